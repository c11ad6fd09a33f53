from __future__ import annotations

import pytest

#: A small table with nulls, empty and blank texts, repeated rows, ties and a clashing extra column.
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 60), (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 60),
    (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 60), (3, None, "en", None, None), (4, "", None, "a", 0), (5, " \n\t ", "de", "b", 4), (6, "one", "en", "a", 3),
    (None, "no id here but words enough to count as a text of its own kind", "fr", "c", 62), (7, "mail jo.doe@mail.example.com or +1 (017) 555-5036, ip 19.37.233.111 card 4539578763621486", "en", "a", 90),
    (8, "a\n" * 40, "en", "a", 80), (9, "wörter über größe façade 日本語 🙂 don't stop " * 30, "de", "b", 1), (10, "x" * 5000 + "  " + "y z " * 3000, "en", "a", 1),
]


@pytest.fixture(scope="session")
def small(spark):
    return spark.createDataFrame([(*r, "extra") for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long, fp string").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(small):
    return small.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


SF = "/root/testdata/sf0.001"
