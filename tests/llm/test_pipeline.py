"""The pipeline stage by stage against its operators' brute-force versions."""

from __future__ import annotations

import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from assayflow.llm import rulefit, tokens

from .test_operators import SF, base_slow, components_slow, fp_slow, spans_slow


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], SF).cache())
        assert kept[-1].columns == docs.columns
    ids = [{r.doc_id: r.text for r in d.collect()} for d in kept]
    model = rulefit.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(ids[1]) == {r.doc_id for r in rulefit.scored(docs, model).where(F.col("score") >= 0.3).collect()}
    assert set(ids[2]) <= {i for i, t in ids[1].items() if not base_slow(t)[5]}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    clean = {i for i in good & set(ids[1]) if not base_slow(ids[1][i])[5]}
    assert len(clean - set(ids[2])) <= 0.02 * len(clean)  # 200 documents make rough estimates
    assert set(ids[3]) == set(components_slow({i: fp_slow(t) for i, t in ids[2].items()}).values())
    assert set(ids[4]) == set(ids[3]) and all(not spans_slow(t) for t in ids[4].values())
    secret = re.compile('(?i)token = "[0-9a-f]{40}"')
    assert all(ids[4][i] == t for i, t in ids[3].items() if not spans_slow(t) and not secret.search(t)) and not any(secret.search(t) for t in ids[4].values())
    e = tokens.Encoder(tokens.default_vocabulary())
    want = {i: np.append(x, np.uint32(0)) for i, x in zip(ids[4], e.encode(ids[4].values()), strict=True)}
    rows = corpus_pipeline.STAGES[-1][1](spark, kept[4], SF).collect()
    assert sum(r.length for r in rows) == sum(map(len, want.values()))
    assert all(r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].astype("<u4").tobytes()) for r in rows)


@pytest.mark.parametrize("empty_table", [False, True])
def test_stages_take_odd_rows(spark, small, empty_table, tmp_path):
    """Every stage but the last returns the columns of its input, and rows with their own values in them, whatever the columns are called."""
    spark.createDataFrame([(1, 1, 0), (6, 0, 0), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    others = ("quality", "Score", "__score", "row", "f", "s", "key", "fp", "spans", "component_id")
    docs = small.drop("fp").withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in others})
    docs = docs.limit(0) if empty_table else docs
    columns, before = docs.columns, [r.asDict() for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == columns, name
        rows = [r.asDict() for r in docs.collect()]
        assert all(r[n] == f"{n}{'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for n in others), name
        same = ("doc_id", "lang", "source") + (() if name == "personal data" else ("text", "n_chars"))
        left = [tuple(r[c] for c in same) for r in before]
        for r in rows:
            left.remove(tuple(r[c] for c in same))  # each row is one of those before, repeats counted
        if name == "quality rules":
            assert all(not base_slow(r["text"])[5] for r in rows)
        if name == "near-duplicates" and rows:
            fps = {r["doc_id"]: fp_slow(r["text"]) for r in before if r["doc_id"] is not None}
            assert {r["doc_id"] for r in rows if r["doc_id"] is not None} == set(components_slow(fps).values()) and len(rows) == len({r["doc_id"] for r in rows})
        if name == "personal data":
            assert len(rows) == len(before) and all(r["text"] is None or not spans_slow(r["text"]) for r in rows)
        before = rows
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {r["doc_id"] for r in before} and all(r.length > 0 for r in packed)
