"""Prefix tries, ranked lexical search and substring dedup against brute force, on edge cases and on the smallest tables."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from assayflow.llm import lexical, prefixtrie, queries, substrings

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


# Prefix tries


def rebuilt_slow(rows, family=5, heads=9):
    """rows: conv_id, turn, role, text; returns conv -> list of (role, text)."""
    md5 = lambda r, t: [int.from_bytes(hashlib.md5(f"{len(r)}:{r}{t}".encode()).digest()[i : i + 8], "big", signed=True) for i in (0, 8)]
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", md5(role or "", text or ""), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    if not family:
        return own
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        out[c] = own.get(c - int(math.fmod(c, family)), [])[:h] + v[h:]
    return out


def trie_slow(convs):
    members = collections.defaultdict(list)
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children = collections.defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[c] for c in children[p]) if children[p] else 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[c] for c in children[p])
    digest = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(convs[c]) == len(p)).encode()).hexdigest()
    return sorted(str((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], digest(p))) for p, m in members.items())


@pytest.mark.parametrize("shard_rows", [1 << 18, 60, 1])
def test_trie_of_the_table(spark, shard_rows):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    want = trie_slow(rebuilt_slow([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]))
    assert rows_of(prefixtrie.trie(prefixtrie.rebuilt(prefixtrie.turns_of(table)), shard_rows)) == want
    got = queries.op11_prefixtrie(spark, SF)
    assert rows_of(got) == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    assert sorted(map(str, con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL['op11_prefixtrie']})").fetchall())) == want


@pytest.fixture(scope="module")
def odd_turns(spark):
    rng = random.Random(1)
    rows = [(0, None, "user", "hi"), (0, None, "user", "hi"), (0, 1, None, None), (1, 5, "user", ""), (1, 5, "", "user"), (2, 1, "a", "b"), (2, 1, "ab", ""), (None, 1, "user", "lost"), (-3, 1, "user", "ü🙂"), (-5, 0, "user", "neg"), (-5, 3000, "user", "far")]
    rows += [(c, t, rng.choice("ua"), rng.choice("xyz") * rng.randrange(3)) for c in range(10, 90) for t in range(rng.randrange(6))]
    rows += [(c, t, "u", "the same") for c in range(200, 260) for t in range(3)] + [(300, t, "u", f"t{t % 7}") for t in range(2500)] + [(305, t, "u", f"t{t % 7}") for t in range(2100)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, left long").repartition(5).cache()


@pytest.mark.parametrize(("shard_rows", "family"), [(1 << 18, 5), (50, 5), (1, 5), (200, 0)])
def test_trie_of_odd_turns(odd_turns, shard_rows, family, monkeypatch):
    rows, table = odd_turns
    monkeypatch.setattr(prefixtrie, "CHUNK", 7)
    turns = prefixtrie.turns_of(table)
    got = prefixtrie.trie(prefixtrie.rebuilt(turns) if family else prefixtrie.plain(turns), shard_rows)
    assert rows_of(got) == trie_slow(rebuilt_slow(rows, family))


def test_trie_of_nothing(odd_turns):
    empty = odd_turns[1].limit(0)
    assert prefixtrie.trie(prefixtrie.rebuilt(prefixtrie.turns_of(empty))).collect() == []


def test_turnless_conversation(spark):
    """Conversation 12 takes no turn from an absent one and has fewer turns than it gives up: a member of the root alone."""
    c = next(c for c in range(11, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    table = spark.createDataFrame([(c, 0, "u", "x")], "conv_id long, turn long, role string, text string")
    got = prefixtrie.trie(prefixtrie.rebuilt(prefixtrie.turns_of(table))).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_louds():
    """A top with two roots; the first has two children, the second of which has one."""
    tree = prefixtrie.Louds(np.array([2, 0, 0, 1, 0]), 2, np.zeros((5, 3)))
    assert tree.parents().tolist() == [-1, -1, 0, 0, 3]
    assert tree.degrees().tolist() == [2, 0, 0, 1, 0]


# Ranked lexical search


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def ranked_slow(docs, items, k):
    tfs = [(i, collections.Counter(TERM.findall(lower(t)))) for i, t in docs]
    tfs = [(i, c) for i, c in tfs if c]
    n_docs, n_terms = len(tfs), sum(sum(c.values()) for _, c in tfs)
    df = collections.Counter(t for _, c in tfs for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in tfs:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in {*TERM.findall(lower(text))} if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("shard_docs", [10_000, 7])
def test_lexical_of_the_tables(spark, shard_docs):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = ranked_slow([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 50)
    assert rows_of(lexical.top_k(docs.repartition(3), items, shard_docs=shard_docs)) == want


def test_lexical_twin(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows_of(queries.op12_lexical(spark, SF).select("item_id", "rank", "doc_id", "score")) == sorted(map(str, con.sql(f"SELECT item_id, rank, doc_id, score FROM ({queries.ORACLE_SQL['op12_lexical']})").fetchall()))


def test_lexical_odd_rows(spark, small, empty):
    items = [(1, "The QUICK fox; Dog? don't"), (1, "The QUICK fox; Dog? don't"), (None, "wörter über"), (3, None), (4, "  ,;"), (5, "zzz unknown"), (6, "a a a a")]
    asked = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, rank int")
    want = ranked_slow([(r.doc_id, r.text) for r in small.collect()], items, 3)
    for shard_docs in (100, 1):
        assert rows_of(lexical.top_k(small, asked, 3, shard_docs=shard_docs)) == want
    assert lexical.top_k(empty, asked).collect() == []
    assert lexical.top_k(small, asked.limit(0)).collect() == []


def test_squeezed():
    values = np.array([0, 1, 127, 128, 300, 16383, 16384, 1 << 40, 5])
    assert lexical.unsqueezed(lexical.squeezed(values)[0]).tolist() == values.tolist()
    assert len(lexical.unsqueezed(lexical.squeezed(values[:0])[0])) == 0


def test_terms_are_bytes_beyond_ascii():
    for text in ("Ünï_cöde-x9 A.b\x00c", "日本語 x　y", "\x85a\xa0b", ""):
        assert [t.decode() for t in lexical.terms_of(text)] == TERM.findall(lower(text))


# Substring dedup


def dedup_slow(docs, window=50):
    big = 1 << 62
    first = {}
    for i, t in docs:
        w = WORD.findall(t or "")
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            first[key] = min(first.get(key, big), big if i is None else i)
    out = []
    for i, t in docs:
        w = WORD.findall(t or "")
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < (big if i is None else i):
                gone |= {*range(p, p + window)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(map(str, out))


@pytest.mark.parametrize(("hot", "shard_words"), [(2000, 1 << 20), (0, 500)])
def test_dedup_of_the_table(spark, documents, hot, shard_words):
    want = dedup_slow([(r.doc_id, r.text) for r in documents.collect()])
    assert rows_of(substrings.dedup(documents, hot=hot, shard_words=shard_words)) == want


def test_dedup_twin(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    columns = "doc_id, n_words, n_removed, kept_sha256"
    assert rows_of(queries.op13_substrings(spark, SF).select(*columns.split(", "))) == sorted(map(str, con.sql(f"SELECT {columns} FROM ({queries.ORACLE_SQL['op13_substrings']})").fetchall()))


@pytest.mark.parametrize("hot", [2000, 1])
def test_dedup_of_planted_passages(spark, hot):
    """Passages of 49, 50, 51 and 300 words in text of their own, runs of one word, repeats within a document, equal ids, nulls."""
    rng = random.Random(7)
    some = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(n))
    passages = [some(n) for n in (49, 50, 51, 300)]
    rows = [(i, " \n".join([some(rng.randrange(9)), rng.choice(passages), some(rng.randrange(70)), rng.choice(passages)])) for i in range(40)]
    rows += [(100, "x " * 500), (101, "x " * 120 + "y"), (102, "x " * 49), (50, passages[3] + " " + passages[3]), (51, passages[3]), (51, passages[3]), (51, passages[2]), (None, passages[3]), (None, None), (7, ""), (8, None), (-4, passages[1] + " Ü　é"), (60, passages[1].replace(" ", "\t\n"))]
    table = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, spans string").repartition(4)
    assert rows_of(substrings.dedup(table, hot=hot, shard_words=3000)) == dedup_slow(rows)


def test_dedup_odd_rows(spark, small, empty):
    assert rows_of(substrings.dedup(small)) == dedup_slow([(r.doc_id, r.text) for r in small.collect()])
    assert substrings.dedup(empty).collect() == []


def test_least_owners():
    rng = random.Random(3)
    base = [rng.choice("abcdefgh") for _ in range(400)]
    texts = [[rng.choice("abcxyz") for _ in range(rng.randrange(20))] + base[i : i + rng.randrange(50, 100)] for i in (rng.randrange(300) for _ in range(30))] + [["a"] * 70, ["a"] * 120]
    owners = np.array([rng.randrange(40) for _ in texts])
    least = {}
    for w, o in zip(texts, owners.tolist(), strict=True):
        for p in range(len(w) - 49):
            least[tuple(w[p : p + 50])] = min(o, least.get(tuple(w[p : p + 50]), 99))
    got = substrings.least_owners([" ".join(w) for w in texts], owners)
    assert [g.tolist() for g in got] == [[least[tuple(w[p : p + 50])] for p in range(len(w) - 49)] for w in texts]


def test_pieces_hold_each_window_once():
    rng = random.Random(5)
    docs = [[rng.choice("abc") + str(rng.randrange(50)) for _ in range(rng.randrange(300))] for _ in range(20)] + [["x"] * 500, []]
    hasher = substrings.Hasher()
    words = np.concatenate([hasher.of([w.encode() for w in d]) for d in docs])
    held = collections.defaultdict(list)
    for doc, start, n, _, _ in zip(*substrings.pieces(words, np.cumsum([len(d) for d in docs])), strict=True):
        held[int(doc)] += range(start, start + n)
    assert all(sorted(held[i]) == list(range(max(0, len(d) - 49))) for i, d in enumerate(docs))
