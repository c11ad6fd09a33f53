"""Exact BM25 top-k: sharded inverted indexes with block-max WAND, merged by global statistics.

Every task of the table indexes the documents of its partition in shards, which are closed at ``SHARD_DOCS`` documents or
``SHARD_POSTINGS`` postings, whichever comes first, so neither a large partition nor long documents make a large index. A
shard is a file in the shared folder, named by partition and number and renamed into place, so that a repeated task replaces
it by the same content; no document is shuffled. It holds, per term, the postings in document order, and the terms' document
counts, which are summed over all shards: number of documents, mean length and document counts are those of the whole
table, so a score does not depend on the shard. Within a shard documents are ordered by their most frequent term and
length, and ``BLOCK_DOCS`` documents in order are a block, so that a block holds documents alike.

Queries are written once, in blocks of about ``QUERY_BLOCK``, and a task searches one block of queries in ``GROUP_SHARDS``
shards, one index at a time: its work does not grow with the table, and nothing is dealt but pairs of numbers. A query runs
through a shard as block-max WAND does. Each of its terms has a cursor over the blocks that hold it and a bound, its
greatest impact in the shard. The pivot is the first block at which the bounds of the terms with a cursor up to there
reach the k-th score so far (over all shards passed); all cursors before it move to it. Only there are the block's own
greatest impacts summed, and only if that reaches the k-th score, too, is the block opened and its documents scored; up to
``LOT`` such blocks are opened at once. Without a k-th score the block of the greatest sum is opened first. What remains of
each group is k rows per query, and the merge takes the first k of these.

Every query takes its terms with their counts from its whole text, in lower case (A-Z), over all
documents, its own included. Ties go to the lesser id (null last), then to the earlier place in the shard. Null,
empty and wordless texts match nothing and have no results; they count as documents of length 0. A document that
shares no term with a query is no result. Repeated rows are documents of their own. The same id queried twice is two
queries of that id, whose results are equal. Ids are whole numbers of any width up to 64 bits, null included; other types are
refused before any work. Columns besides id and text are not read, whatever their names.
"""

from __future__ import annotations

import io
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop_folder, drop_table, materialised, new_folder, whole_number
from .tokenfile import _filesystem

K, K1, B = 10, 1.2, 0.75
SHARD_DOCS, SHARD_POSTINGS, BLOCK_DOCS, QUERY_BLOCK, GROUP_SHARDS = 10_000, 4_000_000, 256, 384, 8
#: Pivots that wait to be opened together; the k-th score rises after each lot.
LOT = 16
#: Terms whose hashes a task remembers.
KNOWN_TERMS = 100_000
#: Allowance for rounding when a bound is held against a score.
SLACK = 1e-9
TINY = np.finfo(float).tiny


class Hasher:
    """Hashed terms of texts; a bounded memory spares hashing frequent words again."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Hashed terms in ascending order, and their counts."""
        found = Counter((text or "").encode("utf-8", "surrogatepass").lower().split())
        if len(self.known) > KNOWN_TERMS:
            self.known.clear()
        known, of = self.known, xxhash.xxh64_intdigest
        terms = np.fromiter((known.get(w) or known.setdefault(w, of(w)) for w in found), np.uint64, len(found)).view(np.int64)
        order = np.argsort(terms)
        return terms[order], np.fromiter(found.values(), np.int32, len(found))[order]


def _put(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Writes arrays into one file under a name of its own, and renames it into place."""
    held = io.BytesIO()
    np.savez(held, **arrays)
    fs, name = _filesystem(path)
    fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
    own = f"{name}.{np.random.default_rng().integers(1 << 62):x}"
    with fs.open_output_stream(own) as out:
        out.write(held.getbuffer())
    fs.move(own, name)


def _get(path: str, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Some of the arrays of a file; the others are not read."""
    fs, name = _filesystem(path)
    with fs.open_input_file(name) as source, np.load(source) as held:
        return {n: held[n] for n in names}


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


class Index:
    """A shard: ids, postings by term and document, and greatest impacts by term and block.

    Only ids, lengths, terms and the postings' documents and counts are kept in the file, in the narrowest types; impacts and
    blocks follow from them and the mean length.
    """

    NAMES = ("ids", "absent", "lengths", "terms", "sizes", "docs", "counts")

    def __init__(self, ids: np.ndarray, absent: np.ndarray, lengths: np.ndarray, terms: np.ndarray, sizes: np.ndarray, docs: np.ndarray, counts: np.ndarray) -> None:
        self.ids, self.absent, self.lengths, self.terms, self.sizes, self.docs, self.counts = ids, absent, lengths, terms, sizes, docs, counts

    @classmethod
    def build(cls, ids: list[int | None], terms: list[np.ndarray], counts: list[np.ndarray]) -> Index:
        sizes = np.array([len(t) for t in terms], np.int64)
        return cls.packed(ids, sizes, np.concatenate([np.empty(0, np.int64), *terms]), np.concatenate([np.empty(0, np.int32), *counts]))

    @classmethod
    def packed(cls, ids: list[int | None], sizes: np.ndarray, term: np.ndarray, tf: np.ndarray) -> Index:
        """Of the documents' terms and counts end to end."""
        starts = np.append(0, np.cumsum(sizes))
        lengths = np.add.reduceat(np.append(tf, 0), starts[:-1]).astype(np.int64) * (sizes > 0) if len(ids) else sizes
        main = np.array([term[a + np.argmax(tf[a:b])] if b > a else 0 for a, b in itertools.pairwise(starts.tolist())], np.int64)
        rank = np.lexsort(([i or 0 for i in ids], [i is None for i in ids], lengths, main))  # documents alike side by side, shorter ones first
        place = np.empty(len(rank), np.int32)
        place[rank] = np.arange(len(rank))
        owner = np.repeat(_narrow(place), sizes)
        order = np.lexsort((owner, term))
        docs, counts = owner[order], _narrow(tf)[order]
        term = term[order]
        del order, owner
        kinds, n = np.unique(term, return_counts=True)
        absent = np.array([i is None for i in ids], bool)[rank]
        return cls(np.array([i or 0 for i in ids], np.int64)[rank], absent, _narrow(lengths[rank]), kinds, _narrow(n), docs, counts)

    def save(self, path: str) -> None:
        _put(path, {n: getattr(self, n) for n in self.NAMES})

    @classmethod
    def load(cls, path: str, mean: float) -> Index:
        return cls(**_get(path, cls.NAMES)).ready(mean)

    def ready(self, mean: float) -> Index:
        """Makes impacts and blocks, which a task that only writes the index has no need of."""
        docs, sizes = self.docs, self.sizes
        self.impacts = self.counts.astype(float)
        below = (K1 * (1 - B + B * self.lengths.astype(float) / mean))[docs]
        below += self.impacts
        self.impacts *= K1 + 1
        self.impacts /= below
        del below, self.counts
        kind, block = np.repeat(np.arange(len(self.terms), dtype=np.int32), sizes), docs.astype(np.int32) // BLOCK_DOCS
        starts = np.flatnonzero(np.append(len(docs) > 0, (kind[1:] != kind[:-1]) | (block[1:] != block[:-1]))[: len(docs)])
        self.first = np.searchsorted(kind[starts], np.arange(len(self.terms) + 1))
        self.blocks, self.posting = block[starts], np.append(starts, len(docs))
        self.most = np.maximum.reduceat(self.impacts, starts) if len(starts) else self.impacts
        self.n_blocks = -(-len(self.ids) // BLOCK_DOCS)
        return self

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of the best ``k`` documents with scores not below ``least``, and the number of blocks opened."""
        places, scores, opened = np.empty(0, np.int64), np.empty(0), 0
        if not len(self.terms):
            return places, scores, opened
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        here = np.flatnonzero(self.terms[at] == terms)
        if not len(here):
            return places, scores, opened
        at, weights, n_blocks = at[here], weights[here], self.n_blocks
        lo = self.first[at]
        n = self.first[at + 1] - lo
        entry = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        row, block = np.repeat(np.arange(len(here)), n), self.blocks[entry]
        held = np.zeros((n_blocks, len(here)))  # a term's greatest score in a block
        held[block, row] = weights[row] * self.most[entry]
        bounds = held.max(axis=0)  # and in the shard
        ahead = np.full((n_blocks + 1, len(here)), n_blocks, np.intp)  # a cursor's next block from a block on
        ahead[block, row] = block
        ahead = np.minimum.accumulate(ahead[::-1], axis=0)[::-1]
        by_block = np.argsort(block, kind="stable")  # entries of a block in the order of terms: equal documents have equal sums
        parts = np.append(0, np.cumsum(np.bincount(block, minlength=n_blocks)))
        entry, weight = entry[by_block], weights[row[by_block]]
        begin = self.posting[entry]
        size = self.posting[entry + 1] - begin

        def opens(some: list[int]) -> None:
            nonlocal places, scores, opened
            opened += len(some)
            e = np.concatenate([np.arange(parts[b], parts[b + 1]) for b in some])
            m = size[e]
            p = np.repeat(begin[e] - np.cumsum(m) + m, m) + np.arange(m.sum())
            total = np.bincount(self.docs[p], np.repeat(weight[e], m) * self.impacts[p])
            found = np.flatnonzero(total >= max(limit(), TINY))
            places, scores = np.concatenate([places, found]), np.concatenate([scores, total[found]])
            if len(scores) > k:
                kept = scores >= np.partition(scores, -k)[-k]
                places, scores = places[kept], scores[kept]
            best = np.lexsort((places, self.ids[places], self.absent[places], -scores))[:k]
            places, scores = places[best], scores[best]

        def limit() -> float:
            return max(least, scores[k - 1] if len(scores) >= k else -np.inf) * (1 - SLACK)

        start = -1
        if least == -np.inf:
            start = int(held.sum(axis=1).argmax())
            opens([start])
        cursors, least_now, waiting = ahead[0], limit(), []
        while True:
            reach = np.bincount(cursors, bounds, n_blocks + 1)[:n_blocks].cumsum()
            pivot = int(reach.searchsorted(max(least_now, TINY)))
            if pivot == n_blocks:
                break
            if pivot != start and held[pivot].sum() >= least_now:
                waiting.append(pivot)
                if len(waiting) == LOT or least_now == -np.inf:
                    opens(waiting)
                    least_now, waiting = limit(), []
            cursors = ahead[pivot + 1]
        if waiting:
            opens(waiting)
        kept = scores >= least * (1 - SLACK)
        return places[kept], scores[kept], opened


def build(docs: DataFrame, folder: str, id_col: str = "doc_id", text: str = "text", shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """Writes the shards of ``docs`` into ``folder``; one row per shard: ``part, number, docs, words``."""
    wanted = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    # Many small partitions become fewer, without a shuffle, as each makes a shard of its own; with room, so that few leave a small rest.
    parts, least = wanted.rdd.getNumPartitions(), -(-4 * wanted.count() // (3 * shard_docs))
    wanted = wanted.coalesce(max(1, least, wanted.sparkSession.sparkContext.defaultParallelism)) if least < parts else wanted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size, hasher = TaskContext.get().partitionId(), 0, 0, Hasher()
        ids: list[int | None] = []
        sizes: list[int] = []
        terms, counts = bytearray(), bytearray()  # end to end, as many small arrays would break up the memory

        def close() -> pa.RecordBatch:
            nonlocal number, size, terms, counts
            index = Index.packed(ids, np.array(sizes, np.int64), np.frombuffer(terms, np.int64), np.frombuffer(counts, np.int32))
            index.save(f"{folder}/{part}-{number}.npz")
            row = [[part], [number], [len(ids)], [int(np.frombuffer(counts, np.int32).sum())]]
            ids.clear()
            sizes.clear()
            terms, counts = bytearray(), bytearray()
            number, size = number + 1, 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in row], ["part", "number", "docs", "words"])

        for rb in batches:
            for doc, t in zip(rb.column(0).to_pylist(), rb.column(1), strict=True):
                found = hasher.counts(t.as_py())
                ids.append(doc)
                sizes.append(len(found[0]))
                terms += found[0].tobytes()
                counts += found[1].tobytes()
                size += len(found[0])
                if len(ids) >= shard_docs or size >= shard_postings:
                    yield close()
        if ids:
            yield close()

    return materialised(wanted.mapInArrow(run, "part long, number long, docs long, words long"), "shards")


def _document_counts(shards: DataFrame, folder: str) -> DataFrame:
    """``term`` and ``df`` over all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for part, number in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                held = _get(f"{folder}/{part}-{number}.npz", ("terms", "sizes"))
                for at in range(0, len(held["terms"]), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(held[n][at : at + (1 << 16)].astype(np.int64)) for n in ("terms", "sizes")], ["term", "df"])

    spread = shards.select("part", "number").repartition(max(1, shards.count()), "part", "number")
    return spread.mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _vectors(queries: DataFrame, id_col: str, text: str) -> DataFrame:
    """Queries as ``q`` (a number of its own), ``id``, and ``terms`` and ``counts``."""
    wanted = queries.select(F.monotonically_increasing_id().alias("q"), F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for rb in batches:
            pairs = [hasher.counts(t.as_py()) for t in rb.column(2)]
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array([t for t, _ in pairs], pa.list_(pa.int64())), pa.array([c for _, c in pairs], pa.list_(pa.int32()))], ["q", "id", "terms", "counts"])

    return wanted.mapInArrow(run, "q long, id long, terms array<long>, counts array<int>")


def _query_blocks(asked: DataFrame, counts: DataFrame, n_docs: int, folder: str, blocks: int) -> None:
    """Writes queries with the weights of their terms, a file per block; queries without a known term are left out."""
    pairs = asked.select("q", "id", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("q", "id", F.col("t.terms").alias("term"), F.col("t.counts").alias("n"))
    idf = F.log1p((F.lit(n_docs) - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    # Only terms of queries are looked up; a term that is common in queries is split by adaptive execution.
    needed = counts.join(pairs.select("term").distinct(), "term").select("term", idf.alias("idf"))
    weighted = pairs.join(needed, "term").groupBy("q", "id").agg(F.sort_array(F.collect_list(F.struct("term", (F.col("n") * F.col("idf")).alias("w")))).alias("terms"))
    dealt = weighted.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)))

    def save(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        table = table.sort_by("q")
        lists = table.column("terms").combine_chunks()
        flat, ends = lists.flatten(), np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))
        ids = table.column("id")
        arrays = {"q": table.column("q").to_numpy(), "ids": ids.fill_null(0).to_numpy(), "absent": ids.is_null().to_numpy(), "ends": ends}
        _put(f"{folder}/q{block}.npz", arrays | {n: flat.field(n).to_numpy(zero_copy_only=False) for n in ("term", "w")})
        return pa.table({"block": pa.array([block], pa.int64())})

    materialised(dealt.groupBy("block").applyInArrow(save, "block long"), "blocks")


def top_k(docs: DataFrame, queries: DataFrame, k: int = K, id_col: str = "doc_id", text: str = "text", shard_docs: int = SHARD_DOCS, group_shards: int = GROUP_SHARDS) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``doc_id`` and ``score`` of the best ``k`` of ``docs`` for each row of ``queries``.

    The search is done when this returns; index and query files are gone by then, what remains is a table of the result.
    """
    spark = docs.sparkSession
    whole_number(docs, id_col)
    whole_number(queries, id_col)
    folder = new_folder(spark, "index")
    shards = build(docs, folder, id_col, text, shard_docs)
    n, words = shards.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    mean = words / n if words else 1.0
    asked = materialised(_vectors(queries, id_col, text), "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    _query_blocks(asked, _document_counts(shards, folder), n, folder, blocks)
    # One number per task that built shards, as the driver holds for any job; it tells where the shards of a group are.
    per_part = sorted(tuple(r) for r in shards.groupBy("part").agg(F.count("*")).collect())
    parts, sizes = (np.array([r[i] for r in per_part], np.int64) for i in (0, 1))
    ends = np.cumsum(sizes)
    groups = -(-int(sizes.sum()) // group_shards)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for number in rb.column(0).to_pylist():
                yield from one(number // blocks, number % blocks)

    def one(group: int, block: int) -> Iterator[pa.RecordBatch]:
        try:
            asks = _get(f"{folder}/q{block}.npz", ("q", "ids", "absent", "ends", "term", "w"))
        except FileNotFoundError:  # no query was dealt to this block
            return
        spans = list(zip(asks["ends"][:-1].tolist(), asks["ends"][1:].tolist(), strict=True))
        none = (np.empty(0, np.int64), np.empty(0, bool), np.empty(0))
        best = [none] * len(spans)
        for shard in range(group * group_shards, min((group + 1) * group_shards, int(ends[-1]))):
            p = int(np.searchsorted(ends, shard, "right"))
            index = None  # the last one goes before the next one comes
            index = Index.load(f"{folder}/{parts[p]}-{shard - (ends[p] - sizes[p])}.npz", mean)
            for r, (a, b) in enumerate(spans):
                ids, absent, scores = best[r]
                places, more, _ = index.search(asks["term"][a:b], asks["w"][a:b], k, scores[k - 1] if len(scores) >= k else -np.inf)
                ids, absent, scores = np.concatenate([ids, index.ids[places]]), np.concatenate([absent, index.absent[places]]), np.concatenate([scores, more])
                order = np.lexsort((ids, absent, -scores))[:k]
                best[r] = ids[order], absent[order], scores[order]
        sizes_ = [len(s) for *_, s in best]
        ids, absent, scores = (np.concatenate([none[i], *(x[i] for x in best)]) for i in range(3))
        columns = [pa.array(np.repeat(asks["q"], sizes_)), pa.array(np.repeat(asks["ids"], sizes_), mask=np.repeat(asks["absent"], sizes_)), pa.array(ids, mask=absent), pa.array(scores)]
        yield pa.RecordBatch.from_arrays(columns, ["q", "query_id", "doc_id", "score"])

    pairs = spark.range(0, groups * blocks, 1, max(1, min(groups * blocks, 1 << 14)))
    found = pairs.mapInArrow(search, "q long, query_id long, doc_id long, score double")
    place: Column = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    result = materialised(found.withColumn("rank", place.cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score"), "found")
    drop_folder(spark, folder)
    for table in (shards, asked):
        drop_table(table)
    return result
