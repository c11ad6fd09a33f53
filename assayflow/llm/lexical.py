"""Ranked lexical search: documents at a time, by a heap merge over compressed postings in the order of ``doc_id``.

Every task of the table indexes the documents of its partition in shards, which are closed at ``SHARD_DOCS`` documents or
``SHARD_POSTINGS`` postings, whichever comes first. A shard is a file in the shared folder, named by partition and number and
renamed into place, so that a repeated task replaces it by the same content; no document is shuffled. Its documents are
numbered in ascending ``doc_id``, and each term's postings are gaps between these numbers and occurrences, both in bytes of
seven bits. What a score needs of the whole table (number of documents with a term, all terms, documents that hold a term)
is summed over all shards, so a score does not depend on the shard.

Queries are written once, in blocks of about ``QUERY_BLOCK``, and a task runs one block through a group of shards, one shard
at a time. A query has a cursor per term; a heap of the cursors, keyed by document, gives the next document and all its
terms, whose whole-number impacts are summed; a heap of at most ``k`` results, keyed by score and then by ``doc_id``, goes
along through the group's shards. The merge takes the first ``k`` of what the groups leave.

Terms are the maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of the whole text, A-Z in lower case,
identified by 64-bit hashes. A document without a term counts in no number and is never found; so a null, empty or blank
text. Repeated rows are documents of their own with equal scores, and a null ``doc_id`` stands after all others. Each row of
the queries is a query of its own; one without a term that the table holds gives no rows, as do empty tables. Columns beside
the two named ones are not read, whatever their names.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import _get, _narrow, _put
from .shared import broadcast_if_small, drop_folder, drop_table, materialised, new_folder, whole_number

K = 50
SHARD_DOCS, SHARD_POSTINGS, QUERY_BLOCK, MOST_GROUP = 10_000, 4_000_000, 256, 32
#: Terms whose hashes a task remembers.
KNOWN_TERMS = 100_000
#: Bits of an impact: weights stay below 2^16 and the other factor is at most 10^6.
IMPACT_BITS = 36

#: Bytes as terms have them: A-Z in lower case, separators as spaces; the bytes of all other characters are from 0x80 on.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """All terms of a text in order, with repeats."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


class Hasher:
    """Hashes of terms; a bounded memory spares hashing frequent ones again."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The hashed terms of a text and their occurrences."""
        found = Counter(terms_of(text))
        if len(self.known) > KNOWN_TERMS:
            self.known.clear()
        known, of = self.known, xxhash.xxh64_intdigest
        terms = np.fromiter((known.get(w) or known.setdefault(w, of(w)) for w in found), np.uint64, len(found)).view(np.int64)
        return terms, np.fromiter(found.values(), np.int64, len(found))


def squeezed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers as bytes of seven bits, the last of each number below 128, and the number of bytes of each."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        sizes += values >= np.uint64(1 << bits)
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for place in range(int(sizes.max(initial=0))):
        at = sizes > place
        low = (values[at] >> np.uint64(7 * place)).astype(np.uint8) & 127
        out[(ends - sizes)[at] + place] = low | np.where(sizes[at] > place + 1, 128, 0).astype(np.uint8)
    return out, sizes


def unsqueezed(data: np.ndarray) -> np.ndarray:
    """The numbers that ``squeezed`` wrote into ``data``."""
    ends = np.flatnonzero(data < 128)
    starts = np.append(0, ends[:-1] + 1)[: len(ends)]
    if len(ends) == len(data):
        return data.astype(np.int64)
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts)


class Postings:
    """A shard: ids in ascending order, lengths, and per term the compressed numbers and occurrences of its documents."""

    NAMES = ("ids", "absent", "lengths", "terms", "sizes", "gaps", "gap_bytes", "counts", "count_bytes")

    def __init__(self, **arrays: np.ndarray) -> None:
        for name in self.NAMES:
            setattr(self, name, arrays[name])
        self.gap_ends, self.count_ends = (np.append(0, np.cumsum(a, dtype=np.int64)) for a in (self.gap_bytes, self.count_bytes))

    @classmethod
    def packed(cls, ids: list[int | None], sizes: np.ndarray, term: np.ndarray, tf: np.ndarray) -> Postings:
        """Of the documents' terms and occurrences end to end."""
        absent = np.array([i is None for i in ids], bool)
        rank = np.lexsort(([i or 0 for i in ids], absent))
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        owner = np.repeat(place, sizes)
        lengths = np.bincount(owner, tf, len(rank)).astype(np.int64)
        order = np.lexsort((owner, term))
        term, owner, tf = term[order], owner[order], tf[order]
        first = np.append(len(term) > 0, term[1:] != term[:-1])[: len(term)]
        starts = np.flatnonzero(first)
        gaps, gap_sizes = squeezed(np.where(first, owner, np.diff(owner, prepend=0)))
        counts, count_sizes = squeezed(tf)
        per_term = lambda x: _narrow(np.add.reduceat(x, starts)) if len(starts) else x
        return cls(ids=np.array([i or 0 for i in ids], np.int64)[rank], absent=absent[rank], lengths=_narrow(lengths), terms=term[starts], sizes=_narrow(np.diff(np.append(starts, len(term)))),
                   gaps=gaps, gap_bytes=per_term(gap_sizes), counts=counts, count_bytes=per_term(count_sizes))

    def save(self, path: str) -> None:
        _put(path, {n: getattr(self, n) for n in self.NAMES})

    @classmethod
    def load(cls, path: str) -> Postings:
        return cls(**_get(path, cls.NAMES))

    def prepare(self, n_docs: int, n_terms: int) -> Postings:
        """Takes in what the impacts need of the whole table."""
        self.below = 20 * (50 + 50 * self.lengths.astype(np.int64) * n_docs // n_terms)
        self.read: dict[tuple[int, int], np.ndarray] = {}
        return self

    def cursor(self, term: int, weight: int) -> np.ndarray | None:
        """The term's documents in order, each with its impact in the low bits; read once per block of queries."""
        if (found := self.read.get((term, weight))) is None:
            at = int(np.searchsorted(self.terms, term))
            if at == len(self.terms) or self.terms[at] != term:
                return None
            docs = np.cumsum(unsqueezed(self.gaps[self.gap_ends[at] : self.gap_ends[at + 1]]))
            tf = unsqueezed(self.counts[self.count_ends[at] : self.count_ends[at + 1]])
            impacts = weight * (1_000_000_000 * tf // (1000 * tf + self.below[docs]))
            found = self.read[term, weight] = docs << IMPACT_BITS | impacts
        return found

    def search(self, terms: list[int], weights: list[int], k: int, best: list[tuple[int, int, int]]) -> None:
        """Puts the shard's best documents into ``best``, a heap of at most ``k`` entries of score and descending ``doc_id`` (whether absent, id)."""
        cursors = [c.tolist() for t, w in zip(terms, weights, strict=True) if w and (c := self.cursor(t, w)) is not None]
        ids, absent = self.ids, self.absent
        each, bits = [iter(c) for c in cursors], len(cursors).bit_length()
        heap = [next(c) << bits | i for i, c in enumerate(each)]  # document, impact, cursor
        heapq.heapify(heap)
        which, impact, shift = (1 << bits) - 1, (1 << IMPACT_BITS) - 1, IMPACT_BITS + bits
        replace, pop = heapq.heapreplace, heapq.heappop
        least = best[0] if len(best) >= k else (0, 0, 0)
        while heap:
            entry = heap[0]
            doc, score = entry >> shift, 0
            while entry >> shift == doc:
                score += entry >> bits & impact
                i = entry & which
                if (after := next(each[i], None)) is None:
                    pop(heap)
                    if not heap:
                        break
                else:
                    replace(heap, after << bits | i)
                entry = heap[0]
            if score >= least[0] and score > 0 and (found := (score, -int(absent[doc]), -int(ids[doc]))) > least:
                if len(best) < k:
                    heapq.heappush(best, found)
                else:
                    replace(best, found)
                least = best[0] if len(best) >= k else (0, 0, 0)


def build(docs: DataFrame, folder: str, id_col: str = "doc_id", text: str = "text", shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """Writes the shards of ``docs`` into ``folder``; one row per shard: ``part, number, docs`` (with a term) and ``words``."""
    wanted = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size, hasher = TaskContext.get().partitionId(), 0, 0, Hasher()
        ids: list[int | None] = []
        sizes: list[int] = []
        terms, counts = bytearray(), bytearray()  # end to end, as many small arrays would break up the memory

        def close() -> pa.RecordBatch:
            nonlocal number, size, terms, counts
            tf = np.frombuffer(counts, np.int64)
            Postings.packed(ids, np.array(sizes, np.int64), np.frombuffer(terms, np.int64), tf).save(f"{folder}/{part}-{number}.npz")
            row = [[part], [number], [len(ids)], [int(tf.sum())]]
            ids.clear()
            sizes.clear()
            terms, counts = bytearray(), bytearray()
            number, size = number + 1, 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in row], ["part", "number", "docs", "words"])

        for rb in batches:
            for doc, t in zip(rb.column(0).to_pylist(), rb.column(1), strict=True):
                found = hasher.counts(t.as_py())
                if not len(found[0]):
                    continue
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


def _document_counts(shards: DataFrame, folder: str, needed: DataFrame, n_shards: int) -> DataFrame:
    """``term`` and ``df`` over all shards of the ``needed`` terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for part, number in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                held = _get(f"{folder}/{part}-{number}.npz", ("terms", "sizes"))
                for at in range(0, len(held["terms"]), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(held[n][at : at + (1 << 16)].astype(np.int64)) for n in ("terms", "sizes")], ["term", "df"])

    spread = shards.select("part", "number").repartition(max(1, n_shards), "part", "number")
    return spread.mapInArrow(run, "term long, df long").join(broadcast_if_small(needed), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))


def _asked(queries: DataFrame, id_col: str, text: str) -> DataFrame:
    """Queries as ``q`` (a number of its own), ``id`` and their distinct ``terms``."""
    wanted = queries.select(F.monotonically_increasing_id().alias("q"), F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for rb in batches:
            terms = pa.array([np.sort(hasher.counts(t.as_py())[0]) for t in rb.column(2)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), terms], ["q", "id", "terms"])

    return wanted.mapInArrow(run, "q long, id long, terms array<long>")


def _query_blocks(asked: DataFrame, counts: DataFrame, n_docs: int, folder: str, blocks: int) -> None:
    """Writes queries with the weights of their terms, a file per block; queries without a known term are left out."""
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2) / (F.lit(2.0) * F.col("df") + 1)))
    pairs = asked.select("q", "id", F.explode("terms").alias("term")).join(counts.select("term", weight.alias("w")), "term")
    weighted = pairs.groupBy("q", "id").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("terms"))

    def save(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        table = table.sort_by("q")
        lists = table.column("terms").combine_chunks()
        flat, ids = lists.flatten(), table.column("id")
        arrays = {"q": table.column("q").to_numpy(), "ids": ids.fill_null(0).to_numpy(), "absent": ids.is_null().to_numpy(), "ends": np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))}
        _put(f"{folder}/q{block}.npz", arrays | {n: flat.field(n).to_numpy(zero_copy_only=False) for n in ("term", "w")})
        return pa.table({"block": pa.array([block], pa.int64())})

    drop_table(materialised(weighted.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks))).groupBy("block").applyInArrow(save, "block long"), "blocks"))


def top_k(docs: DataFrame, queries: DataFrame, k: int = K, id_col: str = "doc_id", text: str = "text", query_id: str = "item_id", query_text: str = "text", shard_docs: int = SHARD_DOCS) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``doc_id`` and ``score`` of the best ``k`` of ``docs`` for each row of ``queries``.

    The search is done when this returns; index and query files are gone by then, what remains is a table of the result.
    """
    spark = docs.sparkSession
    whole_number(docs, id_col)
    whole_number(queries, query_id)
    folder = new_folder(spark, "lexical")
    shards = build(docs, folder, id_col, text, shard_docs)
    n_docs, n_terms, n_shards = shards.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0)), F.count("*")).first()
    asked = materialised(_asked(queries, query_id, query_text), "asked")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    needed = asked.select(F.explode("terms").alias("term")).distinct()
    _query_blocks(asked, _document_counts(shards, folder, needed, n_shards), n_docs, folder, blocks)
    # One number per task that built shards, as the driver holds for any job; it tells where the shards of a group are.
    per_part = sorted(tuple(r) for r in shards.groupBy("part").agg(F.count("*")).collect())
    parts, sizes = (np.array([r[i] for r in per_part], np.int64) for i in (0, 1))
    ends = np.cumsum(sizes)
    group = max(1, min(MOST_GROUP, n_shards * blocks // (4 * spark.sparkContext.defaultParallelism)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for number in rb.column(0).to_pylist():
                yield from one(number // blocks, number % blocks)

    def one(at: int, block: int) -> Iterator[pa.RecordBatch]:
        try:
            asks = _get(f"{folder}/q{block}.npz", ("q", "ids", "absent", "ends", "term", "w"))
        except FileNotFoundError:  # no query was dealt to this block
            return
        terms, weights, ends_ = asks["term"].tolist(), asks["w"].tolist(), asks["ends"].tolist()
        best: list[list[tuple[int, int, int]]] = [[] for _ in asks["q"]]
        for number in range(at * group, min((at + 1) * group, n_shards)):
            p = int(np.searchsorted(ends, number, "right"))
            shard = None  # the last one goes before the next one comes
            shard = Postings.load(f"{folder}/{parts[p]}-{number - (ends[p] - sizes[p])}.npz").prepare(n_docs, n_terms)
            for r, found in enumerate(best):
                shard.search(terms[ends_[r] : ends_[r + 1]], weights[ends_[r] : ends_[r + 1]], k, found)
        sizes_ = [len(b) for b in best]
        flat = [x for b in best for x in b]
        columns = [
            pa.array(np.repeat(asks["q"], sizes_)), pa.array(np.repeat(asks["ids"], sizes_), mask=np.repeat(asks["absent"], sizes_)),
            pa.array([-i for _, _, i in flat], pa.int64(), mask=np.array([a != 0 for _, a, _ in flat], bool)), pa.array([s for s, _, _ in flat], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["q", "query_id", "doc_id", "score"])

    tasks = -(-n_shards // group) * blocks
    found = spark.range(0, tasks, 1, max(1, min(tasks, 1 << 14))).mapInArrow(search, "q long, query_id long, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    result = materialised(found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score"), "ranked")
    drop_folder(spark, folder)
    for table in (shards, asked):
        drop_table(table)
    return result


def oracle(k: int = K) -> str:
    """DuckDB SQL for ``top_k`` of ``documents`` for each row of ``benchmark``."""
    terms = "unnest(regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
    return f"""
WITH words AS (SELECT doc_id, {terms.format("text")} AS term FROM documents), tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY ALL), whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, whole GROUP BY term, docs),
damping AS (SELECT doc_id, 50 + 50 * n * docs // words AS m FROM lengths, whole),
asked AS (SELECT DISTINCT item_id, {terms.format("text")} AS term FROM benchmark),
scores AS (SELECT item_id, doc_id, sum(w * (1000000000 * tf // (1000 * tf + 20 * m)))::BIGINT AS score FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN damping USING (doc_id) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= {k}"""
