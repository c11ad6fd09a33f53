"""SimHash near-duplicates by a grid range-join in the space of segment popcounts.

A 64-bit fingerprint is mapped to the bit counts (0, 1 or 2) of its 32 two-bit segments. The Manhattan
distance of two such vectors never exceeds the Hamming distance of the fingerprints, so pairs within
3 bits lie within Manhattan distance 3. Of the two halves of the vector (16 segments each) one then
differs by at most ``3 // 2 = 1``: it is the same grid cell, or a neighbour one step away in one
dimension. Every distinct fingerprint is stored under the cells of its two halves, and probes its own
and its upper neighbour cells; of two adjacent cells one is the upper neighbour of the other, so no pair
is lost. What meets in a cell is cut by the full Manhattan distance and then verified on the
fingerprints themselves.

Exact copies are folded into one fingerprint before the join, only verified links leave it, and the
join's sides are plain shuffles, so adaptive execution can split a hot cell. Beyond ``FINE_GRID`` distinct
fingerprints the cells also carry one segment-count octet of the other half: as the other half is within
distance 3, at least one of its four octets agrees, so this loses no pair either and divides the cells by
about 64. Both grids give the same links.

Nulls, empty and blank texts have fingerprint zero, which links like any other. Null ids keep a row; a
component whose ids are all null has a null ``component_id``. Repeated rows each return a row, an empty table gives an
empty one, and columns besides id and text may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialised

SHINGLE = 3
SEED = 42
MAX_BITS = 3
FINE_GRID = 1 << 24
#: Shingles hashed at a time, which bounds the memory a very long text needs.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of the word shingles of a text, repeats included; 0 without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    total = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, BLOCK):
        part = words[at : at + min(BLOCK, total - at) + shingle - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)))) if total > 1 else [b" ".join(words)]
        hashes = np.array([digest(g, seed) for g in grams], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE) -> DataFrame:
    """``keep`` columns and ``fp``, the fingerprint as a signed 64-bit integer."""
    wanted = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    schema = wanted.drop("__text").withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(x.as_py(), shingle) for x in batch.column(len(keep))]
            fps = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], fps], [*keep, "fp"])

    return wanted.mapInArrow(run, schema)


def _segment_counts(fp: Column) -> Column:
    """The popcounts of the 32 two-bit segments, each in its own two bits."""
    mask = F.lit(0x5555555555555555)
    even, odd = fp.bitwiseAND(mask), F.shiftrightunsigned(fp, 1).bitwiseAND(mask)
    return even.bitwiseXOR(odd).bitwiseOR(F.shiftleft(even.bitwiseAND(odd), 1))


def _unary(counts: Column) -> Column:
    """Counts 0, 1, 2 as bits 00, 01, 11: the popcount of an XOR is then the Manhattan distance."""
    return counts.bitwiseOR(F.shiftrightunsigned(counts.bitwiseAND(F.lit(-0x5555555555555556)), 1))


def links(fps: DataFrame, max_bits: int = MAX_BITS, fine: bool = False) -> DataFrame:
    """Pairs ``(u, v)`` of distinct fingerprints (column ``fp``) that differ in at most ``max_bits`` <= 3 bits.

    A pair that meets in several cells appears several times.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the grid's radius of one step per half covers at most 3 bits")
    low = F.lit(0xFFFFFFFF)
    cells = fps.select("fp", _segment_counts(F.col("fp")).alias("n")).select("fp", "n", _unary(F.col("n")).alias("unary"))
    halves = cells.select("fp", "unary", F.posexplode(F.array(F.col("n").bitwiseAND(low), F.shiftrightunsigned("n", 32).bitwiseAND(low))).alias("half", "cell"), "n")
    if fine:
        other = F.when(F.col("half") == 0, F.shiftrightunsigned("n", 32)).otherwise(F.col("n").bitwiseAND(low))
        octets = F.array(*[F.shiftrightunsigned(other, 8 * k).bitwiseAND(F.lit(255)) for k in range(4)])
        halves = halves.select("fp", "unary", "half", "cell", F.posexplode(octets).alias("octet", "side"))
    else:
        halves = halves.select("fp", "unary", "half", "cell", F.lit(0).alias("octet"), F.lit(0).cast("long").alias("side"))
    steps = [F.when(F.shiftrightunsigned("cell", 2 * k).bitwiseAND(F.lit(3)) < 2, F.col("cell") + F.lit(1 << 2 * k)) for k in range(16)]
    probes = halves.select("fp", "unary", "half", "octet", "side", F.col("cell").alias("home"), F.explode(F.array_compact(F.array(F.col("cell"), *steps))).alias("cell"))
    a, b = probes.alias("a"), halves.alias("b")
    near = F.bit_count(F.col("a.unary").bitwiseXOR(F.col("b.unary"))) <= max_bits
    exact = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits
    once = (F.col("a.home") != F.col("a.cell")) | (F.col("a.fp") < F.col("b.fp"))
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("half", "cell", "octet", "side")]
    pairs = a.join(b, [*same, once, near, exact])
    return pairs.select(F.least("a.fp", "b.fp").alias("u"), F.greatest("a.fp", "b.fp").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(u, v)``, by repeated contraction.

    Each round sends a node to the neighbour, or itself, of least hash, and joins the edges to these
    choices; the hash's seed changes with the round, so the number of nodes falls by a constant factor on
    average, whatever the shape of the graph. Only edges and nodes that still have links take part.
    """
    edges = materialised(edges.distinct(), "edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        order = lambda c: F.struct(F.xxhash64(F.lit(len(rounds)), c).alias("h"), F.col(c).alias("to"))
        both = edges.select("u", order("v").alias("best")).union(edges.select(F.col("v").alias("u"), order("u").alias("best")))
        own = both.groupBy("u").agg(F.min("best").alias("best"))
        chosen = own.select(F.col("u").alias("node"), F.least(F.col("best"), order("u")).getField("to").alias("to"))
        chosen = materialised(chosen, "chosen")
        rounds.append(chosen)
        left = edges.join(chosen.select(F.col("node").alias("u"), F.col("to").alias("pu")), "u")
        ends = left.join(chosen.select(F.col("node").alias("v"), F.col("to").alias("pv")), "v").where("pu <> pv")
        edges = materialised(ends.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
    if not rounds:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = rounds[0].select("node", F.col("to").alias("root"))
    for chosen in rounds[1:]:
        step = chosen.select(F.col("node").alias("root"), F.col("to").alias("next"))
        roots = roots.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return roots


def classes(prints: DataFrame, id_col: str, max_bits: int = MAX_BITS, fine_grid: int = FINE_GRID) -> DataFrame:
    """``(fp, component_id)`` per distinct fingerprint: the least id of all that are linked to it, itself included."""
    distinct = materialised(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    roots = components(links(distinct, max_bits, fine=distinct.count() > fine_grid))
    linked = materialised(roots.join(distinct, F.col("node") == F.col("fp")).select("fp", "root", "least"), "linked")
    # Written first, so that both sides of the next join are plain shuffles and a large component's key can be split.
    heads = materialised(linked.groupBy("root").agg(F.min("least").alias("component_id")), "heads")
    named = linked.join(heads, "root").select("fp", "component_id", F.lit(True).alias("is_linked"))
    both = distinct.join(named, "fp", "left").select("fp", F.when(F.col("is_linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    return materialised(both, "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits) and ``component_id``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("body"))
    prints = materialised(with_fingerprints(rows, "body", ("id",)), "prints")
    found = prints.join(classes(prints, "id", max_bits), "fp")
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: that of the least id (a null id only if there is no other).

    Of repeated rows with the same id exactly one stays. The columns are those of ``docs``.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text).alias("body"))
    prints = with_fingerprints(rows, "body", ("row", "id"))
    prints = materialised(prints.withColumn("at", F.monotonically_increasing_id()), "prints")
    keys = prints.select("fp", "at", "id", F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("at").alias("at")).alias("rank"))
    firsts = keys.groupBy("fp").agg(F.min("rank").alias("rank"))
    # The position of a row is unique where ids need not be: classes are formed over it.
    found = classes(firsts.select("fp", "rank"), "rank", max_bits)
    stay = found.groupBy("component_id").agg(F.first("component_id.at").alias("at")).select("at")
    return prints.join(stay, "at", "left_semi").select("row.*")
