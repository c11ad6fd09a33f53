"""Conversation prefix trie: every distinct sequence of first turns is a node, with its members and what its subtree sums to.

A turn is its role and text, of which two 64-bit halves of an MD5 and the text's length go on; texts are not shuffled. A
prefix is known by its depth and the sums of three hashes of each turn and its place, so the prefixes of a conversation are
running sums, taken in buckets of ``SPAN`` turns. One aggregation over all (conversation, depth) rows, combined before the shuffle, gives
each node's members, its least member, and the member that ends there.

Nodes of a single member hang below the others as tails whose columns follow at once, so however long one conversation is, only
prefixes that two or more share make up the tries. Of these, nodes are heavy while more than ``SHARD_ROWS`` rows of
conversations lie below them; they are the upper levels. Below them hang the prefix shards, subtrees with fewer, several of which are packed into
a task: numpy builds their LOUDS bitvector and label arrays in level order, and a pass from the last level to the
first adds up leaves and saved bytes (``add.at``). What the shards' tops sum to goes to their heavy parents, whose trie is merged by the same
code in a task of its own: it has at most one node for each ``SHARD_ROWS`` rows and depth.

The hash of a node's ending conversations is taken over chunks of ``CHUNK`` ids, made where a range sort puts them, so that even a node that
a third of all conversations end at is hashed as a stream.

Null roles and texts are empty ones. Turns go by ``turn``, null first; equal turns by role, then by the MD5 above, and repeated rows are
turns of their own. Rows without a conversation id belong to no conversation and are left out. Texts count whole, whatever
their length. An empty table gives an empty one. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop_table, materialised, whole_number

SPAN, SHARD_ROWS, CHUNK = 1024, 1 << 18, 512
#: Bits of each of the three sums' terms: a conversation may have 2^23 turns before a sum leaves 63 bits.
LANE_BITS = 40
LANES = ("a", "b", "c")
KEY, PARENT = ("depth", *LANES), ("depth0", *[f"{x}0" for x in LANES])


def running(rows: DataFrame, key: str, bucket: Column, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds running sums within each ``key`` in ``order``, with which ``bucket`` does not decrease: no key is summed in one piece."""
    held = rows.withColumns({"bucket_": bucket} | {f"{n}_": c for n, c in sums.items()})
    before = Window.partitionBy(key).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    totals = held.groupBy(key, "bucket_").agg(*[F.sum(f"{n}_").alias(f"{n}_") for n in sums])
    offsets = totals.select(key, "bucket_", *[F.coalesce(F.sum(f"{n}_").over(before), F.lit(0)).alias(f"{n}_before") for n in sums])
    inside = Window.partitionBy(key, "bucket_").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = held.join(offsets, [key, "bucket_"])
    return both.select(*rows.columns, *[(F.sum(f"{n}_").over(inside) + F.col(f"{n}_before")).alias(n) for n in sums])


def turns_of(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv``, ``place`` from 1, the turn's ``h1`` and ``h2``, and ``bytes`` of its text."""
    whole_number(conversations, conv)
    role_, text_ = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_))
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    rows = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), role_.alias("role"), half(1).alias("h1"), half(17).alias("h2"), F.octet_length(text_).cast("long").alias("bytes"))
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("h1"), F.asc("h2")]
    bucket = F.coalesce(F.floor(F.col("turn") / SPAN).cast("long"), F.lit(-(1 << 62)))
    return running(rows, "conv", bucket, order, {"place": F.lit(1)}).select("conv", "place", "h1", "h2", "bytes")


def plain(turns: DataFrame) -> DataFrame:
    """Conversations as they are: a row per (conversation, depth) with ``left``, the turns that follow; depth 0 has no turn."""
    return _with_root(turns.withColumnRenamed("place", "depth"), turns.groupBy("conv").agg(F.count("*").alias("length")))


def rebuilt(turns: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """Conversations that take their first turns from another one, as ``plain`` gives them.

    Conversation ``c`` begins with the first ``h`` turns of conversation ``c - c % family``, fewer if it has fewer and none if it is not there, and
    goes on with its own turns after its first ``h``; ``h`` is the unsigned CRC-32 of the decimal ``c`` modulo ``heads``.
    """
    turns = materialised(turns, "turns")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    base = F.col("conv") - F.col("conv") % family
    first = turns.where((F.col("conv") % family == 0) & (F.col("place") < heads)).withColumnRenamed("conv", "base")
    sizes = turns.groupBy("conv").agg(F.count("*").alias("own")).withColumns({"h": h, "base": base})
    lent = F.least("h", F.coalesce("lent", F.lit(0)))
    convs = sizes.join(first.groupBy("base").agg(F.count("*").alias("lent")), "base", "left").select("conv", "base", "h", lent.alias("lent"), (lent + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    taken = convs.join(first, "base").where(F.col("place") <= F.col("lent")).select("conv", F.col("place").alias("depth"), "h1", "h2", "bytes")
    kept = turns.where(F.col("place") > h).join(convs, "conv").select("conv", (F.col("place") - F.col("h") + F.col("lent")).alias("depth"), "h1", "h2", "bytes")
    return _with_root(taken.union(kept), convs.select("conv", "length"))


def _with_root(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    roots = lengths.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(0).cast("long").alias("bytes"))
    columns = ["conv", F.col("depth").cast("long").alias("depth"), "h1", "h2", "bytes"]
    return turns.select(*columns).union(roots).join(lengths, "conv").select(*columns, (F.col("length") - F.col("depth")).alias("left"))


class Louds:
    """A forest in level order: for each node a one per child and a zero, beneath a top whose children are the roots; ``labels`` stand in the same order."""

    def __init__(self, degrees: np.ndarray, roots: int, labels: np.ndarray) -> None:
        bits = np.ones(int(degrees.sum()) + len(degrees) + roots + 1, bool)
        bits[np.cumsum(np.append(roots, degrees) + 1) - 1] = False
        self.size, self.bits, self.labels = len(bits), np.packbits(bits), labels

    def parents(self) -> np.ndarray:
        """Each node's parent, -1 for roots: the i-th one stands behind as many zeros as nodes were closed before its parent."""
        ones = np.flatnonzero(np.unpackbits(self.bits, count=self.size))
        return ones - np.arange(len(ones)) - 1

    def degrees(self) -> np.ndarray:
        zeros = np.flatnonzero(np.unpackbits(self.bits, count=self.size) == 0)
        return np.diff(zeros) - 1


def _parent_rows(own: np.ndarray, parents: np.ndarray) -> np.ndarray:
    """For each row of ``parents`` the row of ``own`` (distinct) that equals it, -1 if none does."""
    both = np.concatenate([own, parents])
    order = np.lexsort(both.T)
    ids = np.empty(len(both), np.int64)
    ids[order] = np.cumsum(np.append(False, (both[order][1:] != both[order][:-1]).any(axis=1)))
    at = np.full(len(both), -1, np.int64)
    at[ids[: len(own)]] = np.arange(len(own))
    return at[ids[len(own) :]]


def summed(table: pa.Table) -> pa.Table:
    """The rows of one or more subtrees with the sums over each node's subtree.

    Columns in: ``KEY``, ``PARENT``, ``conv_id``, ``n_convs``, ``bytes``, ``parent_conv_id`` of roots, and ``children``, ``leaves``, ``saved`` of what hangs on a node from
    elsewhere. A root is a node whose parent is not here.
    """
    get = lambda c: table.column(c).to_numpy()
    own, n = np.stack([get(c) for c in KEY], 1), table.num_rows
    up = _parent_rows(own, np.stack([get(c) for c in PARENT], 1))
    level, depth = np.zeros(n, np.int64), own[:, 0]
    by_depth = np.argsort(depth, kind="stable")
    for some in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1):
        level[some] = np.where(up[some] >= 0, level[up[some]] + 1, 0)
    place, starts, order = np.full(n + 1, -1, np.int64), [0], []
    by_level = np.argsort(level, kind="stable")
    for some in np.split(by_level, np.flatnonzero(np.diff(level[by_level])) + 1):
        some = some[np.lexsort((own[some, 3], own[some, 2], own[some, 1], place[up[some]]))]  # siblings by label
        place[some] = starts[-1] + np.arange(len(some))
        starts.append(starts[-1] + len(some))
        order.append(some)
    rank = np.concatenate(order)
    roots = int((up < 0).sum())
    trie = Louds(np.bincount(place[up[up >= 0]], minlength=n), roots, own[rank, 1:])
    parent, degree = trie.parents(), trie.degrees()
    conv, convs = get("conv_id")[rank], get("n_convs")[rank]
    children = degree + get("children")[rank]
    leaves = get("leaves")[rank] + (children == 0)
    saved = get("saved")[rank] + (convs - 1) * get("bytes")[rank]
    for a, b in zip(reversed(starts[1:-1]), reversed(starts[2:]), strict=True):  # from the last level up; the roots have none above
        np.add.at(leaves, parent[a:b], leaves[a:b])
        np.add.at(saved, parent[a:b], saved[a:b])
    taken = lambda c: pc.take(table.column(c), pa.array(rank)).combine_chunks()
    parent_conv = pc.if_else(pa.array(parent >= 0), pa.array(conv[parent]), taken("parent_conv_id"))
    out = {c: pa.array(own[rank, i]) for i, c in enumerate(KEY)} | {c: taken(c) for c in PARENT}
    out |= {"root": pa.array(parent < 0), "conv_id": pa.array(conv), "parent_conv_id": parent_conv, "n_convs": pa.array(convs), "n_children": pa.array(children), "n_leaves": pa.array(leaves), "saved_tokens": pa.array(saved)}
    return pa.table(out)


_SUMMED = ", ".join([*[f"{c} long" for c in (*KEY, *PARENT)], "root boolean", *[f"{c} long" for c in ("conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]])
_INTO = (*KEY, *PARENT, "conv_id", "n_convs", "bytes", "parent_conv_id", "children", "leaves", "saved")


def _same(left: DataFrame, right: DataFrame, ours: tuple[str, ...], theirs: tuple[str, ...], how: str = "left") -> DataFrame:
    """Joins on key columns of different names; the right side's go."""
    held = right.withColumnsRenamed({c: f"{c}_r" for c in theirs})
    return left.join(held, [F.col(a) == F.col(f"{b}_r") for a, b in zip(ours, theirs, strict=True)], how).drop(*[f"{c}_r" for c in theirs])


def _ends(rows: DataFrame, many: DataFrame) -> DataFrame:
    """``conv_id``, ``depth`` and ``digest`` of nodes at which several conversations end; their ids are chunked where a range sort puts them."""
    ended = _same(rows.where(F.col("left") == 0).select(*KEY, "conv"), many.select(*KEY, "conv_id"), KEY, KEY, "inner").select("conv_id", "depth", "conv")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            node, depth, conv = (rb.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((node[1:] != node[:-1]) | (depth[1:] != depth[:-1])) + 1
            parts = [(x, min(x + CHUNK, b)) for a, b in zip([0, *cuts], [*cuts, len(node)], strict=True) for x in range(a, b, CHUNK)]
            starts = np.array([a for a, _ in parts], np.int64)
            yield pa.RecordBatch.from_arrays([*[pa.array(x[starts]) for x in (node, depth, conv)], pa.array([",".join(map(str, conv[a:b].tolist())) for a, b in parts])], ["conv_id", "depth", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, hashlib.sha256()
        for rb in batches:
            done = []
            for node, depth, ids in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), rb.column(3).to_pylist(), strict=True):
                if (node, depth) != now:
                    done += [(*now, held.hexdigest())] if now else []
                    now, held = (node, depth), hashlib.sha256(ids.encode())
                else:
                    held.update(b"," + ids.encode())
            yield _digest_rows(done)
        yield _digest_rows([(*now, held.hexdigest())] if now else [])

    order = ("conv_id", "depth")
    chunked = ended.repartitionByRange(*order, "conv").sortWithinPartitions(*order, "conv").mapInArrow(chunks, "conv_id long, depth long, first long, ids string")
    return chunked.repartition(*order).sortWithinPartitions(*order, "first").mapInArrow(digests, "conv_id long, depth long, digest string")


def _digest_rows(done: list[tuple[int, int, str]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], kinds[i]) for i in range(3)], ["conv_id", "depth", "digest"])


def trie(turns: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row per node of the conversations that ``plain`` or ``rebuilt`` gave: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    lane = lambda i: F.when(F.col("depth") > 0, F.xxhash64("h1", "h2", "depth", F.lit(i)).bitwiseAND((1 << LANE_BITS) - 1)).otherwise(F.lit(0).cast("long"))
    own = turns.withColumns({f"{x}1": lane(i) for i, x in enumerate(LANES)}).drop("h1", "h2")
    bucket = F.floor(F.col("depth") / SPAN)
    rows = materialised(running(own, "conv", bucket, [F.asc("depth")], {x: F.col(f"{x}1") for x in LANES}), "prefixes")
    ends = F.col("left") == 0
    grouped = rows.groupBy(*KEY).agg(
        F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"), F.max("bytes").alias("bytes"), F.sum("left").alias("below"),
        F.count(F.when(ends, 1)).alias("n_ends"), F.min(F.when(ends, F.col("conv"))).alias("end"), *[F.max(f"{x}1").alias(f"{x}1") for x in LANES],
    )
    parent = {"depth0": F.col("depth") - 1} | {f"{x}0": F.col(x) - F.col(f"{x}1") for x in LANES}
    nodes = materialised(grouped.withColumns(parent).drop(*[f"{x}1" for x in LANES]), "nodes")
    shared, single = nodes.where("n_convs > 1"), nodes.where("n_convs = 1")
    # Tails: one leaf, nothing saved, and the least member of the node they hang on.
    of_parent = shared.select(*KEY, F.col("conv_id").alias("parent_conv_id"))
    tails = _same(single.select(*KEY, *PARENT, "conv_id", "end"), of_parent, PARENT, KEY)
    hung = tails.where(F.col("parent_conv_id").isNotNull()).groupBy(*PARENT).agg(F.count("*").alias("children"))
    own_parent = F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id"))
    results = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    long = lambda n: F.lit(n).cast("long")
    tail_rows = tails.select("conv_id", "depth", own_parent.alias("parent_conv_id"), long(1).alias("n_convs"), F.when(F.col("end").isNull(), 1).otherwise(0).cast("long").alias("n_children"), long(1).alias("n_leaves"), long(0).alias("saved_tokens"))
    # Shared nodes, with what hangs on them: heavy ones above, shards below.
    loaded = _same(shared, hung, KEY, PARENT).withColumn("children", F.coalesce("children", F.lit(0))).withColumns({"leaves": F.col("children"), "saved": long(0)})
    loaded = materialised(loaded, "shared")
    heavy, light = loaded.where(F.col("below") > shard_rows), loaded.where(F.col("below") <= shard_rows)
    light = _same(light, heavy.select(*KEY, F.col("conv_id").alias("parent_conv_id")), PARENT, KEY)
    bins = max(1, -(-light.count() // shard_rows))
    tops = light.where(F.col("parent_conv_id").isNotNull() | (F.col("depth") == 0)).select(*KEY, F.pmod(F.xxhash64(*KEY), F.lit(bins)).alias("bin"))
    cut = _same(rows.select(*KEY, F.col("conv").alias("conv_id")), tops, KEY, KEY, "inner").select("conv_id", "bin")
    low = materialised(light.join(cut, "conv_id").select("bin", *_INTO).groupBy("bin").applyInArrow(lambda t: summed(t.drop_columns("bin")), _SUMMED), "low")
    lent = low.where("root AND depth > 0").groupBy(*PARENT).agg(F.count("*").alias("more"), F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    both = _same(heavy, lent, KEY, PARENT).select(*[c for c in _INTO if c not in ("parent_conv_id", "children", "leaves", "saved")], F.lit(None).cast("long").alias("parent_conv_id"), plus("children", "more"), plus("leaves", "more_leaves"), plus("saved", "more_saved"))
    high = both.groupBy(F.lit(0).alias("one")).applyInArrow(lambda t: summed(t.select(_INTO)), _SUMMED)
    found = low.select(*results).union(high.select(*results)).union(tail_rows)
    marks = nodes.where("n_ends > 0").select("conv_id", "depth", "n_ends", "end").join(_ends(rows, nodes.where("n_ends > 1")), ["conv_id", "depth"], "left")
    digest = F.coalesce("digest", F.sha2(F.coalesce(F.col("end").cast("string"), F.lit("")).cast("binary"), 256))
    out = materialised(found.join(marks, ["conv_id", "depth"], "left").select(*results, digest.alias("ends_sha256")), "trie")
    for table in (rows, nodes, loaded, low):
        drop_table(table)
    return out


def oracle() -> str:
    """DuckDB SQL for ``trie(rebuilt(turns_of(conversations)))``, but for turns that tie, which tables do not have."""
    return """
WITH tab AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS tab FROM range(256) r(n)),
own AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, role, text) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
placed AS (SELECT conv_id, l, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 9 AS h FROM own, tab),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(b.l[1 : c.h], []), c.l[c.h + 1 :]) AS l FROM placed c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
prefixes AS (SELECT conv_id, l, d, l[1 : d] AS k FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE strlen(k[d].t) END AS bytes, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(l) = d), '') AS ends FROM prefixes GROUP BY k, d),
children AS (SELECT k[1 : d - 1] AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
known AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (k)),
sums AS (SELECT k[1 : e] AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM known) GROUP BY ALL)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM known n JOIN sums s USING (k) LEFT JOIN nodes p ON n.d > 0 AND p.k = n.k[1 : n.d - 1]"""
