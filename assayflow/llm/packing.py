"""Cost-balanced packing of tokenised documents into sequences.

The cost of a piece of ``n`` tokens is estimated as ``LINEAR * n + QUADRATIC * n * n``: the matrix
products grow with its tokens, its attention with their square. A document of more than ``capacity``
tokens is cut into full sequences and a rest; full sequences have no room and one cost, so only the
rests are placed. They are dealt by a hash of their row's number into batches of about ``BATCH_DOCS`` documents, whatever is in
the rows, so that repeated rows are spread like others, and each batch is packed by one task: with ``m`` the least number of sequences that hold the batch, the rests are assigned in
descending length to the sequence of lowest cost with remaining room for them; one that fits nowhere
whole is cut, its head filling the roomiest sequence, and its tail is assigned in turn. A batch so
pads fewer than ``capacity`` tokens in all, whatever the lengths, and a batch's size does not grow
with the table.

Null and empty texts consist of the end id alone. Repeated rows and null ids are packed row by row, ties in length by the
ids' bytes; an empty table gives an empty one. Other columns are not read, whatever their names. Row numbers must come out
the same when a task is repeated, as they do for tables; write anything else to one first.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

CAPACITY = 1024
BATCH_DOCS = 1024
LINEAR = 1.0
#: Relative to ``LINEAR``: attention costs as much as the rest of a layer at about 4,000 tokens.
QUADRATIC = 1 / 4096

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def assign(lengths: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int, int]]]:
    """Per sequence its pieces ``(document, start in it, length, offset)``, for lengths of 1 to ``capacity`` tokens.

    Ties go to the earlier document and the earlier sequence, so equal input gives equal output.
    """
    m = -(-sum(lengths) // capacity)
    made: list[list[tuple[int, int, int, int]]] = [[] for _ in range(m)]
    used, costs = [0] * m, [0.0] * m
    cheapest = [(0.0, k) for k in range(m)]
    waiting = [(-n, d, 0) for d, n in enumerate(lengths)]
    heapq.heapify(waiting)
    while waiting:
        minus, d, start = heapq.heappop(waiting)
        n, full = -minus, []
        while cheapest and capacity - used[cheapest[0][1]] < n:
            full.append(heapq.heappop(cheapest))
        if cheapest:
            k = heapq.heappop(cheapest)[1]
        else:
            k = min(range(m), key=lambda k: (used[k], k))
            full = [x for x in full if x[1] != k]
            heapq.heappush(waiting, (capacity - used[k] - n, d, start + capacity - used[k]))
            n = capacity - used[k]
        made[k].append((d, start, n, used[k]))
        used[k] += n
        costs[k] += cost(n)
        for x in full:
            heapq.heappush(cheapest, x)
        if used[k] < capacity:
            heapq.heappush(cheapest, (costs[k], k))
    return made


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, batch_docs: int = BATCH_DOCS) -> DataFrame:
    """One row per piece: the id and ``SCHEMA``; ``start`` counts the document's tokens before the piece.

    ``sequence_id`` holds the batch above bit 40 and the sequence within it below.
    """
    vocabulary = vocabulary or tokens.default_vocabulary()
    wanted = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    batches = max(1, -(-wanted.count() // batch_docs))
    dealt = wanted.withColumn("batch", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(batches)))

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens.encoder(vocabulary)
        for rb in rows:
            out: dict[str, list] = {"batch": [], "id": [], "n": [], "full": [], "rest": []}
            texts = (x.as_py() for x in rb.column(1))
            for i, found in enumerate(own.encode(texts)):
                ids = np.append(found, np.uint32(tokens.END_ID)).astype("<u4")
                cut = len(ids) - len(ids) % capacity
                out["batch"].append(rb.column(2)[i].as_py())
                out["id"].append(rb.column(0)[i].as_py())
                out["n"].append(len(ids))
                out["full"].append([zlib.crc32(ids[k : k + capacity]) for k in range(0, cut, capacity)])
                rest = ids[cut:]
                out["rest"].append((rest.astype("<u2") if rest.size and rest.max() < 65536 else rest).tobytes() if rest.size else b"")
                # Two bytes an id where they suffice; the number of ids tells the width.
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("batch", pa.int64()), ("id", rb.schema.field(0).type), ("n", pa.int64()), ("full", pa.list_(pa.int64())), ("rest", pa.binary())]))

    id_type = wanted.schema["id"].dataType.simpleString()
    encoded = dealt.mapInArrow(encode, f"batch long, id {id_type}, n long, full array<long>, rest binary")

    def place(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("n", "rest", "id", "full")), strict=True), key=lambda r: (-(r[0] % capacity), r[0], r[1], str(r[2]), r[3]))
        base = (table.column("batch")[0].as_py() << 40) if rows else 0
        out, sequence = [], base
        for n, _, doc, full in rows:
            for k, crc in enumerate(full):
                out.append((doc, k * capacity, capacity, crc, n, sequence, 0, cost(capacity)))
                sequence += 1
        ends = [(n, rest, doc) for n, rest, doc, _ in rows if rest]
        for made in assign([n % capacity for n, _, _ in ends], capacity):
            for d, start, length, offset in made:
                n, rest, doc = ends[d]
                ids = np.frombuffer(rest, "<u2" if len(rest) == 2 * (n % capacity) else "<u4").astype("<u4")
                out.append((doc, n - n % capacity + start, length, zlib.crc32(ids[start : start + length]), n, sequence, offset, cost(length)))
            sequence += 1
        columns = list(zip(*out, strict=True)) or [()] * 8
        types = [table.schema.field("id").type, *[pa.int64()] * 6, pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"])

    return encoded.groupBy("batch").applyInArrow(place, f"`{id_col}` {id_type}, {SCHEMA}")
