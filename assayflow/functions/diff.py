"""Unified diffs of texts by lines: a shortest edit script, cut into hunks with context."""

from __future__ import annotations

from array import array

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that are Python objects at a time.
LOT = 64


def script(a: list[str], b: list[str]) -> list[tuple[str, int, int]]:
    """A shortest list of kept, deleted and added lines (``=``, ``-``, ``+`` with places in either), in time of the longer times the edits.

    Greedy furthest-reaching paths: for each number of edits the furthest line of ``a`` on each diagonal, whose history leads back.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    n, m = len(a), len(b)
    while n > head and m > head and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    furthest, history = {1: head}, []
    for d in range(n + m - 2 * head + 1):
        history.append(array("i", [furthest[k] for k in range(1 - d, d, 2)]))  # all that the way back asks for
        for k in range(-d, d + 1, 2):
            x = furthest[k + 1] if k == -d or (k != d and furthest[k - 1] < furthest[k + 1]) else furthest[k - 1] + 1
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            furthest[k] = x
            if x >= n and x - k >= m:
                break
        else:
            continue
        break
    out, x, y = [], n, m
    for d in range(len(history) - 1, -1, -1):
        before, k = history[d], x - y
        at = lambda k, d=d, before=before: before[(k + d - 1) // 2]
        last = k + 1 if k == -d or (k != d and at(k - 1) < at(k + 1)) else k - 1
        px = at(last) if d else head
        py = px - last if d else head
        while x > px and y > py and x - y == k and a[x - 1] == b[y - 1] and (x > px + (last < k) or not d):
            x, y = x - 1, y - 1
            out.append(("=", x, y))
        if d:
            if last > k:
                y -= 1
                out.append(("+", x, y))
            else:
                x -= 1
                out.append(("-", x, y))
    out.reverse()
    tail = [("=", n + i, m + i) for i in range(len(a) - n)]
    return [("=", i, i) for i in range(head)] + out + tail


def hunks(a: list[str], b: list[str], context: int = 3) -> list[str]:
    """The lines of a unified diff without its file names; none for equal texts."""
    steps = script(a, b)
    changed = [i for i, (op, _, _) in enumerate(steps) if op != "="]
    out, at = [], 0
    while at < len(changed):
        last = at
        while last + 1 < len(changed) and changed[last + 1] - changed[last] <= 2 * context + 1:
            last += 1
        part = steps[max(0, changed[at] - context) : changed[last] + context + 1]
        old, new = (sum(op != skip for op, _, _ in part) for skip in "+-")
        x, y = part[0][1] + (old > 0), part[0][2] + (new > 0)
        span = lambda start, size: f"{start}" if size == 1 else f"{start},{size}"
        out.append(f"@@ -{span(x, old)} +{span(y, new)} @@")
        out += [{"=": " ", "-": "-", "+": "+"}[op] + (b[j] if op == "+" else a[i]) for op, i, j in part]
        at = last + 1
    return out


def changes(left: pa.Array, right: pa.Array, context: int = 3) -> pa.Array:
    """Structs of ``diff`` and ``changed`` for texts: only ``LOT`` texts of an Arrow batch, which may hold very many, are Python objects at a time."""
    lines = lambda t: t.split("\n") if t else []
    kind = pa.struct([("diff", pa.string()), ("changed", pa.int32())])
    parts = [pa.array([], kind)]
    for i in range(0, len(left), LOT):
        rows = [hunks(lines(x.as_py()), lines(y.as_py()), context) for x, y in zip(left[i : i + LOT], right[i : i + LOT], strict=True)]
        parts.append(pa.array([{"diff": "\n".join(r), "changed": sum(x[0] in "+-" for x in r)} for r in rows], kind))
    return pa.concat_arrays(parts)


def unified(before: Column, after: Column, context: int = 3) -> Column:
    """A struct of the ``diff`` and the number of ``changed`` lines of two texts; null texts count as empty, which has no line."""

    @F.arrow_udf("struct<diff:string,changed:int>")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        return changes(left, right, context)

    return run(before, after)
