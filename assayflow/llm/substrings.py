"""Substring dedup: long passages that an earlier document holds, by compressed FM-indexes over shards of pieces.

A window is ``WINDOW`` consecutive words. So that no document meets every index, documents are cut into pieces by their windows'
minimizers, the least hash of the ``GRAM``-word sequences in a window: consecutive windows with one minimizer, ``RUN`` at most, form a piece, and
equal windows have equal minimizers, so a window's equals all stand in pieces of its minimizer. Minimizers that pieces of one document id
alone have are dropped. Of equal pieces the one in the document of the least id stands for all; these distinct pieces
are dealt to shards by their minimizer. A minimizer with more than ``HOT`` distinct pieces (a passage that very many documents
embed in text of their own) is dealt by whole windows instead, whose equals are combined before they are dealt.

A shard concatenates the words of its pieces, sorts its suffixes by their first 64 words, which is all that patterns of ``WINDOW``
words need, and keeps the Burrows-Wheeler transform as a wavelet matrix of bit vectors with rank counts. All pieces of the
shard are streamed through it together, from their last word to the first: the matching statistic goes up by a backward-search step per
word until it reaches ``WINDOW``, and is held there by leaving out the last word, which widens the interval to the suffixes that agree in
``WINDOW - 1`` words. Of each interval the least document id is taken, and where that is less than a document's own, the window
is one to remove. Words are compared as they are; hashes choose pieces and shards only, but for
pieces that are taken as equal by two 64-bit hashes.

A null id stands after all others: its document loses what any document with an id holds. Documents of equal ids do not
take words from each other; repeated rows lose the same words. Null, empty and short texts (fewer than ``WINDOW``
words) have no window. Texts count whole, whatever their length. An empty table gives an empty one. Columns beside the two named
are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_table, materialised, whole_number

WINDOW, GRAM, RUN, HOT, SHARD_WORDS = 50, 8, 64, 2_000, 1 << 18
#: Characters that are cut into words at once.
LOT = 1 << 21
#: Rows that are taken out of a batch at once where texts are cut into words and put together again.
ROWS = 256
#: The order number of a document without an id.
LAST = (1 << 63) - 1
KNOWN_WORDS = 200_000
#: An odd number, so that it has an inverse modulo 2^64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``, unchanged."""
    return (text or "").encode("utf-8", "surrogatepass").split()


class Rolling:
    """Hashes of all runs of consecutive words, from hashes of words."""

    def __init__(self, words: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.append(np.uint64(1), np.full(len(words), _BASE)))
            self.back = np.cumprod(np.append(np.uint64(1), np.full(len(words), _BACK)))
            self.sums = np.append(np.uint64(0), np.cumsum(words * powers[:-1]))

    def of(self, starts: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        h = (self.sums[starts + size] - self.sums[starts]) * self.back[starts]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


class Hasher:
    """Hashes of words; a bounded memory spares hashing frequent ones again."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        known, make = self.known, xxhash.xxh64_intdigest
        return np.fromiter((known.get(w) or known.setdefault(w, make(w)) for w in words), np.uint64, len(words))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of ``width`` values."""
    span, out = 1, values
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - span :])


def pieces(words: np.ndarray, ends: np.ndarray, window: int = WINDOW, gram: int = GRAM, run: int = RUN) -> tuple[np.ndarray, ...]:
    """Of documents whose hashed words stand end to end: each piece's document, first word in it, number of windows, minimizer and content hash."""
    none = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(words) < window:
        return none
    rolling = Rolling(words)
    minima = _least(rolling.of(np.arange(len(words) - gram + 1), gram), window - gram + 1)
    starts = np.append(0, ends[:-1])
    owner = np.repeat(np.arange(len(ends)), ends - starts)[: len(minima)]
    at = np.flatnonzero(np.arange(len(minima)) + window <= ends[owner])
    if not len(at):
        return none
    owner, minima = owner[at], minima[at]
    cut = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (minima[1:] != minima[:-1])))
    length = np.diff(np.append(cut, len(at)))
    parts = -(-length // run)  # a longer run of one minimizer is cut
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(cut, parts) + nth * run
    n = np.minimum(np.repeat(length, parts) - nth * run, run)
    return owner[first], at[first] - starts[owner[first]], n, minima[first], rolling.of(at[first], n + window - 1) + n.astype(np.uint64)


class Bits:
    """A bit vector with counts of ones before every 64th bit."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.append(packed, np.zeros(16 - len(packed) % 8, np.uint8)).view(np.uint64)
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words))).astype(np.uint32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        low = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word].astype(np.int64) + np.bitwise_count(low)


class Wavelet:
    """A wavelet matrix: how often a symbol occurs before a place."""

    def __init__(self, symbols: np.ndarray, kinds: int) -> None:
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in reversed(range(max(1, (kinds - 1).bit_length()))):
            bits = (symbols >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(bits), int((~bits).sum())))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
        self.base = self._down(np.arange(kinds), np.zeros(kinds, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where(symbol >> shift & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._down(symbol, at) - self.base[symbol]


class FmIndex:
    """Over sequences of symbols from 1 on, end to end; suffixes are sorted by 64 symbols, so patterns may have up to 63."""

    def __init__(self, symbols: np.ndarray, kinds: int) -> None:
        """Symbol 0 ends each sequence."""
        n = len(symbols)
        rank, depth = symbols.astype(np.int64), 1
        for _ in range(6):
            self.half = rank  # at the end that of 32 symbols
            key = rank * (n + kinds + 1) + np.append(rank[depth:] + 1, np.zeros(min(depth, n), np.int64))
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.append(False, key[order][1:] != key[order][:-1]))
            depth *= 2
        self.n, self.places = n, order
        self.first = np.append(0, np.cumsum(np.bincount(symbols, minlength=kinds)))
        self.wavelet = Wavelet(symbols[order - 1], kinds)

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The run of suffixes that agree in ``size`` symbols (33 to 63) with each suffix in order: number, and first suffix of each run and the end."""
        a = self.half[self.places]
        b = np.append(self.half, np.full(size, -1))[self.places + size - 32]
        starts = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, self.n))), np.append(starts, self.n)

    def back(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with ``symbol`` before them."""
        both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return self.first[symbol] + both[: len(low)], self.first[symbol] + both[len(low) :]


def least_owners(texts: list[str], owners: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each window of each text (of ``window`` words at least) the least owner of a text that holds it, by matching statistics of all texts against their index."""
    kinds: dict[bytes, int] = {}
    coded = [np.array([kinds.setdefault(w, len(kinds) + 1) for w in words_of(t)] + [0], np.int64) for t in texts]
    sizes = np.array([len(c) for c in coded])
    symbols, ends = np.concatenate(coded), np.cumsum(sizes) - 1
    index = FmIndex(symbols, len(kinds) + 1)
    run, bounds = index.runs(window)
    wide, wide_bounds = index.runs(window - 1)
    least = np.minimum.reduceat(np.repeat(owners, sizes)[index.places], bounds[:-1])
    found = np.full(len(symbols), LAST, np.int64)
    streams = np.argsort(-sizes, kind="stable")  # the longest first, so that those that go on are a prefix
    at, left = ends[streams].copy(), sizes[streams] - 1
    low, high = np.zeros(len(streams), np.int64), np.full(len(streams), index.n)
    for step in range(1, int(left.max(initial=0)) + 1):
        m = int(np.searchsorted(-left, -step, "right"))
        at[:m] -= 1
        if step > window:
            of = wide[low[:m]]
            low[:m], high[:m] = wide_bounds[of], wide_bounds[of + 1]
        low[:m], high[:m] = index.back(symbols[at[:m]], low[:m], high[:m])
        if step >= window:
            found[at[:m]] = least[run[low[:m]]]
    starts = ends - sizes + 1
    return [found[a : a + s - window] for a, s in zip(starts.tolist(), sizes.tolist(), strict=True)]


def _cut(texts: pa.Array, hasher: Hasher) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Lots of texts: from, to, hashed words end to end, and where each text's end."""
    lengths, a = np.cumsum([len(t.as_py() or "") for t in texts]), 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(lengths, (lengths[a - 1] if a else 0) + LOT)))
        words = [words_of(t.as_py()) for t in texts[a:b]]
        yield a, b, np.concatenate([hasher.of(w) for w in words]), np.cumsum([len(w) for w in words])
        a = b


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for rb in batches:
        doc, mark = (rb.column(i).to_numpy() for i in range(2))
        for a, _, words, ends in _cut(rb.column(2), hasher):
            owner, start, n, minimizer, content = pieces(words, ends)
            columns = [doc[a + owner], mark[a + owner], start, n, minimizer.view(np.int64), content.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc", "mark", "start", "n", "minimizer", "content"])


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (rb.slice(at, ROWS) for rb in batches for at in range(0, rb.num_rows, ROWS))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of representative pieces; pieces of hot minimizers as windows of their own, known by two hashes."""
    names = ["minimizer", "content", "nth", "hot", "unit", "check", "doc", "words"]
    for rb in _sliced(batches):
        for doc, text, held in zip(rb.column(0).to_pylist(), rb.column(1), rb.column(2).to_pylist(), strict=True):
            words, out = words_of(text.as_py()), []
            for p in held:
                if p["hot"]:
                    for i in range(p["n"]):
                        part = b" ".join(words[p["start"] + i : p["start"] + i + WINDOW])
                        both = xxhash.xxh128_intdigest(part)
                        unit, check = (int(x) for x in np.array([both & LAST, both >> 64 & LAST]))
                        out.append((p["minimizer"], p["content"], i, True, unit, check, doc, part.decode("utf-8", "surrogatepass")))
                else:
                    part = b" ".join(words[p["start"] : p["start"] + p["n"] + WINDOW - 1])
                    out.append((p["minimizer"], p["content"], 0, False, p["minimizer"], p["content"], doc, part.decode("utf-8", "surrogatepass")))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], pa.schema([(c, pa.bool_() if c == "hot" else pa.string() if c == "words" else pa.int64()) for c in names]))


def _searched(table: pa.Table) -> pa.Table:
    """Runs of windows of each unit with one least document: ``at`` of a run's first window, and the document."""
    found = least_owners(table.column("words").to_pylist(), table.column("doc").to_numpy())
    cuts = [np.flatnonzero(np.append(True, f[1:] != f[:-1])) for f in found]
    runs = {"at": pa.array([c.tolist() for c in cuts], pa.list_(pa.int64())), "least": pa.array([f[c].tolist() for f, c in zip(found, cuts, strict=True)], pa.list_(pa.int64()))}
    return pa.table({c: table.column(c) for c in ("unit", "check", "hot")} | runs)


def repeated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", hot: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``doc`` (``LAST`` for null), ``mark`` (a hash of the text) and ``spans``, sorted pairs of first and end word, of documents with something to remove."""
    whole_number(docs, id_col)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    seen = materialised(rows.mapInArrow(_occurrences, "doc long, mark long, start long, n long, minimizer long, content long"), "pieces")
    several = seen.groupBy("minimizer").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).where("a < z").select("minimizer")
    hits = materialised(seen.join(several, "minimizer"), "hits")
    drop_table(seen)
    # One representative of equal pieces: of the least document.
    kept = hits.groupBy("minimizer", "content").agg(F.min(F.struct("doc", "mark", "start")).alias("r"), F.min("n").alias("n")).select("minimizer", "content", "r.*", "n")
    kept = materialised(kept, "distinct")
    many = kept.groupBy("minimizer").agg(F.count("*").alias("k")).where(F.col("k") > hot).select("minimizer", F.lit(True).alias("hot"))
    asked = kept.join(many, "minimizer", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    per_doc = asked.groupBy("doc", "mark").agg(F.collect_list(F.struct("minimizer", "content", "start", "n", "hot")).alias("held"))
    once = rows.groupBy("doc", "mark").agg(F.first("text").alias("text"))  # repeated rows are combined before they are dealt
    units = once.join(per_doc, ["doc", "mark"]).select("doc", "text", "held").mapInArrow(_units, "minimizer long, content long, nth long, hot boolean, unit long, check long, doc long, words string")
    units = materialised(units, "units")
    drop_table(kept)
    # Equal windows of hot minimizers meet here, combined first; one that a single document holds has nothing to find.
    common = units.where("hot").groupBy("unit", "check").agg(F.min("doc").alias("doc"), F.max("doc").alias("z"), F.first("words").alias("words")).where("doc < z")
    dealt = units.where("NOT hot").select("unit", "check", "hot", "doc", "words").union(common.select("unit", "check", F.lit(True).alias("hot"), "doc", "words"))
    total = units.agg(F.sum(F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) + 2)).first()[0] or 0
    bins = max(1, -(-total // shard_words))
    found = materialised(dealt.withColumn("bin", F.pmod(F.xxhash64("unit"), F.lit(bins))).groupBy("bin").applyInArrow(lambda t: _searched(t), "unit long, check long, hot boolean, at array<long>, least array<long>"), "found")
    usual = found.where("NOT hot").select(F.col("unit").alias("minimizer"), F.col("check").alias("content"), "at", "least")
    windows = units.where("hot").select("minimizer", "content", "nth", "unit", "check", "doc").join(found.where("hot").select("unit", "check", F.col("least")[0].alias("best")), ["unit", "check"], "left")
    by_window = windows.groupBy("minimizer", "content").agg(F.sort_array(F.collect_set(F.struct("nth", F.coalesce("best", "doc").alias("least")))).alias("w"))
    matched = usual.union(by_window.select("minimizer", "content", "w.nth", "w.least"))
    # A piece's windows whose least document comes before its own, as spans of words.
    span = lambda x, i: F.struct((F.col("start") + x["at"]).alias("a"), (F.col("start") + F.coalesce(F.get(F.col("at"), i + 1), F.col("n")) + F.lit(WINDOW - 1)).alias("z"), (x["least"] < F.col("doc")).alias("gone"))
    spans = F.filter(F.transform(F.arrays_zip("at", "least"), span), lambda s: s["gone"])
    lost = hits.join(matched, ["minimizer", "content"]).select("doc", "mark", spans.alias("s")).where(F.size("s") > 0)
    out = lost.select("doc", "mark", F.explode("s").alias("s")).groupBy("doc", "mark").agg(F.sort_array(F.collect_set(F.struct("s.a", "s.z"))).alias("spans"))
    out = materialised(out, "spans")
    for table in (hits, units, found):
        drop_table(table)
    return out


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in _sliced(batches):
        n_words, n_removed, kept = [], [], []
        for text, spans in zip(rb.column(1), rb.column(2).to_pylist(), strict=True):
            words, at, rest = words_of(text.as_py()), 0, []
            for s in spans or []:
                rest += words[at : s["a"]]
                at = max(at, s["z"])
            rest += words[at:]
            n_words.append(len(words))
            n_removed.append(len(words) - len(rest))
            kept.append(b" ".join(rest).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept)], ["doc_id", "n_words", "n_removed", "kept"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", hot: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_removed`` and ``kept``, the words that stay, joined by one space."""
    spans = repeated(docs, id_col, text, hot, shard_words)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    return rows.join(spans, ["doc", "mark"], "left").select("doc_id", "text", "spans").mapInArrow(_without, "doc_id long, n_words long, n_removed long, kept string")


def oracle(window: int = WINDOW) -> str:
    """DuckDB SQL for the digest columns of ``dedup`` over ``documents``."""
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - {window} + 2)) AS p FROM d),
windows AS (SELECT doc_id, p, array_to_string(w[p : p + {window - 1}], ' ') AS t FROM starts),
least AS (SELECT t, min(doc_id) AS first FROM windows GROUP BY t HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + {window})) AS i FROM windows JOIN least USING (t) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS k, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""
