"""SentencePiece BPE encoding by suffix-array matching, and decoding.

A text is normalised as the model says (identity, spaces as U+2581, one put in front). No piece has U+2581 after
another character, so the text falls into units at these places. A unit falls further into atoms between any two
neighbouring characters that stand side by side in no piece, as no merge can cross such a place. Each distinct atom is encoded
once for a batch. The atoms of a batch are laid end to end; the suffix array of that text is sorted by as many characters as the
longest piece has; every piece is looked up by binary search, which gives the range of its occurrences. These
occurrences are edges from start to end; they are sorted by position and relaxed from left to right, all atoms side by side.

The model is a BPE model, whose result is not the best-scored path but what its merges lead to. Encodings of
prefixes are prefixes of encodings, and a sequence is what merging gives if and only if each two neighbours, merged
alone, stay the same two pieces. So a place is relaxed by the one edge whose piece agrees with the last
piece of the encoding up to its start; agreement is worked out once for each pair. A character that is no piece is an
edge of its own and is written as its UTF-8 bytes.

Nulls and empty texts have no ids. Texts are encoded whole; the suffix array is made in blocks, so a
text's length bounds only its own list of places. Null ids are kept, repeated rows encoded row by row, and an empty table gives an
empty one; columns besides id and text may have any names. A model of another kind (not BPE, another normaliser, pieces of
the user's or across words) is refused before any work, as these steps would give other ids than the library.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
BLOCK_CHARS = 1 << 16
CACHE_UNITS = 400_000
CACHE_PAIRS = 1 << 20
END_UNIT = 0x110000
#: Numbers beside those of pieces: no piece, a place not reached, and the first of characters that are no pieces.
NONE, UNREACHED, FREE = 0x7FFFFFFF, 0x7FFFFFFE, 0x40000000
SEPARATORS = [chr(c) for c in range(1, 9)]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a serialised protocol buffer: number, and value or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


def check_model(proto: bytes) -> None:
    """Raises unless the model is BPE whose text is taken as it is, with spaces as marks and one put in front."""
    trainer, normaliser, kinds = {}, {}, set()
    for number, value in _fields(proto):
        if number == 1:
            kinds.add(dict(_fields(value)).get(3, 1))
        elif number in (2, 3):
            (trainer if number == 2 else normaliser).update(_fields(value))
    # Field numbers of the published format, with their defaults.
    faults = {
        "it is not BPE": trainer.get(3, 1) != 2,
        "it marks spaces behind words": bool(trainer.get(24, 0)),
        "it has pieces defined by the user": 4 in kinds,
        "its normaliser changes characters": bool(normaliser.get(2, b"")),
        "it puts no mark in front": not normaliser.get(3, 1),
        "it removes spaces": bool(normaliser.get(4, 1)),
        "it leaves spaces as they are": not normaliser.get(5, 1),
    }
    if any(faults.values()):
        raise ValueError("this model cannot be matched: " + ", ".join(f for f, there in faults.items() if there))


class Pieces:
    """A model's pieces, matched in batches of texts."""

    def __init__(self, model: str) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model)
        check_model(sp.serialized_model_proto())
        plain = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.names = {i: sp.id_to_piece(i) for i in plain}
        self.ids = {p: i for i, p in self.names.items()}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        self.unknown = sp.unk_id()
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces of this model cross word boundaries")
        self.longest = max(map(len, self.ids))
        table = np.zeros((len(plain), self.longest), ">u4")
        for row, i in enumerate(plain):
            table[row, : len(self.names[i])] = [ord(c) for c in self.names[i]]
        self.lengths = np.array([len(self.names[i]) for i in plain])
        self.numbers = np.array(plain)
        self.low = table.view(f"S{4 * self.longest}").ravel()
        high = table.copy()
        high[np.arange(self.longest) >= self.lengths[:, None]] = 0xFFFFFFFF
        self.high = high.view(f"S{4 * self.longest}").ravel()
        self.pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        codes = np.array([(ord(p[0]), ord(p[1])) for p in self.pairs], np.int64).reshape(-1, 2)
        self.pair_codes = np.sort(codes[:, 0] << 21 | codes[:, 1])
        self.single_codes = np.array(sorted(ord(p) for p in self.ids if len(p) == 1), np.int64)
        # What each id stands for whatever stands beside it; bytes from 0x80 on depend on their neighbours.
        alone = self.names | {i: chr(b) for b, i in enumerate(self.bytes) if b < 0x80}
        self.texts = pa.array([alone.get(i, "") for i in range(sp.vocab_size())], pa.string())
        self.plain = np.isin(np.arange(sp.vocab_size()), list(alone))
        self.cache: dict[str, list[int]] = {}
        self.atoms: dict[str, list[int]] = {}
        self.agrees: dict[int, bool] = {}

    def _merge(self, text: str) -> list[str]:
        """Plain merging of a short string: the highest score first, leftmost of equals."""
        parts, score = list(text), self.scores.get
        while len(parts) > 1:
            best, k = None, 0
            for i in range(len(parts) - 1):
                s = score(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, k = s, i
            if best is None:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _agree(self, left: str, right: str) -> bool:
        """Whether two pieces side by side stay as they are; with no left one, whether the piece does."""
        return self._merge(left + right) == ([left, right] if left else [right])

    def _name(self, piece: int) -> str:
        """The characters of a piece, or of a character that is no piece; of none the empty string."""
        return "" if piece == NONE else self.names[piece] if piece < FREE else chr(piece - FREE)

    def _agreements(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``_agree`` for many pairs, each distinct pair once."""
        keys, back = np.unique(left.astype(np.int64) << 32 | right, return_inverse=True)
        if len(self.agrees) > CACHE_PAIRS:
            self.agrees.clear()
        out, known = np.empty(len(keys), bool), self.agrees.get
        for k, key in enumerate(keys.tolist()):
            found = known(key)
            if found is None:
                found = self.agrees[key] = self._agree(self._name(key >> 32), self._name(key & 0xFFFFFFFF))
            out[k] = found
        return out[back]

    def _edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All occurrences of pieces as (end, start, piece), sorted by place. A character that is no piece is an edge too."""
        alone = np.flatnonzero(~np.isin(text, self.single_codes) & (text != END_UNIT))
        ends, starts, kinds = [alone + 1], [alone], [text[alone].astype(np.int64) + FREE]
        padded = np.concatenate([text, np.full(self.longest, END_UNIT)]).astype(">u4")
        for at in range(0, len(text), BLOCK_CHARS):
            n = min(BLOCK_CHARS, len(text) - at)
            windows = np.lib.stride_tricks.sliding_window_view(padded[at : at + n + self.longest - 1], self.longest)
            suffixes = np.ascontiguousarray(windows).view(f"S{4 * self.longest}").ravel()
            array = np.argsort(suffixes, kind="stable")
            ordered = suffixes[array]
            first, last = np.searchsorted(ordered, self.low, "left"), np.searchsorted(ordered, self.high, "right")
            count = last - first
            which = np.repeat(np.arange(len(count)), count)
            place = array[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)] + at
            starts.append(place)
            ends.append(place + self.lengths[which])
            kinds.append(self.numbers[which])
        start, end, kind = np.concatenate(starts), np.concatenate(ends), np.concatenate(kinds)
        order = np.lexsort((start, end))
        return end[order], start[order], kind[order]

    def _encode_atoms(self, atoms: list[str]) -> list[list[int]]:
        """The ids of each atom. Edges are relaxed for all atoms at once, those that end after one character first."""
        lengths = np.array([len(a) for a in atoms])
        bases = np.cumsum(lengths + 1) - lengths - 1
        codes = np.frombuffer("\x00".join(atoms).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        codes[bases[1:] - 1] = END_UNIT
        end, start, kind = self._edges(codes)
        base = bases[np.searchsorted(bases, start, "right") - 1]
        depth = end - base
        order = np.argsort(depth, kind="stable")
        end, start, kind, first = end[order], start[order], kind[order], (start == base)[order]
        cuts = np.searchsorted(depth[order], np.arange(1, lengths.max() + 2))
        last = np.full(len(codes) + 2, UNREACHED, np.int64)  # per place the last piece of the encoding up to it, and where it starts
        back = np.zeros(len(codes) + 2, np.int64)
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            left = np.where(first[lo:hi], NONE, last[start[lo:hi]])
            some = np.flatnonzero(left != UNREACHED)
            some = some[self._agreements(left[some], kind[lo:hi][some])] + lo
            last[end[some]], back[end[some]] = kind[some], start[some]
        last_of, back_of, out = last.tolist(), back.tolist(), []
        for at, n in zip(bases.tolist(), lengths.tolist(), strict=True):
            place, path = at + n, []
            while place > at:
                path.append(last_of[place])
                place = back_of[place]
            path.reverse()
            if max(path) >= FREE:
                path = [i for p in path for i in ([p] if p < FREE else [self.bytes[b] for b in chr(p - FREE).encode("utf-8", "surrogatepass")])]
            out.append(path)
        return out

    def _cut(self, units: list[str]) -> tuple[list[str], np.ndarray]:
        """The atoms of all units, end to end, and where each unit's begin among them."""
        text = "".join(units)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        bounds = np.cumsum([0, *map(len, units)])
        free = np.ones(len(codes) + 1, bool)
        if len(self.pair_codes):
            pair = codes[:-1] << 21 | codes[1:]
            at = np.minimum(np.searchsorted(self.pair_codes, pair), len(self.pair_codes) - 1)
            free[1:-1] = self.pair_codes[at] != pair
        free[bounds] = True
        cuts = np.flatnonzero(free)
        places = cuts.tolist()
        return [text[a:b] for a, b in zip(places[:-1], places[1:], strict=True)], np.searchsorted(cuts, bounds)

    def _learn(self, distinct: list[str]) -> None:
        """Puts the ids of units into the cache."""
        if len(self.cache) + len(distinct) > CACHE_UNITS:
            self.cache.clear()
        missing = [u for u in distinct if u not in self.cache]
        if not missing:
            return
        parts, bounds = self._cut(missing)
        atoms = set(parts)
        if len(self.atoms) + len(atoms) > CACHE_UNITS:
            self.atoms.clear()
        new = [a for a in atoms if a not in self.atoms]
        if new:
            self.atoms.update(zip(new, self._encode_atoms(new), strict=True))
        known, places = self.atoms, bounds.tolist()
        for unit, a, b in zip(missing, places[:-1], places[1:], strict=True):
            self.cache[unit] = known[parts[a]] if b == a + 1 else [i for p in parts[a:b] for i in known[p]]

    def encode_array(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text of a batch; a null has none."""
        lists = cut_units(texts)
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self._learn(distinct)
        own = [self.cache[u] for u in distinct]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        flat = np.fromiter(chain.from_iterable(own), np.int32, int(sizes.sum()))
        each = pa.LargeListArray.from_arrays(np.append(0, np.cumsum(sizes)), pa.array(flat))
        which = coded.indices
        ids = each.take(which).flatten()
        ends = np.append(0, np.cumsum(sizes[which.to_numpy()]))
        return pa.LargeListArray.from_arrays(ends[lists.offsets.to_numpy()], ids)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text of a batch."""
        return self.encode_array(pa.array(texts, pa.string())).to_pylist()

    def decode_array(self, lists: pa.LargeListArray) -> list[str]:
        """The text of each list of ids."""
        ids, bounds = lists.flatten(), lists.offsets.to_numpy()
        odd = np.append(0, np.cumsum(~self.plain[ids.to_numpy()]))
        joined = pc.binary_join(pa.ListArray.from_arrays(lists.offsets.cast(pa.int32()), self.texts.take(ids)), "")
        marked = pc.replace_substring(joined, MARK, " ").to_pylist()
        simple = odd[bounds[1:]] == odd[bounds[:-1]]
        return [t[1:] if s and t.startswith(" ") else t if s else self.decode(x.as_py()) for t, s, x in zip(marked, simple, lists, strict=True)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD each."""
        out, held = [], bytearray()

        def close() -> None:
            text = bytes(held)
            held.clear()
            while text:
                try:
                    out.append(text.decode("utf-8"))
                    return
                except UnicodeDecodeError as e:
                    out.append(text[: e.start].decode("utf-8") + "�")
                    text = text[e.start + 1 :]

        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                close()
            out.append(self.names.get(i, " ⁇ " if i == self.unknown else ""))
        if held:
            close()
        text = "".join(out).replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def units(text: str | None) -> list[str]:
    """The normalised text, cut before each mark that no other mark precedes."""
    if not text:
        return []
    parts = (MARK + text.replace(" ", MARK)).split(MARK)
    out, run = [], ""
    for part in parts[1:]:
        run += MARK
        if part:
            out.append(run + part)
            run = ""
    return out + [run] * bool(run)


def cut_units(texts: pa.Array) -> pa.ListArray:
    """``units`` of each text by Arrow kernels, around a control character that no text of the batch has."""
    free = next((c for c in SEPARATORS if not pc.any(pc.match_substring(texts, c)).as_py()), None)
    if free is None:
        return pa.array([units(t) for t in texts.to_pylist()], pa.large_list(pa.large_string()))
    texts = texts.cast(pa.large_string())
    marked = pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), pc.replace_substring(texts, " ", MARK), pa.scalar("", pa.large_string()))
    parts = pc.split_pattern(pc.replace_substring_regex(marked, f"({MARK}+)", free + "\\1"), free)
    # The first part of each text is empty, as the text begins with a mark; it goes, and so does the mark put before no text.
    offsets = parts.offsets.to_numpy()
    empty = pc.fill_null(pc.equal(texts, ""), True).to_numpy(zero_copy_only=False)
    gone = np.where(empty, np.diff(offsets), 1)
    kept = np.ones(len(parts.values), bool)
    kept[offsets[:-1][~empty]] = False
    kept[np.repeat(empty, np.diff(offsets))] = False
    fewer = offsets - np.append(0, np.cumsum(gone))
    return pa.LargeListArray.from_arrays(fewer.astype(np.int64), parts.values.filter(pa.array(kept)))


_models: dict[str, Pieces] = {}


def pieces(model: str) -> Pieces:
    """One per Python worker and model."""
    if model not in _models:
        _models[model] = Pieces(model)
    return _models[model]


def encode(docs: DataFrame, id_col: str = "doc_id", text: str = "text", model: str | None = None, ids: bool = True, batch: int = 1024) -> DataFrame:
    """Per document its id, ``n_ids``, ``ids_crc32`` (as little-endian unsigned 32-bit integers), ``returns`` (whether decoding gives
    the text back, a U+2581 in it as a space) and, if asked for, ``ids``."""
    model = model or default_model()
    wanted = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                rb = whole.slice(at, batch)
                texts = rb.column(1)
                found = own.encode_array(texts)
                bounds, flat = found.offsets.to_numpy(), found.flatten().to_numpy().astype("<u4")
                crcs = [zlib.crc32(flat[a:b]) for a, b in itertools.pairwise(bounds.tolist())]
                same = [d == (t or "").replace(MARK, " ") for d, t in zip(own.decode_array(found), texts.to_pylist(), strict=True)]
                columns = [rb.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(crcs, pa.int64()), pa.array(same), *[found.cast(pa.list_(pa.int32()))] * ids]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_ids", "ids_crc32", "returns", *["ids"] * ids])

    return wanted.mapInArrow(run, f"`{id_col}` {wanted.schema['id'].dataType.simpleString()}, n_ids long, ids_crc32 long, returns boolean" + ", ids array<int>" * ids)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids: str = "ids", model: str | None = None) -> DataFrame:
    """Per document its id and ``text``; null ids give the empty text."""
    model = model or default_model()
    wanted = encoded.select(F.col(id_col).alias("id"), F.col(ids).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            texts = [pieces(model).decode(x.as_py() or []) for x in rb.column(1)]
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return wanted.mapInArrow(run, f"`{id_col}` {wanted.schema['id'].dataType.simpleString()}, text string")
