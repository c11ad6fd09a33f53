"""Exact byte-level BPE encoding of whole texts, a distinct word at a time.

The pre-tokenizer of byte-level BPE never lets a token reach across a space that stands before a
non-space: that space always begins a group of its own. Texts are cut there into pieces, words with their leading
space and punctuation, and equal pieces have equal ids wherever they stand. The distinct pieces of a stretch of
text are cut once more, into the pre-tokenizer's groups, and the distinct groups are looked up in a cache of
bounded size. Only new groups go to the BPE model of the tokenizers library; pieces with unusual white space or characters
go through the whole library uncut. Cutting, finding what is distinct and
putting ids together are Arrow kernels. A text of any length needs memory for its own ids and one stretch.

This holds for a vocabulary of that kind alone (``_cuts_alike``). Texts that contain a string of its added tokens, and all texts of any other
vocabulary, are handed to the library whole. Null texts are empty; equal texts have equal ids.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Distinct groups in each of a task's two cache generations.
CACHE_GROUPS = 400_000
#: Id that ends each document.
END_ID = 0
#: Characters of text worked on at a time; a longer text is cut at a place where pieces end.
STRETCH = 1 << 22
_CUT = regex.compile(r" (?!\s)(?=.)", regex.S)
#: Fixed value: white space, for RE2. A space before it is no place to cut.
_WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ODD = rf" (?:[{_WHITE}]|$)"
#: Fixed value: the groups of byte-level BPE, for pieces whose only white space is lone spaces and line ends, and whose characters' classes no Unicode version changes.
_GROUPS = r"('s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\n)"
_WHOLE = r"[^\n\x20-\x7e\x{a1}-\x{24f}]|[ \n][ \n]| $"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def stretches(text: str) -> Iterator[str]:
    """The text in stretches of about ``STRETCH`` characters, cut between pieces where it has any."""
    at = 0
    while len(text) - at > STRETCH and (cut := _CUT.search(text, at + STRETCH)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def pieces(text: str) -> list[str]:
    """Cuts before each space that a non-space follows; joined, the pieces are the text."""
    out: list[str] = []
    parts = text.split(" ")
    held = [parts[0]]
    for part in parts[1:]:
        if part and not part[0].isspace():
            out.append(" ".join(held))
            held = ["", part]
        else:
            held.append(part)
    out.append(" ".join(held))
    return out


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts, and where each text's begin among them; a text may have empty pieces."""
    parts = pc.split_pattern(pc.replace_substring(texts, " ", "\0 "), "\0")
    odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
    if odd.any():
        lists = [pieces(t) if o else x for t, o, x in zip(texts.to_pylist(), odd, parts.to_pylist(), strict=True)]
        parts = pa.array(lists, parts.type)
    return parts.flatten(), parts.offsets.to_numpy()


def _joined(lists: pa.Array, which: pa.Array) -> pa.Array:
    return lists.take(which).flatten()


def _lists(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), values)


def _cuts_alike(settings: dict) -> bool:
    """Whether a tokenizer is plain byte-level BPE, whose groups ``_GROUPS`` and whose cuts ``_CUT`` tell."""
    cut, model = settings.get("pre_tokenizer") or {}, settings["model"]
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    byte_level = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex")
    return bool(byte_level and model.get("type") == "BPE" and plain and not any(settings.get(k) for k in ("normalizer", "truncation", "padding")))


class Encoder:
    """Ids as unsigned 32-bit arrays, those that the library gives for the whole text without special tokens added."""

    def __init__(self, vocabulary: str, cache_groups: int = CACHE_GROUPS) -> None:
        if vocabulary not in _tokenizers:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            made = Tokenizer.from_file(vocabulary)
            settings = json.loads(made.to_str())
            _tokenizers[vocabulary] = made, _cuts_alike(settings), [t["content"] for t in settings["added_tokens"]]
        self.tokenizer, self.plain, self.added = _tokenizers[vocabulary]
        self.groups: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.uncut: set[str] = set()  # pieces that the library has to cut
        self.cache_groups = cache_groups
        # Byte-level BPE writes each byte as a printable character: itself, or the next one from U+0100.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.table = dict(zip([b for b in range(256) if b not in shown], range(0x100, 0x200), strict=False))

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text in order, without an end id; null is empty."""
        waiting: list[str] = []
        size = 0
        for text in texts:
            text = text or ""
            if not self.plain or any(x in text for x in self.added):
                yield from self._encode(waiting)
                waiting, size = [], 0
                yield self._whole(text)
                continue
            alone = len(text) > STRETCH or "\0" in text  # NUL is the mark between pieces
            if alone or size + len(text) > STRETCH:
                yield from self._encode(waiting)
                waiting, size = [], 0
            if alone and "\0" in text:
                yield np.concatenate([self._whole(x) for x in stretches(text)])
            elif alone:
                yield np.concatenate([ids for x in stretches(text) for ids in self._encode([x])])
            else:
                waiting.append(text)
                size += len(text)
        yield from self._encode(waiting)
        pa.default_memory_pool().release_unused()

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        if not texts:
            return
        flat, bounds = _split(pa.array(texts, pa.large_string()))
        coded = flat.dictionary_encode()
        distinct, which = coded.dictionary, coded.indices.to_numpy()
        # A word with at most one full stop or comma behind it needs no pattern to be cut.
        core = pc.utf8_rtrim(distinct, ",.")
        short = pc.less_equal(pc.subtract(pc.utf8_length(distinct), pc.utf8_length(core)), 1)
        word = pc.and_(pc.starts_with(core, " "), pc.utf8_is_alpha(pc.utf8_slice_codeunits(core, 1)))
        easy = pc.and_(pc.and_(short, word), pc.invert(pc.match_substring_regex(distinct, _WHOLE)))
        plain, other = distinct.filter(easy), distinct.filter(pc.invert(easy))
        order = np.argsort(~easy.to_numpy(zero_copy_only=False), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        which = pa.array(place[which])
        plain = pc.replace_substring(pc.replace_substring(plain, ",", "\0,"), ".", "\0.")
        marked = pc.utf8_slice_codeunits(pc.replace_substring_regex(other, _GROUPS, "\\1\0"), 0, -1)
        whole = pc.match_substring_regex(other, _WHOLE)
        self.uncut = set(other.filter(whole).to_pylist())
        other = pc.if_else(whole, other, marked)
        parts = pc.split_pattern(pa.concat_arrays([plain, other]), "\0")
        groups = parts.flatten().dictionary_encode()
        ids, sizes = self._known(groups.dictionary.to_pylist())
        of_group = _lists(ids, np.append(0, np.cumsum(sizes)))
        in_piece = np.append(0, np.cumsum(sizes[groups.indices.to_numpy()]))[parts.offsets.to_numpy()]
        of_piece = _lists(_joined(of_group, groups.indices), in_piece)
        whole = _joined(of_piece, which).to_numpy()
        places = np.append(0, np.cumsum(np.diff(in_piece)[which.to_numpy()]))[bounds]
        for a, b in zip(places[:-1], places[1:], strict=True):
            yield whole[a:b]

    def _known(self, names: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The ids of groups end to end, and how many each has."""
        if len(self.groups) > self.cache_groups:
            self.older, self.groups = self.groups, {"": b""}
        groups, older = self.groups, self.older
        new = []
        for name in names:
            if name not in groups:
                if name in older:
                    groups[name] = older[name]
                else:
                    new.append(name)
        self._look_up(new)
        found = [groups[n] for n in names]
        return pa.array(np.frombuffer(b"".join(found), "<u4")), np.array([len(x) for x in found], np.int64) // 4

    def _look_up(self, new: list[str]) -> None:
        """Asks the library's BPE model for each group, which is what it would do after its own cutting."""
        groups, model, table = self.groups, self.tokenizer.model.tokenize, self.table
        for group in new:
            mapped = group.encode("utf-8", "surrogatepass").decode("latin-1").translate(table)
            groups[group] = array("I", [t.id for t in model(mapped)]).tobytes()
        for group in self.uncut.intersection(new):
            groups[group] = self._whole(group).astype("<u4").tobytes()


_tokenizers: dict = {}


def encoder(vocabulary: str) -> Encoder:
    """An encoder for one task. Its cache goes with it, so that an idle Python worker holds the vocabulary only."""
    return Encoder(vocabulary)
