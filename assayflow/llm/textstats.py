"""Text statistics as native column expressions. A null text counts as empty; no statistic is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .shared import count_chars, let, words_of

SYMBOLS = "#*$%&|<>"
MARKS = ".,;:!?"
WHITE = " \t\n\x0b\x0c\r"
WINDOW = 5


def word_chars(text: Column) -> Column:
    return F.length(text).cast("long") - count_chars(text, WHITE)


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))).cast("long")


def _window_keys(words: Column) -> Column:
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    key = lambda h: lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
    return let(hashed, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), key(h)))


def _covered(keys: Column) -> Column:
    """Words in windows whose key occurs twice or more: sorts, so n log n for any text."""
    pairs = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    same = lambda s, x, j: F.coalesce(F.get(s, j)["k"] == x["k"], F.lit(False))
    twice = lambda s: F.filter(s, lambda x, j: same(s, x, j + 1) | same(s, x, F.when(j > 0, j - 1).otherwise(F.size(s))))
    places = let(pairs, lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))
    gaps = lambda p: F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
    return F.aggregate(let(places, gaps), F.lit(0).cast("long"), lambda a, x: a + x)


def n_repeat_words(words: Column) -> Column:
    """Words in 5-word windows that are found twice or more in the text, the first included."""
    some = let(_window_keys(words), lambda k: F.when(F.size(F.array_distinct(k)) < F.size(k), _covered(k)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) > WINDOW, some).otherwise(F.lit(0).cast("long"))


def base_statistics(text: Column) -> Column:
    """A struct of ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_marks`` and ``n_distinct``, all long."""
    both = F.struct(F.coalesce(text, F.lit("")).alias("t"), words_of(text).alias("w"))
    return let(both, lambda x: F.struct(
        F.size(x["w"]).cast("long").alias("n_words"), word_chars(x["t"]).alias("word_chars"), count_chars(x["t"], SYMBOLS).alias("n_symbols"),
        n_dup_lines(x["t"]).alias("n_dup_lines"), n_repeat_words(x["w"]).alias("n_repeat_words"), n_lines(x["t"]).alias("n_lines"),
        count_chars(x["t"], MARKS).alias("n_marks"), F.size(F.array_distinct(x["w"])).cast("long").alias("n_distinct"),
    ))
