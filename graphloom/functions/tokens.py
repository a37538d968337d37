"""Tokens and keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import STOP_WORDS
from .segment import SEED_WORDS, Segmenter  # noqa: F401
from .text import SPACE

#: ASCII marks.
MARKS = r"[!-/:-@\[-`{-~]"
def plain_tokens(c: Column) -> Column:
    """Between white space, lower-cased, ASCII marks out, empty ones dropped."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(c), f"{MARKS}+", ""), f"{SPACE}+"), "")


def drop_stop_words(tokens: Column, stop_words=STOP_WORDS) -> Column:
    words = F.array(*[F.lit(w) for w in stop_words])
    return F.filter(tokens, lambda t: ~F.array_contains(words, t))


def top_words(tokens: Column, k: int = 10) -> Column:
    """(word, weight) of the ``k`` most frequent tokens, by weight and then word; the weight is the share of the tokens."""
    n = F.size(tokens)
    counted = F.transform(F.array_distinct(tokens), lambda w: F.struct((-F.size(F.filter(tokens, lambda t: t == w))).alias("m"), w.alias("word")))
    return F.transform(F.slice(F.array_sort(counted), 1, k), lambda s: F.struct(s["word"].alias("word"), (-s["m"] / n).alias("weight")))


def model_tokens(c: Column) -> Column:
    """What stands between white space, as a stand-in for a model's tokens."""
    return F.filter(F.split(c, f"{SPACE}+", -1), lambda t: t != "")


def joined_tokens(tokens: Column) -> Column:
    """The text of ``model_tokens``, with one space between."""
    return F.array_join(tokens, " ")
