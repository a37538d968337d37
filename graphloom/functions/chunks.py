"""Splitting texts into chunks. Every function returns an array column; lengths are code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE

_CUT = "\u0001"


def fixed_chunks(c: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Chunks of ``size`` that share ``overlap`` with the one before; an overlap that is not below the size is half of it."""
    if overlap >= size:
        overlap = size // 2
    stride = size - overlap
    n = F.ceil(F.char_length(c) / F.lit(stride)).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(c, i * stride + 1, F.lit(size)))


def sentence_pieces(c: Column, compat: bool = True) -> Column:
    """Non-empty pieces after sentence ends. ``compat`` needs white space or the end after the mark; else the mark is enough."""
    marked = F.regexp_replace(c, f"([。！？.])({SPACE}|$)" if compat else r"([。！？.!?])", f"$1$2{_CUT}" if compat else f"$1{_CUT}")
    return F.filter(F.split(marked, _CUT, -1), lambda p: p != "")


def paragraph_pieces(c: Column) -> Column:
    """Trimmed, non-empty paragraphs, which blank lines part."""
    return F.filter(F.transform(F.split(c, r"\n[ \t\x0B\f\r\n]*\n", -1), lambda p: F.btrim(p, F.lit(" \t\n\r"))), lambda p: p != "")


def packed(pieces: Column, most: int, size: int, joiner: str) -> Column:
    """Pieces packed in order: a chunk ends before the piece that would bring it over ``size`` or that it has no place for."""
    extra = len(joiner)
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"), F.lit(0).alias("chars"))

    def step(acc, p):
        full = (acc["n"] > 0) & ((acc["n"] >= most) | (acc["chars"] + F.char_length(p) > size))
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["n"] == 0), p).otherwise(F.concat(acc["now"], F.lit(joiner), p)).alias("now"),
            F.when(full, F.lit(1)).otherwise(acc["n"] + 1).alias("n"),
            F.when(full, F.char_length(p) + extra).otherwise(acc["chars"] + F.char_length(p) + extra).alias("chars"),
        )

    return F.aggregate(pieces, empty, step, lambda acc: F.when(acc["n"] > 0, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]))


def sentence_chunks(c: Column, size: int = 1000, most: int = 10, compat: bool = True) -> Column:
    return packed(sentence_pieces(c, compat), most, size, "")


def paragraph_chunks(c: Column, size: int = 2000, most: int = 5) -> Column:
    return packed(paragraph_pieces(c), most, size, "\n\n")


def _words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"\w+"), F.lit(0)))


def semantic_chunks(c: Column, size: int = 1000, threshold: float = 0.1) -> Column:
    """Sentences packed up to ``size``; a chunk also ends where a sentence shares less than ``threshold`` of its words with the last one."""
    pieces = sentence_pieces(c, compat=False)
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit("").alias("last"))

    def step(acc, p):
        a, b = _words(acc["last"]), _words(p)
        share = F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
        new = (acc["now"] != "") & ((F.char_length(acc["now"]) + F.char_length(p) > size) | (share < threshold))
        return F.struct(F.when(new, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"), F.when(new, p).otherwise(F.concat(acc["now"], p)).alias("now"), p.alias("last"))

    return F.aggregate(pieces, empty, step, lambda acc: F.when(acc["now"] != "", F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]))


def hybrid_chunks(c: Column, size: int = 1000, overlap: int = 0) -> Column:
    """Paragraph chunks; those that are still over ``size`` are cut into fixed ones."""
    return F.flatten(F.transform(paragraph_chunks(c, size), lambda p: F.when(F.char_length(p) > size, fixed_chunks(p, size, overlap)).otherwise(F.array(p))))


SPLITTERS: dict[str, Callable[..., Column]] = {"FIXED_SIZE": fixed_chunks, "SENTENCE": sentence_chunks, "PARAGRAPH": paragraph_chunks, "SEMANTIC": semantic_chunks, "HYBRID": hybrid_chunks}


def split_by(strategy: str, c: Column, **options) -> Column:
    """Chunks by the named strategy; an unknown one packs paragraphs."""
    return SPLITTERS.get(strategy.upper(), paragraph_chunks)(c, **options)


def with_metadata(chunks: Column, doc_id: Column, metadata: Column) -> Column:
    """Chunks as structs of index, id, text and their document's metadata; the id is a hash of document and index."""
    return F.transform(chunks, lambda t, i: F.struct(i.alias("index"), F.sha2(F.concat_ws("#", doc_id.cast("string"), i.cast("string")), 256).alias("id"), t.alias("text"), metadata.alias("metadata")))


def stream_pieces(c: Column, size: int = 5) -> Column:
    """An answer in pieces of ``size`` code points, as it is streamed."""
    return fixed_chunks(c, size, 0)


