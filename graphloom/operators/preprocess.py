"""The preprocessing pipeline: cleaning, splitting, metadata, tokens and keywords, as steps that are chained over a DataFrame.

A step takes rows and options and returns the rows with its columns; it works on whole columns, so a batch of files is one job.
A step that the options skip leaves the defaults of its columns. Steps made of one's own functions (``own_step``) are run in
Arrow batches; a row at which such a function fails keeps the step's fallback, and the others are not touched by it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metadata as meta
from ..functions.chunks import split_by
from ..functions.names import STOP_WORDS
from ..functions.text import Cleaner
from ..functions.tokens import Segmenter
from ..sources.files import load_documents
from .scratch import small_batches

#: The columns that the steps fill, in order, and what they hold before.
COLUMNS = {"cleaned": "string", "chunks": "array<string>", "metadata": "map<string,string>", "tokens": "array<string>", "keywords": "array<struct<word:string,weight:double>>"}


@dataclass(frozen=True)
class Options:
    clean: bool = True
    split: bool = True
    strategy: str = "FIXED_SIZE"
    split_options: dict = field(default_factory=dict)
    extract_metadata: bool = True
    tokenize: bool = True
    mode: str = "MIX"
    extract_keywords: bool = True
    keyword_count: int = 10


Step = Callable[[DataFrame, Options], DataFrame]


def cleaning(cleaner: Callable[[Column], Column] | None = None) -> Step:
    """cleaned: the text by ``cleaner``, or the text itself if cleaning is skipped; null stays null."""
    rule = cleaner or Cleaner()
    return lambda rows, options: rows.withColumn("cleaned", rule(F.col("text")) if options.clean else F.col("text"))


def splitting(rows: DataFrame, options: Options) -> DataFrame:
    """chunks of the cleaned text by the strategy; skipped, or where it gives none, the whole text is the one chunk."""
    whole = F.when(F.coalesce(F.col("cleaned"), F.lit("")) != "", F.array("cleaned")).otherwise(F.array().cast("array<string>"))
    if not options.split:
        return rows.withColumn("chunks", whole)
    found = split_by(options.strategy, F.col("cleaned"), **options.split_options)
    return rows.withColumn("chunks", F.when(F.size(found) > 0, found).otherwise(whole))


def extracting_metadata(rows: DataFrame, options: Options) -> DataFrame:
    """metadata: counts of the cleaned text, over which the file's own entries (``file_metadata``, if there) are laid."""
    if not options.extract_metadata:
        return rows
    c = F.col("cleaned")
    counts = F.create_map(F.lit("character_count"), meta.character_count(c).cast("string"), F.lit("line_count"), meta.line_count(c).cast("string"), F.lit("word_count"), meta.word_count(c).cast("string"))
    base = F.when(F.coalesce(c, F.lit("")) != "", counts).otherwise(F.create_map().cast("map<string,string>"))
    return rows.withColumn("metadata", laid_over(base, F.col("file_metadata")) if "file_metadata" in rows.columns else base)


def laid_over(base: Column, top: Column) -> Column:
    """Both maps' entries; of equal keys that of ``top``, which may be null."""
    top = F.coalesce(top, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(top), k)), top)


def tokenizing(segmenter: Segmenter | None = None) -> Step:
    """tokens of the cleaned text in the options' mode."""
    own = segmenter or Segmenter()
    return lambda rows, options: rows.withColumn("tokens", own.column(F.coalesce("cleaned", F.lit("")), options.mode)) if options.tokenize else rows


def top_tokens(tokens: Iterable[str], k: int, stop_words: Iterable[str] = STOP_WORDS) -> list[dict]:
    """The ``k`` most frequent tokens, by frequency and then by word, with their share of all; stop words do not count."""
    skipped = set(stop_words)
    counted = Counter(t for t in tokens if t not in skipped)
    total = sum(counted.values())
    return [{"word": w, "weight": n / total} for w, n in sorted(counted.items(), key=lambda x: (-x[1], x[0]))[:k]]


def extracting_keywords(segmenter: Segmenter | None = None, stop_words: Iterable[str] = STOP_WORDS) -> Step:
    """keywords of the cleaned text, and their words in the metadata, joined by ", "; texts without any leave both as they are.
    They are counted from the text itself, so the step does not need the tokens' one."""
    own, words = segmenter or Segmenter(), tuple(stop_words)

    def step(rows: DataFrame, options: Options) -> DataFrame:
        if not options.extract_keywords:
            return rows
        k = options.keyword_count

        @F.pandas_udf(COLUMNS["keywords"])
        def top(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: top_tokens(own.cut(t), k, words))

        rows = rows.withColumn("keywords", top(F.coalesce("cleaned", F.lit(""))))
        joined = F.create_map(F.lit("keywords"), F.array_join(F.transform("keywords", lambda x: x["word"]), ", "))
        return rows.withColumn("metadata", F.when(F.size("keywords") > 0, laid_over(F.col("metadata"), joined)).otherwise(F.col("metadata")))

    return step


def own_step(column: str, function: Callable[[str], str], fallback: str = "text") -> Step:
    """``column`` by a function of the cleaned text (of the text where that is null); where it fails, the column ``fallback``."""

    def guarded(text):
        try:
            return None if text is None else function(text)
        except Exception:  # the row falls back
            return None

    def step(rows: DataFrame, options: Options) -> DataFrame:
        run = F.pandas_udf(lambda texts: texts.map(guarded), "string")
        return rows.withColumn(column, F.coalesce(run(F.coalesce("cleaned", "text")), F.col(fallback)))

    return step


class Pipeline:
    """Steps in order; the five of the reference order unless others are given."""

    def __init__(self, steps: Iterable[Step] | None = None):
        self.steps = [cleaning(), splitting, extracting_metadata, tokenizing(), extracting_keywords()] if steps is None else list(steps)

    def add(self, step: Step) -> Pipeline:
        self.steps.append(step)
        return self

    def clear(self) -> Pipeline:
        self.steps.clear()
        return self

    def __call__(self, docs: DataFrame, options: Options | None = None) -> DataFrame:
        """``docs`` (text, others) with the columns of ``COLUMNS``; those of no step are empty."""
        options = options or Options()
        rows = small_batches(docs).select(*[c for c in docs.columns if c not in COLUMNS], *[_nothing(t).alias(c) for c, t in COLUMNS.items()])
        for step in self.steps:
            rows = step(rows, options)
        return rows

    def text(self, spark: SparkSession, text: str | None, options: Options | None = None) -> DataFrame:
        return self(spark.createDataFrame([(text,)], "text string"), options)

    def files(self, spark: SparkSession, *paths: str, options: Options | None = None, extractors: dict | None = None) -> DataFrame:
        """path, loader, text and the columns of each file, with the file's own metadata; a file that cannot be read has an empty text."""
        found = load_documents(spark, *paths, extractors=extractors)
        kind = meta.document_type(F.col("text"), F.col("path"))
        own = F.map_concat(meta.metadata_by_type(kind, F.col("text")), F.create_map(F.lit("file_name"), F.element_at(F.split("path", "/"), -1)))
        return self(found.withColumn("file_metadata", own), options).drop("file_metadata")


def _nothing(kind: str) -> Column:
    empty = F.create_map() if kind.startswith("map") else F.array() if kind.startswith("array") else F.lit(None)
    return empty.cast(kind)
