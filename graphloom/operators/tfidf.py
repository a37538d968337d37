"""Term statistics and TF-IDF in long form: one row for each document and term."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tokens import drop_stop_words, plain_tokens


def term_frequencies(docs: DataFrame, text: str = "text", tokenizer: Callable[[Column], Column] = plain_tokens, stop_words=(), binary: bool = False) -> DataFrame:
    """doc_id, term, tf. Raw counts, or 1 each if ``binary``.

    The texts are dealt out by document, whole, as their terms by themselves are several times as large: counting, norms and ranks by
    document need no further exchange, and what counts them twice in one plan, as a vocabulary and its use do, shares this one.
    """
    tokens = tokenizer(F.col(text))
    if stop_words:
        tokens = drop_stop_words(tokens, stop_words)
    counted = docs.select("doc_id", text).repartition("doc_id").select("doc_id", F.explode(tokens).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return counted.withColumn("tf", F.lit(1).cast("long")) if binary else counted


def document_frequencies(tf: DataFrame) -> DataFrame:
    """term, df; the rows of ``tf`` are distinct by document and term already."""
    return tf.groupBy("term").agg(F.count("*").alias("df"))


@dataclass(frozen=True)
class TfIdf:
    """Parameters of a vectorizer. ``min_df`` and ``max_df`` below 1 are shares of the documents; ``min_df`` from 1 is a number, ``max_df`` from 1 is off."""

    min_df: float = 0.0
    max_df: float = 1.0
    max_features: int = 0
    norm: str = "l2"
    binary: bool = False
    smooth: float = 1.0
    tokenizer: Callable[[Column], Column] = plain_tokens
    stop_words: tuple = ()

    def counted(self, docs: DataFrame, text: str = "text") -> DataFrame:
        return term_frequencies(docs, text, self.tokenizer, self.stop_words, self.binary)

    def vocabulary(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """term, df, idf and the term's place by df (falling) and name."""
        n = docs.agg(F.count("*").alias("n"))
        df = document_frequencies(self.counted(docs, text)).crossJoin(F.broadcast(n))  # one row
        if self.min_df > 0:
            df = df.filter(F.col("df") >= (F.lit(self.min_df) * F.col("n") if self.min_df < 1 else F.lit(self.min_df)))
        if self.max_df < 1:
            df = df.filter(F.col("df") <= F.lit(self.max_df) * F.col("n"))
        if self.max_features:
            df = df.orderBy(F.desc("df"), "term").limit(self.max_features)
        return df.select("term", "df", (F.log((F.col("n") + self.smooth) / (F.col("df") + self.smooth)) + 1).alias("idf"))

    def transform(self, docs: DataFrame, vocabulary: DataFrame, text: str = "text") -> DataFrame:
        """doc_id, term, weight; terms outside the vocabulary are dropped, rows of norm 0 stay as they are."""
        w = self.counted(docs, text).join(vocabulary.select("term", "idf"), "term").withColumn("w", F.col("tf") * F.col("idf"))
        if self.norm in ("l1", "l2"):
            row = Window.partitionBy("doc_id")
            size = F.sum(F.abs("w")).over(row) if self.norm == "l1" else F.sqrt(F.sum(F.col("w") * F.col("w")).over(row))
            w = w.withColumn("size", size).withColumn("w", F.when(F.col("size") > 0, F.col("w") / F.col("size")).otherwise(F.col("w")))
        return w.select("doc_id", "term", F.col("w").alias("weight"))

    def fit_transform(self, docs: DataFrame, text: str = "text") -> DataFrame:
        return self.transform(docs, self.vocabulary(docs, text), text)


def feature_names(vocabulary: DataFrame) -> DataFrame:
    """term and its index by df (falling) and name. Terms of one df and two first letters are numbered among themselves, after
    all that come before: one window holds the sizes of these groups, the others a group each."""
    dealt = vocabulary.select("term", "df").withColumn("letter", F.substring("term", 1, 2))
    sizes = dealt.groupBy("df", "letter").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy(F.desc("df"), "letter")) - F.col("n")).drop("n")
    inner = F.row_number().over(Window.partitionBy("df", "letter").orderBy("term"))
    return dealt.join(before, ["df", "letter"]).select("term", (F.col("before") + inner - 1).cast("int").alias("index"))


def keywords(docs: DataFrame, k: int = 10, text: str = "text", idf: DataFrame | None = None, vectorizer: TfIdf | None = None) -> DataFrame:
    """doc_id, rank, word, weight of the ``k`` terms of the largest tf times idf; the corpus' own idf unless one is given."""
    v = vectorizer or TfIdf(norm="none")
    idf = v.vocabulary(docs, text) if idf is None else idf
    scored = v.counted(docs, text).join(idf.select("term", "idf"), "term").select("doc_id", F.col("term").alias("word"), (F.col("tf") * F.col("idf")).alias("weight"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("weight"), "word")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


#: Vectorizers by name.
VECTORIZERS: dict[str, Callable[..., TfIdf]] = {"tfidf": TfIdf}


def create_vectorizer(kind: str, **params) -> TfIdf:
    if kind not in VECTORIZERS:
        raise ValueError(f"unknown vectorizer {kind}")
    kinds = {"min_df": float, "max_df": float, "max_features": int, "smooth": float}
    return VECTORIZERS[kind](**{k: kinds[k](v) if k in kinds else v for k, v in params.items()})


def save_vectorizer(vectorizer: TfIdf, vocabulary: DataFrame, path: str) -> None:
    """Parameters and vocabulary below ``path``; the tokenizer is code and is not saved."""
    params = {k: v for k, v in vars(vectorizer).items() if k != "tokenizer"}
    vocabulary.write.parquet(f"{path}/vocabulary")
    vocabulary.sparkSession.createDataFrame([(json.dumps(params),)], "value string").coalesce(1).write.text(f"{path}/parameters")


def load_vectorizer(spark: SparkSession, path: str, tokenizer: Callable[[Column], Column] = plain_tokens) -> tuple[TfIdf, DataFrame]:
    """What ``save_vectorizer`` wrote."""
    params = json.loads(spark.read.text(f"{path}/parameters").first()[0])
    return TfIdf(**{**params, "stop_words": tuple(params["stop_words"])}, tokenizer=tokenizer), spark.read.parquet(f"{path}/vocabulary")


def load_stop_words(spark: SparkSession, path: str) -> tuple[str, ...]:
    """One word a line; empty lines and those that begin with # are left out."""
    rows = spark.read.text(path).select(F.trim("value").alias("w")).filter("w <> '' and w not like '#%'").distinct().collect()
    return tuple(sorted(r.w for r in rows))
