"""Vectors of texts by sparse signed random projection, and search for similar ones by random hyperplanes with exact cosines."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, digest, norm
from .graph import Graph, describe
from .scratch import FEW_ROWS, cut
from .tfidf import TfIdf

#: Numbers of a vector, and places of it that a term adds to.
SIZE, PLACES = 384, 4


def term_places(size: int = SIZE, places: int = PLACES) -> Column:
    """The places of a vector, counted from 1, that column ``term`` adds to, negative where it is taken away: by the MD5 of the term and
    the place's number."""
    hashed = lambda i: F.conv(F.substring(F.md5(F.concat_ws("#", "term", i.cast("string"))), 1, 8), 16, 10).cast("long")
    place = lambda h: (F.pmod(F.shiftright(h, 1), F.lit(size)).cast("int") + 1) * (1 - 2 * (h % 2)).cast("int")
    return F.transform(F.transform(F.sequence(F.lit(0), F.lit(places - 1)), hashed), place)


def projected(weights: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id and the sum, of ``size`` numbers, of what its (doc_id, weight, places) rows add. Rows that are dealt out by doc_id stay so."""
    each = weights.select("doc_id", "weight", F.explode("places").alias("at"))
    sums = each.groupBy("doc_id", (F.abs("at") - 1).alias("place")).agg(F.sum(F.col("weight") * F.signum("at")).alias("w"))
    own = sums.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "w"))).alias("own"))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    before = lambda j: F.when(j == 0, -1).otherwise(F.get("own", j - 1)["place"])
    filled = F.flatten(F.transform("own", lambda e, j: F.concat(zeros((e["place"] - before(j) - 1).cast("int")), F.array(e["w"]))))
    return own.select("doc_id", F.concat(filled, zeros(F.lit(size - 1) - F.element_at("own", -1)["place"])).alias("sum"))


def _common(idf: DataFrame) -> DataFrame:
    """The terms of the smallest idf, as many as are broadcast: few terms are most of what texts hold."""
    n = idf.count()
    if n <= FEW_ROWS:
        return idf
    return idf.filter(F.col("idf") < idf.approxQuantile("idf", [FEW_ROWS / n], 0.001)[0])


def text_vectors(docs: DataFrame, idf: DataFrame | None = None, size: int = SIZE, places: int = PLACES, vectorizer: TfIdf | None = None) -> DataFrame:
    """id and vector of all ``docs`` (doc_id, text): the projection of tf times idf, of length 1, or zeros for a text without known
    terms.

    ``idf`` (term, idf) is the vocabulary of the corpus unless given; it is written. Rows of one doc_id are one document; those without
    an id have none. Frequent terms meet their idf by a broadcast and are summed where their document is, so that only rare ones
    move, to their idf and back.
    """
    v, docs = vectorizer or TfIdf(norm="none"), docs.select("doc_id", "text").filter("doc_id is not null")
    idf = cut((v.vocabulary(docs) if idf is None else idf).select("term", "idf"), "idf")
    common = _common(idf)
    found = v.counted(docs).join(F.broadcast(common.withColumn("places", term_places(size, places))), "term", "left")
    weight = (F.col("tf") * F.col("idf")).alias("weight")
    often = projected(found.filter("idf is not null").select("doc_id", weight, "places"), size)
    rest = found.filter("idf is null").select("doc_id", "term", "tf").join(idf, "term").select("doc_id", weight, "term")
    seldom = projected(rest.repartition("doc_id").select("doc_id", "weight", term_places(size, places).alias("places")), size)
    zeros = F.array_repeat(F.lit(0.0), size)
    both = docs.select("doc_id").distinct().join(often, "doc_id", "left").join(seldom.withColumnRenamed("sum", "more"), "doc_id", "left")
    both = both.select("doc_id", F.zip_with(F.coalesce("sum", zeros), F.coalesce("more", zeros), lambda a, b: a + b).alias("v"))
    sized = both.withColumn("n", norm(F.col("v")))
    return sized.select(F.col("doc_id").alias("id"), F.when(F.col("n") > 0, F.transform("v", lambda x: x / F.col("n"))).otherwise(zeros).alias("vector"))


@dataclass(frozen=True)
class Planes:
    """Random hyperplanes: in each of ``tables`` tables a vector's code says on which side of ``bits`` planes it lies."""

    size: int = SIZE
    tables: int = 24
    bits: int = 9
    seed: int = 11

    def codes(self, vector: Column, near: bool = False) -> Column:
        """A vector's code in each table, the table's number in front; with ``near`` also those that differ in one bit. Zero,
        null and not finite vectors have none."""
        planes = np.random.default_rng(self.seed).standard_normal((self.tables * self.bits, self.size))
        weight, flips = 1 << np.arange(self.bits), np.array([0, *(1 << np.arange(self.bits))] if near else [0])
        first = np.arange(self.tables) << self.bits

        @F.pandas_udf("array<int>")
        def coded(vectors: pd.Series) -> pd.Series:
            out = []
            for lo in range(0, len(vectors), 1024):
                some = vectors.iloc[lo : lo + 1024]
                fit = [v is not None and len(v) == self.size and bool(np.isfinite(np.asarray(v, float)).all()) and bool(np.any(v)) for v in some]
                rows = np.array([np.asarray(v, float) for v, ok in zip(some, fit) if ok]).reshape(-1, self.size)
                bits = (rows @ planes.T > 0).reshape(-1, self.tables, self.bits)
                codes = ((bits @ weight)[:, :, None] ^ flips[None, None, :]) + first[None, :, None]
                found = iter(codes.reshape(len(rows), self.tables * len(flips)).astype(np.int32))
                out += [next(found) if ok else [] for ok in fit]
            return pd.Series(out, index=vectors.index)

        return coded(vector)


class Index:
    """An inverted index of vectors by their codes: tables ``codes`` (code, id), partitioned by code, and ``vectors`` (id, vector,
    digest) below a path. Of equal vectors only that of the smallest id has codes; ``same`` (first, id) has the first ids of each."""

    def __init__(self, spark: SparkSession, path: str, planes: Planes, parts: int = 32, copies: int = 100):
        self.spark, self.path, self.planes, self.parts, self.copies = spark, path, planes, parts, copies

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}")

    def build(self, vectors: DataFrame) -> Index:
        """Index ``vectors`` (id, vector). Rows without an id, and zero and null vectors, are left out and never found. Of equal
        vectors ``copies`` are kept, those of the smallest ids: a search for more results has to set more."""
        rows = vectors.select("id", "vector").filter(F.col("id").isNotNull() & (norm(F.col("vector")) > 0))
        rows.withColumn("digest", digest(F.col("vector"))).write.parquet(f"{self.path}/vectors")
        order = Window.partitionBy("digest").orderBy("id")
        kept = self._read("vectors").select("id", "digest").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= self.copies)
        kept.withColumn("first", F.min("id").over(Window.partitionBy("digest"))).write.parquet(f"{self.path}/same")
        coded = self._firsts(self._read("vectors").select("id", "digest", self.planes.codes(F.col("vector")).alias("codes"))).select("id", F.explode("codes").alias("code"))
        dealt = coded.withColumn("part", F.pmod(F.hash("code"), F.lit(self.parts)).cast("int"))
        dealt.hint("rebalance", "part").write.partitionBy("part").parquet(f"{self.path}/codes")
        return self

    def _firsts(self, rows: DataFrame) -> DataFrame:
        """Of rows (id, digest, ...) of ``vectors`` those that stand for their equal ones."""
        return rows.join(self._read("same").filter("nth = 1").select("id", "digest"), ["id", "digest"], "left_semi")

    def candidates(self, queries: DataFrame) -> DataFrame:
        """query_id and id of the vectors that share a code with a query, or a code but for one bit, in some table."""
        asked = queries.select("query_id", F.explode(self.planes.codes(F.col("vector"), near=True)).alias("code"))
        asked = asked.withColumn("part", F.pmod(F.hash("code"), F.lit(self.parts)).cast("int"))
        return asked.join(self._read("codes"), ["part", "code"]).select("query_id", "id").distinct()

    def search(self, queries: DataFrame, k: int = 10, least: float = 0.0) -> DataFrame:
        """query_id, id, similarity (cosine, 9 digits) and rank of the ``k`` most similar vectors of at least that cosine to each of
        ``queries`` (query_id, vector); of equal ones the smaller ids. Cosines are exact, candidates are those of ``candidates``."""
        if k > self.copies:
            raise ValueError(f"the index keeps {self.copies} equal vectors")
        near = self._firsts(self.candidates(queries).join(self._read("vectors"), "id")).dropDuplicates(["query_id", "id", "digest"]).join(queries.select("query_id", F.col("vector").alias("q")), "query_id")
        scored = near.select("query_id", F.col("id").alias("first"), F.round(cosine(F.col("q"), F.col("vector")), 9).alias("similarity")).filter(F.col("similarity") >= least)
        order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "first")
        best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")
        every = best.join(self._read("same").select("first", "id"), "first")
        last = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
        return every.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", "id", "similarity", "rank")


def entity_texts(graph: Graph) -> DataFrame:
    """doc_id and text of entities: the name, then the values of the properties, by key."""
    values = F.transform(F.array_sort(F.map_entries("properties")), lambda e: e["value"])
    return graph.entities.select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.col("name"), values).alias("text"))


def semantic_search(graph: Graph, questions: DataFrame, path: str, k: int = 10, least: float = 0.3, size: int = SIZE) -> DataFrame:
    """Triples at the entities whose vectors are most like those of ``questions`` (query_id, text): the question's words are weighed
    as those of entities are. relevance is the entity's similarity; entity_id says which one it was. The index is written to ``path``."""
    texts = entity_texts(graph)
    idf = TfIdf(norm="none").vocabulary(texts)
    index = Index(graph.entities.sparkSession, path, Planes(size)).build(text_vectors(texts, idf, size))
    asked = text_vectors(questions.select(F.col("query_id").alias("doc_id"), "text"), idf, size).select(F.col("id").alias("query_id"), "vector")
    found = index.search(asked, k, least).select("query_id", F.col("id").alias("entity_id"), F.col("similarity").alias("relevance"))
    ends = graph.triples.select("id", "subject_id", "relation_id", "object_id", "confidence", F.explode(F.array_distinct(F.array("subject_id", "object_id"))).alias("entity_id"))
    return describe(found.join(ends, "entity_id"), graph.entities, graph.relations)
