import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions.vectors import cosine
from graphloom.operators import similar

V = "id long, vector array<double>"


def by_rows(queries, vectors, k, least=None):
    """Each pair by itself, in SQL functions."""
    pairs = vectors.crossJoin(queries.select("query_id", F.col("vector").alias("q"))).filter("id <> query_id")
    pairs = pairs.select("query_id", "id", F.round(cosine(F.col("q"), F.col("vector")), 9).alias("similarity"))
    pairs = pairs if least is None else pairs.filter(F.col("similarity") >= least)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return sorted(map(str, pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).collect()))


def test_products_give_what_pairs_give(spark, monkeypatch):
    draw = random.Random(3)
    rows = [(i, [draw.choice((-1.0, 0.0, 0.5, 2.0)) for _ in range(4)] if i % 3 else [draw.gauss(0, 1) for _ in range(4)]) for i in range(300)]
    rows += [(300 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(40)] + [(400, None), (401, [1.0]), (402, [float("nan")] * 4), (403, [None, 1.0, 1.0, 1.0]), (404, [1e200] * 4), (405, [0.0] * 4), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows, V).cache()
    asked = df.filter("id % 10 = 0 or id > 399").withColumnRenamed("id", "query_id")
    monkeypatch.setattr(similar, "ROWS", 64)
    for least in (None, 0.9):
        assert sorted(map(str, similar.top_similar(asked, df, 5, least).collect())) == by_rows(asked, df, 5, least)
    monkeypatch.setattr(similar, "BROADCAST_BYTES", 400)
    assert sorted(map(str, similar.top_similar(asked, df, 5).collect())) == by_rows(asked, df, 5)


def test_pairs_are_not_made_as_rows(spark):
    draw = random.Random(4)
    df = spark.createDataFrame([(i, [draw.gauss(0, 1) for _ in range(8)]) for i in range(400)], V)
    found = similar.top_similar(df.withColumnRenamed("id", "query_id"), df, 3)
    assert "MapInPandas" in found._jdf.queryExecution().toString() and found.count() == 1200
