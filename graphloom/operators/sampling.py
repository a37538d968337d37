"""Sampling of the next token from tables of candidates: top-k, top-p and temperature as windows, draws by hashed uniforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Below this temperature the most probable token is always taken.
COLD = 1e-5


def uniform(*parts: Column | str) -> Column:
    """A number from 0 to 1 (not included) that looks random and depends on nothing but the parts: 32 bits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("#", *parts)), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def kept(candidates: DataFrame, top_k: int = 40, top_p: float = 0.9, temperature: float = 1.0) -> DataFrame:
    """id, token, rank and weight of the candidates (id, token, p) that can be drawn.

    The ``top_k`` most probable ones (0: all) of each id are taken, equal ones by token, and of these the first whose p sum up to
    ``top_p`` (outside of 0 to 1: all). Then each p is raised to 1 / temperature and the sum made 1; at a temperature of 1 p stays
    as it is, and what is lacking to 1 belongs to the first. Near 0 only the first is left. Candidates with null or without
    probability are left out, and so are those of null ids.
    """
    order = Window.partitionBy("id").orderBy(F.desc("p"), "token")
    rows = candidates.select("id", "token", F.col("p").cast("double").alias("p")).filter("id is not null and token is not null and p > 0")
    rows = rows.withColumn("rank", F.row_number().over(order))
    most = 1 if temperature < COLD else top_k
    rows = rows.filter(F.col("rank") <= most) if most > 0 else rows
    if 0 < top_p < 1:
        before = F.coalesce(F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        rows = rows.withColumn("before", before).filter(F.col("before") < top_p).drop("before")
    if temperature < COLD:
        return rows.select("id", "token", "rank", F.lit(1.0).alias("weight"))
    if temperature == 1.0:
        return rows.select("id", "token", "rank", F.col("p").alias("weight"))
    heated = rows.withColumn("w", F.exp(F.log("p") / temperature))
    return heated.select("id", "token", "rank", (F.col("w") / F.sum("w").over(Window.partitionBy("id"))).alias("weight"))


def sampled(candidates: DataFrame, draws: DataFrame, seed: str = "", **options) -> DataFrame:
    """id, draw and token: for each of ``draws`` (id, draw) the first kept candidate at which the sum of weights is above the
    draw's uniform number, or the first of all if none is. Draws of ids without candidates have no token and are left out.

    Candidates of an id are joined as one array, bounded by ``top_k``; without it, by the vocabulary.
    """
    some = kept(candidates, **options)
    upto = F.sum("weight").over(Window.partitionBy("id").orderBy("rank"))
    ladder = some.withColumn("upto", upto).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "upto", "token"))).alias("ladder"))
    r = uniform(F.col("id").cast("string"), F.col("draw").cast("string"), F.lit(seed))
    drawn = draws.select("id", "draw").join(ladder, "id").withColumn("r", r)
    hit = F.filter("ladder", lambda x: F.col("r") < x["upto"])
    return drawn.select("id", "draw", F.coalesce(F.get(hit, F.lit(0)), F.get("ladder", F.lit(0)))["token"].alias("token"))
