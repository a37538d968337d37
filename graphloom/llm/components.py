"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut, drop_cut

#: Up to so many edges are joined by one task, in memory; of more, by rounds over the cluster.
ONE_TASK = 1 << 18


def _both(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x")).select("x.u", "x.v")


def _large_star(e: DataFrame) -> DataFrame:
    """Every neighbour larger than u is tied to the smallest of u and its neighbours."""
    n = _both(e)
    low = n.groupBy("u").agg(F.min("v").alias("m"))
    return n.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.least("m", "u").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every neighbour smaller than u, and u, are tied to the smallest of them."""
    n = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = n.groupBy("u").agg(F.min("v").alias("m"))
    tied = n.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return tied.union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()


def _mark(e: DataFrame):
    r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r.n, r.s


def _joined(batches):
    """Union by the smaller node, with shortened ways."""
    up, schema = {}, None

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    if schema is not None:
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, schema.types[0]), pa.array([top(x) for x in nodes], schema.types[0])], names=["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b", one_task: int | None = None) -> DataFrame:
    """(node, root): the smallest node that is reachable, for each node with an edge to another one.

    Nulls and edges from a node to itself are ignored; repeated edges and either direction count once. Empty in, empty out.
    Up to ``one_task`` edges (``ONE_TASK`` unless given) are joined by one task in Python; 0 keeps all in SQL functions. Of more, each round writes its edges to the shared folder, so the plan stays
    short and survives lost executors; the number of rounds grows with the logarithm of the largest component.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a is not null and b is not null and a <> b").distinct()
    e = cut(e, "edges")
    mark = _mark(e)
    if mark[0] <= (ONE_TASK if one_task is None else one_task):
        kind = e.schema["a"].dataType.simpleString()
        roots = cut(e.coalesce(1).mapInArrow(_joined, f"node {kind}, root {kind}"), "roots")
        drop_cut(e)
        return roots
    while mark[0]:
        new = cut(_small_star(_large_star(e)), "edges")
        drop_cut(e)
        e, old, mark = new, mark, _mark(new)
        if mark == old:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b"), F.col("b")).distinct())
