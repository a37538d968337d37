"""SQL over a graph's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import Graph


def register(graph: Graph, prefix: str = "") -> None:
    """Temporary views of the graph's tables."""
    for name in ("entities", "relations", "triples"):
        getattr(graph, name).createOrReplaceTempView(prefix + name)


def execute(graph: Graph, query: str, params: dict | None = None) -> DataFrame:
    """A query with named parameters (``:name``), which are values and never text of the query."""
    register(graph)
    return graph.entities.sparkSession.sql(query, args=params or {})


def as_json(df: DataFrame) -> DataFrame:
    """Each row as a JSON object of strings."""
    return df.select(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in df.columns])).alias("json"))
