"""Graphs as JSON, CSV and N-Triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import inverse_name, is_symmetric, triple_id
from ..operators.graph import Graph

DOCUMENT = (
    "name string, entities array<struct<id string, name string, type string, properties map<string,string>>>, "
    "relations array<struct<id string, name string, type string, inverseName string, symmetric boolean, properties map<string,string>>>, "
    "triples array<struct<subject string, relation string, object string, confidence double, properties map<string,string>>>"
)
CONTEXT = '{"@context": {"id": "@id", "type": "@type", "name": "http://schema.org/name", "subject": "http://www.w3.org/1999/02/22-rdf-syntax-ns#subject", "relation": "http://www.w3.org/1999/02/22-rdf-syntax-ns#predicate", "object": "http://www.w3.org/1999/02/22-rdf-syntax-ns#object"}}'
_NONE = "map<string,string>"


def json_rows(graph: Graph) -> DataFrame:
    """kind and one JSON object for each entity, relation and triple; everything is escaped. Confidence has three places."""
    e = graph.entities.select(F.lit("entity").alias("kind"), F.to_json(F.struct("id", "name", "type", "properties")).alias("json"))
    r = graph.relations.select(F.lit("relation").alias("kind"), F.to_json(F.struct("id", "name", "type", F.col("inverse_name").alias("inverseName"), "symmetric", "properties")).alias("json"))
    t = graph.triples.select(F.lit("triple").alias("kind"), F.to_json(F.struct(F.col("subject_id").alias("subject"), F.col("relation_id").alias("relation"), F.col("object_id").alias("object"), F.round("confidence", 3).alias("confidence"), "properties")).alias("json"))
    return e.unionByName(r).unionByName(t)


def write_json(graph: Graph, path: str) -> None:
    """Folders of JSON lines for the three tables, and the context. Nothing is gathered in one place."""
    for kind in ("entity", "relation", "triple"):
        json_rows(graph).filter(F.col("kind") == kind).select("json").write.text(f"{path}/{kind}")
    graph.entities.sparkSession.createDataFrame([(CONTEXT,)], "value string").coalesce(1).write.text(f"{path}/context")


def from_tables(spark: SparkSession, entities: DataFrame, relations: DataFrame, triples: DataFrame, name: str = "graph") -> Graph:
    """A graph of rows as JSON has them: triples whose ends are missing are left out."""
    none = F.create_map().cast(_NONE)
    e = entities.select("id", "name", F.coalesce("type", F.lit("UNKNOWN")).alias("type"), F.coalesce("properties", none).alias("properties"))
    r = relations.select("id", "name", F.coalesce("type", F.lit("UNKNOWN")).alias("type"), F.coalesce("inverseName", inverse_name(F.col("type"))).alias("inverse_name"), F.coalesce("symmetric", is_symmetric(F.col("type"))).alias("symmetric"), F.coalesce("properties", none).alias("properties"))
    t = triples.select(triple_id(F.col("subject"), F.col("relation"), F.col("object")).alias("id"), F.col("subject").alias("subject_id"), F.col("relation").alias("relation_id"), F.col("object").alias("object_id"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("properties", none).alias("properties"))
    return Graph.empty(spark, name).add_entities(e).add_relations(r).add_triples(t)


def read_json(spark: SparkSession, path: str) -> Graph:
    """What ``write_json`` wrote."""
    schemas = {"entity": "id string, name string, type string, properties map<string,string>", "relation": "id string, name string, type string, inverseName string, symmetric boolean, properties map<string,string>", "triple": "subject string, relation string, object string, confidence double, properties map<string,string>"}
    return from_tables(spark, *(spark.read.schema(s).json(f"{path}/{k}") for k, s in schemas.items()))


def read_document(spark: SparkSession, path: str) -> Graph:
    """A graph that one JSON document holds, with entities, relations and triples as arrays."""
    doc = spark.read.schema(DOCUMENT).option("multiLine", "true").json(path)
    return from_tables(spark, doc.select(F.inline("entities")), doc.select(F.inline("relations")), doc.select(F.inline("triples")))


def write_csv(graph: Graph, path: str) -> None:
    for name in ("entities", "relations", "triples"):
        df = getattr(graph, name)
        df.withColumn("properties", F.to_json("properties")).write.option("header", "true").option("escape", '"').csv(f"{path}/{name}")


def read_csv(spark: SparkSession, path: str) -> Graph:
    from .. import schema

    out = []
    for name, s in (("entities", schema.ENTITIES), ("relations", schema.RELATIONS), ("triples", schema.TRIPLES)):
        df = spark.read.option("header", "true").option("escape", '"').schema(s.replace("properties map<string,string>", "properties string")).csv(f"{path}/{name}")
        out.append(df.withColumn("properties", F.from_json("properties", _NONE)))
    return Graph(*out)


_IRI = r"<urn:graph:([^>]*)>"


def ntriples(graph: Graph) -> DataFrame:
    """One N-Triples line for each name, type and triple."""
    iri = lambda c: F.concat(F.lit("<urn:graph:"), F.url_encode(c), F.lit(">"))
    lit = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    line = lambda s, p, o: F.concat(s, F.lit(" "), p, F.lit(" "), o, F.lit(" ."))
    rows = [graph.triples.select(line(iri(F.col("subject_id")), iri(F.col("relation_id")), iri(F.col("object_id"))).alias("value"))]
    for kind, df in (("entity", graph.entities), ("relation", graph.relations)):
        for column in ("name", "type"):
            rows.append(df.select(line(iri(F.col("id")), F.lit(f"<urn:{kind}:{column}>"), lit(F.col(column))).alias("value")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def from_ntriples(lines: DataFrame) -> Graph:
    """The graph of N-Triples lines (value)."""
    spark, none = lines.sparkSession, F.create_map().cast(_NONE)
    un = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    out = {}
    for kind in ("entity", "relation"):
        pattern = rf'^{_IRI} <urn:{kind}:(name|type)> "(.*)" \.$'
        parts = lines.filter(F.col("value").rlike(pattern)).select(F.url_decode(F.regexp_extract("value", pattern, 1)).alias("id"), F.regexp_extract("value", pattern, 2).alias("k"), un(F.regexp_extract("value", pattern, 3)).alias("v"))
        out[kind] = parts.groupBy("id").agg(F.max(F.when(F.col("k") == "name", F.col("v"))).alias("name"), F.max(F.when(F.col("k") == "type", F.col("v"))).alias("type"))
    pattern = rf"^{_IRI} {_IRI} {_IRI} \.$"
    t = lines.filter(F.col("value").rlike(pattern)).select(*[F.url_decode(F.regexp_extract("value", pattern, i)).alias(n) for i, n in ((1, "subject"), (2, "relation"), (3, "object"))])
    e = out["entity"].withColumn("properties", none)
    r = out["relation"].withColumn("inverseName", F.lit(None).cast("string")).withColumn("symmetric", F.lit(None).cast("boolean")).withColumn("properties", none)
    return from_tables(spark, e, r, t.withColumn("confidence", F.lit(1.0)).withColumn("properties", none))
