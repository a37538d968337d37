"""Search of the graph for parsed questions. All questions are answered by one plan; each type has its branch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import Graph, describe, path_items, paths
from .questions import normalised
from .scratch import cut, few


def by_entity(graph: Graph, wanted: DataFrame) -> DataFrame:
    """Triples that start or end at an entity, for (query_id, entity_id, others); a triple from an entity to itself is found twice."""
    t = graph.triples
    out, back = wanted.join(t, wanted["entity_id"] == t["subject_id"]), wanted.join(t, wanted["entity_id"] == t["object_id"])
    return describe(out.unionByName(back), graph.entities, graph.relations)


def by_relation(graph: Graph, wanted: DataFrame) -> DataFrame:
    """Triples of a relation, for (query_id, relation_id, others)."""
    found = wanted.withColumnRenamed("relation_id", "wanted_relation").join(graph.triples, F.col("wanted_relation") == F.col("relation_id"))
    return describe(found.drop("wanted_relation"), graph.entities, graph.relations)


def relevance(subject: Column, obj: Column, relation: Column, entities: Column, relations: Column, attributes: Column) -> Column:
    """0.4 if the subject is asked for, 0.3 each for object and relation, 0.2 if the relation's name holds an attribute; 1 at most."""
    score = F.when(F.array_contains(entities, subject), 0.4).otherwise(0.0) + F.when(F.array_contains(entities, obj), 0.3).otherwise(0.0) + F.when(F.array_contains(relations, relation), 0.3).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), score + F.when(F.exists(attributes, lambda a: (a != "") & F.contains(relation, a)), 0.2).otherwise(0.0)), 6)


def _hits(rows: DataFrame, way: str, relevance: Column | None = None) -> DataFrame:
    """Triples found for questions, not yet described: by which way, and for paths how relevant and where."""
    none = lambda kind: F.lit(None).cast(kind)
    of_path = (relevance.cast("double"), F.col("path_index"), F.col("path_length")) if relevance is not None else (none("double"), none("int"), none("int"))
    return rows.select("query_id", F.lit(way).alias("way"), "id", "subject_id", "relation_id", "object_id", "confidence", of_path[0].alias("given"), of_path[1].alias("path_index"), of_path[2].alias("path_length"))


_TRIPLE = ("id", "subject_id", "relation_id", "object_id", "confidence")


def _named_relations(graph: Graph, q: DataFrame) -> DataFrame:
    """query_id and relation_id of the relations that questions name."""
    said = q.select("query_id", F.explode("relations").alias("relation_name"))
    kinds = graph.relations.select(F.col("id").alias("relation_id"), normalised(F.col("name")).alias("relation_name"))
    return said.join(kinds, "relation_name").select("query_id", "relation_id")


def _near(graph: Graph, entities: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """by, key and the triple, for triples at the entities (entity_id) and of the relations (relation_id): once for each end that is
    asked for, so one from an entity to itself is there twice. All triples are gone through once; what is found is written."""
    asked = entities.select(F.lit("entity").alias("by"), F.col("entity_id").alias("key"))
    ends = [("entity", "subject_id"), ("entity", "object_id")]
    if relations is not None:
        asked, ends = asked.union(relations.select(F.lit("relation"), "relation_id")), [*ends, ("relation", "relation_id")]
    each = graph.triples.select(*_TRIPLE, F.explode(F.array(*[F.struct(F.lit(by).alias("by"), F.col(c).alias("key")) for by, c in ends])).alias("e")).select(*_TRIPLE, "e.*")
    return cut(each.join(few(asked, "asked"), ["by", "key"]), "near")


def _around(near: DataFrame, wanted: DataFrame, way: str) -> DataFrame:
    """Triples at the entities of (query_id, entity_id); one from an entity to itself is found twice."""
    return _hits(wanted.select("query_id", "entity_id").join(near.filter("by = 'entity'").withColumnRenamed("key", "entity_id"), "entity_id"), way)


def _of_first(near: DataFrame, q: DataFrame, links: DataFrame) -> DataFrame:
    first = links.filter("nth = 0").select("query_id", "entity_id")
    return _around(near, q.filter("type in ('ENTITY', 'ATTRIBUTE', 'LIST', 'FACT', 'DEFINITION')").select("query_id").join(first, "query_id"), "first")


def _of_all(near: DataFrame, q: DataFrame, links: DataFrame, named: DataFrame) -> DataFrame:
    """Triples around every entity that a question names, and of every relation that it names. Duplicates stay."""
    around = _around(near, q.select("query_id").join(links.select("query_id", "entity_id"), "query_id"), "any")
    of_relation = near.filter("by = 'relation'").drop("relation_id").withColumnRenamed("key", "relation_id")
    return around.unionByName(_hits(named.join(of_relation, "relation_id"), "any"))


def _reached(graph: Graph, near: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """The triples that a path of at most ``depth`` between two ends can have: either end of each is at most half as many hops from
    one of them. They are written."""
    both = lambda rows: rows.select(F.explode(F.array("subject_id", "object_id")).alias("at"))
    at = few(pairs.select(F.explode(F.array("source", "target")).alias("at")), "ends")
    for n in range(depth // 2):
        seen = near.filter("by = 'entity'").withColumnRenamed("key", "at").join(at, "at") if n == 0 else _touching(graph, at)
        at = few(both(seen).union(at.select("at")), "reached")
    s, o = at.select(F.col("at").alias("subject_id")), at.select(F.col("at").alias("object_id"))
    return cut(graph.triples.select(*_TRIPLE).join(s, "subject_id").join(o, "object_id").select(*_TRIPLE), "between")


def _touching(graph: Graph, at: DataFrame) -> DataFrame:
    ends = graph.triples.select("subject_id", "object_id", F.explode(F.array("subject_id", "object_id")).alias("at"))
    return ends.join(at, "at")


def _between(graph: Graph, near: DataFrame, q: DataFrame, links: DataFrame, depth: int) -> DataFrame:
    """The triples of all simple paths between the first two entities of questions (query_id, most: triples of a path at most);
    each triple of a path of n has relevance 1/n."""
    a = links.filter("nth = 0").select("query_id", F.col("entity_id").alias("source"))
    b = links.filter("nth = 1").select("query_id", F.col("entity_id").alias("target"))
    pairs = cut(q.select("query_id", "most").join(a, "query_id").join(b, "query_id"), "pairs")
    triples = _reached(graph, near, pairs, depth)
    found = paths(triples, pairs, depth).join(q.select("query_id", "most").distinct(), "query_id").filter("length <= most").drop("most")
    items = path_items(found).withColumnRenamed("triple_id", "id")
    return _hits(items.join(triples, "id"), "path", F.col("relevance"))


def _judged(graph: Graph, hits: DataFrame, q: DataFrame, links: DataFrame) -> DataFrame:
    """Results from hits: all are described at once, then kept and scored by their question's type and the way they were found."""
    second = links.filter("nth = 1").select("query_id", F.col("entity_id").alias("other_id"))
    asked = q.select("query_id", "type", "entities", "relations", "attributes", "params").join(second, "query_id", "left")
    hits = cut(hits, "hits")
    # entities are gone through once, for the names of those that were found
    ends = few(hits.select(F.explode(F.array("subject_id", "object_id")).alias("id")), "ends")
    named = cut(graph.entities.select("id", "name", "type").join(ends, "id"), "named")
    d = describe(hits, named, graph.relations).join(asked, "query_id")
    holds = F.exists("attributes", lambda a: (a != "") & F.contains(F.col("relation"), a)) | (F.col("relation_type") == "HAS_PROPERTY")
    listed = F.contains(F.col("relation"), F.coalesce(F.try_element_at("params", F.lit("list_type")), F.lit("")))
    kept = F.when(F.col("type") == "ATTRIBUTE", holds).when(F.col("type") == "LIST", listed).when(F.col("type") == "FACT", F.col("object_id") == F.col("other_id")).otherwise(F.lit(True))
    score = relevance(normalised(F.col("subject")), normalised(F.col("object")), normalised(F.col("relation")), F.col("entities"), F.col("relations"), F.col("attributes"))
    by_type = F.when(F.col("type").isin("ATTRIBUTE", "LIST"), 0.9).otherwise(1.0)
    rel = F.when(F.col("way") == "path", F.col("given")).when(F.col("way") == "first", by_type).otherwise(score).cast("double")
    items = d.filter((F.col("way") != "first") | kept)
    return items.select("query_id", F.col("id").alias("triple_id"), "subject", "relation", "object", "relation_type", "confidence", rel.alias("relevance"), "path_index", "path_length")


_OPEN = "type in ('COMPARISON', 'OPEN', 'UNKNOWN')"


def exact(graph: Graph, parsed: DataFrame, links: DataFrame) -> DataFrame:
    """Results of every question by its type. ``links`` has the entities of ``questions.link_entities`` that exist."""
    links, named = cut(links, "links"), cut(_named_relations(graph, parsed.filter(_OPEN)), "relations")
    near = _near(graph, links, named)
    related = parsed.filter("type = 'RELATION'").select("query_id", F.lit(2).alias("most"))
    hits = _of_first(near, parsed, links).unionByName(_between(graph, near, related, links, 2)).unionByName(_of_all(near, parsed.filter(_OPEN), links, named))
    return _judged(graph, hits, parsed, links)


def related_items(graph: Graph, q: DataFrame, links: DataFrame, depth: int) -> DataFrame:
    """The triples of all simple paths between the first two entities of questions; each triple of a path of n has relevance 1/n."""
    links = cut(links, "links")
    return _judged(graph, _between(graph, _near(graph, links), q.select("query_id", F.lit(depth).alias("most")), links, depth), q, links)


def generic(graph: Graph, q: DataFrame, links: DataFrame) -> DataFrame:
    """Triples around every entity that a question names, and of every relation that it names, by relevance. Duplicates stay."""
    links, named = cut(links, "links"), cut(_named_relations(graph, q), "relations")
    return _judged(graph, _of_all(_near(graph, links, named), q, links, named), q, links)


def ranked(items: DataFrame, min_confidence: float = 0.0, offset: int = 0, limit: int = 10) -> DataFrame:
    """Results of at least the confidence, sorted by relevance, then cut once: rank counts from 1 after the offset."""
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "path_index", "triple_id")
    kept = items.filter(F.col("confidence") >= min_confidence).withColumn("rank", F.row_number().over(order) - offset)
    kept = kept.filter(F.col("rank") >= 1)
    return kept.filter(F.col("rank") <= limit) if limit else kept


def route(kind: Column, n_entities: Column, strategy: str = "HYBRID") -> Column:
    """What a strategy does with a question: PATH_FINDING, SEMANTIC or EXACT_MATCH. A path needs two entities."""
    pathy = kind.isin("RELATION", "COMPARISON") & (n_entities >= 2)
    if strategy == "PATH_FINDING":
        return F.when(pathy, "PATH_FINDING").otherwise("EXACT_MATCH")
    if strategy == "HYBRID":
        return F.when(pathy, "PATH_FINDING").when(kind.isin("DEFINITION", "OPEN"), "SEMANTIC").otherwise("EXACT_MATCH")
    return F.lit(strategy)


def search(graph: Graph, parsed: DataFrame, links: DataFrame, strategy: str = "HYBRID", min_confidence: float = 0.0, offset: int = 0, limit: int = 10, depth: int = 3) -> DataFrame:
    """Ranked results of all questions, each by the way its type and the strategy say. Triples are gone through twice (once more for
    each two hops that ``depth`` has beyond 3), entities once; results are written to the shared folder, so they can be read often."""
    known = cut(links.filter("confidence > 0"), "links")
    routed = parsed.withColumn("way", route(F.col("type"), F.size("entities"), strategy))
    straight, depths = routed.filter("way <> 'PATH_FINDING'"), F.when(F.col("way") == "PATH_FINDING", depth).when(F.col("type") == "RELATION", 2)
    between, open_ = routed.withColumn("most", depths).filter("most is not null"), straight.filter(_OPEN)
    named = cut(_named_relations(graph, open_), "relations")
    near = _near(graph, known, named)
    hits = _of_first(near, straight, known).unionByName(_between(graph, near, between, known, max(depth, 2))).unionByName(_of_all(near, open_, known, named))
    return cut(ranked(_judged(graph, hits, parsed, known), min_confidence, offset, limit), "found")
