"""The property graph: three tables, look-ups, changes, merging, subgraphs and paths.

Nothing is indexed. Look-ups are filters that reach the Parquet scan; what must refer to something else is checked by joins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.names import triple_id
from .scratch import cut, dealt, few


@dataclass(frozen=True)
class Graph:
    entities: DataFrame
    relations: DataFrame
    triples: DataFrame
    name: str = "graph"
    description: str = ""

    @staticmethod
    def empty(spark: SparkSession, name: str = "graph") -> Graph:
        return Graph(spark.createDataFrame([], schema.ENTITIES), spark.createDataFrame([], schema.RELATIONS), spark.createDataFrame([], schema.TRIPLES), name)

    def cached(self) -> Graph:
        """The same graph, kept by the executors in memory or on their disks after its first use; what is lost is computed again."""
        return replace(self, entities=self.entities.cache(), relations=self.relations.cache(), triples=self.triples.cache())

    def clear(self) -> Graph:
        return Graph.empty(self.entities.sparkSession, self.name)

    # Look-ups

    def entity(self, id_: str) -> DataFrame:
        return self.entities.filter(F.col("id") == id_)

    def relation(self, id_: str) -> DataFrame:
        return self.relations.filter(F.col("id") == id_)

    def triple(self, id_: str) -> DataFrame:
        return self.triples.filter(F.col("id") == id_)

    def entities_by(self, name: str | None = None, type: str | None = None) -> DataFrame:
        return _equal(self.entities, name=name, type=type)

    def relations_by(self, name: str | None = None, type: str | None = None) -> DataFrame:
        return _equal(self.relations, name=name, type=type)

    def triples_by(self, subject: str | None = None, relation: str | None = None, object: str | None = None) -> DataFrame:
        return _equal(self.triples, subject_id=subject, relation_id=relation, object_id=object)

    def query_entities(self, name: str = "", type: str = "UNKNOWN", properties: dict | None = None, limit: int = 0) -> DataFrame:
        return _queried(self.entities, name, type, properties, limit)

    def query_relations(self, name: str = "", type: str = "UNKNOWN", properties: dict | None = None, limit: int = 0) -> DataFrame:
        return _queried(self.relations, name, type, properties, limit)

    def query_triples(self, subject: str = "", relation: str = "", object: str = "", properties: dict | None = None, min_confidence: float = 0.0, limit: int = 0) -> DataFrame:
        out = _equal(self.triples, subject_id=subject or None, relation_id=relation or None, object_id=object or None)
        if min_confidence > 0:
            out = out.filter(F.col("confidence") >= min_confidence)
        out = has_properties(out, properties)
        return out.orderBy("id").limit(limit) if limit else out

    def counts(self) -> DataFrame:
        one = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        return one(self.entities, "entity").union(one(self.relations, "relation")).union(one(self.triples, "triple"))

    def described(self) -> DataFrame:
        """Triples with the names and types of what they connect. Relations are a small table, which is broadcast."""
        return describe(self.triples, self.entities, self.relations)

    # Changes; each gives a new graph

    def add_entities(self, new: DataFrame) -> Graph:
        return replace(self, entities=_inserted(self.entities, new))

    def add_relations(self, new: DataFrame) -> Graph:
        return replace(self, relations=_inserted(self.relations, new))

    def add_triples(self, new: DataFrame) -> Graph:
        """New triples whose ends and relation exist, and whose id is not there yet."""
        made = new.withColumn("id", triple_id(F.col("subject_id"), F.col("relation_id"), F.col("object_id")))
        return replace(self, triples=_inserted(self.triples, valid_triples(made, self.entities, self.relations)))

    def remove_entities(self, ids: DataFrame) -> Graph:
        """Entities go, and so do triples from or to them. The ids are written first; where they are few nothing else moves."""
        gone = few(ids.select("id"), "gone")
        triples = _without(_without(self.triples, "subject_id", gone), "object_id", gone)
        return replace(self, entities=_without(self.entities, "id", gone), triples=triples)

    def remove_relations(self, ids: DataFrame) -> Graph:
        """Relations go, and so do triples of them. They are kinds, so a small table, which is broadcast."""
        gone = F.broadcast(ids.select("id").distinct())
        return replace(self, relations=_without(self.relations, "id", gone), triples=_without(self.triples, "relation_id", gone))

    def remove_triples(self, ids: DataFrame) -> Graph:
        return replace(self, triples=not_among(self.triples, "id", ids))

    # Sets

    def merge(self, other: Graph, wins: Callable[[str, str], Column] | None = None) -> tuple[Graph, DataFrame]:
        """The union by id, where this graph's rows win, and the numbers of added entities and triples.

        ``wins(new, old)`` takes the two prefixes of a clashing triple's columns, as in ``F.col(f"{new}.confidence")``, and says when the new
        one replaces the old one; a replaced triple counts as added. The other graph's triples are dealt out by their id once, over more
        tasks the more there are, and only ids and what ``wins`` compares of this graph's go to them.
        """
        entities = not_among(_named(other.entities), "id", self.entities)
        relations = not_among(_named(other.relations), "id", self.relations)
        all_entities, all_relations = self.entities.unionByName(entities), self.relations.unionByName(relations)
        names, kinds = (mine.select("id").union(theirs.filter(_HAS_ID).select("id")) for mine, theirs in ((self.entities, other.entities), (self.relations, other.relations)))
        incoming = valid_triples(one_of_each(dealt(other.triples, "id")), names, kinds, other.triples)
        kept, added = self.triples, not_among(incoming, "id", self.triples)
        if wins is not None:
            added = incoming.alias("new").join(self.triples.alias("old"), F.col("new.id") == F.col("old.id"), "left").filter(F.col("old.id").isNull() | wins("new", "old")).select("new.*")
            kept = not_among(self.triples, "id", added)
        counts = entities.agg(F.count("*").alias("added_entities")).crossJoin(added.agg(F.count("*").alias("added_triples")))  # one row each
        return replace(self, entities=all_entities, relations=all_relations, triples=kept.unionByName(added)), counts

    def subgraph(self, ids: DataFrame, connected: bool = False) -> Graph:
        """The named entities that exist, with their neighbours if ``connected``; triples within; relations those triples use."""
        chosen = among(self.entities.select("id"), "id", ids)
        if connected:
            out = among(self.triples, "subject_id", chosen).select(F.col("object_id").alias("id"))
            back = among(self.triples, "object_id", chosen).select(F.col("subject_id").alias("id"))
            chosen = among(self.entities.select("id"), "id", chosen.union(out).union(back))
        entities = among(self.entities, "id", chosen)
        triples = among(among(self.triples, "subject_id", chosen), "object_id", chosen)
        relations = among(self.relations, "id", triples, "relation_id")
        return Graph(entities, relations, triples, f"{self.name}_subgraph")

    def expanded(self) -> DataFrame:
        """Triples and, for symmetric relations, the opposite ones."""
        flipped = of_relations(self.triples, self.relations.filter("symmetric"))
        back = flipped.select(triple_id(F.col("object_id"), F.col("relation_id"), F.col("subject_id")).alias("id"), F.col("object_id").alias("subject_id"), "relation_id", F.col("subject_id").alias("object_id"), "confidence", "properties")
        return self.triples.unionByName(not_among(back, "id", self.triples))

    def degrees(self) -> DataFrame:
        ends = self.triples.select(F.explode(F.array(F.struct(F.col("subject_id").alias("id"), F.lit(1).alias("o")), F.struct(F.col("object_id").alias("id"), F.lit(0).alias("o")))).alias("e")).select("e.*")
        return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum(1 - F.col("o")).alias("in_degree"), F.count("*").alias("degree"))


def among(df: DataFrame, column: str, keys: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose column is one of the keys. An inner join with distinct keys: a semi join would be pushed into each branch of a
    union, and several of them in a row multiply the plan."""
    k = keys.select(F.col(key).alias("_key")).distinct()
    return df.join(k, df[column] == k["_key"]).drop("_key")


def not_among(df: DataFrame, column: str, keys: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose column is none of the keys; null is none."""
    return _without(df, column, keys.select(key).distinct(), key)


def _without(df: DataFrame, column: str, keys: DataFrame, key: str = "id") -> DataFrame:
    """``not_among`` for keys that are distinct."""
    k = keys.select(F.col(key).alias("_key"))
    return df.join(k, df[column] == k["_key"], "left").filter("_key is null").drop("_key")


def of_relations(triples: DataFrame, relations: DataFrame) -> DataFrame:
    """Triples of one of the relations. Those are kinds, so a small table, which is broadcast: dealt out by their relation, all
    triples would go to as many tasks as there are relations."""
    k = F.broadcast(relations.select(F.col("id").alias("_key")).distinct())
    return triples.join(k, triples["relation_id"] == k["_key"]).drop("_key")


def _equal(df: DataFrame, **wanted) -> DataFrame:
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def has_properties(df: DataFrame, properties: dict | None) -> DataFrame:
    """Rows that have all the properties, with these values."""
    for k, v in (properties or {}).items():
        df = df.filter(F.try_element_at("properties", F.lit(k)) == v)
    return df


def divided(pairs: DataFrame, properties: dict) -> DataFrame:
    """ids of (id, key, value) rows that have every one of the properties: relational division."""
    wanted = None
    for k, v in properties.items():
        one = (F.col("key") == k) & (F.col("value") == v)
        wanted = one if wanted is None else wanted | one
    return pairs.filter(wanted).groupBy("id").agg(F.countDistinct("key").alias("n")).filter(F.col("n") >= len(properties)).select("id")


def property_rows(df: DataFrame) -> DataFrame:
    """(id, key, value) rows of a table's properties."""
    return df.select("id", F.explode("properties").alias("key", "value"))


def property_map(pairs: DataFrame) -> DataFrame:
    """id and properties of (id, key, value) rows; the inverse of ``property_rows``."""
    return pairs.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct("key", "value")))).alias("properties"))


def _queried(df: DataFrame, name: str, type: str, properties: dict | None, limit: int) -> DataFrame:
    if name:
        df = df.filter(F.col("name").contains(name))
    if type != "UNKNOWN":
        df = df.filter(F.col("type") == type)
    df = has_properties(df, properties)
    return df.orderBy("id").limit(limit) if limit else df


def canonical(df: DataFrame, column: str) -> Column:
    """A column as something that can be compared: maps as sorted entries."""
    c = F.col(column)
    return F.to_json(F.sort_array(F.map_entries(c))) if dict(df.dtypes)[column].startswith("map") else c


def one_of_each(df: DataFrame, key: str = "id") -> DataFrame:
    """One row of each key, that which sorts first by its columns in order (nulls first), so always the same one."""
    rest = [c for c in df.columns if c != key]
    order = F.struct(*[canonical(df, c) for c in rest])
    # the key itself is kept, so the rows are known to be dealt out by it
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("row")).select(*[key if c == key else f"row.{c}" for c in df.columns])


_HAS_ID = "id is not null and id <> ''"


def _named(df: DataFrame) -> DataFrame:
    """Rows with an id, one of each."""
    return one_of_each(df.filter(_HAS_ID))


def _inserted(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(not_among(_named(new), "id", old), allowMissingColumns=True)


def valid_triples(triples: DataFrame, entities: DataFrame, relations: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """Triples whose subject, object and relation exist.

    Ends that are no entity are looked for first, and written: a task sends an end once, however many triples have it, and where
    they are few the triples themselves do not move. ``within``: triples that have all ends of these and are cheaper to go through.
    """
    ends = (triples if within is None else within).select(F.explode(F.array("subject_id", "object_id")).alias("id")).distinct()
    unknown = few(not_among(ends, "id", entities), "unknown")
    held = of_relations(triples, relations).filter("subject_id is not null and object_id is not null")
    return _without(_without(held, "subject_id", unknown), "object_id", unknown)


def describe(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    s = entities.select(F.col("id").alias("subject_id"), F.col("name").alias("subject"), F.col("type").alias("subject_type"))
    o = entities.select(F.col("id").alias("object_id"), F.col("name").alias("object"), F.col("type").alias("object_type"))
    r = relations.select(F.col("id").alias("relation_id"), F.col("name").alias("relation"), F.col("type").alias("relation_type"))
    return triples.join(F.broadcast(r), "relation_id").join(s, "subject_id").join(o, "object_id")


def _hops(triples: DataFrame) -> DataFrame:
    """Each triple in both directions."""
    out = F.struct(F.col("subject_id").alias("u"), F.col("object_id").alias("v"))
    back = F.struct(F.col("object_id").alias("u"), F.col("subject_id").alias("v"))
    return triples.filter("subject_id <> object_id").select("id", F.explode(F.array(out, back)).alias("h")).select("id", "h.u", "h.v")


def paths(triples: DataFrame, pairs: DataFrame, depth: int = 3) -> DataFrame:
    """(query_id, source, target, length, nodes, steps) of all simple paths of at most ``depth`` triples, in either direction of them.

    Walks start at both ends and meet in the middle: half of the hops before the middle triple go from the source, the others from
    the target, so up to a depth of 3 either end takes one hop only. Of the triples, only those that lie between an end of a walk
    from a source and one from a target are joined with walks at all, from whichever side fewer walks stand at, so an entity
    with many triples is never expanded into all its walks. The walks and those triples are written to the shared folder once. A
    pair of an entity with itself has no path; nulls meet nothing.
    """
    hops, key = _hops(triples), ["query_id", "source", "target"]
    ends = F.array(F.struct(F.lit(True).alias("ahead"), F.col("source").alias("at")), F.struct(F.lit(False).alias("ahead"), F.col("target").alias("at")))
    level = pairs.filter("source <> target").select(*key, F.explode(ends).alias("e")).select(*key, "e.*", F.lit(0).alias("n"), F.array("e.at").alias("nodes"), F.array().cast("array<string>").alias("steps"))
    walks = level
    for n in range(1, depth // 2 + 1):
        moving = level if n <= (depth - 1) // 2 else level.filter("ahead")
        free = ~F.array_contains("nodes", F.col("v")) & (F.col("v") != F.when(F.col("ahead"), F.col("target")).otherwise(F.col("source")))
        moved = moving.join(hops, moving["at"] == hops["u"]).filter(free)
        level = moved.select(*key, "ahead", F.col("v").alias("at"), F.lit(n).alias("n"), F.concat("nodes", F.array("v")).alias("nodes"), F.concat("steps", F.array("id")).alias("steps"))
        walks = walks.unionByName(level)
    walks = cut(walks, "walks")
    side = lambda ahead, at, p: walks.filter("ahead" if ahead else "not ahead").select(*key, F.col("at").alias(at), F.col("n").alias(f"{p}_n"), F.col("nodes").alias(f"{p}_nodes"), F.col("steps").alias(f"{p}_steps"))
    there, back = side(True, "u", "a"), side(False, "v", "b")
    stand = lambda some, at: some.groupBy(at).agg(F.count("*").alias(f"n_{at}"))
    middle = cut(hops.join(stand(there, "u"), "u").join(stand(back, "v"), "v"), "middle")
    fits = (F.col("a_n") - F.col("b_n")).isin(0, 1) & (F.col("a_n") + F.col("b_n") < depth) & ~F.arrays_overlap("a_nodes", "b_nodes")
    met = middle.filter("n_u <= n_v").join(there, "u").join(back, [*key, "v"]).unionByName(middle.filter("n_u > n_v").join(back, "v").join(there, [*key, "u"]))
    return met.filter(fits).select(
        *key,
        (F.col("a_n") + F.col("b_n") + 1).alias("length"),
        F.concat("a_nodes", F.reverse("b_nodes")).alias("nodes"),
        F.concat("a_steps", F.array("id"), F.reverse("b_steps")).alias("steps"),
    )


def shortest(found: DataFrame) -> DataFrame:
    """The shortest of ``paths`` for each query and pair; of equal ones the first by its steps."""
    best = found.groupBy("query_id", "source", "target").agg(F.min(F.struct("length", "steps", "nodes")).alias("p"))
    return best.select("query_id", "source", "target", "p.*")


def path_items(found: DataFrame) -> DataFrame:
    """A row for each triple of each path: query_id, path_index, path_length, step, triple_id, relevance (1 / length)."""
    by_path = Window.partitionBy("query_id").orderBy("length", "steps")
    numbered = found.withColumn("path_index", F.row_number().over(by_path) - 1)
    return numbered.select("query_id", "path_index", F.col("length").alias("path_length"), F.posexplode("steps").alias("step", "triple_id"), (1 / F.col("length")).alias("relevance"))
