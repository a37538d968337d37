"""A graph over the star schema's tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import inverse_name, is_symmetric, triple_id
from ..operators.graph import Graph

#: id, name, type of the relations.
RELATIONS = (("located_in", "位于", "LOCATED_IN"), ("belongs_to", "属于", "BELONGS_TO"), ("created_by", "创建", "CREATED_BY"), ("has_property", "具有特性", "HAS_PROPERTY"), ("related_to", "相关", "RELATED_TO"))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream. It may be one file or a folder of files: a glob takes either, where a plain path has to be a folder."""
    return spark.readStream.schema(_read(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _id(letter: str, key: str) -> F.Column:
    return F.concat(F.lit(f"{letter}:"), F.col(key).cast("string"))


def _entities(df: DataFrame, id_, name, kind: str, **properties: str) -> DataFrame:
    props = F.create_map(*[x for k, c in properties.items() for x in (F.lit(k), F.col(c).cast("string"))]) if properties else F.create_map()
    return df.select(id_.alias("id"), name.alias("name"), F.lit(kind).alias("type"), props.cast("map<string,string>").alias("properties"))


def _keyed(df: DataFrame, key: str, prefix: str, wanted: str | None) -> DataFrame:
    """Rows whose key after ``prefix`` may be the ``wanted`` text, by a filter that reaches the Parquet scan; all of them for none."""
    if wanted is None:
        return df
    return df.filter(F.col(key) == F.lit(wanted[len(prefix) :]).try_cast(df.schema[key].dataType) if wanted.startswith(prefix) else F.lit(False))


def entities(spark: SparkSession, sf_dir: str, id_: str | None = None, name: str | None = None) -> DataFrame:
    """All entities; or, where an id or a name is given, at least those that have it: an id's letter says in which table its key is."""
    keys = {"region": ("r_regionkey", "r:"), "nation": ("n_nationkey", "n:"), "supplier": ("s_suppkey", "s:"), "customer": ("c_custkey", "c:"), "orders": ("o_orderkey", "o:")}
    part = _read(spark, sf_dir, "part")
    known = {n: _keyed(_read(spark, sf_dir, n), *k, id_) for n, k in keys.items()}
    known |= {"part": _keyed(part, "p_partkey", "p:", id_), "brand": _keyed(part, "p_brand", "b:", id_), "orders": _keyed(known["orders"], "o_orderkey", "order ", name)}
    read = known.__getitem__
    out = _entities(read("region"), _id("r", "r_regionkey"), F.col("r_name"), "LOCATION")
    for more in (
        _entities(read("nation"), _id("n", "n_nationkey"), F.col("n_name"), "LOCATION", region="n_regionkey"),
        _entities(read("supplier"), _id("s", "s_suppkey"), F.col("s_name"), "ORGANIZATION", nation="s_nationkey"),
        _entities(read("customer"), _id("c", "c_custkey"), F.col("c_name"), "PERSON", segment="c_mktsegment", nation="c_nationkey"),
        _entities(read("part"), _id("p", "p_partkey"), F.col("p_name"), "PRODUCT", brand="p_brand", type="p_type", size="p_size"),
        _entities(read("orders"), _id("o", "o_orderkey"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), "EVENT", status="o_orderstatus", priority="o_orderpriority"),
        _entities(read("brand").select("p_brand").distinct(), _id("b", "p_brand"), F.col("p_brand"), "CONCEPT"),
    ):
        out = out.unionByName(more)
    return out


def _triples(df: DataFrame, s, relation: str, o, confidence) -> DataFrame:
    r = F.lit(relation)
    return df.select(triple_id(s, r, o).alias("id"), s.alias("subject_id"), r.alias("relation_id"), o.alias("object_id"), confidence.cast("double").alias("confidence"), F.create_map().cast("map<string,string>").alias("properties"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda n: _read(spark, sf_dir, n)
    one = F.lit(1.0)
    pairs = read("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    after = read("supplier").select("s_suppkey", F.lead("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("next")).filter("next is not null")
    status = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "P", 0.5).otherwise(0.3)
    out = _triples(read("nation"), _id("n", "n_nationkey"), "located_in", _id("r", "n_regionkey"), one)
    for more in (
        _triples(read("supplier"), _id("s", "s_suppkey"), "located_in", _id("n", "s_nationkey"), one),
        _triples(read("customer"), _id("c", "c_custkey"), "located_in", _id("n", "c_nationkey"), one),
        _triples(read("orders"), _id("o", "o_orderkey"), "belongs_to", _id("c", "o_custkey"), status),
        _triples(pairs, _id("p", "l_partkey"), "created_by", _id("s", "l_suppkey"), F.least(F.lit(1.0), F.col("n") / F.lit(5.0))),
        _triples(read("part"), _id("p", "p_partkey"), "has_property", _id("b", "p_brand"), F.lit(0.9)),
        _triples(after, _id("s", "s_suppkey"), "related_to", _id("s", "next"), F.lit(0.4)),
    ):
        out = out.unionByName(more)
    return out


def star_graph(spark: SparkSession, sf_dir: str, id_: str | None = None, name: str | None = None) -> Graph:
    """The graph; for the look-up of one entity by id or name, with at least the entities that have it."""
    rows = spark.createDataFrame(list(RELATIONS), "id string, name string, type string")
    relations = rows.select("id", "name", "type", inverse_name(F.col("type")).alias("inverse_name"), is_symmetric(F.col("type")).alias("symmetric"), F.create_map().cast("map<string,string>").alias("properties"))
    return Graph(entities(spark, sf_dir, id_, name), relations, triples(spark, sf_dir), "star")


#: CTEs e, r, t. Properties are columns of e.
SQL = """
e as (
  select 'r:' || r_regionkey as id, r_name as name, 'LOCATION' as type, null::varchar as region, null::varchar as nation, null::varchar as segment, null::varchar as brand, null::varchar as ptype, null::varchar as size, null::varchar as status, null::varchar as priority from region
  union all select 'n:' || n_nationkey, n_name, 'LOCATION', n_regionkey::varchar, null, null, null, null, null, null, null from nation
  union all select 's:' || s_suppkey, s_name, 'ORGANIZATION', null, s_nationkey::varchar, null, null, null, null, null, null from supplier
  union all select 'c:' || c_custkey, c_name, 'PERSON', null, c_nationkey::varchar, c_mktsegment, null, null, null, null, null from customer
  union all select 'p:' || p_partkey, p_name, 'PRODUCT', null, null, null, p_brand, p_type, p_size::varchar, null, null from part
  union all select 'o:' || o_orderkey, 'order ' || o_orderkey, 'EVENT', null, null, null, null, null, null, o_orderstatus, o_orderpriority from orders
  union all select distinct 'b:' || p_brand, p_brand, 'CONCEPT', null, null, null, null, null, null, null, null from part),
r as (select * from (values ('located_in', '位于', 'LOCATED_IN', '位置包含', false), ('belongs_to', '属于', 'BELONGS_TO', '拥有', false), ('created_by', '创建', 'CREATED_BY', '创建了', false),
  ('has_property', '具有特性', 'HAS_PROPERTY', '是...的属性', false), ('related_to', '相关', 'RELATED_TO', '相关', true)) v(id, name, type, inverse_name, is_symmetric)),
t0 as (
  select 'n:' || n_nationkey as subject_id, 'located_in' as relation_id, 'r:' || n_regionkey as object_id, 1.0::double as confidence from nation
  union all select 's:' || s_suppkey, 'located_in', 'n:' || s_nationkey, 1.0::double from supplier
  union all select 'c:' || c_custkey, 'located_in', 'n:' || c_nationkey, 1.0::double from customer
  union all select 'o:' || o_orderkey, 'belongs_to', 'c:' || o_custkey, (case o_orderstatus when 'F' then 1.0 when 'P' then 0.5 else 0.3 end)::double from orders
  union all select 'p:' || l_partkey, 'created_by', 's:' || l_suppkey, least(1.0::double, count(*) / 5.0::double) from lineitem group by l_partkey, l_suppkey
  union all select 'p:' || p_partkey, 'has_property', 'b:' || p_brand, 0.9::double from part
  union all select 's:' || s_suppkey, 'related_to', 's:' || next, 0.4::double from (select s_suppkey, lead(s_suppkey) over (partition by s_nationkey order by s_suppkey) as next from supplier) where next is not null),
t as (select subject_id || '_' || relation_id || '_' || object_id as id, * from t0)
"""


def sql(rest: str, recursive: bool = False) -> str:
    """A query over e, r and t; ``rest`` is more CTEs and the select."""
    return f"with {'recursive ' if recursive else ''}{SQL.strip()}{rest}"
