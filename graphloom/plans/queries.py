"""The stated queries of the library's own operators, each with the same query in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chunks, metadata, names, text, tokens, vectors
from ..functions.names import triple_id
from ..operators import answers, caches, dialogue, extraction, preprocess, questions, search, similar, store, tfidf
from ..operators import graph as g
from ..sources import graphs
from ..sources import sql as gsql
from ..streaming import ingest
from .star import _read, _stream, sql, star_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            SQL[f.__name__] = oracle
        return f

    return add


def _stored(spark, d) -> g.Graph:
    """The graph as searches meet it: made once, then read many times in a query."""
    return star_graph(spark, d).cached()


TRIPLE = "id, subject_id, relation_id, object_id, confidence"
_T = ["id", "subject_id", "relation_id", "object_id", "confidence"]


# Graph: look-ups


@query(sql("select 'entity' as kind, count(*) as n from e union all select 'relation', count(*) from r union all select 'triple', count(*) from t"))
def kg_counts(spark, d):
    return star_graph(spark, d).counts()


@query(sql("select id, name, type from e where name = 'small ring'"))
def kg_entity_by_name(spark, d):
    return star_graph(spark, d, name="small ring").entities_by(name="small ring").select("id", "name", "type")


@query(sql("select id, name from e where type = 'ORGANIZATION'"))
def kg_entity_by_type(spark, d):
    return star_graph(spark, d).entities_by(type="ORGANIZATION").select("id", "name")


@query(sql("select id, name, type, region, nation from e where id = 'n:3'"))
def kg_entity_by_id(spark, d):
    p = lambda k: F.try_element_at("properties", F.lit(k)).alias(k)
    return star_graph(spark, d, id_="n:3").entity("n:3").select("id", "name", "type", p("region"), p("nation"))


@query(sql(f"select {TRIPLE} from t where subject_id = 'p:7'"))
def kg_triples_by_subject(spark, d):
    return star_graph(spark, d).triples_by(subject="p:7").select(*_T)


@query(sql(f"select {TRIPLE} from t where object_id = 's:5'"))
def kg_triples_by_object(spark, d):
    return star_graph(spark, d).triples_by(object="s:5").select(*_T)


@query(sql(f"select {TRIPLE} from t where relation_id = 'related_to'"))
def kg_triples_by_relation(spark, d):
    return star_graph(spark, d).triples_by(relation="related_to").select(*_T)


@query(sql(f"select 'sr' as kind, {TRIPLE} from t where subject_id = 's:2' and relation_id = 'located_in' union all select 'ro', {TRIPLE} from t where relation_id = 'located_in' and object_id = 'n:4' union all select 'so', {TRIPLE} from t where subject_id = 'n:4' and object_id = 'r:4'"))
def kg_pair_lookup(spark, d):
    k = star_graph(spark, d)
    one = lambda kind, **w: k.triples_by(**w).select(F.lit(kind).alias("kind"), *_T)
    return one("sr", subject="s:2", relation="located_in").union(one("ro", relation="located_in", object="n:4")).union(one("so", subject="n:4", object="r:4"))


@query(sql("select id, name from e where contains(name, 'Supplier#') and type = 'ORGANIZATION' and nation = '7'"))
def kg_query_entities(spark, d):
    return star_graph(spark, d).query_entities("Supplier#", "ORGANIZATION", {"nation": "7"}).select("id", "name")


@query(sql("select id, name, inverse_name, is_symmetric as \"symmetric\" from r where contains(name, '相') or type = 'LOCATED_IN'"))
def kg_query_relations(spark, d):
    k = star_graph(spark, d)
    found = k.query_relations("相").unionByName(k.query_relations(type="LOCATED_IN"))
    return found.select("id", "name", "inverse_name", "symmetric")


@query(sql(f"select {TRIPLE} from t where relation_id = 'created_by' and confidence >= 0.4 order by id limit 50"))
def kg_query_triples_filtered(spark, d):
    return star_graph(spark, d).query_triples(relation="created_by", min_confidence=0.4, limit=50).select(*_T)


@query(sql(", kv as (select id, 'brand' as key, brand as value from e where brand is not null union all select id, 'type', ptype from e where ptype is not null) select id from kv where (key = 'brand' and value = 'Brand#2') or (key = 'type' and value = 'ECONOMY') group by id having count(distinct key) >= 2"))
def kg_property_division(spark, d):
    return g.divided(g.property_rows(star_graph(spark, d).entities), {"brand": "Brand#2", "type": "ECONOMY"})


@query(sql(", kv as (select id, unnest([struct_pack(k := 'region', v := region), struct_pack(k := 'nation', v := nation), struct_pack(k := 'segment', v := segment), struct_pack(k := 'brand', v := brand), struct_pack(k := 'type', v := ptype), struct_pack(k := 'size', v := size), struct_pack(k := 'status', v := status), struct_pack(k := 'priority', v := priority)]) as p from e) select p.k as key, count(*) as n, count(distinct p.v) as n_values from kv where p.v is not null group by p.k"))
def kg_property_rows(spark, d):
    rows = g.property_rows(star_graph(spark, d).entities)
    back = g.property_rows(g.property_map(rows))
    return back.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))


@query(sql(" select t.id, s.name as subject, r.name as relation, o.name as object, s.type as subject_type, o.type as object_type, confidence from t join e s on s.id = subject_id join r on r.id = relation_id join e o on o.id = object_id"))
def kg_triple_denorm(spark, d):
    return star_graph(spark, d).described().select("id", "subject", "relation", "object", "subject_type", "object_type", "confidence")


@query(sql(" select id, 'Entity{id=' || id || ', name=' || name || ', type=' || type || case when region is null then '' else ', properties={region=' || region || '}' end || '}' as shown from e where type = 'LOCATION'"))
def kg_to_string(spark, d):
    e = star_graph(spark, d).entities_by(type="LOCATION")
    return e.select("id", names.entity_string(F.col("id"), F.col("name"), F.col("type"), F.col("properties")).alias("shown"))


def _named(types) -> str:
    return "case n_nationkey " + " ".join(f"when {i} then '{t}'" for i, t in enumerate(types)) + " else 'UNKNOWN' end"


@query(f"with k as (select n_nationkey as code, {_named(names.ENTITY_TYPES)} as name, {_named(names.RELATION_TYPES)} as relation from nation) select code, name, relation = 'RELATED_TO' as symmetric, case relation " + " ".join(f"when '{k}' then '{v}'" for k, v in names.INVERSE_NAMES.items()) + " else '' end as inverse from k")
def kg_type_names(spark, d):
    code = F.col("n_nationkey")
    kind = names.type_name(code, names.RELATION_TYPES)
    return _read(spark, d, "nation").select(code.alias("code"), names.type_name(code, names.ENTITY_TYPES).alias("name"), names.is_symmetric(kind).alias("symmetric"), names.inverse_name(kind).alias("inverse"))


@query(sql(" select a.id, b.id as other from t a join t b on a.subject_id = b.object_id and a.relation_id = b.relation_id and a.object_id = b.subject_id where a.relation_id = 'related_to' union all select id, id from t where relation_id = 'related_to'"))
def kg_same_triples(spark, d):
    """Triples of a symmetric relation, and those of the graph that are the same or their opposites."""
    k = star_graph(spark, d)
    a = k.triples_by(relation="related_to")
    b = g.Graph(k.entities, k.relations, a).expanded()
    return a.alias("a").join(b.alias("b"), names.same_triple(a, b)).select("a.id", F.col("b.id").alias("other"))


# Graph: changes and sets


@query(sql(f", x as (select {TRIPLE} from t union all select 'n:1_located_in_r:99', 'n:1', 'located_in', 'r:99', 1.0::double union all select 'n:1_no_r:1', 'n:1', 'no', 'r:1', 1.0::double) select relation_id, count(*) as n from x where subject_id in (select id from e) and object_id in (select id from e) and relation_id in (select id from r) group by 1"))
def kg_validate(spark, d):
    k = star_graph(spark, d)
    odd = spark.createDataFrame([("n:1", "located_in", "r:99"), ("n:1", "no", "r:1")], "s string, r string, o string")
    odd = odd.select(triple_id(F.col("s"), F.col("r"), F.col("o")).alias("id"), F.col("s").alias("subject_id"), F.col("r").alias("relation_id"), F.col("o").alias("object_id"), F.lit(1.0).alias("confidence"))
    return g.valid_triples(k.triples.select(*_T).unionByName(odd), k.entities, k.relations).groupBy("relation_id").agg(F.count("*").alias("n"))


@query(sql(", x as (select id from e where type = 'ORGANIZATION' and nation = '3') select relation_id, count(*) as n from t where subject_id not in (select id from x) and object_id not in (select id from x) group by 1"))
def kg_cascade_delete(spark, d):
    k = star_graph(spark, d)
    left = k.remove_entities(k.query_entities(type="ORGANIZATION", properties={"nation": "3"}))
    return left.triples.groupBy("relation_id").agg(F.count("*").alias("n"))


@query(sql(", a as (select * from t where relation_id <> 'belongs_to') select relation_id, count(*) as n from (select * from a union all select * from t where id not in (select id from a)) group by 1"))
def kg_merge(spark, d):
    k = star_graph(spark, d)
    part = k.remove_relations(k.relation("belongs_to"))
    return part.merge(k)[0].triples.groupBy("relation_id").agg(F.count("*").alias("n"))


@query(sql(" select 0 as added_entities, (select count(*) from t where relation_id = 'created_by' and confidence < 0.5) as added_triples"))
def kg_merge_conflict(spark, d):
    k = star_graph(spark, d)
    surer = g.Graph(k.entities, k.relations, k.triples.withColumn("confidence", F.when(F.col("relation_id") == "created_by", F.greatest("confidence", F.lit(0.5))).otherwise(F.col("confidence"))))
    return k.merge(surer, lambda new, old: F.col(f"{new}.confidence") > F.col(f"{old}.confidence"))[1]


@query(sql(", x as (select 's:1' as id union select 's:2' union select 's:3'), y as (select id from x union select object_id from t where subject_id in (select id from x) union select subject_id from t where object_id in (select id from x)) select t.id, t.confidence from t join y a on a.id = t.subject_id join y b on b.id = t.object_id"))
def kg_subgraph_1hop(spark, d):
    ids = spark.createDataFrame([("s:1",), ("s:2",), ("s:3",), ("nobody",)], "id string")
    return _stored(spark, d).subgraph(ids, connected=True).triples.select("id", "confidence")


@query(sql(" select relation_id, count(*) as n from (select id, relation_id from t union select object_id || '_' || relation_id || '_' || subject_id, relation_id from t where relation_id = 'related_to') group by 1"))
def kg_symmetric_expand(spark, d):
    return star_graph(spark, d).expanded().groupBy("relation_id").agg(F.count("*").alias("n"))


@query(sql(" select id, sum(o)::bigint as out_degree, sum(1 - o)::bigint as in_degree, count(*) as degree from (select subject_id as id, 1 as o from t union all select object_id, 0 from t) group by id"))
def kg_degree(spark, d):
    return star_graph(spark, d).degrees()


# Graph: search


@query(sql(f", m as (select {TRIPLE} from t where subject_id = 's:4' union all select {TRIPLE} from t where object_id = 's:4') select row_number() over (order by confidence desc, id) as rank, id, confidence from m qualify rank <= 10"))
def kg_entity_search_topk(spark, d):
    wanted = spark.createDataFrame([(1, "s:4")], "query_id long, entity_id string")
    order = Window.partitionBy("query_id").orderBy(F.desc("confidence"), "id")
    found = search.by_entity(star_graph(spark, d), wanted).withColumn("rank", F.row_number().over(order).cast("long"))
    return found.filter("rank <= 10").select("rank", "id", "confidence")


@query(sql(" select t.id, s.name as subject, o.name as object from t join e s on s.id = subject_id join e o on o.id = object_id where relation_id = 'related_to'"))
def kg_relation_search(spark, d):
    wanted = spark.createDataFrame([(1, "related_to")], "query_id long, relation_id string")
    return search.by_relation(star_graph(spark, d), wanted).select("id", "subject", "object")


@query(sql(" select t.id, least(1.0, case when s.name = 'ASIA' or s.name = 'NATION_3' then 0.4 else 0 end + case when o.name = 'ASIA' or o.name = 'NATION_3' then 0.3 else 0 end + case when r.name = '相关' then 0.3 else 0 end + case when contains(r.name, '位') then 0.2 else 0 end)::double as relevance from t join e s on s.id = subject_id join r on r.id = relation_id join e o on o.id = object_id where relation_id in ('located_in', 'related_to')"))
def kg_relevance(spark, d):
    lit = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    found = star_graph(spark, d).described().filter(F.col("relation_id").isin("located_in", "related_to"))
    return found.select("id", search.relevance(F.col("subject"), F.col("object"), F.col("relation"), lit("ASIA", "NATION_3"), lit("相关"), lit("位")).alias("relevance"))


_PATHS = """, h as (select id, subject_id as u, object_id as v from t where subject_id <> object_id union all select id, object_id, subject_id from t where subject_id <> object_id),
p(query_id, target, cur, nodes, steps) as (
  select * from (values (1, 'c:5', 's:3', ['s:3'], []::varchar[]), (2, 's:4', 's:2', ['s:2'], []), (3, 'r:1', 'n:1', ['n:1'], [])) v(a, b, c, f, g)
  union all select query_id, target, h.v, list_append(nodes, h.v), list_append(steps, h.id) from p join h on p.cur = h.u where len(steps) < 3 and cur <> target and not list_contains(nodes, h.v))
"""


def _pairs(spark):
    return spark.createDataFrame([(1, "s:3", "c:5"), (2, "s:2", "s:4"), (3, "n:1", "r:1")], "query_id int, source string, target string")


@query(sql(_PATHS + "select query_id, len(steps)::int as length, array_to_string(nodes, '|') as nodes, array_to_string(steps, '|') as steps from p where cur = target", True))
def kg_paths_le3(spark, d):
    found = g.paths(_stored(spark, d).triples, _pairs(spark), 3)
    return found.select("query_id", "length", F.array_join("nodes", "|").alias("nodes"), F.array_join("steps", "|").alias("steps"))


@query(sql(_PATHS + "select query_id, min(len(steps))::int as length from p where cur = target group by query_id", True))
def kg_shortest_path(spark, d):
    return g.shortest(g.paths(_stored(spark, d).triples, _pairs(spark), 3)).select("query_id", "length")


@query(sql(_PATHS + ", f as (select query_id, steps, row_number() over (partition by query_id order by len(steps), steps) - 1 as path_index from p where cur = target) select query_id, path_index::int as path_index, len(steps)::int as path_length, unnest(steps) as triple_id, 1.0::double / len(steps) as relevance from f", True))
def kg_path_items(spark, d):
    return g.path_items(g.paths(_stored(spark, d).triples, _pairs(spark), 3)).select("query_id", "path_index", "path_length", "triple_id", "relevance")


@query(sql(" select type, count(*) as n from e where type = 'LOCATION' group by type"))
def kg_sql(spark, d):
    return gsql.execute(star_graph(spark, d), "select type, count(*) as n from entities where type = :kind group by type", {"kind": "LOCATION"})


@query(sql(" select '{\"name\":\"' || name || '\",\"type\":\"' || type || '\"}' as json from e where type = 'CONCEPT'"))
def kg_sql_json(spark, d):
    return gsql.as_json(gsql.execute(star_graph(spark, d), "select name, type from entities where type = :kind", {"kind": "CONCEPT"}))


# Documents


def _docs(spark, d):
    return _read(spark, d, "documents").select("doc_id", "text")


def _pages(spark, d):
    return _read(spark, d, "pages").select("page_id", "url", "html")


_ENT = "{}"
for _n, _c in text.ENTITIES:
    _ENT = f"replace({_ENT}, '{_n}', '{_c.replace(chr(39), chr(39) * 2)}')"
_WS = "[ \\t\\n\\x0B\\f\\r]"
_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))"
_CLEAN = _TRIM.format(_ENT.format(f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({{}}, '<[^>]*>', ' ', 'g'), '{_WS}+', ' ', 'g'), '^\\s*(?:Page|Document)\\s+\\d+.*?(?:\\n|\\r\\n?)', ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')"))


@query(f"select page_id, {_CLEAN.format('html')} as clean from pages")
def doc_clean(spark, d):
    return _pages(spark, d).select("page_id", text.Cleaner("reference")(F.col("html")).alias("clean"))


@query(f"select doc_id, lower(regexp_replace({_CLEAN.format('text')}, '[0-9]', '#', 'g')) as clean from documents")
def doc_clean_rules(spark, d):
    cleaner = text.Cleaner("basic").add_regex("[0-9]", "#").add(F.lower)
    return _docs(spark, d).select("doc_id", cleaner(F.col("text")).alias("clean"))


_STRIP = _TRIM.format(_ENT.format(f"regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '{_WS}+', ' ', 'g')"))


@query(f"select page_id, {_STRIP} as text from pages")
def doc_html_strip(spark, d):
    return _pages(spark, d).select("page_id", text.html_text(F.col("html")).alias("text"))


_TYPES = [("a.pdf", "x"), ("b", "%PDF-1.4 x"), ("c", "<!DOCTYPE html><p>"), ("d", "<?xml version"), ("e", '{"a": 1}'), ("f", "a,b,c,d,e,f,g\n1,2,3,4,5,6,7"), ("g", "# head\ntext"), ("h.MD", "x"), ("i", ""), ("j", "plain")]


@query("select page_id, 'HTML' as kind from pages union all select * from (values (-1, 'PDF'), (-2, 'PDF'), (-3, 'HTML'), (-4, 'XML'), (-5, 'JSON'), (-6, 'CSV'), (-7, 'MARKDOWN'), (-8, 'MARKDOWN'), (-9, 'UNKNOWN'), (-10, 'TEXT')) v(a, b)")
def doc_type_detect(spark, d):
    own = spark.createDataFrame([(-i - 1, n, c) for i, (n, c) in enumerate(_TYPES)], "page_id long, url string, html string")
    rows = _pages(spark, d).withColumn("url", F.lit("")).unionByName(own)
    return rows.select("page_id", metadata.document_type(F.col("html"), F.col("url")).alias("kind"))


@query("select doc_id, strlen(text)::bigint as character_count, (length(text) - length(replace(text, chr(10), '')) + 1)::bigint as line_count, len(regexp_extract_all(text, '\\w+'))::bigint as word_count from documents")
def doc_content_metadata(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", metadata.character_count(t).alias("character_count"), metadata.line_count(t).alias("line_count"), metadata.word_count(t).alias("word_count"))


@query("select page_id, nullif(regexp_extract(html, '<title>([^<]+)</title>', 1), '') as title, nullif(regexp_extract(html, '<h1[^>]*>([^<]+)</h1>', 1), '') as h1, len(regexp_extract_all(html, '<meta\\s+(?:name|property)=\"([^\"]+)\"\\s+content=\"([^\"]+)\"')) as n_meta from pages union all select -1, 'T', 'H', 2")
def page_html_metadata(spark, d):
    own = spark.createDataFrame([(-1, "", '<title>T</title><meta name="author" content="A"><meta property="k" content="B"><h1 class="x">H</h1>')], "page_id long, url string, html string")
    m = _pages(spark, d).unionByName(own).select("page_id", metadata.html_metadata(F.col("html")).alias("m"))
    at = lambda k: F.try_element_at("m", F.lit(k)).alias(k)
    return m.select("page_id", at("title"), at("h1"), F.size(F.map_filter("m", lambda k, v: k.startswith("meta_"))).cast("long").alias("n_meta"))


@query("select doc_id as id, case when doc_id % 3 > 0 then coalesce(source, 'none') end as author, case when doc_id % 3 > 1 then 'paper ' || doc_id || ' in ' || coalesce(lang, '?') end as title from documents")
def pdf_metadata(spark, d):
    key = F.col("doc_id")
    title = F.concat(F.lit(" /Title (paper "), key.cast("string"), F.lit(" in "), F.coalesce("lang", F.lit("?")), F.lit(")"))
    author = F.concat(F.lit(" /Author("), F.coalesce("source", F.lit("none")), F.lit(")"))
    content = F.concat(F.lit("%PDF-1.5\n"), F.when(key % 3 > 1, title).otherwise(""), F.when(key % 3 > 0, author).otherwise(""), F.lit("\nendobj"))
    m = _read(spark, d, "documents").select(key.alias("id"), metadata.pdf_metadata(content).alias("m"))
    return m.select("id", F.try_element_at("m", F.lit("author")).alias("author"), F.try_element_at("m", F.lit("title")).alias("title"))


@query("select doc_id, (i - 1)::int as idx, substr(text, (i - 1) * 800 + 1, 1000) as chunk from documents, generate_series(1, greatest(1, ceil(length(text) / 800.0)::bigint)) s(i) where length(text) > 0")
def doc_fixed_chunks(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(chunks.fixed_chunks(F.col("text"))).alias("idx", "chunk"))


_PIECES = f"list_filter(string_split(regexp_replace(text, '([。！？.])({_WS}|$)', '\\1\\2' || chr(1), 'g'), chr(1)), lambda p: p <> '')"


@query(f"select doc_id, generate_subscripts(l, 1)::int - 1 as idx, unnest(l) as piece from (select doc_id, {_PIECES} as l from documents)")
def doc_sentence_pieces(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(chunks.sentence_pieces(F.col("text"))).alias("idx", "piece"))


def _packed(pieces: str, most: int, size: int, joiner: str) -> str:
    extra = len(joiner)
    j = " || ".join(["chr(10)"] * extra) or "''"
    return f"""with recursive s as (select doc_id, generate_subscripts(l, 1) as i, unnest(l) as p from (select doc_id, {pieces} as l from documents)),
w as (select doc_id, i, 0 as chunk, 1 as n, length(p) + {extra} as chars from s where i = 1
  union all select s.doc_id, s.i, case when n >= {most} or chars + length(s.p) > {size} then chunk + 1 else chunk end, case when n >= {most} or chars + length(s.p) > {size} then 1 else n + 1 end,
    case when n >= {most} or chars + length(s.p) > {size} then length(s.p) + {extra} else chars + length(s.p) + {extra} end from w join s on s.doc_id = w.doc_id and s.i = w.i + 1)
select doc_id, chunk as idx, string_agg(p, {j} order by i) as chunk from w join s using (doc_id, i) group by doc_id, w.chunk"""


@query(_packed(_PIECES, 10, 1000, ""))
def doc_sentence_chunks(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(chunks.sentence_chunks(F.col("text"))).alias("idx", "chunk"))


@query(_packed("list_filter(list_transform(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\\n[ \\t\\x0B\\f\\r\\n]*\\n'), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13))), lambda p: p <> '')", 5, 2000, "\n\n"))
def doc_paragraph_chunks(spark, d):
    doubled = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    return _docs(spark, d).select("doc_id", F.posexplode(chunks.paragraph_chunks(doubled)).alias("idx", "chunk"))


@query(r"""with recursive s as (select doc_id, generate_subscripts(l, 1) as i, unnest(l) as p from (select doc_id, list_filter(string_split(regexp_replace(text, '([。！？.!?])', '\1' || chr(1), 'g'), chr(1)), lambda p: p <> '') as l from documents)),
v as (select *, list_distinct(regexp_extract_all(lower(p), '\w+')) as own, lag(list_distinct(regexp_extract_all(lower(p), '\w+')), 1, []::varchar[]) over (partition by doc_id order by i) as last from s),
x as (select doc_id, i, p, len(list_intersect(last, own)) / greatest(len(list_distinct(list_concat(last, own))), 1)::double < 0.1 as apart from v),
w as (select doc_id, i, 0 as chunk, length(p) as chars from x where i = 1
  union all select x.doc_id, x.i, case when apart or chars + length(p) > 1000 then chunk + 1 else chunk end, case when apart or chars + length(p) > 1000 then length(p) else chars + length(p) end from w join x on x.doc_id = w.doc_id and x.i = w.i + 1)
select doc_id, chunk as idx, string_agg(p, '' order by i) as chunk from w join x using (doc_id, i) group by doc_id, w.chunk""")
def doc_semantic_chunks(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(chunks.semantic_chunks(F.col("text"))).alias("idx", "chunk"))


_PARAGRAPHS = "list_filter(list_transform(string_split_regex(text, '\\n[ \\t\\x0B\\f\\r\\n]*\\n'), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13))), lambda p: p <> '')"


@query("select doc_id, (row_number() over (partition by doc_id order by idx, i) - 1)::int as idx, substr(chunk, (i - 1) * 1000 + 1, 1000) as chunk from (" + _packed(_PARAGRAPHS, 5, 1000, "\n\n") + ") c, generate_series(1, ceil(length(chunk) / 1000.0)::bigint) g(i)")
def doc_hybrid_chunks(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(chunks.hybrid_chunks(F.col("text"))).alias("idx", "chunk"))


@query("select doc_id, (i - 1)::int as idx, sha256(doc_id || '#' || (i - 1)) as id, 'src' as source from documents, generate_series(1, ceil(length(text) / 800.0)::bigint) s(i)")
def doc_chunk_metadata(spark, d):
    c = chunks.with_metadata(chunks.fixed_chunks(F.col("text")), F.col("doc_id"), F.create_map(F.lit("source"), F.lit("src")))
    return _docs(spark, d).select("doc_id", F.explode(c).alias("c")).select("doc_id", F.col("c.index").alias("idx"), "c.id", F.col("c.metadata")["source"].alias("source"))


# Tokens and vectors

_MARKS = "[!-/:-@\\[-`{-~]"
_TOK = f"list_filter(list_transform(string_split_regex(lower(text), '{_WS}+'), lambda x: regexp_replace(x, '{_MARKS}', '', 'g')), lambda x: x <> '')"
_SEGMENTS = "regexp_extract_all(t, '[A-Za-z0-9]+|[\\p{L}\\p{N}]+')"


@query(
    f"with c as (select doc_id, {_CLEAN.format('text')} as t from documents), w as (select doc_id, unnest({_SEGMENTS}) as word from c), k as (select doc_id, word, count(*) as n, row_number() over (partition by doc_id order by count(*) desc, word) as place from w group by 1, 2), "
    "j as (select doc_id, string_agg(word, ', ' order by place) as keywords from k where place <= 5 group by 1) "
    f"select doc_id, greatest(1, ceil(length(t) / 800.0))::int as n_chunks, strlen(t)::varchar as character_count, len({_SEGMENTS})::int as n_tokens, j.keywords from c left join j using (doc_id)"
)
def doc_preprocess(spark, d):
    steps = [preprocess.cleaning(), preprocess.splitting, preprocess.extracting_metadata, preprocess.tokenizing(), preprocess.extracting_keywords(stop_words=())]
    found = preprocess.Pipeline(steps)(_docs(spark, d), preprocess.Options(keyword_count=5))
    return found.select("doc_id", F.size("chunks").alias("n_chunks"), F.col("metadata")["character_count"].alias("character_count"), F.size("tokens").alias("n_tokens"), F.col("metadata")["keywords"].alias("keywords"))


_TF = f"tok as (select doc_id, unnest({_TOK}) as term from documents), tf as (select doc_id, term, count(*) as tf from tok group by 1, 2), n as (select count(*) as n from documents), df as (select term, count(*) as df from tf group by 1), idf as (select term, df, ln((n + 1.0::double) / (df + 1.0::double)) + 1 as idf from df, n)"


@query(f"select doc_id, len({_TOK})::int as n_tokens, {_TOK}[1] as first_token from documents")
def doc_tokens(spark, d):
    t = tokens.plain_tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(t).alias("n_tokens"), F.get(t, F.lit(0)).alias("first_token"))


@query(f"select doc_id, len(list_filter({_TOK}, lambda x: x not in ('the', 'of', 'and', 'to', 'in')))::int as n_tokens from documents")
def doc_stopwords(spark, d):
    return _docs(spark, d).select("doc_id", F.size(tokens.drop_stop_words(tokens.plain_tokens(F.col("text")), ("the", "of", "and", "to", "in"))).alias("n_tokens"))


@query(f"with {_TF} select doc_id, term, tf from tf")
def doc_term_freq(spark, d):
    return tfidf.term_frequencies(_docs(spark, d))


@query(f"with {_TF} select term, df, round(idf, 8) as idf from idf")
def doc_df_idf(spark, d):
    return tfidf.TfIdf().vocabulary(_docs(spark, d)).select("term", "df", F.round("idf", 8).alias("idf"))


@query(f"with {_TF}, w as (select doc_id, term, tf * idf as w from tf join idf using (term)) select doc_id, term, round(w / sqrt(sum(w * w) over (partition by doc_id)), 8) as weight from w")
def doc_tfidf_l2(spark, d):
    return tfidf.TfIdf().fit_transform(_docs(spark, d)).select("doc_id", "term", F.round("weight", 8).alias("weight"))


@query(f"with {_TF}, w as (select doc_id, term, idf as w from tf join idf using (term) where df >= 3 and df <= 0.5 * (select n from n)) select doc_id, term, round(w / sum(abs(w)) over (partition by doc_id), 8) as weight from w")
def doc_tfidf_l1(spark, d):
    v = tfidf.create_vectorizer("tfidf", norm="l1", binary=True, min_df="3", max_df="0.5")
    return v.fit_transform(_docs(spark, d)).select("doc_id", "term", F.round("weight", 8).alias("weight"))


@query(f"with {_TF} select term, df, (row_number() over (order by df desc, term) - 1)::int as idx from (select * from df order by df desc, term limit 100)")
def doc_vocab_topk(spark, d):
    v = tfidf.TfIdf(max_features=100).vocabulary(_docs(spark, d))
    return tfidf.feature_names(v).join(v, "term").select("term", "df", F.col("index").alias("idx"))


@query(f"with {_TF} select doc_id, rank, word, round(weight, 8) as weight from (select doc_id, term as word, tf * idf as weight, row_number() over (partition by doc_id order by tf * idf desc, term)::int as rank from tf join idf using (term)) where rank <= 10")
def doc_keywords_topk(spark, d):
    return tfidf.keywords(_docs(spark, d), 10).select("doc_id", "rank", "word", F.round("weight", 8).alias("weight"))


@query("with q as (select vec_id as query_id, embedding as q from embeddings where vec_id % 100 = 0), s as (select query_id, vec_id as id, round(list_cosine_similarity(q::double[], embedding::double[]), 9) as similarity from q, embeddings where vec_id <> query_id) select query_id, id, round(similarity, 6) as similarity, row_number() over (partition by query_id order by similarity desc, id)::int as rank from s qualify rank <= 5")
def emb_cosine_topk(spark, d):
    v = _read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = v.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")
    return similar.top_similar(asked, v, 5).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 6) as size, 1.0::double as unit_size from embeddings")
def emb_unit(spark, d):
    e = _read(spark, d, "embeddings")
    return e.select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("size"), F.round(vectors.norm(vectors.unit(F.col("embedding"))), 6).alias("unit_size"))


@query("select doc_id, len(list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda t: t <> ''))::int as n_tokens, length(array_to_string(list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda t: t <> ''), ' '))::int as n_chars from documents where text is not null")
def doc_model_tokens(spark, d):
    rows = _docs(spark, d).filter("text is not null").select("doc_id", tokens.model_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.char_length(tokens.joined_tokens(F.col("t"))).alias("n_chars"))


@query()
def doc_hashed_embedding(spark, d):
    short = _read(spark, d, "benchmark").select("item_id", tokens.plain_tokens(F.col("text")).alias("t"))
    return short.select("item_id", F.round(vectors.norm(vectors.hashed_embedding(F.col("t"), 64)), 6).alias("size"))


# Extraction

#: A text about each customer, and the same in SQL.
_PARTS = ("'张三就职于'", "{seg}", "'大学，李'", "{seg}", "'出生于中国。第'", "{key}", "'号'", "{seg}", "'集团位于'", "{place}", "'，'", "{year}", "'年'", "{month}", "'月创建'", "{seg}", "'公司。'")
_PART_SQL = {"seg": "lower(c_mktsegment)", "key": "c_custkey::varchar", "place": "case c_nationkey % 3 when 0 then '上海市' when 1 then '美国' else '' end", "year": "(1990 + c_custkey % 30)::varchar", "month": "(1 + c_custkey % 12)::varchar"}
_TEXT_SQL = f"d as (select c_custkey as doc_id, case when c_custkey % 50 = 0 then null when c_custkey % 50 = 1 then '' else {' || '.join(_PARTS).format(**_PART_SQL)} end as text from customer)"
_E_RULES, _R_RULES = extraction.rule_set("chinese_all")


def _rule_sql(rules) -> str:
    pattern = lambda p: p.replace("\\u4e00", "\\x{4e00}").replace("\\u9fa5", "\\x{9fa5}")
    return " union all ".join(f"select doc_id, {i} as seq, '{r.name}' as rule_name, '{r.type}' as type, unnest(regexp_extract_all(text, '{pattern(r.pattern)}')) as text from d" for i, r in enumerate(rules))


def _texts(spark, d):
    key = F.col("c_custkey")
    place = F.when(F.col("c_nationkey") % 3 == 0, "上海市").when(F.col("c_nationkey") % 3 == 1, "美国").otherwise("")
    columns = {"seg": F.lower("c_mktsegment"), "key": key.cast("string"), "place": place, "year": (1990 + key % 30).cast("string"), "month": (1 + key % 12).cast("string")}
    text = F.concat(*[columns[p[1:-1]] if p[0] == "{" else F.lit(p[1:-1]) for p in _PARTS])
    return _read(spark, d, "customer").select(key.alias("doc_id"), F.when(key % 50 == 0, None).when(key % 50 == 1, "").otherwise(text).alias("text"))


def _placed_sql(rules, name: str) -> str:
    """A CTE of mentions with their places, as ``extraction.mentions`` finds them."""
    pattern = lambda p: p.replace("\\u4e00", "\\x{4e00}").replace("\\u9fa5", "\\x{9fa5}")
    found = " union all ".join(f"select doc_id, {i} as seq, '{r.name}' as rule_name, '{r.type}' as type, '{r.label}' as label, regexp_extract_all(text, '{pattern(r.pattern)}') as ts, string_split_regex(text, '{pattern(r.pattern)}') as ps from d" for i, r in enumerate(rules))
    return f"""{name}_all as (select doc_id, seq, rule_name, type, case label when '' then ts[i] else label end as label, ts[i] as text,
  (list_sum(list_transform(ps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(ts[1:i - 1], lambda x: len(x))), 0))::int as position
  from (select *, unnest(range(1, len(ts) + 1)) as i from ({found}))),
{name} as (select * from {name}_all qualify row_number() over (partition by doc_id, label order by seq, position) = 1)"""


@query(f"with {_TEXT_SQL} select * from ({_rule_sql(_E_RULES)}) where text <> ''")
def ext_entities_rules(spark, d):
    return extraction.rule_matches(_texts(spark, d), _E_RULES).drop("label")


@query(f"with {_TEXT_SQL} select doc_id, rule_name, type, text from ({_rule_sql(_R_RULES)})")
def ext_relations_rules(spark, d):
    return extraction.rule_matches(_texts(spark, d), _R_RULES).select("doc_id", "rule_name", "type", "text")


@query(f"with {_TEXT_SQL} select doc_id, text, min(seq) as seq from ({_rule_sql(_E_RULES)}) where text <> '' group by 1, 2")
def ext_entity_dedup(spark, d):
    found = extraction.RuleExtractor().entities(_texts(spark, d))
    return found.select("doc_id", "text", "seq")


_NEAREST = f"""with {_TEXT_SQL}, {_placed_sql(_E_RULES, 'e')}, {_placed_sql(_R_RULES, 'r')},
n as (select r.doc_id, r.label as relation, r.type as relation_type, r.position, max({{'p': e.position, 'label': e.label, 'type': e.type}}) filter (e.position < r.position) as b, min({{'p': e.position, 'label': e.label, 'type': e.type}}) filter (e.position > r.position) as a
  from r left join e on e.doc_id = r.doc_id group by all)"""


@query(f"{_NEAREST} select doc_id, b.label as before, relation, a.label as after from n")
def ext_nearest_association(spark, d):
    rules = extraction.RuleExtractor()
    texts = _texts(spark, d)
    found = extraction.nearest(rules.relations(texts), rules.entities(texts))
    return found.select("doc_id", F.col("before.label").alias("before"), F.col("relation.label").alias("relation"), F.col("after.label").alias("after"))


@query(f"with {_TEXT_SQL}, {_placed_sql(_E_RULES, 'e')} select doc_id, seq, rule_name, text, position from e_all")
def ext_mention_places(spark, d):
    return extraction.mentions(_texts(spark, d), _E_RULES).select("doc_id", "seq", "rule_name", "text", "position")


#: The same search for mentions over whole documents: languages' articles as entities, line ends as relations.
_EN_RULES = [extraction.Rule("capital", "CONCEPT", "[A-Z][a-z]+"), extraction.Rule("number", "TIME", "[0-9]+")]


@query("select rule_name, count(*) as n, count(distinct text) as n_texts from (select 'capital' as rule_name, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) as text from documents union all select 'number', unnest(regexp_extract_all(text, '[0-9]+')) from documents) group by 1")
def ext_document_mentions(spark, d):
    found = extraction.rule_matches(_docs(spark, d), _EN_RULES)
    return found.groupBy("rule_name").agg(F.count("*").alias("n"), F.countDistinct("text").alias("n_texts"))


@query(f"with d as (select doc_id, text from documents), {_placed_sql(_EN_RULES, 'e')} select doc_id, seq, count(*) as n, sum(position)::bigint as places, sum(position * len(text))::bigint as spread from e_all group by 1, 2")
def ext_document_places(spark, d):
    found = extraction.mentions(_docs(spark, d), _EN_RULES)
    return found.groupBy("doc_id", "seq").agg(F.count("*").alias("n"), F.sum(F.col("position").cast("long")).alias("places"), F.sum(F.col("position").cast("long") * F.col("length")).alias("spread"))


@query(f"{_NEAREST} select doc_id, b.label as subject, relation, a.label as object from n where a is not null and b is not null")
def ext_triples(spark, d):
    return extraction.RuleExtractor().triples(_texts(spark, d)).select("doc_id", "subject", "relation", "object")


@query(f"{_NEAREST}, t as (select distinct b.label, b.type, relation, relation_type, a.label, a.type from n where a is not null and b is not null) select 'entity' as kind, count(*) as n from (select distinct label, type from e) union all select 'relation', count(*) from (select distinct label, type from r) union all select 'triple', count(*) from t")
def ext_graph_build(spark, d):
    return extraction.Extractors().build(_texts(spark, d)).counts()


@query(f"with {_TEXT_SQL} select doc_id, regexp_extract(text, '李([a-z]+)', 1) as subject, '出生于' as relation, '中国' as object from d where text <> ''")
def ext_model_hook(spark, d):
    """A model that finds whoever was born in a country, and something that it is not sure of."""
    model = extraction.ModelExtractor(lambda t: [(t.split("李")[1].split("出生于")[0], "PERSON", 0.9), ("中国", "LOCATION", 0.8), ("弱", "CONCEPT", 0.1)], lambda t, e: [(0, 1, "出生于", "BORN_IN", 0.9), (1, 0, "弱", "CUSTOM", 0.1)])
    return model.triples(_texts(spark, d)).select("doc_id", "subject", "relation", "object")


_TOKEN_RULES = [extraction.Rule("capital_word", "CONCEPT", "[A-Z][a-z]+"), extraction.Rule("short", "CONCEPT", "[A-Za-z]{2,3}")]


@query("with t as (select item_id as doc_id, unnest(string_split(text, ' ')) as text from benchmark) select doc_id, text, rule_name from t join (values ('capital_word', '^(?:[A-Z][a-z]+)$'), ('short', '^(?:[A-Za-z]{2,3})$')) r(rule_name, p) on regexp_matches(text, p) where len(text) >= 2")
def ext_token_matches(spark, d):
    rows = _read(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.split("text", " ").alias("tokens"))
    return extraction.token_matches(rows, _TOKEN_RULES).select("doc_id", "text", "rule_name")


# Questions

ASKED = [
    (1, "NATION_1是谁？"), (2, "Supplier#000000003和Customer#000000005有什么关系？"), (3, "NATION_2有哪些位于？"), (4, "small ring的具有是什么？"), (5, "Supplier#000000001是不是NATION_20？"),
    (6, "什么是red widget？"), (7, "Supplier#000000002和Supplier#000000004相比哪个更大？"), (8, "ASIA Brand#2 为什么"), (9, "列举一切"), (10, "hello"), (11, "李白和杜甫是什么关系？"), (12, "中国有哪些主要城市？"), (13, "北京是哪个国家的首都？"),
]
_ASKED_SQL = "q as (select query_id, text, {n} as q from (values " + ", ".join(f"({i}, '{t}')" for i, t in ASKED) + ") v(query_id, text))"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '{questions.DROPPED}', '', 'g'))"


_ASKED_SQL = _ASKED_SQL.replace("{n}", _norm("text"))
_KIND = "case " + " ".join(f"when {' or '.join(f'contains(q, {chr(39)}{m}{chr(39)})' for m in marks)} then '{k}'" for k, marks in {**questions.TYPE_MARKS, "OPEN": questions.OPEN_MARKS}.items()) + " else 'UNKNOWN' end"


def _x(kind: str, group: int) -> str:
    return f"trim(regexp_extract(q, '{questions.PATTERNS[kind]}', {group}))"


_WORDS = "list_filter(list_sort(list_distinct(string_split_regex(q, '[ \\t\\n\\x0B\\f\\r]+'))), lambda w: strlen(w) > 1 and w not in (" + ", ".join(f"'{w}'" for w in names.STOP_WORDS) + "))"
_NAMED = "list_filter({}, lambda p: p <> '')"
_ENTITIES = "case type " + " ".join(f"when '{k}' then {_NAMED.format('[' + ', '.join(_x(k, i) for i in gs) + ']')}" for k, gs in {"ENTITY": (1,), "RELATION": (1, 2), "ATTRIBUTE": (1,), "LIST": (1,), "COMPARISON": (1, 2), "DEFINITION": (1,), "FACT": (1, 2)}.items()) + f" else {_WORDS} end"
_ATTRS = f"case type when 'ATTRIBUTE' then {_NAMED.format('[' + _x('ATTRIBUTE', 2) + ']')} when 'LIST' then {_NAMED.format('[' + _x('LIST', 2) + ']')} when 'COMPARISON' then {_NAMED.format('[' + _x('COMPARISON', 3) + ']')} else [] end"
_RELS = f"case when type = 'RELATION' and {_x('RELATION', 1)} <> '' then ['关系'] else [] end"
_PARSED = f"{_ASKED_SQL}, k as (select *, {_KIND} as type from q), parsed as (select *, {_ENTITIES} as entities, {_RELS} as relations, {_ATTRS} as attributes, case type when 'LIST' then {_x('LIST', 2)} end as list_type from k)"


def _parsed(spark):
    return questions.parse(spark.createDataFrame(ASKED, "query_id int, text string"))


#: A question about each supplier, of a kind that its key says.
_KINDS = ("{s}是谁？", "{s}和NATION_{n}有什么关系？", "{s}有哪些位于？", "{s}的地址是什么？", "{s}是不是NATION_{n}？", "什么是{s}？", "{s}和Supplier#{n}相比哪个更大？", "{s} 为什么  THE", "列举一切")
_KINDS_SQL = " ".join(f"when {i} then '{t}'" for i, t in enumerate(_KINDS)).replace("{s}", "' || s_name || '").replace("{n}", "' || s_nationkey || '")
_PARSED_ALL = _PARSED.replace(_ASKED_SQL, f"q as (select query_id, {_norm('text')} as q from (select s_suppkey as query_id, case s_suppkey % {len(_KINDS)} {_KINDS_SQL} end as text from supplier))")


def _parsed_all(spark, d):
    of = lambda t: F.concat(*[F.col("s_name") if p == "{s}" else F.col("s_nationkey").cast("string") if p == "{n}" else F.lit(p) for p in re.split(r"(\{[sn]\})", t) if p])
    text = F.lit(None)
    for i, t in enumerate(_KINDS):
        text = F.when(F.col("s_suppkey") % len(_KINDS) == i, of(t)).otherwise(text)
    return questions.parse(_read(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"), text.alias("text")))


@query(f"with {_PARSED_ALL} select query_id, q as normalized, type, case type " + " ".join(f"when '{k}' then '{v}'" for k, v in names.QUERY_TYPE_LABELS.items()) + " end as label from parsed")
def qa_parse_type(spark, d):
    return _parsed_all(spark, d).select("query_id", "normalized", "type", names.query_type_label(F.col("type")).alias("label"))


@query(f"with {_PARSED_ALL} select query_id, array_to_string(entities, '|') as entities, array_to_string(relations, '|') as relations, array_to_string(attributes, '|') as attributes, list_type from parsed")
def qa_parse_intent(spark, d):
    j = lambda c: F.array_join(c, "|").alias(c)
    return _parsed_all(spark, d).select("query_id", j("entities"), j("relations"), j("attributes"), F.try_element_at("params", F.lit("list_type")).alias("list_type"))


@query(f"with {_PARSED_ALL} select query_id, round(case when type = 'UNKNOWN' then 0.0 else 0.3 end + 0.3 * least(1.0, len(entities) / 2.0) + case when len(relations) > 0 then 0.2 else 0 end + case when len(attributes) > 0 then 0.2 else 0 end, 6)::double as parse_confidence from parsed")
def qa_parse_confidence(spark, d):
    return _parsed_all(spark, d).select("query_id", "parse_confidence")


_LINKS = f"{_PARSED}, en as (select {_norm('name')} as mention, min(id) as entity_id from e group by 1), said as (select query_id, generate_subscripts(entities, 1) - 1 as nth, unnest(entities) as mention from parsed), links as (select query_id, nth, mention, coalesce(entity_id, 'temp_' || mention) as entity_id, case when entity_id is null then 0.0 else 1.0 end as confidence from said left join en using (mention))"


@query(sql(f", {_LINKS} select query_id, nth::int as nth, mention, entity_id, confidence::double as confidence from links"))
def qa_entity_link(spark, d):
    return questions.link_entities(_parsed(spark), star_graph(spark, d).entities)


@query(sql(f", {_PARSED}, said as (select query_id, unnest(relations) as mention from parsed) select query_id, mention, 'temp_' || mention as relation_id from said"))
def qa_relation_link(spark, d):
    return questions.link_relations(_parsed(spark), star_graph(spark, d).relations).select("query_id", "mention", "relation_id")


def _searched(spark, d, **options):
    k, parsed = star_graph(spark, d), _parsed(spark)
    return k, parsed, search.search(k, parsed, questions.link_entities(parsed, k.entities), **options)


_DENORM = "dn as (select t.id, subject_id, object_id, relation_id, s.name as subject, r.name as relation, o.name as object, r.type as relation_type, confidence from t join e s on s.id = subject_id join r on r.id = relation_id join e o on o.id = object_id)"
_FIRST = f"{_LINKS}, {_DENORM}, f as (select p.*, l.entity_id as first_id, l2.entity_id as other_id from parsed p join links l on l.query_id = p.query_id and l.nth = 0 and l.confidence > 0 left join links l2 on l2.query_id = p.query_id and l2.nth = 1 and l2.confidence > 0), around as (select f.*, dn.id as triple_id, subject, relation, object, relation_type, confidence, object_id from f join dn on first_id = subject_id union all select f.*, dn.id, subject, relation, object, relation_type, confidence, object_id from f join dn on first_id = object_id)"


def _of_type(kind: str, keep: str, score: str) -> str:
    return sql(f", {_FIRST}, m as (select query_id, triple_id, {score}::double as relevance, confidence from around where type = '{kind}' and ({keep})) select query_id, triple_id, relevance, row_number() over (partition by query_id order by relevance desc, triple_id)::int as rank from m where confidence >= 0.2 qualify rank <= 10")


def _one_type(spark, d, kind: str):
    k, parsed = star_graph(spark, d), _parsed(spark)
    links = questions.link_entities(parsed, k.entities).filter("confidence > 0")
    found = search.ranked(search.exact(k, parsed.filter(F.col("type") == kind), links), 0.2)
    return found.select("query_id", "triple_id", "relevance", "rank")


@query(_of_type("ENTITY", "true", "1.0"))
def qa_search_entity(spark, d):
    return _one_type(spark, d, "ENTITY")


@query(_of_type("ATTRIBUTE", "relation_type = 'HAS_PROPERTY' or len(list_filter(attributes, lambda a: contains(relation, a))) > 0", "0.9"))
def qa_search_attribute(spark, d):
    return _one_type(spark, d, "ATTRIBUTE")


@query(_of_type("LIST", "contains(relation, list_type)", "0.9"))
def qa_search_list(spark, d):
    return _one_type(spark, d, "LIST")


@query(_of_type("FACT", "object_id = other_id", "1.0"))
def qa_search_fact(spark, d):
    return _one_type(spark, d, "FACT")


_SCORE = f"round(least(1.0, case when list_contains(entities, {_norm('subject')}) then 0.4 else 0 end + case when list_contains(entities, {_norm('object')}) then 0.3 else 0 end + case when list_contains(relations, relation) then 0.3 else 0 end + case when len(list_filter(attributes, lambda a: a <> '' and contains(relation, a))) > 0 then 0.2 else 0 end), 6)"


@query(sql(f", {_LINKS}, {_DENORM}, n as (select p.*, l.entity_id from parsed p join links l using (query_id) where l.confidence > 0 and type in ('COMPARISON', 'OPEN', 'UNKNOWN')), a as (select n.*, dn.id as triple_id, subject, relation, object, confidence from n join dn on entity_id = subject_id union all select n.*, dn.id, subject, relation, object, confidence from n join dn on entity_id = object_id), m as (select query_id, triple_id, confidence, {_SCORE}::double as relevance from a) select query_id, triple_id, relevance, row_number() over (partition by query_id order by relevance desc, triple_id)::int as rank from m where confidence >= 0.2 qualify rank <= 10"))
def qa_search_generic(spark, d):
    k, parsed = star_graph(spark, d), _parsed(spark)
    links = questions.link_entities(parsed, k.entities).filter("confidence > 0")
    found = search.ranked(search.generic(k, parsed.filter(F.col("type").isin("COMPARISON", "OPEN", "UNKNOWN")), links), 0.2)
    return found.select("query_id", "triple_id", "relevance", "rank")


_RELATED = f"""{_LINKS}, pr as (select a.query_id, a.entity_id as source, b.entity_id as target from links a join links b on a.query_id = b.query_id and a.nth = 0 and b.nth = 1 join parsed p on p.query_id = a.query_id where a.confidence > 0 and b.confidence > 0 and a.entity_id <> b.entity_id and type in ('RELATION', 'COMPARISON')),
h as (select id, subject_id as u, object_id as v from t where subject_id <> object_id union all select id, object_id, subject_id from t where subject_id <> object_id),
w(query_id, target, cur, nodes, steps) as (select query_id, target, source, [source], []::varchar[] from pr union all select query_id, target, h.v, list_append(nodes, h.v), list_append(steps, h.id) from w join h on w.cur = h.u where len(steps) < 3 and cur <> target and not list_contains(nodes, h.v)),
pa as (select query_id, steps, row_number() over (partition by query_id order by len(steps), steps) - 1 as path_index from w where cur = target),
pi as (select query_id, path_index, unnest(steps) as triple_id, 1.0::double / len(steps) as relevance from pa)"""


@query(sql(f", {_RELATED} select query_id, triple_id, relevance, rank from (select query_id, triple_id, relevance, row_number() over (partition by query_id order by relevance desc, path_index, triple_id)::int as rank from pi join t on t.id = pi.triple_id where confidence >= 0.2) where rank <= 10", True))
def qa_search_relation(spark, d):
    k, parsed = star_graph(spark, d), _parsed(spark)
    links = questions.link_entities(parsed, k.entities).filter("confidence > 0")
    found = search.related_items(k, parsed.filter(F.col("type").isin("RELATION", "COMPARISON")), links, 3)
    return search.ranked(found, 0.2).select("query_id", "triple_id", "relevance", "rank")


_HYBRID = f"""{_RELATED}, {_FIRST[len(_LINKS) + 2:]},
m as (select query_id, triple_id, (case when type in ('ATTRIBUTE', 'LIST') then 0.9 else 1.0 end)::double as relevance, null::bigint as path_index, subject, relation, object, relation_type, confidence from around
    where type in ('ENTITY', 'DEFINITION') or (type = 'ATTRIBUTE' and (relation_type = 'HAS_PROPERTY' or len(list_filter(attributes, lambda a: contains(relation, a))) > 0)) or (type = 'LIST' and contains(relation, list_type)) or (type = 'FACT' and object_id = other_id)
  union all select pi.query_id, triple_id, relevance, path_index, subject, relation, object, relation_type, confidence from pi join dn on dn.id = triple_id
  union all select query_id, id, {_SCORE}::double, null, subject, relation, object, relation_type, confidence from (select p.query_id, p.type, p.entities, p.relations, p.attributes, dn.* from parsed p join links l on l.query_id = p.query_id and l.confidence > 0 join dn on l.entity_id = subject_id where p.type in ('OPEN', 'UNKNOWN')
    union all select p.query_id, p.type, p.entities, p.relations, p.attributes, dn.* from parsed p join links l on l.query_id = p.query_id and l.confidence > 0 join dn on l.entity_id = object_id where p.type in ('OPEN', 'UNKNOWN'))),
hits as (select *, row_number() over (partition by query_id order by relevance desc, path_index nulls first, triple_id)::int as rank from m where confidence >= 0.2 qualify rank <= 10)"""


@query(sql(f", {_HYBRID} select query_id, rank, triple_id, relevance, confidence from hits", True))
def qa_hybrid(spark, d):
    return _searched(spark, d, min_confidence=0.2)[2].select("query_id", "rank", "triple_id", "relevance", "confidence")


@query(sql(f", {_HYBRID} select query_id, string_agg('Triple: ' || subject || ' - ' || relation || ' - ' || object, '|' order by rank) as sources from hits group by query_id", True))
def qa_sources(spark, d):
    return answers.sources(_searched(spark, d, min_confidence=0.2)[2]).select("query_id", F.array_join("sources", "|").alias("sources"))


_POST = "regexp_replace(regexp_replace({0}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '([。！？，：；]) ', '\\1', 'g')"


def _ended(x: str) -> str:
    return f"case when regexp_matches({x}, '[。！？!?]$') or {x} = '' then {x} else {x} || '。' end"


_SPOKEN = "subject || ' ' || relation || ' ' || object"
_ANSWER = f"""case p.type
  when 'FACT' then case when n > 0 and top_relevance > 0.8 then '是的，' || top_spoken || '。' else '{answers.FACT_UNKNOWN}' end
  when 'ENTITY' then case when n > 0 then coalesce(entities[1], top_subject) || ' 是' || coalesce(' ' || defined, ' 一个实体') || '。' || coalesce(' ' || coalesce(entities[1], top_subject) || ' 的特点包括：' || traits || '。', '') else '{answers.ENTITY_UNKNOWN}' end
  when 'ATTRIBUTE' then case when n > 0 and len(attributes) > 0 then coalesce(attr_spoken, '{answers.ATTRIBUTE_UNKNOWN}') else '{answers.ATTRIBUTE_UNCLEAR}' end
  when 'LIST' then case when n > 0 then coalesce(entities[1], '') || ' 的 ' || list_type || ' 包括：' || coalesce(listed || '。', '未找到相关信息。') else '{answers.LIST_UNKNOWN}' end
  else case when n > 0 then '根据知识库中的信息：' || chr(10) || spoken else '{answers.NOTHING}' end end"""
_DIRECT = f"""{_HYBRID}, agg as (select p.query_id, count(rank) as n, min_by(relevance, rank) as top_relevance, min_by({_SPOKEN}, rank) as top_spoken, min_by(subject, rank) as top_subject, min_by(confidence, rank) as top_confidence,
  string_agg(object, ' ' order by rank) filter (relation_type = 'IS_A' or contains(relation, '定义') or contains(relation, '类型')) as defined,
  array_to_string((list(relation || ' ' || object order by rank) filter (relation_type = 'HAS_PROPERTY'))[1:3], '，') as traits,
  min_by(subject || ' 的 ' || relation || ' 是 ' || object || '。', rank) filter (contains(relation, attributes[1])) as attr_spoken, min_by(confidence, rank) filter (contains(relation, attributes[1])) as attr_confidence,
  string_agg(object, '，' order by rank) filter (contains(relation, list_type)) as listed, string_agg('- ' || {_SPOKEN} || chr(10), '' order by rank) filter (rank <= 3) as spoken
  from parsed p left join hits using (query_id) group by p.query_id),
told as (select p.query_id, p.type, {_POST.format(_ANSWER)} as a, (case p.type when 'FACT' then case when n > 0 and top_relevance > 0.8 then top_confidence else 0.3 end when 'ENTITY' then case when n > 0 then 0.8 else 0.2 end
  when 'ATTRIBUTE' then case when n > 0 and len(attributes) > 0 then coalesce(attr_confidence, 0.2) else 0.1 end when 'LIST' then case when n = 0 then 0.2 when listed is null then 0.3 else 0.7 end else case when n > 0 then 0.5 else 0.1 end end)::double as confidence
  from parsed p join agg using (query_id))"""


@query(sql(f", {_DIRECT} select query_id, type, {_ended('a')} as answer, confidence from told", True))
def qa_direct_answer(spark, d):
    _, parsed, found = _searched(spark, d, min_confidence=0.2)
    return answers.direct(parsed, found)


@query(sql(f", {_DIRECT}, fin as (select query_id, {_ended('a')} as answer from told) select query_id, (i - 1)::int as idx, substr(answer, (i - 1) * 5 + 1, 5) as piece from fin, generate_series(1, 400) s(i) where (i - 1) * 5 < length(answer)", True))
def qa_stream_chunks(spark, d):
    _, parsed, found = _searched(spark, d, min_confidence=0.2)
    return answers.direct(parsed, found).select("query_id", F.posexplode(chunks.stream_pieces(F.col("answer"))).alias("idx", "piece"))


@query(sql(f", {_HYBRID} select query_id, round(least(1.0, 0.5 + 0.2 * least(1.0, count(*) / 5.0) + 0.3 * avg(relevance)), 6)::double as confidence from hits group by query_id", True))
def qa_model_confidence(spark, d):
    return answers.model_confidence(_searched(spark, d, min_confidence=0.2)[2])


@query(sql(f", {_HYBRID} select p.query_id, '{answers.PROMPT_HEAD.replace(chr(10), '')}' || chr(10) || chr(10) || '用户问题: ' || text || chr(10) || chr(10) || '相关知识:' || chr(10) || coalesce(string_agg('- ' || {_SPOKEN} || chr(10), '' order by rank) filter (relevance >= 0.5), '') || chr(10) || '请根据以上信息回答用户问题。Please answer in English.' as prompt from parsed p left join hits using (query_id) group by p.query_id, text", True))
def qa_prompts(spark, d):
    _, parsed, found = _searched(spark, d, min_confidence=0.2)
    return answers.prompts(parsed, found, min_confidence=0.5, language="en")


@query(sql(f""", {_DIRECT}, mc as (select query_id, round(least(1.0, 0.5 + 0.2 * least(1.0, count(*) / 5.0) + 0.3 * avg(relevance)), 6)::double as surely from hits group by query_id),
g as (select p.query_id, p.type in ('FACT', 'ATTRIBUTE') or (n = 1 and top_relevance > 0.9) as is_direct from parsed p join agg using (query_id))
select told.query_id, type, case when is_direct then {_ended('a')} else '模型：{answers.PROMPT_HEAD[:5]}。' end as answer, case when is_direct then confidence else coalesce(surely, 0.5) end::double as confidence, is_direct, not is_direct as is_model
from told join g using (query_id) left join mc using (query_id)""", True))
def qa_generate(spark, d):
    """Answers with a stand-in model: templates where they do, the model's text elsewhere."""
    _, parsed, found = _searched(spark, d, min_confidence=0.2)
    return answers.generate(parsed, found, model=lambda p: F.concat(F.lit("模型："), F.substring(p, 1, 5))).drop("sources")


@query("with q as (select item_id as id, chr(10) || replace(text, '.', '。') || '， ' as a from benchmark), p as (select id, " + _POST.format("a") + " as a from q) select id, " + _ended("a") + " as answer from p")
def qa_postprocess(spark, d):
    raw = F.concat(F.lit("\n"), F.replace("text", F.lit("."), F.lit("。")), F.lit("， "))
    return _read(spark, d, "benchmark").select(F.col("item_id").alias("id"), answers.postprocessed(raw).alias("answer"))


# Dialogue

_MESSAGES = "m as (select conv_id::varchar as session_id, turn::int as seq, case role when 'user' then 'USER' when 'assistant' then 'ASSISTANT' when 'system' then 'SYSTEM' else 'USER' end as role, text as content from conversations)"


def _messages(spark, d):
    return dialogue.from_conversations(_read(spark, d, "conversations"))


@query(f"with {_MESSAGES} select session_id, seq, role, content from m qualify row_number() over (partition by session_id order by seq desc) <= 20")
def dlg_history_last20(spark, d):
    return dialogue.history(_messages(spark, d))


@query(f"with {_MESSAGES} select session_id, seq, role from m qualify row_number() over (partition by session_id order by seq desc) <= 5")
def dlg_last5_context(spark, d):
    return dialogue.history(_messages(spark, d), 5).select("session_id", "seq", "role")


@query(f"with {_MESSAGES} select session_id, count(*) as n_messages, max(seq) as last_seq from m group by 1")
def dlg_session_counts(spark, d):
    return dialogue.session_counts(_messages(spark, d))


@query(f"with {_MESSAGES} select count(distinct session_id) as n_sessions from m where session_id not in ('1', '2')")
def dlg_active_sessions(spark, d):
    gone = spark.createDataFrame([("1",), ("2",)], "session_id string")
    return dialogue.active_sessions(dialogue.clear(_messages(spark, d), gone))


@query(f"with {_MESSAGES}, l as (select session_id, max(seq) as last from m where session_id in ('3', '4') group by 1) select session_id, (last + i)::int as seq, r as role from l, (values (1, 'USER'), (2, 'ASSISTANT')) v(i, r) where session_id = '3'")
def dlg_append(spark, d):
    before = _messages(spark, d)
    new = spark.createDataFrame([("3", 1, "USER", "hi"), ("3", 2, "ASSISTANT", "ho"), ("nobody", 1, "USER", "x")], "session_id string, nth int, role string, content string")
    return dialogue.append(before, new).join(before.select("session_id", "seq"), ["session_id", "seq"], "left_anti").select("session_id", "seq", "role")


@query(f"with {_MESSAGES} select session_id, role as key, max_by(content, seq) as value from m group by 1, 2")
def dlg_attributes(spark, d):
    writes = _messages(spark, d).select("session_id", "seq", F.col("role").alias("key"), F.col("content").alias("value"))
    return dialogue.attributes(writes)


@query(r"""with names as (select distinct w as name from (select unnest(string_split_regex(text, '[\s，。？！,.?!]+')) as w from benchmark) where len(w) > 5),
m as (select conv_id::varchar as session_id, turn as seq, text from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 5),
w as (select distinct session_id, seq, name from (select session_id, seq, unnest(string_split_regex(text, '[\s，。？！,.?!]+')) as name from m) join names using (name)),
l as (select session_id, max({'seq': seq, 'n': len(name), 'name': name}) as x from w group by session_id)
select query_id, case when query_id % 2 = 0 then x.name end as last_entity from (select distinct conv_id as query_id from conversations) left join l on session_id = query_id::varchar""")
def dlg_pronoun_context(spark, d):
    messages = _messages(spark, d)
    asked = _read(spark, d, "conversations").select(F.col("conv_id").alias("query_id")).distinct()
    asked = asked.select("query_id", F.col("query_id").cast("string").alias("session_id"), F.when(F.col("query_id") % 2 == 0, "它在哪里").otherwise("你好").alias("text"))
    words = _read(spark, d, "benchmark").select(F.explode(F.split("text", r"[\s，。？！,.?!]+")).alias("name")).filter(F.char_length("name") > 5).distinct()
    return dialogue.in_context(asked, messages, words).select("query_id", "last_entity")


# Storage

_CHANGED = "b as (select id, confidence from t where relation_id <> 'related_to'), n as (select id, case when relation_id = 'belongs_to' then least(1.0::double, confidence + 0.1) else confidence end as confidence from t where relation_id <> 'has_property')"


def _versions(spark, d):
    k = star_graph(spark, d)
    base = k.remove_relations(k.relation("related_to"))
    new = k.remove_relations(k.relation("has_property"))
    sure = new.triples.withColumn("confidence", F.when(F.col("relation_id") == "belongs_to", F.least(F.lit(1.0), F.col("confidence") + 0.1)).otherwise(F.col("confidence")))
    return base, g.Graph(new.entities, new.relations, sure)


@query(sql(f", {_CHANGED}, x as (select case when b.id is null then 'added' when n.id is null then 'deleted' when b.confidence <> n.confidence then 'modified' end as change from b full join n on b.id = n.id) select 'triple' as kind, change, count(*) as n from x where change is not null group by change union all select 'relation', 'added', 1 union all select 'relation', 'deleted', 1"))
def ver_diff(spark, d):
    return store.diff(*_versions(spark, d)).groupBy("kind", "change").agg(F.count("*").alias("n"))


@query(sql(" select id from t where relation_id = 'belongs_to' and least(1.0::double, confidence + 0.1) <> confidence"))
def ver_modified(spark, d):
    return store.diff(*_versions(spark, d)).filter("kind = 'triple' and change = 'modified'").select("id")


@query(sql(" select id, case when id = 'r:0' then 'changed' else name end as name from e where type = 'LOCATION' union all select 'r:new', 'new'"))
def store_upsert(spark, d):
    old = star_graph(spark, d).entities_by(type="LOCATION").select("id", "name")
    return store.upsert(old, spark.createDataFrame([("r:0", "changed"), ("r:new", "new")], "id string, name string"))


@query(sql(" select id, case when id = 'n:0_located_in_r:0' then 0.25 else confidence end as confidence from t where relation_id = 'located_in' and starts_with(subject_id, 'n:')"))
def store_upsert_triples(spark, d):
    k = star_graph(spark, d)
    old = k.triples.filter(F.col("subject_id").startswith("n:"))
    new = old.filter("id = 'n:0_located_in_r:0'").withColumn("confidence", F.lit(0.25))
    return store.upsert_triples(old, new).select("id", "confidence")


@query(sql(" select id, name, type from e where type <> 'EVENT'"))
def store_json_roundtrip(spark, d):
    e = graphs.json_rows(star_graph(spark, d)).filter("kind = 'entity'")
    back = e.select(F.from_json("json", "id string, name string, type string").alias("j")).select("j.*")
    return back.filter("type <> 'EVENT'")


@query(sql(" select subject_id, relation_id, object_id from t where relation_id in ('located_in', 'related_to')"))
def store_ntriples_roundtrip(spark, d):
    k = star_graph(spark, d)
    some = g.Graph(k.entities.filter("type in ('LOCATION', 'ORGANIZATION', 'PERSON')"), k.relations, k.triples.filter("relation_id in ('located_in', 'related_to')"))
    return graphs.from_ntriples(graphs.ntriples(some)).triples.select("subject_id", "relation_id", "object_id")


@query("with l as (select o_orderkey, o_orderpriority, o_orderdate from orders) select o_orderkey as backup_id, o_orderpriority as graph, nth::int as nth, nth <= 10 and o_orderdate >= timestamp '1998-08-01' - interval 30 day as keep from (select *, row_number() over (partition by o_orderpriority order by o_orderdate desc, o_orderkey desc) as nth from l) where nth <= 20")
def backup_retention(spark, d):
    o = _read(spark, d, "orders").select(F.col("o_orderkey").alias("backup_id"), F.col("o_orderpriority").alias("graph"), F.col("o_orderdate").alias("created"))
    return store.retained(o, 10, 30, F.lit("1998-08-01").cast("timestamp_ntz")).filter("nth <= 20").select("backup_id", "graph", "nth", "keep")


@query("with h as (select event_type as tier, lag(ts) over (partition by event_type, user_id order by ts, event_id) as before, ts from events) select tier, count(*) as accesses, count(*) filter (ts <= before + interval 600 minute) as hits, round(count(*) filter (ts <= before + interval 600 minute) / count(*), 6) as hit_rate from h group by tier")
def cache_hit_rate(spark, d):
    log = _read(spark, d, "events").select(F.col("event_type").alias("tier"), F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("access_id"))
    return caches.hit_rates(log, F.expr("interval 600 minutes"))


_CACHE = "i as (select event_type as tier, user_id as key, max(ts) as last, min(ts) as first, count(*) as hits, max(value) as weight, max(event_id % 3) as priority from events group by 1, 2)"


@query(f"with {_CACHE} " + " union all ".join(f"select '{p}' as policy, tier, key, rank from (select tier, key, row_number() over (partition by tier order by {', '.join(c + ' desc' for c in cols)}, key)::int as rank from i) where rank <= 5" for p, cols in caches.POLICIES.items()))
def cache_policies(spark, d):
    log = _read(spark, d, "events").select(F.col("event_type").alias("tier"), F.col("user_id").alias("key"), F.col("ts").alias("at"), (F.col("event_id") % 3).alias("priority"), F.col("value").alias("weight"))
    out = None
    for p in caches.POLICIES:
        one = caches.held(log, 5, p).withColumn("policy", F.lit(p))
        out = one if out is None else out.unionByName(one)
    return out


# Streams


@query("select event_type, strftime(time_bucket(interval 10 minute, ts), '%Y-%m-%d %H:%M:%S') as starts, count(*) as n, round(sum(value), 2) as value from events group by event_type, time_bucket(interval 10 minute, ts)")
def evt_stream_window(spark, d):
    counted = ingest.run_available(ingest.windowed_counts(_stream(spark, d, "events")))
    return counted.select("event_type", F.date_format("starts", "yyyy-MM-dd HH:mm:ss").alias("starts"), "n", "value")
