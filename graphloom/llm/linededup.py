"""Operator 6: repeated multi-line chunks with content-defined boundaries, and whole repeated runs of lines. SQL functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .tables import cut, table

#: A line starts a chunk if the first hex digit of the rolling hash over it and the line before is below this: 5 in 16 do.
BOUNDARY = "5"
#: Lines that a chunk needs to be removed.
LEAST_LINES = 2

_PACK = 1 << 31
_SPACES = " \t\n\r\f\x0b"


def _held(df: DataFrame, name: str, value) -> DataFrame:
    """``df`` with a column that later expressions read, and do not compute again for each array element."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with dk (the id; null is smaller than all) and tk (hash of the text)."""
    whole = isinstance(docs.schema["doc_id"].dataType, IntegralType)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))) if whole else F.struct(F.col("doc_id").isNotNull(), "doc_id")
    return docs.withColumn("dk", key).withColumn("tk", F.xxhash64(F.coalesce("text", F.lit(""))))


def _others(docs: DataFrame, made: tuple) -> tuple[DataFrame, list]:
    """doc_id, text and all other columns as one, so that their names meet none of those in between; and how to get them back.
    Columns named like ``made`` are left out."""
    names = [c for c in docs.columns if c.lower() not in ("doc_id", "text", *made)]
    if not names:
        return docs.select("doc_id", "text"), []
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in names)).alias("others")), [F.col(f"others.`{c}`").alias(c) for c in names]


def _split(docs: DataFrame) -> DataFrame:
    return _held(docs, "lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))


def _chunked(docs: DataFrame) -> DataFrame:
    """dk, tk, lines, and spans: start * 2^31 + end of each chunk.

    The boundary test reads two lines and nothing else, so the same run of lines is cut at the same places wherever it stands.
    """
    rows = _split(_keyed(docs))
    rows = _held(rows, "hashes", F.transform("lines", F.md5))
    before = F.concat(F.array(F.lit("")), F.slice("hashes", 1, F.size("hashes") - 1))
    rows = _held(rows, "rolling", F.zip_with(before, "hashes", lambda a, b: F.substring(F.md5(F.concat(a, b)), 1, 1))).drop("hashes")
    starts = F.filter(F.transform("rolling", lambda d, i: F.when((i == 0) | (d < BOUNDARY), i.cast("long"))), lambda i: i.isNotNull())
    rows = _held(rows, "starts", starts).drop("rolling")
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("lines").cast("long")))
    return _held(rows, "spans", F.zip_with("starts", ends, lambda a, b: a * _PACK + b)).drop("starts")


def _lines(span) -> F.Column:
    return F.slice("lines", F.shiftright(span, 31).cast("int") + 1, (span % _PACK - F.shiftright(span, 31)).cast("int"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, others) with text cleaned, and n_lines, removed_lines, removed_chunks.

    Lines end at line feeds. A chunk of two lines or more that is not blank and occurs in several places goes everywhere but in
    its first place: the document with the smallest id (a null id is smaller than all), and there the first line. Chunks count
    as equal when their bytes are; where two different chunks have one hash, both stay. Rows that share id and text are cleaned
    alike; rows that share an id only rank as one document. Null texts stay null and have no lines. Shuffles each chunk's bytes
    and each text once; equal chunks of a task are merged before. Ids may be of any type that can be sorted. Columns named like the
    result's own are replaced, all others are kept, whatever their names.
    """
    base, others = _others(docs, ("n_lines", "removed_lines", "removed_chunks"))
    one = F.explode("spans").alias("span")
    chunks = _chunked(docs.select("doc_id", "text")).select("dk", "tk", "lines", one).filter(F.col("span") % _PACK - F.shiftright("span", 31) >= LEAST_LINES)
    bodies = chunks.select("dk", "tk", "span", F.array_join(_lines(F.col("span")), "\n").alias("body")).filter(F.btrim("body", F.lit(_SPACES)) != "")
    bodies = bodies.withColumn("h", F.xxhash64("body"))
    same = bodies.groupBy("h", "body").agg(F.count("*").alias("n"), F.min("dk").alias("first"))
    repeated = same.groupBy("h").agg(F.count("*").alias("texts"), F.sum("n").alias("n"), F.min("first").alias("first")).filter("n > 1 and texts = 1").select("h", "first")
    places = bodies.select("dk", "tk", "span", "h")
    inside = places.groupBy("dk", "tk", "h").agg(F.min("span").alias("least"), F.count("*").alias("n")).filter("n > 1").select("dk", "tk", "h", "least")
    again = places.join(repeated, "h").join(inside, ["dk", "tk", "h"], "left").filter("dk > first or span > least")
    gone = again.groupBy("dk", "tk").agg(F.collect_set("span").alias("removed"))
    rows = _chunked(base).join(gone, ["dk", "tk"], "left")
    kept = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(F.transform(F.array_except("spans", "removed"), _lines)), "\n"))
    lost = F.coalesce(F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x % _PACK - F.shiftright(x, 31)), F.lit(0).cast("long"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long")
    chunks_gone = F.greatest(F.coalesce(F.size("removed"), F.lit(0)).cast("long"), F.lit(0).cast("long"))
    done = rows.select("doc_id", *(["others"] if others else []), kept.alias("text"), n_lines.alias("n_lines"), lost.alias("removed_lines"), chunks_gone.alias("removed_chunks"))
    return done.select("doc_id", *others, "text", "n_lines", "removed_lines", "removed_chunks")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return dedup_lines(docs.select("doc_id", "text"))


OP6_SQL = f"""
with d as (select row_number() over () as r, coalesce(doc_id, -9223372036854775808) as dk, doc_id, text, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select r, dk, generate_subscripts(lines, 1) as i, unnest(lines) as line from d),
m as (select *, case when i = 1 or substr(md5(md5(lag(line) over (partition by r order by i)) || md5(line)), 1, 1) < '{BOUNDARY}' then 1 else 0 end as starts from l),
c as (select *, sum(starts) over (partition by r order by i) as chunk from m),
b as (select r, dk, chunk, count(*) as n, string_agg(line, chr(10) order by i) as body from c group by r, dk, chunk),
f as (select body, min(dk) as first_dk, count(*) as times from b where n >= {LEAST_LINES} and trim(body, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)) <> '' group by body),
w as (select b.*, row_number() over (partition by r, b.body order by chunk) as nth from b),
g as (select r, chunk, n from w join f using (body) where n >= {LEAST_LINES} and times > 1 and (dk > first_dk or nth > 1)),
k as (select c.r, string_agg(line, chr(10) order by i) as text from c left join g on c.r = g.r and c.chunk = g.chunk where g.r is null group by c.r),
x as (select r, sum(n) as removed_lines, count(*) as removed_chunks from g group by r)
select doc_id, case when d.text is null then null when x.r is null then d.text else coalesce(k.text, '') end as text, case when d.text is null then 0 else len(lines) end::bigint as n_lines,
  coalesce(removed_lines, 0)::bigint as removed_lines, coalesce(removed_chunks, 0)::bigint as removed_chunks
from d left join k on k.r = d.r left join x on x.r = d.r
"""


def _pairs(docs: DataFrame) -> DataFrame:
    """dk, tk, at and key of each line that has a next one: its place, and 128 bits of a SHA-256 over the two lines' SHA-256."""
    rows = _held(_split(_keyed(docs)).drop("text"), "hashes", F.transform("lines", lambda x: F.sha2(x, 256))).drop("lines")
    both = F.zip_with(F.slice("hashes", 1, F.size("hashes") - 1), F.slice("hashes", 2, F.size("hashes")), lambda a, b: F.substring(F.unhex(F.sha2(F.concat(a, b), 256)), 1, 16))
    return rows.select("dk", "tk", F.posexplode(both).alias("at", "key"))


def dedup_runs(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, others) with text cleaned, and n_lines, removed_lines, removed_runs.

    Every line goes that lies in a run of two lines or more, not all blank, that an earlier place holds too: a document with a
    smaller id (a null id is smaller than all), or further up in the same one, not overlapping. Such runs are made of
    neighbouring lines that an earlier place holds as neighbours, so comparing those finds all of them whole. The first place of
    every line stays. Rows that share id and text are cleaned alike; rows that share an id only rank as one document. Null texts
    stay null and have no lines. Shuffles a digest for each two neighbouring lines, and each text once. Ids and other
    columns are as in ``dedup_lines``.
    """
    base, others = _others(docs, ("n_lines", "removed_lines", "removed_runs"))
    pairs = _pairs(docs.select("doc_id", "text"))
    repeated = pairs.groupBy("key").agg(F.count("*").alias("n"), F.min("dk").alias("first")).filter("n > 1").select("key", "first")
    own = F.when(F.col("dk") == F.col("first"), F.col("key"))
    again = pairs.join(repeated, "key").select("dk", "tk", "at", own.alias("own")).repartition("dk", "tk")
    least = F.min("at").over(Window.partitionBy("dk", "tk", "own"))
    found = again.withColumn("least", least).filter(f"own is null or at >= least + {LEAST_LINES}")
    gone = found.groupBy("dk", "tk").agg(F.sort_array(F.collect_set("at")).alias("at"))
    rows = _split(_keyed(base).join(gone, ["dk", "tk"], "left"))
    starts = F.filter("at", lambda x, i: (i == 0) | (F.get("at", i - 1) < x - 1))
    ends = F.transform(F.filter("at", lambda x, i: (i == F.size("at") - 1) | (F.get("at", i + 1) > x + 1)), lambda x: x + 2)
    part = lambda a, b: F.slice("lines", a + 1, b - a)
    solid = F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: F.btrim(F.array_join(part(x["a"], x["b"]), "\n"), F.lit(_SPACES)) != "")
    rows = _held(rows, "spans", solid)
    between = F.zip_with(F.concat(F.array(F.lit(0)), F.col("spans.b")), F.concat(F.col("spans.a"), F.array(F.size("lines"))), part)
    kept = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(between), "\n"))
    lost = F.coalesce(F.aggregate("spans", F.lit(0), lambda s, x: s + x["b"] - x["a"]), F.lit(0)).cast("long")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long")
    runs = F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans")).cast("long")
    done = rows.select("doc_id", *(["others"] if others else []), kept.alias("text"), n_lines.alias("n_lines"), lost.alias("removed_lines"), runs.alias("removed_runs"))
    return done.select("doc_id", *others, "text", "n_lines", "removed_lines", "removed_runs")


def op6_repeated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP6_RUNS_SQL = f"""
with d as (select row_number() over () as r, coalesce(doc_id, -9223372036854775808) as dk, doc_id, text, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select r, dk, generate_subscripts(lines, 1) as i, unnest(lines) as line from d),
n as (select *, line || chr(10) || lead(line) over (partition by r order by i) as pair from l),
f as (select pair, min(dk) as first_dk from n where pair is not null group by pair),
w as (select *, min(i) over (partition by r, pair) as least from n where pair is not null),
g as (select r, i, i - row_number() over (partition by r order by i) as run from w join f using (pair) where dk > first_dk or i >= least + {LEAST_LINES}),
s as (select r, min(i) as a, max(i) + 1 as b from g group by r, run),
t as (select s.r, a, b from s join l on s.r = l.r and i between a and b group by s.r, a, b having trim(string_agg(line, ''), ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)) <> ''),
k as (select l.r, string_agg(line, chr(10) order by i) as text from l left join t on l.r = t.r and i between a and b where t.r is null group by l.r),
x as (select r, sum(b - a + 1) as removed_lines, count(*) as removed_runs from t group by r)
select doc_id, case when d.text is null then null when x.r is null then d.text else coalesce(k.text, '') end as text, case when d.text is null then 0 else len(lines) end::bigint as n_lines,
  coalesce(removed_lines, 0)::bigint as removed_lines, coalesce(removed_runs, 0)::bigint as removed_runs
from d left join k on k.r = d.r left join x on x.r = d.r
"""
