"""Operator 13: how many spans are open at each moment, and the peaks, by a sweep over range-partitioned deltas."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import cut, table

#: Moments of one block, a row of the table between the two passes, at most.
BLOCK = 4096
DAY = 86_400
#: Key of the sweep over all nations, and of sales without a nation.
ALL, NONE = -2, -1

_LISTS = pa.list_(pa.int64())
_BLOCKS = pa.schema([("part", pa.int32()), ("key", pa.int32()), ("seq", pa.int64()), ("before_n", pa.int64()), ("before_v", pa.int64()), ("high_n", pa.int64()), ("all_n", pa.int64()), ("all_v", pa.int64()), ("max_n", pa.int64()), ("max_v", pa.int64()), ("next", pa.int64()), ("at", _LISTS), ("n", _LISTS), ("v", _LISTS)])
BLOCKS = "part int, key int, seq long, before_n long, before_v long, high_n long, all_n long, all_v long, max_n long, max_v long, next long, at array<long>, n array<long>, v array<long>"
SWEPT = "key int, from_s long, to_s long, n_open long, open_value long, high_open long, is_peak boolean"


def seconds(df: DataFrame, name: str) -> F.Column:
    """A time column as whole seconds since 1970, rounded down; a time without a zone is taken as UTC in any session."""
    c = F.col(name)
    if df.schema[name].dataType.typeName() == "timestamp_ntz":
        return F.unix_date(c.cast("date")).cast("long") * DAY + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    return F.unix_seconds(c.cast("timestamp"))


def deltas(spans: DataFrame) -> DataFrame:
    """(key, at, n, v): what starts and ends at a moment change together; moments that change nothing are left out.

    Summed before and after the shuffle, so a moment or key of many spans is one row from each task.
    """
    change = lambda at, n: F.struct(F.col(at).alias("at"), F.lit(n).cast("long").alias("n"), (n * F.col("value")).alias("v"))
    ends = F.array(change("start", 1), change("end", -1))
    moved = spans.select("key", F.explode(ends).alias("x")).select("key", "x.*").filter("at is not null")
    return moved.groupBy("key", "at").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).filter("n <> 0 or v <> 0")


def _blocks(batches):
    """Pass one: a partition's sorted deltas as blocks of one key, each with the sums and the largest prefix of the partition so far."""
    part, seq, held = TaskContext.get().partitionId(), 0, None
    key, sum_n, sum_v, max_n, max_v = None, 0, 0, None, None

    def row(block, following):
        return pa.RecordBatch.from_pylist([block | {"next": following}], schema=_BLOCKS)

    for batch in batches:
        keys, at, n, v = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
            for a in range(lo, hi, BLOCK):
                b = min(a + BLOCK, hi)
                k = int(keys[a])
                if held is not None:
                    yield row(held, int(at[a]) if k == key else None)
                if k != key:
                    key, sum_n, sum_v, max_n, max_v = k, 0, 0, None, None
                high, run_n, run_v = max_n, sum_n + np.cumsum(n[a:b]), sum_v + np.cumsum(v[a:b])
                held = {"part": part, "key": k, "seq": seq, "before_n": sum_n, "before_v": sum_v, "high_n": high}
                sum_n, sum_v = int(run_n[-1]), int(run_v[-1])
                max_n = int(run_n.max()) if max_n is None else max(max_n, int(run_n.max()))
                max_v = int(run_v.max()) if max_v is None else max(max_v, int(run_v.max()))
                held |= {"all_n": sum_n, "all_v": sum_v, "max_n": max_n, "max_v": max_v, "at": at[a:b], "n": n[a:b], "v": v[a:b]}
                seq += 1
    if held is not None:
        yield row(held, None)


def carries(parts: list) -> dict:
    """(part, key) to what earlier partitions hand on: open count and value, largest count, next moment, and the key's largest value.

    ``parts`` has part, key, all_n, all_v, max_n, max_v and first of each pair, in any order.
    """
    out, of = {}, {}
    for p in sorted(parts, key=lambda p: p["part"]):
        of.setdefault(p["key"], []).append(p)
    for key, own in of.items():
        n = v = 0
        high, peak, rows = None, None, []
        for i, p in enumerate(own):
            rows.append((p["part"], n, v, high, own[i + 1]["first"] if i + 1 < len(own) else None))
            high = n + p["max_n"] if high is None else max(high, n + p["max_n"])
            peak = v + p["max_v"] if peak is None else max(peak, v + p["max_v"])
            n, v = n + p["all_n"], v + p["all_v"]
        out |= {(part, key): (*rest, peak) for part, *rest in rows}
    return out


def _finished(carried, batches):
    """Pass two: the moments of each block, with the carries put on top."""
    for batch in batches:
        for r in range(batch.num_rows):
            one = {name: batch.column(i)[r] for i, name in enumerate(batch.schema.names)}
            part, key, before_n, before_v, high_n, following = (one[c].as_py() for c in ("part", "key", "before_n", "before_v", "high_n", "next"))
            n0, v0, high0, after, peak = carried.value[part, key]
            at, n, v = (one[c].values.to_numpy(zero_copy_only=False) for c in ("at", "n", "v"))
            n, v = n0 + before_n + np.cumsum(n), v0 + before_v + np.cumsum(v)
            high = np.maximum.accumulate(n)
            for earlier in (high0, None if high_n is None else n0 + high_n):
                if earlier is not None:
                    high = np.maximum(high, earlier)
            last = following if following is not None else after
            to = pa.array([*at[1:].tolist(), last], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), key, np.int32)), pa.array(at), to, pa.array(n), pa.array(v), pa.array(high), pa.array(v == peak)], names=["key", "from_s", "to_s", "n_open", "open_value", "high_open", "is_peak"])


def sweep(spans: DataFrame) -> DataFrame:
    """The moments at which the count or value of the open spans changes, with what is open from then on.

    ``spans`` has key (int), start and end (long; the end is not included, null: never) and value (long); other columns are
    ignored. Returned are key, from_s, to_s (the key's next from_s, null at its last), n_open, open_value, high_open (the largest
    n_open of the key so far) and is_peak (open_value is the key's largest). Spans with a null key or start, and those that do not
    end after their start, take no part; a null value is 0. Equal spans count each. Empty in, empty out.

    Deltas are range-partitioned by key and moment, so a key of any size is spread over many tasks. Pass one writes them in
    blocks, with each partition's sums and largest prefixes; the driver gets one short row for each pair of a partition and a key
    in it, at most as many as partitions and keys together, so keys are to be a bounded set such as nations. It scans the
    carries and broadcasts them, and pass two adds them to the prefix sums of each block. Nothing is lost with an executor: both
    passes read tables in the shared folder.
    """
    spark = spans.sparkSession
    some = spans.filter("key is not null and start is not null and (end is null or end > start)").select(F.col("key").cast("int").alias("key"), "start", "end", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    moved = cut(deltas(some), "deltas")
    spread = moved.repartitionByRange("key", "at").sortWithinPartitions("key", "at")
    blocks = cut(spread.mapInArrow(_blocks, BLOCKS), "blocks")
    last = F.struct("seq", "all_n", "all_v", "max_n", "max_v")
    parts = blocks.groupBy("part", "key").agg(F.max(last).alias("m"), F.min(F.element_at("at", 1)).alias("first")).select("part", "key", "m.*", "first").collect()
    carried = spark.sparkContext.broadcast(carries([p.asDict() for p in parts]))
    return blocks.mapInArrow(lambda b: _finished(carried, b), SWEPT)


def open_sales(sales: DataFrame, lines: DataFrame, clients: DataFrame) -> DataFrame:
    """The spans of all sales: by their client's nation, and again under ``ALL``.

    A sale is open from sold_at until a day after its earliest shipped_at. Ids that repeat among clients count once, with the
    smallest nation. Both looked-up tables are written first: so both sides of either join are plain exchanges, and Spark
    splits the partition of a sale or client with many rows.
    """
    shipped = cut(lines.filter("sale_id is not null").groupBy("sale_id").agg(F.min(seconds(lines, "shipped_at")).alias("shipped")).filter("shipped is not null"), "shipped")
    nations = cut(clients.filter("client_id is not null and nation_id is not null").groupBy("client_id").agg(F.min("nation_id").cast("int").alias("nation")), "nations")
    total = F.when(F.abs("total") < 9e16, F.floor(100 * F.col("total") + 0.5)).otherwise(0)
    sold = sales.select("sale_id", "client_id", seconds(sales, "sold_at").alias("start"), total.cast("long").alias("value")).filter("start is not null")
    ended = sold.join(shipped, "sale_id", "left").withColumn("end", F.col("shipped") + DAY).filter("end is null or end > start")
    placed = ended.join(nations, "client_id", "left")
    return placed.select(F.explode(F.array(F.coalesce("nation", F.lit(NONE)), F.lit(ALL))).alias("key"), "start", "end", "value")


def op13_peak_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = open_sales(table(spark, sf_dir, "sales"), table(spark, sf_dir, "sale_lines"), table(spark, sf_dir, "clients"))
    return sweep(spans).withColumnsRenamed({"key": "nation_id", "open_value": "open_cents"})


OP13_SQL = """
with shipped as (select sale_id, min(epoch_us(shipped_at) // 1000000) + 86400 as b from sale_lines where sale_id is not null and shipped_at is not null group by sale_id),
c as (select client_id, min(nation_id) as nation from clients group by client_id),
s as (
  select coalesce(nation, -1) as nation, epoch_us(sold_at) // 1000000 as a, b, case when abs(total) < 9e16 then floor(100 * total + 0.5)::bigint else 0 end as cents
  from sales left join shipped using (sale_id) left join c using (client_id) where sold_at is not null),
o as (select * from s where b is null or b > a),
x as (select nation, a, b, cents from o union all select -2, a, b, cents from o),
d as (select nation, a as t, 1 as n, cents as v from x union all select nation, b, -1, -cents from x where b is not null),
m as (select nation, t, sum(n) as n, sum(v) as v from d group by nation, t having sum(n) <> 0 or sum(v) <> 0),
r as (select nation, t, lead(t) over w as to_s, sum(n) over w as n_open, sum(v) over w as open_cents from m window w as (partition by nation order by t))
select nation::int as nation_id, t::bigint as from_s, to_s::bigint as to_s, n_open::bigint as n_open, open_cents::bigint as open_cents,
  max(n_open) over (partition by nation order by t)::bigint as high_open, open_cents = max(open_cents) over (partition by nation) as is_peak from r
"""
