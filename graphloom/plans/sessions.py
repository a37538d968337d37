"""Queries over sessions of the shop's clicks: a client's clicks are its messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import ingest
from ..streaming import sessions as s
from .queries import query
from .star import _read, _stream

_SESSIONS = """
m as (select client_id::varchar as session_id, epoch_us(ts) as us, coalesce(click_id, 0) as id, coalesce(kind, '') as content from clicks where client_id is not null and ts is not null),
g as (select *, case when us - lag(us) over w > 1800000000 then 1 else 0 end as begins from m window w as (partition by session_id order by us, id, content)),
n as (select *, sum(begins) over (partition by session_id order by us, id, content rows unbounded preceding) as nth from g),
p as (select *, row_number() over (partition by session_id, nth order by us desc, id desc, content desc) as place from n),
r as (select session_id, min(us) as started, max(us) as ended, count(*) as n_messages, array_to_string(list(content order by us, id, content) filter (place <= 20), '|') as last from p group by session_id, nth)"""


def _clicks(clicks):
    return clicks.select(F.col("client_id").alias("session_id"), "ts", F.col("click_id").alias("id"), F.col("kind").alias("content"))


def _shown(found):
    return found.select("session_id", "started", "ended", "n_messages", F.array_join("last", "|").alias("last"))


@query(f"with {_SESSIONS} select session_id, started, ended, n_messages, last from r")
def dlg_click_sessions(spark, d):
    return _shown(s.sessions(_clicks(_read(spark, d, "clicks"))))


@query(f"with {_SESSIONS} select session_id, started, ended, n_messages, last from r where (ended + 1800000000) // 1000 + 1 <= (select max(us) from m) // 1000 - 3600000")
def dlg_stream_sessions(spark, d):
    with s.state_store(spark):
        return _shown(ingest.run_available(s.expiring_sessions(_clicks(_stream(spark, d, "clicks"))), "append"))
