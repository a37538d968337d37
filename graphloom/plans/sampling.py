"""Queries of token sampling: the candidates of a language are its documents' words, by their shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens
from ..operators import sampling
from .queries import _TOK, query
from .star import _read

_OPTIONS = {"top_k": 50, "top_p": 0.25, "temperature": 0.7}
_SQL = f"""
w as (select lang as id, unnest({_TOK}) as token from documents where lang is not null),
c as (select id, token, count(*) as n, count(*) / sum(count(*)) over (partition by id) as p from w group by 1, 2),
k as (select *, row_number() over (partition by id order by p desc, token) as rank from c qualify rank <= {_OPTIONS['top_k']}),
t as (select *, coalesce(sum(p) over (partition by id order by rank rows between unbounded preceding and 1 preceding), 0) as before from k qualify before < {_OPTIONS['top_p']}),
h as (select id, token, rank, exp(ln(p) / {_OPTIONS['temperature']}) as w from t),
s as (select id, token, rank::int as rank, w / sum(w) over (partition by id) as weight from h)"""


def _candidates(docs):
    words = docs.filter("lang is not null").select(F.col("lang").alias("id"), F.explode(tokens.plain_tokens(F.col("text"))).alias("token"))
    counted = words.groupBy("id", "token").agg(F.count("*").alias("n"))
    total = counted.groupBy("id").agg(F.sum("n").alias("total"))
    return counted.join(total, "id").select("id", "token", (F.col("n") / F.col("total")).alias("p"))


@query(f"with {_SQL} select id, token, rank, round(weight, 9) as weight from s")
def lm_kept_tokens(spark, d):
    found = sampling.kept(_candidates(_read(spark, d, "documents")), **_OPTIONS)
    return found.select("id", "token", "rank", F.round("weight", 9).alias("weight"))


@query(f"""with {_SQL}, u as (select *, sum(weight) over (partition by id order by rank) as upto from s),
q as (select lang as id, doc_id as draw, ('0x' || substr(md5(lang || '#' || doc_id || '#seed'), 1, 8))::bigint / 4294967296.0::double as r from documents where lang is not null and doc_id is not null)
select q.id, draw, coalesce(arg_min(token, rank) filter (r < upto), arg_min(token, rank)) as token from q join u on u.id = q.id group by q.id, draw""")
def lm_sampled_tokens(spark, d):
    """One word for each document, from the words of its language."""
    docs = _read(spark, d, "documents")
    draws = docs.filter("lang is not null and doc_id is not null").select(F.col("lang").alias("id"), F.col("doc_id").alias("draw"))
    return sampling.sampled(_candidates(docs), draws, "seed", **_OPTIONS)
