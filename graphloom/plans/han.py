"""Queries of the segmenter. The given tables have no Han text, so their words are written in Han characters, a letter for each of
a to z, and a sentence without the spaces between its words: what segmentation has to find again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import segment
from ..operators.extraction import spread
from ..operators.scratch import cut, small_batches
from .queries import query
from .star import _read

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HAN = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余"
#: Words of the dictionary: the most frequent ones of the documents, up to a length.
WORDS, LONGEST = 20_000, 16


def _latin_words(text):
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit("[a-z]+"), F.lit(0))


def _han_words(docs):
    """doc_id and the words of each document in Han characters."""
    return docs.select("doc_id", F.transform(_latin_words(F.col("text")), lambda w: F.translate(w, LOWER, HAN)).alias("tokens"))


def dictionary(docs):
    """word, n and a whole number for a weight, so that sums of weights are exact."""
    return _weights(segment.word_counts(docs.select(_latin_words(F.col("text")).alias("tokens")), longest=LONGEST, most=WORDS))


def _weights(counted):
    return counted.select(F.translate("word", LOWER, HAN).alias("word"), "n", F.floor(1000 * F.col("weight")).alias("weight"))


_SQL_WORDS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z]+')"
_SQL_HAN = f"'{LOWER}', '{HAN}'"


@query(f"""
with w as (select {_SQL_WORDS} as words from documents),
r as (select string_split(array_to_string(list_transform(words, lambda x: case when len(x) = 1 then 'S' else 'B' || repeat('M', len(x) - 2) || 'E' end), ''), '') as s, string_split(array_to_string(words, ''), '') as c from w where len(words) > 0),
x as (
  select 'start' as kind, '' as a, s[1] as b from r
  union all select 'follow', unnest(s[:-2]), unnest(s[2:]) from r
  union all select 'emit', unnest(s), translate(unnest(c), {_SQL_HAN}) from r)
select kind, a, b, count(*) as n from x group by kind, a, b""")
def cjk_model_counts(spark, d):
    return segment.state_counts(_han_words(_read(spark, d, "documents")))


def sentences(items):
    """item_id, sentence and its letters in Han characters, of sentences that have some."""
    parts = items.select("item_id", F.posexplode(F.split(F.translate("text", UPPER, LOWER), r"[.?!\n]+")).alias("sentence", "part"))
    return parts.select("item_id", "sentence", F.translate(F.regexp_replace("part", "[^a-z]+", ""), LOWER, HAN).alias("run")).filter("run <> ''")


@query(f"""
with recursive w as (select unnest({_SQL_WORDS}) as word from documents),
f as (select word, count(*) as n from w where len(word) <= {LONGEST} group by word order by n desc, word limit {WORDS}),
d as (select word, floor(1000 * ln(n / (select sum(n) from f)))::bigint as weight from f),
parts as (select item_id, string_split_regex(translate(text, '{UPPER}', '{LOWER}'), '[.?!\\n]+') as p from benchmark),
runs as (select item_id, i, regexp_replace(p[i + 1], '[^a-z]+', '', 'g') as run from (select item_id, p, unnest(range(len(p))) as i from parts)),
places as (select item_id, i, run, unnest(range(1, len(run) + 1)) as p from runs where run <> ''),
spans as (select *, unnest(range(1, least({LONGEST}, len(run) - p + 1) + 1)) as k from places),
known as (select item_id, i, p, k, substr(run, p, k) as word from spans),
ways as (
  select item_id, i, p, list({{'w': coalesce(weight, (select min(weight) from d)), 'k': k, 'word': word}}) as ways
  from known left join d using (word) where weight is not null or k = 1 group by item_id, i, p),
b(item_id, i, p, best) as (
  select item_id, i, len(run) + 1, [{{'s': 0::bigint, 'k': 0::bigint, 'path': ''}}] from runs where run <> ''
  union all
  select b.item_id, b.i, b.p - 1, list_prepend(list_sort(list_transform(ways, lambda x: {{'s': (x.w + best[x.k].s)::bigint, 'k': x.k::bigint, 'path': x.word || ' ' || best[x.k].path}}), 'DESC')[1], best)
  from b join ways on ways.item_id = b.item_id and ways.i = b.i and ways.p = b.p - 1)
select item_id, i::int as sentence, translate(trim(best[1].path), {_SQL_HAN}) as tokens, len(string_split(trim(best[1].path), ' '))::int as n_tokens from b where p = 1""")
def cjk_path_tokens(spark, d):
    cut = segment.segmenter(dictionary(_read(spark, d, "documents"))).column(F.col("run"), "MIX")
    found = sentences(_read(spark, d, "benchmark")).withColumn("words", cut)
    return found.select("item_id", "sentence", F.array_join("words", " ").alias("tokens"), F.size("words").alias("n_tokens"))


def recovered(docs, mode="DEFAULT"):
    """doc_id, its number of words, and the words that are found in it without its spaces, by dictionary and model of all documents.
    Texts are gone through twice: for the words that stand in them, which are written with their counts, and to be cut."""
    texts, letters = small_batches(spread(docs.select("doc_id", "text"))), F.lit("[A-Za-z]+")
    counted = segment.neighbour_counts(texts.select(F.regexp_extract_all("text", letters, F.lit(0)).alias("tokens")), fold=F.lower)
    words = cut(counted, "words")
    model = segment.model_of(segment.states_of(words.withColumn("word", F.translate("word", LOWER, HAN))))
    made = segment.segmenter(cut(_weights(segment.frequent(words, LONGEST, WORDS)), "dictionary"), model)
    run = F.translate(F.regexp_replace("text", "[^A-Za-z]+", ""), UPPER + LOWER, HAN + HAN)
    return texts.select("doc_id", F.coalesce(F.regexp_count("text", letters), F.lit(0)).alias("n_words"), made.column(run, mode).alias("tokens"))


@query()
def doc_cjk_tokens(spark, d):
    return recovered(_read(spark, d, "documents"))
