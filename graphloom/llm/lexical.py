"""Operator 11: ranked lexical search, as a blocked sparse product of an item-term and a term-document matrix."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import cut, give_back, table

#: Documents of one block of the term-document matrix, at most.
BLOCK_DOCS = 2048
#: Text of the items that are searched for at once; more items take more passes over the documents.
BLOCK_BYTES = 4 << 20
#: Tasks of the first step that joins the best rows of tasks, for each item.
SPREAD = 64

#: Letters of either case, digits and all bytes beyond ASCII make terms; A-Z is lower-cased, all else parts.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_INTS, _LONGS = pa.list_(pa.int32()), pa.list_(pa.int64())
_MATRIX = pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64()), ("docs", _LONGS), ("sizes", _LONGS), ("terms", _INTS), ("counts", _INTS), ("rows", _INTS), ("tfs", _INTS)])
MATRIX = "n_docs long, n_terms long, docs array<long>, sizes array<long>, terms array<int>, counts array<int>, rows array<int>, tfs array<int>"
BEST = "item int, doc_id long, score long"
FOUND = "item_id long, rank int, doc_id long, score long"


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text, in order; null has none."""
    return text.translate(_TABLE).split() if text else []


def _matrix(words, batches):
    """A block of the term-document matrix from each ``BLOCK_DOCS`` documents, by columns of the terms of ``words`` alone."""
    get = words.value.get
    for whole in batches:
        for lo in range(0, whole.num_rows, BLOCK_DOCS):
            batch = whole.slice(lo, BLOCK_DOCS)
            ids, found, sizes, n_hit = batch.column(0).to_pylist(), [], [], []
            for text in batch.column(1).cast(pa.binary()):
                own = terms(text.as_py())
                hit = list(filter(None, map(get, own)))
                sizes.append(len(own))
                n_hit.append(len(hit))
                found += hit
            doc = np.repeat(np.arange(len(ids), dtype=np.int64), n_hit)
            keys, tf = np.unique((np.array(found, dtype=np.int64) << 32) | doc, return_counts=True)
            term, doc = keys >> 32, keys & 0xFFFFFFFF
            kept, row = np.unique(doc, return_inverse=True)
            which, count = np.unique(term, return_counts=True)
            size = np.array(sizes, dtype=np.int64)
            yield pa.RecordBatch.from_pylist(
                [{"n_docs": int((size > 0).sum()), "n_terms": int(size.sum()), "docs": [ids[i] for i in kept.tolist()], "sizes": size[kept], "terms": which, "counts": count, "rows": row.ravel(), "tfs": tf}],
                schema=_MATRIX,
            )
    give_back()


def best_of(score: np.ndarray, ids: np.ndarray, none: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, of equal ones those with the smallest ids, rows without an id last."""
    if len(score) > 4 * k:  # no need to sort those below the k-th
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
        return some[np.lexsort((ids[some], none[some], -score[some]))[:k]]
    return np.lexsort((ids, none, -score))[:k]


def merge_rows(places: list[tuple[int, int, int]], rows: np.ndarray, impacts: np.ndarray, out: np.ndarray) -> np.ndarray:
    """One row of the product by Gustavson: the rows of the term-document matrix that the item's terms name, times their
    multiplicities, merged in the dense accumulator ``out``. A row names each document once."""
    for lo, hi, times in places:
        out[rows[lo:hi]] += times * impacts[lo:hi]
    return out


def _products(query, batches):
    """The best rows of each item over a task's blocks."""
    items, weights, n_docs, n_terms, k = query.value
    kept = {}
    for batch in batches:
        for block in range(batch.num_rows):
            docs, size, term, count, rows, tf = (batch.column(c)[block].values for c in range(6))
            if not len(docs):
                continue
            none = docs.is_null().to_numpy(zero_copy_only=False)
            ids = docs.fill_null(0).to_numpy(zero_copy_only=False)
            size, term, count, rows, tf = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (size, term, count, rows, tf))
            m = 10 + (90 * size * n_docs) // n_terms
            impacts = np.repeat(weights[term], count) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[rows]))
            ends = np.cumsum(count)
            at = {t: (a, b) for t, a, b in zip(term.tolist(), (ends - count).tolist(), ends.tolist())}
            out = np.zeros(len(ids), dtype=np.int64)
            for item, wanted in enumerate(items):
                places = [(*at[t], times) for t, times in wanted if t in at]
                if not places:
                    continue
                out[:] = 0
                merge_rows(places, rows, impacts, out)
                hit = np.flatnonzero(out > 0)
                new = (out[hit], ids[hit], none[hit])
                if item in kept:
                    new = tuple(map(np.concatenate, zip(kept[item], new)))
                top = best_of(*new, k)
                kept[item] = tuple(x[top] for x in new)
    for item, (score, ids, none) in kept.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item, np.int32)), pa.array(ids, pa.int64(), mask=none), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])
    give_back()


def _wanted(rows: list, once: bool) -> tuple[list, dict, list]:
    """Item ids, a number from 1 for each term, and each item's (term, multiplicity) pairs. Rows of one id are one item."""
    own, words = {}, {}
    for item, text in rows:
        counts = own.setdefault(item, {})
        for t in terms(None if text is None else text.encode()):
            n = words.setdefault(t, len(words) + 1)
            counts[n] = 1 if once else counts.get(n, 0) + 1
    return list(own), words, [sorted(c.items()) for c in own.values()]


def search(docs: DataFrame, items: DataFrame, k: int = 10, once: bool = True) -> DataFrame:
    """item_id, rank (from 1, unique, highest score first), doc_id and score of each item's ``k`` best documents.

    ``docs`` has doc_id (long) and text, ``items`` item_id (long) and text; other columns are ignored, whatever their names. A
    score sums the impacts of the item's terms, each once or, with ``once=False``, as often as the item holds it; only scores above 0
    count, and equal ones are ranked by doc_id, without one last. Null and empty texts have no terms, and nothing is found for
    them. Repeated document rows are ranked each; item rows with one id are one item, also without an id. Empty tables give none.
    Sums are 64-bit: 90 times the documents times one document's terms has to stay below 2 ** 63.

    The documents are read once for each ``BLOCK_BYTES`` of item texts: to blocks of term counts, with the totals that weights
    need; then each block is multiplied by the items' matrix, and a task keeps ``k`` rows an item. What is broadcast, terms and
    weights of a block of items, is bounded by ``BLOCK_BYTES``, except that one item is never split.
    """
    spark = docs.sparkSession
    items, docs = items.select("item_id", "text"), docs.select("doc_id", "text")
    size = items.agg(F.sum(F.octet_length("text") + 1).alias("n")).first().n or 0
    parts = -(-size // BLOCK_BYTES)
    found = spark.createDataFrame([], FOUND)
    for part in range(parts):
        some = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()
        names, words, wanted = _wanted([(r.item_id, r.text) for r in some], once)
        if not words:
            continue
        sent = spark.sparkContext.broadcast(words)
        blocks = cut(docs.mapInArrow(lambda b, sent=sent: _matrix(sent, b), MATRIX), "matrix")
        n_docs, n_terms = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not n_terms:
            continue
        pairs = blocks.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("df"))
        weights = np.zeros(len(words) + 1, dtype=np.int64)
        for r in pairs.collect():
            weights[r.terms] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1)))
        query = spark.sparkContext.broadcast((wanted, weights, n_docs, n_terms, k))
        best = blocks.select("docs", "sizes", "terms", "counts", "rows", "tfs").mapInArrow(lambda b, query=query: _products(query, b), BEST)
        found = found.unionByName(_ranked(best, names, k))
    return found


def _ranked(best: DataFrame, names: list, k: int) -> DataFrame:
    """The best rows of all tasks: first among some of the tasks, then among those that are left."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = best.withColumn("salt", F.spark_partition_id() % SPREAD).withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).filter(F.col("rank") <= k)
    last = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    named = best.sparkSession.createDataFrame(list(enumerate(names)), "item int, item_id long")
    return last.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP11_SQL = f"""
with d as (select row_number() over () as row, doc_id, {_WORDS} as words from documents),
sums as (select count(*) filter (len(words) > 0) as n_docs, sum(len(words))::bigint as n_terms from d),
tf as (select row, doc_id, len(words) as n, unnest(words) as term from d),
x as (select row, any_value(doc_id) as doc_id, term, any_value(n) as n, count(*) as tf from tf group by row, term),
df as (select term, count(*) as df from x group by term),
q as (select distinct item_id, term from (select item_id, unnest({_WORDS}) as term from benchmark)),
s as (
  select item_id, row, any_value(doc_id) as doc_id,
    sum(floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double))::bigint * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::bigint as score
  from q join x using (term) join df using (term), sums group by item_id, row)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from s where score > 0 qualify rank <= 10
"""
