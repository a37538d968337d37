"""Similar vectors by cosine."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, norm

#: Bytes of query vectors that are broadcast; more of them are gone through in blocks.
BROADCAST_BYTES = 32 << 20
#: Vectors and queries whose product is made at once.
ROWS, ASKED = 1024, 2048
#: What a matrix product may be off by, with the rounding to 9 digits.
_OFF = 1e-8


def rounded(x: np.ndarray) -> np.ndarray:
    """Numbers at 9 digits, halves away from zero, as SQL rounds what they are written as."""
    at = x * 1e9
    out = np.rint(at) / 1e9
    for i in np.flatnonzero(np.abs(np.abs(at - np.floor(at)) - 0.5) < 1e-4):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("1e-9"), ROUND_HALF_UP))
    return out


def _sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The products of two tables' rows, summed in order, as ``functions.vectors.dot`` does."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


class _Best:
    """The ``k`` best of the vectors seen so far for each of some queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, least: float | None):
        self.ids, self.k, self.least = ids, k, least
        self.q, self.n = vectors, np.sqrt(_sums(vectors, vectors))
        self.unit = (vectors / np.where(self.n > 0, self.n, 1)[:, None]).T
        self.rows = (np.zeros(0, int), np.zeros(0), None)  # query, similarity, id; the best first
        self.limit = np.full(len(ids), -np.inf if least is None else least)

    def add(self, ids: np.ndarray, v: np.ndarray, n: np.ndarray, unit: np.ndarray) -> None:
        near = unit @ self.unit
        limit = self.limit
        if len(ids) > self.k + 1 and np.isneginf(limit).any():  # one more, as one may be the query itself
            limit = np.maximum(limit, np.partition(near, len(ids) - self.k - 1, axis=0)[len(ids) - self.k - 1])
        r, c = np.nonzero(near >= limit - _OFF)
        keep = ids[r] != self.ids[c]
        r, c = r[keep], c[keep]
        if not len(r):
            return
        size, s = n[r] * self.n[c], np.empty(len(r))
        for lo in range(0, len(r), 1 << 16):
            some = slice(lo, lo + (1 << 16))
            s[some] = _sums(v[r[some]], self.q[c[some]])
        s = rounded(np.where(size > 0, s / np.where(size > 0, size, 1), 0.0))
        if self.least is not None:
            keep = s >= self.least
            r, c, s = r[keep], c[keep], s[keep]
        old_c, old_s, old_i = self.rows
        c, s, i = np.concatenate([old_c, c]), np.concatenate([old_s, s]), ids[r] if old_i is None else np.concatenate([old_i, ids[r]])
        order = np.lexsort((i, -s, c))
        c, s, i = c[order], s[order], i[order]
        starts = np.searchsorted(c, np.arange(len(self.ids)))
        keep = np.arange(len(c)) - starts[c] < self.k
        self.rows = c[keep], s[keep], i[keep]
        counts = np.bincount(self.rows[0], minlength=len(self.ids))
        full = np.flatnonzero(counts == self.k)
        self.limit[full] = self.rows[1][np.cumsum(counts)[full] - 1]


def _plain(ids) -> np.ndarray:
    out = np.asarray(ids)
    return out.astype(str) if out.dtype == object else out


def _products(queries: DataFrame, vectors: DataFrame, k: int, least: float | None) -> DataFrame:
    """The best of each task's vectors to each of ``queries``, which go to the executors. All have one length and finite norms."""
    rows = queries.collect()
    asked = _plain([r.query_id for r in rows]), np.array([r.q for r in rows], float).reshape(len(rows), -1)
    sent = queries.sparkSession.sparkContext.broadcast(asked)
    kinds = {f.name: f.dataType.simpleString() for f in [*queries.schema, *vectors.schema]}

    def best(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, m = sent.value
        blocks = [_Best(q[lo : lo + ASKED], m[lo : lo + ASKED], k, least) for lo in range(0, len(q), ASKED)]
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                some = batch.iloc[lo : lo + ROWS].sort_values("id")
                ids, v = _plain(some["id"].to_numpy()), np.array(some["vector"].tolist(), float) + 0.0
                same = pd.Series([x.tobytes() for x in v])
                few = (same.groupby(same).cumcount() <= k).to_numpy()  # of equal vectors those of the smallest ids
                ids, v = ids[few], v[few]
                n = np.sqrt(_sums(v, v))
                unit = v / np.where(n > 0, n, 1)[:, None]
                for b in blocks:
                    b.add(ids, v, n, unit)
        for b in blocks:
            c, s, i = b.rows
            if len(c):
                yield pd.DataFrame({"query_id": b.ids[c], "id": i, "similarity": s})

    return vectors.mapInPandas(best, f"query_id {kinds['query_id']}, id {kinds['id']}, similarity double")


def top_similar(queries: DataFrame, vectors: DataFrame, k: int = 5, least: float | None = None) -> DataFrame:
    """query_id, id, similarity, rank: the ``k`` most similar of ``vectors`` (id, vector) to each stated query (query_id, vector), of at
    least a similarity if one is given.

    Every query is compared with every vector, by products of matrices in tasks that keep the best of their vectors before anything
    moves; what is close to the best is computed again as ``cosine`` does, so results are exact. The queries are counted first: blocks of
    them are broadcast. Vectors that are null, hold null, not finite or extreme numbers, or have another length, go row by row.
    """
    spark = vectors.sparkSession
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("d")).first()
    blocks = max(1, -(-size.n * max(size.d, 1) * 8 // BROADCAST_BYTES))
    q = queries.select("query_id", F.col("vector").alias("q")).filter("query_id is not null")
    v = vectors.select("id", "vector").filter("id is not null")
    n = lambda c: norm(F.col(c))
    fit = lambda c: F.coalesce((F.size(c) == size.d) & (F.size(c) > 0) & ((n(c) == 0) | n(c).between(1e-100, 1e100)), F.lit(False))
    known = v.filter(fit("vector")).repartition(2 * spark.sparkContext.defaultParallelism)
    some = lambda b: q if blocks == 1 else q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
    best = None
    for b in range(blocks):
        odd = [(some(b).filter(~fit("q")), v), (some(b).filter(fit("q")), v.filter(~fit("vector")))]
        scored = [a.join(F.broadcast(c), F.col("id") != F.col("query_id")).select("query_id", "id", F.round(cosine(F.col("q"), F.col("vector")), 9).alias("similarity")) for c, a in odd]
        for found in [_products(some(b).filter(fit("q")), known, k, least), *scored]:
            best = found if best is None else best.unionByName(found)
    if least is not None:
        best = best.filter(F.col("similarity") >= least)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
