"""Operator 5: near-duplicate vectors by product quantisation: inverted lists, residual codes, table look-ups, exact rerank.

By default the search loses nothing. Vectors are scaled to unit length, so a cosine bound is a bound on the distance. A vector
probes every list whose border with its own list is within that distance, and the error of each code is kept, so that a look-up
distance can only rule out vectors that are too far away. What remains is compared by cosine in double precision. Of two lists
only the vectors of the first ask the second. Where the vectors of a label have no structure that lists can follow, borders are
near and most lists are probed: then the work grows with the square of a label's vectors. With ``probes`` a vector asks only that
many of its nearest lists, whose number grows with the vectors; links that cross other borders are lost.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .tables import cut, table

#: Vectors that the lists and codes are fitted on, at most: those with the smallest hashes.
SAMPLE = 16_384
#: Coarse lists, at least; subspaces and codes of each subspace, at most. With a number of probes there are more lists: the square
#: root of the number of vectors, while the sample has ``PER_LIST`` vectors for each.
LISTS, PARTS, CODES, PER_LIST = 64, 8, 256, 16
#: Lists that a vector of the stated query asks.
PROBES = 16
#: Vectors and queries of a block; larger lists are split into several.
BLOCK, QUERIES = 2048, 2048
_SLACK = 1e-6


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 12) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        home = _nearest(x, c)
        n = np.bincount(home, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():
            c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), dtype=np.int64)
    for at in range(0, len(x), 8192):
        out[at : at + 8192] = ((c * c).sum(1) - 2 * x[at : at + 8192] @ c.T).argmin(1)
    return out


class Quantiser:
    """Coarse centroids and the code books of the residuals, fitted on unit vectors."""

    def __init__(self, sample: np.ndarray, cosine: float, lists: int = LISTS, asks: int | None = None, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.asks = asks
        self.reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + _SLACK
        self.lists = _kmeans(sample, lists, rng)
        self.edges = np.array_split(np.arange(sample.shape[1]), min(PARTS, sample.shape[1]))
        rest = sample - self.lists[_nearest(sample, self.lists)]
        self.books = [_kmeans(np.ascontiguousarray(rest[:, e]), CODES, rng) for e in self.edges]
        self.between = np.sqrt(np.maximum(((self.lists[:, None] - self.lists[None]) ** 2).sum(-1), 1e-300))

    def encode(self, x: np.ndarray):
        """List, codes and the distance between vector and code of each row."""
        home = _nearest(x, self.lists)
        rest = x - self.lists[home]
        codes = np.stack([_nearest(np.ascontiguousarray(rest[:, e]), b) for e, b in zip(self.edges, self.books)], axis=1).astype(np.uint8)
        error = np.sqrt(sum(((rest[:, e] - b[codes[:, i]]) ** 2).sum(1) for i, (e, b) in enumerate(zip(self.edges, self.books))))
        return home, codes, error

    def probes(self, x: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Row and list of each list that x asks: its own, and later ones that may hold a vector within reach, as x is not further
        than that from the lists' border. With a number of asks, the nearest of those, earlier ones too."""
        d = ((x * x).sum(1)[:, None] - 2 * x @ self.lists.T) + (self.lists**2).sum(1)
        to_border = (d - d[np.arange(len(x)), home][:, None]) / (2 * self.between[home])
        near = to_border <= self.reach
        if self.asks is None:
            near &= np.arange(len(self.lists)) > home[:, None]
        elif self.asks < near.shape[1]:
            near &= to_border <= np.partition(to_border, self.asks - 1, axis=1)[:, self.asks - 1 : self.asks]
        near[np.arange(len(x)), home] = True
        return np.argwhere(near)

    def look_up(self, q: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances from each query to each code of list ``at``: a table for each subspace, then sums of look-ups."""
        rest = q - self.lists[at]
        out = np.zeros((len(q), len(codes)), dtype=np.float64)
        for i, (e, b) in enumerate(zip(self.edges, self.books)):
            part = rest[:, e]
            out += ((part * part).sum(1)[:, None] - 2 * part @ b.T + (b * b).sum(1))[:, codes[:, i]]
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # else squares of very small or large components leave the range
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _assign(model):
    def run(batches):
        q = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                x = _unit(_matrix(some.column("embedding")))
                home, codes, error = q.encode(x)
                probes = q.probes(x, home)
                row = np.concatenate([np.arange(len(x)), probes[:, 0]])
                kept = some.take(pa.array(row)).select(["uid", "label", "times", "embedding"])
                code = pa.array([c.tobytes() for c in codes] + [None] * len(probes), pa.binary())
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.concatenate([home, probes[:, 1]]), pa.int32()), code, pa.array(np.concatenate([error, np.where((probes[:, 1] == home[probes[:, 0]]) | (q.asks is not None), 0.0, 1.0)]))], names=["uid", "label", "times", "embedding", "list", "code", "error"])

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(node, root) of the nodes of edges (a, b) that are not roots: as connected as the edges, but one row for each node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    off = root != np.arange(len(nodes))
    return np.stack([nodes[off], nodes[root[off]]], axis=1)


def _search(model, cosine: float):
    def run(table: pa.Table) -> pa.Table:
        q = model.value
        table = table.combine_chunks()
        is_db = table.column("code").is_valid()
        db, ask = table.filter(is_db), table.filter(pa.compute.invert(is_db))
        uid, link, edges = [], [], []
        if db.num_rows and ask.num_rows:
            one = lambda t, c: t.column(c).combine_chunks() if isinstance(t.column(c), pa.ChunkedArray) else t.column(c)
            raw_d, raw_q = _unit(_matrix(one(db, "embedding"))), _unit(_matrix(one(ask, "embedding")))
            codes = np.frombuffer(b"".join(one(db, "code").to_pylist()), np.uint8).reshape(db.num_rows, -1)
            allowed = (q.reach + one(db, "error").to_numpy() + _SLACK) ** 2
            times, ids, asked = (one(db, "times").to_numpy(), one(db, "uid").to_numpy(), one(ask, "uid").to_numpy())
            many, back = one(ask, "times").to_numpy(), one(ask, "error").to_numpy() > 0  # these are not asked in return
            at = table.column("list")[0].as_py()
            for lo in range(0, len(asked), 512):
                i, j = np.nonzero(q.look_up(raw_q[lo : lo + 512], at, codes) <= allowed)
                i += lo
                keep = asked[i] != ids[j]
                i, j = i[keep], j[keep]
                cos = np.concatenate([np.einsum("ij,ij->i", raw_q[i[s : s + 65536]], raw_d[j[s : s + 65536]]) for s in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
                i, j = i[cos >= cosine], j[cos >= cosine]
                if len(i):
                    n = np.bincount(i, weights=times[j], minlength=len(asked))
                    uid.append(asked[n > 0])
                    link.append(n[n > 0].astype(np.int64))
                    edges.append(_forest(asked[i], ids[j]))
                    i, j = i[back[i]], j[back[i]]
                    n = np.bincount(j, weights=many[i], minlength=len(ids))
                    uid.append(ids[n > 0])
                    link.append(n[n > 0].astype(np.int64))
        uid = np.concatenate([np.zeros(0, np.int64), *uid])
        pairs = np.concatenate([np.zeros((0, 2), np.int64), *edges])
        return pa.table({"uid": pa.array(np.concatenate([uid, pairs[:, 0]]), pa.int64()), "links": pa.array(np.concatenate([np.zeros(0, np.int64), *link, np.zeros(len(pairs), np.int64)]), pa.int64()), "other": pa.concat_arrays([pa.nulls(len(uid), pa.int64()), pa.array(pairs[:, 1], pa.int64())])})

    return run


def find_links(distinct: DataFrame, cosine: float, probes: int | None = None) -> DataFrame:
    """(uid, links, other) for distinct vectors (uid, label, embedding, times) of one length: how many rows are linked to uid in
    one block of one list, or, with ``other``, an edge. The edges join what is linked, with at most a row for each vector of a block."""
    spark = distinct.sparkSession
    sample = distinct.orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).select("embedding").toArrow().column(0).combine_chunks()
    lists = LISTS if probes is None else max(LISTS, min(len(sample) // PER_LIST, math.isqrt(distinct.count())))
    model = spark.sparkContext.broadcast(Quantiser(_unit(_matrix(sample)), cosine, lists, probes))
    label = distinct.schema["label"].dataType.simpleString()
    spread = cut(distinct.select("uid", "label", "times", "embedding").mapInArrow(_assign(model), f"uid long, label {label}, times long, embedding array<{distinct.schema['embedding'].dataType.elementType.simpleString()}>, list int, code binary, error double"), "probes")
    sizes = spread.groupBy("label", "list").agg(F.ceil(F.count("code") / F.lit(BLOCK)).cast("int").alias("blocks"), F.ceil((F.count("*") - F.count("code")) / F.lit(QUERIES)).cast("int").alias("asks"))
    sizes = sizes.filter("blocks > 0 and asks > 0")
    sized = spread.join(sizes, ["label", "list"])
    turn = F.xxhash64(F.lit(3), "uid")
    db = sized.filter("code is not null").withColumn("block", F.pmod(turn, F.col("blocks"))).withColumn("ask", F.explode(F.sequence(F.lit(0).cast("long"), F.col("asks").cast("long") - 1)))
    ask = sized.filter("code is null").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1))).withColumn("ask", F.pmod(turn, F.col("asks")))
    return db.unionByName(ask).groupBy("label", "list", "block", "ask").applyInArrow(_search(model, cosine), "uid long, links long, other long")


def near_vectors(vectors: DataFrame, cosine: float = 0.93, probes: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of ``vectors`` (vec_id, embedding, label). With ``probes`` a vector asks at
    most so many lists: links are then lost, never invented.

    Rows are linked when their labels are equal and not null and their cosine is at least ``cosine``. Null, empty and zero
    vectors, those with null or non-finite components and those of another length link with nothing. Equal vectors are
    searched for once and count as many links as they have rows. Null and repeated ids are rows like others; a null id is never
    the smallest, and its row is kept if alone. An empty table gives an empty one. Other columns are ignored.
    """
    v = vectors.select("vec_id", "embedding", "label")
    fine = F.col("label").isNotNull() & F.coalesce(F.size("embedding") > 0, F.lit(False)) & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    v = v.withColumn("fine", fine)
    distinct = v.filter("fine").groupBy("label", "embedding").agg(F.count("*").alias("times"), F.min("vec_id").alias("least")).withColumn("uid", F.monotonically_increasing_id())
    distinct = cut(distinct, "vectors")
    found = None
    for row in distinct.select(F.size("embedding").alias("n")).distinct().toLocalIterator():
        one = find_links(distinct.filter(F.size("embedding") == row.n), cosine, probes)
        found = one if found is None else found.union(one)
    if found is None:
        return v.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = cut(found, "links")
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    roots = components(found.filter("other is not null"), "uid", "other")
    known = distinct.join(links, "uid", "left").join(roots, distinct["uid"] == roots["node"], "left").withColumn("root", F.coalesce("root", "uid"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(least, "root").select("label", "embedding", F.lit(True).alias("fine"), (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = v.join(known, ["label", "embedding", "fine"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With bounded probes; README has the recall, measured against the exact mode."""
    return near_vectors(table(spark, sf_dir, "embeddings"), probes=PROBES)


OP5_SQL = """
with recursive v as (select row_number() over () as r, vec_id, embedding::double[] as e, label,
    label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 as fine from embeddings),
l as (select x.r as a, y.r as b from v x join v y on x.label = y.label and len(x.e) = len(y.e) and x.r <> y.r where x.fine and y.fine and list_cosine_similarity(x.e, y.e) >= 0.93),
t as (select r as a, r as b from v union select t.a, l.b from t join l on t.b = l.a),
m as (select a, min(v.vec_id) as c from t join v on v.r = t.b group by a),
n as (select a, count(*) as n from l group by a)
select vec_id, coalesce(n.n, 0)::bigint as n_links, coalesce(m.c, vec_id) as component_id, coalesce(vec_id = coalesce(m.c, vec_id), true) as kept
from v left join n on n.a = v.r left join m on m.a = v.r
"""
