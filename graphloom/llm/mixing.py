"""Operator 9: temperature mixing of sources to target weights, realised as budgeted block permutations."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import cut, drop_cut, table

#: Documents of a block, on average, and blocks that are summed in one window.
BLOCK_DOCS, RUN = 2048, 2048
#: The largest exponent that is tried.
STEEPEST = 64.0
#: A pass over the sources tries all the exponents that so many halvings can reach; the interval is halved so often in all.
HALVINGS, PASSES = 4, 8

ADDED = ("mix_tokens", "epoch", "block", "place")


class Mixture(NamedTuple):
    """What was chosen: the exponent, the weights' entropy, and the tokens that are dealt out."""

    exponent: float
    entropy: float
    budget: float


def count_tokens(text) -> F.Column:
    """Runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def _tried(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float, float, float]]:
    """(sum of the powers, entropy, largest and smallest weight over share) for each exponent, in one pass. Shares are powers of
    their part of the largest, so that nothing underflows."""
    q, p = F.col("part_of_largest"), F.col("share")
    asked = []
    for i, a in enumerate(exponents):
        power = F.pow(q, F.lit(a))
        asked += [F.sum(power).alias(f"z{i}"), F.sum(power * F.log(q)).alias(f"e{i}"), F.max(power / p).alias(f"m{i}"), F.min(power / p).alias(f"l{i}")]
    got = shares.agg(*asked).first()
    out = []
    for i, a in enumerate(exponents):
        z = got[f"z{i}"]
        out.append((z, math.log(z) - a * got[f"e{i}"] / z, got[f"m{i}"] / z, got[f"l{i}"] / z))
    return out


def _bisected(shares: DataFrame, lo: float, hi: float, holds: Callable) -> float:
    """The smallest exponent from ``lo`` to ``hi`` at which ``holds``, which stays true once it is; ``hi`` if it never is."""
    if holds(*_tried(shares, [lo])[0]):
        return lo
    parts = 1 << HALVINGS
    for _ in range(PASSES):
        inner = [lo + (hi - lo) * i / parts for i in range(1, parts)]
        true = [a for a, t in zip(inner, _tried(shares, inner)) if holds(*t)]
        lo, hi = (max(lo, true[0] - (hi - lo) / parts), true[0]) if true else (inner[-1], hi)
    return hi


def choose(shares: DataFrame, total: int, budget: float | None, entropy: float | None, repeats: float | None) -> Mixture:
    """The exponent and the budget for sources' shares.

    The exponent is the smallest from 0 on at which the weights' entropy is at most ``entropy`` (at most ``STEEPEST``, where ties
    of the largest sources leave it no way down). It is then raised, to 1 at most, until no source is read more than ``repeats``
    times. Where that is not enough, as with more than ``repeats`` times the corpus or with weights steeper than the shares, the
    budget is lowered instead: the limit always holds. Without a budget it is the smallest that takes every source once whole.
    """
    if repeats is not None and repeats < (1 if budget is None else 0):
        raise ValueError("a limit on repeats under 1 needs a budget, and one under 0 has no meaning")
    a = 0.0 if entropy is None else _bisected(shares, 0.0, STEEPEST, lambda z, h, most, least: h <= entropy + 1e-12)
    spent = lambda least: total / least / total if budget is None else budget / total  # in times of the corpus
    if repeats is not None and a < 1:
        a = _bisected(shares, a, 1.0, lambda z, h, most, least: spent(least) * most <= repeats + 1e-12)
    _, h, most, least = _tried(shares, [a])[0]
    times = spent(least)
    if repeats is not None:
        times = min(times, repeats / most)
    return Mixture(a, h, times * total)


def mix(docs: DataFrame, budget: float | None = None, entropy: float | None = None, repeats: float | None = 4.0, seed: int = 0) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, source, others) as often as the mixture takes them, with mix_tokens, epoch, block and place.

    Sources' token shares are raised to the exponent of ``choose`` and normalised; a source's part of the chosen budget is its
    weight's. It gives all its documents in each full epoch, and in the last one whole blocks of a permutation, then documents of
    the next block, up to the first that would exceed its part: no source gives more, and none gives less by a document or more.
    Sorted by epoch, block and place, the rows are that permutation.

    Documents without tokens cost nothing; a source that has only those gives each once. A null source is a source; repeated
    rows count each, and of equal rows at the end of a part as many are taken as fit. An empty table gives an empty one.
    Columns named like the added ones are replaced; no other name clashes. Sources may be of any size: token counts are written
    once, sums run over blocks and runs of blocks, and only a source's last block is counted document by document.
    """
    own = [c for c in docs.columns if c not in ADDED]
    quoted = [F.col(f"`{c}`") for c in own]
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name in own and "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    packed = docs.select(F.struct(*quoted).alias("r"), F.struct("source").alias("s"), F.xxhash64(*plain).alias("id"), count_tokens(F.col("text")).alias("t"))
    slim = cut(packed.select("s", "id", "t"), "tokens")
    plan = cut(_plan(slim, budget, entropy, repeats), "plan")
    ends = cut(_ends(slim, plan, seed), "ends")
    drop_cut(slim)

    placed = packed.join(plan.select("s", "full", "blocks"), "s")  # a null source is equal to itself within a struct
    placed = placed.join(ends, "s", "left")
    here = F.struct(_block(seed, F.col("full")).alias("block"), _place(seed, F.col("full")).alias("place"), F.col("id"))
    more = F.coalesce(here < F.col("edge"), F.lit(False))
    times = F.col("full") + more.cast("int")
    taken = placed.withColumn("times", times).filter("times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    # of the equal rows that the part ends within, as many as fit
    within = placed.filter((here == F.col("edge")) & (F.col("copies") > 0)).groupBy("s", "id").agg(F.first(F.struct("r", "t", "full", "blocks", "copies")).alias("x"))
    within = within.select("id", "x.r", "x.t", "x.blocks", F.col("x.full").alias("epoch"), F.explode(F.sequence(F.lit(1), F.col("x.copies"))))
    both = taken.select("id", "r", "t", "blocks", "epoch").unionByName(within.select("id", "r", "t", "blocks", "epoch"))
    return both.select("r.*", F.col("t").alias("mix_tokens"), "epoch", _block(seed, F.col("epoch")).alias("block"), _place(seed, F.col("epoch")).alias("place"))


def _block(seed: int, epoch) -> F.Column:
    return F.pmod(F.xxhash64(F.lit(seed), epoch.cast("int"), "id"), F.col("blocks"))


def _place(seed: int, epoch) -> F.Column:
    return F.xxhash64(F.lit(seed + 1), epoch.cast("int"), "id")


def _plan(slim: DataFrame, budget: float | None, entropy: float | None, repeats: float | None) -> DataFrame:
    """s, full (whole epochs), left (tokens of the last, partial one) and blocks of each source."""
    stats = cut(slim.groupBy("s").agg(F.sum("t").alias("tokens"), F.count("*").alias("docs")), "sources")
    all_of = stats.agg(F.sum("tokens").alias("total"), F.max("tokens").alias("largest")).first()
    total = all_of.total or 0
    part = F.lit(0.0)
    if total:
        share = F.col("tokens") / F.lit(float(total))
        shares = stats.filter("tokens > 0").select(share.alias("share"), (F.col("tokens") / F.lit(float(all_of.largest))).alias("part_of_largest"))
        chosen = choose(shares, total, budget, entropy, repeats)
        z = _tried(shares, [chosen.exponent])[0][0]
        part = F.lit(float(chosen.budget)) * F.pow(F.col("tokens") / F.lit(float(all_of.largest)), F.lit(chosen.exponent)) / F.lit(z)
    some = F.greatest("tokens", F.lit(1))  # a source without tokens has no part
    times = part / some
    # rounding must neither take a document from a source that is taken whole nor add one
    part = F.when(F.abs(times - F.round(times)) < 1e-6, F.round(times) * F.col("tokens")).otherwise(part)
    full = F.when(F.col("tokens") > 0, F.floor(part / some)).otherwise(F.lit(1))
    left = F.when(F.col("tokens") > 0, part - F.floor(part / some) * F.col("tokens")).otherwise(F.lit(0.0))
    return stats.select("s", full.cast("int").alias("full"), F.floor(left + F.lit(1e-6)).cast("long").alias("left"), F.ceil(F.col("docs") / F.lit(BLOCK_DOCS)).cast("long").alias("blocks"))


def _ends(slim: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """s, edge (block, place, id) and copies: the first documents of the last epoch that do not all fit, and how many of them do.

    The block is found by runs of blocks, each of ``RUN`` times fewer: a window holds a run's blocks or a block's documents."""
    some = plan.filter("left > 0")
    last = slim.join(some, "s").select("s", "id", "t", "left", "blocks", _block(seed, F.col("full")).alias("block"), _place(seed, F.col("full")).alias("place"))
    most = some.agg(F.max("blocks")).first()[0] or 1
    width = 1
    while most > width * RUN:
        width *= RUN
    found = some.select("s", F.lit(0).cast("long").alias("first"), F.lit(most).cast("long").alias("past"), F.lit(0).cast("long").alias("before"), "left")
    while width:
        inside = last.drop("left").join(found, "s").filter("block >= first and block < past").select("s", "t", F.floor(F.col("block") / F.lit(width)).cast("long").alias("run"), "before", "left")
        sums = inside.groupBy("s", "run").agg(F.sum("t").alias("t"), F.first("before").alias("before"), F.first("left").alias("left"))
        upto = F.sum("t").over(Window.partitionBy("s").orderBy("run"))
        sums = sums.withColumn("upto", F.col("before") + upto)
        # the first run that does not fit whole
        found = sums.filter("upto > left").groupBy("s").agg(F.min(F.struct("run", (F.col("upto") - F.col("t")).alias("before"), "left")).alias("x"))
        found = cut(found.select("s", (F.col("x.run") * width).alias("first"), ((F.col("x.run") + 1) * width).alias("past"), "x.before", "x.left"), "runs")
        width //= RUN
    inner = last.drop("left").join(found, "s").filter("block = first")
    equal = inner.groupBy("s", "block", "place", "id").agg(F.count("*").alias("n"), F.first("t").alias("t"), F.first("before").alias("before"), F.first("left").alias("left"))
    upto = F.sum(F.col("n") * F.col("t")).over(Window.partitionBy("s").orderBy("place", "id"))
    equal = equal.withColumn("given", F.col("before") + upto - F.col("n") * F.col("t")).filter("given + n * t > left")
    first = equal.groupBy("s").agg(F.min(F.struct("place", "id", "block", F.floor((F.col("left") - F.col("given")) / F.greatest("t", F.lit(1))).cast("int").alias("copies"))).alias("x"))
    return first.select("s", F.struct("x.block", "x.place", "x.id").alias("edge"), "x.copies")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus' own number of tokens, mixed as evenly as four passes over any source allow, up to 0.97 of the full entropy."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    sizes = docs.groupBy("source").agg(F.sum(count_tokens(F.col("text"))).alias("t")).filter("t > 0").agg(F.count("*").alias("n"), F.sum("t").alias("t")).first()
    mixed = mix(docs, budget=sizes.t or 0, entropy=0.97 * math.log(max(sizes.n, 1)), repeats=4.0)
    return mixed.select("doc_id", "source", F.col("mix_tokens").alias("n_tokens"), "epoch", "block", "place")
