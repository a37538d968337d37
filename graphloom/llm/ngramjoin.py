"""Operator 3: exact join of documents whose shingle sets have a Jaccard similarity of 0.8 or more, in the Jaccard metric space.

Jaccard distance is a metric, so regions around pivots can be joined one by one. Unrelated texts all lie at distance 1 from each
other and from any text that could be a pivot; there the triangle inequality says nothing. So the first pivots are not texts but
single shingles. Each set is in the region of the rarest of its shingles, and its window of further regions are those of its
next rarest ones, as many as a set within the threshold can lack. Two linked sets share a region (the prefix bound on overlaps),
and in the first region they share both have enough shingles from there on, which bounds the size of a partner (``cap``).
Each set is first compared with one pivot, the set nearest to the core of its regions. What that joins needs no more comparing:
a region keeps only members that a member of another component can still be linked with. Regions that stay large are split
recursively with sets as pivots: a member is in the Voronoi region of its nearest pivot, and boundary members are replicated to
each pivot at most twice the threshold further away. Members within the threshold of a pivot are linked to it; of them only
those stay that the triangle inequality lets a member outside reach. Small regions are compared pair by pair. Every distance is
computed from whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shingles import set_id, steps
from .tables import cut, drop_cut, give_back, small_batches, table

#: Two sets are linked when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: A region of so many members or fewer is compared pair by pair.
LEAF = 64
#: Pivots of a region in the first, second, ... round of splitting; the last number holds from there on.
PIVOTS = (4, 16, 48)
#: A shingle in so many sets or more is common: rarer ones come before all common ones.
COMMON = 64
#: Sets whose shingles are sent to the index together, and shingles at which such a group ends early.
GROUP, GROUP_SHINGLES = 4096, 1 << 21
#: Shingles that a part of the index is meant to hold, so that its task's memory does not grow with the data.
PART_SHINGLES = 1 << 21

#: Of a shingle's hash the index keeps 48 bits; the low ones hold its class in replies.
_CLASS, _KEPT = np.uint64(7), ~np.uint64(0xFFFF)
_META = "doc_id long, n_shingles long, sid binary"
_OWNER = np.dtype("S12")
_REPLY = np.dtype([("sid", _OWNER), ("n", "<i4"), ("count", "<i4")])


def _meta(batches):
    for batch in batches:
        sizes, ids = [], []
        for _, sets in steps(batch, 1):
            sizes.extend(map(len, sets))
            ids.extend(set_id(s) if len(s) else None for s in sets)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), *batch.columns[2:]], names=["doc_id", "n_shingles", "sid", *batch.schema.names[2:]])


def set_table(docs: DataFrame, keep: tuple = ()) -> DataFrame:
    """doc_id, n_shingles, the set's id (null for an empty set) and the columns ``keep`` of each document; no shuffle."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", *keep)
    return small_batches(rows).mapInArrow(_meta, _META + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:]))


def _classes(df: np.ndarray) -> np.ndarray:
    """1 for a shingle of one set, 2 for two or three, and so on by powers of two, 7 from ``COMMON`` on."""
    return np.minimum(np.frexp(df.astype(np.float64))[1], 7).astype(np.uint64)


def _targets(sid: np.ndarray, targets: int) -> np.ndarray:
    return np.ascontiguousarray(sid).view("<u4")[::3].astype(np.int64) % targets


def _pack_replies(owners: np.ndarray, at: np.ndarray, e: np.ndarray, targets: int):
    """(target, blob) of shingles, with their class in the low bits, for the sets that hold them: ``at`` are places in ``owners``."""
    order = np.lexsort((e, at))
    at, e = at[order], e[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    heads = np.zeros(len(first), dtype=_REPLY)
    heads["sid"], heads["count"] = owners[at[first]], np.diff(np.append(first, len(at)))
    target = _targets(heads["sid"], targets)
    of_row = np.repeat(target, heads["count"])
    for t in np.unique(target):
        some = heads[target == t]
        yield int(t), np.int32(len(some)).tobytes() + some.tobytes() + e[of_row == t].astype("<u8").tobytes()


def _pack_postings(owners: np.ndarray, e: np.ndarray, at: np.ndarray) -> bytes:
    """The owners, then the steps from one shingle to the next, in as many bytes as the longest takes, then each shingle's owner."""
    held, place = np.unique(at, return_inverse=True)
    step = np.diff(e >> np.uint64(16), prepend=np.uint64(0))
    width = max(1, -(-int(step[1:].max(initial=0)).bit_length() // 8))
    steps = step[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    head = np.array([len(held), len(e), width], "<i4").tobytes() + step[:1].astype("<u8").tobytes()
    return head + owners[held].tobytes() + steps.tobytes() + place.astype("<u2").tobytes()


def _unpack_postings(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    held, n, width = np.frombuffer(blob, "<i4", 3).tolist()
    at = 20 + held * _OWNER.itemsize
    step = np.zeros((n, 8), np.uint8)
    step[0] = np.frombuffer(blob, np.uint8, 8, 12)
    step[1:, :width] = np.frombuffer(blob, np.uint8, (n - 1) * width, at).reshape(-1, width)
    place = np.frombuffer(blob, "<u2", n, at + (n - 1) * width)
    return np.frombuffer(blob, _OWNER, held, 20), np.cumsum(step.view("<u8").ravel(), dtype=np.uint64) << np.uint64(16), place


_ROWS = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])


def _rows(rows: list[tuple]):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_ROWS.types)], schema=_ROWS)


def _post(parts: int):
    """Sends the shingles of each group of documents to the part of the index that their hash falls in. Kind 0 holds the sets'
    ids, then (shingle, set) pairs; kind 1 is a shingle that is common within the group, told once without its sets;
    kind 2 is the reply for those sets, and the sizes of all sets, which the index passes on."""

    def send(sets: dict[bytes, np.ndarray]):
        if not sets:
            return
        owners = np.array(list(sets), dtype=_OWNER)
        sizes = np.array([len(s) for s in sets.values()])
        e = np.concatenate(list(sets.values())) & _KEPT
        at = np.repeat(np.arange(len(owners), dtype=np.uint16), sizes)
        order = np.argsort(e, kind="stable")
        e, at = e[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
        many = np.diff(np.append(first, len(e)))
        common = np.repeat(many >= COMMON, many)
        heads = np.zeros(len(owners), dtype=_REPLY)
        heads["sid"], heads["n"] = owners, sizes
        target, spread = _targets(owners, parts), int.from_bytes(next(iter(sets))[:4], "little")
        rows = [((int(t) * 7919 + spread) % parts, 2, np.array([t, (target == t).sum()], "<i4").tobytes() + heads[target == t].tobytes()) for t in np.unique(target)]
        if common.any():
            c = e[common]
            for t, blob in _pack_replies(owners, at[common], c | _CLASS, parts):
                rows.append(((t * 7919 + spread) % parts, 2, np.int32(t).tobytes() + blob))
            told = np.unique(c)
            part = (told >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            rows += [(int(p), 1, told[part == p].tobytes()) for p in np.unique(part)]
            e, at = e[~common], at[~common]
        part = (e >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)  # sorted, as e is
        cuts = np.searchsorted(part, np.arange(parts + 1))
        for p in range(parts):
            lo, hi = cuts[p], cuts[p + 1]
            if lo < hi:
                rows.append((p, 0, _pack_postings(owners, e[lo:hi], at[lo:hi])))
        yield _rows(rows)

    def run(batches):
        sets: dict[bytes, np.ndarray] = {}
        held = 0
        for batch in batches:
            for _, some in steps(batch, 0):
                for s in some:
                    if len(s):
                        held += len(s)
                        sets[set_id(s)] = s
                    if len(sets) >= GROUP or held >= GROUP_SHINGLES:
                        yield from send(sets)
                        sets, held = {}, 0
        yield from send(sets)
        sets.clear()
        give_back()

    return run


def _index(parts: int):
    """For the shingles of a part that more than one set holds: their class, told to each of these sets."""

    def run(batches):
        owners, places, shingles, told, held = [], [], [], [np.zeros(0, np.uint64)], 0
        for batch in batches:
            for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2)):
                blob = blob.as_buffer()
                if kind == 2:
                    yield _rows([(int(np.frombuffer(blob, np.int32, 1)[0]), 2, blob.slice(4).to_pybytes())])
                elif kind == 1:
                    told.append(np.frombuffer(blob, np.uint64).copy())
                else:
                    some, e, place = _unpack_postings(blob)
                    owners.append(some.copy())
                    shingles.append(e)
                    places.append(place.astype(np.uint32) + np.uint32(held))
                    held += len(some)
        if not shingles:
            return
        # a set may come from many groups, as its copies do
        owners, same = np.unique(np.concatenate(owners), return_inverse=True)
        e = np.concatenate(shingles)
        shingles = None
        at = same.astype(np.uint32)[np.concatenate(places)]
        places = None
        order = np.argsort(e)
        e, at = e[order], at[order]
        order = None
        told = np.unique(np.concatenate(told))
        twin = np.concatenate([e[1:] == e[:-1], [False]])
        twin[1:] |= twin[:-1].copy()
        known = told[np.minimum(np.searchsorted(told, e), len(told) - 1)] == e if len(told) else np.zeros(len(e), bool)
        keep = twin | known
        e, at, known = e[keep], at[keep], known[keep]
        order = np.lexsort((at, e))
        e, at, known = e[order], at[order], known[order]
        keep = np.concatenate([[True], (e[1:] != e[:-1]) | (at[1:] != at[:-1])]) if len(e) else np.zeros(0, bool)
        e, at, known = e[keep], at[keep], known[keep]
        if not len(e):
            return
        first = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
        many = np.diff(np.append(first, len(e)))
        kind = np.where(known, _CLASS, np.repeat(_classes(many), many))
        keep = kind > 1
        at, e = at[keep], (e | kind)[keep]
        twin = known = kind = None
        for t, blob in _pack_replies(owners, at, e, parts):
            yield _rows([(t, 2, blob)])
        owners = at = e = None
        give_back()

    return run


_SETS = pa.schema([("sid", pa.binary()), ("n", pa.int64()), ("shared", pa.binary()), ("regions", pa.list_(pa.int64()))])


def _gather(batches):
    """The sets of which enough shingles occur in other sets: their shared shingles, and the regions they belong to."""
    heads, shingles = [], []
    for batch in batches:
        for blob in batch.column(2).to_pylist():
            n = int(np.frombuffer(blob, np.int32, 1)[0])
            head = np.frombuffer(blob, _REPLY, n, 4)
            heads.append(head)
            shingles.append(np.frombuffer(blob, np.uint64, offset=4 + n * _REPLY.itemsize))
    if not heads:
        return
    head, e = np.concatenate(heads), np.concatenate(shingles)
    heads, shingles = [], []
    starts = np.cumsum(head["count"]) - head["count"]
    order = np.argsort(head["sid"], kind="stable")
    head, starts = head[order], starts[order]
    first = np.flatnonzero(np.concatenate([[True], head["sid"][1:] != head["sid"][:-1]]))
    # a set that came from several groups may have been told of a common shingle more than once, so this is an upper bound
    told, size = np.add.reduceat(head["count"], first), np.maximum.reduceat(head["n"], first)
    ends = np.append(first[1:], len(head))
    out = {k: [] for k in _SETS.names}
    for g in np.flatnonzero(100 * told >= PERCENT * size).tolist():
        pieces = [e[starts[i] : starts[i] + head["count"][i]] for i in range(first[g], ends[g])]
        own = np.unique(np.concatenate(pieces))
        n = int(size[g])
        if 100 * len(own) < PERCENT * n:
            continue
        window = n - -(-PERCENT * n // 100) + 1 - (n - len(own))
        rarest = own[np.lexsort((own, own & _CLASS))][:window]
        out["sid"].append(head[first[g]].tobytes()[: _OWNER.itemsize])
        out["n"].append(n)
        out["shared"].append((own & ~_CLASS).tobytes())
        out["regions"].append((rarest & ~_CLASS).view(np.int64).tolist())
        if len(out["sid"]) >= 512:
            yield pa.RecordBatch.from_pydict(out, schema=_SETS)
            out = {k: [] for k in _SETS.names}
    if out["sid"]:
        yield pa.RecordBatch.from_pydict(out, schema=_SETS)


def candidate_sets(docs: DataFrame, shingles: int = 0) -> DataFrame:
    """sid, n, shared (sorted shingles that occur in other sets, 8 bytes each) and regions of each set that can have a link.

    Shingles go to the index packed by group of documents, and the index answers packed by set, so either exchange has a few
    large rows. A shingle that is common within a group is told once for all its sets. ``shingles``, the sum of the sets' sizes,
    sets the number of the index's parts.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shingles // PART_SHINGLES))
    ddl = "part int, kind int, blob binary"
    posted = small_batches(docs.select("text")).mapInArrow(_post(parts), ddl)
    answered = posted.repartition(parts, "part").mapInArrow(_index(parts), ddl)
    return answered.repartition(parts, "part").mapInArrow(_gather, "sid binary, n long, shared binary, regions array<long>")


def _overlaps(batches):
    for batch in batches:
        a, b = batch.column("set_a"), batch.column("set_b")
        both = [len(np.intersect1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True)) for x, y in zip(a, b)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("na"), batch.column("nb"), pa.array(both, pa.int64())], names=["a", "b", "na", "nb", "both"])


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, whether the sets are linked, and their Jaccard distance, for distinct pairs (a, b) of ids of sets."""
    of = lambda k: sets.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("shared").alias(f"set_{k}"))
    found = pairs.join(of("b"), "b").join(of("a"), "a").mapInArrow(_overlaps, "a long, b long, na long, nb long, both long")
    union = F.col("na") + F.col("nb") - F.col("both")
    return found.select("a", "b", (100 * F.col("both") >= PERCENT * union).alias("linked"), (1 - F.col("both") / union).alias("d"))


def _members(sets: DataFrame) -> DataFrame:
    """region, id, n, cap and off of each set in each region of its window.

    If a region is the first that two sets share, their overlap is at most the number of either's shingles from there on, which
    come after ``place`` others. With that bound a partner of more than ``cap`` shingles is out of the threshold. ``off`` is the
    part of a set's shingles, in thousandths, that no other set has: how far it is from the core of its regions.
    """
    shared = (F.length("shared") / 8).cast("long")
    rows = sets.select("id", "n", shared.alias("m"), F.posexplode("regions").alias("i", "region"))
    cap = F.floor((F.lit(100 + PERCENT) * (F.col("m") - F.col("i")) - PERCENT * F.col("n")) / F.lit(PERCENT))
    off = F.floor(1000 * (F.col("n") - F.col("m")) / F.col("n"))
    return rows.select("region", "id", F.col("n").cast("int"), cap.cast("int").alias("cap"), off.cast("int").alias("off")).filter(f"100 * cap >= {PERCENT} * n")


def _first(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of each set with one pivot: of the sets next to the core of one of its regions, the one that all regions have in
    the same order first. A group's members mostly share it, so one distance for each member joins most of a group."""
    order = F.struct("off", F.xxhash64(F.lit(7), "id").alias("o"), "id")
    pivots = members.groupBy("region").agg(F.min(order).alias("p"), F.count("*").alias("size")).filter("size > 1").select("region", "p")
    best = members.select("region", "id").join(pivots, "region").groupBy("id").agg(F.min("p").alias("p"))
    return overlaps(best.select(F.col("p.id").alias("a"), F.col("id").alias("b")).filter("a <> b"), sets).filter("linked").select("a", "b")


def _reachable(members: DataFrame) -> DataFrame:
    """Members (region, id, n, cap, root) whose size and cap fit the sizes and caps of members of another component.

    The region's largest component is told from all others, so its members are held against the others only.
    """
    own = members.groupBy("region", "root").agg(F.count("*").alias("c"), F.min("n").alias("low"), F.max("cap").alias("high"))
    main = own.groupBy("region").agg(F.max(F.struct("c", "root")).alias("m"), F.count("*").alias("roots")).filter("roots > 1").select("region", F.col("m.root").alias("main"))
    other = F.col("root") != F.col("main")
    bounds = own.join(main, "region").groupBy("region", "main").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min(F.when(other, F.col("low"))).alias("low2"), F.max(F.when(other, F.col("high"))).alias("high2"))
    fits = F.when(other, (F.col("cap") >= F.col("low")) & (F.col("n") <= F.col("high"))).otherwise((F.col("cap") >= F.col("low2")) & (F.col("n") <= F.col("high2")))
    return members.join(bounds, "region").filter(fits).select("region", "id", "n", "cap", "root")


def _open_regions(regions: DataFrame, roots: DataFrame) -> DataFrame:
    """region, id, n, cap, root, size of members that may still be linked across components; of regions with the same members
    and caps one stays."""
    known = regions.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("region", "id", "n", "cap", F.coalesce("root", "id").alias("root"))
    known = cut(known, "known")
    fit = cut(_reachable(known), "reachable")
    drop_cut(known)
    info = fit.groupBy("region").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"), F.bit_xor(F.xxhash64("id", "cap")).alias("x"), F.sum(F.xxhash64(F.lit(1), "id", "cap").cast("decimal(38,0)")).alias("s"))
    one = info.filter("low < high").groupBy("size", "x", "s").agg(F.min("region").alias("region")).select("region", "size")
    members = cut(fit.join(one, "region"), "regions")
    drop_cut(fit)
    return members


def links(sets: DataFrame) -> DataFrame:
    """Edges (a, b) between ids of sets that join every two linked sets, directly or by way of others both are linked to.

    Only components are asked for, so what is joined already needs no more comparing: after each round regions keep only what
    may link different components, and only members of different components are paired.
    """
    regions = cut(_members(sets), "regions")
    edges, level, tau = cut(_first(regions, sets), "links"), 0, 1 - PERCENT / 100
    while True:
        roots = components(edges)
        members = _open_regions(regions, roots)
        drop_cut(regions)
        if members.isEmpty():
            return edges
        # from here on only the sets of open regions are read
        used = cut(members.select("id").distinct(), "used")
        left = cut(sets.select("id", "n", "shared").join(used, "id", "left_semi"), "left")
        if level:
            drop_cut(sets)
        sets = left
        small, large = members.filter(F.col("size") <= LEAF), members.filter(F.col("size") > LEAF)
        of = lambda k: small.select("region", *(F.col(c).alias(f"{c}_{k}") for c in ("id", "n", "cap", "root")))
        near = of("a").join(of("b"), "region").filter("id_a < id_b and root_a <> root_b and n_a <= cap_b and n_b <= cap_a")
        near = cut(near.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct(), "near")
        found = overlaps(near, sets).filter("linked").select("a", "b")
        if large.isEmpty():
            return edges.union(cut(found, "links"))
        k = PIVOTS[min(level, len(PIVOTS) - 1)]
        # pivots come from the smaller components of a region first, whose members have most left to be compared with
        share = large.groupBy("region", "root").agg(F.count("*").alias("own"))
        order = F.struct(F.col("own"), F.xxhash64(F.lit(7), "id").alias("o"), F.col("id"))
        pivots = large.join(share, ["region", "root"]).groupBy("region", F.pmod(F.xxhash64(F.lit(11 + level), "root"), F.lit(k)).alias("j")).agg(F.min(order).alias("p")).select("region", F.col("p.id").alias("pivot"))
        pivots = cut(pivots, "pivots")
        # a pivot is compared with all members of its region, so it is done
        rest = large.join(pivots.select("region", F.col("pivot").alias("id")), ["region", "id"], "left_anti")
        against = cut(rest.join(pivots, "region").select("region", "id", "n", "cap", "pivot"), "against")
        pairs = cut(against.select(F.col("pivot").alias("a"), F.col("id").alias("b")).union(_among(pivots)).distinct(), "pairs")
        distances = cut(overlaps(pairs, sets), "distances")
        at = against.join(distances.select(F.col("a").alias("pivot"), F.col("b").alias("id"), "linked", "d"), ["pivot", "id"])
        nearest = at.groupBy("region", "id").agg(F.min("d").alias("least"))
        homes = at.join(nearest, ["region", "id"]).filter(F.col("d") <= F.col("least") + 2 * tau + 1e-9)
        outside = homes.filter("not linked").groupBy("region", "pivot").agg(F.min("d").alias("reach"))
        homes = homes.join(outside, ["region", "pivot"]).filter(~F.col("linked") | (F.col("d") >= F.col("reach") - tau - 1e-9))
        regions = cut(homes.select(F.xxhash64("region", "pivot").alias("region"), "id", "n", "cap"), "regions")
        new = cut(edges.union(found).union(distances.filter("linked").select("a", "b")), "links")
        for done in (edges, members, used, near, pivots, against, pairs, distances):
            drop_cut(done)
        edges, level = new, level + 1


def _among(pivots: DataFrame) -> DataFrame:
    """The pairs of pivots of a region, which has at most ``PIVOTS[-1]`` of them."""
    x, y = pivots.select("region", F.col("pivot").alias("a")), pivots.select("region", F.col("pivot").alias("b"))
    return x.join(y, "region").filter("a < b").select("a", "b")


def near_groups(docs: DataFrame, keep: tuple = ()) -> DataFrame:
    """doc_id, n_shingles, root and the columns ``keep`` of each row of ``docs`` (doc_id, text): rows that links tie together, and
    no others, have the same root. It is null without words."""
    meta = cut(set_table(docs, keep), "sets")
    shingles = meta.agg(F.sum("n_shingles")).first()[0] or 0
    # ids are given once, as the table is written
    sets = cut(candidate_sets(docs, shingles).withColumn("id", F.monotonically_increasing_id()), "candidates")
    group = F.concat(F.lit("component "), F.col("root").cast("string")).cast("binary")
    roots = components(links(sets)).join(sets.select(F.col("id").alias("node"), "sid"), "node").select("sid", group.alias("root"))
    return meta.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid")).drop("sid")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links, of each row of ``docs`` (doc_id, text).

    Null and texts without words have no shingles, are linked with nothing and are their own component. Rows with equal sets
    are linked; repeated ids and repeated rows stay rows of their own. A null id is never the smallest, unless alone. A very long
    text is one set. Other columns are ignored; an empty table gives an empty one.
    """
    grouped = near_groups(docs)
    several = grouped.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")).filter("n > 1")
    # written, so that a root with many rows can be split in the join
    found = grouped.join(cut(several.drop("n"), "least"), "root", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
OP3_SQL = f"""
with recursive d as (select row_number() over () as r, doc_id, coalesce({_WORDS}, []) as w from documents),
s as (select distinct r, array_to_string(w[p : p + 4], ' ') as k from (select r, w, unnest(generate_series(1, greatest(1, len(w) - 4))) as p from d where len(w) > 0)),
n as (select r, count(*) as n from s group by r),
o as (select x.r as a, y.r as b, count(*) as c from s x join s y on x.k = y.k and x.r <> y.r group by x.r, y.r),
e as (select a, b from o join n na on na.r = a join n nb on nb.r = b where 100 * c >= {PERCENT} * (na.n + nb.n - c)),
t as (select r as a, r as b from n union select t.a, e.b from t join e on t.b = e.a),
m as (select a, min(d.doc_id) as c from t join d on d.r = t.b group by a)
select doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(m.c, doc_id) as component_id from d left join n on n.r = d.r left join m on m.a = d.r
"""
