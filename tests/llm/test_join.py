"""The n-gram join on hot groups, with regions that have to be split, against all pairs."""

import numpy as np
import pytest

from graphloom.llm import components, ngramjoin, shingles


def plain(rows):
    """doc_id: (size of the set, smallest id that links reach), from all pairs."""
    words = [(t or "").replace("\xa0", "x").lower().split() for _, t in rows]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in words]
    up = [i for i, _ in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while True:
        was = list(up)
        for a, b in near:
            up[a] = up[b] = min(up[a], up[b])
        if up == was:
            return {i: (len(s), u) for (i, _), s, u in zip(rows, sets, up)}


def found(spark, rows):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


@pytest.mark.parametrize("leaf", [24, 3])
def test_hot_group(spark, rng, monkeypatch, leaf):
    monkeypatch.setattr(ngramjoin, "LEAF", leaf)
    monkeypatch.setattr(ngramjoin, "PIVOTS", (2, 3))
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(220):  # all around the threshold, with few words to put in, so that many share an edit
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 2, 3, 3, 4])):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([["x"], ["y"], [], ["x", "y"]])
        rows.append((i, " ".join(w)))
    common = " ".join(f"c{i}" for i in range(30))
    rows += [(300 + i, f"{common} {' '.join(f'u{rng.randrange(10**6)}' for _ in range(rng.randrange(9)))}") for i in range(90)]
    rows += [(500 + i, " ".join(f"c{j}" for j in range(rng.randrange(1, 36)))) for i in range(60)]
    rng.shuffle(rows)
    assert found(spark, rows) == plain(rows)


def test_caps(spark):
    """No link is lost for sets at the threshold itself, however their sizes differ."""
    rows, at = [], 0
    for n in (9, 10, 20, 25, 45):
        a = [f"s{n}w{i}" for i in range(n)]
        for drop in range(0, n // 4 + 2):
            rows.append((at, " ".join(a[: n - drop])))
            rows.append((at + 1, " ".join(a[drop:] + [f"s{n}e{drop}"])))
            at += 2
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == {}


def test_postings_round_trip():
    r = np.random.default_rng(3)
    owners = np.array([r.bytes(12) for _ in range(9)], dtype=ngramjoin._OWNER)
    for e in (np.array([5 << 16, 1 << 60, (1 << 64) - (1 << 16)], np.uint64), np.sort(r.integers(0, 1 << 40, 500, dtype=np.uint64) << np.uint64(16)), np.array([7 << 16], np.uint64)):
        at = r.integers(0, 9, len(e)).astype(np.uint16)
        held, back, place = ngramjoin._unpack_postings(ngramjoin._pack_postings(owners, e, at))
        assert (back == e).all() and (held[place] == owners[at]).all()


def test_set_ids():
    r = np.random.default_rng(4)
    s = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    assert shingles.set_id(s) == shingles.set_id(s[::-1].copy()) and len(shingles.set_id(s[:1])) == 12
    assert len({shingles.set_id(s[:n]) for n in range(1, 41)}) == 40


@pytest.mark.parametrize("one_task", [0, 1 << 18])
def test_components_both_ways(spark, rng, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(20)] + [(300, 300 + i) for i in range(9)] + [(None, 4), (5, None), (7, 7)]
    up = {x: x for e in edges for x in e if x is not None}
    for _ in up:
        for a, b in edges:
            if a is not None and b is not None:
                up[a] = up[b] = min(up[a], up[b])
    alone = {x for x in up if not any(x in e and e[0] != e[1] and None not in e for e in edges)}
    got = [(r.node, r.root) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert sorted(got) == sorted((x, r) for x, r in up.items() if x not in alone)
    assert components.components(spark.createDataFrame([("b", "a"), ("b", "c")], "a string, b string")).filter("root = 'a'").count() == 3
