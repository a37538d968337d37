"""Reply trees with scored branches, and conversations as trees without any."""

import pytest

from graphloom.llm import chat

MESSAGES = "tree string, node int, parent int, role string, text string, score double"


def plain(rows, branches):
    """Root-to-leaf paths by following parents, ranked within each root."""
    by = {}
    for tree, node, parent, role, text, score in rows:
        if node is not None:
            by.setdefault(tree, {}).setdefault(node, (parent, score or 0.0, role, text))
    out = []
    for tree, nodes in by.items():
        ways = {}
        for leaf in set(nodes) - {n[0] for n in nodes.values()}:
            path, at = [], leaf
            while at in nodes and at not in path:
                path.append(at)
                at = nodes[at][0]
            if at not in nodes:
                ways.setdefault(path[-1], []).append((-sum(nodes[n][1] for n in path) / len(path), -len(path), leaf, [(nodes[n][2], nodes[n][3]) for n in reversed(path)]))
        for root, found in ways.items():
            out += [(tree, root, leaf, rank + 1, round(-score, 9), turns) for rank, (score, _, leaf, turns) in enumerate(sorted(found)[:branches])]
    return sorted(out, key=str)


@pytest.mark.parametrize("branches", [1, 3])
def test_branches_are_ranked_by_their_scores(spark, rng, branches):
    rows = []
    for tree in ("a", "b", None):
        for node in range(40):
            parent = None if node < 2 else rng.randrange(node) if node < 36 else 999 if node == 36 else {37: 38, 38: 37, 39: 38}[node]
            rows.append((tree, node, parent, rng.choice(["user", "assistant", None]), rng.choice(["x", "### y", "", None]), rng.choice([None, 0.25, 0.5, 1.0, -1.0])))
    rows += [("chain", i, i - 1 if i else None, "user", str(i), 0.5) for i in range(70)] + [("a", None, 1, "user", "lost", 1.0)]
    got = [(r.tree, r.root, r.leaf, r.rank, round(r.score, 9), [(t.role, t.text) for t in r.turns]) for r in chat.reply_paths(spark.createDataFrame(rows, MESSAGES), branches).collect()]
    assert sorted(got, key=str) == plain(rows, branches)


def test_conversations_are_chains(spark):
    rows = [(1, 2, "user", "c"), (1, 1, "assistant", "b"), (1, 1, "user", "a"), (1, None, "system", None), (2, 1, None, "### x </turn>"), (None, 1, "user", "n")]
    tree = chat.linear(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    paths = chat.format_paths(chat.reply_paths(tree)).collect()
    turns = sorted(chat.parse_turns(r.formatted) for r in paths)
    assert turns == sorted([[("system", ""), ("assistant", "b"), ("user", "a"), ("user", "c")], [("", "### x </turn>")], [("user", "n")]])
    assert chat.linear(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
