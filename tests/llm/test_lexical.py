import math
import re
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import lexical

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain(docs, items, k=10, once=True):
    own = [(i, words(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in own), sum(len(w) for _, w in own)
    df, out, wanted = Counter(t for _, w in own for t in set(w)), [], {}
    for i, t in items:
        wanted.setdefault(i, []).extend(words(t))
    for item, terms in wanted.items():
        scored = []
        for doc, w in own:
            tf, score = Counter(w), 0
            for t, times in Counter(terms).items():
                if tf[t]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += (1 if once else times) * weight * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * (10 + 90 * len(w) * n_docs // n_terms)))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, parts=3, **more):
    df = spark.createDataFrame(docs, DOCS).repartition(parts) if docs else spark.createDataFrame([], DOCS)
    return sorted((tuple(r) for r in lexical.search(df, spark.createDataFrame(items, ITEMS), **more).collect()), key=str)


@pytest.fixture()
def corpus(rng):
    vocab = ["Alpha", "beta", "ÉTÉ", "été", "x9", "中文", "a'b", "ſ", "gamma"] + [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", "\n", "\t", "\0"]) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 40))) for i in range(150)] + [(i, "same words here") for i in range(300, 320)] + [(7, text(9)), (None, "same words here"), (400, None), (401, ""), (402, "?!"), (403, text(5000))]
    return docs, [(i, text(rng.randrange(0, 9))) for i in range(12)] + [(20, "same SAME words"), (21, None), (22, "?"), (20, "here"), (None, "beta w1")]


@pytest.mark.parametrize("once", [True, False])
def test_equals_plain(spark, corpus, once):
    assert found(spark, *corpus, once=once) == plain(*corpus, once=once)


def test_ties_go_by_id_and_those_without_come_last(spark, corpus):
    docs = [(None, "a b"), *((i, "a b") for i in range(12, 2, -1)), (99, "c")]
    assert [r[2] for r in sorted(found(spark, docs, [(1, "a")], k=11), key=lambda r: r[1])] == [*range(3, 13), None]


def test_items_in_several_passes(spark, corpus, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 120)
    assert found(spark, *corpus, parts=2) == plain(*corpus)


def test_empty(spark):
    assert found(spark, [], [(1, "a")]) == found(spark, [(1, "a")], []) == found(spark, [(1, None)], [(1, "a")]) == []


def test_other_columns_do_not_matter(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x")], DOCS + ", item_id long, terms string")
    items = spark.createDataFrame([(3, "b", 8)], ITEMS + ", doc_id long")
    assert [r[:3] for r in lexical.search(docs, items).collect()] == [(3, 1, 1)]


def test_row_merge_is_a_matrix_product():
    rng = np.random.default_rng(3)
    d = rng.integers(0, 50, (6, 40)) * (rng.random((6, 40)) < 0.3)
    q = rng.integers(0, 3, (5, 6))
    term, row = np.nonzero(d)
    ends = np.cumsum(np.bincount(term, minlength=6))
    for i in range(5):
        places = [(int(ends[t - 1]) if t else 0, int(ends[t]), int(q[i, t])) for t in range(6) if q[i, t]]
        assert (lexical.merge_rows(places, row, d[term, row], np.zeros(40, np.int64)) == q[i] @ d).all()
