"""Each operator against a plain version, with nulls, empty and repeated rows, ties and extra columns."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import chat, decontaminate, linededup, ngramjoin, pqdedup, quality, simple8b, tokenids, urlfilter
from graphloom.llm.components import components

DOCS = "doc_id long, text string, source string"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def texts(rng, n, words=40):
    vocabulary = [f"w{i}" for i in range(300)]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, words))) for _ in range(n)]


@pytest.mark.parametrize("values", [[], [0] * 900, [2**64 - 1, 5, 2**60 - 1, 2**60 - 2, 0] * 300, list(range(3000))])
def test_simple8b_round_trip(values):
    v = np.array(values, dtype=np.uint64)
    p = simple8b.encode(v)
    assert (simple8b.decode(p) == v).all()
    assert (simple8b.decode(p, 1, 2) == v[512:1024]).all()


def test_token_ids(spark, rng):
    rows = [(i, t, "s") for i, t in enumerate(texts(rng, 30))] + [(100, None, "s"), (101, "", "s"), (None, "It's <|endoftext|> Ünï", "s"), (3, "again", "s")]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenids.default_tokenizer())
    got = sorted(tokenids.token_ids(docs(spark, rows)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    want = {}
    for i, t, _ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    at = 0
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        at += r.n_tokens
    assert tokenids.token_ids(docs(spark, [])).count() == 0


def test_decontaminate(spark):
    bench = spark.createDataFrame([(1, "Alpha beta gamma"), (2, None), (3, ""), (1, "alpha BETA gamma")], "item_id long, text string")
    rows = [(1, "x alpha, beta-gamma y", "s"), (2, "alphabeta gamma", "s"), (3, None, "s"), (4, "", "s"), (1, "x alpha, beta-gamma y", "s")]
    hits = decontaminate.judged(decontaminate.decontaminate(docs(spark, rows), bench))
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated, r.spans) for r in hits.collect()]
    assert got.count((1, 5, 3, 1, True, [[2, 19]])) == 2
    assert (2, 2, 0, 0, False, []) in got and (3, 0, 0, 0, False, []) in got


def test_url_filter(spark):
    pages = spark.createDataFrame([(1, "http://A.org/x"), (2, "http://q.example.org/es/1"), (3, None), (4, "nothing"), (5, "http://alias.net/a"), (6, "http://example.org/en/12?x"), (7, "http://example.org")], "page_id long, url string")
    edges = spark.createDataFrame([("http://alias.net/a", "http://mid.net/"), ("http://mid.net/", "http://q.example.org/es/1")], "a string, b string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(pages, urlfilter.RULES, edges).collect()}
    assert got[1] == ("a.org", "/x", "org/", "allow") and got[2][2:] == ("example.org/es/", "block") and got[3] == ("", "", None, "allow")
    assert got[5][2:] == (None, "block") and got[6][2:] == ("example.org/en/1", "block") and got[7] == ("example.org", "", None, "allow")
    freed = edges.union(spark.createDataFrame([("http://alias.net/a", "http://a.org/ok")], "a string, b string"))
    assert {r.page_id: r.verdict for r in urlfilter.filter_urls(pages, urlfilter.RULES, freed).collect()}[5] == "allow"


def test_links_in_pages(spark):
    html = '<LINK href="http://b/" rel="canonical"><meta http-equiv="refresh" content="0; url=http://c/"><link rel=canonical href=/no>'
    pages = spark.createDataFrame([("http://a/", html), (None, html), ("http://d/", None)], "url string, html string")
    assert sorted(r.b for r in urlfilter.alias_edges(pages).collect()) == ["http://b/", "http://c/"]


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (None, 3), (3, 1)], "a long, b long")
    assert {(r.node, r.root) for r in components(e).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
    assert components(e.filter("a > 100")).count() == 0


def test_chat_format():
    turns = [("user", r"\### Assistant: </turn> ok"), ("assistant", "a\n### x"), (None, None), ("assistant", "")]
    made, mask = chat.format_turns(turns)
    assert chat.parse_turns(made) == [(r or "", t or "") for r, t in turns]
    assert "".join(chat.unescape(made[a:b]) for a, b in mask) == "a\n### x"


def test_reply_trees(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 0.1), ("t", 3, 1, "assistant", "good", 0.9), ("t", 4, 3, "user", "more", 0.9), ("t", 8, 9, "user", "loop", 1.0), ("t", 9, 8, "user", "loop", 1.0), (None, 1, None, "user", "alone", None), ("t", 2, 1, "assistant", "bad", 0.1)]
    found = chat.reply_paths(spark.createDataFrame(rows, "tree string, node int, parent int, role string, text string, score double")).collect()
    assert {(r.tree, tuple(t.text for t in r.turns)) for r in found} == {("t", ("q", "good", "more")), (None, ("alone",))}


def test_line_dedup(spark):
    body = "\n".join(f"line {i}" for i in range(60))
    rows = [(1, "top\n" + body, "s"), (2, "other\nhead\n" + body + "\nend", "s"), (3, None, "s"), (4, "", "s"), (5, "a", "s"), (6, "a", "s")]
    got = {r.doc_id: r for r in linededup.dedup_lines(docs(spark, rows)).collect()}
    assert got[1].removed_lines == 0 and got[1].text == rows[0][1]
    assert got[2].removed_lines > 30 and got[2].text.startswith("other\nhead") and got[2].text.endswith("end")
    assert got[3].text is None and got[4].text == "" and got[6].text == "a"


def test_near_duplicates(spark, rng):
    base = texts(rng, 6, 120)
    rows = []
    for t in base:
        for _ in range(rng.choice([1, 3, 30])):
            w = t.split()
            if len(w) > 10:
                w[rng.randrange(len(w))] = "changed"
            rows.append(" ".join(w))
    rows += ["", None, "a b", "A  b", "a b"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.near_duplicates(docs(spark, [(i, t, "s") for i, t in enumerate(rows)])).collect()}
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in ((t or "").lower().split() for t in rows)]
    up = list(range(len(rows)))
    for _ in rows:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    up[i] = min(up[i], up[j])
    assert got == {i: (len(s), up[i]) for i, s in enumerate(sets)}


def test_near_vectors(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(5, 16))
    v = [(i, [float(x) for x in base[i % 5] + 0.08 * r.normal(size=16)], int(i % 2)) for i in range(60)]
    v += [(100, None, 1), (101, [0.0] * 16, 1), (102, [float("nan")] * 16, 1), (103, v[0][1], v[0][2]), (104, v[0][1], None), (105, [1.0, None], 1)]
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in pqdedup.near_vectors(spark.createDataFrame(v, "vec_id long, embedding array<float>, label int")).collect()}
    fine = [(i, np.array(e, np.float32).astype(float), c) for i, e, c in v if c is not None and e is not None and len(e) == 16 and np.isfinite(e).all() and any(e)]
    link = {i: {j for j, f, c2 in fine if j != i and c == c2 and e @ f / np.linalg.norm(e) / np.linalg.norm(f) >= 0.93} for i, e, c in fine}
    up = {i: i for i in got}
    for _ in range(70):
        for i, js in link.items():
            up[i] = min([up[i], *(up[j] for j in js)])
    assert got == {i: (len(link.get(i, ())), up[i], up[i] == i) for i in got}


def test_quality_learns(spark, rng):
    good, bad = texts(rng, 120), [t.upper().replace(" ", "!! ") for t in texts(rng, 120)]
    n = quality.fit(good[:90] + bad[:90], [1] * 90 + [0] * 90)
    rows = [(i, t, "s") for i, t in enumerate(good[90:] + bad[90:])] + [(100, None, "s"), (101, "", "s"), (102, "x" * 5000, "s")]
    got = {r.doc_id: r.score for r in quality.score_texts(docs(spark, rows), n).collect()}
    assert np.mean([got[i] for i in range(30)]) > 0.8 and np.mean([got[i] for i in range(30, 60)]) < 0.2
    assert got[100] == got[101] and 0 <= got[102] <= 1


def test_chunks_cover_the_text():
    for n in (1, 511, 512, 513, 992, 993, 5000):
        starts, _ = quality.chunks(np.zeros(n, np.uint8), np.array([0, n]))
        assert starts[0] == 0 and starts[-1] + quality.CHUNK >= n and (np.diff(starts) <= quality.CHUNK - quality.SHARED).all()
