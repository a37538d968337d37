import itertools
import math
import random
import re
from collections import Counter

import pytest

from graphloom.functions import segment
from graphloom.functions.segment import NEVER, STATES, Model, Segmenter


def all_cuts(run):
    for bits in itertools.product([0, 1], repeat=len(run) - 1):
        out, word = [], run[0]
        for c, b in zip(run[1:], bits):
            if b:
                out.append(word)
                word = c
            else:
                word += c
        yield [*out, word]


def plain_path(run, weights):
    low = min(weights.values())
    known = [c for c in all_cuts(run) if all(w in weights or len(w) == 1 for w in c)]
    return max(known, key=lambda c: (sum(weights.get(w, low) for w in c), [len(w) for w in c]))


def plain_states(run, m):
    ways = []
    for s in itertools.product(STATES, repeat=len(run)):
        if s[0] in "BS" and s[-1] in "ES" and all(b in segment._AFTER[a] for a, b in zip(s, s[1:])):
            score = m.start.get(s[0], NEVER) + sum(m.emit.get(x, NEVER) for x in zip(s, run)) + sum(m.follow.get(x, NEVER) for x in zip(s, s[1:]))
            ways.append((score, "".join(s)))
    return max(ways)[0], {s for score, s in ways if score == max(ways)[0]}


def made_model(rng, letters):
    return Model({"B": -1.0, "S": -2.0}, {(a, b): -float(rng.randrange(1, 6)) for a, bs in segment._AFTER.items() for b in bs}, {(s, c): -float(rng.randrange(1, 9)) for s in STATES for c in letters})


def test_path_is_the_most_probable_one():
    rng = random.Random(1)
    for _ in range(150):
        weights = {"".join(rng.choice("甲乙丙丁") for _ in range(rng.randrange(1, 5))): -float(rng.randrange(1, 12)) for _ in range(9)}
        run = "".join(rng.choice("甲乙丙丁戊") for _ in range(rng.randrange(1, 10)))
        assert Segmenter(weights).path(run) == plain_path(run, weights)


def test_states_are_the_most_probable_ones():
    rng = random.Random(2)
    for _ in range(100):
        m, run = made_model(rng, "甲乙丙"), "".join(rng.choice("甲乙丙") for _ in range(rng.randrange(1, 8)))
        assert m.states(run) in plain_states(run, m)[1]
        assert "".join(m.cut(run)) == run


def test_modes():
    words = {"北京": -3.0, "大学": -3.0, "北京大学": -4.0, "大学生": -5.0, "学生": -4.0, "京大学": -20.0, "在": -2.0}
    m = Model({"B": -0.1, "S": -3.0}, {("B", "E"): -0.1, ("B", "M"): -3.0, ("M", "E"): -0.5, ("M", "M"): -2.0, ("E", "B"): -0.5, ("E", "S"): -1.0, ("S", "B"): -0.5, ("S", "S"): -1.0}, {(s, c): -5.0 for s in STATES for c in "在赵钱北京大学"})
    s = Segmenter(words, m)
    assert s.cut("在北京大学 AI9", "MIX") == ["在", "北京大学", "AI9"]
    assert s.cut("北京大学", "SEARCH") == ["北京", "大学", "京大学", "北京大学"]
    assert s.cut("北京大学赵钱", "DEFAULT") == ["北京大学", "赵钱"]
    assert s.cut("北京大学赵钱", "MIX") == ["北京大学", "赵", "钱"]
    assert s.cut("赵钱，北京", "HMM") == ["赵钱", "北京"]
    assert s.add("赵").cut("赵钱") == ["赵", "钱"]
    assert s.add("赵钱大").cut("赵钱大") == ["赵钱大"] and s.weights["赵钱大"] == -4.0
    assert Segmenter({}).cut("北京x") == ["北", "京", "x"]


def test_column_with_stop_words_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, "我爱北京天安门"), (2, None), (3, ""), (1, "我爱北京天安门")], "id int, t string")
    got = df.select("id", Segmenter().column(df.t, stop_words=True).alias("w")).collect()
    assert sorted((r.id, r.w) for r in got) == [(1, ["爱", "北京", "天安门"])] * 2 + [(2, []), (3, [])]


def test_dictionary_from_a_file(spark, tmp_path):
    (tmp_path / "d.txt").write_text("# made up\n北京 30 ns\n大学 10\n\n清华 nz\n北京 5 x\n的\n", encoding="utf8")
    words = segment.load_words(spark, str(tmp_path / "d.txt"))
    assert sorted(map(tuple, words.collect())) == [("北京", 30, "ns"), ("大学", 10, None), ("清华", 1, "nz"), ("的", 1, None)]
    s = segment.segmenter(words, own=spark.createDataFrame([("清华大学",)], "word string"))
    assert s.weights["北京"] == pytest.approx(math.log(30 / 42)) and s.cut("清华大学的北京") == ["清华大学", "的", "北京"]


def test_model_from_a_file(spark, tmp_path):
    text = "#B E M S\n-0.5 -3.14e+100 -3.14e+100 -1.0\n" + "-9 -0.1 -2 -9\n-0.3 -9 -9 -1\n-9 -0.5 -0.9 -9\n-0.4 -9 -9 -0.8\n" + "甲:-1,乙:-2\n甲:-3,乙:-1\n甲:-4\n甲:-5,乙:-6\n"
    (tmp_path / "m.txt").write_text(text, encoding="utf8")
    m = segment.load_model(spark, str(tmp_path / "m.txt"))
    assert m.start["S"] == -1.0 and m.follow["M", "E"] == -0.5 and m.emit["E", "乙"] == -1.0
    assert m.states("甲乙甲乙") == "BEBE"


def test_model_is_counted_from_words(spark):
    rows = [(["甲乙", "丙", None, ""],), ([],), (None,), (["丙", "甲丙乙"],)]
    counts = segment.state_counts(spark.createDataFrame(rows, "tokens array<string>"))
    got = {(r.kind, r.a, r.b): r.n for r in counts.collect()}
    assert {k: n for k, n in got.items() if k[0] != "emit"} == {("start", "", "B"): 1, ("start", "", "S"): 1, ("follow", "B", "E"): 1, ("follow", "E", "S"): 1, ("follow", "S", "B"): 1, ("follow", "B", "M"): 1, ("follow", "M", "E"): 1}
    assert got["emit", "B", "甲"] == 2 and got["emit", "S", "丙"] == 2 and got["emit", "M", "丙"] == 1 and got["emit", "E", "乙"] == 2
    m = segment.model_of(counts)
    assert m.follow["B", "E"] == pytest.approx(math.log(0.5)) and m.start["B"] == pytest.approx(math.log(0.5))


def test_word_counts(spark):
    rows = spark.createDataFrame([(["a", "b", "a", "toolongword"],), (["b", "c"],), (None,)], "tokens array<string>")
    got = segment.word_counts(rows, longest=4, most=2).collect()
    assert sorted((r.word, r.n, round(r.weight, 6)) for r in got) == [("a", 2, round(math.log(0.5), 6)), ("b", 2, round(math.log(0.5), 6))]
    assert segment.word_counts(rows.limit(0)).collect() == []


def test_documents_are_recovered_as_by_the_plain_segmenter(spark):
    from graphloom.plans import han

    texts = ["The cat sat. The cat ran!", "a cat, the rat", None, "", "RAT sat the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    write = lambda w: "".join(han.HAN[han.LOWER.index(c)] for c in w)
    words = [[w.lower() for w in (t or "").replace(".", " ").replace("!", " ").replace(",", " ").split()] for t in texts]
    counts = {w: sum(x.count(w) for x in words) for x in words for w in x}
    made = Segmenter({write(w): math.floor(1000 * math.log(n / sum(counts.values()))) for w, n in counts.items()}, segment.model_of(segment.state_counts(han._han_words(docs))))
    got = {r.doc_id: r for r in han.recovered(docs).collect()}
    assert {i: r.n_words for i, r in got.items()} == {0: 6, 1: 4, 2: 0, 3: 0, 4: 3}
    for i, w in enumerate(words):
        run = "".join(map(write, w))
        assert got[i].tokens == (made.cut(run) or [])
        if 0 < len(run) < 16 and texts[i]:
            assert made.cut(run, "MIX") == plain_path(run, made.weights)


def test_many_runs_at_once_are_cut_as_each_by_itself(rng, monkeypatch):
    words = {"".join(rng.choices("天地玄黄宇", k=rng.randint(1, 6))): -rng.randint(1, 9) for _ in range(60)}
    runs = ["".join(rng.choices("天地玄黄宇宙", k=rng.randint(1, 90))) for _ in range(300)]
    made = Segmenter(words)
    for at_once in (1, 200, 1 << 17):
        monkeypatch.setattr(segment, "AT_ONCE", at_once)
        assert list(made.paths(runs)) == [made.path(r) for r in runs]
    assert made.add("宙宙天", 5) and list(made.paths(runs)) == [made.path(r) for r in runs]
    odd = Segmenter({w: x / 3 for w, x in words.items()})
    assert list(odd.paths(runs)) == [odd.path(r) for r in runs] and list(made.paths([])) == []
    texts = [None, "", "abc 天地，玄x9", *runs]
    for mode in ("MIX", "DEFAULT", "SEARCH", "HMM"):
        assert list(made.cut_all(texts, mode)) == [made.cut(t, mode) for t in texts]


def test_documents_are_dealt_out_before_they_are_cut(spark):
    from graphloom.plans import han

    docs = spark.createDataFrame([(i, "some words") for i in range(50)], "doc_id long, text string").coalesce(1)
    assert han.recovered(docs).rdd.getNumPartitions() >= 4


def test_long_parts_are_gone_through_by_themselves(rng, monkeypatch):
    words = {"".join(rng.choices("天地玄", k=rng.randint(1, 5))): -rng.randint(1, 9) for _ in range(40)}
    runs = ["".join(rng.choices("天地玄黄", k=rng.choice((1, 3, 20, 700)))) for _ in range(60)] + ["天地" * 900]
    for heavy in (0, 1 << 25):  # weights that single precision does not hold
        made = Segmenter({w: x - heavy for w, x in words.items()})
        for together in (0, 1, 5, 10_000):
            monkeypatch.setattr(segment, "TOGETHER", together)
            assert made._table() and list(made.paths(runs)) == [made.path(r) for r in runs]


def test_texts_are_read_twice_and_states_counted_over_distinct_words(spark, rng):
    from graphloom.plans import han

    texts = [" ".join(rng.choices(["the", "The", "a", "A", "cat", "réd", "x"], k=rng.randrange(12))) for _ in range(60)] + [None, "", "é 1"]
    seen = spark.sparkContext.accumulator(0)

    def read(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_words for r in han.recovered(docs.mapInPandas(read, docs.schema)).collect()}
    assert got == {i: len(re.findall("[A-Za-z]+", t or "")) for i, t in enumerate(texts)} and seen.value == 2 * len(texts)
    tokens = docs.selectExpr("regexp_extract_all(text, '[A-Za-z]+', 0) as tokens")
    plain = Counter()
    for t in texts:
        states = [(c, s) for w in re.findall("[A-Za-z]+", t or "") for c, s in zip(w, "S" if len(w) == 1 else "B" + "M" * (len(w) - 2) + "E")]
        plain.update(("emit", s, c) for c, s in states)
        plain.update(("follow", a[1], b[1]) for a, b in zip(states, states[1:]))
        plain.update(("start", "", s) for _, s in states[:1])
    assert {(r.kind, r.a, r.b): r.n for r in segment.state_counts(tokens).collect()} == plain
    pairs = segment.neighbour_counts(tokens)
    assert pairs.count() == pairs.select("word", "before").distinct().count() and pairs.agg({"n": "sum"}).first()[0] == sum(got.values())
