"""Stages of the pipeline that choose rows by themselves."""

import random
from collections import Counter

import corpus_pipeline as p

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def test_near_copies_with_repeated_ids(spark, rng):
    fresh = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))
    a, b, c, d, e, f = (fresh() for _ in range(6))
    rows = [(1, a, "s"), (1, b, "s"), (1, b, "s"), (2, a, "s"), (3, a + " more", "s"), (5, c, "s"), (5, a, "s"), (6, d, "s"), (7, d, "t"), (7, e, "s")]
    rows += [(8, "", "s"), (8, "", "s"), (8, " \n", "s"), (8, None, "s"), (None, e, "s"), (None, f, "s"), (None, f + " more", "s"), (None, f, "s"), (None, None, "s")]
    got = [(r.doc_id, r.text, r.source) for r in p.drop_near_copies(spark, made(spark, rows), "").collect()]
    word = [x for x in got if (x[1] or "").strip()]
    assert Counter(x for x in got if x not in word) == Counter(x for x in rows if not (x[1] or "").strip())
    assert Counter(x for x in word if x[0] is not None) == Counter([(1, a, "s"), (1, b, "s"), (5, c, "s"), (6, d, "s"), (7, e, "s")])
    assert len([x for x in word if x[0] is None]) == 1 and {x[1] for x in word if x[0] is None} <= {f, f + " more"}


def test_contaminated_by_items_without_id(spark, tmp_path):
    bench = [(1, "Alpha beta gamma"), (None, "delta epsilon"), (None, None), (2, "delta epsilon zeta")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, "x alpha beta gamma", "s"), (2, "x delta epsilon y", "s"), (3, "delta x epsilon", "s"), (4, None, "s"), (5, "delta epsilon " + "w " * 60, "s"), (6, "delta epsilon zeta", "s")]
    got = p.drop_contaminated(spark, made(spark, rows), str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {3, 4, 5}
    hits = p.decontaminate.judged(p.decontaminate.decontaminate(made(spark, rows), p.table(spark, str(tmp_path), "benchmark"))).collect()
    assert {r.doc_id: (r.n_hit, r["items"]) for r in hits} == {1: (3, ["1"]), 2: (2, []), 3: (0, []), 4: (0, []), 5: (2, []), 6: (3, ["2"])}


def test_run_drops_what_each_stage_should(spark, tmp_path):
    from test_toxicity import made as texts

    rng = random.Random(11)
    clean, toxic = texts(rng, 160, False), texts(rng, 60, True)
    passage = " ".join(f"benchmark{i}" for i in range(15))
    rows = [(i, t, "big" if i % 4 else "small") for i, t in enumerate(clean)]
    rows += [(1000 + i, t, "big") for i, t in enumerate(toxic)]
    base = " ".join(f"unique{i}" for i in range(60))
    rows += [(2000, base, "s"), (2001, base + " more", "s"), (2002, base.upper(), "t"), (2100, f"{clean[0]} {passage} {clean[1]}", "s"), (2200, None, "s"), (2201, "", None)]
    made(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i in range(120)] + [(1000 + i, 0, 1) for i in range(45)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("b", passage)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = p.run(spark, str(tmp_path)).collect()
    ids = Counter(r.doc_id for r in got)
    assert sum(1000 <= i < 1060 for i in ids) <= 3  # the classifier learns from 30 toxic documents
    assert len([i for i in ids if i < 160]) >= 158 and max(ids.values()) <= 2
    assert {i for i in ids if i >= 2000} == {2000, 2200, 2201}
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and {r.n_tokens for r in got if r.doc_id in (2200, 2201)} == {1}
    kept = {r.doc_id for r in p.mix_sources(spark, made(spark, rows), str(tmp_path)).collect()}
    assert kept == {i for i, _, _ in rows}  # the mixture holds every row at least once
