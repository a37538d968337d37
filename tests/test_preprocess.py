"""The preprocessing pipeline: default steps, options, fallbacks, own steps, files."""

from graphloom.functions.text import Cleaner
from graphloom.operators import preprocess as p

TEXT = "北京是中国的首都。\n\nBeijing  is <b>big</b> and Beijing is old.\x07"


def test_default_steps(spark):
    docs = spark.createDataFrame([(1, TEXT, "kept"), (2, None, "x"), (3, "", "y"), (3, "", "y")], "doc_id long, text string, tokens string")
    got = {r.doc_id: r for r in p.Pipeline()(docs).collect()}
    one = got[1]
    assert "\x07" not in one.cleaned and "<b>" not in one.cleaned and one.chunks == [one.cleaned]
    assert {"北京", "首都", "Beijing"} <= set(one.tokens) and one.keywords[0].word in ("Beijing", "is")
    assert one.metadata["keywords"].split(", ")[0] == one.keywords[0].word and one.metadata["character_count"] == str(len(one.cleaned.encode()))
    assert abs(sum(k.weight for k in one.keywords) - 1) < 1 or len(one.keywords) == 10
    for i in (2, 3):
        assert got[i].chunks == [] and got[i].metadata == {} and got[i].tokens == [] and got[i].keywords == []
    assert p.Pipeline()(docs.limit(0)).count() == 0


def test_options_skip_steps(spark):
    off = p.Options(clean=False, split=False, extract_metadata=False, tokenize=False, extract_keywords=False)
    r = p.Pipeline().text(spark, TEXT, off).first()
    assert r.cleaned == TEXT and r.chunks == [TEXT] and r.metadata == {} and r.tokens == [] and r.keywords == []
    some = p.Options(strategy="SENTENCE", split_options={"size": 20, "most": 1}, keyword_count=2)
    r = p.Pipeline().text(spark, "One here. Two there. Three.", some).first()
    assert len(r.chunks) == 3 and len(r.keywords) == 2


def test_own_steps_fall_back(spark):
    docs = spark.createDataFrame([("12",), ("no number",), (None,)], "text string")
    steps = p.Pipeline().clear().add(p.cleaning(Cleaner("none"))).add(p.own_step("doubled", lambda t: str(2 * int(t))))
    assert sorted(str(r.doubled) for r in steps(docs).collect()) == ["24", "None", "no number"]
    assert set(steps(docs).columns) == {"text", *p.COLUMNS, "doubled"}


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("first file\nof two lines")
    (tmp_path / "b.html").write_text("<html><head><title>T</title></head><body><p>second</p></body></html>")
    (tmp_path / "c.pdf").write_bytes(b"%PDF broken")
    got = {r.path.rsplit("/", 1)[1]: r for r in p.Pipeline().files(spark, str(tmp_path)).collect()}
    assert got["a.txt"].metadata["line_count"] == "2" and got["a.txt"].metadata["file_name"] == "a.txt"
    assert "second" in got["b.html"].cleaned and got["c.pdf"].text == "" and got["c.pdf"].chunks == []


def test_top_tokens():
    assert p.top_tokens(["b", "a", "a", "c", "b"], 2, ()) == [{"word": "a", "weight": 0.4}, {"word": "b", "weight": 0.4}]
    assert p.top_tokens([], 3) == []


def test_workers_get_few_texts_at_once(spark):
    from graphloom.operators import preprocess

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        step = preprocess.own_step("size", lambda t: t)
        rows = preprocess.Pipeline([preprocess.cleaning(), step])(spark.range(600).selectExpr("id", "'a b' as text").coalesce(1))
        seen = rows.select("size").mapInPandas(lambda batches: (b.assign(size=str(len(b))) for b in batches), "size string")
        sizes = [int(r.size) for r in seen.collect()]
        assert len(sizes) == 600 and max(sizes) <= 256
    finally:
        spark.conf.set(name, before)
