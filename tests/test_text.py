from pyspark.sql import functions as F

from graphloom.functions import chunks, metadata, text, tokens


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).first().r


def test_control_characters_go(spark):
    assert one(spark, "包含\x01不可\x02打印\x07字符\x1f的文本", text.Cleaner()) == "包含不可打印字符的文本"


def test_digit_rule(spark):
    assert one(spark, "包含数字123和456的文本", text.Cleaner("none").add_regex(r"\d", "#")) == "包含数字###和###的文本"


def test_function_rule(spark):
    assert one(spark, "Mixed Case Text 混合大小写文本", text.Cleaner("none").add(F.upper)) == "MIXED CASE TEXT 混合大小写文本"


def test_entities_are_decoded_in_order(spark):
    assert one(spark, "&amp;lt;p&gt; &nbsp;x", text.Cleaner()) == "<p>  x"


def test_html_text(spark):
    assert one(spark, "<p>a <b>b</b>\n c&amp;d</p>", text.html_text) == "a b c&d"


def test_structured_mode_keeps_paragraphs(spark):
    assert one(spark, "a  b\r\n\r\n\r\nc", text.Cleaner("structured")) == "a b\n\nc"


def test_fixed_chunks(spark):
    got = one(spark, "A" * 1200, lambda c: chunks.fixed_chunks(c, 500, 100))
    assert [len(x) for x in got] == [500, 500, 400]
    assert len(one(spark, "A" * 1000, lambda c: chunks.fixed_chunks(c, 300, 50))) == 4
    assert one(spark, "", chunks.fixed_chunks) == []


def test_packed_chunks_keep_the_text(spark):
    body = " ".join(f"sentence {i}." for i in range(60))
    got = one(spark, body, lambda c: chunks.sentence_chunks(c, 200, 4))
    assert "".join(got) == body and all(len(x) <= 200 for x in got)


def test_hybrid_and_semantic(spark):
    body = "a" * 50 + "\n\n" + "b" * 10
    assert max(map(len, one(spark, body, lambda c: chunks.hybrid_chunks(c, 20)))) <= 20
    assert "".join(one(spark, "one two. one two three. four five.", lambda c: chunks.semantic_chunks(c))) == "one two. one two three. four five."


def test_html_metadata(spark):
    html = '<title>测试HTML文档</title><meta name="author" content="x"><meta name="author" content="y"><h1>标题</h1>'
    assert one(spark, html, metadata.html_metadata) == {"title": "测试HTML文档", "h1": "标题", "meta_author": "y"}


def test_empty_content_has_no_metadata(spark):
    assert one(spark, "", metadata.content_metadata) == {}


def test_segmenter():
    s = tokens.Segmenter()
    assert s.cut("我爱北京天安门") == ["我", "爱", "北京", "天安门"]
    assert len(s.cut("计算机科学", "SEARCH")) >= len(s.cut("计算机科学"))
    assert s.add("爱北京").cut("我爱北京") == ["我", "爱北京"]
    assert s.cut(None) == []
