"""Links of pages that are relative, or whose hosts differ in case."""

from urllib.parse import urljoin

from pyspark.sql import functions as F

from graphloom.llm import urlfilter


def test_block_over_relative_links(spark, tmp_path):
    link = '<link rel="canonical" href="{}">'
    rows = [(1, "http://alias.net/a", link.format("//Example.org/es/1")), (2, "HTTP://ALIAS.net/a", ""), (3, "http://alias.net/A", ""), (4, "http://alias.net/b", link.format("/a")), (5, None, link.format("/a"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.verdict for r in urlfilter.op10_url_filter(spark, str(tmp_path)).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "allow"}


def test_resolved(spark):
    bases = ["http://a.org", "http://a.org/", "https://A.org/x/y/z?q=1#f", "http://a.org/x?u=http://b/c"]
    targets = ["/es/x", "//host/x", "x", "../x", "../../../x/./y/..", "./", "..", "?n=2", "#top", "https://b.org/e", "x?u=http://c/d", "/a/../b?c/../d"]
    rows = [(b, t) for b in bases for t in targets]
    got = spark.createDataFrame(rows, "b string, t string").select("b", "t", urlfilter.resolved(F.col("t"), F.col("b")).alias("r")).collect()
    assert [(r.b, r.t, r.r) for r in got] == [(b, t, urljoin(b, t)) for b, t in rows]
    odd = spark.createDataFrame([("http://a.org/", "mailto:x@y"), ("nothing", "/x")], "b string, t string")
    assert [r[0] for r in odd.select(urlfilter.resolved(F.col("t"), F.col("b"))).collect()] == [None, None]


def _against_sql(spark, tmp_path, rows):
    import duckdb

    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(str, map(tuple, urlfilter.op10_url_filter(spark, str(tmp_path)).collect())))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    cursor = con.execute(urlfilter.OP10_SQL)
    assert [c[0] for c in cursor.description] == ["page_id", "host", "path", "rule", "verdict"]
    assert got == sorted(map(str, cursor.fetchall()))
    return {r.page_id: r.verdict for r in urlfilter.op10_url_filter(spark, str(tmp_path)).collect()}


def test_chains_equal_the_sql(spark, tmp_path, rng):
    link, hop = '<link rel="canonical" href="{}">', "<META http-equiv='refresh' content='0; url={}'>"
    rows = [(i, f"http://h{i % 7}.net/c/{i}", rng.choice([link, hop]).format(rng.choice([f"/c/{i + 7}", f"../c/./{i + 7}", f"http://H{i % 7}.net/c/{i + 7}?a=1&amp;b=2", f"//h{(i + 1) % 7}.net/c/{i + 1}", "?x", "#y", "mailto:a@b"]))) for i in range(300)]
    rows += [(900 + i, f"http://h{i}.net/c/{i * 41}", link.format(t)) for i, t in enumerate(["http://example.org/es/1", "http://x.com/fr/2", "http://x.com/de/3", "http://b.com/de/"])]
    rows += [(990, None, link.format("/x")), (991, "nothing", link.format("/x")), (992, "http://z.org/../a/./b/..", link.format("..")), (993, "http://z.org", link.format("x/../y")), (990, None, link.format("/x"))]
    got = _against_sql(spark, tmp_path, rows)
    assert len(set(got.values())) == 2


def test_no_python_on_the_path(spark):
    pages = spark.createDataFrame([(1, "http://a.net/1", '<link rel="canonical" href="http://example.org/es/1?a&amp;b">', 7, 8, 9, 10)], "page_id long, url string, html string, own int, same int, carried int, w int")
    edges = urlfilter.alias_edges(pages)
    assert edges.first().b == "http://example.org/es/1?a&b"
    many = [*urlfilter.RULES, *(("allow", f"h{i}.net", "/") for i in range(300))]
    for rules in (urlfilter.RULES, many):
        df = urlfilter.filter_urls(pages, rules, edges)
        assert "MapIn" not in df._jdf.queryExecution().toString() and "Python" not in df._jdf.queryExecution().toString()
        row = df.first()
        assert (row.verdict, row.own, row.same, row.carried, row.w) == ("block", 7, 8, 9, 10)


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert urlfilter.filter_urls(pages, urlfilter.RULES, urlfilter.alias_edges(pages)).count() == 0


def test_many_rules_equal_few(spark, rng):
    hosts = [".".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h in hosts for p in ("/", "/x", "/x/y")}.values())
    urls = [(i, f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/x', '/x/y/z', '/q'])}") for i in range(200)] + [(500, None), (501, "x")]
    df = spark.createDataFrame(urls, "page_id long, url string")
    few = sorted(map(str, urlfilter.filter_urls(df, rules).collect()))
    old, urlfilter.INLINE_RULES = urlfilter.INLINE_RULES, 3
    try:
        assert sorted(map(str, urlfilter.filter_urls(df, rules).select(*["page_id", "url", "host", "path", "rule", "verdict"]).collect())) == few
    finally:
        urlfilter.INLINE_RULES = old
