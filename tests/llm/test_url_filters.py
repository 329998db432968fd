from warung.llm import url_filters as U
from warung.llm.components import components
from warung.llm.queries import URL_RULES

PAGES = [
    (1, "http://A.Example.COM/en/1?x#y", None), (2, "https://www.example.com/en/2", ""), (3, "http://x.net/es/3", None),
    (4, "http://x.org/a", '<link rel="canonical" href="http://x.net/es/3">'), (5, "http://y.org/b", "<LINK HREF='/c' REL=canonical>"),
    (6, "http://y.org/c/", '<meta http-equiv="refresh" content="0; url=http://x.org/a">'), (7, "http://z.org/q", None), (8, None, None),
    (9, "no scheme", None), (10, "http://x.net", None), (11, "http://q.org/1", '<link rel=canonical href="http://x.net/fr/9">'),
    (12, "http://q.org/2", '<link rel=canonical href="http://q.org/1">'), (13, "http://ok.com/5", '<link rel=canonical href="http://q.org/2">'),
    (7, "http://z.org/q", None), (14, "HTTP://HOST?a/b", None), (15, "http://net/es/1", None), (16, "http://x.org/a?utm_source=f#t", None),
]


def judged(spark, pages, **more):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS node", "3 AS verdict")
    return {r.page_id: r for r in U.judge(spark, df, URL_RULES, **more).collect()}


def test_rules_and_aliases(spark):
    out = judged(spark, PAGES)
    assert (out[1].host, out[1].path, out[1].rule, out[1].verdict) == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert (out[2].rule, out[2].verdict) == ("www.example.com/en/", "allow")
    assert (out[3].rule, out[3].verdict) == ("net/es/", "block") and out[15].verdict == "block"
    for i in (4, 5, 6, 16):                        # aliases of a blocked page, directly and through one another
        assert out[i].rule is None and out[i].verdict == "block", i
    assert out[7].verdict == "allow" and out[7].component is None
    for i in (8, 9):
        assert (out[i].host, out[i].path, out[i].rule, out[i].verdict) == ("", "", None, "allow")
    assert (out[10].path, out[10].rule) == ("", None)
    for i in (11, 12, 13):                         # an explicit allow among the aliases goes first
        assert out[i].verdict == "allow", i
    assert (out[14].host, out[14].path) == ("host", "")


def test_redirect_table(spark):
    moves = spark.createDataFrame([("http://z.org/q", "http://w.org/1"), ("http://w.org/1", "http://x.net/fr/2")], "a string, b string")
    assert judged(spark, PAGES, redirects=moves)[7].verdict == "block"


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert U.judge(spark, df, URL_RULES).count() == 0


def test_repeated_rows_give_rows(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert U.judge(spark, df, URL_RULES).count() == len(PAGES)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components(spark, df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}}
