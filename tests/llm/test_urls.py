"""URL rules, aliases and components."""

import random

from pyspark.sql import functions as F

from foliant.llm import url_filters as u
from foliant.llm.components import connected_components
from foliant.llm.queries import RULES


def test_components_are_those_of_a_walk(spark):
    rng = random.Random(1)
    edges = [
        (rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)
    ] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(100)] + [(7, 7), (None, 3)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in connected_components(df).collect()} == {x: find(x) for x in list(top)}
    assert connected_components(df.limit(0)).count() == 0


PAGES = [
    (1, "http://a.org/x#f", '<link rel="canonical" href="HTTP://Bad.net/es/1">'),
    (2, "http://b.org/y", "<meta http-equiv='refresh' content='0; url=/z?a=1&amp;b=2'>"),
    (3, "http://b.org/z?a=1&b=2", "<LINK href=http://a.org/x rel=canonical>"),
    (4, "http://c.org/", "<!-- <link rel=canonical href=http://bad.net/es/1> --><script>'<link rel=canonical href=http://bad.net/es/1>'</script>"),
    (5, None, "canonical"),
    (6, "http://d.org/q", '<link rel="alternate canonical" href="//www.example.com/en/1">'),
    (7, "http://bad.net/es/1", None),
    (8, "http://e.org/q", '<link rel=canonical href="http://bad.net/es/9">'),
    (9, "http://f.org/a/b", '<meta http-equiv=refresh content="5;URL=c">'),
    (10, "http://f.org/a/c", '<link rel=canonical href="http://d.org/q">'),
    (11, "no scheme", "refresh"),
    (12, "HTTPS://X.Example.COM/en/p?q#z", ""),
    (13, "http://net/es/", ""),
    (14, "http://notnet/es/", ""),
    (1, "http://a.org/x#f", None),
]


def test_blocks_reach_aliases_and_allows_come_first(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("rule", F.lit("clash"))
    rows = u.judge_urls(df, RULES).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == len(PAGES)
    assert {k: v[3] for k, v in got.items()} == {
        1: "block",
        2: "block",
        3: "block",
        4: "allow",
        5: "allow",
        6: "allow",
        7: "block",
        8: "block",
        9: "allow",
        10: "allow",
        11: "allow",
        12: "block",
        13: "block",
        14: "allow"
    }
    assert got[12] == ("x.example.com", "/en/p", "example.com/en/", "block") and got[5] == ("", "", None, "allow") and got[13][0] == "net"
    assert u.judge_urls(df.limit(0), RULES).count() == 0


def test_redirect_tables_make_edges(spark):
    df = spark.createDataFrame([(1, "http://p.org/1", None), (2, "http://q.org/", None)], "page_id long, url string, html string")
    moves = spark.createDataFrame(
        [("http://p.org/1", "http://m.org/"), ("http://m.org", "http://z.net/fr/x"), (None, "http://q.org/")],
        "source string, target string"
    )
    assert {r.page_id: r.verdict for r in u.judge_urls(df, RULES, moves).collect()} == {1: "block", 2: "allow"}


def test_many_rules_give_what_few_give(spark, monkeypatch):
    urls = [
        (i, f"http://{h}{p}", None) for i, (h, p) in enumerate(
            (h, p) for h in (
                "com", "example.com", "www.example.com", "a.www.example.com", "x.net", "net.org"
            ) for p in ("", "/", "/en/", "/en/1", "/es/2", "/fr")
        )
    ]
    df = spark.createDataFrame(urls, "page_id long, url string, html string")
    few = {r.page_id: (r.rule, r.verdict) for r in u.judge_urls(df, RULES).collect()}
    monkeypatch.setattr(u, "MAX_INLINE", 2)
    assert {r.page_id: (r.rule, r.verdict) for r in u.judge_urls(df, RULES).collect()} == few
