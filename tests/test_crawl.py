"""Crawls over many links and nested frames against row models; markup of any kind in linear time."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from harvest.sources import crawl, links


def page(n: int) -> str:
    return f"https://x.example/{n}"


@pytest.mark.parametrize("depth", [0, 1, 3, 50])
def test_spread_is_breadth_first(spark, depth):
    rng = random.Random(depth)
    edges = {i: [rng.randrange(90) for _ in range(rng.choice([0, 1, 3]))] + [0] for i in range(80)}  # all lead to 0; 80 to 89 aren't fetched
    edges |= {i: [i + 1] for i in range(100, 140)} | {140: [100, 140]}  # a long chain that ends in a cycle
    seen, level = {5: (0, None), 100: (0, None)}, [5, 100]
    for k in range(1, depth + 1):
        found = {}
        for u in level:
            for v in edges.get(u, []):
                if v not in seen:
                    found[v] = min(found.get(v, page(u)), page(u))
        seen |= {v: (k, via) for v, via in found.items()}
        level = list(found)
    body = [(page(u), "".join(f"<p><a href=/{v}#f>{v}</a>" for v in vs)) for u, vs in edges.items()]
    fetched = spark.createDataFrame(body, "url string, html string")
    seeds = spark.createDataFrame([(page(5),), (page(100),), (page(5),), (None,)], "url string")
    got = crawl.spread(seeds, crawl.follow(fetched), depth).collect()
    assert sorted((r.url, r.depth, r.via) for r in got) == sorted((page(v), d, via) for v, (d, via) in seen.items())


def test_spread_takes_any_expansion_and_keys(spark):
    e = spark.createDataFrame([(1, 0, 2), (1, 1, 3), (2, 0, None), (3, 0, 1)], "url long, pos int, target long")
    got = crawl.spread(spark.createDataFrame([(1,)], "url long"), lambda new: e.join(new, "url"), 9)
    assert sorted((r.url, r.depth, r.via) for r in got.collect()) == [(1, 0, None), (2, 1, 1), (3, 1, 1)]
    assert crawl.spread(spark.createDataFrame([], "url long"), lambda new: e.join(new, "url"), 9).collect() == []


def test_follow_keeps_to_the_site(spark):
    body = '<a href="https://y.example/1">out</a><a href="/a.pdf">file</a><a href="#x">mark</a><a href="mailto:a@x.example">m</a><a href="/2/?utm_source=q&b=1">in</a>'
    fetched = spark.createDataFrame([(page(1), body)], "url string, html string")
    expand = crawl.follow(fetched)
    assert [(r.pos, r.target) for r in expand(fetched.select("url")).collect()] == [(4, "https://x.example/2?b=1")]


def test_nested_frames(spark):
    bodies = {
        1: "<a href=/a>a</a><iframe src='/2'></iframe><!-- <iframe src='/9'> --><iframe title='x'></iframe><iframe name=\"a>b\" SRC=/3></iframe><a href=/b>b</a>",
        2: "<a href=/c>c</a><iframe src=/3></iframe><iframe src=/1></iframe>",
        3: "<a href=/d>d</a><iframe src=/3></iframe><iframe src=/gone></iframe>",
        4: "<a href=/e>e</a>",
    }
    own = {1: ["/a", "/b"], 2: ["/c"], 3: ["/d"], 4: ["/e"]}
    inner = {1: [(1, 2), (2, 3)], 2: [(1, 3), (2, 1)], 3: [(1, 3)], 4: []}

    def model(root, at, path, chain, left):
        out = [(page(root), path, page(at), k, h) for k, h in enumerate(own[at])]
        for k, to in inner[at]:
            if left and to not in chain:
                out += model(root, to, (*path, k), (*chain, to), left - 1)
        return out

    fetched = spark.createDataFrame([(page(k), b) for k, b in bodies.items()], "url string, html string")
    for depth in (0, 1, 2, 9):
        got = sorted((r.url, tuple(r.path), r.page, r.pos, r.href) for r in crawl.nested_anchors(fetched, depth).collect())
        assert got == sorted(x for k in bodies for x in model(k, k, (), (k,), depth))
    some = crawl.nested_anchors(fetched, 9, fetched.where(F.col("url") == page(2)).select("url")).collect()
    assert {r.url for r in some} == {page(2)}
    assert crawl.nested_anchors(fetched.limit(0), 3).collect() == []


@pytest.mark.parametrize(
    ("tag", "want"),
    [("<a href=x>", "x"), ("<a\nHREF = 'x y' >", "x y"), ('<a href="a&amp;b">', "a&b"), ("<a data-href=n href=y>", "y"), ("<a title='href=n' href=y>", "y"), ('<a b="c"href="d">', "d"), ("<a href>", None), ("<a href=''>", ""), ("<a href=>", ""), ("<a b", None), ("<a href='open", "open"), ("<a hrefs=n>", None), ("<a href=1 href=2>", "1"), ("<a x=href=3>", None), (None, None)],
)
def test_attribute(spark, tag, want):
    assert spark.createDataFrame([(tag,)], "t string").select(links.attribute(F.col("t"), "href")).first()[0] == want


@pytest.mark.parametrize("unit", ["<!-- ", "<a x ", '<a "', "<a href='", "<script>", "<a b>x</a   ", "<", "<a b=c d=e ", "<iframe <", "<style ", "</a ", "<a href=/x>", "&amp"])
def test_a_megabyte_of_open_markup(spark, unit):
    df = spark.createDataFrame([(page(1), unit * (1_000_000 // len(unit)) + " <a href=/end>end</a>")], "url string, html string").cache()
    df.count()
    began = time.monotonic()
    links.anchors(df).count(), crawl.frames(df).count()
    assert time.monotonic() - began < 10
