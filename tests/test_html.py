"""The page tree: structure, selectors, and time linear in the page."""

from __future__ import annotations

import time

import pytest

from harvest.functions import html

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{a:"</p>"}</style><script type=x>if (a<b) "</div>"</script></head>
<body><!-- <p>no</p> --><div class="a b" id=z><p>One<br>two<p>three</div><ul><li><a HREF='/x?a=1&amp;b=2' title="a>b">L<b>i</b>nk</a><li data-k>second</ul></p><img src=i /><span/>tail"""


def test_tree():
    root = html.parse(PAGE)
    assert html.select(root, "title")[0].all_text() == "T & t"
    assert [n.text for n in html.select(root, "script, style")] == ['p{a:"</p>"}', 'if (a<b) "</div>"']
    assert [n.all_text() for n in html.select(root, "div.a.b#z p")] == ["Onetwothree", "three"]
    a = html.select(root, "ul > li a[href^='/x'][title]")[0]
    assert a.attrs == {"href": "/x?a=1&b=2", "title": "a>b"} and a.all_text() == "Link" and html.closest(a, "ul") is html.select(root, "ul")[0]
    assert [n.tag for n in html.after(html.select(root, "#z")[0])] == ["ul", "img", "span"]
    assert [n.attrs for n in html.select(root, "li[data-k]")] == [{"data-k": ""}] and html.select(a, "b")[0].parent is a and html.select(a, "li") == []
    assert root.all_text().endswith("tail") and "no" not in root.all_text()
    assert [n.i for n in root.walk()] == list(range(1, len(root.page.nodes)))


@pytest.mark.parametrize(("page", "tags", "text"), [(None, [], ""), ("", [], ""), ("a < b", [], "a < b"), ("<p", ["p"], ""), ("x</p>y", [], "xy"), ("<a href='open>t", ["a"], ""), ("<!-- open", [], ""), ("<script>open", ["script"], ""), ("<P>a</P >b", ["p"], "ab"), ("<i a=1 a=2>", ["i"], "")])
def test_odd_pages(page, tags, text):
    root = html.parse(page)
    assert [n.tag for n in root.walk()] == tags and root.all_text() == text


def test_the_first_of_two_attributes_counts():
    assert html.select(html.parse("<i A=1 a=2 b c='x'y=z>"), "i")[0].attrs == {"a": "1", "b": "", "c": "x", "y": "z"}


@pytest.mark.parametrize("unit", ["<div>", "<a ", "<!-- ", '<a "', "</div>", "<p><b>", "<script>", "<", "&amp", "<p></p>", "<ul><li></ul>"])
def test_a_megabyte_is_read_in_linear_time(unit):
    began = time.monotonic()
    root = html.parse(unit * (1_000_000 // len(unit)))
    html.select(root, "div p, ul b, h1.x, [href]"), root.all_text()
    assert time.monotonic() - began < 10


def test_selector_that_is_none():
    with pytest.raises(ValueError, match="selector"):
        html.select(html.parse("<p>"), "p:first")
