"""The source divergence audit against the definition, term by term."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from harvest.llm import divergence

WORDS = "the The cat Café café ÉTÉ été x-ray 12 ☃ a_b zug und der".split()


def brute(rows, least=3, ranks=200):
    docs = [(t or "", g or "", s or "") for _, t, g, s in rows]
    terms = [[re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)] for t, _, _ in docs]
    out = {}
    for lang in {g for _, g, _ in docs}:
        df = Counter(w for (_, g, _), ws in zip(docs, terms, strict=True) if g == lang for w in set(ws))
        kept = sorted(w for w, n in df.items() if n >= least)
        count = defaultdict(Counter)
        for (_, g, s), ws in zip(docs, terms, strict=True):
            if g == lang:
                count[s].update(w for w in ws if df[w] >= least)
        whole = sum(count.values(), Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}  # noqa: E731, B023
        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in count:
            pairs = [(-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in count if o != s]
            own = [(-f(p[s][w], q[w]), w.encode(), w) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(own)[:ranks])):
                for k, (value, _, item) in enumerate(found):
                    out[lang, s, part, k + 1] = (item, -value)
    return out


def got(df):
    rows = df.collect()
    out = {(r.lang, r.source, r.part, r["rank"]): (r.item, r.value) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    made = []
    for i in range(150):
        words = rng.choice(WORDS, rng.integers(0, 40), p=np.arange(1, len(WORDS) + 1) / sum(range(1, len(WORDS) + 1)))
        made.append((i, " ".join(words), ["en", "de", None, ""][min(i % 7, 3)], ["a", "b", "é", "B", None, ""][int(rng.integers(6))]))
    made += [(1, None, "en", "a"), (None, "the the", "en", "only nulls"), (500, "", "fr", "alone"), (501, "\x00 12", "fr", "other"), (502, "the " * 40000, "en", "long"), (502, "the " * 40000, "en", "long")]
    return made


def test_equals_the_definition(spark, rows):
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS n", "text AS term", "'x' AS value", "lang AS part", "source AS docs")
    assert got(divergence.audit(df)) == want
    assert got(divergence.audit(df.repartition(7), ranks=2)) == brute(rows, ranks=2)


def test_common_terms_and_small_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(divergence, "COMMON", 1)
    monkeypatch.setattr(divergence, "PAIRS", 5)
    monkeypatch.setattr(divergence, "CHUNK", 300)
    assert got(divergence.audit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))) == brute(rows)


def test_nothing_kept_and_empty(spark):
    few = [(1, "a b", "en", "x"), (2, "a", "en", "y"), (3, "c", "en", "x")]
    df = spark.createDataFrame(few, "doc_id long, text string, lang string, source string")
    assert got(divergence.audit(df)) == {("en", "x", "pair", 1): ("y", 0), ("en", "y", "pair", 1): ("x", 0)}
    assert divergence.audit(df.limit(0)).collect() == []


def test_shares_of_large_counts():
    n, total = np.array([10**15 - 1, 5 * 10**12, 1, 7], np.int64), np.array([10**15, 9 * 10**14, 10**15, 9], np.int64)
    assert divergence.shares(n, total).tolist() == [1 + 10**9 * int(a) // int(b) for a, b in zip(n, total, strict=True)]


def test_added_up_tells_documents_apart():
    text = ["a A b", "a", "", "b b", "c"]
    data, offsets = divergence.text_buffer(pa.array(text))
    b = divergence.added_up(data, offsets, pa.array([5, 6, 7, 8, 9]), pa.array(["en"] * 5), pa.array(["s", "s", "s", "s", "t"]))
    assert sorted(zip(*(b.column(c).to_pylist() for c in ("term", "source", "doc", "docs", "n")), strict=True)) == [("a", "s", 5, 2, 3), ("b", "s", 5, 2, 3), ("c", "t", 9, 1, 1)]
