"""The training-data operators against brute force, round trips and held-out accuracy, with the odd cases."""

from __future__ import annotations

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public = pytest.importorskip("public_tokenizers")

from harvest.llm import ann, langid, maxent_lm, ngram_join, packing, piece_lattice, quality, queries, span_ids, token_output, topk, url_filters  # noqa: E402
from harvest.llm import common as llm_common  # noqa: E402
from harvest.llm import vectors as llm_vectors  # noqa: E402
from harvest.llm.common import chunks, one_hash, word_hashes  # noqa: E402
from harvest.llm.components import components  # noqa: E402

ODD = [(900, None, None), (901, "", "en"), (902, "x", None), (903, "  \n ", "fr"), (904, "é ☃\x0bZ", "en"), (905, "a b c d e", "en"), (906, "A  b\tc d E", "en"), (None, "a b c d e", "en"), (907, "w" * 5000, "de"), (908, "the cat sat " * 3000, "en"), (908, "the cat sat " * 3000, "en"), (909, "one text of an id that has two", "en"), (909, "a b c d e f", "en")]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    voices = {"en": "the and that with ing tion er re", "fr": "le eau que ment oi des aux elle", "de": "sch ung ver ich der heit en zu"}
    rows = []
    for i in range(120):
        lang = rng.choice(list(voices))
        own = voices[lang].split()
        words = ["".join(rng.choices(own, k=rng.randint(1, 3))) for _ in range(rng.randint(3, 80))]
        rows.append((i, " ".join(words), lang, f"src{i % 3}", 0))
        if i % 6 == 0:  # near copies
            for k in range(3):
                other = list(words)
                other[rng.randrange(len(other))] = f"new{k}"
                rows.append((200 + 3 * i + k, " ".join(other), lang, "src0", 0))
    rows += [(i, t, g, None, 1) for i, t, g in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _t long").cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_words_match_the_pattern():
    texts = ["Ab cd\tEf", None, "", "x\x0b\x0cY", "é  Z\x1cq"]
    for first, end, data, offsets in chunks(pa.array(texts), 5):
        hashes, rows = word_hashes(data, offsets)
        for i in range(first, end):
            assert hashes[rows[i - first] : rows[i - first + 1]].tolist() == [one_hash(w.encode()) for w in _words(texts[i])]


def test_url_filters_odd_cases(spark):
    captures = [(1, None, 5), (2, "http://a.example/x", None), (3, "nonsense", 5), (4, "https://A.example:80/p/q?z#f", 5), (4, "https://A.example:80/p/q?z#f", 5)]
    captures += [(5, "http://user:pw@spam.example/x", 5), (6, "http://a.example@spam.example/", 5), (7, "http://spam.example./x", 5), (8, "http://[2001:DB8::1]:8080/x", 5), (9, "http://x.y.spam.example", 5), (10, "", 5), (None, "http://b.example/" + "d/" * 2000, 5)]
    captures = spark.createDataFrame(captures, "page_id long, url string, t long").withColumn("fetched_at", F.timestamp_seconds("t")).selectExpr("*", "'q' host", "1 scope", "2 pattern", "3 decision")
    lists = [("l", "host", "a.example", "block", "add", 1), ("l", "path", "a.example/p", "allow", "add", 5), ("l", "host", "a.example", "block", "remove", 9), (None,) * 6, ("l", "domain", "spam.example", "block", "add", 2), ("k", "domain", "spam.example", "block", "add", 2), ("l", "host", "[2001:db8::1]", "block", "add", 2), ("l", "path", "b.example", "block", "add", 2), ("l", "path", "b.example/d/d", "allow", "add", 2)]
    entries = spark.createDataFrame(lists, "list_name string, scope string, pattern string, verdict string, action string, t long").withColumn("at", F.timestamp_seconds("t"))
    want = [(None, "allow", 2, "l"), (1, "none", 0, None), (2, "none", 0, None), (3, "none", 0, None), (4, "allow", 2, "l"), (4, "allow", 2, "l"), (5, "block", 2, "l"), (6, "block", 2, "l"), (7, "block", 2, "l"), (8, "block", 1, "l"), (9, "block", 2, "l"), (10, "none", 0, None)]
    for most in (0, 1000):  # by shuffle and by broadcast
        got = url_filters.filter_urls(captures, entries, broadcast_rows=most)
        assert sorted(((r["page_id"], r["decision"], r["n_active"], r["list_name"]) for r in got.collect()), key=str) == sorted(want, key=str)
        none = url_filters.filter_urls(captures, entries.limit(0), broadcast_rows=most)
        assert {(r["decision"], r["n_active"]) for r in none.collect()} == {("none", 0)} and none.count() == captures.count()
        assert url_filters.filter_urls(captures.limit(0), entries, broadcast_rows=most).count() == 0
    plan = url_filters.filter_urls(captures, entries)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "_h_row" not in plan


def test_language(spark, docs, empty):
    held = langid.held_out(docs)
    model = langid.train(docs, learn=~held)
    got = langid.identify(docs, model).join(docs.where("_t = 0").select("doc_id", "lang"), "doc_id").where(held)
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.9
    odd = {r["doc_id"]: r for r in langid.identify(docs.where("_t = 1"), model).collect()}
    assert [odd[k]["lang_pred"] for k in (900, 901, 903)] == ["und"] * 3 and odd[902]["lang_pred"] in model.langs
    assert all(0 <= r["score"] <= 1 for r in odd.values())
    assert langid.identify(empty, langid.train(empty)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, langid.train(empty)).collect()} == {"und"}


def test_language_with_few_rows_keeps_them(spark):
    rows = [(i, "the cat sat on the mat and that", "en") for i in range(60)] + [(100, "zxq zxq qxz", "one"), (101, "zxq", None)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "qxz zxq"), (2, "that cat")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(asked, model).collect()} == {1: "one", 2: "en"}


def _letters_of(k):
    """Letters of an invented language: its own ten of a block."""
    return [chr(0x4E00 + 10 * k + j) for j in range(10)]


def test_three_hundred_languages(spark, monkeypatch):
    rng = random.Random(6)
    say = lambda k, n=30: "".join(rng.choices([*_letters_of(k), " "], k=n))
    rows = [(10 * k + j, say(k), f"l{k:03d}") for k in range(300) for j in range(4 if k % 3 else 40 if k % 9 == 0 else 6)]
    rows = [(i, t, g) for i, (_, t, g) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS g", "2 AS cells", "'x' AS score", "3 AS n")
    asked = spark.createDataFrame([(k, say(k)) for k in range(300)] + [(1000, "".join(chr(0x3041 + j % 80) for j in range(60))), (1001, "".join(_letters_of(5)) * 20000)], "doc_id long, text string")
    got = {}
    for dense in (0, 1 << 30):
        monkeypatch.setattr(langid, "DENSE", dense)
        model = langid.train(docs)
        assert len(model.langs) == 300 and (model.grams[1].rows is None) == (dense == 0)
        got[dense] = {r.doc_id: r for r in langid.identify(asked, model).collect()}
    for k, r in got[0].items():
        other = got[1 << 30][k]
        assert (r.lang_pred, r.rejected) == (other.lang_pred, other.rejected) and abs(r.score - other.score) < 1e-4 and abs(r.entropy - other.entropy) < 1e-4
    assert all(r.lang_pred == f"l{k:03d}" and not r.rejected for k, r in got[0].items() if k < 300)
    assert got[0][1000].rejected  # letters that no language has
    assert got[0][1001].lang_pred == "l005"
    monkeypatch.setattr(langid, "DENSE", 0)
    few = langid.train(docs, total=600)
    assert len(few.langs) == 300 and sum(len(x.value) for x in few.grams.values()) < sum(len(x.value) for x in model.grams.values())


def test_equal_texts_in_two_languages_go_to_the_first(spark):
    docs = spark.createDataFrame([(i, "abc abd", g) for i, g in enumerate(["b", "a"] * 5)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(docs, langid.train(docs)).collect()} == {"a"}


def test_kneser_ney_by_brute_force():
    """Interpolated Kneser-Ney of order 3 with one discount a level, from the definition."""
    rng = random.Random(12)
    texts = ["".join(rng.choices("abcd ", k=40)) for _ in range(12)]
    order, pad = 3, [0, 0]
    ids = lambda t: [*pad, *(0 if c == " " else ord(c) for c in re.sub(" +", " ", t).lstrip() + " ")]
    counts = Counter(tuple(s[k : k + order]) for s in map(ids, texts) for k in range(len(s) - order + 1))
    m = langid.KneserNey.fit(["x"], np.array(list(counts), np.uint32), np.zeros(len(counts), np.int64), np.array(list(counts.values())), order)
    levels = {3: counts}
    for size in (2, 1):
        levels[size] = Counter(g[1:] for g in levels[size + 1])

    def p(g):
        size = len(g)
        if not size:
            return 1 / (len(levels[1]) + 2)
        level, context = levels[size], g[:-1]
        n1, n2 = (sum(v == k for v in level.values()) for k in (1, 2))
        discount = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
        total = sum(v for h, v in level.items() if h[:-1] == context)
        if not total:
            return p(g[1:])
        types = sum(h[:-1] == context for h in level)
        return max(level.get(g, 0) - discount, 0) / total + discount * types / total * p(g[1:])

    for _ in range(200):
        g = tuple(rng.choice([0, 97, 98, 99, 100, 101]) for _ in range(3))
        assert m.char_scores(np.array(g, np.uint32))[0, 0] == pytest.approx(math.log(p(g)), abs=1e-4)


def test_kneser_ney_sums_to_one():
    cells = np.array([[0, 1, 2], [0, 1, 3], [1, 2, 3], [0, 2, 1]], np.uint32)
    m = langid.KneserNey.fit(["x"], cells, np.zeros(4, np.int64), np.array([3, 1, 2, 1]), 3)
    alphabet = sorted({1, 2, 3})
    total = sum(math.exp(m.char_scores(np.array([0, 1, c], np.uint32))[0, 0]) for c in alphabet)
    unseen = math.exp(m.char_scores(np.array([0, 1, 99], np.uint32))[0, 0])
    assert total + 2 * unseen == pytest.approx(1, abs=1e-5)  # the alphabet and two symbols' worth of the floor


def _brute_components(rows, percent, size):
    sets = {}
    for i, t in rows:
        w = _words(t)
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("percent", "size"), [(85, 4), (60, 2)])
def test_ngram_components(spark, docs, empty, percent, size):
    def check(rows):
        """By row; a component's id is the smallest of its rows' ids."""
        by_row = _brute_components(list(enumerate(t for _, t in rows)), percent, size)
        groups: dict = {}
        for k, (i, _) in enumerate(rows):
            groups.setdefault(by_row[k][1], []).append(i)
        want = sorted(((i, by_row[k][0], min((x for x in groups[by_row[k][1]] if x is not None), default=None)) for k, (i, _) in enumerate(rows)), key=str)
        df = spark.createDataFrame([(i, t, 7, "x", 1, 2, 3) for i, t in rows], "doc_id long, text string, n int, rep string, token int, component int, row int")
        assert sorted((tuple(r) for r in ngram_join.ngram_components(df, percent, size).collect()), key=str) == want

    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(rows)  # null and repeated ids, one of them with two texts
    if size == 4:
        check([(i, t) for i, t in dict(rows).items() if i is not None])
    assert ngram_join.ngram_components(empty).count() == 0


def test_ngram_components_of_hot_keys_and_long_lists(spark, monkeypatch):
    monkeypatch.setattr(llm_common, "HOT", 8)
    monkeypatch.setattr(ngram_join, "LIST_BLOCK", 3)
    rng = random.Random(11)
    passage = [f"p{k}" for k in range(30)]
    texts = [" ".join(passage)] * 20 + [" ".join([*passage[:k], f"x{k}", *passage[k + 1 :]]) for k in range(30) for _ in (0, 1)]
    texts += [" ".join([f"own{i}q{k}" for k in range(rng.randint(1, 9))] + passage[:6]) for i in range(60)]  # a list of many that don't link
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 80, 2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == _brute_components(rows, 80, 2)


def test_ngram_light_classes_of_the_larger_size(spark, percent=80, common=4, rare=5):
    rng = random.Random(percent)
    sets = [[f"own{i}w{k}" for k in range(common)] for i in range(60)]
    for k in range(4):  # two sets of the larger size share all but one, without and with a set of what they share
        base = [f"base{k}w{j}" for j in range(rare - 1)]
        sets += [[*base, f"left{k}"], [*base, f"right{k}"]] + ([base] if k > 1 else [])
    rng.shuffle(sets)
    rows = list(enumerate(" ".join(s) for s in sets))
    assert ngram_join.boundary(dict(Counter(len(s) for s in sets)), percent) >= rare
    want = _brute_components(rows, percent, 1)
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), percent, 1).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_components_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 102), (102, 101)], "a long, b long")
    assert {r["id"]: r["component"] for r in components(pairs).collect()} == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100, 102: 100}


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(600, 8)) / 3)]
    rows += [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] + [1.0] * 7), (1060, [None] + [1.0] * 7), (1080, rows[0][1]), (1081, rows[0][1]), (1100, []), (None, rows[0][1])]
    rows += [(20, rows[20][1]), (20, rows[21][1]), (14, rows[20][1])]  # ids that repeat, as query and as candidate
    rows += [(2000 + i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(30, 3)))]  # another dimension
    rows += [(3000 + i, [float(i % 4), 1.0, 0.0, 0.5, 0.0]) for i in range(60)]  # ties
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 row", "2 score", "'x' rank")


def _searched(vectors, zeros, f):
    """Of each query row its list of (score, id); rows of one id are listed in any order."""
    rows = [(r[0], np.array(r[1], float)) for r in vectors.collect() if r[0] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and (zeros or any(r[1]))]
    out = []
    for n, (q, v) in enumerate(rows):
        if q % 20 == 0:
            out.append((q, [(-s, i) for s, i in sorted((-f(v, w), i) for m, (i, w) in enumerate(rows) if m != n and len(v) == len(w))[:20]]))
    return out


def _lists(rows):
    """The same from a result: a list ends where ranks begin again."""
    out: dict = {}
    for r in rows:
        out.setdefault(r["query_id"], {}).setdefault(r["rank"], []).append((r["score"], r["vec_id"]))
    assert all(sorted(by_rank) == list(range(1, len(by_rank) + 1)) for by_rank in out.values())
    return out


def _by_rank(lists):
    out: dict = {}
    for q, found in lists:
        for k, x in enumerate(found, 1):
            out.setdefault(q, {}).setdefault(k, []).append(x)
    return out


def test_exact_topk(vectors):
    want = _by_rank(_searched(vectors, True, lambda a, b: int(np.floor(64 * a) @ np.floor(64 * b))))
    for block in (None, 100):
        got = _lists(topk.exact_topk(vectors, block=block).collect())
        assert {q: {k: sorted(x) for k, x in y.items()} for q, y in got.items()} == {q: {k: sorted(x) for k, x in y.items()} for q, y in want.items()}
    assert topk.exact_topk(vectors.limit(0)).count() == 0
    with pytest.raises(ValueError, match="63 bits"):
        topk.exact_topk(vectors.selectExpr("vec_id", "transform(embedding, x -> x * 1e9) embedding"))


def test_ann_of_all_partitions_is_exact(vectors):
    want = _by_rank(_searched(vectors, False, lambda a, b: float(np.einsum("nd,d->n", b[None], a)[0])))
    got = _lists(ann.ann_search(vectors, block=100, parts=8, recall=1.0).collect())
    assert {q: {k: sorted(x) for k, x in y.items()} for q, y in got.items()} == {q: {k: sorted(x) for k, x in y.items()} for q, y in want.items()}
    assert ann.ann_search(vectors.limit(0)).count() == 0
    assert {r["vec_id"] for r in ann.ann_search(vectors.where("vec_id in (0, 1)")).collect()} == {1}
    assert ann.ann_search(vectors.where("vec_id = 1")).count() == 0


def test_ann_recall_at_the_registered_parameters(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.select("vec_id", "embedding").toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(float)
    got: dict = {}
    for r in ann.ann_search(df).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for n in np.flatnonzero(ids % 20 == 0):
        s = x @ x[n]
        s[n] = -np.inf
        near = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        hits, total = hits + len(near & got[ids[n]]), total + len(near)
    assert hits / total >= 0.9


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1000])
def test_feistel_permutes(n):
    assert sorted(token_output.feistel(np.arange(n), n, 5).tolist()) == list(range(n))


def test_training_order_round_trip(spark, docs, empty, tmp_path):
    args = (public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    got = token_output.training_order(docs, *args, path=str(tmp_path / "s"), length=16, records=64).collect()
    assert sorted(r["slot"] for r in got) == list(range(len(got)))
    assert all((r["shard"], r["offset"]) == (r["slot"] // 64, r["slot"] % 64 * token_output.stride(16)) for r in got)
    # slots are the images of the sequences' indices: those of one document follow one another in the input
    place = token_output.feistel(np.arange(len(got)), len(got), 17)
    index = np.argsort(place)
    long = sorted((r["piece"], int(index[r["slot"]])) for r in got if r["doc_id"] == 907)
    assert len(long) > 100 and [i for _, i in long] == list(range(long[0][1], long[0][1] + len(long)))
    with pytest.raises(Exception, match="already exists"):
        token_output.materialise(docs, str(tmp_path / "s"), *args)
    records = token_output.read_records(spark, str(tmp_path / "s"), length=16, records=64).collect()
    parts: dict = {}
    for r in records:
        parts.setdefault(r["doc_id"], Counter())[(r["piece"], r["ids"])] += 1
    import base64

    import tiktoken

    with open(args[0], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want: dict = {}
    for r in docs.collect():
        ids = np.array([*enc.encode_ordinary(r["text"] or ""), 50256], "<u2")
        for k in range(-(-len(ids) // 16)):
            want.setdefault(r["doc_id"], Counter())[(k, ids[16 * k : 16 * k + 16].tobytes())] += 1
    assert {k: {(p, bytes(b)): n for (p, b), n in v.items()} for k, v in parts.items()} == want
    assert [r["slot"] for r in token_output.read_records(spark, str(tmp_path / "s"), 62, 66, length=16, records=64).orderBy("slot").collect()] == [62, 63, 64, 65]
    assert token_output.training_order(empty, *args).count() == 0


def brute_nbest(m, t, n):
    s, found = "▁" + t.replace(" ", "▁"), []

    def walk(i, total):
        if i == len(s):
            found.append(total)
        for k in range(1, min(m.longest, len(s) - i) + 1):
            p = s[i : i + k]
            if p in m.index:
                walk(i + k, total + m.score[m.index[p]])
            elif k == 1:
                walk(i + 1, total + m.unknown * len(p.encode()))

    walk(0, 0.0)
    return sorted(found, reverse=True)[:n]


def test_nbest(docs, empty):
    m = piece_lattice.load(public.path("piece_bpe_32k.model"))

    texts = ["the cat", "a  b", "é☃x\nyz", "hello", "x", "to be or"]
    ((_, _, data, offsets),) = chunks(pa.array(texts))
    for t, got in zip(texts, piece_lattice.segment(m, data, offsets, 4), strict=True):
        assert np.allclose([s for s, _ in got], brute_nbest(m, t, 4))
        assert all(m.decode(np.frombuffer(i, "<u4").tolist()) == t for _, i in got)
    rows = piece_lattice.digest_nbest(docs, public.path("piece_bpe_32k.model")).collect()
    assert all(r["decoded"] for r in rows)
    assert {r["n_pieces"] for r in rows if r["doc_id"] in (900, 901)} == {0}
    back = piece_lattice.decode(piece_lattice.encode_nbest(docs, public.path("piece_bpe_32k.model")), public.path("piece_bpe_32k.model")).where("rank = 1")
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert piece_lattice.digest_nbest(empty, public.path("piece_bpe_32k.model")).count() == 0


def test_nbest_of_ties_and_long_words():
    import time
    import tracemalloc

    m = piece_lattice.load(public.path("piece_bpe_32k.model"))
    rng = random.Random(9)
    kinds = {"mixed": "".join(rng.choices("ABCDEFabcdefghij0123456789+/", k=20_000)), "one letter": "w" * 20_000}
    for word in kinds.values():
        seconds = []
        for n in (5_000, 20_000):
            ((_, _, data, offsets),) = chunks(pa.array([word[:n]]))
            tracemalloc.start()
            began = time.process_time()
            (got,) = piece_lattice.segment(m, data, offsets, 4)
            seconds.append(time.process_time() - began)
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            assert peak < n * 8000  # bytes a character
            assert len({i for _, i in got}) == 4 and [s for s, _ in got] == sorted((s for s, _ in got), reverse=True)
            assert all(m.decode(np.frombuffer(i, "<u4").tolist()) == word[:n] for _, i in got)
            assert all(sum(m.score[k] for k in np.frombuffer(i, "<u4")) == pytest.approx(s) for s, i in got)
        assert seconds[1] < 9 * seconds[0]
    for _ in range(300):  # every segmentation of short words, ties among them
        word = "".join(rng.choices(rng.choice(["ab", "aw", "the "]), k=rng.randint(1, 9)))
        ((_, _, data, offsets),) = chunks(pa.array([word]))
        (got,) = piece_lattice.segment(m, data, offsets, 7)
        assert len({i for _, i in got}) == len(got)
        want = brute_nbest(m, word, 7)
        assert np.allclose([s for s, _ in got], want)


def test_nbest_decodes_every_rank(spark):
    path = public.path("piece_bpe_32k.model")
    m = piece_lattice.load(path)
    rows = spark.createDataFrame([(1, "the cat sat there"), (2, "the\u2581cat sat there")], "doc_id long, text string")
    got = {(r["doc_id"], r["rank"]): r["decoded"] for r in piece_lattice.digest_nbest(rows, path).collect()}
    assert got == {(i, k): i == 1 for i in (1, 2) for k in (1, 2, 3, 4)}
    table = [bytes([m.byte_of[i]]) if i in m.byte_of else t.replace("▁", " ").encode() for i, t in enumerate(m.text)]
    rng = random.Random(8)
    few = [m.index[c] for c in "ab"] + [m.index[c] for c in ("aa", "ab", "ba") if c in m.index]
    for _ in range(2000):
        ids = [[rng.choice(few) for _ in range(rng.randint(0, 5))] for _ in range(4)]
        whole = [b"".join(table[i] for i in x) for x in ids]
        want = rng.choice(whole)
        assert piece_lattice.decoded(table, [np.array(x, "<u4").tobytes() for x in ids], want) == [w == want for w in whole]


def test_packing(docs, empty):
    path = public.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    special = docs.limit(1).selectExpr("cast(950 as long) doc_id", "'a <|endoftext|> b<|STARTOFTEXT|>' text", "lang", "source", "_t")
    docs = docs.unionByName(special)
    rows = packing.pack(docs.selectExpr("*", "1 length", "2 _rank", "3 offset"), path).collect()
    want = Counter()
    for r in docs.collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for k, s in enumerate(range(0, len(ids), 2048)):
            want[(r["doc_id"], k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 2048) + 1
    assert packing.pack(empty, path).count() == 0


def _strings(n):
    rng = random.Random(17)
    parts = list("abcXYZ019 \n\t\r\x0b\x0c.,!?'\"#%-()&<|>$") + ["é", "ß", "İ", "Σ", "ŉ", "\u0301", "\u0307", "\u00a0", "\u2003", "\u3000", "\x85", "\x1c", "☃", "😀", "中", "한", "ᄒ", "ᅡ", "ड़", "\u093c", "Ⅷ", "²", "ﬁ", "\u212b", "\u200d", "\x00"]
    parts += ["'s", "'ll", "'RE", "the", "and", "<|endoftext|>", "<|", "  ", "\n\n"]
    out = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(n)]
    out += ["".join(chr(rng.choice([rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x2FFFF), rng.randrange(32, 127), 32])) for _ in range(rng.randint(1, 8))) for _ in range(n)]
    return out + ["a" + chr(c) + "!!" for c in range(32, 0xD800)]


def test_span_ids_are_the_tokenizers():
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    texts = _strings(30_000)
    words, path = public.path("word_bpe_49k.json"), public.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    t, e = Tokenizer.from_file(words), tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for own, ids in ((span_ids.WordIds(words, 5000), lambda x: t.encode(x, add_special_tokens=False).ids), (span_ids.ByteIds(path, public.PATTERN, 5000), e.encode_ordinary)):
        for first, _, data, offsets in chunks(pa.array(texts), 20_000):
            flat, begin = own.encode(data, offsets, 7)
            assert all(flat[a:b].tolist() == [*ids(texts[first + r]), 7] for r, (a, b) in enumerate(zip(begin, begin[1:], strict=False)))


def test_packing_plan_is_tight():
    rng = random.Random(1)
    lengths = Counter(min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(50_000))
    bins = packing.plan(dict(lengths))
    assert sum(n for _, n in bins) <= 1.01 * sum(n * c for n, c in lengths.items()) / 2048 + 1
    assert all(sum(b) <= 2048 for b, _ in bins)
    used = Counter()
    for b, n in bins:
        for x in b:
            used[x] += n
    assert used == lengths


def test_lm(docs, empty, monkeypatch):
    monkeypatch.setattr(maxent_lm, "COMMON", 20)  # most words then meet by the join
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    counts: Counter = Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            counts.update([*_words(t), "\0end"])
    total, distinct = sum(counts.values()), len(counts)
    want = sorted((str(i), len(_words(t)) + 1, sum(counts[w] > 0 for w in [*_words(t), "\0end"]), round(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in [*_words(t), "\0end"]), 5)) for i, t in rows)
    got = maxent_lm.score(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {total} and all(r["score"] < 0 for r in got)
    assert maxent_lm.score(empty).count() == 0


def test_lm_score_by_brute_force(docs):
    rows = docs.where("doc_id < 60 or _t = 1").select("doc_id", "text")
    model, seen, common, totals = maxent_lm.fit(rows)
    assert np.abs(model.w).max() > 0.01
    counts = {r["h"] % 2**64: r["c"] for r in seen.collect()}
    group = lambda w: int(maxent_lm.tokens(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[1][0])
    k, at = maxent_lm._K, {int(h): i for i, h in enumerate(model.words)}
    mixed = lambda x: int(llm_common.mix(np.array([x % 2**64], np.uint64))[0])

    def soft(z):
        e = np.exp(z - z.max())
        return e / e.sum()

    def probability(h, g, one, two):
        c, leaf = (int(model.cls[at[h]]), int(model.leaf[at[h]])) if h in at else (g, 0)
        keys = [one * int(k[0]), two * int(k[1]), one * int(k[2]) + two * int(k[3])]
        a, b = model.class_rows, model.leaf_rows
        z = model.class_bias + sum(model.w[i * a + mixed(x) % a] for i, x in enumerate(keys))
        y = model.leaf_bias[c] + sum(model.w[3 * a + i * b + mixed(x + (c + 1) * int(k[4])) % b] for i, x in enumerate(keys[:2]))
        p = soft(z)[c] * soft(y)[leaf]
        n = totals["ends"] if h == int(maxent_lm._END) else counts.get(h, 0)
        return p if leaf else p * (n + 0.1) / 10 ** model.rest[c]

    start, end = int(maxent_lm._START), int(maxent_lm._END)
    got = {(r["doc_id"], r["n_tokens"]): r["score"] for r in maxent_lm.score_with(rows.withColumn("held", F.lit(False)), model, seen, common, totals).collect()}
    for i, text in rows.collect()[:25]:
        one = two = start
        total = 0.0
        for h, g in [*((one_hash(w.encode()), group(w)) for w in _words(text)), (end, 0)]:
            total += math.log10(probability(h, g, one, two))
            one, two = h, one
        assert got[(i, len(_words(text)) + 1)] == pytest.approx(total, abs=1e-3 * (len(_words(text)) + 1))
    # all known words, the end and one unknown word of each class make one
    known = {one_hash(w.encode()): group(w) for _, t in rows.collect() for w in _words(t)}
    assert known.keys() == counts.keys()
    for one, two in ((start, start), (next(iter(known)), start), (12345, 678)):
        mass = sum(probability(h, g, one, two) for h, g in known.items()) + probability(end, 0, one, two)
        mass += sum(probability(-1 - c, c, one, two) for c in range(maxent_lm.CLASSES))
        assert mass == pytest.approx(1, abs=1e-4)


def test_lm_commonest_keeps_its_bound(spark):
    seen = spark.createDataFrame([(i, 0, c) for i, c in enumerate([1] * 50 + [2] * 9 + [100, 101, 5000])], "h long, g int, c long")
    assert [maxent_lm.commonest(seen, n).num_rows for n in (0, 1, 3, 11, 12, 61, 62)] == [0, 1, 3, 3, 12, 12, 62]


def test_lm_learns_from_the_history(spark):
    rng = random.Random(5)
    pairs = {f"w{k}": f"v{k}" for k in range(30)}
    text = lambda: " ".join(x for w in rng.choices(list(pairs), k=40) for x in (w, pairs[w] if rng.random() < 0.9 else "z"))
    got = maxent_lm.score(spark.createDataFrame([(i, text()) for i in range(2000)], "doc_id long, text string")).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (got[0] - got[1]) / got[2] > 0.4


def test_quality(spark, docs, empty):
    rng = random.Random(4)
    good = [(i, " ".join(f"word{rng.randrange(500)}" for _ in range(60)) + ".", "a", "en") for i in range(300)]
    bad = [(1000 + i, ("SPAM!! " * 40) + str(i), "a", "en") for i in range(100)]
    d = spark.createDataFrame([*good, *bad, (None, None, None, None), (2000, "", "a", "en")], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, *_ in good[::2] + bad[::2]] + [(1, None), (3, 0), (3, 1)], "doc_id long, quality int")
    model = quality.train(d, labels)
    rows = quality.classify(d, model).collect()
    got = {r["doc_id"]: r["keep"] for r in rows if r["doc_id"] is not None and r["doc_id"] < 2000}
    assert sum(got[i] == (i < 1000) for i in got) / len(got) > 0.97
    wide = d.selectExpr("*", "1 score", "'x' keep", "array(doc_id) y", "2 aside")
    assert sorted(map(str, quality.accepted(wide, model).collect())) == sorted(str(r) for r, k in zip(wide.collect(), rows, strict=True) if k["keep"])
    assert quality.classify(docs, model).count() == docs.count()
    assert quality.train(d, labels.limit(0)) is None and quality.train(d.limit(0), labels) is None
    assert {r["keep"] for r in quality.classify(docs, None).collect()} == {True}
    assert quality.classify(empty, None).count() == 0 and quality.accepted(empty, model).count() == 0


def test_quality_sums_count_every_document(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["SPAM!! " * 20, "some plain words of a text "]) * rng.randint(1, 3), rng.choice("ab"), "en") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)
    data = [quality.text_view(x, o) for _, _, x, o in chunks(pa.array([r[1] for r in rows]))][0]
    meta = [quality.meta_view(x, o, [r[2] for r in rows], ["en"] * len(rows)) for _, _, x, o in chunks(pa.array([r[1] for r in rows]))][0]
    noise = np.random.default_rng(3)
    w = [noise.normal(size=v.shape[1] + 1) for v in (data, meta)]
    for x, v in zip((data, meta), w, strict=True):  # both labels are sure of some
        z = x @ v[:-1]
        v *= 6 / z.std()
        v[-1] = -6 * z.mean() / z.std()
    z = [x @ v[:-1] + v[-1] for x, v in zip((data, meta), w, strict=True)]
    p = [1 / (1 + np.exp(-np.clip(v, -30, 30))) for v in z]
    for k, (n, gradient, curvature) in enumerate(quality._sums(d, w, [(-1.0, 2.0)] * 2)):
        x = np.hstack([(data, meta)[k], np.ones((300, 1))])
        for label, sure in ((1, z[1 - k] >= 2), (0, z[1 - k] <= -1)):
            q, own = p[k][sure], x[sure]
            assert n[label] == sure.sum() > 0
            assert np.allclose(gradient[label], sum(((a - label) * r for a, r in zip(q, own, strict=True)), np.zeros(x.shape[1])), rtol=1e-3, atol=2e-3)
            assert np.allclose(curvature[label], sum((a * (1 - a) * r * r.sum() for a, r in zip(q, own, strict=True)), np.zeros(x.shape[1])), rtol=1e-2, atol=2e-3)
            # the bound holds: along any direction the loss bends less
            hessian = (own * (q * (1 - q))[:, None]).T @ own
            for direction in noise.normal(size=(5, x.shape[1])):
                assert direction @ hessian @ direction <= (curvature[label] * direction**2).sum() * 1.01 + 1e-6


def test_sure_bounds():
    z = np.array([-3.0, -2, -1, 0, 1, 2, 3])
    few = quality.sure_bounds(z, np.array([0, 0, 0, 1, 0, 1, 1]))
    assert few == (-np.inf, np.inf)  # too few rows to be sure by
    many = quality.sure_bounds(np.repeat(z, 100), np.repeat([0, 0, 0, 1, 0, 1, 1], 100))
    assert many == (-1.0, 2.0) and quality.sure_bounds(np.zeros(0), np.zeros(0)) == (-np.inf, np.inf)


def test_quality_whole_by_brute_force(spark, monkeypatch):
    """All of co-training on a small table: the fit with sums over each unlabelled row one by one, then the combination."""
    rng = random.Random(9)
    rows = [(i, rng.choice(["Buy!! $$ now " * 9, "a plain line of words here. " * 4]) + str(i), rng.choice("ab"), "en") for i in range(160)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, int("plain" in t)) for i, t, _, _ in rows[:90]], "doc_id long, quality int")
    monkeypatch.setattr(quality, "SURE", 0.8)  # few rows are kept aside
    model = quality.train(d, labels, labelled=1 << 40)
    column = pa.array([r[1] for r in rows])
    text = np.vstack([quality.text_view(x, o) for _, _, x, o in chunks(column)])
    meta = np.vstack([quality.meta_view(x, o, [r[2] for r in rows], ["en"] * len(rows)) for _, _, x, o in chunks(column)])
    aside = np.array([r[0] for r in spark.range(90).select(F.pmod(F.xxhash64("id", F.lit("aside")), F.lit(3)) == 0).collect()])
    y = np.array([int("plain" in r[1]) for r in rows[:90]])

    used = []

    def sums(w, bounds):
        out = []
        used.append(bounds)
        for k, views in ((0, (text, meta)), (1, (meta, text))):
            own, other = (np.hstack([v[90:], np.ones((70, 1))]) for v in views)
            n, g, c = np.zeros(2), np.zeros((2, own.shape[1])), np.zeros((2, own.shape[1]))
            for x, z in zip(own, other, strict=True):
                p, at = 1 / (1 + math.exp(-max(-30, min(30, x @ w[k])))), z @ w[1 - k]
                low, high = bounds[1 - k]
                if at >= high or at <= low:
                    label = int(at >= high)
                    n[label], g[label], c[label] = n[label] + 1, g[label] + (p - label) * x, c[label] + p * (1 - p) * x * x.sum()
            out.append((n, g, c))
        return out

    want = quality.QualityModel.fit(text[:90], meta[:90], y, aside, sums)
    assert len(used) == quality.ROUNDS and all(np.isfinite(b).all() for b in np.array(used)[:, 0])
    got = {r.doc_id: (r.text_score, r.meta_score, r.score) for r in quality.classify(d, model).collect()}
    for i, *each in zip(range(160), *want.scores(text, meta), strict=True):
        assert got[i] == pytest.approx(each, abs=0.02)


def test_quality_on_labels_kept_from_it(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(d, quality.train(d, labels.where("doc_id % 4 <> 0"))).join(labels.where("doc_id % 4 = 0"), "doc_id").agg(*(F.avg((F.col(c) == (F.col("quality") == 1)).cast("int")) for c in ("keep",)), F.count("*")).first()
    assert got[0] > 0.97 and got[1] > 300


def test_names():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 14))


def test_topk_blocks_follow_the_queries(spark, monkeypatch):
    monkeypatch.setattr(llm_vectors, "CELL_BYTES", 64 * 8 * 10)
    asked = []
    real = topk.blocks_for
    monkeypatch.setattr(topk, "blocks_for", lambda rows, *a: asked.append((rows, real(rows, *a))) or real(rows, *a))
    rng = np.random.default_rng(1)
    rows = [(20 * i, rng.integers(-3, 4, 64).astype(float).tolist()) for i in range(100)]  # every row is a query
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.exact_topk(df, k=3, scale=1).collect()}
    assert asked[0] == (100, 10)  # 10 vectors a block
    v = np.array([x for _, x in rows])
    for i in range(100):
        best = sorted((-int(v[i] @ v[j]), 20 * j) for j in range(100) if j != i)[:3]
        assert [got[20 * i, k + 1] for k in range(3)] == [(j, -s) for s, j in best]


def test_ann_nearest_in_slices(monkeypatch):
    monkeypatch.setattr(ann, "SLICE", 100)
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(40, 8)), rng.normal(size=(9, 8))
    assert (np.sort(ann.nearest(q, x, 5)) == np.sort(np.argsort(-(q @ x.T), axis=1)[:, :5])).all() and ann.nearest(q, x, 50).shape == (9, 40)
    graph = ann.neighbour_graph(x, 3)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    assert (np.sort(graph) == np.sort(np.argsort(-s, axis=1)[:, :3])).all()


def test_lm_score_does_not_depend_on_the_split(docs, monkeypatch):
    monkeypatch.setattr(maxent_lm, "SHARD_TOKENS", 400)
    monkeypatch.setattr(maxent_lm, "CHUNK_BYTES", 2000)
    rows = docs.select("doc_id", "text")
    train = maxent_lm.train
    monkeypatch.setattr(maxent_lm, "train", lambda t, m, n, rounds: train(t, m, n, rounds, shard_tokens=400))
    got = []
    for parts in (1, 12):
        done = maxent_lm.score(rows.repartition(parts)).collect()
        got.append(sorted((str(r.doc_id), r.n_tokens, r.base_score, r.score) for r in done))
    assert len(got[0]) == len(got[1]) > 100
    for a, b in zip(*got, strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-9) and a[3] == pytest.approx(b[3], rel=1e-6)
    assert any(abs(s - b) > 0.1 for _, _, b, s in got[0])  # weights were trained


def test_lm_pieces_are_cut_by_rows_alone():
    texts = [("a" * (i % 7), i // 20) for i in range(100)]
    whole = pa.table({"shard": [s for _, s in texts], "text": [t for t, _ in texts]})
    want = None
    for size in (1, 3, 17, 100):
        got = [(int(s), t.to_pylist()) for s, t in maxent_lm._pieces(whole.to_batches(max_chunksize=size), limit=10)]
        assert [(t, s) for s, ts in got for t in ts] == texts
        assert want in (None, got)
        want = got


def test_lm_a_round_leaves_nothing_of_the_weights_on_the_driver(spark, monkeypatch):
    made, broadcast = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: made.append(broadcast(value)) or made[-1])
    docs = spark.createDataFrame([(k, f"some words {k % 7} again {k % 3}") for k in range(300)], "doc_id long, text string")
    assert maxent_lm.score(docs, rounds=3).count() == 300
    assert [os.path.exists(b._path) for b in made] == [False] * 3 + [True]  # one for each round, and the one that scores


def test_lm_changes_are_added_by_block():
    w, size = np.ones((2 * maxent_lm._BLOCK, maxent_lm.CLASSES), np.float32), maxent_lm._BLOCK
    value = np.concatenate([np.full(size * maxent_lm.CLASSES, 6, np.float32), np.full(size - 1, 3, np.float32), np.zeros(1, np.float32)])
    changes = pa.table({"part": [0], "block": [1], "value": pa.array([value.tobytes()], pa.binary())})
    maxent_lm._add(w, changes)
    maxent_lm._add(w, changes.slice(1))
    assert (w[:size] == 1).all() and (w[size:-1] == 3).all() and (w[-1] == 7).all()
