"""The toxicity operator: features by brute force, the cross-fitted lexicon, and labels kept from it."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from harvest.llm import toxicity as T

ODD = [None, "", " \n ", "...", "You IDIOT!!", "you are a st*pid l0ser", "Dummkopf, du!", "i d i o t", "NO WAY ??", "stuuupid", "x" * 30000, "é ☃ É", "1234 55-66", "the cat " * 9000, "idiot " + "word " * 12 + "you", "İdiot ıdiot", "a!b c.d"]
LEX = T.Lexicon.of([(0, b"zork", np.array([2.0, 3.0, 0.0, 1.0, 4.0])), (5, b"blarg", np.array([1.0, 1.0, 1.0, 1.0, 5.0]))])


def brute(text, fold):
    raw = [w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w]
    mark = lambda c: c < "\x80" and not c.isalnum()
    words = []
    for w in ("".join(c.lower()[:1] for c in w) for w in raw):  # one letter for one, as Arrow lowers
        while w and mark(w[0]):
            w = w[1:]
        while w and mark(w[-1]):
            w = w[:-1]
        words.append(w)
    weight = lambda w: max([{"zork": (2, 3, 0, 1, 4)}.get(w, (0,) * 5)[fold]] + [(1, 1, 1, 1, 5)[fold]] * (len(w.encode()) > 5 and w.encode()[:5] == b"blarg"))
    weights = [weight(w) for w in words]
    insults, second = [w in T.INSULTS for w in words], [w in T.SECOND for w in words]
    letter = lambda c: c >= "\x80" or c.isalpha()
    odd = [any(letter(c) for c in w) and any(not letter(c) for c in w) for w in words]
    long = [re.search(r"([a-z])\1\1", w) is not None for w in words]

    def plain(w, skip):
        got = "".join(c for c in w.translate(str.maketrans("013457@$!", "oieastasi")) if c.isalpha()) if not skip else "".join(c.translate(str.maketrans("57$", "sts")) for c in w if c not in "aeiou0134@!" and (c.isalpha() or c in "57$"))
        return re.sub(r"(.)\1+", r"\1", got)

    pool = [*T.INSULTS, "zork"]
    known = {(s, p) for w in pool for s, least in ((False, 4), (True, 3)) if len((p := plain(w, s)).encode()) >= least}
    hidden = [(o or g) and not i and not h and any((s, plain(w, s)) in known for s in (False, True)) for w, o, g, i, h in zip(words, odd, long, insults, weights, strict=True)]
    bad = [k for k in range(len(words)) if weights[k] or insults[k] or hidden[k]]
    near = max([1 - abs(j - k) / 11 for k in bad for j in range(len(words)) if second[j] and abs(j - k) <= 10], default=0)
    n, data = max(len(words), 1), (text or "").encode()
    upper, ascii_letters = sum(65 <= c <= 90 for c in data), sum(chr(c).isalpha() and c < 128 for c in data)
    is_mark = [32 < c < 127 and not chr(c).isalnum() for c in data]
    out = [sum(map(bool, weights)) / n, sum(weights) / n, max(weights, default=0), math.log1p(sum(map(bool, weights))), sum(insults) / n, math.log1p(sum(insults)), sum(hidden) / n, math.log1p(sum(hidden)), near, sum(second) / n]
    out += [upper / max(ascii_letters, 1), sum(len(re.findall("[A-Z]", w)) >= 3 and not re.search("[a-z]", w) for w in raw) / n, data.count(b"!") / n, data.count(b"?") / n, sum(is_mark) / max(len(data), 1)]
    out += [sum(is_mark[i] and data[i] == data[i - 1] for i in range(1, len(data))) / n, sum(odd) / n, sum(long) / n, sum(len(w.encode()) == 1 and letter(w) for w in words) / n, math.log1p(len(words)), len(data) / n, sum(c >= 128 for c in data) / max(len(data), 1)]
    return out


def test_features_equal_the_definition():
    texts = [*ODD, "zork ZORK zorks blarg blargs you", "z0rk? zo*rk blargh!"]
    for fold in (0, 2, T.FOLDS):
        got = T.features(pa.array(texts), LEX, np.full(len(texts), fold))
        for t, row in zip(texts, got, strict=True):
            want = brute(t, fold)
            assert all(abs(a - b) < 1e-9 for a, b in zip(row, want, strict=True)), (t, fold, [(n, a, b) for n, a, b in zip(T.NAMES, row, want, strict=True) if abs(a - b) > 1e-9])


@pytest.fixture(scope="module")
def made(spark):
    """Prose of invented words; toxic rows hold words of an invented stem, which the general lexicon doesn't know."""
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(900):
        words = ["".join(rng.choice(list("abdegiklmnorstu"), 5)) for _ in range(int(rng.integers(5, 60)))]
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(3):
                words.insert(int(rng.integers(len(words) + 1)), "grumph" + "".join(rng.choice(list("aeiou"), 2)))
        rows.append((i, " ".join(words), "en", "s"))
        if i % 9:
            labels.append((i, None, toxic))
    rows += [(1000 + i, t, None, None) for i, t in enumerate(ODD)] + [(None, "you idiot", "en", "s"), (5, rows[5][1], "en", "s")]
    labels += [(1000, 1, None), (1001, 1, 0), (1001, 1, 1), (None, 1, 1), (77777, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS y", "'a' AS fold", "2 AS score", "doc_id AS x", "text AS features")
    return docs.cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_learns_unknown_stems_and_scores_every_row(made):
    docs, labels, rows = made
    model = T.train(docs, labels)
    got = T.classify(docs, model).collect()
    assert len(got) == len(rows) and sum(r.doc_id == 5 for r in got) == 2 and sum(r.doc_id is None for r in got) == 1
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 100 and sum(r.predicted == (r.doc_id % 5 == 0) for r in held) / len(held) > 0.98
    by_split = {r.doc_id: r.score for r in T.classify(docs.repartition(3), T.train(docs.repartition(5), labels.repartition(2))).collect()}
    assert all(abs(by_split[r.doc_id] - r.score) < 1e-9 for r in got)


def test_held_out_labels_teach_nothing(spark, made):
    docs, labels, _ = made
    turned = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = (sorted((str(r.doc_id), r.score) for r in T.classify(docs, T.train(docs, x)).collect()) for x in (labels, turned))
    assert a == b


def test_lexicon_of_a_fold_leaves_its_rows_out(spark):
    rows = [("grumble you", 1, k) for k in range(4) for _ in range(6)] + [("snort here", 1, 0)] * 6 + [("plain words here", 0, k) for k in range(4) for _ in range(40)]
    found = {(k, t): w for k, t, w in T.learned_terms(spark.createDataFrame(rows, "text string, y int, fold int"))}
    whole = found[0, b"grumble"]
    assert (whole > 0).all() and (0, b"plain") not in found
    assert found[0, b"snort"][0] == 0 and found[0, b"snort"][4] > 0


def test_without_both_classes_and_empty(made):
    docs, labels, rows = made
    for own, share in ((labels.limit(0), 0.0), (labels.where("toxic = 1"), 1.0)):
        got = T.classify(docs, T.train(docs, own)).collect()
        assert len(got) == len(rows) and {(r.score, r.predicted) for r in got} == {(share, int(share))}
    assert T.classify(docs.limit(0), T.train(docs.limit(0), labels)).collect() == []
