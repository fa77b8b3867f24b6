"""The corpus pipeline against brute force over rows, where doc_id is null or repeats."""

from __future__ import annotations

import random
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from harvest.llm import langid, packing, quality  # noqa: E402
from harvest.llm.queries import tokenizer  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string"


def _grams(text):
    w = (text or "").lower().split()
    n = corpus_pipeline.NEAR_WORDS
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def test_run_decides_by_row(spark, tmp_path):
    rng = random.Random(6)
    good = lambda: " ".join(f"word{rng.choice('abcdefgh')}{rng.choice('xyz')}ing" for _ in range(60)) + "."
    spam = lambda k: "SPAM!! " * 40 + str(k)
    near = lambda t: t.rsplit(" ", 1)[0] + " last."
    rows = [(i, good(), "en", "a") for i in range(200)] + [(1000 + i, spam(i), "en", "a") for i in range(80)]
    labels = [(i, int(i < 1000)) for i, *_ in rows[::2]]
    twice, own = good(), good()
    odd = [(None, good()), (None, spam(500)), (None, near(rows[7][1])), (5001, good()), (5001, spam(501)), (5002, twice), (5002, twice), (5002, near(twice)), (5003, good()), (5003, good()), (None, own), (None, near(own)), (5004, None)]
    rows += [(i, t, "en", "a") for i, t in odd]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")

    def frame(now, ids):
        return spark.createDataFrame([(ids(k), *r[1:]) for k, r in enumerate(now)], SCHEMA)

    def left(now, decided):
        passed = {r["doc_id"] for r in decided.collect()}
        return [r for k, r in enumerate(now) if k in passed]

    number = lambda k: k
    model = quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    now = left(rows, quality.classify(frame(rows, number), model).where("keep"))
    now = left(now, langid.identify(frame(now, number), langid.train(frame(now, lambda k: now[k][0]))).where("not rejected"))
    sets, group = [_grams(r[1]) for r in now], list(range(len(now)))
    for a in range(len(now)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= corpus_pipeline.NEAR_PERCENT * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    best: dict = {}
    for g, r in zip(group, now, strict=True):
        best[g] = min(best.get(g, r), r, key=lambda x: (x[0] is None, x[0] or 0))
    ids = Counter(r[0] for r in best.values())
    assert (ids[5001], ids[5002], ids[5003], ids[None]) == (1, 1, 2, 2) and ids[7] == 1

    # of rows that repeat an id within a group, either may stay
    texts = {(r["doc_id"], r["ids_crc32"]) for r in packing.pack(spark.createDataFrame(now, SCHEMA), tokenizer("word_bpe_49k.json")).collect()}
    got = [(r["doc_id"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert Counter(i for i, _ in got) == ids
    assert len(set(got)) == len(got) and set(got) <= texts
