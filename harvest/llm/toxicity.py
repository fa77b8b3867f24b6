"""Toxicity: gradient-boosted trees over dense features of a whole text, with isotonic calibration.

Features are densities of lexicons (a general one of insults; one of words and word beginnings that is learned from the
labelled rows), how near second-person words stand to their hits, capitals, punctuation and obfuscation rates. Words that
digits, marks or long letters disguise are looked up by their letters without vowels and repeats too.

The learned lexicon is cross-fitted: a labelled row's features come from entries and weights that the rows of its own
fold had no part in, so the trees see lexicon hits as new documents have them. One fold is kept from the trees and
calibrates their margin. Trees and calibration are Spark's own; they are fitted on a bounded sample, in one partition
in the order of ids, so that the model doesn't depend on how the tables are split.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Lookup, chunks, drop, key_crc32, mix, span_hashes, table, text_buffer, whole_texts, word_spans

#: About so many labelled rows are fitted on, chosen by a hash of doc_id.
LABELLED = 12_000
FOLDS = 4
#: A term belongs to the learned lexicon when so many toxic rows, and this share of them, have it, ...
LEAST, LEAST_SHARE = 4, 0.01
#: ... its log odds are so high, and so many standard errors above 0.
ODDS, ERRORS = 1.5, 2.5
#: Bytes of word beginnings that are terms, of longer words.
STEMS = (4, 5, 6, 7)
#: Words between a hit and a second-person word that count as near.
NEAR = 10
TREES, DEPTH, RATE, LEAF_ROWS = 30, 3, 0.2, 20

#: Insults of four languages.
INSULTS = (
    "asshole bastard bitch clown coward creep cretin crook disgusting dumb dumbass fool freak fuck fucking garbage hate idiot idiotic imbecile jerk kill liar "
    "loser maggot moron moronic nasty pathetic pig pig-headed rat retard retarded scum shit shut sick slut stupid trash ugly useless vermin whore worthless "
    "abschaum arsch arschloch bastard blöd dreck dumm dummkopf hure idiot lügner schlampe schwein scheiße trottel versager wertlos "
    "abruti connard connasse con crétin débile dégueulasse idiot imbécile merde minable ordure pute raclure salaud salope stupide "
    "asqueroso basura cabrón cerdo escoria estúpido gilipollas idiota imbécil inútil mierda patético perdedor puta tonto"
).split()
#: Second-person words of the same languages.
SECOND = "you your yours yourself yourselves u ur youre you're du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros os".split()

_LETTER = np.zeros(256, bool)
_LETTER[0x30:0x3A] = _LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
#: What digits and marks stand for in a disguised word; 0 is left out.
_PLAIN = np.zeros(256, np.uint8)
_PLAIN[0x61:0x7B] = np.arange(0x61, 0x7B)
_PLAIN[0x80:] = np.arange(0x80, 0x100)
for _mark, _for in zip("013457@$!", "oieastasi", strict=True):
    _PLAIN[ord(_mark)] = ord(_for)
_CONSONANT = _PLAIN.copy()
_CONSONANT[list(b"aeiou0134@!")] = 0

NAMES = (
    "learned_density learned_weight learned_strongest learned_count insult_density insult_count disguised_density disguised_count near_second second_density "
    "capitals capital_words exclamations questions marks mark_runs odd_words long_letters single_letters words word_length other_letters".split()
)


def words_of(column: pa.Array, first: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of the rows; where their words begin and end without marks at the ends, and their rows. A word of marks is empty."""
    data, offsets = text_buffer(pc.utf8_lower(column.slice(first, end - first)))
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    starts, ends, begin = word_spans(data, offsets)
    at = np.arange(len(data))
    letter = _LETTER[data]
    after = np.minimum.accumulate(np.where(letter, at, len(data))[::-1])[::-1] if len(data) else at
    before = np.maximum.accumulate(np.where(letter, at, -1))
    if len(starts):
        starts = np.minimum(after[starts], ends)
        ends = np.maximum(before[ends - 1] + 1, starts)
    return data, starts, ends, np.repeat(np.arange(end - first), np.diff(begin))


def _terms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(length or 0 for whole words, places of the words, starts, ends) of each kind of term."""
    yield 0, np.flatnonzero(ends > starts), starts, ends
    for size in STEMS:
        yield size, np.flatnonzero(ends - starts > size), starts, starts + size


def term_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int) -> np.ndarray:
    return mix(span_hashes(data, starts, ends, fold=False) + np.uint64(kind))


def hash_of(term: bytes, kind: int = 0) -> int:
    return int(term_hashes(np.frombuffer(term, np.uint8), np.zeros(1, np.int64), np.full(1, len(term)), kind)[0])


def disguised(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words (not overlapping, in order) by what their bytes stand for, without repeats, and the lengths hashed."""
    size = ends - starts
    word = np.repeat(np.arange(len(starts)), size)
    at = np.arange(len(word)) + np.repeat(starts - (np.cumsum(size) - size), size)
    letters = plain[data[at]]
    word, letters = word[letters > 0], letters[letters > 0]
    if len(word):
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (letters[1:] != letters[:-1])
        word, letters = word[new], letters[new]
    n = np.bincount(word, minlength=len(starts))
    end, some, out = np.cumsum(n), n > 0, np.zeros(len(starts), np.uint64)
    out[some] = term_hashes(letters, (end - n)[some], end[some], 99 if plain is _PLAIN else 98)
    return out, n


@dataclass
class Lexicon:
    """Terms by hash, their weights (FOLDS that leave a fold out, then of all rows), and the disguises of insults and learned words."""

    terms: Lookup
    weights: np.ndarray
    insults: Lookup
    second: Lookup
    hidden: Lookup

    @classmethod
    def of(cls, learned: list[tuple[int, bytes, np.ndarray]]) -> Lexicon:
        keys = np.array([hash_of(t, k) for k, t, _ in learned], np.uint64)
        order = np.argsort(keys)
        weights = np.array([w for _, _, w in learned], float).reshape(-1, FOLDS + 1)[order]
        sorted_of = lambda found: Lookup(np.unique(np.array(sorted(found), np.uint64)))
        hidden = set()
        for word in {*(w.encode() for w in INSULTS), *(t for k, t, w in learned if not k and w[-1] > 0)}:
            data, a, b = np.frombuffer(word, np.uint8), np.zeros(1, np.int64), np.full(1, len(word))
            for plain, least in ((_PLAIN, 4), (_CONSONANT, 3)):
                h, n = disguised(data, a, b, plain)
                hidden |= {int(h[0])} if n[0] >= least else set()
        return cls(Lookup(keys[order]), weights, sorted_of(hash_of(w.encode()) for w in INSULTS), sorted_of(hash_of(w.encode()) for w in SECOND), sorted_of(hidden))


def features(column: pa.Array, lexicon: Lexicon, fold: np.ndarray) -> np.ndarray:
    """Rows x NAMES; ``fold`` says which weights of the lexicon count for each row. An empty text has zeros."""
    out = np.zeros((len(column), len(NAMES)))
    for first, end, data, offsets in chunks(column):
        out[first:end] = _features(column, first, end, data, offsets, lexicon, fold[first:end])
    return out


def _features(column, first, end, data, offsets, lexicon, fold) -> np.ndarray:
    n = end - first
    low, starts, ends, row = words_of(column, first, end)
    words = np.bincount(row, minlength=n).astype(float)
    one = np.maximum(words, 1)
    count = lambda where, weight=None: np.bincount(row[where], None if weight is None else weight[where], minlength=n)
    weight = np.zeros(len(row))
    for kind, at, a, b in _terms(low, starts, ends):
        place, there = lexicon.terms.find(term_hashes(low, a[at], b[at], kind))
        at, place = at[there], place[there]
        weight[at] = np.maximum(weight[at], lexicon.weights[place, fold[row[at]]])
    hit = weight > 0
    strongest = np.zeros(n)
    np.maximum.at(strongest, row[hit], weight[hit])
    hashes = np.zeros(len(row), np.uint64)
    full = ends > starts
    hashes[full] = term_hashes(low, starts[full], ends[full], 0)
    insult, second = lexicon.insults.find(hashes)[1] & full, lexicon.second.find(hashes)[1] & full

    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    inner = np.concatenate([[0], np.cumsum(~letter)])
    same = np.zeros(len(low) + 1, np.int64)
    if len(low) > 2:
        same[3:] = np.cumsum((low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & letter[2:])
    some = np.concatenate([[0], np.cumsum(letter)])
    odd = full & (inner[ends] > inner[starts]) & (some[ends] > some[starts])
    long = full & (same[ends] > same[np.minimum(starts + 2, ends)])
    look = np.flatnonzero(odd | long)
    hidden = np.zeros(len(row), bool)
    for plain in (_PLAIN, _CONSONANT):
        h, size = disguised(low, starts[look], ends[look], plain)
        hidden[look[lexicon.hidden.find(h)[1] & (size > 0)]] = True
    hidden &= ~insult & ~hit

    bad, near = np.flatnonzero(hit | insult | hidden), np.zeros(n)
    of = np.flatnonzero(second)
    if len(bad) and len(of):
        right = np.searchsorted(of, bad)
        for side in (np.minimum(right, len(of) - 1), np.maximum(right - 1, 0)):
            gap = np.abs(of[side] - bad)
            close = (gap <= NEAR) & (row[of[side]] == row[bad])
            np.maximum.at(near, row[bad[close]], 1 - gap[close] / (NEAR + 1))

    size = np.diff(offsets)
    byte_row = np.repeat(np.arange(n), size)
    share = lambda mask, whole: np.bincount(byte_row[mask], minlength=n) / np.maximum(whole, 1)
    upper, ascii_lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    letters = np.bincount(byte_row[upper | ascii_lower], minlength=n)
    marks = ((data > 32) & (data < 127)) & ~_LETTER[data]
    twice = np.zeros(len(data), bool)
    if len(data) > 1:
        twice[1:] = marks[1:] & (data[1:] == data[:-1]) & (byte_row[1:] == byte_row[:-1])
    caps, lower = np.concatenate([[0], np.cumsum(upper)]), np.concatenate([[0], np.cumsum(ascii_lower)])
    a, b, begin = word_spans(data, offsets)
    shouted = (caps[b] - caps[a] >= 3) & (lower[b] == lower[a])
    single = full & (ends - starts == 1) & letter[np.minimum(starts, max(len(low) - 1, 0))] if len(low) else np.zeros(0, bool)
    cols = [count(hit) / one, count(hit, weight) / one, strongest, np.log1p(count(hit)), count(insult) / one, np.log1p(count(insult)), count(hidden) / one, np.log1p(count(hidden)), near, count(second) / one]
    cols += [share(upper, letters), np.bincount(np.repeat(np.arange(n), np.diff(begin))[shouted], minlength=n) / one, share(data == 33, words), share(data == 63, words), share(marks, size), share(twice, words)]
    cols += [count(odd) / one, count(long) / one, count(single) / one, np.log1p(words), size / one, share(data >= 128, size)]
    return np.stack(cols, axis=1)


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from learning, as a column."""
    return key_crc32(doc_id) % 5 == 0


def _folds(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("fold").to_numpy().astype(np.int64)


def learned_terms(sample: DataFrame) -> list[tuple[int, bytes, np.ndarray]]:
    """(kind, term, weights) of the lexicon that labelled rows (text, y, fold) teach."""
    sizes = np.zeros((FOLDS, 2))
    for r in sample.groupBy("fold", "y").count().collect():
        sizes[r["fold"], r["y"]] = r["count"]
    least = max(LEAST, int(np.ceil(LEAST_SHARE * sizes[:, 1].sum())))

    def toxic(batches):
        for b in batches:
            text = b.column("text")
            for first, end, _, _ in chunks(text):
                data, starts, ends, row = words_of(text, first, end)
                for kind, at, a, z in _terms(data, starts, ends):
                    terms = pa.array([data[i:j].tobytes() for i, j in zip(a[at].tolist(), z[at].tolist(), strict=True)], pa.binary()).dictionary_encode()
                    pairs = np.unique(terms.indices.to_numpy().astype(np.int64) * (end - first) + row[at])
                    code, n = np.unique(pairs // (end - first), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), kind, np.int32)), terms.dictionary.take(pa.array(code)), pa.array(n.astype(np.int64))], names=["kind", "term", "n"])

    often = sample.where("y = 1").select("text").mapInArrow(toxic, "kind int, term binary, n long").groupBy("kind", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    terms = sorted((r["kind"], bytes(r["term"])) for r in often.collect())  # of `least` rows of the bounded sample each
    keys = np.array([hash_of(t, k) for k, t in terms], np.uint64)
    order = np.argsort(keys)
    lookup = Lookup(keys[order])

    def counted(batches):
        counts = np.zeros((len(terms), FOLDS * 2), np.int64)
        for b in batches:
            text, group = b.column("text"), _folds(b) * 2 + b.column("y").to_numpy()
            for first, end, _, _ in chunks(text):
                data, starts, ends, row = words_of(text, first, end)
                for kind, at, a, z in _terms(data, starts, ends):
                    place, there = lookup.find(term_hashes(data, a[at], z[at], kind))
                    pairs = np.unique(place[there] * (end - first) + row[at[there]])
                    np.add.at(counts, (pairs // (end - first), group[first:end][pairs % (end - first)]), 1)
        at, group = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(order[at].astype(np.int64)), pa.array(group.astype(np.int32)), pa.array(counts[at, group])], names=["at", "group", "n"])

    counts = np.zeros((len(terms), FOLDS, 2))
    if terms:
        for r in sample.select("text", "y", "fold").mapInArrow(counted, "at long, group int, n long").groupBy("at", "group").agg(F.sum("n").alias("n")).collect():
            counts[r["at"], r["group"] // 2, r["group"] % 2] = r["n"]
    weights = np.zeros((len(terms), FOLDS + 1))
    for f in range(FOLDS + 1):
        others = np.arange(FOLDS) != f
        n, whole = counts[:, others].sum(axis=1), sizes[others].sum(axis=0)
        odds = np.log((n[:, 1] + 0.5) / (whole[1] + 1)) - np.log((n[:, 0] + 0.5) / (whole[0] + 1))
        sure = (odds >= ODDS) & (odds >= ERRORS * np.sqrt(1 / (n[:, 1] + 0.5) + 1 / (n[:, 0] + 0.5))) & (n[:, 1] >= max(LEAST - 1, LEAST_SHARE * whole[1]))
        weights[:, f] = np.where(sure, odds, 0)
    return [(k, t, w) for (k, t), w in zip(terms, weights, strict=True) if w.any()]


@dataclass
class ToxicityModel:
    """A lexicon, Spark's trees and its calibration of their margin; without trees every score is ``share``."""

    lexicon: Lexicon | None
    trees: object
    calibration: object
    share: float


def _with_margin(rows: DataFrame, trees) -> DataFrame:
    return trees.transform(rows.withColumn("features", array_to_vector("x"))).withColumn("margin", vector_to_array("rawPrediction")[1]).drop("features", "rawPrediction", "probability", "prediction")


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, learn=None) -> ToxicityModel:
    """Fit on about ``labelled`` rows of ``labels`` (doc_id, toxic) that ``learn`` (by default: not ``held_out``) lets in.

    Null or contradicting labels don't count. Where labels don't hold both classes, the share of 1 is every score (0 without labels).
    """
    toxic = F.col("toxic").cast("int")
    known = labels.where(toxic.isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out() if learn is None else learn)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(toxic).alias("y"), F.max(toxic).alias("_h_y")).where("y = _h_y").select("doc_id", "y")
    sizes = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return ToxicityModel(None, None, None, float(1 in sizes))
    u = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    ranks = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    chosen = known.where(u < labelled / sum(sizes.values())).withColumn("fold", ranks)
    sample = table(whole_texts(docs).join(F.broadcast(chosen), "doc_id"))  # chosen has about `labelled` rows
    lexicon = Lexicon.of(learned_terms(sample))

    def run(batches):
        for b in batches:
            x = features(b.column("text"), lexicon, _folds(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), b.column("fold"), _lists(x)], names=["doc_id", "y", "fold", "x"])

    rows = table(sample.select("text", "doc_id", "y", "fold").mapInArrow(run, "doc_id long, y int, fold int, x array<double>"))
    drop(sample)
    ordered = rows.orderBy("doc_id", "y", "x").coalesce(1)
    classes = {(r[0], r[1]) for r in rows.select(F.col("fold") == 0, "y").distinct().collect()}
    fitted = "fold <> 0" if {(False, 0), (False, 1)} <= classes else "true"
    aside = "fold = 0" if {(True, 0), (True, 1)} <= classes else "true"
    if not {0, 1} <= {y for _, y in classes}:  # labels of rows that the documents don't have
        return ToxicityModel(None, None, None, sizes[1] / sum(sizes.values()))
    trees = GBTClassifier(labelCol="y", maxIter=TREES, maxDepth=DEPTH, stepSize=RATE, maxBins=64, minInstancesPerNode=LEAF_ROWS, seed=7)
    trees = trees.fit(ordered.where(fitted).withColumn("features", array_to_vector("x")).withColumn("y", F.col("y").cast("double")).select("features", "y"))
    pairs = _with_margin(ordered.where(aside), trees).select("margin", F.col("y").cast("double").alias("y"))
    calibration = IsotonicRegression(featuresCol="margin", labelCol="y").fit(pairs)
    drop(rows)
    return ToxicityModel(lexicon, trees, calibration, 0.0)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def classify(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted, and by name what it goes by: margin, learned_count, insult_count, disguised_count) of each row of (doc_id, text).

    Whole texts. ``score`` is the calibrated probability of label 1; within a step of the calibration a millionth of it
    follows the margin. A null text is an empty one and gets a score too; repeated rows keep their rows.
    """
    if model.trees is None:
        none = [F.lit(None).cast("double").alias(c) for c in ("margin", *_SHOWN)]
        return whole_texts(docs).select("doc_id", F.lit(model.share).alias("score"), F.lit(int(model.share >= threshold)).alias("predicted"), *none)
    lexicon = model.lexicon

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _lists(features(b.column("text"), lexicon, np.full(b.num_rows, FOLDS)))], names=["doc_id", "x"])

    scored = _with_margin(whole_texts(docs).mapInArrow(run, "doc_id long, x array<double>"), model.trees)
    scored = model.calibration.transform(scored)
    score = F.col("prediction") * (1 - 1e-6) + 1e-6 / (1 + F.exp(-2 * F.col("margin")))
    shown = [F.col("x")[NAMES.index(c)].alias(c) for c in _SHOWN]
    return scored.select("doc_id", score.alias("score"), "margin", *shown).select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "margin", *_SHOWN)


_SHOWN = ("learned_count", "insult_count", "disguised_count")
