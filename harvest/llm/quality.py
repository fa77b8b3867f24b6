"""Quality classifier by co-training of two views of a document.

* Text view: hashed byte 4-grams and statistics of the words (repetition, marks, case, lengths).
* Metadata view: source, language, size and layout (lines, their lengths, blanks) of the page.

Both are logistic models. In each round each view scores every unlabelled document and labels those that it is sure of
for the other view. The other view's next fit minimises the loss of the labelled rows and that of all these documents, which
stands in it by their own gradients at the present weights and a bound of their curvature: sums of one number a feature over every
pseudo-labelled row, added up by the tasks, so that each counts for itself and what meets on the driver doesn't grow. On
labelled rows kept aside each view is calibrated and a logistic model combines the calibrated views. It scores every document.

The labelled rows that fitting uses are a bounded sample, chosen by a hash of doc_id: about ``labelled``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, column_of, few_sums, kept, one_hash, table, whole_texts, word_hashes

LABELLED = 4000
ROUNDS = 4
#: A view is sure of a label from the margin on beyond which this share (one more counted as wrong) of the rows kept aside has it.
SURE = 0.98
#: Weight of all pseudo-labelled rows of a label in the last round, in units of the labelled rows'.
TRUST = 1.0
BINS = 2048
_TEXT_STATS = 12
_SOURCES = 64
_META = _SOURCES + 16 + 10


def text_view(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x (BINS + 12): logarithms of 4-gram counts, scaled to length 1, and statistics between 0 and about 1."""
    n, size = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, BINS + _TEXT_STATS), np.float32)
    row = np.repeat(np.arange(n, dtype=np.int64), size)
    if len(data) >= 4:
        d = data.astype(np.uint32)
        h = (d[:-3] | d[1:-2] << 8 | d[2:-1] << 16 | d[3:] << 24) * np.uint32(0x9E3779B1) >> np.uint32(21)
        own = row[:-3] == row[3:]
        grams = np.log1p(np.bincount(row[:-3][own] * BINS + h[own].astype(np.int64), minlength=n * BINS).reshape(n, BINS))
        out[:, :BINS] = grams / np.maximum(np.sqrt(np.square(grams).sum(axis=1, keepdims=True)), 1e-9)
    words, begin = word_hashes(data, offsets)
    count = np.diff(begin)
    one = np.maximum(count, 1)
    each = np.repeat(np.arange(n), count)
    share = lambda mask: np.bincount(row[mask], minlength=n) / np.maximum(size, 1)
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    stats = [share(upper), share(lower), share(data > 127), share((data >= 48) & (data <= 57))]
    marks = np.isin(data, np.frombuffer(b"!#$%&*|<>{}[]@^~+=/\\", np.uint8))
    stats += [share(marks), share(np.isin(data, np.frombuffer(b".,;:'\"()-?", np.uint8)))]
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (each[1:] == each[:-1])
    stats.append(np.bincount(each[same], minlength=n) / one)
    distinct, most = np.zeros(n), np.zeros(n)
    for r in np.flatnonzero(count):
        c = np.unique(words[begin[r] : begin[r + 1]], return_counts=True)[1]
        distinct[r], most[r] = len(c), c.max()
    stats += [np.minimum(distinct / one * np.sqrt(one) / 20, 2), distinct / one, most / one]
    stats += [np.minimum(size / one / 20, 3), np.log1p(count) / 10]
    out[:, BINS:] = np.stack(stats, axis=1)
    return out


def meta_view(data: np.ndarray, offsets: np.ndarray, source: list, lang: list) -> np.ndarray:
    """Rows x features of source, language, size and layout."""
    n, size = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, _META), np.float32)
    for k, (width, at, values) in enumerate(((_SOURCES, 0, source), (16, _SOURCES, lang))):
        known = {v: (one_hash(str(v).encode() or b" ") + k) % width for v in set(values)}
        out[np.arange(n), at + np.array([known[v] for v in values], np.int64)] = 1
    row = np.repeat(np.arange(n), size)
    lines = np.bincount(row[data == 10], minlength=n)
    one = np.maximum(size, 1)
    mean = size / (lines + 1)
    blanks = np.bincount(row[data == 32], minlength=n)
    starts = np.bincount(row[1:][(data[:-1] == 10) & (data[1:] >= 65) & (data[1:] <= 90) & (row[1:] == row[:-1])], minlength=n) if len(data) > 1 else np.zeros(n)
    empty = np.bincount(row[1:][(data[:-1] == 10) & (data[1:] == 10)], minlength=n) if len(data) > 1 else np.zeros(n)
    out[:, -10:] = np.stack([np.log1p(size) / 12, np.square(np.log1p(size) / 12), np.log1p(lines) / 6, np.log1p(mean) / 10, lines / one * 50, blanks / one * 5, (size < 200) * 1.0, starts / np.maximum(lines, 1), empty / np.maximum(lines, 1), np.minimum(blanks / (lines + 1) / 100, 3)], axis=1)
    return out


def sure_bounds(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Margins up to which a view is sure of label 0 and from which of label 1, by rows kept aside; infinite where there is none."""
    out = []
    for sign, label in ((1, 0), (-1, 1)):
        order = np.argsort(sign * z, kind="stable")
        right = np.cumsum(y[order] == label) / (np.arange(len(y)) + 2)
        whole = np.append(z[order][1:] != z[order][:-1], True)[: len(y)]  # equal margins go together
        good = np.flatnonzero((right >= SURE) & whole)
        out.append(float(z[order[good[-1]]]) if len(good) else -sign * np.inf)
    return out[0], out[1]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 250, ridge: float = 1e-4, start: np.ndarray | None = None, more: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Weights and, last, the bias of a logistic model, by full-batch Adam; classes weigh the same.

    ``more`` are other rows' share of the loss as (shares by class, gradient, curvature) at ``start``: a quadratic of the weights' way from there.
    """
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    share = more[0] if more is not None else np.zeros(2)
    weight = np.zeros(len(y))
    for k in (0, 1):
        weight[y == k] = (1 - share[k]) / max((y == k).sum(), 1)
    w = np.zeros(x.shape[1]) if start is None else start.copy()
    first, m, v = w.copy(), np.zeros(len(w)), np.zeros(len(w))
    for t in range(1, steps + 1):
        g = x.T @ ((_sigmoid(x @ w) - y) * weight).astype(x.dtype) + ridge * np.append(w[:-1], 0)
        if more is not None:
            g = g + more[1] + more[2] * (w - first)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


@dataclass
class QualityModel:
    """Weights of both views, their calibrations (slope, offset), and the combination (two slopes, offset)."""

    text: np.ndarray
    meta: np.ndarray
    platt: np.ndarray
    joint: np.ndarray

    @classmethod
    def fit(cls, text: np.ndarray, meta: np.ndarray, y: np.ndarray, aside: np.ndarray, sums, rounds: int = ROUNDS) -> QualityModel:
        """From labelled rows, of which ``aside`` marks those that only calibrate and tell when a view is sure. ``sums`` takes the weights
        and the sure bounds of both views and gives, for each view, (numbers, gradients, curvatures), by label, of the rows that the other one is sure of."""
        views, own = (text, meta), y[~aside]
        w = [fit_logistic(x[~aside], own) for x in views]
        for turn in range(rounds):
            trust = TRUST * (turn + 1) / rounds
            fresh = []
            bounds = [sure_bounds(x[aside] @ v[:-1] + v[-1], y[aside]) for x, v in zip(views, w, strict=True)]
            for x, now, (n, gradient, curvature) in zip(views, w, sums(w, bounds), strict=True):
                share = np.where(n > 0, trust / (1 + trust), 0.0)
                each = (share / np.maximum(n, 1))[:, None]
                fresh.append(fit_logistic(x[~aside], own, start=now, more=(share, (each * gradient).sum(axis=0), (each * curvature).sum(axis=0))))
            w = fresh
        z = [x[aside] @ v[:-1] + v[-1] for x, v in zip(views, w, strict=True)]
        own = y[aside]
        plain = np.array([0.0, 1.0])
        if len(set(own.tolist())) < 2:  # nothing to calibrate on
            return cls(w[0], w[1], np.stack([plain[::-1]] * 2), np.array([1.0, 0.0, 0.0]))
        platt = [fit_logistic(v[:, None] / 10, own, steps=400, ridge=1e-6) * np.array([0.1, 1.0]) for v in z]
        both = np.stack([np.clip(v * p[0] + p[1], -12, 12) for v, p in zip(z, platt, strict=True)], axis=1)
        return cls(w[0], w[1], np.stack(platt), fit_logistic(both / 5, own, steps=400, ridge=1e-4) * np.array([0.2, 0.2, 1.0]))

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probability of good quality by text, by metadata, and by both."""
        z = [np.clip((x @ w[:-1].astype(np.float32) + w[-1]) * p[0] + p[1], -12, 12) for x, w, p in ((text, self.text, self.platt[0]), (meta, self.meta, self.platt[1]))]
        return _sigmoid(z[0]), _sigmoid(z[1]), _sigmoid(z[0] * self.joint[0] + z[1] * self.joint[1] + self.joint[2])


def _views(batch: pa.RecordBatch):
    source, lang = (column_of(batch, c).to_pylist() for c in ("source", "lang"))
    for first, end, data, offsets in chunks(column_of(batch, "text"), rows=1000):
        yield first, end, text_view(data, offsets), meta_view(data, offsets, source[first:end], lang[first:end]), np.diff(offsets)


def _own(docs: DataFrame) -> DataFrame:
    return whole_texts(docs, *(F.col(c).cast("string").alias(c) for c in ("source", "lang") if c in docs.columns))


def _sums(docs: DataFrame, w: list[np.ndarray], bounds: list[tuple[float, float]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each view (numbers, gradients, curvatures), by label, of all rows of docs that the other view is sure of.

    A gradient is the sum of the rows' own at ``w``; a curvature is the sum of p (1 - p) |x_j| |x|_1, which bounds how fast it changes.
    """
    w = [x.astype(np.float32) for x in w]

    def run(batches):
        sums = [np.zeros((2, 1 + 2 * len(x))) for x in w]
        for b in batches:
            for _, _, text, meta, _ in _views(b):
                views = (text, meta)
                z = [x @ v[:-1] + v[-1] for x, v in zip(views, w, strict=True)]
                for k, other in ((0, 1), (1, 0)):
                    low, high = bounds[other]
                    for label, sure in ((0, (z[other] <= low) & (z[other] < high)), (1, (z[other] >= high) & (z[other] > low))):
                        x, q = views[k][sure], _sigmoid(z[k][sure])
                        bend = q * (1 - q) * (np.abs(x).sum(axis=1) + 1)
                        sums[k][label] += np.concatenate([[len(q)], (q - label) @ x, [(q - label).sum()], bend @ np.abs(x), [bend.sum()]])
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part, part]), pa.array([0, 1]), pa.array([x.tobytes() for x in sums], pa.binary())], names=["part", "block", "value"])

    got = few_sums(_own(docs).mapInArrow(run, "part long, block long, value binary"), np.float64)
    out = []
    for k, n in enumerate(map(len, w)):
        x = got.get(k, np.zeros(2 + 4 * n)).reshape(2, -1)
        out.append((x[:, 0], x[:, 1 : n + 1], x[:, n + 1 :]))
    return out


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> QualityModel | None:
    """Fit on about ``labelled`` rows of ``labels`` (doc_id, quality), and on all documents besides them.

    Null or contradicting labels don't count. None where labels don't hold both classes. Documents without an id, and all
    rows of a table without labels for them, are unlabelled; repeated rows count as often as they occur.
    """
    quality = F.col("quality").cast("int")
    known = labels.where(quality.isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(quality).alias("y"), F.max(quality).alias("_h_y")).where("y = _h_y").select("doc_id", "y")
    sizes = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return None
    u = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(u < labelled / sum(sizes.values())).withColumn("aside", F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(3)) == 0)
    sample = F.broadcast(table(chosen))  # about `labelled` rows

    def run(batches):
        for b in batches:
            for first, end, text, meta, _ in _views(b):
                cut = lambda c, a=first, z=end: b.column(c).slice(a, z - a)
                yield pa.RecordBatch.from_arrays([cut("doc_id"), cut("y"), cut("aside"), pa.array([x.tobytes() for x in text], pa.binary()), pa.array([x.tobytes() for x in meta], pa.binary())], names=["doc_id", "y", "aside", "t", "m"])

    got = _own(docs).join(sample, "doc_id").mapInArrow(run, "doc_id long, y int, aside boolean, t binary, m binary").toArrow().sort_by("doc_id")
    y, aside = got.column("y").to_numpy(), got.column("aside").to_numpy(zero_copy_only=False)
    if len({*y[~aside].tolist()}) < 2:
        return None
    text, meta = (np.frombuffer(b"".join(got.column(c).to_pylist()), np.float32).reshape(len(y), -1) for c in "tm")
    del got
    rest = docs.withColumn("doc_id", F.col("doc_id").cast("long")).join(sample.select("doc_id"), "doc_id", "left_anti")
    return QualityModel.fit(text, meta, y, aside, lambda w, bounds: _sums(rest, w, bounds), rounds)


def classify(docs: DataFrame, model: QualityModel | None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, text_score, meta_score, score, keep) of each row of (doc_id, text, source, lang), whole texts.

    ``keep`` is score >= threshold. A null text is an empty one; null or absent source and lang are values of
    their own. Without a model scores are null and everything is kept. Repeated rows keep their rows.
    """

    def run(batches):
        for b in batches:
            for first, end, text, meta, _ in _views(b):
                got = model.scores(text, meta) if model else [np.full(end - first, np.nan)] * 3
                cols = [pa.array(x.astype(float), mask=np.isnan(x)) for x in got]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, end - first), *cols, pa.array(got[2] >= threshold if model else np.ones(end - first, bool))], names=["doc_id", "text_score", "meta_score", "score", "keep"])

    return _own(docs).mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, keep boolean")


def accepted(docs: DataFrame, model: QualityModel | None, threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, that ``classify`` keeps."""
    if model is None:
        return docs
    return kept(docs, lambda b: np.concatenate([[], *(model.scores(text, meta)[2] >= threshold for _, _, text, meta, _ in _views(b))]).astype(bool))
