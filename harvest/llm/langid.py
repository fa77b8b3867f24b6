"""Language identification by interpolated Kneser-Ney character models.

One model per language over letters and single spaces. All languages share sorted arrays of 64-bit
n-gram hashes, with the log-probability in each language that has the n-gram; interpolation is done at
training, so scoring is one binary search for most characters and a back-off path for the rest. The
language with the lowest cross-entropy per character wins. Rejection is calibrated on rows kept from counting.

Every language is learned. Counting uses a bounded sample of labelled rows: about ``rows`` per language, fewer where there are so
many languages that ``total`` would be passed, chosen by a hash of doc_id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, chunks, column_of, kept, key_crc32, mix, multipliers, whole_texts

ORDER = 4
#: Labelled rows counted per language, and half as many to calibrate, about.
TRAIN_ROWS = 2000
#: Rows counted in all; with more than TOTAL_ROWS / TRAIN_ROWS languages each has its share of them, so the model stays bounded.
TOTAL_ROWS = 100_000
#: Rows of a language from which on some of them only calibrate.
ENOUGH = 30
#: Numbers (of four bytes) that rows of all languages may take.
DENSE = 1 << 26
#: Symbols times languages that are scored at once.
CELLS = 1 << 23
#: Steepnesses of the confidence that calibration chooses from.
SHARPS = [2.0**k for k in range(-6, 3)]
_TABLES: list[np.ndarray] = []
_K = multipliers(8)


def _folds() -> np.ndarray:
    """Code point to lower-cased letter; what is no letter becomes 0."""
    if not _TABLES:
        t = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _TABLES.append(t)
    return _TABLES[0]


def letters(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters and single spaces (0) of all rows, each after ``order - 1`` spaces, and where rows begin."""
    text = data.tobytes().decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    begin = lead[offsets]
    folded = _folds()[np.minimum(points, 0x10FFFF)]
    first = np.zeros(len(folded) + 1, bool)
    first[begin] = True
    keep = folded > 0
    if len(keep) > 1:
        keep[1:] |= (folded[:-1] > 0) & ~first[1:-1]  # one space after a word
    kept = np.concatenate([[0], np.cumsum(keep)])[begin]
    n, pad = len(offsets) - 1, order - 1
    out = np.zeros(kept[-1] + n * pad, np.uint32)
    row = np.repeat(np.arange(n), np.diff(kept))
    out[np.arange(kept[-1]) + (row + 1) * pad] = folded[keep]
    return out, kept + np.arange(n + 1) * pad


def grams(seq: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` symbols that end at each place from ``size - 1`` on."""
    out = np.full(len(seq) - size + 1, size, np.uint64)
    for j in range(size):
        out += (seq[j : len(seq) - size + 1 + j].astype(np.uint64) + np.uint64(1)) * _K[j]
    return mix(out)


def gram_rows(cells: np.ndarray) -> np.ndarray:
    """The same hash of each row of a matrix of symbols."""
    out = np.full(len(cells), cells.shape[1], np.uint64)
    for j in range(cells.shape[1]):
        out += (cells[:, j].astype(np.uint64) + np.uint64(1)) * _K[j]
    return mix(out)


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted array, and whether each is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Pairs:
    """Values of (hash, language) pairs in the order of both: sorted distinct hashes, where each begins, languages, values.

    ``rows``, if there, is the same as a row of all languages for each hash, what is missing filled in.
    """

    keys: np.ndarray
    start: np.ndarray
    lang: np.ndarray
    value: np.ndarray
    rows: np.ndarray | None = None

    @classmethod
    def of(cls, h: np.ndarray, lang: np.ndarray, value: np.ndarray) -> Pairs:
        order = np.lexsort((lang, h))
        h = h[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        return cls(h[first], np.append(first, len(h)), lang[order].astype(np.int32), value[order].astype(np.float32))

    def add_to(self, out: np.ndarray, wanted: np.ndarray, put: bool) -> None:
        """Adds to, or puts in, the places of ``out`` (rows x languages) what each row's hash has for its languages."""
        at, there = find(self.keys, wanted)
        row, at = np.flatnonzero(there), at[there]
        n = self.start[at + 1] - self.start[at]
        k = np.arange(n.sum()) + np.repeat(self.start[at] - (np.cumsum(n) - n), n)
        place = (np.repeat(row, n), self.lang[k])
        out[place] = self.value[k] if put else out[place] + self.value[k]


@dataclass
class KneserNey:
    """Per order, n-grams with log-probabilities and contexts with back-off weights, of the languages that have them.

    What a language hasn't seen follows from its shorter n-grams. While rows of all languages stay below DENSE numbers they are
    written out, so that most symbols take one look-up; above, scoring adds up the pairs. Both give the same.
    """

    langs: list[str]
    order: int = ORDER
    grams: dict[int, Pairs] = field(default_factory=dict)
    contexts: dict[int, Pairs] = field(default_factory=dict)
    floor: float = -12.0
    sharp: float = 1.0
    limit: np.ndarray | None = None

    @classmethod
    def fit(cls, langs: list[str], cells: np.ndarray, lang: np.ndarray, count: np.ndarray, order: int = ORDER, dense: int | None = None) -> KneserNey:
        """From rows of (n symbols, language, count); an n-gram of a language may come in several rows."""
        m, L = cls(langs, order), len(langs)
        both = lambda h, g: mix(h + g.astype(np.uint64) * _K[7])
        levels = {}
        for size in range(order, 0, -1):
            if size < order:  # continuation counts: one for each n-gram type above
                c, g, _ = levels[size + 1]
                cells, lang, count = c[:, 1:], g, np.ones(len(g), np.int64)
            _, at, back = np.unique(both(gram_rows(cells), lang), return_index=True, return_inverse=True)
            levels[size] = (cells[at], lang[at], np.bincount(back, count).astype(np.float64))
        m.floor = -math.log(len(np.unique(levels[1][0])) + 2)
        last: tuple = ()
        for size in range(1, order + 1):
            cells, lang, count = levels[size]
            h, ctx = gram_rows(cells), gram_rows(cells[:, :-1])
            pairs, at, place = np.unique(both(ctx, lang), return_index=True, return_inverse=True)
            total, types = np.bincount(place, count), np.bincount(place).astype(np.float64)
            n1, n2 = (np.bincount(lang[count == k], minlength=L) for k in (1, 2))
            discount = np.where(n1 > 0, np.clip(n1 / np.maximum(n1 + 2 * n2, 1), 0.1, 0.95), 0.5)
            weight = discount[lang[at]] * types / total
            if size == 1:
                lower = np.full(len(h), math.exp(m.floor))
            else:
                lower = np.exp(last[1][np.searchsorted(last[0], both(gram_rows(cells[:, 1:]), lang))])
            logp = np.log(np.maximum(count - discount[lang], 0) / total[place] + weight[place] * lower)
            own = both(h, lang)
            order_of = np.argsort(own)
            last = own[order_of], logp[order_of]
            m.grams[size], m.contexts[size] = Pairs.of(h, lang, logp), Pairs.of(ctx[at], lang[at], np.log(weight))
        cost = L * sum(len(x.keys) for t in (m.grams, m.contexts) for x in t.values())
        if cost <= (DENSE if dense is None else dense):
            m._write_out(levels)
        return m

    def _write_out(self, levels: dict) -> None:
        for size in range(1, self.order + 1):
            ctx, own, cells = self.contexts[size], self.grams[size], levels[size][0]
            ctx.rows = np.zeros((len(ctx.keys), len(self.langs)), np.float32)
            ctx.add_to(ctx.rows, ctx.keys, True)
            h, at = np.unique(gram_rows(cells), return_index=True)
            one = cells[at]
            lower = self.grams[size - 1].rows[np.searchsorted(self.grams[size - 1].keys, gram_rows(one[:, 1:]))] if size > 1 else np.float32(self.floor)
            own.rows = ctx.rows[np.searchsorted(ctx.keys, gram_rows(one[:, :-1]))] + lower
            own.add_to(own.rows, h, True)

    def char_scores(self, seq: np.ndarray) -> np.ndarray:
        """Log-probabilities (natural, per language) of each symbol from place ``order - 1`` on."""
        n = len(seq) - self.order + 1
        none = mix(np.zeros(1, np.uint64))[0]
        before = lambda size, todo: grams(seq[self.order - size :], size - 1)[todo] if size > 1 else np.full(len(todo), none, np.uint64)
        if self.grams[1].rows is None:
            out = np.full((n, len(self.langs)), self.floor, np.float32)
            for size in range(1, self.order + 1):
                self.contexts[size].add_to(out, before(size, np.arange(n)), False)
                self.grams[size].add_to(out, grams(seq[self.order - size :], size), True)
            return out
        out, todo = np.zeros((n, len(self.langs)), np.float32), np.arange(n)
        for size in range(self.order, 0, -1):
            own, ctx = self.grams[size], self.contexts[size]
            at, there = find(own.keys, grams(seq[self.order - size :], size)[todo])
            out[todo[there]] += own.rows[at[there]]
            todo = todo[~there]
            if not len(todo):
                return out
            at, there = find(ctx.keys, before(size, todo))
            out[todo[there]] += ctx.rows[at[there]]
        out[todo] += self.floor
        return out

    def entropies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol (nats) of each row in each language, and its number of symbols."""
        seq, begin = letters(data, offsets, self.order)
        size = np.diff(begin) - (self.order - 1)
        total, n = np.zeros((len(size), len(self.langs))), max(0, len(seq) - self.order + 1)
        row, ends = np.repeat(np.arange(len(size)), np.diff(begin))[:n], begin[:-1] + size  # what lies between rows are pads
        for p in range(0, n, step := max(1, CELLS // max(1, len(self.langs)))):
            scores, own = self.char_scores(seq[p : p + step + self.order - 1]), row[p : p + step]
            scores[np.arange(p, p + len(own)) >= ends[own]] = 0
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            total[own[first]] += np.add.reduceat(scores, first, axis=0, dtype=np.float64)
        return -total / np.maximum(size, 1)[:, None], size

    def decide(self, entropy: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language (the first of equals), confidence, and whether the row is rejected."""
        best = entropy.argmin(axis=1)
        gap = (entropy - entropy.min(axis=1, keepdims=True)) * np.minimum(size, 200)[:, None] * self.sharp
        score = 1 / np.exp(-np.minimum(gap, 700)).sum(axis=1)
        least = entropy[np.arange(len(best)), best]
        limit = self.limit[best] if self.limit is not None else np.inf
        rejected = (size == 0) | (least > limit + 3 / np.sqrt(np.maximum(size, 1)))
        return best, np.where(size == 0, 0.0, score), rejected

    def losses(self, entropy: np.ndarray, size: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entropy in the right language of each row, and minus the log-likelihood of that language at each of SHARPS."""
        at = np.arange(len(lang))
        gap = (entropy - entropy.min(axis=1, keepdims=True)) * np.minimum(size, 200)[:, None]
        return entropy[at, lang], np.stack([np.log(np.exp(-gap * k).sum(axis=1)) + gap[at, lang] * k for k in SHARPS], axis=1)

    def calibrate(self, right: np.ndarray, losses: np.ndarray, lang: np.ndarray) -> None:
        """Sharpness by the likelihood of the right language; a limit of entropy that keeps all but the oddest 0.1 % and a margin.

        A language with fewer than 5 rows here has the limit of all rows' own entropies together, and at most nine tenths of what text of
        letters that no language has comes to; without any row that is every language's.
        """
        self.limit = np.full(len(self.langs), 0.9 * -self.floor)
        if not len(lang):
            return
        self.sharp = SHARPS[int(losses.mean(axis=0).argmin())]
        self.limit[:] = min(self.limit[0], 1.2 * np.quantile(right, 0.999))
        order = np.argsort(lang, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(lang[order])) + 1):
            if len(own) >= 5:
                self.limit[lang[own[0]]] = 1.2 * np.quantile(right[own], 0.999)


def _cut(column: pa.Array, langs: int):
    """Chunks of which rows times languages, and symbols times languages but for a long text, stay near CELLS."""
    return chunks(column, min(CHUNK_BYTES, max(1, CELLS // max(1, langs))), max(1, CELLS // (16 * max(1, langs))))


def train(docs: DataFrame, rows: int = TRAIN_ROWS, order: int = ORDER, learn=None, total: int = TOTAL_ROWS) -> KneserNey:
    """Fit on rows of (doc_id, text, lang) that ``learn`` (a condition) admits; two thirds count, one third calibrates.

    All rows of a language with fewer than ENOUGH count. Rows without text or lang teach nothing. Without any such row
    the model knows no language. Rows without an id are one to the hash, and repeated ones all count or none.
    """
    own = docs.select(F.col("doc_id").cast("string").alias("_h_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), (F.lit(True) if learn is None else learn).alias("_h_learn"))
    own = own.where(F.col("_h_learn") & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r[0]: r[1] for r in own.groupBy("lang").count().collect()}  # a row a language
    langs = sorted(counts)
    if not langs:
        return KneserNey([], order)
    u = F.pmod(F.xxhash64("_h_id", F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    rows = min(rows, total / len(langs))
    shares = own.sparkSession.createDataFrame([(g, 1.5 * rows / n, n >= ENOUGH) for g, n in counts.items()], "lang string, _h_share double, _h_many boolean")
    sample = own.join(F.broadcast(shares), "lang").where(u < F.col("_h_share")).withColumn("_h_cal", F.col("_h_many") & (F.pmod(F.xxhash64("_h_id", F.lit("calibrate")), F.lit(3)) == 0))
    index = {g: i for i, g in enumerate(langs)}

    def count(batches):
        for b in batches:
            lang, text = b.column("lang").to_pylist(), b.column("text")
            for first, end, data, offsets in chunks(text):
                seq, begin = letters(data, offsets, order)
                if len(seq) < order:
                    continue
                h = grams(seq, order)
                row = np.repeat(np.arange(end - first), np.diff(begin))[: len(h)]
                real = np.arange(len(h)) < (begin[1:] - order + 1)[row]
                at = np.flatnonzero(real)
                g = np.array([index[x] for x in lang[first:end]], np.int64)[row[at]]
                _, one, n = np.unique(mix(h[at] + g.astype(np.uint64) * _K[7]), return_index=True, return_counts=True)
                cells = np.lib.stride_tricks.sliding_window_view(seq, order)[at[one]]
                yield pa.RecordBatch.from_arrays([pa.array(g[one].astype(np.int32)), pa.array([c.tobytes() for c in cells.astype("<u4")], pa.binary()), pa.array(n)], names=["g", "cells", "n"])

    table = sample.where(~F.col("_h_cal")).select("text", "lang").mapInArrow(count, "g int, cells binary, n long").groupBy("g", "cells").agg(F.sum("n").alias("n")).toArrow()
    cells = np.frombuffer(b"".join(table.column("cells").to_pylist()), "<u4").reshape(-1, order) if table.num_rows else np.zeros((0, order), np.uint32)
    if not len(cells):
        return KneserNey([], order)
    model = KneserNey.fit(langs, cells, table.column("g").to_numpy().astype(np.int64), table.column("n").to_numpy(), order)

    def measure(batches):
        for b in batches:
            for first, end, data, offsets in _cut(b.column("text"), len(langs)):
                e, size = model.entropies(data, offsets)
                lang = np.array([index[x] for x in b.column("lang").slice(first, end - first).to_pylist()], np.int64)
                own = np.flatnonzero(size > 0)
                right, losses = model.losses(e[own], size[own], lang[own])
                yield pa.RecordBatch.from_arrays([pa.array(lang[own].astype(np.int32)), pa.array(right), pa.array(list(losses), pa.list_(pa.float64()))], names=["g", "right", "losses"])

    got = sample.where("_h_cal").select("text", "lang").mapInArrow(measure, "g int, right double, losses array<double>").toArrow()  # ten numbers a row of the bounded sample
    model.calibrate(got.column("right").to_numpy(), np.array(got.column("losses").to_pylist()).reshape(-1, len(SHARPS)), got.column("g").to_numpy().astype(np.int64))
    return model


def identify(docs: DataFrame, model: KneserNey) -> DataFrame:
    """(doc_id, lang_pred, score, rejected, entropy) of each row of (doc_id, text), whole texts.

    ``und`` with score 0, rejected, where text is null or has no letter, or the model knows no language;
    else always a learned language, rejected or not. ``score`` is the calibrated confidence (0 to 1).
    """
    model_b = docs.sparkSession.sparkContext.broadcast(model)  # at most 4 x DENSE bytes, or 12 for each n-gram of the bounded sample

    def run(batches):
        m = model_b.value
        names = np.array([*m.langs, "und"], object)
        for b in batches:
            for first, end, data, offsets in _cut(b.column("text"), len(m.langs)):
                if m.langs:
                    e, size = m.entropies(data, offsets)
                    best, score, rejected = m.decide(e, size)
                    best = np.where(size > 0, best, len(m.langs))
                    least = np.where(size > 0, e.min(axis=1), 0.0)
                else:
                    best, score, least, rejected = (np.full(end - first, x) for x in (0, 0.0, 0.0, True))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, end - first), pa.array(names[best], pa.string()), pa.array(score), pa.array(rejected), pa.array(least)], names=["doc_id", "lang_pred", "score", "rejected", "entropy"])

    return whole_texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean, entropy double")


def identified(docs: DataFrame, model: KneserNey) -> DataFrame:
    """The rows, with all their columns, that ``identify`` doesn't reject."""
    model_b = docs.sparkSession.sparkContext.broadcast(model)

    def decide(batch):
        m, out = model_b.value, [np.zeros(0, bool)]
        for first, end, data, offsets in _cut(column_of(batch, "text"), len(m.langs)):
            out.append(~m.decide(*m.entropies(data, offsets))[2] if m.langs else np.zeros(end - first, bool))
        return np.concatenate(out)

    return kept(docs, decide)


def held_out(docs: DataFrame, folds: int = 5):
    """The condition that puts a row in the held-out fold."""
    return F.coalesce(key_crc32() % folds == 0, F.lit(False))
