"""Language-model scores from a hashed maximum-entropy model with class-factored softmax.

P(word | history) = P(class | history) * P(leaf | class, history) * P(word | leaf). The commonest words and the
end of a text are leaves of their own, dealt to CLASSES classes so that these hold about equal shares of the tokens; each
class has one more leaf for the rest: all other words, known or not, by their last two bytes. Both softmax factors are
trained. Their scores are the logarithm of the unigram share and hashed weights of the history: of the previous word
(bigram), the word before it (skip) and, for the class, both (trigram); a leaf's weights are hashed with its class.
A rest leaf's word is a smoothed share of counts, so that without weights the model is the unigram model.

Counts come from every training document. The weight tables grow with the number of distinct words, up to what a
worker should hold. Weights are trained over all training documents, split into rounds and shards by hashes of the rows: a task makes
gradient steps from the common weights over each of its shards, and changes are averaged by weight row, over the tasks that
touched the row, in levels of bounded fan-in. Counts of the commonest words, in bounded number, are broadcast; all
others meet by a shuffle join.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, LOWER, SEPARATORS, Lookup, chunks, drop, key_crc32, mix, multipliers, table, text_buffer, tidy, tree_sums, whole_texts, word_hashes

CLASSES = 32
#: Leaves of a class, the first of them for the rest.
LEAVES = 32
#: Greatest numbers of weight rows for each feature of the class and of the leaf, as powers of two (23 MB in all).
MOST_CLASS_ROWS, MOST_LEAF_ROWS = 1 << 14, 1 << 16
ROUNDS = 3
BATCH = 4096
#: Words whose counts are broadcast (24 bytes each), at most.
COMMON = 1 << 18
#: Tokens that one training task takes in a round, about.
SHARD_TOKENS = 5_000_000
_BLOCK = 256
_END = np.uint64(0x2545F4914F6CDD1D)
_START = np.uint64(0x9FB21C651E98DF25)
_K = multipliers(6)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens (words, then an end, of each row), their class by last bytes, and where rows begin."""
    words, rows = word_hashes(data, offsets)
    group = np.zeros(len(words), np.int64)
    if len(words):
        blank = np.ones(len(data) + 1, bool)
        blank[:-1] = SEPARATORS[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        at = np.flatnonzero(~blank[:-1] & (blank[1:] | edge[1:]))
        before = np.where((at > 0) & ~edge[at] & ~blank[at - 1], LOWER[data[at - 1]], 0)
        group = (mix(LOWER[data[at]].astype(np.uint64) * np.uint64(256) + before.astype(np.uint64)) % np.uint64(CLASSES)).astype(np.int64)
    n = len(rows) - 1
    ends = rows[1:] + np.arange(n)
    out, groups = np.empty(len(words) + n, np.uint64), np.zeros(len(words) + n, np.int64)
    own = np.ones(len(out), bool)
    own[ends] = False
    out[ends], out[own], groups[own] = _END, words, group
    return out, groups, rows + np.arange(n + 1)


def _power(n: float, most: int) -> int:
    return min(most, 1 << max(8, math.ceil(math.log2(max(n, 1)))))


_ONES = np.ones(CLASSES, np.float32)
_FEW = 4


def _summed(g: np.ndarray, order: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Sums of the rows of g by group, of which most are small: ``order`` sorts by group, ``cut`` is where groups begin."""
    size = np.diff(np.append(cut, len(order)))
    out = g.take(order[cut], axis=0)
    for k in range(1, _FEW):
        more = np.flatnonzero(size > k)
        out[more] += g.take(order[cut[more] + k], axis=0)
    large = np.flatnonzero(size > _FEW)
    if len(large):
        rest = size[large] - _FEW
        of = np.repeat(np.arange(len(large)), rest)
        at = np.arange(len(of))
        picks = np.zeros((len(large), len(of)), np.float32)
        picks[of, at] = 1
        out[large] += picks @ g.take(order[np.repeat(cut[large] + _FEW - (np.cumsum(rest) - rest), rest) + at], axis=0)
    return out


@dataclass
class Model:
    """Listed words (sorted hashes) with class and leaf, unigram scores of both factors, denominators of the rests, weights."""

    words: np.ndarray
    cls: np.ndarray
    leaf: np.ndarray
    class_bias: np.ndarray
    leaf_bias: np.ndarray
    #: log10 of what the count of a word of a rest is divided by.
    rest: np.ndarray
    class_rows: int
    leaf_rows: int
    w: np.ndarray

    def __post_init__(self):
        self.lookup = Lookup(self.words)

    @classmethod
    def start(cls, words: np.ndarray, counts: np.ndarray, groups: np.ndarray, masses: np.ndarray, kinds: np.ndarray, distinct: int) -> Model:
        """From words to list (with counts and own rest classes), and all words' tokens and numbers by rest class."""
        order = np.lexsort((words, -counts))[: CLASSES * (LEAVES - 1)]
        words, counts, groups = words[order], counts[order], groups[order]
        mass = masses - np.bincount(groups, counts, CLASSES) + 0.1 * (kinds - np.bincount(groups, minlength=CLASSES) + 1)
        bias = np.full((CLASSES, LEAVES), -1e9)
        bias[:, 0] = np.log(mass)
        heap, used = [(m, k) for k, m in enumerate(mass.tolist())], [1] * CLASSES
        heapq.heapify(heap)
        own, leaf = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for i, n in enumerate(counts.tolist()):  # the commonest first, each to the lightest class with a free leaf
            m, k = heapq.heappop(heap)
            own[i], leaf[i] = k, used[k]
            bias[k, used[k]] = math.log(n + 0.1)
            used[k] += 1
            if used[k] < LEAVES:
                heapq.heappush(heap, (m + n, k))
        totals = np.log(np.exp(bias).sum(axis=1))
        at = np.argsort(words)
        rows = _power(distinct / 32, MOST_CLASS_ROWS), _power(distinct / 8, MOST_LEAF_ROWS)
        class_bias = (totals - np.log(np.exp(totals).sum())).astype(np.float32)
        return cls(words[at], own[at], leaf[at], class_bias, (bias - totals[:, None]).astype(np.float32), np.log10(mass), *rows, np.zeros((3 * rows[0] + 2 * rows[1], CLASSES), np.float32))

    def labels(self, t: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and leaf of each token."""
        at, there = self.lookup.find(t)
        return (np.where(there, self.cls[at], groups), np.where(there, self.leaf[at], 0)) if len(self.words) else (groups, np.zeros(len(t), np.int64))

    def features(self, t: np.ndarray, begin: np.ndarray, cls: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(first weight row, row of each token) of the class's three features and the leaf's two; a row's start stands in for missing history."""
        one = np.concatenate([[_START], t[:-1]])
        one[begin[:-1]] = _START
        two = np.concatenate([[_START], one[:-1]])
        two[begin[:-1]] = _START
        of = (cls.astype(np.uint64) + np.uint64(1)) * _K[4]
        a, b = np.uint64(self.class_rows - 1), np.uint64(self.leaf_rows - 1)
        keys = [one * _K[0], two * _K[1], one * _K[2] + two * _K[3]]
        places = [mix(k) & a for k in keys] + [mix(k + of) & b for k in keys[:2]]
        begins = [0, self.class_rows, 2 * self.class_rows, 3 * self.class_rows, 3 * self.class_rows + self.leaf_rows]
        return [(first, p.astype(np.uint16)) for first, p in zip(begins, places, strict=True)]

    def factors(self, features: list[tuple[int, np.ndarray]], cls: np.ndarray, part: slice) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of all classes, and of all leaves of the token's class, of some tokens."""
        out = []
        for own, bias in ((features[:3], self.class_bias), (features[3:], self.leaf_bias[cls[part]])):
            z = bias + self.w[own[0][0] : own[0][0] + (1 << 16)].take(own[0][1][part], axis=0)
            for first, p in own[1:]:
                z += self.w[first : first + (1 << 16)].take(p[part], axis=0)
            np.minimum(z, 60, out=z)
            np.exp(z, out=z)
            z *= (1 / (z @ _ONES))[:, None]
            out.append(z)
        return out[0], out[1]

    def steps(self, t: np.ndarray, groups: np.ndarray, begin: np.ndarray, past: np.ndarray, touched: np.ndarray, rate: float = 0.3) -> None:
        """Gradient steps over batches of tokens, in place; ``past`` holds each weight row's mean squared gradients."""
        cls, leaf = self.labels(t, groups)
        features = self.features(t, begin, cls)
        for i in range(0, len(t), BATCH):
            part = slice(i, i + BATCH)
            for own, g, truth in zip((features[:3], features[3:]), self.factors(features, cls, part), (cls[part], leaf[part]), strict=True):
                np.negative(g, out=g)
                g[np.arange(len(truth)), truth] += 1
                for first, places in own:
                    order = np.argsort(places[part], kind="stable")
                    p = places[part][order]
                    cut = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
                    at = p[cut].astype(np.int64) + first
                    sums = _summed(g, order, cut)
                    past[at] += np.einsum("ij,ij->i", sums, sums) / CLASSES
                    self.w[at] += rate * sums / (np.sqrt(past[at]) + 1)[:, None]
                    touched[at] += np.diff(np.append(cut, len(p)))

    def values(self, t: np.ndarray, groups: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of each token's leaf (less the denominator of a rest), and whether the leaf is a rest."""
        cls, leaf = self.labels(t, groups)
        features, out = self.features(t, begin, cls), np.empty(len(t))
        for i in range(0, len(t), BATCH):
            part = slice(i, i + BATCH)
            p, q = self.factors(features, cls, part)
            at = np.arange(len(p))
            out[part] = np.log10(np.maximum(p[at, cls[part]], 1e-30)) + np.log10(np.maximum(q[at, leaf[part]], 1e-30))
        out -= np.where(leaf == 0, self.rest[cls], 0.0)
        return out, leaf == 0


assert CLASSES == LEAVES, "both factors share a table"


def counts(training: DataFrame) -> DataFrame:
    """(h, g, c): hash, class by last bytes and count of every distinct word of the training rows."""

    def run(batches):
        for b in batches:
            for _, _, data, offsets in chunks(b.column("text"), 1 << 22):
                t, g, _ = tokens(data, offsets)
                own = t != _END
                h, at, n = np.unique(t[own], return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g[own][at].astype(np.int32)), pa.array(n)], names=["h", "g", "c"])

    return table(training.select("text").mapInArrow(run, "h long, g int, c long").groupBy("h", "g").agg(F.sum("c").alias("c")))


def commonest(seen: DataFrame, most: int) -> pa.Table:
    """At most ``most`` words, all that are commoner than a bound, which a histogram of counts (sixteenths of powers of two) gives."""
    scale = F.floor(16 * F.log2("c"))
    sizes = sorted((r[0], r[1]) for r in seen.groupBy(scale.alias("k")).count().collect())
    bound = 0
    for k, n in reversed(sizes):
        if most < n:
            bound = k + 1
            break
        most -= n
    return seen.where(scale >= bound).toArrow()


def _pieces(batches, limit: int = CHUNK_BYTES):
    """(shard, texts) of about ``limit`` bytes of rows in the order of shards: cut by what the rows hold, not by batches."""
    held: list[pa.Array] = []
    size, now = 0, None
    for b in batches:
        shard, offsets = b.column("shard").to_numpy(), text_buffer(b.column("text"))[1]
        at = 0
        while at < len(shard):
            if held and shard[at] != now:
                yield now, pa.concat_arrays(held)
                held, size = [], 0
            now = shard[at]
            end = min(int(np.searchsorted(shard, now, "right")), max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit - size))))
            held.append(b.column("text").slice(at, end - at))
            size, at = size + int(offsets[end] - offsets[at]), end
            if size >= limit:
                yield now, pa.concat_arrays(held)
                held, size = [], 0
    if held:
        yield now, pa.concat_arrays(held)


def _add(w: np.ndarray, changes: pa.Table) -> None:
    """Add the mean changes by block (block, value), where they lie in Arrow's memory."""
    for b in changes.to_batches():
        for k, value in zip(b.column("block").to_pylist(), b.column("value"), strict=True):
            value = np.frombuffer(value.as_buffer(), np.float32)
            w[k * _BLOCK : (k + 1) * _BLOCK] += value[: -_BLOCK].reshape(_BLOCK, CLASSES) / np.maximum(value[-_BLOCK:, None], 1)


def train(training: DataFrame, model: Model, tokens_in_all: int, rounds: int = ROUNDS, shard_tokens: int = SHARD_TOKENS) -> None:
    """Fit the weights on all training rows: each round takes another share of them.

    Rows are dealt to rounds and shards, and ordered in these, by hashes of id and text, and the number of shards follows the tokens, so
    the weights don't depend on how the input is split, or over how many cores.
    """
    sc = training.sparkSession.sparkContext
    shards = max(1, math.ceil(tokens_in_all / (rounds * shard_tokens)))
    own = training.select(F.coalesce(F.col("doc_id"), F.lit(-1)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("spread", F.xxhash64("doc_id", "text", F.lit("shard"))).withColumn("shard", F.pmod("spread", F.lit(shards)))
    own = own.withColumn("round", F.pmod(F.xxhash64("doc_id", "text", F.lit("round")), F.lit(rounds)))
    size = len(model.w)
    for turn in range(rounds):
        now = sc.broadcast(model)  # 23 MB at most

        def run(batches, now=now):
            m, past, touched, at = None, None, None, None

            def blocks():
                change = (m.w - now.value.w) * touched[:, None]
                for k in np.flatnonzero(np.add.reduceat(touched, np.arange(0, size, _BLOCK))).tolist():
                    rows = slice(k * _BLOCK, (k + 1) * _BLOCK)
                    value = np.concatenate([change[rows].ravel(), touched[rows]])
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([k], pa.int64()), pa.array([value.tobytes()], pa.binary())], names=["part", "block", "value"])

            for shard, texts in _pieces(batches):
                if shard != at:
                    if at is not None:
                        yield from blocks()
                    m, at = replace(now.value, w=now.value.w.copy()), int(shard)
                    past, touched = np.zeros(size, np.float32), np.zeros(size, np.float32)
                for _, _, data, offsets in chunks(texts, 1 << 62):
                    m.steps(*tokens(data, offsets), past, touched)
            if at is not None:
                yield from blocks()

        dealt = own.where(F.col("round") == turn).repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "spread", "doc_id", "text").select("shard", "text")
        # Tables of the weights' size pass through the driver one at a time: the broadcast goes as soon as its round is summed, and blocks are added where they lie.
        summed = table(tree_sums(dealt.mapInArrow(run, "part long, block long, value binary"), shards, np.float32))
        now.destroy()
        tidy(training.sparkSession)
        _add(model.w, summed.toArrow())
        drop(summed)
        pa.default_memory_pool().release_unused()


def score(docs: DataFrame, folds: int = 10, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of (doc_id, text).

    Rows whose crc32(doc_id as text) mod ``folds`` is 0 are held out, all others teach. Tokens are the words
    ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, and one end; a null or empty text has the end alone. Words
    are told apart by 64-bit hashes. ``base_score`` is the add-0.1 unigram log10-probability, ``score`` the
    model's. A null doc_id is not held out. Repeated rows count, and are returned, as often as they occur.
    Without training rows base_score is 0 for each token and the model is uniform over classes.
    """
    held = F.coalesce(key_crc32() % folds == 0, F.lit(False))
    rows = whole_texts(docs, held.alias("held"))
    training = rows.where(~F.col("held"))
    return score_with(rows, *fit(training, rounds))


def fit(training: DataFrame, rounds: int = ROUNDS) -> tuple[Model, DataFrame, pa.Table, dict[str, int]]:
    """The model, all words' counts, the commonest words', and totals, from the training rows (doc_id, text)."""
    seen = counts(training)
    common = commonest(seen, COMMON)
    ends = training.count()
    by_group = {r["g"]: (r["n"], r["v"]) for r in seen.groupBy("g").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    masses, kinds = (np.array([by_group.get(g, (0, 0))[k] for g in range(CLASSES)], np.float64) for k in (0, 1))
    total, distinct = int(masses.sum()) + ends, int(kinds.sum()) + (ends > 0)
    words, often, groups = (common.column(c).to_numpy() for c in ("h", "c", "g"))
    words = words.view(np.uint64)
    if ends:  # the end counts as a word of class 0
        words, often, groups = np.append(words, _END), np.append(often, ends), np.append(groups, 0)
        masses[0], kinds[0] = masses[0] + ends, kinds[0] + 1
    model = Model.start(words, often, groups, masses, kinds, distinct)
    train(training, model, total, rounds)
    return model, seen, common, {"tokens": total, "distinct": distinct, "ends": ends}


def score_with(rows: DataFrame, model: Model, seen: DataFrame, common: pa.Table, totals: dict[str, int]) -> DataFrame:
    """The result of ``score`` for rows (doc_id, text, held)."""
    ends, whole = totals["ends"], totals["tokens"] + 0.1 * (totals["distinct"] + 1)
    order = np.argsort(common.column("h").to_numpy().view(np.uint64))
    keys, logs = common.column("h").to_numpy().view(np.uint64)[order], np.log10(common.column("c").to_numpy()[order] + 0.1)
    shared = rows.sparkSession.sparkContext.broadcast((model, Lookup(keys), logs))

    def run(batches):
        model, keys, logs = shared.value
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            held = b.column("held")
            for first, end, data, offsets in chunks(b.column("text")):
                t, g, begin = tokens(data, offsets)
                value, in_rest = model.values(t, g, begin)
                place, there = keys.find(t)
                log = np.where(there, logs[place] if len(logs) else 0.0, 0.0)
                is_end = t == _END
                log[is_end] = math.log10(ends + 0.1)
                value[in_rest] += log[in_rest]
                rest = ~there & ~is_end
                add = lambda x: np.add.reduceat(x, begin[:-1])
                row = np.repeat(np.arange(end - first), np.diff(begin))[rest]
                sizes = np.bincount(row, minlength=end - first)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(t[rest].view(np.int64)))
                key = (part << 40) + at + np.arange(end - first)
                at += end - first
                cut = lambda c: c.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([pa.array(key), cut(b.column("doc_id")), cut(held), pa.array(np.diff(begin)), pa.array(add((there | (is_end & (ends > 0))).astype(np.int64))), pa.array(add(log)), pa.array(add(value)), lists], names=["key", "doc_id", "held_out", "n_tokens", "n_known", "logs", "value", "rest"])

    done = table(rows.mapInArrow(run, "key long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, value double, rest array<long>"))
    rare = done.select("key", F.explode("rest").alias("h"))
    met = rare.join(seen.select("h", "c"), "h", "left").groupBy("key").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("_h_logs"), F.count("c").alias("_h_known"))
    out = done.select("key", "doc_id", "held_out", "n_tokens", "n_known", "logs", "value").join(met, "key", "left")
    extra = F.coalesce("_h_logs", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("_h_known", F.lit(0))).alias("n_known"),
        F.lit(totals["tokens"]).cast("long").alias("train_tokens"),
        (F.col("logs") + extra - F.col("n_tokens") * F.lit(math.log10(whole))).alias("base_score"),
        (F.col("value") + extra).alias("score"),
    )
