"""Source divergence audit: how the sources of a language differ in their terms, by sorted runs.

Each task adds up a chunk of documents to rows (lang, term, source, first document, documents, occurrences) before anything
moves. These are repartitioned by (lang, term) and sorted within partitions by (lang, term, source, document), so that
a scan sees each term as one run and each of its sources as one run within: their lengths are document frequency and
counts. Terms that are common in a chunk meet by (lang, term, source) and a salt first, so no term's run is longer
than its sources times SALTS. A second scan over the terms kept emits each run's terms and partial sums of its pairs.

Of a pair of sources, terms that one of them lacks give what depends on its totals alone. They are added from the
numbers of terms by count, a few rows a source, and a run only adds for the sources that it has:
with f(c, d) of the counts c and d, f(c, d) = f(c, 0) + [f(0, d) - f(0, 0)] + [f(c, d) - f(c, 0) - f(0, d) + f(0, 0)].
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, drop, partitions, table, text_buffer

UNIT = 1_000_000_000
LEAST_DOCS = 3
RANKS = 200
#: Bytes of text, and documents, that are added up before they move.
CHUNK, CHUNK_ROWS = 16 << 20, 1 << 16
#: A term of more documents of a chunk is common there; its rows meet in so many parts first.
COMMON, SALTS = 64, 32
#: (lang, source) groups whose totals every task holds, about 200 bytes each; counted, and refused beyond.
HELD_GROUPS = 500_000
#: Pairs that a task compares, or keeps sums of, at once.
PAIRS = 1 << 20
TERM = np.zeros(256, bool)
TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True
_ROW = "lang string, term string, source string, doc long, docs long, n long, common boolean"


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms, matches of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased, and the row of each."""
    inside = TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    begin = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    terms = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(begin), pa.py_buffer(LOWER[data[inside]])])
    return terms, np.searchsorted(offsets, starts, "right") - 1


def _runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.ones(len(sorted_columns[0]), bool)
    new[1:] = False
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _lengths(begin: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(begin, n))


def added_up(data: np.ndarray, offsets: np.ndarray, doc: pa.Array, lang: pa.Array, source: pa.Array) -> pa.RecordBatch | None:
    """Rows of _ROW of a chunk of documents."""
    terms, row = spans(data, offsets)
    if not len(terms):
        return None
    code = terms.dictionary_encode()
    words, code = code.dictionary, code.indices.to_numpy().astype(np.int64)
    langs, sources = (x.dictionary_encode() for x in (lang, source))
    of_lang, of_source = (x.indices.to_numpy().astype(np.int64) for x in (langs, sources))
    group, own = np.unique(of_lang * len(sources.dictionary) + of_source, return_inverse=True)
    at = np.sort((own[row] * len(words) + code) * len(offsets) + row)  # by group, term, row: chunks are small enough for 63 bits
    pair, row = np.divmod(at, len(offsets))
    begin = _runs(pair)
    each_doc = _runs(pair, row)
    docs = np.diff(np.append(np.searchsorted(each_doc, begin), len(each_doc)))
    own, code = np.divmod(pair[begin], len(words))
    l, s = np.divmod(group[own], len(sources.dictionary))
    _, whole = np.unique(l * len(words) + code, return_inverse=True)
    common = np.bincount(whole, docs)[whole] > COMMON
    cols = [langs.dictionary.take(pa.array(l)), words.take(pa.array(code)).cast(pa.binary()).cast(pa.string()), sources.dictionary.take(pa.array(s))]
    cols += [doc.take(pa.array(row[begin])), pa.array(docs.astype(np.int64)), pa.array(_lengths(begin, len(pair)).astype(np.int64)), pa.array(common)]
    return pa.RecordBatch.from_arrays(cols, schema=_SCHEMA)


_SCHEMA = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("doc", pa.int64()), ("docs", pa.int64()), ("n", pa.int64()), ("common", pa.bool_())])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input batches put together to about CHUNK bytes (a document at least), and cut where one alone has more."""
    held: list[pa.RecordBatch] = []
    size = rows = 0
    for b in batches:
        offsets = text_buffer(b.column("text"))[1]
        first = 0
        while first < b.num_rows:
            end = int(np.searchsorted(offsets, offsets[first] + CHUNK - size, "right")) - 1
            end = min(max(end, first + (not held)), b.num_rows, first + CHUNK_ROWS - rows)
            if end > first:
                held.append(b.slice(first, end - first))
                size, rows = size + int(offsets[end] - offsets[first]), rows + end - first
            first = end
            if first < b.num_rows or size >= CHUNK or rows >= CHUNK_ROWS:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size, rows = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _rows(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in _gathered(batches):
            data, offsets = text_buffer(b.column("text"))
            got = added_up(data[offsets[0] : offsets[-1]], offsets - offsets[0], *(b.column(c) for c in ("doc", "lang", "source")))
            if got is not None:
                yield got

    return docs.mapInArrow(run, _ROW)


def _strings(column: pa.Array) -> np.ndarray:
    return column.dictionary_encode().indices.to_numpy().astype(np.int64)


def _scan(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Rows in the order of (lang, term, source, doc): whole runs of (lang, term) to (lang, term, docs, sources, counts)."""

    def run(batches):
        rest = None
        for b in batches:
            whole = pa.Table.from_batches([b] if rest is None else [rest, b]).combine_chunks()
            b = whole.to_batches()[0] if whole.num_rows else None
            if b is None:
                continue
            begin = _runs(_strings(b.column("lang")), _strings(b.column("term")))
            last = begin[-1]
            if last:
                yield _folded(b.slice(0, last), begin[:-1])
            rest = _shrunk(b.slice(last))
        if rest is not None:
            yield _folded(rest, np.zeros(1, np.int64))

    def _shrunk(b: pa.RecordBatch) -> pa.RecordBatch:
        """An open run with a row a source: what waits for the next batch is no longer than its sources."""
        first = _runs(_strings(b.column("source")))
        if len(first) == b.num_rows:
            return b
        sums = {c: pa.array(np.add.reduceat(b.column(c).to_numpy(), first)) for c in ("docs", "n")}
        b = b.take(pa.array(first))
        return pa.RecordBatch.from_arrays([sums.get(c, b.column(c)) for c in b.schema.names], schema=b.schema)

    def _folded(b: pa.RecordBatch, begin: np.ndarray) -> pa.RecordBatch:
        term = np.zeros(b.num_rows, np.int64)
        term[begin] = 1
        first = _runs(np.cumsum(term), _strings(b.column("source")))
        n, docs = np.add.reduceat(b.column("n").to_numpy(), first), np.add.reduceat(b.column("docs").to_numpy(), begin)
        sources = b.column("source").take(pa.array(first))
        ends = np.append(np.searchsorted(first, begin), len(first)).astype(np.int32)
        keep = pa.array(docs >= width)
        cols = [b.column("lang").take(pa.array(begin)), b.column("term").take(pa.array(begin)), pa.array(docs), pa.ListArray.from_arrays(pa.array(ends), sources), pa.ListArray.from_arrays(pa.array(ends), pa.array(n))]
        return pa.RecordBatch.from_arrays(cols, names=["lang", "term", "docs", "sources", "counts"]).filter(keep)

    return rows.sortWithinPartitions(*keys).mapInArrow(run, "lang string, term string, docs long, sources array<string>, counts array<long>")


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """A table (lang, term, docs, sources, counts) of each lang's terms in at least ``least`` of its rows; docs has (doc, text, lang, source)."""
    keys, n = ["lang", "term", "source", "doc"], partitions(docs.sparkSession)
    rows = table(_rows(docs).withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS))))
    often = rows.where("common").repartition(n, "lang", "term", "source", "salt")
    often = often.groupBy("lang", "term", "source", "salt").agg(F.min("doc").alias("doc"), F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    meet = rows.where("NOT common").select(*keys, "docs", "n").unionByName(often.select(*keys, "docs", "n"))
    out = table(_scan(meet.repartition(n, "lang", "term"), keys, least))
    drop(rows)
    return out


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * n / total) without passing 63 bits, for totals below 9e15: three digits at a time."""
    out, rest = np.divmod(n, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q)."""
    return (p - q) ** 2 // q


class Sums:
    """Sums by a pair of numbers, kept as sorted arrays, and emitted when there are too many."""

    def __init__(self):
        self.key, self.value, self.waiting, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, key: np.ndarray, value: np.ndarray) -> None:
        self.waiting.append((key, value))
        self.size += len(key)
        if self.size >= PAIRS:
            self.fold()

    def fold(self) -> None:
        keys = np.concatenate([self.key, *(k for k, _ in self.waiting)])
        values = np.concatenate([self.value, *(v for _, v in self.waiting)])
        self.waiting, self.size = [], 0
        if len(keys):
            order = np.argsort(keys, kind="stable")
            keys, values = keys[order], values[order]
            begin = _runs(keys)
            self.key, self.value = keys[begin], np.add.reduceat(values, begin)

    def full(self) -> bool:
        return len(self.key) >= PAIRS

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.fold()
        out = self.key, self.value
        self.key, self.value = np.zeros(0, np.int64), np.zeros(0, np.int64)
        return out


class Groups:
    """The (lang, source) groups in order, what each adds to a share (occurrences of kept terms, terms of the lang) and each lang's own."""

    def __init__(self, rows: list):
        rows = sorted((r["lang"], r["source"], r["n"] or 0, r["v"] or 0) for r in rows)
        self.lang, self.source = [r[0] for r in rows], [r[1] for r in rows]
        self.total = np.array([r[2] + r[3] for r in rows], np.int64)
        self.langs = sorted(set(self.lang))
        of = {x: k for k, x in enumerate(self.langs)}
        self.of_lang = np.array([of[x] for x in self.lang], np.int64)
        self.place = {(x, s): k for k, (x, s) in enumerate(zip(self.lang, self.source, strict=True))}
        n, v = np.zeros(len(self.langs), np.int64), np.zeros(len(self.langs), np.int64)
        np.add.at(n, self.of_lang, np.array([r[2] for r in rows], np.int64))
        v[self.of_lang] = [r[3] for r in rows]
        self.terms, self.lang_total = v, n + v
        self.first = np.searchsorted(self.of_lang, np.arange(len(self.langs)))
        self.end = np.searchsorted(self.of_lang, np.arange(len(self.langs)), "right")
        self.zero = shares(np.ones(len(rows), np.int64), np.maximum(self.total, 1))

    def of_rows(self, lang: pa.Array, sources: pa.ListArray) -> np.ndarray:
        """Group of each of the sources in the lists."""
        lang, flat = lang.dictionary_encode(), sources.flatten().dictionary_encode()
        l, s = lang.dictionary.to_pylist(), flat.dictionary.to_pylist()
        known = np.array([[self.place.get((a, b), -1) for b in s] for a in l], np.int64).reshape(len(l), len(s))
        return known[np.repeat(lang.indices.to_numpy(), pc.list_value_length(sources).to_numpy()), flat.indices.to_numpy()]

    def pairs(self, sums: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        key, value = sums
        g, h = np.divmod(key, len(self.lang))
        lang, source = pa.array(self.lang, pa.string()), pa.array(self.source, pa.string())
        return pa.RecordBatch.from_arrays([lang.take(pa.array(g)), source.take(pa.array(g)), pa.array(["pair"] * len(g), pa.string()), source.take(pa.array(h)), pa.array(value)], names=_OUT)


_OUT = ["lang", "source", "part", "item", "value"]
_OUT_ROW = "lang string, source string, part string, item string, value long"


def _of_runs(kept: DataFrame, groups: Groups, ranks: int) -> DataFrame:
    """What runs of kept terms give: partial sums of their pairs, and terms above their lang's share (a task's best ``ranks`` of each group)."""
    n_groups = len(groups.lang)

    def run(batches):
        sums, best = Sums(), []
        held, least = 0, np.zeros(n_groups, np.int64)  # the value that a term needs to be among a group's best so far
        for b in batches:
            at = groups.of_rows(b.column("lang"), b.column("sources"))
            length = pc.list_value_length(b.column("sources")).to_numpy().astype(np.int64)
            counts = b.column("counts").flatten().to_numpy()
            p = shares(counts + 1, groups.total[at])
            run_of, first = np.repeat(np.arange(len(length)), length), np.cumsum(length) - length
            whole = np.add.reduceat(counts, first)
            q = shares(whole + 1, groups.lang_total[groups.of_lang[at[first]]])[run_of]
            f = gaps(p, q)
            keep = np.flatnonzero((p > q) & (f >= least[at]))
            best.append((at[keep], f[keep], b.column("term").take(pa.array(run_of[keep]))))
            held += len(keep)
            if held > 2 * ranks * n_groups + 65536:
                best = [_best(best, ranks, least)]
                held = len(best[0][0])
            for a, c in _pair_blocks(first, length):
                sums.add(at[a] * n_groups + at[c], gaps(p[a], p[c]) - gaps(p[a], groups.zero[at[c]]) - gaps(groups.zero[at[a]], p[c]) + gaps(groups.zero[at[a]], groups.zero[at[c]]))
                if sums.full():
                    yield groups.pairs(sums.take())
        yield groups.pairs(sums.take())
        if best:
            at, f, term = _best(best, ranks, least)
            lang, source = (pa.array(x, pa.string()).take(pa.array(at)) for x in (groups.lang, groups.source))
            yield pa.RecordBatch.from_arrays([lang, source, pa.array(["term"] * len(at), pa.string()), term, pa.array(f)], names=_OUT)

    return kept.mapInArrow(run, _OUT_ROW)


def _pair_blocks(first: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, c), a <> c, of all pairs within runs, about PAIRS at a time."""
    member = np.repeat(np.arange(len(length)), length)
    ends = np.cumsum(length[member])
    at = 0
    while at < len(member):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        own = np.arange(at, end)
        size = length[member[own]]
        a = np.repeat(own, size)
        c = np.repeat(first[member[own]], size) + np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size)
        yield a[a != c], c[a != c]
        at = end


def _best(parts: list, ranks: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The ``ranks`` largest of each group and what equals the last of them; ``least`` gets that value."""
    at, f = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
    term = pa.concat_arrays([x[2] for x in parts])
    order = np.lexsort((-f, at))
    at, f = at[order], f[order]
    begin = _runs(at) if len(at) else np.zeros(0, np.int64)
    size = _lengths(begin, len(at))
    last = f[begin + np.minimum(size, ranks) - 1]
    full = size >= ranks
    least[at[begin[full]]] = last[full]
    keep = f >= np.repeat(np.where(full, last, 0), size)
    return at[keep], f[keep], term.take(pa.array(order[keep]))


def _of_counts(by_count: DataFrame, groups: Groups) -> DataFrame:
    """Partial sums of pairs that come from the numbers of a group's terms by count: as if the other source had none of them,
    and what a source's terms change for others that have none of them."""
    n_groups = len(groups.lang)

    def run(batches):
        sums = Sums()
        for b in batches:
            at = groups.of_rows(b.column("lang"), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32)), b.column("source")))
            counts, terms = b.column("count").to_numpy(), b.column("terms").to_numpy()
            p = shares(counts + 1, np.maximum(groups.total[at], 1))
            for g, c, n, own in zip(at, counts, terms, p, strict=True):
                others = np.arange(groups.first[groups.of_lang[g]], groups.end[groups.of_lang[g]])
                others = others[others != g]
                sums.add(g * n_groups + others, n * gaps(own, groups.zero[others]))
                if c:
                    sums.add(others * n_groups + g, n * (gaps(groups.zero[others], own) - gaps(groups.zero[others], groups.zero[g])))
                if sums.full():
                    yield groups.pairs(sums.take())
        yield groups.pairs(sums.take())

    return by_count.mapInArrow(run, _OUT_ROW)


RESULT = "lang string, source string, part string, item string, value long, rank int"


def audit(docs: DataFrame, least: int = LEAST_DOCS, ranks: int = RANKS, doc_id: str = "doc_id") -> DataFrame:
    """RESULT: how far each (lang, source) is from each other source of its lang (part ``pair``), and by which terms from the lang (``term``).

    A null or absent text, lang or source is an empty string, with a group of its own; repeated rows are documents of their own. A lang's V
    terms are those in at least ``least`` of its documents. A group's share of a term is p = 1 + floor(UNIT (count + 1) / (N + V)), N its
    occurrences of kept terms; p against q gives f = floor((p - q)^2 / q). ``pair`` has f summed over all kept terms (0 if there
    are none), with the other source's q; ``term`` has f of the group's own terms with p above the lang's q. Ranks by group
    and part begin at 1, the largest value first, ties by the item's bytes; ``term`` has ``ranks`` of them. Texts are read whole; an
    empty table gives an empty result. Raises with more than HELD_GROUPS groups, whose pairs alone would be billions of rows.
    """
    spark = docs.sparkSession
    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in docs.columns else F.lit("").alias(c) for c in ("text", "lang", "source"))
    own = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-1)).alias("doc"), text, lang, source)
    kept = kept_terms(own, least)
    each = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", F.col("x.sources").alias("source"), F.col("x.counts").alias("count"))
    by_count = table(each.groupBy("lang", "source", "count").agg(F.count("*").alias("terms")))
    found = own.select("lang", "source").distinct()
    totals = by_count.groupBy("lang", "source").agg(F.sum(F.col("count") * F.col("terms")).alias("n"), F.sum("terms").alias("has"))
    v = kept.groupBy("lang").agg(F.count("*").alias("v"))
    stats = table(found.join(totals, ["lang", "source"], "left").join(v, "lang", "left"))
    if stats.count() > HELD_GROUPS:
        raise ValueError(f"more than {HELD_GROUPS} groups of lang and source")
    groups = Groups(stats.collect())
    none = stats.select("lang", "source", F.lit(0).cast("long").alias("count"), (F.coalesce("v", F.lit(0)) - F.coalesce("has", F.lit(0))).alias("terms"))
    if not groups.lang:
        return spark.createDataFrame([], RESULT)
    parts = _of_runs(kept, groups, ranks).unionByName(_of_counts(by_count.unionByName(none), groups))
    parts = table(parts)
    drop(kept, by_count, stats)
    pair = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    w = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(w).alias("rank")
    salt = Window.partitionBy("lang", "source", "part", F.pmod(F.xxhash64("item"), F.lit(SALTS))).orderBy(F.desc("value"), "item")
    term = parts.where("part = 'term'").withColumn("rank", F.row_number().over(salt)).where(F.col("rank") <= ranks).drop("rank")  # a task's best meet in parts of a group first
    term = term.select("*", rank).where(F.col("rank") <= ranks)
    return pair.select("*", rank).unionByName(term)
