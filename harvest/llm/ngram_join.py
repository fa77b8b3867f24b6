"""N-gram Jaccard self-join by a size-aware heavy-light join, up to connected components.

Documents with the same shingle set are one class; only classes join. Two classes link when
``100 * |A & B| >= percent * |A | B|``.

* Light classes (size up to a boundary) enumerate subsets: a link of sizes s and b means that c(s, b) =
  ceil(percent * (s + b) / (100 + percent)) shingles are shared, so both hold the same c-subset. For s <= b a
  shared c(s, b)-subset links any holder to one of size s, as c(s, s) <= c(s, b), but not two of size b. So holders
  are tied to one of the smaller size, where there is one; nothing is left to verify.
* Pairs with a heavy class scan inverted lists. A class is listed under its prefix: its rarest shingles
  (corpus frequency, then hash), as many as must hold one of any partner's. Listed pairs within the size
  ratio are candidates; parity bitmaps bound their distance from below, and what they can't rule out
  is counted on the texts.
* The boundary minimises the cost of both, from the histogram of class sizes.

Large groups of near copies don't meet as pairs: first every class is verified against the most central class
(that with the least share of shingles that are rare in the corpus) of each of a few min-hashes; lists whose
classes are then all in one component are done, and between two components the closest candidate goes first.
What remains is verified without exception, so no link between components is lost. Keys that hold many rows
(sets, subsets, min-hashes) meet by broadcast, and a long list of classes in squares of blocks.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, drop, join_groups, mix, multipliers, shingle_hashes, table, tidy, whole_texts, word_hashes
from .components import components

#: Size of the table of shingle frequencies, by hash; it only orders the lists.
BUCKETS = 1 << 24
#: Sizes that may be light.
MOST_LIGHT = 32
#: What a listed shingle costs, in units of a subset.
LIST_COST = 3.0
MIN_HASHES = 4
#: Classes of one list that meet in one task.
LIST_BLOCK = 2048
_K = multipliers(MIN_HASHES + 2)[2:]


def overlap(a: int, b: int, percent: int) -> int:
    """Shingles that sets of these sizes must share to link."""
    return -(-percent * (a + b) // (100 + percent))


def boundary(sizes: dict[int, int], percent: int) -> int:
    """The largest light size, by cost: subsets of light classes against lists of the others."""

    def subsets(s: int, x: int) -> int:
        return sum(comb(s, c) for b in range(1, x + 1) if (c := overlap(s, b, percent)) <= min(s, b))

    def listed(s: int) -> int:
        return s - -(-percent * s // 100) + 1

    def cost(x: int) -> float:
        light = sum(n * subsets(s, x) for s, n in sizes.items() if s <= x)
        return light + LIST_COST * sum(n * listed(s) for s, n in sizes.items() if s * 100 >= percent * (x + 1))

    return min(range(MOST_LIGHT + 1), key=lambda x: (cost(x), x))


def _sets(batches, size):
    """(row ids, texts as one buffer) to the distinct shingles of each row."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for first, end, data, offsets in chunks(batch.column("text")):
            hashes, begin = shingle_hashes(*word_hashes(data, offsets), size)
            for r in range(end - first):
                yield int(ids[first + r]), np.unique(hashes[begin[r] : begin[r + 1]])


def _frequencies(docs: DataFrame, size: int) -> np.ndarray:
    """How often the commoner shingles occur, by bucket; buckets common in no partition stay 0."""

    def run(batches):
        counts = np.zeros(BUCKETS, np.int32)
        for _, s in _sets(batches, size):
            if len(s):
                np.add.at(counts, (s >> np.uint64(40)).astype(np.int64), 1)
        mean = counts.mean()
        often = np.flatnonzero(counts > mean + 3 * np.sqrt(mean) + 1.5)
        yield pa.RecordBatch.from_arrays([pa.array(often.astype(np.int32)), pa.array(counts[often].astype(np.int64))], names=["b", "n"])

    found = docs.mapInArrow(run, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows at most
    out = np.zeros(BUCKETS, np.uint8)  # eighths of a power of two: enough for an order
    out[found.column("b").to_numpy()] = np.minimum(8 * np.log2(found.column("n").to_numpy() + 1.0), 255)
    return out


def _bitmap(s: np.ndarray) -> bytes:
    """Parity of the shingles in each of 4 times as many bits, or a little more; a power of two."""
    bits = 1 << max(6, int(4 * len(s) - 1).bit_length())
    odd = (np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the number of shingles in just one of two sets. Halves fold onto one another until lengths agree."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def profiles(docs: DataFrame, percent: int, size: int) -> DataFrame:
    """Of each (doc_id, text): set size, 128-bit key of the set, prefix, min-hashes, bitmap, whole set if it may be light,
    and how many in a thousand of its shingles are rare in the corpus."""
    weights = docs.sparkSession.sparkContext.broadcast(_frequencies(docs, size))  # 16 MB at any size

    def run(batches):
        rank, out = weights.value, []

        def batch():
            cols = list(zip(*out, strict=True))
            types = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 3 + [pa.binary(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        for doc, s in _sets(batches, size):
            n = len(s)
            if n:
                signed = s.view(np.int64)
                keep = n - -(-percent * n // 100) + 1
                often = rank[(s >> np.uint64(40)).astype(np.int64)]
                prefix = signed[np.lexsort((s, often))[:keep]]
                least = np.array([mix(s * k).min() for k in _K[:MIN_HASHES]]).view(np.int64)
                hi, lo = int(np.add.reduce(mix(s ^ _K[0])).view(np.int64)), int(np.bitwise_xor.reduce(mix(s + _K[1])).view(np.int64))
                out.append((doc, n, hi, lo, prefix, least, signed if n <= MOST_LIGHT else None, _bitmap(s), int(1000 * np.count_nonzero(often == 0) / n)))
            else:
                out.append((doc, 0, 0, 0, None, None, None, None, 0))
            if len(out) >= 1000:
                yield batch()
                out.clear()
        if out:
            yield batch()

    names = ["doc_id", "n", "hi", "lo", "prefix", "least", "small", "bits", "rare"]
    return docs.mapInArrow(run, "doc_id long, n long, hi long, lo long, prefix array<long>, least array<long>, small array<long>, bits binary, rare int")


def _light_links(classes: DataFrame, most: int, percent: int) -> DataFrame:
    """Edges (a, b) that tie the holders of each enumerated subset to the first of them that has the smaller size."""

    def run(batches):
        for b in batches:
            rep, low, high, key, less = [], [], [], [], []
            for r, s in zip(b.column("rep").to_pylist(), b.column("small").to_pylist(), strict=True):
                n = len(s)
                x = np.sort(np.array(s, np.int64).view(np.uint64))
                for m in range(1, most + 1):
                    c = overlap(n, m, percent)
                    if c > min(n, m):
                        continue
                    total = mix(x + _K[2])
                    for left_out in combinations(range(n), n - c):  # a subset is the sum of all but what is left out
                        h = np.add.reduce(total) - np.add.reduce(total[list(left_out)]) if left_out else np.add.reduce(total)
                        rep.append(r)
                        low.append(min(n, m))
                        high.append(max(n, m))
                        key.append(int(np.uint64(h).view(np.int64)))
                        less.append(n <= m)
            yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(key, pa.int64()), pa.array(less, pa.bool_())], names=["a", "low", "high", "key", "less"])

    subsets = table(classes.where(F.col("n") <= most).select("rep", "small").mapInArrow(run, "a long, low int, high int, key long, less boolean"))
    least = table(subsets.groupBy("low", "high", "key").agg(F.min(F.when(F.col("less"), F.col("a"))).alias("b"), F.count("*").alias("_h_c")).where("_h_c > 1 AND b IS NOT NULL"))
    links = table(join_groups(subsets, least, ["low", "high", "key"]).where("a <> b").select("a", "b").distinct())
    drop(subsets, least)
    return links


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that sizes and bitmaps admit, with the least difference."""

    def run(batches):
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            far = np.fromiter((least_difference(x, y) for x, y in zip(batch.column("bitsa").to_pylist(), batch.column("bitsb").to_pylist(), strict=True)), np.int64, batch.num_rows)
            # |A & B| = (na + nb - difference) / 2 and |A | B| = (na + nb + difference) / 2
            keep = pa.array(100 * (na + nb - far) >= percent * (na + nb + far))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(far).filter(keep)], names=["a", "b", "far"])

    left, right = (classes.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}")) for c in "ab")
    near = pairs.join(left, "a").join(right, "b").where((F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent))
    return near.select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(run, "a long, b long, far long")


def _verified(pairs: DataFrame, docs: DataFrame, percent: int, size: int) -> DataFrame:
    """A table of those of the pairs (a, b) that link, counted on the whole texts; only the texts that pairs need are moved."""

    def run(batches):
        for batch in batches:
            a, b = (dict(enumerate(s for _, s in _sets([pa.RecordBatch.from_arrays([batch.column("a"), batch.column(t)], names=["doc_id", "text"])], size))) for t in ("ta", "tb"))
            keep = []
            for i in range(batch.num_rows):
                both = len(np.intersect1d(a[i], b[i], assume_unique=True))
                keep.append(100 * both >= percent * (len(a[i]) + len(b[i]) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    needed = [table(pairs.select(F.col(c).alias("doc_id")).distinct()) for c in "ab"]  # of b there are few: the central ones
    texts = [table(docs.join(n, "doc_id", "left_semi").select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}"))) for c, n in zip("ab", needed, strict=True)]
    linked = table(pairs.select("a", "b").join(texts[0], "a").join(texts[1], "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"))
    drop(*needed, *texts)
    return linked


def _central(heavy: DataFrame) -> DataFrame:
    """Pairs (a, b) of each class with the most central class of each of its min-hashes."""
    hashed = heavy.select("rep", "rare", F.posexplode("least"))
    first = table(hashed.groupBy("pos", "col").agg(F.min_by("rep", F.struct("rare", "rep")).alias("b"), F.count("*").alias("_h_c")).where("_h_c > 1"))
    return join_groups(hashed.select("rep", "pos", "col"), first, ["pos", "col"]).select(F.col("rep").alias("a"), "b").where("a <> b").distinct()


def _met(lists: DataFrame, most: int, percent: int) -> DataFrame:
    """Pairs (a, b) of classes of different components that lie in one list (token) and that sizes and places admit.

    lists: token, rep, n, component, pos. A list of more than LIST_BLOCK classes is dealt to squares of blocks: each class
    goes to one row and one column of squares, and two classes meet in one square.
    """
    long = F.broadcast(lists.groupBy("token").agg(F.count("*").alias("_h_c")).where(F.col("_h_c") > LIST_BLOCK))  # fewer than rows / LIST_BLOCK
    marked = lists.join(long, "token", "left").withColumn("_h_n", F.ceil(F.coalesce("_h_c", F.lit(1)) / LIST_BLOCK).cast("int")).drop("_h_c")
    own = F.pmod(F.xxhash64("rep"), F.col("_h_n")).cast("int")
    left = marked.select("token", *(F.col(k).alias(f"{k}a") for k in ("rep", "n", "component", "pos")), own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("_h_n") - 1)).alias("j"))
    right = marked.select("token", *(F.col(k).alias(f"{k}b") for k in ("rep", "n", "component", "pos")), F.explode(F.sequence(F.lit(0), F.col("_h_n") - 1)).alias("i"), own.alias("j"))
    met = left.join(right, ["token", "i", "j"]).where((F.col("componenta") != F.col("componentb")) & (F.col("repa") < F.col("repb")) & (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent) & (F.greatest("na", "nb") > most))
    # of the first shingle that two linked classes share, neither has too few after it
    rest = 1 + F.least(F.col("na") - F.col("posa") - 1, F.col("nb") - F.col("posb") - 1)
    met = met.where(rest * (100 + percent) >= percent * (F.col("na") + F.col("nb")))
    return met.select(F.col("repa").alias("a"), F.col("repb").alias("b")).distinct()


def _components(docs: DataFrame, percent: int, size: int) -> DataFrame:
    """(doc_id, n, component) of (doc_id, text), whose ids are there and unique."""
    spark = docs.sparkSession
    all_rows = table(profiles(docs, percent, size))
    grouped = table(all_rows.where("n > 0").groupBy("n", "hi", "lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("_h_c")))
    member = table(join_groups(all_rows.select("doc_id", "n", "hi", "lo").where("n > 0"), grouped, ["n", "hi", "lo"]).select("doc_id", "n", "rep").unionByName(all_rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("rep"))))
    classes = table(all_rows.join(grouped.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").withColumnRenamed("doc_id", "rep").select("rep", "n", "prefix", "least", "small", "bits", "rare"))
    drop(all_rows, grouped)
    tidy(spark)
    sizes = {r[0]: r[1] for r in classes.groupBy(F.least("n", F.lit(2 * MOST_LIGHT)).alias("n")).count().collect()}
    most = boundary(sizes, percent)
    heavy = classes.where(F.col("n") * 100 >= percent * (most + 1))

    light = _light_links(classes, most, percent)
    possible = table(_possible(_central(heavy), classes, percent))
    near = _verified(possible, docs, percent, size)
    drop(possible)
    links = light.unionByName(near)
    known = components(links)
    tidy(spark)
    listed = heavy.select("rep", F.posexplode("prefix").alias("pos", "token"))
    shared = table(listed.groupBy("token").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count("*").alias("_h_c")).where("lo < hi").select("token", "_h_c"))
    tidy(spark)
    short = table(join_groups(listed, shared, ["token"]))
    drop(shared)
    tidy(spark)
    lists = table(short.join(classes.select("rep", "n"), "rep").join(known.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    drop(short)
    mixed = table(lists.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("_h_c")).where("lo < hi").select("token", "_h_c"))
    left = table(join_groups(lists, mixed, ["token"]))
    drop(lists, mixed)
    met = table(_met(left, most, percent))
    drop(left)
    open_pairs = table(_possible(met, classes, percent))
    drop(met)

    first_turn = True
    while not open_pairs.isEmpty():
        tied = open_pairs.join(known.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(known.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
        tied = tied.select("a", "b", "far", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb")
        tied = table(tied.select("a", "b", "far", F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")))
        drop(open_pairs)
        chosen = tied
        if first_turn:  # the closest pair of each two components may spare the others
            chosen = table(tied.groupBy("ca", "cb").agg(F.min(F.struct("far", "a", "b")).alias("m")).select("m.a", "m.b"))
        new = _verified(chosen, docs, percent, size)
        if not new.isEmpty():
            links = links.unionByName(new)
            known = components(links)
        if not first_turn:
            break
        open_pairs = table(tied.select("a", "b", "far").join(chosen.select("a", "b"), ["a", "b"], "left_anti"))
        first_turn = False
    drop(classes)
    return member.join(known.select(F.col("id").alias("rep"), "component"), "rep", "left").select("doc_id", "n", F.coalesce("component", "rep").alias("component"))


def ngram_components(docs: DataFrame, percent: int = 85, size: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of (doc_id, text), whole texts.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a set is the distinct runs of ``size`` words, the
    whole sequence where there are fewer, empty without words. Empty sets (null text too) link with nothing:
    their component is their own id. Sets are compared by 64-bit hashes of their shingles.

    Each row is a document. component_id is the smallest doc_id of the rows that links reach; where doc_id is null
    or repeats, rows keep their own sets and links, and a component without any id has a null component_id.
    """
    own = whole_texts(docs).fillna("", ["text"])
    names = own.groupBy("doc_id").agg(F.count("*").alias("c"))
    if names.where("doc_id is null or c > 1").isEmpty():
        return _components(own, percent, size).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    rows = table(own.withColumn("row", F.monotonically_increasing_id()))
    got = table(_components(rows.select(F.col("row").alias("doc_id"), "text"), percent, size).withColumnRenamed("doc_id", "row"))
    named = table(got.join(rows.select("row", "doc_id"), "row"))
    least = table(named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("_h_c")))
    return join_groups(named, least, ["component"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
