"""N-best segmentation over a SentencePiece vocabulary, and decoding.

Text is normalised as the vocabularies here ask (a space before the text, spaces as U+2581). No piece runs
past a word, so the piece lattice of a text is a chain of its words' lattices:

* distinct words are scored together, by length: forward Viterbi scores, backward scores, and from both
  the cost of the best detour (a path with an edge off the best path);
* only words with the cheapest detours can differ in the n best segmentations of a text. For these an A-star
  search runs backwards from the word's end, with the forward scores as exact heuristics, and yields
  the word's segmentations best first;
* the lists of these words are merged into the text's n best.

A character without a piece is spelled in byte pieces, at a penalty below the worst score. Of equal scores the best
segmentation has the longest last pieces; others come as the search meets them, and an earlier word's change first.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix, whole_texts

SPACE = 0x2581
PENALTY = 10.0
#: Words of more characters are segmented one by one.
LONG_WORD = 32
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_MODELS: dict[str, Pieces] = {}


class Pieces:
    """A vocabulary as sorted hash arrays."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.byte_of = {i: int(self.text[i][3:5], 16) for i in range(n) if model.is_byte(i)}
        self.byte_id = np.zeros(256, np.int64)
        for i, b in self.byte_of.items():
            self.byte_id[b] = i
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and self.text[i]]
        for i in plain:
            p = self.text[i]
            if "\n" in p and len(p) > 1 or "▁" in p.lstrip("▁"):
                raise ValueError(f"piece {p!r} runs past a word")
        self.score = np.array([model.get_score(i) for i in range(n)])
        self.longest = max(len(self.text[i]) for i in plain)
        self.unknown = float(min(self.score[i] for i in plain)) - PENALTY
        self.index = {self.text[i]: i for i in plain}
        points = [np.frombuffer(self.text[i].encode("utf-32-le"), "<u4") for i in plain]
        keys = np.array([self.key(p) for p in points], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(plain)[order]
        self.maybe = np.zeros(1 << 20, bool)  # by the hash's top bits; most runs of characters are no piece
        self.maybe[self.keys >> np.uint64(44)] = True

    @staticmethod
    def key(points: np.ndarray) -> int:
        h = 0
        for c in points.tolist():
            h = (h * int(_R) + c + 1) % (1 << 64)
        return int(mix(np.array([h + len(points) * 0xD6E8FEB86659FD93 & (1 << 64) - 1], np.uint64))[0])

    def find(self, raw: np.ndarray, length: int) -> np.ndarray:
        """Ids of the pieces with these polynomial hashes, -1 for none."""
        h = mix(raw + np.uint64(length * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
        if len(h) > 64:
            out = np.full(len(h), -1, np.int64)
            own = np.flatnonzero(self.maybe[h >> np.uint64(44)])
            h = h[own]
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            out[own] = np.where(self.keys[at] == h, self.ids[at], -1)
            return out
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.ids[at], -1)

    def edges(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words (rows of code points) the ids and scores [end - 1, length - 1, word]; no piece: -1 and -inf.

        A single character without a piece has id -2 and the penalised score for each of its bytes.
        """
        w, n = words.shape
        most = min(n, self.longest)
        pre = np.zeros((n + 1, w), np.uint64)
        for i in range(n):
            pre[i + 1] = pre[i] * _R + words[:, i].astype(np.uint64) + np.uint64(1)
        ids = np.full((n, most, w), -1, np.int64)
        power = np.uint64(1)
        for size in range(1, most + 1):
            power = np.uint64(int(power) * int(_R) % (1 << 64))
            raw = pre[size:] - pre[: n + 1 - size] * power
            ids[size - 1 :, size - 1] = self.find(raw.ravel(), size).reshape(raw.shape)
        score = np.where(ids >= 0, self.score[ids], -np.inf)
        none = ids[:, 0] < 0
        c = words.T
        size = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        ids[:, 0][none] = -2
        score[:, 0][none] = self.unknown * size[none]
        return ids, score

    def spell(self, point: int) -> list[int]:
        return [int(self.byte_id[b]) for b in chr(point).encode("utf-8", "replace")]

    def viterbi(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Best score, cost of the best detour (inf: none) and best ids (unsigned 32 bits) of each word."""
        w, n = words.shape
        ids, score = self.edges(words)
        most = ids.shape[1]
        ahead = np.full((n + 1, w), -np.inf)
        ahead[0] = 0
        back = np.zeros((n + 1, w), np.int64)
        for i in range(1, n + 1):
            k = min(i, most)
            cand = ahead[i - k : i][::-1] + score[i - 1, :k]  # by length 1 .. k
            back[i] = k - 1 - cand[::-1].argmax(axis=0)  # of equals the longest piece
            ahead[i] = np.take_along_axis(cand, back[i][None], 0)[0]
        behind = np.full((n + 1, w), -np.inf)
        behind[n] = 0
        on_path = np.zeros((n, most, w), bool)
        place, every = np.full(w, n), np.arange(w)
        chosen = np.full((n, w), -1, np.int64)
        for i in range(n, 0, -1):
            here = np.flatnonzero(place == i)
            size = back[i][here]
            on_path[i - 1, size, here] = True
            chosen[i - 1, here] = ids[i - 1, size, here]
            place[here] -= size + 1
            for k in range(1, min(i, most) + 1):
                np.maximum(behind[i - k], behind[i] + score[i - 1, k - 1], out=behind[i - k])
        detour = np.full(w, -np.inf)
        for i in range(1, n + 1):
            k = min(i, most)
            through = ahead[i - k : i][::-1] + score[i - 1, :k] + behind[i][None]
            through[on_path[i - 1, :k]] = -np.inf
            np.maximum(detour, through.max(axis=0), out=detour)
        best = ahead[n]
        with np.errstate(invalid="ignore"):
            cost = np.where(np.isfinite(detour), best - detour, np.inf)
        flat = chosen.T
        out: list[bytes] = []
        odd = (flat == -2).any(axis=1)
        used = flat >= 0
        ends = np.cumsum(used.sum(axis=1)) * 4
        raw = flat[used].astype("<u4").tobytes()
        begin = 0
        for r, end in enumerate(ends.tolist()):
            if odd[r]:
                own = [p for i in range(n) if flat[r, i] != -1 for p in (self.spell(int(words[r, i])) if flat[r, i] == -2 else [int(flat[r, i])])]
                out.append(np.array(own, "<u4").tobytes())
            else:
                out.append(raw[begin:end])
            begin = end
        return best, cost, out

    def best_paths(self, word: np.ndarray, n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of a word, by A-star from its end; the forward scores tell the exact rest.

        A state is a place and the piece that led there, with a pointer to the state before, and its cost is what it has
        lost against the best path. An edge off the best continuation stands for one more whole segmentation of that
        cost, so states that cost more than the n - 1 cheapest of these are not kept, and a place is left n times at most.
        """
        ids, score = (x[:, :, 0].tolist() for x in self.edges(word[None]))
        size, most = len(word), len(ids[0])
        ahead = [0.0] + [-np.inf] * size
        for i in range(1, size + 1):
            row = score[i - 1]
            ahead[i] = max(ahead[i - k] + row[k - 1] for k in range(1, min(i, most) + 1))
        states: list[tuple[int, int, int]] = [(-1, size, -1)]
        heap: list[tuple[float, int]] = [(0.0, 0)]
        cheapest: list[float] = []  # costs of the n - 1 cheapest other paths so far, negative
        found, left = [], Counter()
        while heap and len(found) < n:
            cost, at = heapq.heappop(heap)
            at = -at
            place = states[at][1]
            if place == 0:
                own: list[int] = []
                while at:
                    before, begin, piece = states[at]
                    own += self.spell(int(word[begin])) if piece == -2 else [piece]
                    at = before
                found.append((ahead[size] - cost, np.array(own, "<u4").tobytes()))
                continue
            left[place] += 1
            if left[place] > n:
                continue
            row, edges = score[place - 1], ids[place - 1]
            lost = [(ahead[place] - (ahead[place - k] + row[k - 1]), k) for k in range(1, min(place, most) + 1) if edges[k - 1] != -1 and ahead[place - k] > -np.inf]
            main = max(k for x, k in lost if x == 0)
            for x, k in lost:  # of equals the last one in, the longest piece, comes out first
                if k != main:
                    if len(cheapest) == n - 1 and (n == 1 or cost + x > -cheapest[0]):
                        continue
                    (heapq.heappush if len(cheapest) < n - 1 else heapq.heappushpop)(cheapest, -(cost + x))
                states.append((at, place - k, edges[k - 1]))
                heapq.heappush(heap, (cost + x, 1 - len(states)))
        return found

    def decode(self, ids) -> str:
        """The text of ids: bytes put together, U+2581 as a space, without the space before the text."""
        out = bytearray()
        for i in ids:
            out += bytes([self.byte_of[i]]) if i in self.byte_of else self.text[i].replace("▁", " ").encode()
        text = out.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def load(path: str) -> Pieces:
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the normalised rows, where words begin in them, and where rows begin in the words."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), "<u4")
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    begin = lead[offsets]
    full = np.flatnonzero(np.diff(begin))
    text = np.insert(points, begin[full], SPACE)  # a space before each text; an empty text has no pieces
    text[text == 0x20] = SPACE
    begin = begin + np.concatenate([[0], np.cumsum(np.diff(begin) > 0)])
    cut = np.zeros(len(text), bool)
    cut[begin[full]] = True
    if len(text) > 1:
        space, line = text == SPACE, text == 0x0A
        cut[1:] |= space[1:] & ~space[:-1] | line[1:] | line[:-1]
    starts = np.flatnonzero(cut)
    return text, starts, np.searchsorted(starts, begin)


def _distinct(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First occurrence of each distinct word, and of each word the number of its like."""
    n = len(text)
    ends = np.append(starts[1:], n)
    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), _R, np.uint64)]), dtype=np.uint64)
    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), _R_INV, np.uint64)]), dtype=np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    return first, back


def segment(pieces: Pieces, data: np.ndarray, offsets: np.ndarray, n: int) -> list[list[tuple[float, bytes]]]:
    """Of each row (UTF-8) its n best segmentations, or all if there are fewer: scores and ids."""
    text, starts, rows = words_of(data, offsets)
    out: list[list[tuple[float, bytes]]] = []
    if not len(starts):
        return [[(0.0, b"")] for _ in range(len(offsets) - 1)]
    ends = np.append(starts[1:], len(text))
    first, back = _distinct(text, starts)
    size = (ends - starts)[first]
    best, cost, ids = np.zeros(len(first)), np.full(len(first), np.inf), np.empty(len(first), object)
    for k in np.unique(size):
        own = np.flatnonzero(size == k)
        step = max(1, 400_000 // int(k * min(k, pieces.longest))) if k <= LONG_WORD else 1
        for i in range(0, len(own), step):
            part = own[i : i + step]
            words = text[starts[first[part]][:, None] + np.arange(k)]
            best[part], cost[part], got = pieces.viterbi(words)
            ids[part] = np.array([*got, None], object)[:-1]
    lists: dict[int, list[tuple[float, bytes]]] = {}
    for r in range(len(offsets) - 1):
        own = back[rows[r] : rows[r + 1]]
        total = float(best[own].sum())
        chosen = ids[own].tolist()
        kept: list[tuple[float, tuple]] = [(0.0, ())]
        if n > 1 and len(own):
            c = cost[own]
            near = np.argpartition(c, n - 2)[: n - 1] if len(c) > n - 1 else np.arange(len(c))
            bound = c[near].max()
            near = np.sort(near) if not np.isfinite(bound) else np.sort(np.concatenate([np.flatnonzero(c < bound), np.flatnonzero(c == bound)[: n - 1]]))
            for place in near[np.isfinite(c[near])].tolist():
                u = int(own[place])
                if u not in lists:
                    at = first[u]
                    lists[u] = pieces.best_paths(text[starts[at] : ends[at]], n)
                top = lists[u][0][0]
                more = [(a + (top - s), (*ch, (place, j)) if j else ch) for a, ch in kept for j, (s, _) in enumerate(lists[u])]
                kept = sorted(more)[:n]
        result = []
        for less, changes in kept:
            if not changes:
                result.append((total, b"".join(chosen)))
                continue
            other = chosen.copy()
            for place, j in changes:
                other[place] = lists[int(own[place])][j][1]
            result.append((total - less, b"".join(other)))
        out.append(result)
    return out


def encode_nbest(docs: DataFrame, model: str, n: int = 4) -> DataFrame:
    """(doc_id, rank, score, ids array<int>) of the n best segmentations of each (doc_id, text), whole texts.

    A null or empty text has one segmentation without pieces, score 0. Rows that repeat keep their rows. Time and
    memory grow as the length of a text, also where it is one word.
    """

    def run(batches):
        pieces = load(model)
        for b in batches:
            for first, end, data, offsets in chunks(b.column("text"), 1 << 22):
                got = segment(pieces, data, offsets, n)
                doc = b.column("doc_id").slice(first, end - first).to_pylist()
                rows = [(d, k + 1, s, i) for d, g in zip(doc, got, strict=True) for k, (s, i) in enumerate(g)]
                sizes = np.array([len(r[3]) // 4 for r in rows])
                flat = np.frombuffer(b"".join(r[3] for r in rows), "<i4")
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.float64()), lists], names=["doc_id", "rank", "score", "ids"])

    return _read(docs).mapInArrow(run, "doc_id long, rank int, score double, ids array<int>")


def decoded(table: list[bytes], ids: list[bytes], want: bytes) -> list[bool]:
    """Whether each of a row's segmentations spells the bytes; after the first only what differs from it is spelled."""
    spell = lambda x: b"".join(map(table.__getitem__, x.tolist()))
    best = np.frombuffer(ids[0], "<u4")
    out = [spell(best) == want]
    for raw in ids[1:]:
        own = np.frombuffer(raw, "<u4")
        n = min(len(own), len(best))
        differ = np.flatnonzero(own[:n] != best[:n])
        head = int(differ[0]) if len(differ) else n
        rest = n - head
        differ = np.flatnonzero(own[len(own) - rest :] != best[len(best) - rest :])
        tail = rest - 1 - int(differ[-1]) if len(differ) else rest
        alike = spell(own[head : len(own) - tail]) == spell(best[head : len(best) - tail])
        out.append(out[0] if alike else spell(own) == want)
    return out


def digest_nbest(docs: DataFrame, model: str, n: int = 4) -> DataFrame:
    """(doc_id, rank, score, n_pieces, ids_crc32, decoded) of the same; ``decoded``: the ids of this rank give the text
    back. A text that holds U+2581 itself reads as one with spaces, so none of its ranks do.
    """

    def run(batches):
        pieces = load(model)
        table = [bytes([pieces.byte_of[i]]) if i in pieces.byte_of else t.replace("▁", " ").encode() for i, t in enumerate(pieces.text)]
        for b in batches:
            for first, end, data, offsets in chunks(b.column("text"), 1 << 22):
                raw, at = data.tobytes(), offsets.tolist()
                doc = b.column("doc_id").slice(first, end - first).to_pylist()
                rows = []
                for r, got in enumerate(segment(pieces, data, offsets, n)):
                    want = raw[at[r] : at[r + 1]]
                    want = b" " + want if want else want
                    for k, ((score, ids), same) in enumerate(zip(got, decoded(table, [i for _, i in got], want), strict=True)):
                        rows.append((doc[r], k + 1, score, len(ids) // 4, zlib.crc32(ids), same))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["doc_id", "rank", "score", "n_pieces", "ids_crc32", "decoded"])

    return _read(docs).mapInArrow(run, "doc_id long, rank int, score double, n_pieces long, ids_crc32 long, decoded boolean")


def _read(docs: DataFrame) -> DataFrame:
    return whole_texts(docs)


def decode(rows: DataFrame, model: str) -> DataFrame:
    """(doc_id, rank, text) of rows (doc_id, rank, ids); null ids give a null text."""

    def run(batches):
        pieces = load(model)
        for b in batches:
            text = [None if i is None else pieces.decode(i) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rank"), pa.array(text, pa.string())], names=["doc_id", "rank", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("rank").cast("int").alias("rank"), "ids").mapInArrow(run, "doc_id long, rank int, text string")
