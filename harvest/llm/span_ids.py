"""Token ids of whole texts by spans: each distinct span is encoded once, and numpy puts the ids together.

Both tokenizers here cut a text at places that white space fixes, so the ids of a text are the ids of its spans in
a row. Spans are told apart by 64-bit hashes; a direct-mapped table leads to their ids. Rows in which a span may
depend on its neighbours are encoded as wholes.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np

from .common import span_hashes, word_spans

#: Distinct spans that a worker keeps (others are encoded again in each chunk), and the longest of them.
CACHED, LONGEST = 700_000, 64
_BITS = 20


class Spans:
    """Ids of spans of bytes; ``encode`` gives the ids of distinct ones as unsigned 32-bit numbers."""

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], fold: bool, cached: int = CACHED):
        self.encode, self.fold, self.room = encode, fold, cached
        self.keys = np.zeros((2, 1 << _BITS), np.uint64)
        self.where = np.zeros((2, 1 << _BITS), np.int64)  # place in the pool and, in 16 bits, size
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    @staticmethod
    def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (h >> np.uint64(64 - _BITS)).astype(np.int64), (h & np.uint64((1 << _BITS) - 1)).astype(np.int64)

    def _keep(self, h: np.ndarray, where: np.ndarray) -> None:
        """A hash goes to a free slot in one of the two tables, and stays there; one that finds none is not kept."""
        for t in (0, 1):
            slot = self._slots(h)[t]
            free = np.flatnonzero(self.keys[t, slot] == 0)
            one = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[t, slot[one]], self.where[t, slot[one]] = h[one], where[one]
            left = np.ones(len(h), bool)
            left[one] = False
            h, where = h[left], where[left]

    def _encode(self, h: np.ndarray, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places in the pool and sizes of the ids of new spans; the kept ones' ids come first in the pool."""
        short = np.fromiter((len(x) <= LONGEST for x in spans), bool, len(spans))
        keep = np.flatnonzero(short)[: self.room]
        first = np.zeros(len(spans), bool)
        first[keep] = True
        order = np.concatenate([keep, np.flatnonzero(~first)])
        got = self.encode([spans[i] for i in order.tolist()])
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
        begins = self.used + np.cumsum(sizes) - sizes
        end = self.used + int(sizes.sum())
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(end, np.uint32)])
        self.pool[self.used : end] = np.frombuffer(b"".join(got), "<u4")
        n = len(keep)
        self._keep(h[keep], begins[:n] << 16 | sizes[:n])
        self.room -= n
        self.used += int(sizes[:n].sum())
        place, size = np.empty(len(spans), np.int64), np.empty(len(spans), np.int64)
        place[order], size[order] = begins, sizes
        return place, size

    def find(self, data: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each span has, and where they are in the pool until the next call."""
        h = span_hashes(data, starts, ends, self.fold)
        place, size = np.zeros(len(h), np.int64), np.full(len(h), -1, np.int64)
        for t, slot in enumerate(self._slots(h)):
            there = np.flatnonzero(self.keys[t, slot] == h)
            where = self.where[t, slot[there]]
            place[there], size[there] = where >> 16, where & 0xFFFF
        missing = np.flatnonzero(size < 0)
        if len(missing):
            new, first, back = np.unique(h[missing], return_index=True, return_inverse=True)
            at = missing[first]
            a, n = self._encode(new, [raw[i:j] for i, j in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            place[missing], size[missing] = a[back], n[back]
        return size, place

    def ids(self, size: np.ndarray, place: np.ndarray) -> np.ndarray:
        """All ids in a row."""
        return self.pool[np.repeat(place - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def _split(starts: np.ndarray, cut: np.ndarray, ends: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans, each followed by what is cut off its end if anything is."""
    marked = (cut < ends).astype(np.int64)
    at = np.arange(len(starts)) + np.cumsum(marked) - marked
    a, b, of = (np.empty(len(starts) + int(marked.sum()), np.int64) for _ in range(3))
    a[at], b[at], of[at] = starts, cut, row
    tail = np.flatnonzero(marked)
    a[at[tail] + 1], b[at[tail] + 1], of[at[tail] + 1] = cut[tail], ends[tail], row[tail]
    return a, b, of


def _letters() -> np.ndarray:
    """Code points below 2**16 that are letters and, normalised and in lower case, one letter."""
    low = [unicodedata.normalize("NFC", chr(c)).lower() for c in range(1 << 16)]
    return np.array([chr(c).isalpha() and len(x) == 1 and x.isalpha() for c, x in enumerate(low)])


_LETTER: list[np.ndarray] = []
_MARK = np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)])


def _stems(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the run of ASCII marks at a word's end begins, if it comes after a letter (else the word's end)."""
    if not _LETTER:
        _LETTER.append(_letters())
    cut = ends.copy()
    todo = np.arange(len(ends))
    while len(todo := todo[(cut[todo] > starts[todo]) & _MARK[data[np.maximum(cut[todo] - 1, 0)]]]):
        cut[todo] -= 1
    own = np.flatnonzero((cut < ends) & (cut > starts))
    out = ends.copy()
    last = data[cut[own] - 1].astype(np.int64)
    out[own[last < 0x80]] = cut[own[last < 0x80]]  # no mark and no white space, so a digit, a letter or a control character
    digit = own[(last < 0x80) & ~((last | 0x20 >= 97) & (last | 0x20 <= 122))]
    out[digit] = ends[digit]
    for width, lead in ((2, 0xC0), (3, 0xE0)):
        at = own[(data[cut[own] - 1] >= 0x80) & (cut[own] - starts[own] >= width)]
        at = at[data[cut[at] - width] & (0xF0 if width == 3 else 0xE0) == lead]
        b = [data[cut[at] - width + k].astype(np.int64) for k in range(width)]
        point = (b[0] & 0x1F) << 6 | b[1] & 0x3F if width == 2 else (b[0] & 0x0F) << 12 | (b[1] & 0x3F) << 6 | b[2] & 0x3F
        at = at[_LETTER[0][point]]
        out[at] = cut[at]
    return out


def _put_together(n: int, size: np.ndarray, row: np.ndarray, flat: np.ndarray, whole: dict[int, bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, each with ``end_id`` last, and where rows begin. ``whole`` rows have no spans."""
    per = np.bincount(row, size, n).astype(np.int64) if len(row) else np.zeros(n, np.int64)
    other = {r: np.frombuffer(x, "<u4") for r, x in whole.items()}
    per[list(other)] = [len(x) for x in other.values()]
    begin = np.concatenate([[0], np.cumsum(per + 1)])
    out = np.full(begin[-1], end_id, np.uint32)
    spanned = np.ones(n, bool)
    spanned[list(other)] = False
    kept = np.flatnonzero(spanned)
    to = np.repeat(begin[kept] - (np.cumsum(per[kept]) - per[kept]), per[kept]) + np.arange(len(flat))
    out[to] = flat
    for r, x in other.items():
        out[begin[r] : begin[r] + len(x)] = x
    return out, begin


class WordIds:
    """A tokenizer of the ``tokenizers`` library that folds case, drops white space and never joins across it."""

    def __init__(self, path: str, cached: int = CACHED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[n for t, n in vocabulary.items() if t.endswith("</w>")]] = True
        #: Added tokens are found in texts as they stand, across any span.
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spans = Spans(self._encode, True, cached)

    def _plain(self, texts: list[str]) -> list[bytes]:
        got = []
        for i in range(0, len(texts), 4000):
            got += [array("I", g.ids).tobytes() for g in self.tokenizer.encode_batch_fast(texts[i : i + 4000], add_special_tokens=False)]
        return got

    def _encode(self, spans: list[bytes]) -> list[bytes]:
        """Words of letters in one call, cut at the tokens that end a piece, unless one of them has several pieces."""
        text, out = [w.decode() for w in spans], [b""] * len(spans)
        words = [k for k, w in enumerate(text) if w.isalpha()]
        rest = [k for k, w in enumerate(text) if not w.isalpha()]
        for i in range(0, len(words), 4000):
            own = words[i : i + 4000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([text[k] for k in own])], add_special_tokens=False)[0].ids, "<u4")
            cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            if len(cuts) != len(own) + 1:
                rest += own
                continue
            whole = ids.tobytes()
            for k, a, b in zip(own, cuts, cuts[1:], strict=False):
                out[k] = whole[a:b]
        for k, x in zip(rest, self._plain([text[k] for k in rest]), strict=True):
            out[k] = x
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows (UTF-8), each with ``end_id`` last, and where rows begin."""
        raw, n = data.tobytes(), len(offsets) - 1
        odd = [r for r in range(n) if any(a in raw[offsets[r] : offsets[r + 1]] for a in self.added)] if any(a in raw for a in self.added) else []
        whole = dict(zip(odd, self._plain([raw[offsets[r] : offsets[r + 1]].decode() for r in odd]), strict=True))
        starts, ends, rows = word_spans(data, offsets)
        row = np.repeat(np.arange(n), np.diff(rows))
        if odd:
            keep = ~np.isin(row, odd)
            starts, ends, row = starts[keep], ends[keep], row[keep]
        a, b, of = _split(starts, _stems(data, starts, ends), ends, row)
        size, place = self.spans.find(data, raw, a, b)
        return _put_together(n, size, of, self.spans.ids(size, place), whole, end_id)


class ByteIds:
    """A byte-level BPE of ``tiktoken`` whose pattern takes one space before a word and white space by itself."""

    def __init__(self, path: str, pattern: str, cached: int = CACHED):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.spans = Spans(self._encode, False, cached)

    def _encode(self, spans: list[bytes]) -> list[bytes]:
        encode = self.encoder.encode_ordinary
        return [array("I", encode(x.decode())).tobytes() for x in spans]

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """How many ids each row has, without one for its end."""
        n, whole, size, _, of = self._found(data, offsets)
        out = np.bincount(of, size, n).astype(np.int64) if len(of) else np.zeros(n, np.int64)
        out[list(whole)] = [len(x) // 4 for x in whole.values()]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows (UTF-8), each with ``end_id`` last, and where rows begin."""
        n, whole, size, place, of = self._found(data, offsets)
        return _put_together(n, size, of, self.spans.ids(size, place), whole, end_id)

    def _found(self, data: np.ndarray, offsets: np.ndarray) -> tuple[int, dict[int, bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Rows, ids of rows encoded as wholes, and of all other rows' spans the sizes, places and rows."""
        raw, n = data.tobytes(), len(offsets) - 1
        odd = np.unique(np.searchsorted(offsets, _wide_spaces(data), "right") - 1).tolist()
        whole = dict(zip(odd, self._encode([raw[offsets[r] : offsets[r + 1]] for r in odd]), strict=True))
        starts, ends, rows = word_spans(data, offsets)
        row = np.repeat(np.arange(n), np.diff(rows))
        # a word takes the space before it; of the white space left before, all but the last character are one span, which
        # has that character too where a space or nothing comes after it
        before = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        before = np.maximum(before, offsets[row])
        spaced = (starts > before) & (data[np.maximum(starts - 1, 0)] == 0x20)
        gap = starts - spaced  # end of the white space that is left
        last = np.where(spaced | (gap == before), gap, gap - 1)  # where its last character is a span of its own
        full = np.flatnonzero(np.diff(offsets))
        tail_at, some = offsets[full].copy(), rows[full + 1] > rows[full]  # white space after a row's last word
        tail_at[some] = ends[rows[full + 1][some] - 1]
        cut = _stems(data, starts, ends)
        a = np.concatenate([before, last, gap, cut, tail_at])
        b = np.concatenate([last, gap, cut, ends, offsets[full + 1]])
        of = np.concatenate([row, row, row, row, full])
        keep = b > a
        if odd:
            keep &= ~np.isin(of, odd)
        a, b, of = a[keep], b[keep], of[keep]
        order = np.argsort(a, kind="stable")
        a, b, of = a[order], b[order], of[order]
        return n, whole, *self.spans.find(data, raw, a, b), of


def _wide_spaces(data: np.ndarray) -> np.ndarray:
    """Where white space beyond ASCII begins in UTF-8 bytes."""
    at = np.flatnonzero((data == 0xC2) | (data >= 0xE1) & (data <= 0xE3))
    b = np.zeros(len(data) + 2, np.uint8)
    b[: len(data)] = data
    x, y, z = b[at], b[at + 1], b[at + 2]
    wide = (x == 0xC2) & ((y == 0x85) | (y == 0xA0)) | (x == 0xE1) & (y == 0x9A) & (z == 0x80) | (x == 0xE3) & (y == 0x80) & (z == 0x80)
    wide |= (x == 0xE2) & ((y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF)) | (y == 0x81) & (z == 0x9F))
    return at[wide]
