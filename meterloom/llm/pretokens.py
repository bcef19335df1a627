"""The public byte-level pre-tokenizer pattern as array operations, and a cache of what its matches encode to.

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

A match is a run of letters, digits or other signs, with one space before it; white space before a word gives up its last
character, which joins the word if it is a space; a contraction is cut where a match begins with an apostrophe.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa

from . import flat

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: White_Space of Unicode. Fixed values.
WHITE = [9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
RUN = 1 << 19


@lru_cache(1)
def kinds() -> np.ndarray:
    """SPACE, LETTER, NUMBER or OTHER for each code point."""
    import regex

    points = np.r_[0:0xD800, 0xE000:0x110000]
    every = points.astype("<u4").tobytes().decode("utf-32-le")
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, what in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(what, every):
            out[points[m.start():m.end()]] = kind
    out[WHITE] = SPACE
    return out


def starts(cp: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Where matches start in the code points of the documents at offsets `o`."""
    n = len(cp)
    if not n:
        return np.empty(0, np.int64)
    kind = kinds()[cp]
    fresh = np.zeros(n + 1, bool)
    fresh[o] = True
    b = fresh[:n].copy()
    b[1:] |= kind[1:] != kind[:-1]
    gives = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~fresh[1:n]  # last white space before a word
    b[:-1] |= gives
    b[1:] &= ~(gives & (cp[:-1] == 32))
    q = np.flatnonzero(b & (cp == 39))
    q = q[q + 1 < n]
    q = q[(kind[q + 1] == LETTER) & ~fresh[q + 1]]
    if len(q):
        x = cp[q + 1]
        y = np.where((q + 2 < n) & ~fresh[np.minimum(q + 2, n)], cp[np.minimum(q + 2, n - 1)], 0)
        two = ((x == 114) & (y == 101)) | ((x == 118) & (y == 101)) | ((x == 108) & (y == 108))
        one = np.isin(x, [115, 116, 109, 100])
        q, size = q[one | two], np.where(one, 1, 2)[one | two]
        b[q + 1] = False
        after = q + 1 + size
        b[after[after < n]] = True
    return np.flatnonzero(b)


class Encoder:
    """Ids of matches, each distinct match encoded once while it is in the cache.

    encode: list of str -> list of int sequences. The cache is emptied when it holds `most` matches.
    """

    def __init__(self, encode: Callable[[list[str]], list], most: int = 400_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids, self.first, self.count = np.empty(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def _room(self, name: str, need: int) -> None:
        have = getattr(self, name)
        if len(have) < need:
            setattr(self, name, np.concatenate([have, np.zeros(max(need, 2 * len(have)) - len(have), have.dtype)]))

    def slots(self, known: list[str]) -> np.ndarray:
        if len(self.slot) + len(known) > self.most:
            self.clear()
        out = [self.slot.get(k, -1) for k in known]
        new = [i for i, s in enumerate(out) if s < 0]
        if new:
            got = self.encode([known[i] for i in new])
            size = np.fromiter(map(len, got), np.int64, len(got))
            at, m = self.used, len(self.slot)
            self._room("ids", at + int(size.sum()))
            self._room("first", m + len(new))
            self._room("count", m + len(new))
            self.ids[at:at + int(size.sum())] = [x for row in got for x in row]
            self.first[m:m + len(new)] = at + np.cumsum(size) - size
            self.count[m:m + len(new)] = size
            self.used += int(size.sum())
            for s, i in enumerate(new, m):
                self.slot[known[i]] = out[i] = s
        return np.array(out, np.int64)

    def texts(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, one after the other, and how many each has."""
        ids, counts = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for i, j in flat.runs(off, RUN):
            if j == i + 1 and off[j] - off[i] > 2 * RUN:
                got = [self._run(data[p:q], np.array([0, q - p])) for p, q in _pieces(data, int(off[i]), int(off[j]))]
                ids += [x for x, _ in got]
                counts.append(np.array([sum(int(c[0]) for _, c in got)]))
            else:
                x, c = self._run(data[off[i]:off[j]], off[i:j + 1] - off[i])
                ids.append(x)
                counts.append(c)
        return np.concatenate(ids), np.concatenate(counts)

    def _run(self, b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(b):
            return np.empty(0, np.int32), np.zeros(len(o) - 1, np.int64)
        whole = b.tobytes().decode()
        cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        lead = np.zeros(len(b) + 1, np.int64)
        np.cumsum((b & 0xC0) != 0x80, out=lead[1:])
        co = lead[o]
        s = starts(cp, co)
        e = np.r_[s[1:], len(cp)]
        byte = np.r_[np.flatnonzero((b & 0xC0) != 0x80), len(b)]
        code, first = flat.distinct_ranges(b, byte[s], byte[e])
        slot = self.slots([whole[p:q] for p, q in zip(s[first].tolist(), e[first].tolist())])[code]
        size = self.count[slot]
        total = np.zeros(len(s) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        return self.ids[flat.ragged(self.first[slot], size)], np.diff(total[np.searchsorted(s, co)])


def _pieces(data: np.ndarray, start: int, end: int):
    """Parts of a long text, cut where a white space follows another character: a match never goes on there."""
    at = start
    while at < end:
        to = at + RUN
        while to < end:
            near = flat.WS[data[to - 1:min(end, to + RUN)]]
            cut = np.flatnonzero(near[1:] & ~near[:-1] & (data[to - 1:min(end, to + RUN) - 1] < 128))
            if len(cut):
                to += int(cut[0])
                break
            to += RUN
        to = min(to, end)
        yield at, to
        at = to


def lists(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids))
