"""NumPy kernels over a whole Arrow column of texts: words, lines, windows and their 64-bit hashes.

Texts stay in the column's own UTF-8 buffer, so no text is cut into Python strings. A byte range is hashed in lanes of
eight bytes: each lane is scrambled together with a constant of its place and the lanes are summed (tabulation hashing),
so equal hashes of different ranges are chance, not structure, as they are for a polynomial modulo 2^64. Windows of words
are hashed by doubling. Null texts count as empty.
Kernels work on runs of whole documents of about a quarter of a megabyte; one longer document is a run of its own.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
WS = np.zeros(256, bool)
WS[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_STEP, _LEN = U(0xD1342543DE82EF95), U(0xA0761D6478BD642F)
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
RUN, BLOCK = 1 << 18, 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def tag(k: int) -> np.uint64:
    """A constant for the small number k."""
    return U(k * int(_LEN) & (1 << 64) - 1)


def places(n: int, seed: int = 0) -> np.ndarray:
    """A constant for each of the places 0..n-1."""
    return mix((np.arange(n, dtype=U) + U(1)) * _STEP ^ mix(np.array([seed], U)))


def texts(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the offsets of its rows."""
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), off


def release() -> None:
    """At the end of a task: what Arrow keeps of freed batches goes back, as workers live on."""
    pa.default_memory_pool().release_unused()


def runs(off: np.ndarray, size: int = RUN) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about `size` bytes."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, j
        i = j


def _summed(x: np.ndarray, size: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Hash of each row from the scrambled values of its `count` items, which follow each other in `x`."""
    c = np.zeros(len(x) + 1, U)
    np.cumsum(x, out=c[1:])
    to = np.cumsum(count)
    return mix((c[to] - c[to - count]) ^ size.astype(U) * _LEN)


def range_hashes(b: np.ndarray, s: np.ndarray, e: np.ndarray, table: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
    """Hash of every byte range [s, e), bytes translated by `table` first. The ranges may not overlap much, as each is read."""
    if not len(s):
        return np.empty(0, U)
    size = e - s
    count = (size + 7) >> 3
    wide = np.concatenate([b if table is None else table[b], np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(wide) - 7,), "<u8", wide, strides=(1,))
    nth = ragged(np.zeros(len(s), np.int64), count)
    at = np.repeat(s, count)
    at += nth << 3
    x = lanes[at].astype(U)
    x &= _LOW[np.minimum(np.repeat(e, count) - at, 8)]
    x ^= places(int(count.max()) if len(count) else 0, seed)[nth]
    return _summed(mix(x), size, count)


def distinct_ranges(b: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each byte range, equal for equal bytes, and the first range of each number. Equal hashes are compared
    on the bytes; should ranges of one hash differ, the next seed is taken."""
    seed = 0
    while True:
        code, keys = pd.factorize(range_hashes(b, s, e, seed=seed))
        first = np.empty(len(keys), np.int64)
        first[code[::-1]] = np.arange(len(s) - 1, -1, -1)
        model = first[code]
        size = e - s
        if np.array_equal(size, size[model]) and np.array_equal(b[ragged(s, size)], b[ragged(s[model], size)]):
            return code, first
        seed += 1


def sequence_hashes(h: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Hash of each sequence h[o[i]:o[i + 1]] of hashes."""
    count = np.diff(o)
    nth = ragged(np.zeros(len(count), np.int64), count)
    return _summed(mix(h[o[0]:o[-1]] ^ places(int(count.max()) if len(count) else 0, 1)[nth]), count, count)


def words(b: np.ndarray, o: np.ndarray, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (bytes but ASCII white space) of the documents at offsets `o` of `b`: starts, ends, hashes, and the
    documents' offsets in the list of words."""
    n = len(b)
    if n > BLOCK and len(o) == 2:
        return _long(b, table)
    gap = WS[b]
    first = ~gap
    last = first.copy()
    edge = np.zeros(n + 1, bool)
    edge[o] = True
    first[1:] &= gap[:-1] | edge[1:n]
    last[:-1] &= gap[1:] | edge[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, range_hashes(b, s, e, table), np.searchsorted(s, o)


def _long(b, table):
    """One long document, in blocks cut at white space: what is kept grows with its words, not with its bytes."""
    parts, at, n = [], 0, len(b)
    while at < n:
        to = min(n, at + BLOCK)
        while to < n:
            gaps = np.flatnonzero(WS[b[to:to + BLOCK]])
            if len(gaps):
                to += int(gaps[0]) + 1
                break
            to = min(n, to + BLOCK)
        s, e, h, _ = words(b[at:to], np.array([0, 0, to - at]), table)
        parts.append((s + at, e + at, h))
        at = to
    s, e, h = (np.concatenate(x) for x in zip(*parts))
    return s, e, h, np.array([0, len(s)])


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two sequences, one after the other."""
    return mix(left * _STEP + right)


def windows(h: np.ndarray, wo: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Every k consecutive words of one document: position of the first word, hash of the sequence."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, U)
    v, done, power, size = None, 0, h, 1
    while True:
        if k & size:
            v = power[:n] if v is None else joined(v, power[done:done + n])
            done += size
        if 2 * size > k:
            break
        power = joined(power[:-size], power[size:])
        size *= 2
    doc = np.repeat(np.arange(len(wo) - 1), np.diff(wo))
    at = np.flatnonzero(doc[:n] == doc[k - 1:])
    return at, mix(v[at] ^ tag(k))


def shingles(h: np.ndarray, wo: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As windows(), but a document of fewer than k words has its whole sequence as one: document, hash."""
    at, v = windows(h, wo, k)
    doc = np.repeat(np.arange(len(wo) - 1), np.diff(wo))
    short = np.flatnonzero((np.diff(wo) > 0) & (np.diff(wo) < k))
    if not len(short):
        return doc[at], v
    size = np.diff(wo)[short]
    own = sequence_hashes(h[ragged(wo[short], size)], np.r_[0, np.cumsum(size)])
    d = np.concatenate([doc[at], short])
    order = np.argsort(d, kind="stable")
    return d[order], np.concatenate([v, own])[order]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indexes start..start+count of every row, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    out = np.ones(total, np.int64)
    has = counts > 0
    s, c = starts[has], counts[has]
    heads = np.cumsum(c)[:-1]
    out[0] = s[0]
    out[heads] = s[1:] - s[:-1] - c[:-1] + 1
    return np.cumsum(out)
