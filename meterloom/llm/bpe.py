"""Byte-level BPE encoding and decoding in NumPy: length-bucketed padded matrices, one merge for each row and round."""
from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flat
from .pretokens import Encoder, lists
from .staging import settle

#: Matches of more bytes are merged with a heap: a matrix would need as many rounds as bytes.
WIDEST = 512
NONE = np.int32(1 << 30)


class Pairs:
    """Hashed look-up of token pairs: open addressing over arrays. A pair's rank is the id of the joined token."""

    def __init__(self, tokens: list[bytes]):
        rank = {t: i for i, t in enumerate(tokens)}
        left, right, to = [], [], []
        for i, t in enumerate(tokens):
            for cut in range(1, len(t)):
                a, b = rank.get(t[:cut]), rank.get(t[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    to.append(i)
        self.bits = max(4, int(np.ceil(np.log2(2 * len(to) + 2))))
        self.key, self.to = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        key, value = self._key(np.array(left, np.int64), np.array(right, np.int64)), np.array(to, np.int32)
        at = self._home(key)
        while len(key):  # one of those that want a free cell gets it, the others go on
            free = self.key[at] < 0
            self.key[at[free]] = key[free]
            won = self.key[at] == key
            self.to[at[won]] = value[won]
            key, value, at = key[~won], value[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    @staticmethod
    def _key(a, b):
        return (a.astype(np.int64) << 32) | b

    def _home(self, key):
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = self._key(a, b)
        at, out = self._home(key), np.full(len(key), NONE, np.int32)
        todo = np.arange(len(key))
        while len(todo):
            have = self.key[at]
            hit = have == key[todo]
            out[todo[hit]] = self.to[at[hit]]
            on = ~hit & (have >= 0)
            todo, at = todo[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out


class Merger:
    def __init__(self, tokens: list[bytes]):
        self.tokens, self.rank = tokens, {t: i for i, t in enumerate(tokens)}
        self.pairs = Pairs(tokens)
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int32)

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        out: list = [[self.rank[p]] if p in self.rank else None for p in pieces]
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if out[i] is None:
                if len(p) > WIDEST:
                    out[i] = self._heap(p)
                else:
                    buckets.setdefault(1 << (len(p) - 1).bit_length(), []).append(i)
        for width, rows in buckets.items():
            for k in range(0, len(rows), 1 << 20 >> width.bit_length()):
                part = rows[k:k + (1 << 20 >> width.bit_length())]
                for i, ids in zip(part, self._bucket([pieces[i] for i in part], width)):
                    out[i] = ids
        return out

    def _bucket(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """Every row merges its leftmost pair of least rank, closes the gap and looks up the two new pairs; rows without
        a pair leave."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < size[:, None], self.byte[raw], -1)
        rank = np.full((len(pieces), width), NONE, np.int32)
        inside = np.arange(width - 1) < size[:, None] - 1
        rank[:, :-1][inside] = self.pairs.ranks(ids[:, :-1][inside], ids[:, 1:][inside])
        done: list = [None] * len(pieces)
        row = np.arange(len(pieces))
        while True:
            at = rank.argmin(1)
            best = rank[np.arange(len(row)), at]
            over = best == NONE
            for r, x, n in zip(row[over], ids[over].tolist(), size[over].tolist()):
                done[r] = x[:n]
            if over.all():
                return done
            live = ~over
            row, ids, rank, size, at, best = row[live], ids[live], rank[live], size[live] - 1, at[live], best[live]
            every = np.arange(len(row))
            ids[every, at] = best
            take = np.arange(ids.shape[1] - 1) + (np.arange(ids.shape[1] - 1) > at[:, None])
            ids = np.take_along_axis(ids, take, 1)
            rank = np.take_along_axis(rank, np.arange(rank.shape[1] - 1) + (np.arange(rank.shape[1] - 1) >= at[:, None]), 1)
            for left in (at - 1, at):
                rank_at = np.full(len(row), NONE, np.int32)
                ok = (left >= 0) & (left + 1 < size)
                rank_at[ok] = self.pairs.ranks(ids[every[ok], left[ok]], ids[every[ok], left[ok] + 1])
                here = (left >= 0) & (left < rank.shape[1])
                rank[every[here], left[here]] = rank_at[here]
            wide = int(size.max())
            ids, rank = ids[:, :wide], rank[:, :wide]

    def _heap(self, piece: bytes) -> list[int]:
        """The same merges in the same order for one long match."""
        n, rank, tokens = len(piece), self.rank, self.tokens
        ids, after, before = self.byte[np.frombuffer(piece, np.uint8)].tolist(), list(range(1, n + 1)), list(range(-1, n - 1))

        def pair(i):
            j = after[i]
            return rank.get(tokens[ids[i]] + tokens[ids[j]]) if j < n else None

        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            if ids[i] != a or (j := after[i]) >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (x := pair(k)) is not None:
                    heapq.heappush(heap, (x, k, ids[k], ids[after[k]]))
        return [x for x in ids if x >= 0]


@lru_cache(2)
def _tokens(content: bytes) -> list[bytes]:
    got = {int(r): base64.b64decode(t) for t, r in (line.split() for line in content.splitlines() if line)}
    return [got[i] for i in range(len(got))]


@lru_cache(2)
def encoder(content: bytes) -> Encoder:
    """One for each worker process."""
    merger = Merger(_tokens(content))
    return Encoder(lambda pieces: merger.encode([p.encode() for p in pieces]), most=150_000)


def rank_file(spark: SparkSession, path: str):
    """The rank file's bytes, read on the driver and broadcast: its size is the vocabulary's, not the data's."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, column: str = "text", to: str = "ids") -> DataFrame:
    """`docs` with the array of token ids of `column` as the last column `to` (a column of that name is replaced).

    Null and empty texts have no ids. Every match of the pre-tokenizer pattern is encoded by itself, special tokens are
    plain text. Each row is encoded by itself, so ids, order and repeats of rows don't matter.
    """
    settle(docs.sparkSession)
    shared = rank_file(docs.sparkSession, path)
    docs = docs.drop(to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for batch in batches:
            for part in _slices(batch, column):
                yield pa.RecordBatch.from_arrays([*part.columns, lists(*own.texts(*flat.texts(part, column)))], [*part.schema.names, to])
        flat.release()

    return docs.mapInArrow(run, docs.withColumn(to, F.lit(None).cast("array<int>")).schema)


def _slices(batch: pa.RecordBatch, column: str, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `size` bytes of text: ids take more room than texts."""
    _, off = flat.texts(batch, column)
    for i, j in flat.runs(off, size):
        yield batch.slice(i, j - i)


def decode(coded: DataFrame, path: str, column: str = "ids", to: str = "bytes") -> DataFrame:
    """`coded` with the bytes of the tokens in `column` as the last column `to`; null ids give no bytes."""
    shared = rank_file(coded.sparkSession, path)
    coded = coded.drop(to)

    def run(batches):
        tokens = _tokens(shared.value)
        text = np.frombuffer(b"".join(tokens), np.uint8)
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        first = np.cumsum(size) - size
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(column))
            out = []
            for row in range(len(col)):
                ids = col[row].values
                ids = ids.to_numpy(zero_copy_only=False).astype(np.int64) if ids is not None else np.empty(0, np.int64)
                out.append(text[flat.ragged(first[ids], size[ids])].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, to])

    return coded.mapInArrow(run, coded.withColumn(to, F.lit(None).cast("binary")).schema)
