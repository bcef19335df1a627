"""Numbers of greedy word pieces with a linear longest-match automaton (Song et al., EMNLP 2021).

The vocabulary is a trie. Each node has a failure link and the number of pieces that are complete when the link is
followed, so a word is read once, left to right, and only counts are added; no piece is built. All distinct words of a
batch are read at the same time, one byte of each in a step.
"""
from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flat
from .staging import settle

DEAD = -1
#: Fewer words than these are read to their ends one by one: a step of the lockstep costs as much for one as for all.
FEW = 64


class Automaton:
    """first: pieces that begin a word; later: pieces inside one. Node 0 is the root for first, node 1 for later ones."""

    def __init__(self, first: set[bytes], later: set[bytes]):
        child: list[dict[int, int]] = [{}, {}]
        ends: list[bool] = [False, False]
        for root, pieces in ((0, first), (1, later)):
            for p in sorted(pieces):
                at = root
                for c in p:
                    if c not in child[at]:
                        child[at][c] = len(child)
                        child.append({})
                        ends.append(False)
                    at = child[at][c]
                ends[at] = at > 1
        fail, pops = [DEAD] * len(child), [0] * len(child)
        todo = deque((0, 1))
        while todo:
            at = todo.popleft()
            for c, to in child[at].items():
                if ends[to]:
                    fail[to], pops[to] = 1, 1
                else:
                    z, n = fail[at], pops[at]
                    while z != DEAD and c not in child[z]:
                        n, z = n + pops[z], fail[z]
                    if z != DEAD:
                        fail[to], pops[to] = child[z][c], n
                todo.append(to)
        edges = sorted((at << 8 | c, to) for at, x in enumerate(child) for c, to in x.items())
        self.edge, self.to = np.array([e for e, _ in edges], np.int64), np.array([t for _, t in edges], np.int64)
        self.fail, self.pops = np.array(fail, np.int64), np.array(pops, np.int64)
        self.alone: tuple[dict[int, int], list[int], list[int]] | None = None

    def step(self, at: np.ndarray, c: np.ndarray) -> np.ndarray:
        key = at << 8 | c
        i = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
        return np.where(self.edge[i] == key, self.to[i], DEAD) if len(self.edge) else np.full(len(at), DEAD)

    def counts(self, b: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Pieces of every word [s, e) of `b`; 0 for a word that pieces don't cover."""
        out, live = np.zeros(len(s), np.int64), np.arange(len(s))
        at, pos, n = np.zeros(len(s), np.int64), s.astype(np.int64), np.zeros(len(s), np.int64)
        while len(live) >= FEW:
            more = pos < e[live]
            go = np.full(len(live), DEAD)
            go[more] = self.step(at[more], b[pos[more]].astype(np.int64))
            moved = go != DEAD
            done = ~more & (at == 1)
            out[live[done]] = n[done]
            back = ~moved & ~done
            n[back] += self.pops[at[back]]
            at = np.where(moved, go, np.where(back, self.fail[at], at))
            pos = pos + moved
            keep = ~done & (at != DEAD)
            live, at, pos, n = live[keep], at[keep], pos[keep], n[keep]
        for i, *state in zip(live.tolist(), at.tolist(), pos.tolist(), n.tolist()):
            out[i] = self.rest(b[state[1]:e[i]].tobytes(), state[0], state[2])
        return out

    def rest(self, word: bytes, at: int, n: int) -> int:
        """Pieces of a word of which `word` is still to be read, from node `at` and with `n` pieces so far."""
        if self.alone is None:
            self.alone = dict(zip(self.edge.tolist(), self.to.tolist())), self.fail.tolist(), self.pops.tolist()
        edges, fail, pops = self.alone
        for c in word:
            while (to := edges.get(at << 8 | c)) is None:
                n, at = n + pops[at], fail[at]
                if at == DEAD:
                    return 0
            at = to
        while at not in (1, DEAD):
            n, at = n + pops[at], fail[at]
        return n if at == 1 else 0


@lru_cache(2)
def _automaton(first: tuple[bytes, ...], later: tuple[bytes, ...]) -> Automaton:
    return Automaton(set(first), set(later))


def vocabulary(path: str, mark: bytes = b" ") -> tuple[tuple[bytes, ...], tuple[bytes, ...]]:
    """Word pieces of a public rank file: tokens that begin with a space begin a word, all others stand inside one."""
    import base64

    with open(path, "rb") as f:
        tokens = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    inside = [t for t in tokens if not flat.WS[np.frombuffer(t, np.uint8)].any()]
    return tuple(t[1:] for t in tokens if t[:1] == mark and len(t) > 1 and not flat.WS[np.frombuffer(t[1:], np.uint8)].any()), tuple(inside)


def pieces(docs: DataFrame, path: str, longest: int | None = None) -> DataFrame:
    """doc_id, n_words, n_pieces, n_unknown of every row of `docs` (doc_id, text; other columns are not looked at).

    Words are what ASCII white space parts. A word that pieces don't cover, or of more than `longest` bytes (None: no
    limit), counts as one unknown piece, as word-piece tokenizers do. Null, empty and blank texts have none. Rows are independent of each other.
    """
    spark: SparkSession = docs.sparkSession
    settle(spark)
    shared = spark.sparkContext.broadcast(vocabulary(path))  # as large as the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _automaton(*shared.value)
        for batch in batches:
            data, off = flat.texts(batch)
            total = []
            for i, j in flat.runs(off):
                b, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
                s, e, h, wo = flat.words(b, o)
                code, keys = pd.factorize(h)
                one = np.empty(len(keys), np.int64)
                one[code[::-1]] = np.arange(len(s) - 1, -1, -1)
                count = np.zeros(len(keys), np.int64)
                short = e[one] - s[one] <= (len(b) if longest is None else longest)
                count[short] = own.counts(b, s[one][short], e[one][short])
                each = count[code]
                sums = np.c_[np.r_[0, np.cumsum(np.maximum(each, 1))][wo], np.r_[0, np.cumsum(each == 0)][wo]]
                total.append(np.c_[np.diff(wo), np.diff(sums, axis=0)])
            table = np.concatenate([*total, np.empty((0, 3), np.int64)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(table[:, k]) for k in range(3))], ["doc_id", "n_words", "n_pieces", "n_unknown"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_pieces long, n_unknown long")
