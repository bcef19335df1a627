"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items fall into classes by size (powers of two of their shingle sets). For a class with at most U shingles every document
is read as windows of 2U shingles that start at each multiple of U, so an item lies inside one window and its Jaccard
similarity to that window is bounded from below however long the document is. Each of HASHES minimum hashes is a band of
its own. Minima of longer windows come from those of shorter ones. Items of at most SHORT shingles, for which few minima
would have to hit, are looked for by every one of their shingles; an item of fewer words than a shingle has is one shingle of
its own length. The signatures of the items travel to the scan as a
bitmap of fixed size, which only thins out what the exact join on signatures receives.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .staging import matched, settle, written

U = np.uint64
HASHES = 48
#: Bits of the bitmap, as a power of two: 4 MB.
BITMAP = 25
#: Items of at most so many distinct shingles are sought by all of them; classes begin above.
SHORT = 8
LEAST = 4
_SEEDS = flat.mix(np.arange(1, HASHES + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def size_class(n: np.ndarray) -> np.ndarray:
    """Smallest c >= LEAST with n <= 2^c."""
    return np.maximum(LEAST, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))


def _signature(minima: np.ndarray, c: int, j: int) -> np.ndarray:
    return flat.mix(minima ^ (U(c) << U(32)) + flat.tag(j + 1))


def _whole(shingle: np.ndarray, length: int) -> np.ndarray:
    """Signature of a short item's shingle of `length` words."""
    return flat.mix(shingle ^ flat.tag(1000 + length))


def _batch_words(batch):
    data, off = flat.texts(batch)
    for i, j in flat.runs(off):
        _, _, h, wo = flat.words(data[off[i]:off[j]], off[i:j + 1] - off[i], flat.LOWER)
        yield i, h, wo


def _items(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, item, size, sig = batch.column(0).to_pylist(), [], [], []
            for i, h, wo in _batch_words(batch):
                for d, n in enumerate(np.diff(wo)):
                    own = min(k, int(n))
                    u = np.unique(flat.windows(h[wo[d]:wo[d + 1]], np.array([0, n]), own)[1]) if n else []
                    if 0 < len(u) <= SHORT:
                        item += [ids[i + d]] * len(u)
                        size += [-own] * len(u)  # below zero: a short item, by its words in a shingle
                        sig.append(_whole(u, own))
                    elif len(u):
                        c = int(size_class(np.array([len(u)]))[0])
                        item += [ids[i + d]] * HASHES
                        size += [c] * HASHES
                        sig.append(np.array([_signature((u * s).min(keepdims=True), c, j)[0] for j, s in enumerate(_SEEDS)], U))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(size, pa.int32()), pa.array(flat.signed(np.concatenate([*sig, np.empty(0, U)])))], ["item_id", "size_class", "sig"])

    return run


def _heads(at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of blocks of `step` in each range at[i]..at[i+1], and the blocks' offsets by range."""
    count = -(-np.diff(at) // step)
    block = np.r_[0, np.cumsum(count)]
    return np.repeat(at[:-1], count) + (np.arange(block[-1]) - np.repeat(block[:-1], count)) * step, block


def _search(k: int, classes: list[int], bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint64)
        shift, low = U(64 - BITMAP), U(63)
        large = [c for c in classes if c > 0]
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            docs, sigs = [], []
            for i, h, wo in _batch_words(batch):
                word_doc = np.repeat(np.arange(len(wo) - 1), np.diff(wo))
                for own in (-c for c in classes if c < 0):
                    first, v = flat.windows(h, wo, own)
                    sig = _whole(v, own)
                    cell = sig >> shift
                    hit = np.flatnonzero((bits[cell >> U(6)] >> (cell & low)) & U(1))
                    if len(hit):
                        docs.append(ids[i + word_doc[first[hit]]])
                        sigs.append(sig[hit])
                first, v = flat.windows(h, wo, k)
                if not len(v) or not large:
                    continue
                at = np.searchsorted(word_doc[first], np.arange(len(wo)))
                levels, block = [], at
                for c in range(min(large), max(large) + 1):
                    heads, block = _heads(block, 1 << c if not levels else 2)
                    owner = np.repeat(np.arange(len(block) - 1), np.diff(block))
                    levels.append((c, heads, owner, np.r_[owner[1:] == owner[:-1], False] if len(owner) else np.empty(0, bool)))
                for j, seed in enumerate(_SEEDS):
                    least = v * seed
                    for c, heads, owner, joined in levels:
                        least = np.minimum.reduceat(least, heads)
                        if c in large:
                            wide = least.copy()
                            np.minimum(wide[:-1], least[1:], out=wide[:-1], where=joined[:-1])
                            sig = _signature(wide, c, j)
                            cell = sig >> shift
                            hit = np.flatnonzero((bits[cell >> U(6)] >> (cell & low)) & U(1))
                            if len(hit):
                                docs.append(ids[i + owner[hit]])
                                sigs.append(sig[hit])
            doc, sig = np.concatenate([*docs, np.empty(0, np.int64)]).astype(np.int64), np.concatenate([*sigs, np.empty(0, U)])
            if len(doc):
                order = np.lexsort((sig, doc))
                doc, sig = doc[order], sig[order]
                new = np.r_[True, (doc[1:] != doc[:-1]) | (sig[1:] != sig[:-1])]
                doc, sig = doc[new], sig[new]
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(flat.signed(sig))], ["doc_id", "sig"])
        flat.release()

    return run


def _contained(k: int):
    """Exact: of the item's distinct shingles, as words, how many the document has."""
    def cut(text):
        return [bytes(x) for x in text.encode().translate(flat.LOWER.tobytes()).split()]

    def grams(w, n):
        return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}

    def run(batches):
        for batch in batches:
            texts, items, ids = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "items", "doc_id"))
            out = []
            for d, text, wanted in zip(ids, texts, items):
                own, of = cut(text or ""), {}
                for x in wanted:
                    w = cut(x["text"] or "")
                    n = min(k, len(w))
                    s = grams(w, n) if n else set()
                    if n not in of:
                        of[n] = grams(own, n) if n else set()
                    out.append((d, x["item_id"], len(s), len(s & of[n])))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(4)], ["doc_id", "item_id", "n_shingles", "n_shared"])

    return run


def leaks(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, item_id, n_shingles of the item, n_shared: pairs where the document holds at least `percent` % of the
    item's distinct k-word shingles (words parted by ASCII white space, A-Z in lower case).

    Null, empty or blank texts are in no pair; an item of fewer than k words is one shingle of its own length; rows without an id
    are in no pair; repeated rows give a pair once. Other columns are not looked at.
    """
    spark = docs.sparkSession
    settle(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null")
    signed = written(items.mapInArrow(_items(k), "item_id long, size_class int, sig long"), "items")
    classes = sorted(r[0] for r in signed.select("size_class").distinct().collect())
    if not classes:
        return spark.createDataFrame([], "doc_id long, item_id long, n_shingles long, n_shared long")
    cell = f"shiftrightunsigned(sig, {64 - BITMAP})"
    words = signed.selectExpr(f"shiftright({cell}, 6) AS word", f"shiftleft(1L, CAST(pmod({cell}, 64) AS INT)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    bitmap = np.zeros(1 << BITMAP - 6, np.int64)
    got = words.toPandas()  # at most 2^19 rows, whatever the number of items
    bitmap[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    seen = docs.mapInArrow(_search(k, classes, spark.sparkContext.broadcast(bitmap.tobytes())), "doc_id long, sig long")
    pairs = written(seen.join(signed, "sig").select("doc_id", "item_id").distinct(), "candidates")
    ids = written(pairs.select("doc_id").distinct(), "suspects")
    wanted = pairs.join(items.dropDuplicates(), "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "text")).alias("items"))
    found = matched(docs, ids, "doc_id").join(wanted, "doc_id").mapInArrow(_contained(k), "doc_id long, item_id long, n_shingles long, n_shared long")
    return found.where((F.col("n_shingles") > 0) & (F.col("n_shared") * 100 >= F.col("n_shingles") * percent)).distinct()


def without_leaks(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """`docs` without the documents that hold an item."""
    bad = written(leaks(docs, items, k, percent).select("doc_id").distinct(), "leaking")
    return matched(docs, bad, "doc_id", "left_anti")
