"""Removal of word sequences that repeat across documents, found with difference-cover anchors.

D is a set of residues modulo a period v such that for any two positions some shift below v takes both into D. Short
windows are hashed only where position mod v is in D; two equal windows of `width` words, wherever they start, hold an
anchor at the same place inside them, as the anchor's length is width - v + 1. Anchors that two documents share are
then extended: every window of the full width around one is compared through its own hash.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import flat
from .shared_keys import ABOUT, shared, tags
from .staging import matched, settle, written

U = np.uint64
#: Perfect difference sets by their period: every residue is a difference of two members.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
NO_ID = (1 << 63) - 1
#: A text: its doc_id (NO_ID for null), and twice the hash of the text, plus one where the id is null.
ROW = ["doc_id", "row"]
FOUND = "key long, owner long, row long, tag int, pos int, about struct<n_words:long,sha:string>"


def period(width: int) -> int:
    """The largest cover whose anchors have at least a third of the window's words."""
    return max([v for v in COVERS if width - v + 1 >= max(2, width // 3)], default=1)


def covered(v: int) -> np.ndarray:
    on = np.zeros(v, bool)
    on[list(COVERS.get(v, (0,)))] = True
    return on


def _long(batch, name):
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _placed(value: np.ndarray, start: np.ndarray, wo: np.ndarray, size: int) -> np.ndarray:
    """Positions inside documents as positions in the list of words; none that doesn't fit its document."""
    count = np.diff(start)
    at = value[start[0]:start[-1]] + np.repeat(wo[:-1], count)
    return at[at + size <= np.repeat(wo[1:], count)]


def kept_bytes(b: np.ndarray, s: np.ndarray, e: np.ndarray) -> bytes:
    """The words [s, e) of `b`, joined by one space."""
    if not len(s):
        return b""
    size = e - s
    out = np.full(int(size.sum()) + len(s), 32, np.uint8)
    to = np.cumsum(size + 1) - size - 1
    out[flat.ragged(to, size)] = b[flat.ragged(s, size)]
    return out[:-1].tobytes()


def _anchors(width: int):
    v = period(width)
    on, size = covered(v), width - v + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, (data, off) = _long(batch, "doc_id"), _long(batch, "row"), flat.texts(batch)
            key, owner, row, pos, count, sha = [], [], [], [], [], []
            for i, j in flat.runs(off):
                b, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
                s, e, h, wo = flat.words(b, o)
                doc = np.repeat(np.arange(j - i), np.diff(wo))
                at, x = flat.windows(h, wo, size)
                inside = at - wo[doc[at]]
                take = on[inside % v] & (np.diff(wo)[doc[at]] >= width)
                key.append(x[take])
                owner.append(ids[i + doc[at[take]]])
                row.append(rows[i + doc[at[take]]])
                pos.append(inside[take])
                count.append(np.diff(wo))
                sha += [hashlib.sha256(kept_bytes(b, s[p:q], e[p:q])).hexdigest() for p, q in zip(wo[:-1], wo[1:])]
            cat = lambda parts, kind: np.concatenate([*parts, np.empty(0, kind)])
            key, owner, row, pos, count = cat(key, U), *(cat(x, np.int64).astype(np.int64) for x in (owner, row, pos, count))
            m, n = len(key), len(sha)
            about = pa.StructArray.from_arrays([pa.array(np.r_[np.zeros(m, np.int64), count.astype(np.int64)]), pa.array([""] * m + sha, pa.string())], ["n_words", "sha"], mask=pa.array(np.r_[np.ones(m, bool), np.zeros(n, bool)]))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.r_[flat.signed(key), ids]), pa.array(np.r_[owner, ids]), pa.array(np.r_[row, rows]), pa.array(np.r_[tags(key, owner), np.full(n, ABOUT, np.int32)]),
                pa.array(np.r_[pos, np.zeros(n, np.int64)].astype(np.int32)), about], ["key", "owner", "row", "tag", "pos", "about"])
        flat.release()

    return run


def _extend(width: int):
    """Windows of the full width around the anchors `at` of each text. Where the batch has the window in a smaller
    document, the row is settled (tag 1); of the others, one row of the least document goes on for each key and batch."""
    size = width - period(width) + 1

    def run(batches):
        for batch in batches:
            ids, rows, (data, off) = _long(batch, "doc_id"), _long(batch, "row"), flat.texts(batch)
            anchors = batch.column(batch.schema.get_field_index("at"))
            start, value = np.asarray(anchors.offsets), np.asarray(anchors.values)
            key, owner, row, pos = [], [], [], []
            for i, j in flat.runs(off):
                b, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
                _, _, h, wo = flat.words(b, o)
                here = _placed(value, start[i:j + 1], wo, size)
                edge = np.zeros(len(h) + width + 1, np.int64)
                np.add.at(edge, np.maximum(here + size - width, 0), 1)
                np.add.at(edge, here + 1, -1)
                near = np.cumsum(edge) > 0
                at, x = flat.windows(h, wo, width)
                take = near[at]
                at, x = at[take], x[take]
                doc = np.repeat(np.arange(j - i), np.diff(wo))[at]
                key.append(x)
                owner.append(ids[i + doc])
                row.append(rows[i + doc])
                pos.append(at - wo[doc])
            cat = lambda parts, kind: np.concatenate([*parts, np.empty(0, kind)]).astype(kind)
            key, owner, row, pos = cat(key, U), *(cat(x, np.int64) for x in (owner, row, pos))
            order = np.lexsort((owner, key))
            key, owner, row, pos = key[order], owner[order], row[order], pos[order]
            heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
            least = np.repeat(owner[heads], np.diff(np.r_[heads, len(key)]))
            yield pa.RecordBatch.from_arrays([pa.array(flat.signed(key)), pa.array(owner), pa.array(row), pa.array((owner > least).astype(np.int32)), pa.array(pos.astype(np.int32))], ["key", "owner", "row", "tag", "pos"])

    return run


def _cut(width: int):
    """Texts without the words that the windows starting at `at` cover."""
    def run(batches):
        for batch in batches:
            data, off = flat.texts(batch)
            first = batch.column(batch.schema.get_field_index("at"))
            start, value = np.asarray(first.offsets), np.asarray(first.values)
            n, gone, kept = [], [], []
            for i, j in flat.runs(off):
                b, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
                s, e, _, wo = flat.words(b, o)
                here = _placed(value, start[i:j + 1], wo, width)
                edge = np.zeros(len(s) + 1, np.int64)
                np.add.at(edge, here, 1)
                np.add.at(edge, here + width, -1)
                out = np.cumsum(edge)[:-1] > 0
                for p, q in zip(wo[:-1], wo[1:]):
                    left = ~out[p:q]
                    n.append(int(q - p))
                    gone.append(int(q - p - left.sum()))
                    kept.append(kept_bytes(b, s[p:q][left], e[p:q][left]).decode())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "row")), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "row", "n_words", "n_removed", "kept_text"])

    return run


def _prepared(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All documents (doc_id, n_words, sha of their words); (doc_id, at) window starts to remove; texts of those."""
    settle(docs.sparkSession)
    unknown = F.col("doc_id").isNull().cast("long")
    row = F.shiftleft(F.xxhash64(F.coalesce("text", F.lit(""))), 1).bitwiseOR(unknown).alias("row")
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), row, "text")
    rows = written(shared(base.mapInArrow(_anchors(width), FOUND)), "anchors")
    about = rows.where(F.col("tag") == ABOUT).select(F.col("owner").alias("doc_id"), "row", "about.*")
    anchors = rows.where(F.col("tag") != ABOUT).groupBy(F.col("owner").alias("doc_id"), "row").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    anchors = written(anchors, "shared-anchors")
    near = written(matched(base, anchors.select(*ROW), ROW).join(anchors, ROW), "near")
    found = near.mapInArrow(_extend(width), "key long, owner long, row long, tag int, pos int")
    salt = F.when(F.col("tag") == 1, F.pmod(F.xxhash64("owner", "row", "pos"), F.lit(64)) + 1).otherwise(0)
    least = F.min("owner").over(Window.partitionBy("key", "salt"))
    gone = found.withColumn("salt", salt).withColumn("least", least).where("tag = 1 or owner > least")
    gone = gone.groupBy(F.col("owner").alias("doc_id"), "row").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    return about, written(gone, "repeats"), near.select(*ROW, "text")


def without_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (null where nothing is removed), words_sha256 of the words before removal.

    Words are what ASCII white space parts, case kept. A word is removed if a window of `width` words of its document
    covers it whose sequence also starts in a document of smaller doc_id; the input is judged, not what is left. Null and
    blank texts have no words; documents shorter than `width` lose nothing; a null doc_id counts as greater than others;
    rows of one doc_id, or without one, don't repeat each other, and each is judged by its own text. Other columns are
    not looked at.
    """
    about, gone, near = _prepared(docs, width)
    cut = near.join(gone, ROW).mapInArrow(_cut(width), "doc_id long, row long, n_words long, n_removed long, kept_text string")
    whole = about.join(gone.select(*ROW), ROW, "left_anti").select(*ROW, "n_words", F.lit(0).cast("long").alias("n_removed"), F.lit(None).cast("string").alias("kept_text"), F.col("sha").alias("words_sha256"))
    out = whole.unionByName(cut.withColumn("words_sha256", F.lit(None).cast("string")))
    return out.withColumn("doc_id", F.when(F.col("row") % 2 == 0, F.col("doc_id"))).drop("row")
