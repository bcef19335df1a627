"""Periodic runs of words (maximal repetitions), by tiles of each period octave.

Octave B = 1, 2, 4, ... holds the periods B to 2B-1. A document is cut into blocks of B words, and for each octave into
tiles of many blocks that overlap by the words an extension may read. A stretch in which words p apart are equal, 2B long
or longer, holds a whole block that equals the words p later; such blocks are found by comparing hashes of B words, which
double from octave to octave. At the boundary where such a block begins, Z-functions to the right and of the reversed
words to the left give for each of its periods how far the repetition reaches, at most 2B and B words. Every tile is
solved by itself; what it finds are fragments. They are shuffled by document and period and overlapping ones stitched, so
a run of any length is whole whatever the tiles were. The work is n words for each octave and Z-functions where something
repeats.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import flat
from .staging import BROADCAST_ROWS, settle, written
from .substring import kept_bytes

U = np.uint64
PIECE = "doc_id long, row long, n_words long, sha string, octave int, at long, lead long, own long, words binary, period long, start long, stop long"
NAMES = [x.split()[0] for x in PIECE.split(", ")]


def z_values(x: list[int]) -> list[int]:
    """z[i]: how many items from i on equal those from 0 on."""
    n = len(x)
    z, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _reach(words: np.ndarray, c: int, periods: np.ndarray, size: int) -> tuple[list[int], list[int]]:
    """How far the words p apart stay equal from boundary c: to the left (at most `size`), to the right (at most twice)."""
    right = z_values(words[c:c + 4 * size].tolist())
    after = min(len(words), c + 2 * size)
    before = words[max(0, c - size):c][::-1].tolist()
    left = z_values([*before, -1, *words[max(0, c - size):after][::-1].tolist(), -2])
    return [min(len(before), left[len(before) + 1 + after - c - p]) for p in periods.tolist()], [min(2 * size, right[p]) for p in periods.tolist()]


def _merged(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of equal key that touch become one; key must order them by owner and period."""
    order = np.lexsort((lo, key))
    key, lo, hi = key[order], lo[order], hi[order]
    out_k, out_l, out_h = [], [], []
    for k, a, b in zip(key.tolist(), lo.tolist(), hi.tolist()):
        if out_k and out_k[-1] == k and a <= out_h[-1]:
            out_h[-1] = max(out_h[-1], b)
        else:
            out_k.append(k)
            out_l.append(a)
            out_h.append(b)
    return np.array(out_k, np.int64), np.array(out_l, np.int64), np.array(out_h, np.int64)


def solve(words: np.ndarray, offsets: np.ndarray, lead: np.ndarray, own: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Fragments of the tiles at `offsets` in the octave of `size`: tile, period, first and end position p apart are equal,
    counted from the tile's first own word. `hashes` are those of `size` words from each position on; the first `lead`
    words of a tile are context, its blocks begin in the `own` words that follow."""
    count = np.diff(offsets)
    tile = np.repeat(np.arange(len(count)), count)
    base = offsets[:-1] + lead
    x = np.arange(len(words))
    place = x - base[tile]
    block = base[tile] + (place // size - 1) * size
    ok = (place >= size) & (x + size <= offsets[1:][tile]) & (block - base[tile] < own[tile])
    x, block = x[ok], block[ok]
    same = hashes[x] == hashes[block]
    x, block = x[same], block[same]
    found: list[tuple[int, int, int, int]] = []
    cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.empty(0, np.int64)
    for i, j in zip(cuts, np.r_[cuts[1:], len(block)]):
        c = int(block[i])
        t = int(tile[c])
        lo, hi = int(offsets[t]), int(offsets[t + 1])
        near = words[max(lo, c - size):min(hi, c + 4 * size)]
        at = c - max(lo, c - size)
        periods = x[i:j] - c
        for p, left, right in zip(periods.tolist(), *_reach(near, at, periods, size)):
            if right >= size:
                found.append((t, p, c - left - int(base[t]), c + right - int(base[t])))
    if not found:
        return (np.empty(0, np.int64),) * 4
    t, p, a, b = np.array(found, np.int64).T
    key, a, b = _merged(t * (2 * size) + p, a, b)
    return key // (2 * size), key % (2 * size), a, b


def _dense(h: np.ndarray) -> np.ndarray:
    return np.unique(h, return_inverse=True)[1].astype(np.int64)


def _columns(n: int, **given) -> pa.RecordBatch:
    kinds = {"octave": pa.int32(), "sha": pa.string(), "words": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(given[c], kinds.get(c, pa.int64())) if c in given else pa.nulls(n, kinds.get(c, pa.int64())) for c in NAMES], NAMES)


def _explode(tile: int, times: int):
    """One row about each document; fragments of the documents of one tile for each octave; tiles of longer ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = flat.texts(batch)
            ids, rows = batch.column(0), batch.column(1)
            for i, j in flat.runs(off, 1 << 21):
                b, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
                s, e, h, wo = flat.words(b, o)
                count = np.diff(wo)
                key, row = ids.slice(i, j - i), rows.slice(i, j - i)
                yield _columns(j - i, doc_id=key, row=row, n_words=count, sha=[hashlib.sha256(kept_bytes(b, s[p:q], e[p:q])).hexdigest() for p, q in zip(wo[:-1], wo[1:])])
                size, who, power = 1, np.arange(j - i), h
                ids_here = _dense(h)
                while True:  # documents too short for the octave leave
                    stay = count[who] >= times * size
                    keep = np.repeat(stay, count[who])
                    who, power, ids_here = who[stay], power[keep], ids_here[keep]
                    if not len(who):
                        break
                    o2 = np.r_[0, np.cumsum(count[who])]
                    one = count[who] <= tile
                    zero = np.zeros(len(who), np.int64)
                    t, p, a, c = solve(ids_here, o2, zero, np.where(one, count[who], 0), power, size)
                    if len(t):
                        yield _columns(len(t), doc_id=key.take(pa.array(who[t])), row=row.take(pa.array(who[t])), period=p, start=a, stop=c)
                    for d in np.flatnonzero(~one):
                        step = max(tile // size, 8) * size
                        w = ids_here[o2[d]:o2[d + 1]].astype(np.int32)
                        at = np.arange(0, len(w), step)
                        lead = np.minimum(at, size)
                        yield _columns(len(at), doc_id=key.take(pa.array(np.full(len(at), who[d]))), row=row.take(pa.array(np.full(len(at), who[d]))),
                                       octave=np.full(len(at), size, np.int32), at=at, lead=lead, own=np.full(len(at), step),
                                       words=[w[x - y:x + step + 4 * size].tobytes() for x, y in zip(at.tolist(), lead.tolist())])
                    if 2 * size > (1 << 30):
                        break
                    power = np.concatenate([flat.joined(power[:-size], power[size:]), np.zeros(min(size, len(power)), U)]) if len(power) > size else power
                    size *= 2
        flat.release()

    return run


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments of the tiles that longer documents were cut into."""
    names = ["doc_id", "row", "period", "start", "stop"]
    for batch in batches:
        col = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            w = np.frombuffer(col["words"][i].as_py(), np.int32).astype(np.int64)
            size, lead, own, at = (col[c][i].as_py() for c in ("octave", "lead", "own", "at"))
            power, done = flat.mix(w.astype(U)), 1
            while done < size:
                power = np.concatenate([flat.joined(power[:-done], power[done:]), np.zeros(min(done, len(power)), U)]) if len(power) > done else power
                done *= 2
            _, p, a, b = solve(w, np.array([0, len(w)]), np.array([lead]), np.array([own]), power, size)
            if len(p):
                same = pa.array(np.full(len(p), i))
                yield pa.RecordBatch.from_arrays([col["doc_id"].take(same), col["row"].take(same), pa.array(p), pa.array(a + at), pa.array(b + at)], names)
    flat.release()


def _stitched(fragments: DataFrame) -> DataFrame:
    """doc_id, row, period, start, stop: fragments of one document and period that touch are one."""
    w = Window.partitionBy("doc_id", "row", "period").orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = fragments.withColumn("new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    island = new.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("doc_id", "row", "period", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words that repeat the period before them."""
    for batch in batches:
        data, off = flat.texts(batch)
        runs = batch.column(batch.schema.get_field_index("runs"))
        first = np.asarray(runs.offsets)
        start, length, period = (np.asarray(runs.values.field(k)) for k in ("start", "length", "period"))
        kept = []
        for i, j in flat.runs(off):
            b, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
            s, e, _, wo = flat.words(b, o)
            for d in range(j - i):
                p, q = wo[d], wo[d + 1]
                mine = slice(first[i + d], first[i + d + 1])
                edge = np.zeros(q - p + 1, np.int64)
                np.add.at(edge, start[mine] + period[mine], 1)
                np.add.at(edge, start[mine] + length[mine], -1)
                left = np.cumsum(edge)[:-1] == 0
                kept.append(kept_bytes(b, s[p:q][left], e[p:q][left]).decode())
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), runs, pa.array(kept, pa.string())], ["doc_id", "row", "n_words", "runs", "collapsed"])
    flat.release()


def runs(docs: DataFrame, least: int = 6, times: int = 4, tile: int = 1 << 14) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, ordered by start and period), collapsed (the text's words
    without those that any run holds after its first period; null where there is no run), words_sha256 of all words.

    Words are what ASCII white space parts, case kept, numbered from 0. A run is a stretch with smallest period q of at
    least max(`least`, `times` * q) words that no neighbouring word extends; `times` is 3 or more, so that each run holds a
    whole block. Null, empty and blank texts have no words and no runs; rows of one doc_id are judged by their own texts;
    a null doc_id is kept; columns other than doc_id and text are not looked at. Documents of more than `tile` words send
    the tiles of each octave to other tasks; the result does not depend on it.
    """
    if times < 3:
        raise ValueError("times must be 3 or more")
    settle(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), "text")
    pieces = written(base.mapInArrow(_explode(tile, times), PIECE), "pieces")
    about = pieces.where("n_words is not null").select("doc_id", "row", "n_words", F.col("sha").alias("words_sha256"))
    tiles = pieces.where("octave is not null").select("doc_id", "row", "octave", "at", "lead", "own", "words")
    found = tiles.repartition(F.xxhash64("doc_id", "row", "octave", "at")).mapInArrow(_tiles, "doc_id long, row long, period long, start long, stop long")
    fragments = pieces.where("period is not null").select("doc_id", "row", "period", "start", "stop").unionByName(found)
    whole = _stitched(fragments).select("doc_id", "row", "period", "start", (F.col("stop") - F.col("start") + F.col("period")).alias("length"))
    whole = whole.where(F.col("length") >= F.greatest(F.lit(least), F.col("period") * times))
    # a stretch of several periods has its smallest one here too, over the same words
    whole = whole.groupBy("doc_id", "row", "start", "length").agg(F.min("period").alias("period"))
    each = F.sort_array(F.collect_list(F.struct("start", "period", "length")))
    listed = whole.groupBy("doc_id", "row").agg(F.transform(each, lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"), x["period"].alias("period"))).alias("runs"))
    listed = written(listed, "runs")
    keys = listed.select(F.col("doc_id").alias("run_id"), F.col("row").alias("run_row"))
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    texts = base.join(keys, same("doc_id", "run_id") & same("row", "run_row"), "left_semi")
    listed = listed.select(F.col("doc_id").alias("run_id"), F.col("row").alias("run_row"), "runs")
    cut = texts.join(listed, same("doc_id", "run_id") & same("row", "run_row")).select("doc_id", "row", F.lit(0).cast("long").alias("n_words"), "runs", "text")
    cut = cut.mapInArrow(_collapse, "doc_id long, row long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    cut = cut.select(F.col("doc_id").alias("run_id"), F.col("row").alias("run_row"), "runs", "collapsed").dropDuplicates(["run_id", "run_row"])
    out = about.join(cut, same("doc_id", "run_id") & same("row", "run_row"), "left")
    empty = F.array().cast("array<struct<start:long,length:long,period:long>>")
    return out.select("doc_id", "n_words", F.coalesce("runs", empty).alias("runs"), "collapsed", "words_sha256")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text: in one document of ten, by the checksum of its id, the words from some place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t\\n\\u000b\\f\\r]+"), lambda x: x != "")
    n = F.size(words).cast("long")

    def text(w):
        n, g = F.size(w["words"]).cast("long"), w["g"]
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.when(i < a, w["words"][i]).otherwise(w["words"][(a + (i - a) % p).cast("int")])), " ")

    changed = F.transform(F.array(F.struct(words.alias("words"), F.floor(h / 10).alias("g"))), text)[0]
    return docs.select("doc_id", F.when((h % 10 == 0) & (n > 0), changed).otherwise(F.col("text")).alias("text"))
