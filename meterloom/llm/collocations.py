"""Collocations by vertical partitioning of the suffix tree of words (after ERA: Mansour et al., VLDB 2011).

The tree of all suffixes, cut off at `longest` words, is split at word prefixes: a prefix whose suffixes exceed the budget
of one task is extended by a word, others are leaves of the split. Prefixes are dealt over groups until no group exceeds
twice the budget. Each group's subtree is built by itself: its suffixes are sorted, a node is a stretch with equal first
words, and its count is the total of the leaves below. Suffixes travel as columns of 64-bit word ids, compressed, one row
for each batch and group. Ids are checked to be unique over the whole vocabulary; if two words shared one, the next
seed would be taken, so counts are exact.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import flat
from .staging import BROADCAST_ROWS, matched, settle, written

U = np.uint64
PART = np.zeros(256, bool)
PART[list(b".,;:!?\n\x0b\x0c\r")] = True
GAP = PART.copy()
GAP[[9, 32]] = True
NONE = np.int64(0)  # no further word in the piece; word ids are never 0
MOST_HEAVY = BROADCAST_ROWS


def word_table(b: np.ndarray, o: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and ids of the words of the documents at offsets `o`, and the number of each word's piece."""
    gap = GAP[b]
    edge = np.zeros(len(b) + 1, bool)
    edge[o] = True
    first, last = ~gap, ~gap
    first[1:] &= gap[:-1] | edge[1:-1]
    last[:-1] &= gap[1:] | edge[1:-1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    ids = flat.range_hashes(b, s, e, flat.LOWER, seed)
    ids[ids == 0] = U(1)
    piece = np.cumsum(PART[b] | edge[:-1])[s] if len(s) else np.empty(0, np.int64)
    return s, e, flat.signed(ids), piece


def suffixes(ids: np.ndarray, piece: np.ndarray, longest: int) -> np.ndarray:
    """The first `longest` words of every suffix inside its piece, NONE where the piece ends: one row for each depth."""
    out = np.full((longest, len(ids)), NONE)
    for k in range(min(longest, len(ids))):
        inside = piece[k:] == piece[:len(ids) - k]
        out[k, :len(ids) - k][inside] = ids[k:][inside]
    return out


def route(lang: int, cols: np.ndarray, heavy: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The split's prefix of every suffix: its hash, and its number of words. heavy[k]: sorted hashes of the prefixes of
    k+1 words that are extended."""
    h = flat.joined(np.full(cols.shape[1], lang, np.int64).view(U), cols[0].view(U))
    depth, at = np.ones(cols.shape[1], np.int64), np.arange(cols.shape[1])
    for k, own in enumerate(heavy):
        if not len(own) or k + 1 >= len(cols):
            break
        near = np.minimum(np.searchsorted(own, h[at]), len(own) - 1)
        at = at[own[near] == h[at]]
        h[at] = flat.joined(h[at], cols[k + 1][at].view(U))
        depth[at] += 1
    return h, depth


def packed(cols: np.ndarray, count: np.ndarray) -> bytes:
    return pa.compress(np.concatenate([*cols, count]).tobytes(), "zstd", asbytes=True)


def unpacked(blob: bytes, rows: int, longest: int) -> np.ndarray:
    size = rows * (longest + 1)
    return np.frombuffer(pa.decompress(blob, decompressed_size=size * 8, codec="zstd", asbytes=True), np.int64).reshape(longest + 1, rows)


def summed(cols: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns in order, the counts of equal ones summed."""
    if not cols.shape[1]:
        return cols, count
    order = np.lexsort(cols[::-1])
    cols, count = cols[:, order], count[order]
    heads = np.flatnonzero(np.r_[True, (cols[:, 1:] != cols[:, :-1]).any(axis=0)])
    return cols[:, heads], np.add.reduceat(count, heads)


def _texts_by_lang(batch: pa.RecordBatch):
    """Each language's texts of a batch as one buffer and its offsets."""
    lang = batch.column(batch.schema.get_field_index("lang"))
    codes = lang.dictionary_encode()
    for k, name in enumerate(codes.dictionary.to_pylist()):
        part = batch.filter(pc.equal(codes.indices, k))
        data, off = flat.texts(part)
        yield name, data[off[0]:off[-1]], off - off[0]


def _lang_id(name: str) -> int:
    b = np.frombuffer(name.encode() or b"\0", np.uint8)
    return int(flat.signed(flat.range_hashes(b, np.array([0]), np.array([len(b)])))[0])


def _vocabulary(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, b, o in _texts_by_lang(batch):
                s, e, ids, _ = word_table(b, o, seed)
                if not len(s):
                    continue
                low = flat.LOWER[b]
                code, first = flat.distinct_ranges(low, s, e)
                words = pa.array([low[p:q].tobytes().decode() for p, q in zip(s[first].tolist(), e[first].tolist())])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(first), pa.string()), words, pa.array(ids[first]), pa.array(np.bincount(code, minlength=len(first)))], ["lang", "word", "id", "f"])
        flat.release()

    return run


def _extensions(seed: int, longest: int, heavy: list[np.ndarray]):
    """Counts of the prefixes that extend a heavy one by a word."""
    def run(batches):
        depth = len(heavy) + 1
        for batch in batches:
            for name, b, o in _texts_by_lang(batch):
                _, _, ids, piece = word_table(b, o, seed)
                cols = suffixes(ids, piece, longest)
                h, d = route(_lang_id(name), cols, heavy)
                at = np.flatnonzero((d == depth) & (cols[depth - 1] != NONE))
                own, count = summed(cols[:depth, at], np.ones(len(at), np.int64))
                h, _ = route(_lang_id(name), np.concatenate([own, np.full((1, own.shape[1]), NONE)]), heavy)
                ids = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, depth).astype(np.int32)), pa.array(own.T.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(h), pa.string()), pa.array(flat.signed(h)), ids, pa.array(count)], ["lang", "prefix", "ids", "f"])
        flat.release()

    return run


def _scatter(seed: int, longest: int, heavy: list[np.ndarray], groups: int, often):
    """Every suffix to its prefix's group: one compressed row for each batch, language and group."""
    def run(batches):
        for batch in batches:
            for name, b, o in _texts_by_lang(batch):
                _, _, ids, piece = word_table(b, o, seed)
                cols = suffixes(ids, piece, longest)
                keep = often[(ids.view(U) >> U(64 - SLOT_BITS)).astype(np.int64)]
                for k in range(1, longest):  # a word that cannot be in a frequent phrase ends the suffix
                    ok = np.r_[keep[k:], np.zeros(min(k, len(ids)), bool)][:len(ids)]
                    cols[k][~ok | (cols[k - 1] == NONE)] = NONE
                cols = cols[:, keep & (cols[1] != NONE)] if longest > 1 else cols[:, keep]
                own, count = summed(cols, np.ones(cols.shape[1], np.int64))
                h, _ = route(_lang_id(name), own, heavy)
                g = (h % U(groups)).astype(np.int64)
                order = np.argsort(g, kind="stable")
                g, own, count = g[order], own[:, order], count[order]
                heads = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, np.int64)
                ends = np.r_[heads[1:], len(g)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(heads), pa.string()), pa.array(g[heads]), pa.array(ends - heads),
                                                  pa.array([packed(own[:, i:j], count[i:j]) for i, j in zip(heads, ends)], pa.binary())], ["lang", "group", "rows", "blob"])
        flat.release()

    return run


SLOT_BITS = 24
COUNTED = "lang string, depth int, ids array<long>, f long"


def _subtree(longest: int, least: int, heavy: list[np.ndarray]):
    """Nodes of one group's subtree with at least `least` occurrences, from two words on."""
    def run(table: pa.Table) -> pa.Table:
        name = table.column("lang")[0].as_py()
        parts = [unpacked(b, r, longest) for b, r in zip(table.column("blob").to_pylist(), table.column("rows").to_pylist())]
        whole = np.concatenate(parts, axis=1)
        cols, count = summed(whole[:longest], whole[longest])
        _, prefix = route(_lang_id(name), cols, heavy)
        total = np.r_[0, np.cumsum(count)]
        out = []
        new = np.zeros(cols.shape[1], bool)
        new[:1] = True
        for depth in range(1, longest + 1):
            new[1:] |= cols[depth - 1][1:] != cols[depth - 1][:-1]
            if depth < 2:
                continue
            heads = np.flatnonzero(new)
            leaves = total[np.r_[heads[1:], len(count)]] - total[heads]
            take = (leaves >= least) & (cols[depth - 1][heads] != NONE) & (prefix[heads] <= depth)
            ids = cols[:depth, heads[take]]
            out.append(pa.table({"lang": pa.array([name] * ids.shape[1], pa.string()), "depth": pa.array(np.full(ids.shape[1], depth, np.int32)),
                                 "ids": pa.ListArray.from_arrays(pa.array(np.arange(0, ids.size + 1, depth).astype(np.int32)), pa.array(ids.T.ravel())), "f": pa.array(leaves[take])}))
        return pa.concat_tables(out)

    return run


def _few(df: DataFrame, column: str) -> np.ndarray | None:
    """A column's values, sorted, if there are at most MOST_HEAVY."""
    if df.count() > MOST_HEAVY:
        return None
    return np.sort(np.array([r[0] for r in df.select(column).collect()], np.int64).view(U))


def _split(base: DataFrame, ones: DataFrame, seed: int, longest: int, budget: int) -> tuple[list[np.ndarray], list[DataFrame], int]:
    """Heavy prefixes by depth with their counts, and the budget: doubled until the heavy ones are few enough to send to all tasks."""
    while True:
        heavy, counted, level = [], [], ones
        for depth in range(1, longest):
            level = written(level.where(F.col("f") > budget), "heavy-prefixes")
            own = _few(level, "prefix")
            if own is None:
                break
            if not len(own):
                return heavy, counted, budget
            heavy.append(own)
            counted.append(level)
            if depth + 1 < longest:
                found = base.mapInArrow(_extensions(seed, longest, list(heavy)), "lang string, prefix long, ids array<long>, f long")
                level = found.groupBy("lang", "prefix", "ids").agg(F.sum("f").alias("f"))
        else:
            return heavy, counted, budget
        budget *= 2


def _prefix_hash(rows: DataFrame) -> DataFrame:
    """ones (lang, word, id, f) with the hash of the prefix and its ids as an array."""
    def run(batches):
        for batch in batches:
            langs, ids = batch.column(0), batch.column(2).to_numpy()
            own = {x: _lang_id(x) for x in langs.unique().to_pylist()}
            h = flat.joined(np.array([own[x] for x in langs.to_pylist()], np.int64).view(U), ids.view(U))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(flat.signed(h))], ["lang", "word", "id", "f", "prefix"])
        flat.release()

    return rows.mapInArrow(run, "lang string, word string, id long, f long, prefix long")


def counted(base: DataFrame, longest: int, least: int, budget: int) -> tuple[DataFrame, DataFrame]:
    """The vocabulary (lang, word, id, f, prefix) and all phrases of 2 to `longest` words with at least `least`
    occurrences (lang, depth, ids, f) of base (lang, text)."""
    spark = base.sparkSession
    seed = 0
    while True:
        ones = base.mapInArrow(_vocabulary(seed), "lang string, word string, id long, f long").groupBy("lang", "word", "id").agg(F.sum("f").alias("f"))
        ones = written(_prefix_hash(ones), "vocabulary")
        if ones.groupBy("id").agg(F.min("word").alias("a"), F.max("word").alias("b")).where("a <> b").isEmpty():
            break
        seed += 1
    heavy, above, budget = _split(base, ones, seed, longest, budget)
    # suffixes by hash class of their prefix: classes are doubled until none holds more than two budgets
    light = ones.where(F.col("f") <= budget)
    total = ones.agg(F.sum("f")).first()[0] or 0
    groups = max(1, -(-total // budget))
    while True:
        fullest = light.groupBy(F.pmod(F.col("prefix"), F.lit(groups))).agg(F.sum("f").alias("s")).agg(F.max("s")).first()[0] or 0
        if fullest <= 2 * budget:
            break
        groups *= 2
    # words with too few occurrences end a suffix; a fixed number of bits, so unrelated words may only spare one
    slots = ones.where(F.col("f") >= least).select(F.shiftrightunsigned("id", 64 - SLOT_BITS).alias("slot"))
    bits = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 AS int))")).alias("bits"))
    often = np.zeros(1 << SLOT_BITS, bool)
    got = bits.toArrow()  # at most 2^18 rows, whatever the vocabulary
    if got.num_rows:
        words = np.zeros(1 << (SLOT_BITS - 6), U)
        words[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(U)
        often = np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool)
    shared = spark.sparkContext.broadcast(np.packbits(often))

    def scatter(batches):
        yield from _scatter(seed, longest, heavy, groups, np.unpackbits(shared.value).astype(bool))(batches)

    rows = base.mapInArrow(scatter, "lang string, group long, rows long, blob binary")
    nodes = rows.groupBy("lang", "group").applyInArrow(_subtree(longest, least, heavy), COUNTED)
    for depth, level in enumerate(above, 1):
        if depth > 1:
            nodes = nodes.unionByName(level.where(F.col("f") >= least).select("lang", F.lit(depth).alias("depth"), "ids", "f"))
    return ones, written(nodes, "phrases")


def _score(a: Column, l: Column, r: Column) -> Column:
    """floor(1000000 a a / (l r)), in decimals that hold any product of counts below 10^15."""
    d = lambda x: x.cast("decimal(15,0)")
    return F.call_function("div", d(a) * d(a) * F.lit(1000000).cast("decimal(7,0)"), d(l) * d(r))


def mined(docs: DataFrame, longest: int = 3, least: int = 10, inside_percent: int = 50, top: int = 2000, budget: int = 1_000_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language.

    Texts (doc_id, text, lang; other columns are not looked at) in lower case (A-Z) are split at `.,;:!?` and line ends into
    pieces, these at spaces and tabs into words. A phrase of 2 to `longest` words within a piece that occurs a >= `least`
    times is a candidate; a cut after its first k words gives l and r, the occurrences of both parts, and the score
    floor(1000000 a a / (l r)); its lowest cut counts, the first of equal ones. A candidate inside a longer one with at least
    `inside_percent` % of its occurrences is dropped. The first `top` by score, a and phrase remain; n counts the language's words.
    Null texts are empty, a null lang is `und`; repeated rows count each. `budget` is the number of suffixes a task may hold.
    """
    settle(docs.sparkSession)
    base = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    ones, phrases = counted(base, longest, least, budget)
    words = ones.where(F.col("f") >= least).select("lang", "word", "id", "f")
    of = ones.groupBy("lang").agg(F.sum("f").alias("n"))
    # every part of a candidate: words for their text, both sides of each cut for their counts
    spots = F.inline(F.expr("transform(ids, (x, i) -> named_struct('id', x, 'pos', i))"))
    named = matched(phrases.select("lang", "ids", "depth", spots), written(words, "words"), ["lang", "id"])
    named = named.groupBy("lang", "ids").agg(F.sort_array(F.collect_list(F.struct("pos", "word", "f"))).alias("w"))
    parts = phrases.where("depth > 2").select("lang", F.col("ids").alias("whole"), F.inline(F.expr(
        "flatten(transform(sequence(1, depth - 1), k -> array(named_struct('ids', slice(ids, 1, k), 'k', k, 'left', true), named_struct('ids', slice(ids, k + 1, depth - k), 'k', k, 'left', false))))")))
    parts = matched(parts.where("size(ids) > 1"), phrases.select("lang", "ids", "f"), ["lang", "ids"])
    parts = parts.groupBy("lang", F.col("whole").alias("ids")).agg(F.map_from_entries(F.collect_list(F.struct(F.concat("k", F.when(F.col("left"), F.lit("l")).otherwise("r")), "f"))).alias("inner"))
    all_ = phrases.join(named, ["lang", "ids"]).join(parts, ["lang", "ids"], "left")

    def cut(k):
        left = F.when(k == 1, F.col("w")[0]["f"]).otherwise(F.try_element_at("inner", F.concat(k, F.lit("l"))))
        right = F.when(k == F.col("depth") - 1, F.col("w")[F.col("depth") - 1]["f"]).otherwise(F.try_element_at("inner", F.concat(k, F.lit("r"))))
        return F.struct(_score(F.col("f"), left, right).alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    best = all_.select("lang", "ids", "depth", F.col("f").alias("a"), F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("phrase"),
                       F.array_min(F.transform(F.sequence(F.lit(1), F.col("depth") - 1), cut)).alias("cut"))
    inner = phrases.where("depth > 2").select("lang", F.col("f").alias("longer"), F.explode(F.expr(
        "flatten(transform(sequence(2, depth - 1), s -> transform(sequence(1, depth - s + 1), i -> slice(ids, i, s))))")).alias("ids"))
    inner = inner.groupBy("lang", "ids").agg(F.max("longer").alias("longer"))
    left = best.join(inner, ["lang", "ids"], "left").where(F.coalesce(F.col("longer") * 100 < F.col("a") * inside_percent, F.lit(True)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    flat_ = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("salt"))
    near = flat_.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    out = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return out.join(F.broadcast(of) if of.count() <= BROADCAST_ROWS else of, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
