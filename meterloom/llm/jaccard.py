"""Exact Jaccard self-join on word n-grams by vertical partitioning, and the classes of linked documents.

The global order of n-grams is the order of their hashes. It is cut into fragments, and so is every document's set.

* Candidates. Two sets with similarity >= t differ in at most d elements, d given by their size class; cut into more than
  d fragments, one non-empty fragment is equal in both (pigeonhole). Documents meet on hashes of whole fragments, so a
  passage that many documents share makes no candidates unless it is nearly all of them. A set with too many empty
  fragments also sends the elements of its prefix. No pair of similar sets is lost.
* Equal sets are one node. A group of near copies is first tied to its best connected member; pairs inside one class are
  then never formed. What is still apart and shares a fragment is paired under an exact bound: the bits in which two
  512-bit parity sketches differ are at most the elements in which the sets differ.
* Verification. Texts of paired sets are read again for sketches as wide as the set is large, under the same bound; for the
  pairs it leaves, the overlap is counted in each of a few wider fragments separately and summed.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import flat
from .graph import components
from .shared_keys import ABOUT, shared, tags
from .staging import delete, made, matched, settle, written

U = np.uint64
WORDS = 8
BITS = [f"b{i}" for i in range(WORDS)]
#: Fragments of the verification; a fixed number of rows for each pair.
PARTS = 4
#: Stands for a null doc_id.
NO_ID = (1 << 63) - 1
#: Ties to hubs are looked for on one in so many keys; this only saves work, all keys are paired afterwards.
HUB_KEYS = 8

#: about, of ABOUT rows only: doc_id, n and the sketch.
SCHEMA = "key long, owner long, tag int, about array<long>"


def classes(percent: int, top: int = 1 << 40) -> np.ndarray:
    """Lower bounds of size classes: similar sets are in one class or in two that follow each other."""
    out = [1]
    while out[-1] < top:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out)


def differ(bounds: np.ndarray, c: int, percent: int) -> int:
    """Most elements in which two similar sets differ, the smaller one of class c."""
    most = int(bounds[c + 1]) - 1
    return (100 - percent) * (most + most * 100 // percent) // (100 + percent)


def fragments(n: int, d: int) -> int:
    """Fewest fragments of which a set of n elements leaves more than d non-empty, but for two deviations of chance."""
    f = d + 1
    while d and f < 8 * d + 8:
        rate = n / f
        empty = np.exp(-rate)
        if f * (1 - empty) - 2 * np.sqrt(f * empty * (1 - (1 + rate) * empty)) >= d + 1:
            break
        f += 1 + f // 100
    return f


def fragment_keys(u: np.ndarray, scheme: int, d: int, f: int, percent: int) -> np.ndarray:
    """Keys of the sorted set `u` cut into `f` fragments for sets that differ in at most `d` elements."""
    part = ((u >> U(32)) * U(f)) >> U(32)
    heads = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    out = flat.mix(np.add.reduceat(flat.mix(u ^ U(0x5851F42D4C957F2D)), heads) + (part[heads] + U(scheme << 40)) * U(0x9FB21C651E98DF25))
    if len(heads) <= d:  # other sets of this kind might share empty fragments only: their prefixes meet
        prefix = len(u) - -(-percent * len(u) // 100) + 1
        out = np.concatenate([out, flat.mix(u[:prefix] ^ U((scheme << 8) + 0x1000000000000001))])
    return out


def set_id(u: np.ndarray) -> int:
    """Hash of a whole set."""
    with np.errstate(over="ignore"):
        return int(flat.mix(np.array([np.add.reduce(flat.mix(u ^ U(0x2545F4914F6CDD1D))) ^ U(len(u))]))[0])


def document_sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingle hashes of every document of a batch."""
    data, off = flat.texts(batch)
    for i, j in flat.runs(off):
        b, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
        _, _, h, wo = flat.words(b, o, flat.LOWER)
        doc, v = flat.shingles(h, wo, k)
        at = np.searchsorted(doc, np.arange(j - i + 1))
        for d in range(j - i):
            yield i + d, np.unique(v[at[d]:at[d + 1]])


def _scan(k: int, percent: int):
    bounds = classes(percent)
    allowed: dict[int, tuple[int, int]] = {}

    def cut(c: int) -> tuple[int, int]:
        if c not in allowed:
            d = differ(bounds, c, percent)
            allowed[c] = d, fragments(int(bounds[c]), d)
        return allowed[c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys, owners, seen, about = [], [], set(), []
            for row, u in document_sets(batch, k):
                n = len(u)
                own = set_id(u) if n else 0
                if n and own not in seen:
                    seen.add(own)
                    c = int(np.searchsorted(bounds, n, "right")) - 1
                    for s in {c, max(0, c - 1)}:
                        got = fragment_keys(u, s, *cut(s), percent)
                        keys.append(got)
                        owners.append(np.full(len(got), own, U))
                odd = np.packbits((np.bincount((u & U(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1).astype(np.uint8))
                about.append((ids[row], own, n, odd.view(np.int64)))
            key = np.concatenate([*keys, np.empty(0, U)])
            owner = np.concatenate([*owners, np.empty(0, U)])
            m, a = len(key), len(about)
            docs = np.array([x[0] for x in about], np.int64)
            info = np.array([[x[0], x[2], *x[3]] for x in about], np.int64).reshape(a, WORDS + 2)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[np.zeros(m, np.int32), np.arange(a + 1, dtype=np.int32) * (WORDS + 2)].astype(np.int32)), pa.array(info.ravel()), mask=pa.array(np.r_[np.ones(m, bool), np.zeros(a, bool)]))
            yield pa.RecordBatch.from_arrays([
                pa.array(flat.signed(np.concatenate([key, docs.view(U)]))),
                pa.array(flat.signed(np.concatenate([owner, np.array([x[1] for x in about], U)]))),
                pa.array(np.concatenate([tags(key, owner), np.full(a, ABOUT, np.int32)])), lists], ["key", "owner", "tag", "about"])
        flat.release()

    return run


def wide_sketch(u: np.ndarray) -> np.ndarray:
    """Parity sketch of a set of any size: a power of two of bits, no fewer than elements; its halves add up to the next smaller one."""
    bits = max(64, 1 << (len(u) - 1).bit_length())
    return np.packbits((np.bincount((u & U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def _parts(k: int):
    """owner, number of elements, and the set's elements in each of PARTS fragments of the order; its wide sketch as part -1."""
    def run(batches):
        for batch in batches:
            own, n, part, each = [], [], [], []
            ids = batch.column(batch.schema.get_field_index("owner")).to_numpy(zero_copy_only=False)
            for row, u in document_sets(batch, k):
                if not len(u) or set_id(u) != int(ids[row]) % (1 << 64):  # another row of the same doc_id
                    continue
                cut = np.searchsorted(u >> U(32), (np.arange(PARTS + 1) * (1 << 32) // PARTS).astype(U))
                for p in range(-1, PARTS):
                    own.append(ids[row])
                    n.append(len(u))
                    part.append(p)
                    each.append(wide_sketch(u) if p < 0 else flat.signed(u[cut[p]:cut[p + 1]]))
            sizes = np.r_[0, np.cumsum([len(x) for x in each])].astype(np.int32)
            flat_values = pa.array(np.concatenate([*each, np.empty(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(n, pa.int64()), pa.array(part, pa.int32()), pa.ListArray.from_arrays(pa.array(sizes), flat_values)], ["owner", "n", "part", "items"])

    return run


def _within(percent: int, apart):
    """Size and parity bounds of a pair (x, y) whose sketches differ in `apart` bits; false only if the sets aren't similar."""
    least, most = F.least("nx", "ny"), F.greatest("nx", "ny")
    return (least * 100 >= most * percent) & (apart * (100 + percent) <= (F.col("nx") + F.col("ny")) * (100 - percent))


def _may_link(percent: int):
    return _within(percent, sum((F.bit_count(F.col(f"x{b}").bitwiseXOR(F.col(f"y{b}"))) for b in BITS), F.lit(0)))


def _sides(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (x, y) for each part, with sizes nx, ny and the parts' elements xs, ys."""
    left = parts.select(F.col("owner").alias("x"), F.col("n").alias("nx"), "part", F.col("items").alias("xs"))
    right = parts.select(F.col("owner").alias("y"), F.col("n").alias("ny"), "part", F.col("items").alias("ys"))
    return pairs.join(left, "x").join(right, ["y", "part"])


def _near(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (x, y), those that the bound leaves on wide sketches: all similar ones, and of long sets few others."""
    both = _sides(pairs, parts.where("part < 0"))
    short, long = F.when(F.size("xs") <= F.size("ys"), F.col("xs")).otherwise(F.col("ys")), F.when(F.size("xs") <= F.size("ys"), F.col("ys")).otherwise(F.col("xs"))
    both = both.select("x", "y", "nx", "ny", short.alias("short"), long.alias("long"))
    width = F.size("short")
    folds = F.sequence(F.lit(0), F.floor(F.size("long") / width).cast("int") - 1)
    word = lambda i: F.aggregate(folds, F.get("short", i), lambda acc, j: acc.bitwiseXOR(F.get("long", i + j * width)))
    apart = F.aggregate(F.sequence(F.lit(0), width - 1), F.lit(0), lambda acc, i: acc + F.bit_count(word(i)))
    return both.where(_within(percent, apart)).select("x", "y").distinct()  # a set may be there twice


def _verified(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (x, y), those whose partial overlaps sum up to a similar pair."""
    partial = _sides(pairs, parts).select("x", "y", "nx", "ny", "part", F.size(F.array_intersect("xs", "ys")).alias("part_overlap"))
    partial = partial.groupBy("x", "y", "nx", "ny", "part").agg(F.max("part_overlap").alias("part_overlap"))  # a set may be there twice
    overlap = partial.groupBy("x", "y", "nx", "ny").agg(F.sum("part_overlap").alias("overlap"))
    return overlap.where(F.col("overlap") * 100 >= (F.col("nx") + F.col("ny") - F.col("overlap")) * percent).select("x", "y")


def linked(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `docs` (doc_id, text; other columns are not looked at).

    Words are what ASCII white space parts, A-Z in lower case. A document with fewer than k words has one shingle; a
    null, empty or blank text has none, links with nothing and is its own component. Rows that repeat a doc_id stay rows.
    component_id is the least doc_id that links reach; a null doc_id counts as the row's own and greater than others.
    """
    spark = docs.sparkSession
    settle(spark)
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    rows = written(shared(base.mapInArrow(_scan(k, percent), SCHEMA)), "fragments")
    about = rows.where(F.col("tag") == ABOUT).select("owner", *(F.get("about", F.lit(i)).alias(c) for i, c in enumerate(["doc_id", "n", *BITS])))
    meet = rows.where(F.col("tag") != ABOUT).select("key", "owner")
    nodes = about.where("n > 0").groupBy("owner").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), *(F.first(b).alias(b) for b in BITS))

    met = meet.groupBy("owner").agg(F.count("*").alias("keys"))
    live = written(nodes.join(met, "owner"), "nodes")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Similar pairs of `pairs`. One text for each set of a pair is read; elements of pairs that the wide sketches leave are compared."""
        def members(of: DataFrame) -> DataFrame:
            return of.select(F.explode(F.array("x", "y")).alias("owner")).distinct()

        pairs = written(pairs, name)
        chosen = matched(base, written(live.select("doc_id", "owner").join(members(pairs), "owner"), "chosen"), "doc_id")
        parts = written(chosen.mapInArrow(_parts(k), "owner long, n long, part int, items array<long>"), "parts")
        mine = made[-1]
        near = written(_near(pairs, parts, percent), f"{name}-near")
        whole = matched(parts.where("part >= 0"), written(members(near), "members"), "owner", "left_semi")
        out = written(_verified(near, whole, percent), f"{name}-verified")
        delete(spark, [mine])
        return out

    # Ties to the best connected set of each key.
    hub = F.struct((-F.col("keys")).alias("keys"), "owner")
    some = meet.where(F.pmod("key", F.lit(HUB_KEYS)) == 0).distinct().join(live.select("owner", "keys"), "owner")
    centre = some.groupBy("key").agg(F.min(hub)["owner"].alias("x"))
    ties = some.select("key", F.col("owner").alias("y")).join(centre, "key").where("x <> y").select("x", "y").distinct()

    def sketch(side):
        return live.select(F.col("owner").alias(side), F.col("n").alias(f"n{side}"), *(F.col(b).alias(f"{side}{b}") for b in BITS))

    ties = ties.join(sketch("x"), "x").join(sketch("y"), "y").where(_may_link(percent)).select("x", "y")
    tied = verified(ties, "ties")

    # Sets that share a key and are not in one class yet.
    first = components(tied.select(F.col("x").alias("a"), F.col("y").alias("b")))
    first = live.join(first.withColumnRenamed("node", "owner"), "owner", "left").select("owner", F.coalesce("root", "owner").alias("root"), "n", *BITS)
    w = Window.partitionBy("key")
    apart = meet.distinct().join(first.select("owner", "root"), "owner").withColumns({"lo": F.min("root").over(w), "hi": F.max("root").over(w)}).where("lo <> hi")
    apart = written(apart.select("key", "owner", "root"), "apart")
    wide = apart.join(first.drop("root"), "owner")

    def side(s):
        return wide.select("key", F.col("owner").alias(s), F.col("root").alias(f"r{s}"), F.col("n").alias(f"n{s}"), *(F.col(b).alias(f"{s}{b}") for b in BITS))

    pairs = side("x").join(side("y"), "key").where((F.col("x") < F.col("y")) & (F.col("rx") != F.col("ry")) & _may_link(percent)).select("x", "y").distinct()
    found = verified(pairs, "pairs")
    links = tied.union(found).select(F.col("x").alias("a"), F.col("y").alias("b"))

    root = components(links).withColumnRenamed("node", "owner")
    named = about.join(root, "owner", "left").withColumn("root", F.coalesce("root", "owner"))
    named = written(named.select("doc_id", "n", "root"), "named")
    least = written(named.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    out = matched(named.where("n > 0"), least, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    out = out.union(named.where("n = 0").select("doc_id", "n", "doc_id"))
    return out.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_shingles", F.nullif("component_id", F.lit(NO_ID)).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """`docs` without the documents that are linked with one of smaller doc_id; blank texts and null ids stay."""
    other = written(linked(docs, k, percent).where("doc_id <> component_id").select("doc_id").distinct(), "repeats")
    return matched(docs, other, "doc_id", "left_anti")
