"""Running totals, ranks and exact quantiles over groups of any size.

A window over one whole group would sort that group in a single task. Here equal values are summed first, the
group is cut into value ranges of about equal size, each range is one window, and the totals of the ranges (a
few hundred rows per group) are added on top. Cut points come from a hash-chosen set of the distinct values, so a
recomputed task sees the same ranges; they steer the partitioning only and never change a result.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import col

_PER_CUT = 8
#: Slices of a bracket, and the rows of a group from which on a bracket may hold too many values for one window.
SLICES, SLICE_FROM = 1024, 50_000_000


#: Distinct values that one range window is meant to hold, and bounds of the number of ranges of a group.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 200_000, 1024, 1 << 17


def _bucket(cuts: Column, steps: Column, v: Column) -> Column:
    """How many of the sorted cut points are <= v, by bisection with descending powers of two."""
    return F.aggregate(steps, F.lit(0), lambda acc, st: F.when(F.get(cuts, acc + st - 1) <= v, acc + st).otherwise(acc))


def _hint(by: list[str], few_groups: bool | None):
    """Broadcast only what has one row for each of few groups: without groups, or where the caller knows the bound."""
    return F.broadcast if few_groups or (few_groups is None and not by) else (lambda d: d)


def running_totals(df: DataFrame, key: str | Column, sums: dict[str, Column], by: list[str] | None = None,
                   descending: bool = False, buckets: int | None = None, few_groups: bool | None = None,
                   collapsed: bool = False) -> DataFrame:
    """Distinct `key` per group with `<name>`, `<name>_before` and `<name>_all` for every entry of `sums`.

    few_groups: the number of groups is bounded by the schema or a parameter (models, folds, classes), so the table of
    cut points is broadcast. Otherwise adaptive execution decides by its size. The number of ranges of a group follows
    its distinct values, unless `buckets` (rounded up to a power of two) sets it.
    collapsed: rows are already unique per (group, key), no aggregation is needed.
    """
    by = list(by or [])
    hint = _hint(by, few_groups)
    base = df.select(*by, col(key).alias("key"), *[c.alias(n) for n, c in sums.items()]).where("key is not null")
    if not by:
        by = ["_g"]
        base = base.withColumn("_g", F.lit(0))
    if collapsed:  # one shuffle that all four readers below share, instead of four runs of the input
        base = base.repartition(*by, "key")
    else:
        base = base.groupBy(*by, "key").agg(*[F.sum(n).alias(n) for n in sums])
    sizes = base.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    power = F.ceil(F.log2(F.least(F.greatest(F.col("_n") / RANGE_ROWS, F.lit(float(LEAST_RANGES))), F.lit(float(MOST_RANGES))))).cast("int")
    power = F.lit(max(1, (buckets - 1).bit_length())) if buckets else power
    ranges_of = F.pow(F.lit(2.0), F.col("_p")).cast("int")
    sizes = sizes.withColumn("_p", power)
    every = F.greatest(F.lit(1), F.floor(F.col("_n") / (ranges_of * _PER_CUT)))
    picked = base.select(*by, "key").join(hint(sizes), by).where(F.pmod(F.xxhash64("key"), every) == 0)
    cuts = (picked.groupBy(*by).agg(F.sort_array(F.collect_list("key")).alias("_k"), F.first("_p").alias("_p"))
            .select(*by, F.transform(F.sequence(F.lit(1), ranges_of - 1), lambda i: F.get(
                F.col("_k"), F.floor(i.cast("bigint") * F.size("_k") / ranges_of).cast("int"))).alias("_cuts"),
                F.transform(F.sequence(F.col("_p") - 1, F.lit(0), F.lit(-1)), lambda e: F.pow(F.lit(2.0), e).cast("int")).alias("_steps")))
    cut = (base.join(hint(cuts), by, "left")
           .withColumn("_b", F.coalesce(_bucket(F.col("_cuts"), F.col("_steps"), F.col("key")), F.lit(0))).drop("_cuts", "_steps"))
    order = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    inside = W.partitionBy(*by, "_b").orderBy(order("key")).rowsBetween(W.unboundedPreceding, -1)
    rows = cut.select("*", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"_{n}_in") for n in sums])
    ranges = cut.groupBy(*by, "_b").agg(*[F.sum(n).alias(n) for n in sums])
    prior = W.partitionBy(*by).orderBy(order("_b")).rowsBetween(W.unboundedPreceding, -1)
    offs = ranges.select(*by, "_b",
                         *[F.coalesce(F.sum(n).over(prior), F.lit(0)).alias(f"_{n}_off") for n in sums],
                         *[F.sum(n).over(W.partitionBy(*by)).alias(f"{n}_all") for n in sums])
    out = rows.join(hint(offs), [*by, "_b"])
    keep = [c for c in by if c != "_g"]
    return out.select(*keep, "key", *sums, *[f"{n}_all" for n in sums],
                      *[(F.col(f"_{n}_in") + F.col(f"_{n}_off")).alias(f"{n}_before") for n in sums])


def exact_quantiles(df: DataFrame, value: str | Column, probs: dict[str, float], by: list[str] | None = None,
                    few_groups: bool | None = None, accuracy: int = 10000, higher: bool = False) -> DataFrame:
    """Exact quantiles per group, one column per entry of `probs` (linear interpolation, or the upper of the two
    neighbours with `higher`).

    A mergeable sketch brackets each order statistic; a second pass counts what lies below the bracket and keeps
    only the values inside it. Both passes combine on the map side. What is inside a bracket is cut into SLICES equal
    slices of it, each a window of its own, so no group and no bracket is ever sorted as a whole.
    """
    by = list(by or [])
    hint = _hint(by, few_groups)
    base = df.select(*by, col(value).cast("double").alias("v")).where("v is not null")
    if not by:
        by = ["_g"]
        base = base.withColumn("_g", F.lit(0))
    names = list(probs)
    # The sketch may be off by a rank or two in small groups and by n / accuracy in large ones: the bracket spans at
    # least three ranks either way at every size (groups of up to 30 take their whole range).
    tiers = [(30, 1.0), (1000, 0.1), (30 * accuracy // 10, 0.003), (None, 3.0 / accuracy)]
    points = [p for q in names for _, d in tiers for p in (max(0.0, probs[q] - d), min(1.0, probs[q] + d))]
    sketch = base.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(
        "v", [float(p) for p in points], accuracy).alias("a"))
    tier = F.lit(0)
    for limit, _ in tiers[:-1]:
        tier = tier + (F.col("n") > limit).cast("int")
    at0 = tier * 2
    edges = [(F.col(f"_lo{i}"), F.col(f"_hi{i}")) for i in range(len(names))]
    packed = sketch.select(*by, "n", *[F.get("a", at0 + 2 * len(tiers) * i + s).alias(f"_{e}{i}") for i in range(len(names)) for s, e in ((0, "lo"), (1, "hi"))],
                           F.when(F.col("n") > SLICE_FROM, float(SLICES)).otherwise(1.0).alias("_s"))
    # every row goes to one cell: its own value inside a bracket, else the gap between brackets it lies in; plain expressions
    # over columns, as the number of brackets is known here
    v = F.col("v")
    x = base.join(hint(packed), by)
    inside = reduce(lambda p, q: p | q, [(v >= lo) & (v <= hi) for lo, hi in edges])
    gap = reduce(lambda p, q: p + q, [(hi < v).cast("int") for _, hi in edges])
    # rises with v: slices of every bracket that lie below it; one slice where a bracket can't hold many values
    part = lambda lo, hi: F.when(v <= lo, 0).when(v >= hi, F.col("_s").cast("int")).otherwise(((v - lo) * F.col("_s") / (hi - lo)).cast("int"))
    below = reduce(lambda p, q: p + q, [part(lo, hi) for lo, hi in edges])
    cells = (x.select(*by, "v", inside.alias("in"), gap.alias("gap"), below.alias("slice"))
             .groupBy(*by, "slice", F.when(F.col("in"), v).alias("cell"), F.when(~F.col("in"), F.col("gap")).alias("gap"))
             .agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("first_v"), F.max("v").alias("last_v")))
    w = W.partitionBy(*by, "slice").orderBy("first_v").rowsBetween(W.unboundedPreceding, -1)
    prior = W.partitionBy(*by).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices = cells.groupBy(*by, "slice").agg(F.sum("c").alias("c")).select(*by, "slice", F.coalesce(F.sum("c").over(prior), F.lit(0)).alias("off"))
    cum = cells.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0))).join(slices, [*by, "slice"]).withColumn("before", F.col("before") + F.col("off"))

    def ranks(q):
        rank = q * (F.col("n") - 1)
        low = F.floor(rank + 1e-9) if not higher else F.ceil(rank - 1e-9)
        return low, F.least(low + 1, F.col("n") - 1), F.greatest(rank - F.floor(rank + 1e-9), F.lit(0.0))

    def holds(b):  # only the quantiles of which this cell has a rank
        low, high, _ = ranks(b["q"])
        return (high >= F.col("before")) & (low < F.col("before") + F.col("c"))

    asked = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(probs[q])).alias("q")) for i, q in enumerate(names)])
    cum = cum.join(hint(packed.select(*by, "n")), by).select(*by, "cell", "c", "first_v", "last_v", "before", "n", F.explode(F.filter(asked, holds)).alias("b")).select("*", "b.i", "b.q")
    lo_r, hi_r, frac = ranks(F.col("q"))
    cum = cum.withColumn("r0", lo_r).withColumn("r1", hi_r).withColumn("fr", frac)

    def at(r: str) -> Column:
        first, last = F.col("before"), F.col("before") + F.col("c") - 1
        known = F.when(F.col("cell").isNotNull() & (F.col(r) >= first) & (F.col(r) <= last), F.col("cell")) \
            .when(F.col(r) == first, F.col("first_v")).when(F.col(r) == last, F.col("last_v"))
        return F.max(known)

    got = cum.groupBy(*by, "i").agg(at("r0").alias("v0"), at("r1").alias("v1"), F.first("fr").alias("fr"))
    val = F.col("v0") if higher else F.col("v0") + F.col("fr") * (F.col("v1") - F.col("v0"))
    safe = F.when(F.col("v0").isNull() | F.col("v1").isNull(),
                  F.raise_error(F.lit("quantile bracket missed its rank"))).otherwise(val)
    keep = [c for c in by if c != "_g"]
    out = got.withColumn("val", safe).groupBy(*by).agg(
        *[F.max(F.when(F.col("i") == i, F.col("val"))).alias(q) for i, q in enumerate(names)])
    return out.select(*keep, *names)


def grouped_quantiles(df: DataFrame, value: str | Column, probs: dict[str, float], by: list[str], weight: str | None = None) -> DataFrame:
    """Exact quantiles of many groups, none of which holds more than a task may sort (a day, or a day of a cohort).

    Equal values are counted before the one shuffle, then each group is one window over its distinct values. The rows are read once and
    no sketch is kept for a group, of which a task may see thousands. weight: rows that a row stands for."""
    c = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.select(*by, col(value).cast("double").alias("v"), *([weight] if weight else [])).where("v is not null").groupBy(*by, "v").agg(c.alias("c"))
    group = W.partitionBy(*by)
    upto = group.orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    x = counts.select(*by, "v", "c", F.sum("c").over(upto).alias("_to"), F.sum("c").over(group).alias("_n"))
    return quantiles_of_counts(x, probs, by)


def counted_quantiles(df: DataFrame, value: str, probs: dict[str, float], by: list[str], weight: str) -> DataFrame:
    """Exact quantiles of groups of any size from rows that stand for `weight` rows each."""
    t = running_totals(df, F.col(value).cast("double"), {"c": F.col(weight)}, by)
    return quantiles_of_counts(t.select(*by, F.col("key").alias("v"), "c", (F.col("c_before") + F.col("c")).alias("_to"), F.col("c_all").alias("_n")), probs, by)


def weighted_quantiles(df: DataFrame, value: str, probs: dict[str, float], weights: dict[str, Column], name: str) -> DataFrame:
    """Exact quantiles of one column under several weights (whole numbers of rows), over any number of rows: a row for each
    weight (its key in `name`). Equal values are counted first, for all weights at once."""
    keys = list(weights)
    t = running_totals(df, F.col(value).cast("double"), {f"w{i}": weights[k] for i, k in enumerate(keys)}).where("key is not null")
    one = lambda i, k: F.struct(F.lit(k).alias(name), F.col(f"w{i}").alias("c"), (F.col(f"w{i}_before") + F.col(f"w{i}")).alias("_to"), F.col(f"w{i}_all").alias("_n"))
    x = t.select(F.col("key").alias("v"), F.explode(F.array(*[one(i, k) for i, k in enumerate(keys)])).alias("_w")).select("v", "_w.*").where("c > 0")
    return quantiles_of_counts(x, probs, [name])


def quantiles_of_counts(x: DataFrame, probs: dict[str, float], by: list[str]) -> DataFrame:
    """Quantiles (linear interpolation) from distinct values v with their count c, the rows up to them `_to` and of the group `_n`."""
    out, wanted = {}, F.lit(False)
    for name, q in probs.items():
        rank = F.lit(float(q)) * (F.col("_n") - 1)
        low = F.floor(rank + 1e-9)
        high = F.least(low + 1, F.col("_n") - 1)
        at = lambda r: (r >= F.col("_to") - F.col("c")) & (r < F.col("_to"))
        wanted = wanted | at(low) | at(high)
        v0, v1 = F.max(F.when(at(low), F.col("v"))), F.max(F.when(at(high), F.col("v")))
        out[name] = v0 + F.first(F.greatest(rank - low, F.lit(0.0))) * (v1 - v0)
    return x.where(wanted).groupBy(*by).agg(*[c.alias(n) for n, c in out.items()])


def global_quantiles(df: DataFrame, value, probs: dict[str, float], **kw) -> Column:
    """The quantiles of a whole column as a scalar struct usable in any expression."""
    return exact_quantiles(df, value, probs, **kw).select(F.struct(*probs).alias("q")).scalar()


def mean_ranks(df: DataFrame, key: str, by: list[str] | None = None, **kw) -> DataFrame:
    """Distinct key with its average rank (ties share it), its count and the group size."""
    t = running_totals(df, key, {"c": F.lit(1)}, by, **kw)
    return t.select(*(by or []), "key", "c", F.col("c_all").alias("n"),
                    (F.col("c_before") + (F.col("c") + 1) / 2.0).alias("rank"))
