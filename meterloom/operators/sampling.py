"""Splits, weights, balancing and synthetic changes of series."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .folds import mixed
from .neighbours import lists_by_fold, nearest_neighbours, without_fold
from .panel import DAY, ID, whole
from .ranking import running_totals


def group_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """group -> fold, groups are never split. Groups large enough to unbalance a fold (fewer than 10 k of them) are
    placed one by one on the emptiest fold; all others by an integer mix."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    heavy = sorted(((r.n, r[group]) for r in g.withColumn("_t", total).where(F.col("n") * 10 * k > F.col("_t")).collect()), key=lambda x: (-x[0], str(x[1])))
    load = [0] * k
    placed = []
    for n, name in heavy:
        f = load.index(min(load))
        load[f] += n
        placed.append((name, f))
    whole_number = dict(df.dtypes)[group] in ("tinyint", "smallint", "int", "bigint")
    light = F.pmod(mixed(group) if whole_number else F.xxhash64(group), F.lit(k)).cast("int")
    if not placed:
        return g.select(group, light.alias("fold"))
    typ = dict(df.dtypes)[group]
    fixed = df.sparkSession.createDataFrame(placed, f"{group} {typ}, _f int")
    return g.join(F.broadcast(fixed), group, "left").select(group, F.coalesce("_f", light).alias("fold"))


def permuted(df: DataFrame, value: str, id_col: str = "id", seed: int = 7) -> DataFrame:
    """id with the value of another row: rank by id joined to rank by a mixed id."""
    a = running_totals(df, F.col(id_col), {"c": F.lit(1)}, collapsed=True).select(F.col("key").alias(id_col), F.col("c_before").alias("_r"))
    key = F.struct(mixed(id_col, seed).alias("h"), F.col(id_col).alias("i"), F.col(value).alias("v"))
    b = running_totals(df, key, {"c": F.lit(1)}, collapsed=True).select(F.col("key.v").alias(f"{value}_permuted"), F.col("c_before").alias("_r"))
    return a.join(b, "_r").drop("_r")


def leave_one_out_splits(df: DataFrame, types: list, type_col: str) -> DataFrame:
    """Long form: every row once per held-out type with its role (rows of the type test, all others train)."""
    return df.withColumn("held_out", F.explode(F.array(*[F.lit(t) for t in types]))).withColumn("role", F.when(F.col(type_col) == F.col("held_out"), "test").otherwise("train"))


def class_weights(folds: DataFrame, k: int) -> DataFrame:
    """Negatives per positive in the training part of every fold."""
    x = folds.withColumn("train_for", F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold"))))
    return x.groupBy(F.col("train_for").alias("fold")).agg((F.count_if(F.col("y") == 0) / F.greatest(F.count_if(F.col("y") == 1), F.lit(1))).alias("pos_weight"))


def case_weights(agreement: Column, hard: Column, weak: Column) -> dict[str, Column]:
    """Confidence weight 0.1 + 0.9 a, tenfold weight of hard cases, 1 + 3 e of weakly labelled ones."""
    return {"w_confident": 0.1 + 0.9 * agreement, "w_hard": F.when(hard, 10.0).otherwise(1.0), "w_weak": 1.0 + 3.0 * weak}


def unit_random(*cols) -> Column:
    """Uniform [0, 1) from a hash: the same on every attempt of a task."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)


def smote(df: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic minority rows on the line to one of the k nearest minority rows, until the classes have equal size.

    df: id, y, vec. Returns the input rows and the synthetic ones, numbered downwards from below the least id and 0."""
    n = {r.y: r.n for r in df.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    small = min(n, key=n.get)
    minority = df.where(F.col("y") == small).select("id", "vec")
    need = max(n.values()) - n[small]
    rank = running_totals(minority, F.col("id"), {"c": F.lit(1)}, collapsed=True).select(F.col("key").alias("id"), "c_before")
    each, more = divmod(need, n[small])
    least = min(0, df.agg(F.min("id")).first()[0])
    per = F.lit(each) + (F.col("c_before") < more).cast("int")  # exactly `need` in all
    made_before = F.col("c_before") * each + F.least(F.col("c_before"), F.lit(more))
    e = nearest_neighbours(minority, minority, k).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "nid"))).alias("near"))
    copies = e.join(rank, "id").withColumn("per", per).where("per > 0").select("id", "near", made_before.cast("long").alias("made"), F.explode(F.sequence(F.lit(1), F.col("per"))).alias("copy"))
    pick = F.get("near", F.floor(unit_random(F.lit(seed + 1), "id", "copy") * F.size("near")).cast("int"))
    c = copies.withColumn("nid", pick["nid"]).withColumn("u", unit_random(F.lit(seed + 2), "id", "copy"))
    x = c.join(minority, "id").join(minority.select(F.col("id").alias("nid"), F.col("vec").alias("nvec")), "nid")
    vec = F.zip_with("vec", "nvec", lambda a, b: a + F.col("u") * (b - a))
    new = x.select((F.lit(least) - F.col("made") - F.col("copy")).alias("id"), F.lit(small).alias("y"), vec.alias("vec"))
    return df.select("id", "y", "vec").unionByName(new)


def _training_parts(df: DataFrame, folds: int) -> DataFrame:
    """Every row once for each fold it is trained without."""
    return df.withColumn("without", F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("fold"))))


def smote_by_fold(df: DataFrame, folds: int, k: int = 5, seed: int = 42) -> DataFrame:
    """without, id, copy, partner, y, vec: for every fold the training rows of the others (copy 0) and synthetic rows of
    their smaller class, on the line from row `id` to `partner`, until both classes are equally many.

    df: id, y, fold, vec. Neighbours come from rows of the same training part only: one search keeps the k nearest of each
    fold, and lists without a fold follow from it. A part whose smaller class has a single row or none stays as it is.
    """
    parts = _training_parts(df, folds)
    n = parts.groupBy("without", "y").agg(F.count(F.lit(1)).alias("n"))
    sizes = n.groupBy("without").agg(F.min_by("y", F.struct("n", "y")).alias("small"), F.min("n").alias("few"), F.max("n").alias("many"), F.count(F.lit(1)).alias("classes"))
    sizes = cut_lineage(sizes.where("classes = 2"))  # a row for each fold
    lists = None
    for y in sorted(r.small for r in sizes.select("small").distinct().collect()):
        own = df.where(F.col("y") == y)
        found = without_fold(lists_by_fold(own.select("id", "vec"), own, k, folds), k, folds).withColumn("y", F.lit(y))
        lists = found if lists is None else lists.unionByName(found)
    real = parts.select("without", "id", F.lit(0).cast("long").alias("copy"), F.lit(None).cast("long").alias("partner"), "y", "vec")
    if lists is None:
        return real
    near = lists.groupBy("id", "without", "y").agg(F.array_sort(F.collect_list(F.struct("rank", "nid"))).alias("near"))
    small = parts.join(F.broadcast(sizes), "without").where("y = small")
    place = running_totals(small, "id", {"c": F.lit(1)}, by=["without"], collapsed=True, few_groups=True).select("without", F.col("key").alias("id"), "c_before")
    rows = small.join(place, ["without", "id"]).join(near, ["id", "without", "y"])
    need = F.col("many") - F.col("few")
    per = F.floor(need / F.col("few")) + (F.col("c_before") < need % F.col("few")).cast("long")
    copies = rows.withColumn("per", per).where("per > 0").select("without", "id", "y", "vec", "near", F.explode(F.sequence(F.lit(1).cast("long"), F.col("per"))).alias("copy"))
    pick = F.get("near", F.floor(unit_random(F.lit(seed + 1), "without", "id", "copy") * F.size("near")).cast("int"))["nid"]
    drawn = copies.select("without", "id", "copy", pick.alias("partner"), "y", "vec", unit_random(F.lit(seed + 2), "without", "id", "copy").alias("u"))
    other = df.select(F.col("id").alias("partner"), F.col("vec").alias("pvec"))
    made = drawn.join(other, "partner").select("without", "id", "copy", "partner", "y", F.zip_with("vec", "pvec", lambda a, b: a + F.col("u") * (b - a)).alias("vec"))
    return real.unionByName(made)


def balanced_folds(df: DataFrame, folds: int, k: int = 5, seed: int = 42) -> DataFrame:
    """smote_by_fold() without Tomek links: in each training part, pairs of mutual nearest rows of opposite class go."""
    x = cut_lineage(smote_by_fold(df, folds, k, seed))
    key = F.struct("id", "copy")
    number = running_totals(x, key, {"c": F.lit(1)}, by=["without"], collapsed=True, few_groups=True).select("without", F.col("key.id").alias("id"), F.col("key.copy").alias("copy"), F.col("c_before").cast("long").alias("row"))
    x = cut_lineage(x.join(number, ["without", "id", "copy"]))
    out = None
    for f in range(folds):
        own = x.where(F.col("without") == f)
        left = remove_tomek_links(own.select(F.col("row").alias("id"), "y", "vec")).select(F.col("id").alias("row"))
        part = own.join(left, "row", "left_semi")
        out = part if out is None else out.unionByName(part)
    return out.drop("row")


def remove_tomek_links(df: DataFrame) -> DataFrame:
    """Drop pairs of mutual nearest neighbours of opposite class."""
    e = cut_lineage(nearest_neighbours(df.select("id", "vec"), df.select("id", "vec"), 1).select("id", "nid"))  # read twice
    y = df.select("id", "y")
    back = e.select(F.col("id").alias("nid"), F.col("nid").alias("id"))
    links = e.join(back, ["id", "nid"]).join(y, "id").join(y.select(F.col("id").alias("nid"), F.col("y").alias("ny")), "nid").where("y <> ny").select("id")
    return df.join(links, "id", "left_anti")


def mixup(df: DataFrame, seed: int = 42) -> DataFrame:
    """Convex mix of every row with a permuted partner: features and soft label."""
    p = permuted(df, "id", "id", seed).withColumnRenamed("id_permuted", "pid")
    other = df.select(F.col("id").alias("pid"), F.col("y").alias("py"), F.col("vec").alias("pvec"))
    x = df.join(p, "id").join(other, "pid").withColumn("lam", mixed("id", seed) / 10007.0)
    return x.select("id", "pid", "lam", (F.col("lam") * F.col("y") + (1 - F.col("lam")) * F.col("py")).alias("y"), F.zip_with("vec", "pvec", lambda a, b: F.col("lam") * a + (1 - F.col("lam")) * b).alias("vec"))


ATTACKS = ("point", "contextual", "collective", "scale_global", "zero_interval", "scale_local", "subtract_random", "subtract_mean",
           "reverse_daily", "slight_scale", "cap_max", "reduce_night", "flatten", "long_zero", "scale_down", "flatline", "mixed")


def tamper(df: DataFrame, v: str = "f", attacks: tuple[str, ...] = ATTACKS) -> DataFrame:
    """Synthetic changes of every series, one output row per day and attack. All are per-row rules on the dense panel;
    the mirrored value comes from a self-join on (series, mirrored day)."""
    d, n = F.col(DAY), F.col("n_days")
    mirror = df.select(ID, (F.col("n_days") - 1 - F.col(DAY)).alias(DAY), F.col(v).alias("_rev"))
    x = df.join(mirror, [ID, DAY]).withColumn("_mu", F.avg(v).over(whole())).withColumn("_mx", F.max(v).over(whole()))
    x = x.withColumn("_noise", ((F.col(ID) * 7919 + d * 104729 + 42) % 10007) / 10007.0)
    q1, q2, q3 = F.floor(n / 4), F.floor(n / 2), F.floor(3 * n / 4)
    mid = (d >= q1) & (d < q3)
    f = F.col(v)
    rule = {"point": F.when(d % 37 == 0, f * 3).otherwise(f), "contextual": F.when(mid & (d % 7 < 2), F.col("_mu")).otherwise(f), "collective": F.when((d >= q2) & (d < q2 + 14), F.col("_mx")).otherwise(f),
            "scale_global": f * 0.5, "zero_interval": F.when((d >= q1) & (d < q2), 0.0).otherwise(f), "scale_local": F.when(mid, f * 0.3).otherwise(f),
            "subtract_random": F.greatest(f - F.col("_noise") * F.col("_mu"), F.lit(0.0)), "subtract_mean": F.greatest(f - F.col("_mu"), F.lit(0.0)), "reverse_daily": F.col("_rev"), "slight_scale": f * 0.9,
            "cap_max": F.least(f, F.col("_mu")), "reduce_night": F.when(d % 2 == 1, f * 0.5).otherwise(f), "flatten": (f + F.col("_mu")) / 2, "long_zero": F.when(d >= q3, 0.0).otherwise(f),
            "scale_down": F.when(d >= q2, f * 0.4).otherwise(f), "flatline": F.when(d >= q2, F.col("_mu")).otherwise(f), "mixed": F.when(d >= q3, 0.0).when(d >= q2, f * 0.5).otherwise(f)}
    return x.select(ID, DAY, "n_days", F.explode(F.array(*[F.struct(F.lit(a).alias("attack"), rule[a].cast("double").alias("value")) for a in attacks])).alias("s")).select(ID, DAY, "n_days", "s.*")
