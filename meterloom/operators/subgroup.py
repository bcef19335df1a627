"""The best thresholds of many groups at once: exact, for every distinct score and any number of groups.

F1 = 2 TP / (N + P), with N predicted and P actual positives, so of all choices of one cut for each group the best lies on the
path that takes the edges of the groups' hulls of (N, TP) in order of falling precision. That path is a running total over
all groups' edges. With a floor on recall the path's first point above the floor is only a bound: points that no hull has may
fill the gap. A point can be part of a better choice only if it lies closer to its group's hull, at the path's slope there,
than the gap; those few points are combined group by group, and only choices that nothing dominates go on.
"""
from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut_lineage
from .hulls import lower_hull
from .ranking import running_totals

OUT = "kind string, grp int, threshold double, f1 double, recall double, precision double"


def score_points(df: DataFrame, group: str = "grp", score: str = "p", label: str = "y") -> DataFrame:
    """grp, th, n, tp for every distinct score of every group: rows of at least that score, and positives among them."""
    t = running_totals(df, score, {"tp": F.col(label).cast("bigint"), "n": F.lit(1).cast("bigint")}, by=[group], descending=True)
    return t.select(F.col(group).cast("int").alias("grp"), F.col("key").cast("double").alias("th"), (F.col("n_before") + F.col("n")).alias("n"), (F.col("tp_before") + F.col("tp")).alias("tp"))


def grid_points(table: DataFrame) -> DataFrame:
    """grp, th, n, tp of a threshold table (grp, th, tp, fp); of thresholds with equal counts the least stands for all."""
    x = table.select("grp", "th", (F.col("tp") + F.col("fp")).cast("bigint").alias("n"), F.col("tp").cast("bigint").alias("tp")).where("n > 0")
    return x.groupBy("grp", "n", "tp").agg(F.min("th").alias("th")).select("grp", "th", "n", "tp")


def _edges(points: DataFrame) -> DataFrame:
    """Corners of every group's hull with the edge that leads to them and its precision; the way starts at no positives."""
    start = points.groupBy("grp").agg(F.lit(None).cast("double").alias("th"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("tp"))
    whole = points.select("grp", "th", "n", "tp").unionByName(start).withColumn("up", -F.col("tp"))
    w = W.partitionBy("grp").orderBy("n")
    corners = lower_hull(whole, ["grp"], "n", "up")
    return corners.withColumn("dn", F.col("n") - F.lag("n").over(w)).withColumn("dtp", F.col("tp") - F.lag("tp").over(w)).withColumn("slope", F.col("dtp") / F.col("dn"))


def _choice(kind: str, chosen: DataFrame, tp: int, n: int, positives: int) -> DataFrame:
    rate = lambda a, b: F.lit(a / b if b else 0.0)
    return chosen.select(F.lit(kind).alias("kind"), "grp", "th", rate(2 * tp, n + positives).alias("f1"), rate(tp, positives).alias("recall"), rate(tp, n).alias("precision")).toDF(*[c.split()[0] for c in OUT.split(", ")])


def best_thresholds(points: DataFrame, positives: int, kind: str = "free", floor: float | None = None) -> DataFrame:
    """kind, grp, threshold, f1, recall, precision: the cut of each group (null: none of it is positive) for which F1 over all
    groups is greatest; with `floor`, of those with at least that recall. Empty if no choice reaches the floor.

    points: grp, th, n, tp, with one row for each number of predicted positives. Of equal choices the one with fewest predicted
    positives counts.
    """
    edges = cut_lineage(_edges(points))
    path = running_totals(edges.where("dn > 0"), "slope", {"dn": F.col("dn"), "dtp": F.col("dtp")}, descending=True)
    path = cut_lineage(path.select(F.col("key").alias("slope"), (F.col("dn_before") + F.col("dn")).alias("n"), (F.col("dtp_before") + F.col("dtp")).alias("tp")).where("tp > 0"))
    f1 = F.col("tp") * 2 / (F.col("n") + positives)
    best = path.agg(F.max_by(F.struct("slope", "n", "tp"), F.struct(f1.alias("f"), F.col("slope").alias("s"))).alias("b")).first().b
    need = -(-Fraction(floor).limit_denominator(10**9) * positives // 1) if floor else 0
    spark = points.sparkSession
    if best is None:
        none = edges.where("dn is null")
        return _choice(kind, none, 0, 0, positives) if need <= 0 else spark.createDataFrame([], OUT)
    if best.tp < need:
        best = path.where(F.col("tp") >= int(need)).agg(F.max_by(F.struct("slope", "n", "tp"), "slope").alias("b")).first().b
        if best is None:
            return spark.createDataFrame([], OUT)
        return _above(points, edges, best, int(need), positives, kind)
    at = edges.where(F.col("dn").isNull() | (F.col("slope") >= best.slope)).groupBy("grp").agg(F.max_by("th", "n").alias("th"))
    return _choice(kind, at, best.tp, best.n, positives)


def _above(points: DataFrame, edges: DataFrame, bound, need: int, positives: int, kind: str) -> DataFrame:
    """The best choice of at least `need` true positives; `bound` is the path's first point there, with slope s.

    With D the distance of a choice from the hulls at slope s, N = (TP - M + D) / s, where M is the hulls' own TP - s N. F1
    beyond the bound's L needs D < TP (2 s / L - 1) - P s + M, at most the value at TP = need, as s is below L / 2 there.
    """
    step = edges.where(F.col("slope") == F.lit(bound.slope)).select("dtp", "dn").first()
    s, best = Fraction(step.dtp, step.dn), Fraction(2 * bound.tp, bound.n + positives)
    top = bound.tp - s * bound.n
    room = need * (2 * s / best - 1) - positives * s + top
    at = edges.where(F.col("dn").isNull() | (F.col("slope") >= F.lit(bound.slope))).groupBy("grp").agg(F.max_by(F.struct("th", "n", "tp"), "n").alias("b")).select("grp", "b.*")
    known = at.select("grp", (F.col("tp") - F.col("n") * float(s)).alias("m"), F.col("n").alias("hull_n"))
    start = edges.where("dn is null").select("grp", "th", "n", "tp")
    near = points.select("grp", "th", "n", "tp").unionByName(start).join(known, "grp")
    near = near.where(F.col("m") - (F.col("tp") - F.col("n") * float(s)) <= float(room) + 1e-6 * (1 + abs(float(room))))
    rows = near.select("grp", "th", "n", "tp").collect()  # the points inside the gap
    groups: dict[int, list] = {}
    for r in rows:
        groups.setdefault(r.grp, []).append(r)
    most = {g: max(r.tp - s * r.n for r in v) for g, v in groups.items()}
    reach = {g: max(r.tp for r in v) for g, v in groups.items()}
    left = sum(reach.values())
    front: dict[int, tuple[int, Fraction, tuple]] = {0: (0, Fraction(0), ())}
    for g in sorted(groups):
        left -= reach[g]
        made: dict[int, tuple[int, Fraction, tuple]] = {}
        for tp, (n, lost, chain) in front.items():
            for r in groups[g]:
                d = lost + most[g] - (r.tp - s * r.n)
                t, m = tp + r.tp, n + r.n
                if d <= room and t + left >= need and (t not in made or m < made[t][0]):
                    made[t] = (m, d, (chain, r))
        front, fewest = {}, None
        for t in sorted(made, reverse=True):  # more true positives with no more predicted ones are as good for all that follows
            if fewest is None or made[t][0] < fewest:
                fewest = made[t][0]
                front[t] = made[t]
    tp, (n, _, chain) = max(((t, v) for t, v in front.items() if t >= need), key=lambda x: (Fraction(2 * x[0], x[1][0] + positives), -x[1][0]))
    picked = []
    while chain:
        chain, r = chain
        picked.append((r.grp, r.th))
    return _choice(kind, points.sparkSession.createDataFrame(picked, "grp int, th double"), tp, n, positives)
