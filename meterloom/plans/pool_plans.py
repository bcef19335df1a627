"""Score-pool operators (inventory K)."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import metrics as M, pool as K, profiles as PR, runs as RU, series_stats as S, typology as TY
from ..operators.folds import series_labels, stratified_folds
from ..session import cut_lineage
from ..sources import tables as T
from .catalog import query
from .metric_plans import ID_FOLDS, SERIES, auc_sql, best_sql, grid_sql, series_scored
from .runs_plans import cusum_sql
from .series_plans import runs_sql, series_means
from .shape_plans import COMPACT, MEANRANK, cohorts
from .sqlbase import LABELS, PANEL, SCORES, sel

N = len(T.MODELS)
EIGEN_LIMIT = 0.95


def matrix(spark, sf, models: list[int] | None = None):
    m = T.score_matrix(spark, sf)
    if models is None:
        return m
    return m.withColumn("p", F.array(*[F.get("p", F.lit(i)) for i in models]))


def frame(spark, rows, schema):
    return spark.createDataFrame([tuple(r) for r in rows], schema)


# ---------------------------------------------------------------- leaderboard and diversity


@query("leaderboard", "K-1", sel(SCORES + ",\n" + auc_sql("scores", "model") + ",\n" + grid_sql("scores", "model") + ",\n" + best_sql("model"),
                                 "auc JOIN best USING (model) ORDER BY round(f1, 9) DESC, model LIMIT 20", "model", "auc, f1, threshold"))
def _(spark, sf):
    s = T.scores(spark, sf)
    b = M.roc_auc(s, ["model"]).join(M.best_f1(s, ["model"]), "model").select("model", "auc", "f1", "threshold")
    return rounded(b.orderBy(F.round("f1", 9).desc(), "model").limit(20))


PAIRS = SCORES + """,
cc AS MATERIALIZED (SELECT a.k AS a, b.k AS b, corr(a.p, b.p) AS c FROM scores a JOIN scores b ON a.id = b.id AND a.k < b.k GROUP BY ALL)"""


@query("model_correlation", "K-2", sel(PAIRS, "cc", "CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b", [("c", "corr")]))
def _(spark, sf):
    return rounded(K.pearson_pairs(matrix(spark, sf)))


@query("correlation_edges", "K-3", "WITH " + PAIRS + " SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b FROM cc WHERE abs(c) > 0.1")
def _(spark, sf):
    return K.pearson_pairs(matrix(spark, sf)).where(F.abs("corr") > 0.1).select("a", "b")


@query("correlation_prune", "K-3", "WITH RECURSIVE " + PAIRS + f""",
sy AS (SELECT a, b, c FROM cc UNION ALL SELECT b, a, c FROM cc UNION ALL SELECT k, k, 1 FROM range({N}) t(k)), rw AS (SELECT a, list(abs(c) ORDER BY b) AS r FROM sy GROUP BY a),
od AS (SELECT a, r, 'm' || a AS model, row_number() OVER (ORDER BY 'm' || a) AS i FROM rw),
kp AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT od.i, CASE WHEN len(list_filter(kept, lambda j: r[j + 1] > 0.1)) = 0 THEN list_append(kept, od.a) ELSE kept END FROM kp JOIN od ON od.i = kp.i + 1)
SELECT 'm' || unnest(kept) AS model FROM kp WHERE i = {N}""")
def _(spark, sf):
    c = K.correlation_array(matrix(spark, sf))
    order = sorted(range(N), key=lambda i: T.MODELS[i])
    return frame(spark, [(T.MODELS[i],) for i in K.prune_in_order(c, order, 0.1)], "model string")


@query("quality_prune", "K-4")
def _(spark, sf):
    c = K.correlation_array(matrix(spark, sf))
    auc = {r.model: r.auc for r in M.roc_auc(T.scores(spark, sf), ["model"]).collect()}  # one row per model
    q = np.array([auc[m] for m in T.MODELS])
    greedy = K.prune_in_order(c, list(np.argsort(-q, kind="stable")), 0.1, strict=False)
    clusters = K.prune_by_clusters(c, 0.3, q)
    return frame(spark, [("greedy", T.MODELS[i]) for i in sorted(greedy)] + [("cluster", T.MODELS[i]) for i in clusters], "method string, model string")


@query("quality_order_prune", "K-4", "WITH RECURSIVE " + PAIRS + ",\n" + auc_sql("scores", "model") + f""",
sy AS (SELECT a, b, c FROM cc UNION ALL SELECT b, a, c FROM cc UNION ALL SELECT k, k, 1 FROM range({N}) t(k)), rw AS (SELECT a, list(abs(c) ORDER BY b) AS r FROM sy GROUP BY a),
od AS (SELECT a, r, row_number() OVER (ORDER BY round(auc, 12) DESC, a) AS i FROM rw JOIN auc ON auc.model = 'm' || a),
kp AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT od.i, CASE WHEN len(list_filter(kept, lambda j: r[j + 1] >= 0.1)) = 0 THEN list_append(kept, od.a) ELSE kept END FROM kp JOIN od ON od.i = kp.i + 1)
SELECT 'm' || unnest(kept) AS model FROM kp WHERE i = {N}""")
def _(spark, sf):
    """The better of two correlated models stays, the best first."""
    c = K.correlation_array(matrix(spark, sf))
    auc = {r.model: r.auc for r in M.roc_auc(T.scores(spark, sf), ["model"]).collect()}  # one row per model
    order = np.argsort([-round(auc[m], 12) for m in T.MODELS], kind="stable")
    return frame(spark, [(T.MODELS[i],) for i in K.prune_in_order(c, list(order), 0.1, strict=False)], "model string")


@query("vote_diversity", "K-5", sel(SCORES + """,
v AS (SELECT id, k, (p > 0.5)::INT AS v, ((p > 0.5)::INT <> y)::INT AS e FROM scores),
pr AS (SELECT a.k AS a, b.k AS b, sum(a.v * b.v) AS n11, sum(a.v * (1 - b.v)) AS n10, sum((1 - a.v) * b.v) AS n01, sum((1 - a.v) * (1 - b.v)) AS n00, avg(a.e * b.e) AS df, avg((a.v <> b.v)::INT) AS dis FROM v a JOIN v b ON a.id = b.id AND a.k < b.k GROUP BY ALL)""",
                                    "pr", "CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b", [("coalesce((n11 * n00 - n10 * n01) / nullif(n11 * n00 + n10 * n01, 0)::DOUBLE, 0)", "q"), ("dis", "disagreement"), ("df", "double_fault")]))
def _(spark, sf):
    return rounded(K.vote_pairs(matrix(spark, sf)))


@query("effective_rank", "K-6", sel(PAIRS, "cc", "", [("avg(c)", "mean_corr"), ("max(c)", "max_corr"), (f"{N * N} / ({N} + 2 * sum(c * c))", "effective_rank")]))
def _(spark, sf):
    return rounded(K.diversity_summary(matrix(spark, sf), N).drop("n_eigen"))


@query("eigen_count", "K-6", "WITH RECURSIVE " + PAIRS + f""",
sy AS (SELECT a, b, c FROM cc UNION ALL SELECT b, a, c FROM cc UNION ALL SELECT k, k, 1 FROM range({N}) t(k)),
el AS (SELECT 0::BIGINT AS step, a::BIGINT AS a, b::BIGINT AS b, c - CASE WHEN a = b THEN {EIGEN_LIMIT}::DOUBLE ELSE 0 END AS v FROM sy
  UNION ALL SELECT step + 1, a, b, v - ra * rb / pv FROM (SELECT *, max(v) FILTER (b = step) OVER (PARTITION BY a) AS ra, max(v) FILTER (a = step) OVER (PARTITION BY b) AS rb, max(v) FILTER (a = step AND b = step) OVER () AS pv FROM el) WHERE a > step AND b > step)
SELECT CAST(count(*) FILTER (v > 0) AS INTEGER) AS n_eigen FROM el WHERE a = step AND b = step""")
def _(spark, sf):
    return K.diversity_summary(matrix(spark, sf), N).select("n_eigen")


# ---------------------------------------------------------------- selection and blending


@query("greedy_selection", "K-7")
def _(spark, sf):
    t = K.greedy_forward(cut_lineage(matrix(spark, sf)), N)
    return rounded(frame(spark, [(s, T.MODELS[i], float(f)) for s, i, f in t], "step int, model string, f1 double"))


@query("diverse_selection", "K-8")
def _(spark, sf):
    t = K.greedy_diverse(cut_lineage(matrix(spark, sf)), N, 6)
    return rounded(frame(spark, [(s, T.MODELS[i], float(f)) for s, i, f in t], "step int, model string, objective double"))


@query("gram_matrix", "K-9", sel(SCORES + """,
x AS (SELECT id, 0 AS i, y::DOUBLE AS v FROM scores WHERE k = 0 UNION ALL SELECT id, k + 1, p FROM scores)""", "x a JOIN x b ON a.id = b.id AND a.i <= b.i GROUP BY ALL", "CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j", [("sum(a.v * b.v)", "s")], 4))
def _(spark, sf):
    m = matrix(spark, sf).withColumn("x", F.concat(F.array(F.col("y").cast("double")), "p"))
    return rounded(K.gram(m), 4)


@query("nnls_blend", "K-9")
def _(spark, sf):
    w = K.nnls_weights(matrix(spark, sf))
    return rounded(frame(spark, [(T.MODELS[i], float(x)) for i, x in enumerate(w)], "model string, weight double"))


@query("coordinate_blend", "K-10")
def _(spark, sf):
    w, f1 = K.coordinate_grid(cut_lineage(matrix(spark, sf)), N)
    return rounded(frame(spark, [(T.MODELS[i], float(x), f1) for i, x in enumerate(w)], "model string, weight double, f1 double"))


@query("hill_climb_blend", "K-10")
def _(spark, sf):
    w, f1 = K.hill_climb(cut_lineage(matrix(spark, sf)), N)
    return rounded(frame(spark, [(T.MODELS[i], float(x), f1) for i, x in enumerate(w)], "model string, weight double, f1 double"))


PAIR_W = [(i, j, k) for i in range(N) for j in range(i + 1, N) for k in range(1, 10)]


@query("pair_blends", "K-11", sel(SCORES + """,
w AS (SELECT id, any_value(y) AS y, list(p ORDER BY k) AS ps FROM scores GROUP BY 1),
hc AS (SELECT a, b, t, y, CAST(least(greatest(ceil(((t / 10.0) * ps[a + 1] + (1 - t / 10.0) * ps[b + 1]) * 200 - 10), 0), 180) AS INTEGER) AS c FROM w, range(64) x(a), range(64) z(b), range(1, 10) q(t) WHERE a < b),
hh AS (SELECT a, b, t, c, sum(y) AS pos, count(*) - sum(y) AS neg FROM hc GROUP BY ALL),
cu AS (SELECT *, sum(pos) OVER u AS tp, sum(neg) OVER u AS fp, sum(pos) OVER s AS n_pos, coalesce(lag(c) OVER v, 0) AS below FROM hh WINDOW u AS (PARTITION BY a, b, t ORDER BY c DESC), s AS (PARTITION BY a, b, t), v AS (PARTITION BY a, b, t ORDER BY c)),
grid AS (SELECT a, b, t, (10 + below) / 200.0::DOUBLE AS th, 2 * tp / (tp + fp + n_pos)::DOUBLE AS f1, tp / n_pos::DOUBLE AS recall, tp / (tp + fp)::DOUBLE AS precision, tp, fp FROM cu WHERE c > 0),
""" + best_sql("a, b, t"), "best", "CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST(t AS INTEGER) AS tenths", "threshold, f1, recall, precision"))
def _(spark, sf):
    ws = np.zeros((len(PAIR_W), N))
    for c, (i, j, k) in enumerate(PAIR_W):
        ws[c, i], ws[c, j] = k / 10, 1 - k / 10
    names = frame(spark, [(c, i, j, k) for c, (i, j, k) in enumerate(PAIR_W)], "cand int, a int, b int, tenths int")
    r = K.evaluate_weights(matrix(spark, sf), ws)
    return rounded(r.join(names, "cand").select("a", "b", "tenths", "threshold", "f1", "recall", "precision"))


SIMPLEX = [(a, b, 10 - a - b) for a in range(11) for b in range(11 - a)]
SIMPLEX_GRID: M.Grid = (100, 900, 20)
TOP = 6
_TOP = SCORES + ",\n" + auc_sql("scores", "model") + f""",
tm AS (SELECT model, row_number() OVER (ORDER BY round(auc, 9) DESC, CAST(substr(model, 2) AS INTEGER)) AS r FROM auc QUALIFY r <= {TOP}),
w AS (SELECT id, any_value(y) AS y, list(p ORDER BY r) AS ps, list(model ORDER BY r) AS ms FROM scores JOIN tm USING (model) GROUP BY 1)"""


def top_models(spark, sf, n: int = TOP) -> list[int]:
    """The n models of largest AUC."""
    auc = {r.model: round(r.auc, 9) for r in M.roc_auc(T.scores(spark, sf), ["model"]).collect()}  # one row per model
    return sorted(range(N), key=lambda i: (-auc[T.MODELS[i]], i))[:n]


@query("triple_blends", "K-11", sel(_TOP + f""",
bl AS MATERIALIZED (SELECT ms[a] AS ma, ms[b] AS mb, ms[c] AS mc, wa, wb, y, (wa / 10.0) * ps[a] + (wb / 10.0) * ps[b] + ((10 - wa - wb) / 10.0) * ps[c] AS p
  FROM w, range(1, {TOP + 1}) i(a), range(1, {TOP + 1}) j(b), range(1, {TOP + 1}) k(c), range(1, 10) x(wa), range(1, 10) z(wb) WHERE a < b AND b < c AND wa + wb < 10),
""" + grid_sql("bl", "ma, mb, mc, wa, wb", 50, 950, 5) + ",\n" + best_sql("ma, mb, mc, wa, wb"), "best", "ma, mb, mc, CAST(wa AS INTEGER) AS wa, CAST(wb AS INTEGER) AS wb", "threshold, f1, recall, precision"))
def _(spark, sf):
    top = top_models(spark, sf)
    tri = [(i, j, k, a, b, c) for i in range(TOP) for j in range(i + 1, TOP) for k in range(j + 1, TOP) for a, b, c in SIMPLEX if min(a, b, c) > 0]
    ws = np.zeros((len(tri), TOP))
    for n, (i, j, k, a, b, c) in enumerate(tri):
        ws[n, [i, j, k]] = a / 10, b / 10, c / 10
    names = frame(spark, [(n, *(T.MODELS[top[x]] for x in (i, j, k)), a, b) for n, (i, j, k, a, b, _) in enumerate(tri)], "cand int, ma string, mb string, mc string, wa int, wb int")
    r = K.evaluate_weights(matrix(spark, sf, top), ws)
    return rounded(r.join(names, "cand").select("ma", "mb", "mc", "wa", "wb", "threshold", "f1", "recall", "precision"))


@query("fold_simplex_weights", "K-12", sel(_TOP + ",\n" + ID_FOLDS + """,
bl AS MATERIALIZED (SELECT fold, a, b, y, (a / 10.0) * ps[1] + (b / 10.0) * ps[2] + ((10 - a - b) / 10.0) * ps[3] AS p FROM w JOIN idf USING (id), range(11) x(a), range(11) z(b) WHERE a + b <= 10),
""" + grid_sql("bl", "fold, a, b", 100, 900, 20) + ",\n" + best_sql("fold, a, b") + """,
tp AS (SELECT fold, arg_max(struct_pack(a, b, f1), struct_pack(x := round(f1, 9), y := -a, z := -b)) AS t FROM best GROUP BY 1)""", "tp", "fold, CAST(t.a AS INTEGER) AS a, CAST(t.b AS INTEGER) AS b", [("t.f1", "f1")]))
def _(spark, sf):
    m = matrix(spark, sf, top_models(spark, sf, 3))
    f = stratified_folds(m.select("id", "y"), 5, "id").select("id", "fold")
    r = K.evaluate_weights(m.join(f, "id"), np.array(SIMPLEX) / 10, SIMPLEX_GRID, ["fold"])
    names = F.element_at(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b, _ in SIMPLEX]), F.col("cand") + 1)
    b = r.withColumn("n", names).groupBy("fold").agg(F.max_by(F.struct("n", "f1"), F.struct(F.round("f1", 9), -F.col("cand"))).alias("t"))
    return rounded(b.select("fold", "t.n.a", "t.n.b", "t.f1"))


@query("recall_frontier", "K-13")
def _(spark, sf):
    """2,000 random blends of all models over every distinct score: the best of each bin of recall, and with recall of 0.9."""
    w = np.random.default_rng(42).dirichlet(np.ones(N), 2000)
    return rounded(K.exact_blends(cut_lineage(matrix(spark, sf)), w).where("kind <> 'best'"))


@query("dirichlet_search", "K-13")
def _(spark, sf):
    """50,000 random blends of the eight best models: the best F1 of all, its threshold and weights."""
    top = top_models(spark, sf, 8)
    w = np.random.default_rng(42).dirichlet(np.ones(8), 50_000)
    best = K.exact_blends(cut_lineage(matrix(spark, sf, top)), w, cells=100, best_only=True).first()
    rows = [(T.MODELS[i], float(x), best.f1, best.recall, best.precision, best.threshold) for i, x in zip(top, w[best.cand])] if best else []
    return rounded(frame(spark, rows, "model string, weight double, f1 double, recall double, precision double, threshold double"))


@query("simple_ensembles", "K-14", sel(SCORES + ",\n" + grid_sql("scores", "model", cte="g1") + ",\n" + best_sql("model", grid="g1", cte="b1") + """,
rk AS (SELECT model, row_number() OVER (ORDER BY round(f1, 9) DESC, CAST(substr(model, 2) AS INTEGER)) AS r FROM b1),
en AS MATERIALIZED (SELECT 'mean_all' AS cand, id, any_value(y) AS y, avg(p) AS p FROM scores GROUP BY id UNION ALL SELECT 'mean_top3', id, any_value(y), avg(p) FROM scores JOIN rk USING (model) WHERE r <= 3 GROUP BY id
  UNION ALL SELECT 'best_single', id, y, p FROM scores JOIN rk USING (model) WHERE r = 1),
""" + grid_sql("en", "cand") + ",\n" + best_sql("cand") + ",\n" + auc_sql("en", "cand"), "best JOIN auc USING (cand)", "cand", "f1, auc, recall, precision"))
def _(spark, sf):
    m = matrix(spark, sf)
    f1 = np.round(K.f1_of_weights(m, np.eye(N)), 9)
    order = list(np.argsort(-f1, kind="stable"))
    p = F.col("p")
    cands = {"mean_all": F.aggregate("p", F.lit(0.0), lambda a, x: a + x) / N, "mean_top3": sum((F.get(p, F.lit(int(i))) for i in order[1:3]), F.get(p, F.lit(int(order[0])))) / 3,
             "best_single": F.get(p, F.lit(int(order[0])))}
    x = m.select("id", "y", F.explode(F.array(*[F.struct(F.lit(n).alias("cand"), c.alias("p")) for n, c in cands.items()])).alias("s")).select("id", "y", "s.*")
    return rounded(M.best_f1(x, ["cand"]).drop("threshold").join(M.roc_auc(x, ["cand"]), "cand"))


@query("meta_features", "K-16", sel(SERIES, "ss", "series_id", ["mean", "std", "missing_rate", ("p", "p_a"), ("1 - missing_rate", "p_b"), ("abs(p - (1 - missing_rate))", "p_diff")]))
def _(spark, sf):
    x = series_scored(spark, sf)
    pb = 1 - F.col("missing_rate")
    return rounded(x.select("series_id", "mean", "std", "missing_rate", F.col("p").alias("p_a"), pb.alias("p_b"), F.abs(F.col("p") - pb).alias("p_diff")))


BASE, GATE = 0, 4
RESCUES = [k for k in range(N) if k not in (BASE, GATE)]


@query("gated_blend", "K-17", sel(SCORES + f""",
w AS (SELECT id, any_value(y) AS y, list(p ORDER BY k) AS ps FROM scores GROUP BY 1), cut AS (SELECT quantile_cont(ps[{GATE + 1}], 0.8) AS c FROM w),
gb AS MATERIALIZED (SELECT 'm' || k AS rescue, gate, t AS tenths, y, CASE WHEN gate = 'soft' THEN (1 - ps[{GATE + 1}] * (t / 10.0)) * ps[{BASE + 1}] + ps[{GATE + 1}] * (t / 10.0) * ps[k + 1] WHEN ps[{GATE + 1}] >= c THEN (1 - t / 10.0) * ps[{BASE + 1}] + (t / 10.0) * ps[k + 1] ELSE ps[{BASE + 1}] END AS p
  FROM w, cut, range({N}) x(k), range(1, 11) q(t), (VALUES ('soft'), ('top20')) z(gate) WHERE k NOT IN ({BASE}, {GATE})),
""" + grid_sql("gb", "rescue, gate, tenths", 10, 995, 5, ">=") + ",\n" + best_sql("rescue, gate, tenths"), "best", "rescue, gate, CAST(tenths AS INTEGER) AS tenths", "f1, recall, precision"))
def _(spark, sf):
    """Both gates are linear in gate * (rescue - base): the blends are weight vectors over such columns."""
    from ..operators.ranking import global_quantiles
    cut = global_quantiles(T.wide_scores(spark, sf, [GATE]), f"m{GATE}", {"q": .8})["q"]
    base, gate = F.get("p", F.lit(BASE)), F.get("p", F.lit(GATE))
    gates = {"soft": gate, "top20": (gate >= F.col("cut")).cast("double")}
    moved = [g * (F.get("p", F.lit(k)) - base) for g in gates.values() for k in RESCUES]
    m = matrix(spark, sf).withColumn("cut", cut).select("id", "y", F.array(base, *moved).alias("p"))
    ws, names = [], []
    for at, (g, k) in enumerate([(g, k) for g in gates for k in RESCUES], 1):
        for t in range(1, 11):
            w = np.zeros(1 + len(moved))
            w[0], w[at] = 1, t / 10
            ws.append(w)
            names.append((len(names), f"m{k}", g, t))
    r = K.evaluate_weights(m, ws, (10, 995, 5), inclusive=True)
    return rounded(r.join(frame(spark, names, "cand int, rescue string, gate string, tenths int"), "cand").select("rescue", "gate", "tenths", "f1", "recall", "precision"))


@query("oracle_bound", "K-18", sel(SCORES + """,
ob AS (SELECT 'bound' AS cand, id, any_value(y) AS y, CASE WHEN any_value(y) = 1 THEN max(p) ELSE min(p) END AS p FROM scores GROUP BY id),
""" + auc_sql("ob", "cand") + ",\n" + grid_sql("ob", "cand") + ",\n" + best_sql("cand"), "auc JOIN best USING (cand)", "", "auc, f1, recall, precision"))
def _(spark, sf):
    m = matrix(spark, sf)
    x = m.select("id", "y", F.when(F.col("y") == 1, F.array_max("p")).otherwise(F.array_min("p")).alias("p"), F.lit("bound").alias("cand"))
    return rounded(M.roc_auc(x, ["cand"]).join(M.best_f1(x, ["cand"]).drop("threshold"), "cand").drop("cand"))


RT, RG, RL = [.5, .55, .6, .65, .7, .75, .8], [.74, .76, .78, .8], [20.0, 40.0, 45.0, 50.0]


@query("rescue_filter_rules", "K-19", sel(SERIES + f""",
gr AS (SELECT th, gi, li, go, lo FROM (VALUES {", ".join(f"({t}::DOUBLE)" for t in RT)}) a(th), (VALUES {", ".join(f"({t}::DOUBLE)" for t in RG)}) b(gi), (VALUES {", ".join(f"({t}::DOUBLE)" for t in RL)}) c(li), (VALUES {", ".join(f"({t}::DOUBLE)" for t in RG)}) d(go), (VALUES {", ".join(f"({t}::DOUBLE)" for t in RL)}) e(lo)),
pd AS (SELECT gr.*, y, CASE WHEN p > th THEN NOT (missing_rate > go AND mean < lo) ELSE missing_rate > gi AND mean < li END AS pred FROM ss, gr),
ct AS (SELECT th, gi, li, go, lo, count(*) FILTER (pred AND y = 1) AS tp, count(*) FILTER (pred AND y = 0) AS fp, count(*) FILTER (NOT pred AND y = 1) AS fn FROM pd GROUP BY ALL)""", "ct", "tp, fp, fn",
                                          ["th", ("gi", "gap_in"), ("li", "level_in"), ("go", "gap_out"), ("lo", "level_out"), ("coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0)", "f1")]))
def _(spark, sf):
    return rounded(K.rule_grid(series_scored(spark, sf), "p", "missing_rate", "mean", RT, RG, RL))


FT, FE = [i / 100 for i in range(30, 80, 5)], [i / 100 for i in range(5, 95, 5)]


@query("error_flip_rules", "K-19", sel(SCORES + f""",
w AS (SELECT id, any_value(y) AS y, max(p) FILTER (k = 0) AS p, max(p) FILTER (k = 1) AS e FROM scores GROUP BY 1),
pd AS (SELECT mode, th, err, y, CASE mode WHEN 'both' THEN (p > th) <> (e > err) WHEN 'up' THEN p > th OR e > err ELSE p > th AND NOT e > err END AS pred FROM w,
  (VALUES ('both'), ('up'), ('down')) m(mode), (VALUES {", ".join(f"({t}::DOUBLE)" for t in FT)}) a(th), (VALUES {", ".join(f"({t}::DOUBLE)" for t in FE)}) b(err)),
ct AS (SELECT mode, th, err, count(*) FILTER (pred AND y = 1) AS tp, count(*) FILTER (pred AND y = 0) AS fp, count(*) FILTER (NOT pred AND y = 1) AS fn FROM pd GROUP BY ALL)""", "ct", "mode, tp, fp, fn",
                                       ["th", "err", ("coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0)", "f1"), ("coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0)", "recall"), ("coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0)", "precision")]))
def _(spark, sf):
    w = T.wide_scores(spark, sf, [0, 1])
    return rounded(K.flip_grid(w, "m0", "m1", FT, FE))


@query("error_correction_grid", "K-19", sel(SCORES + """,
w AS (SELECT id, any_value(y) AS y, max(p) FILTER (k = 0) AS p, max(p) FILTER (k = 1) AS e FROM scores GROUP BY 1),
ad AS MATERIALIZED (SELECT alpha5, beta2, y, least(greatest(p + (alpha5 / 5.0) * (e - 0.5) + (beta2 / 2.0) * e * (1 - p), 0), 1) AS p FROM w, range(6) x(alpha5), range(-2, 3) z(beta2)),
""" + grid_sql("ad", "alpha5, beta2", 50, 950, 50) + ",\n" + best_sql("alpha5, beta2"), "best", "CAST(alpha5 AS INTEGER) AS alpha5, CAST(beta2 AS INTEGER) AS beta2", "threshold, f1, recall, precision"))
def _(spark, sf):
    w = T.wide_scores(spark, sf, [0, 1])
    p, e = F.col("m0"), F.col("m1")
    cand = [F.struct(F.lit(a).alias("alpha5"), F.lit(b).alias("beta2"), F.least(F.greatest(p + (a / 5.0) * (e - 0.5) + (b / 2.0) * e * (1 - p), F.lit(0.0)), F.lit(1.0)).alias("p")) for a in range(6) for b in range(-2, 3)]
    x = w.select("id", "y", F.explode(F.array(*cand)).alias("s")).select("id", "y", "s.*")
    return rounded(M.best_f1(x, ["alpha5", "beta2"], grid=(50, 950, 50)))


# ---------------------------------------------------------------- labels

VOTED = SCORES + f""",
vt AS MATERIALIZED (SELECT id, any_value(y) AS y, count(*) FILTER (p > 0.5) AS n_votes, (count(*) FILTER (p > 0.5) >= {N // 2 + 1})::INT AS clean FROM scores GROUP BY 1)"""


@query("consensus_labels", "K-21", "WITH " + VOTED + " SELECT id, y, CAST(n_votes AS INTEGER) AS n_votes, clean, clean <> y AS issue FROM vt")
def _(spark, sf):
    return K.consensus_labels(matrix(spark, sf), N)


@query("noise_by_class", "K-21", sel(VOTED, "vt GROUP BY 1", "y, count(*) AS n", [("avg((clean <> y)::INT)", "noise_rate")]))
def _(spark, sf):
    return rounded(K.noise_by_class(K.consensus_labels(matrix(spark, sf), N)))


@query("leave_one_out_consensus", "K-22", "WITH " + VOTED + f""",
lo AS (SELECT s.id, s.k, (n_votes - (p > 0.5)::INT >= {(N - 1) // 2 + 1})::INT AS c, vt.y FROM scores s JOIN vt USING (id))
SELECT id, any_value(y) AS y, list(c ORDER BY k) AS loo, (avg(c) >= 0.5)::INT AS final, (avg(c) >= 0.5)::INT <> any_value(y) AS disagree FROM lo GROUP BY 1""")
def _(spark, sf):
    return K.leave_one_out_consensus(matrix(spark, sf), N)


_VS = SCORES + ",\n" + auc_sql("scores", "model") + """,
vs AS MATERIALIZED (SELECT id, y, count(*) AS voters, avg((p > 0.5)::INT) AS vote_share, avg(p) AS mean_p FROM scores JOIN auc USING (model) WHERE auc >= 0.5 GROUP BY ALL)"""


@query("flip_labels", "K-23", sel(_VS, "vs", "id, y, voters, y = 1 AND mean_p < 0.48 AS flip_down, y = 0 AND mean_p > 0.52 AS flip_up, CASE WHEN y = 1 AND mean_p < 0.48 THEN 0 WHEN y = 0 AND mean_p > 0.52 THEN 1 ELSE y END AS clean", "vote_share, mean_p"))
def _(spark, sf):
    return rounded(K.flip_labels(K.voter_shares(T.scores(spark, sf), 0.5), "mean_p", 0.48, 0.52))


_LO, _HI = (.40, .45, .48), (.52, .55, .60)


@query("flip_sweep", "K-23", "WITH " + _VS + f""" SELECT lo, hi, count(*) FILTER (y = 1 AND mean_p < lo) AS mean_down, count(*) FILTER (y = 0 AND mean_p > hi) AS mean_up, count(*) FILTER (y = 1 AND vote_share < lo) AS vote_down, count(*) FILTER (y = 0 AND vote_share > hi) AS vote_up
FROM vs, (VALUES {", ".join(f"({x}::DOUBLE)" for x in _LO)}) a(lo), (VALUES {", ".join(f"({x}::DOUBLE)" for x in _HI)}) b(hi) GROUP BY lo, hi""")
def _(spark, sf):
    v = K.voter_shares(T.scores(spark, sf), 0.5)
    g = v.withColumn("g", F.explode(F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a in _LO for b in _HI]))).select("y", "mean_p", "vote_share", "g.*")
    y = F.col("y")
    return g.groupBy("lo", "hi").agg(*[F.count_if((y == 1) & (F.col(c) < F.col("lo"))).alias(f"{n}_down") for n, c in (("mean", "mean_p"), ("vote", "vote_share"))],
                                     *[F.count_if((y == 0) & (F.col(c) > F.col("hi"))).alias(f"{n}_up") for n, c in (("mean", "mean_p"), ("vote", "vote_share"))])


@query("confident_learning", "K-24", "WITH " + SCORES + """,
s AS (SELECT id, y, p, CASE WHEN y = 1 THEN p ELSE 1 - p END AS sp FROM scores WHERE k = 0),
t AS (SELECT avg(1 - p) FILTER (y = 0) AS t0, avg(p) FILTER (y = 1) AS t1 FROM s),
g AS (SELECT s.*, CASE WHEN 1 - p >= t0 - 1e-6 AND p >= t1 - 1e-6 THEN (p > 0.5)::INT WHEN 1 - p >= t0 - 1e-6 THEN 0 WHEN p >= t1 - 1e-6 THEN 1 END AS guess FROM s, t),
j AS (SELECT y, least(round(coalesce(count(*) FILTER (guess = 1 - y) * count(*) / nullif(count(guess), 0)::DOUBLE, 0)), count(*) - 1) AS quota FROM g GROUP BY 1),
r AS (SELECT id, y, sp - (1 - sp) AS m, row_number() OVER (PARTITION BY y ORDER BY sp - (1 - sp), id) - 1 AS r FROM s)
SELECT id, y, r < quota AND m < 0 AS issue FROM r JOIN j USING (y)""")
def _(spark, sf):
    s = T.wide_scores(spark, sf, [0]).withColumnRenamed("m0", "p")
    return K.confident_learning(s)


@query("small_loss_selection", "K-25", sel(SCORES + """,
l AS (SELECT id, -(y * ln(greatest(p, 1e-7)) + (1 - y) * ln(greatest(1 - p, 1e-7))) AS loss FROM scores WHERE k = 1),
r AS (SELECT id, loss, row_number() OVER (ORDER BY loss, id) - 1 < floor(0.85 * count(*) OVER () + 1e-9) AS keep FROM l)""", "r", "id, keep", "loss"))
def _(spark, sf):
    return rounded(K.small_loss(T.wide_scores(spark, sf, [0, 1]), "m1", K.forget_rate(20, 30)))


# ---------------------------------------------------------------- typology


def behaviour(spark, sf, stage: bool = False):
    """One row per series; `stage` materializes it for plans that read it several times."""
    p = T.panel(spark, sf)
    filled = p.withColumn("f", F.coalesce("value", F.lit(0.0)))
    b = PR.behaviour_profile(p, series_means(spark, sf))
    cp = RU.cusum_shift(p, "value", F.col("value").isNotNull()).select("series_id", "has_cp", "change_ratio", "persistence")
    lb = PR.ljung_box(filled).select("series_id", F.col("p_value").alias("ljungbox_p"))
    ac = S.autocorrelation(filled, "f", "day_idx", (1,)).select("series_id", F.col("autocorr_1").alias("acf1"))
    x = b.join(cp, "series_id").join(lb, "series_id").join(ac, "series_id").join(series_labels(spark, sf), "series_id")
    return cut_lineage(x) if stage else x


def _typology_sql() -> str:
    return PANEL + ",\n" + LABELS + ",\n" + cusum_sql("panel", "value", "value IS NOT NULL", True, "value") + ",\n" + MEANRANK + """,
pmed AS (SELECT series_id, quantile_cont(value, 0.5) AS med FROM panel GROUP BY 1),
mf AS MATERIALIZED (SELECT p.series_id, p.day_idx, coalesce(p.value, med, 0) AS g, p.f FROM panel p JOIN pmed USING (series_id)),
q AS (SELECT series_id, quantile_cont(g, 0.1) AS p10 FROM mf GROUP BY 1), x AS (SELECT mf.*, g < greatest(p10 * 0.5, 0.01) AS anom FROM mf JOIN q USING (series_id)),
""" + runs_sql("x", "anom", "ar") + """,
rl AS (SELECT series_id, avg(length) AS mean_run_length FROM ar GROUP BY 1),
lg AS (SELECT *, """ + ", ".join(f"lag(f, {k}) OVER (PARTITION BY series_id ORDER BY day_idx) AS l{k}" for k in range(1, 11)) + """ FROM panel),
lq AS (SELECT series_id, corr(f, l1) AS acf1, count(*) * (""" + " + ".join(f"coalesce(corr(f, l{k}), 0) ** 2" for k in range(1, 11)) + """) AS q FROM lg GROUP BY 1),
g AS (SELECT series_id, avg((g < 0.01)::INT) AS near_zero_ratio, avg(anom::INT) AS anomaly_ratio FROM x GROUP BY 1),
beh AS MATERIALIZED (SELECT g.*, coalesce(mean_run_length, 0) AS mean_run_length, global_rank AS global_rank_pct, has_cp, change_ratio, persistence, acf1, least(exp(-q / 2) * (1 + q / 2 + (q / 2) ** 2 / 2 + (q / 2) ** 3 / 6 + (q / 2) ** 4 / 24), 1) AS ljungbox_p, y
  FROM g JOIN gr USING (series_id) LEFT JOIN rl USING (series_id) JOIN cus USING (series_id) JOIN lq USING (series_id) JOIN series_labels USING (series_id)),
ty AS MATERIALIZED (SELECT *, CASE WHEN has_cp = 1 AND change_ratio >= 0.2 AND change_ratio < 0.8 AND persistence > 0.7 THEN '1_voltage_drop' WHEN has_cp = 1 AND change_ratio < 0.2 THEN '2_bypass' WHEN anomaly_ratio > 0.15 AND mean_run_length >= 3 THEN '4_intermittent'
  WHEN acf1 < 0.3 AND ljungbox_p < 0.1 THEN '5_remote' WHEN near_zero_ratio > 0.9 THEN '6_no_meter' WHEN has_cp = 0 AND global_rank_pct < 0.25 THEN '3_constant_low' ELSE '7_unknown' END AS type FROM beh)"""


TYPED = _typology_sql()


@query("behaviour_types", "K-26", "WITH " + TYPED + " SELECT series_id, type FROM ty")
def _(spark, sf):
    return behaviour(spark, sf).select("series_id", TY.behaviour_type().alias("type"))


@query("expert_labels", "K-26", "WITH " + TYPED + """ SELECT series_id, (y = 1 AND has_cp = 1 AND change_ratio < 0.8 AND persistence > 0.7)::INT AS e1, (y = 1 AND has_cp = 0 AND global_rank_pct < 0.15)::INT AS e2,
(y = 1 AND anomaly_ratio > 0.15 AND mean_run_length >= 3)::INT AS e3, (y = 1)::INT AS e4 FROM ty""")
def _(spark, sf):
    return TY.expert_labels(behaviour(spark, sf))


@query("compact_weak_labels", "K-26, C-41", "WITH " + COMPACT + ",\n" + LABELS + """ SELECT series_id, (y = 1 AND cusum_score > 0.3 AND change_persistence > 0.7)::INT AS e1, ((y = 1 AND near_zero > 0.9) OR global_rank < 0.05)::INT AS e2,
(y = 1 AND anomaly_ratio > 0.1 AND anom_std > 0.15)::INT AS e3, (y = 1)::INT AS e4 FROM compact JOIN series_labels USING (series_id)""")
def _(spark, sf):
    return TY.compact_weak_labels(PR.compact_behaviour(T.panel(spark, sf), cohorts(spark, sf), series_means(spark, sf)).join(series_labels(spark, sf), "series_id"))


@query("type_distribution", "K-27", sel(TYPED, "ty GROUP BY 1", "type, count(*) AS n", [("count(*) / (SELECT count(*) FROM ty)::DOUBLE", "share")]))
def _(spark, sf):
    return rounded(TY.type_distribution(behaviour(spark, sf, True).withColumn("type", TY.behaviour_type())))


_TF = ["near_zero_ratio", "anomaly_ratio", "mean_run_length", "global_rank_pct", "acf1"]


@query("best_feature_per_type", "K-27", sel(TYPED + """,
kn AS (SELECT DISTINCT type FROM ty WHERE y = 1), tx AS (SELECT type, y, ty.* EXCLUDE (type, y) FROM ty WHERE y = 1 UNION ALL SELECT kn.type, y, ty.* EXCLUDE (type, y) FROM ty, kn WHERE y = 0),
lo AS (""" + " UNION ALL ".join(f"SELECT type, y, '{c}' AS feature, {c} AS p FROM tx" for c in _TF) + "),\n" + auc_sql("lo", "type, feature") + """,
b AS (SELECT type, arg_max(struct_pack(feature, a := greatest(auc, 1 - auc)), struct_pack(x := round(greatest(auc, 1 - auc), 9), y := feature)) AS b FROM auc GROUP BY 1)""", "b", "type, b.feature AS feature", [("b.a", "auc")]))
def _(spark, sf):
    return rounded(TY.best_feature_per_type(behaviour(spark, sf, True).withColumn("type", TY.behaviour_type()), _TF))
