"""Peers, neighbours, outlier scores and low-rank residuals (inventory I)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import clean as C, isolation, neighbours as NB, panel as P, peers as PE
from ..operators.folds import stratified_folds
from ..session import cut_lineage
from ..sources import tables as T
from .catalog import query
from .metric_plans import ID_FOLDS
from .series_plans import TIERS, series_means
from .shape_plans import cohorts
from .sqlbase import PANEL, READINGS, sel


@query("peer_deviation", "I-1", sel(PANEL + """,
um AS (SELECT series_id, avg(f) AS m FROM panel GROUP BY 1), ue AS (SELECT quantile_cont(m, [0.2, 0.4, 0.6, 0.8]) AS q FROM um WHERE m > 0),
ub AS (SELECT series_id, (m >= q[1])::INT + (m >= q[2])::INT + (m >= q[3])::INT + (m >= q[4])::INT AS bin FROM um, ue),
mm AS (SELECT series_id, CAST(month(dt) AS INTEGER) AS month, avg(f) AS mean, stddev_pop(f) AS std FROM panel GROUP BY ALL),
lo AS (SELECT series_id, bin, month, 'mean' AS stat, mean AS x FROM mm JOIN ub USING (series_id) UNION ALL SELECT series_id, bin, month, 'std', std FROM mm JOIN ub USING (series_id)),
q AS (SELECT bin, month, stat, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3, count(*) AS n FROM lo GROUP BY ALL),
o AS (SELECT series_id, month, stat, CASE WHEN n >= 5 THEN least(greatest(abs(x - q2) / greatest(q3 - q1, 1e-6), -10), 10) ELSE 0 END AS deviation FROM lo JOIN q USING (bin, month, stat))""", "o", "series_id, month, stat", "deviation", 5))
def _(spark, sf):
    return rounded(PE.monthly_peer_deviation(T.filled(spark, sf)), 5)


@query("cluster_profiles", "I-2")
def _(spark, sf):
    c = PE.cluster_profiles(C.weekly(T.filled(spark, sf)))
    return rounded(PE.cluster_ratio(series_means(spark, sf), c))


@query("cluster_day_medians", "I-3", sel(PANEL + ",\n" + TIERS + """,
x AS (SELECT panel.*, tier AS cluster FROM panel JOIN tiers USING (series_id)), q AS (SELECT cluster, day_idx, quantile_cont(f, 0.5) AS med FROM x GROUP BY ALL)""", "x JOIN q USING (cluster, day_idx) GROUP BY ALL", "series_id, cluster",
                                         [("avg(abs(f - med))", "abs_dev"), ("avg((f < med)::INT)", "below_share")]))
def _(spark, sf):
    c = cohorts(spark, sf).withColumnRenamed("cohort", "cluster")
    return rounded(PE.cluster_day_deviation(T.filled(spark, sf), c))


def vectors(spark, sf):
    return T.embeddings(spark, sf).select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


_VEC = """v AS MATERIALIZED (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings)"""


@query("cosine_graph", "I-4", sel(_VEC + """,
d AS (SELECT a.id AS src, b.id AS dst, 1 - list_cosine_similarity(a.vec, b.vec) AS dist FROM v a JOIN v b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM d)""", "r WHERE rank <= 5", "src, dst, CAST(rank AS INTEGER) AS rank", "dist"))
def _(spark, sf):
    return rounded(NB.cosine_graph(vectors(spark, sf), 5))


@query("knn_distance_by_fold", "I-5", sel(_VEC + ",\n" + ID_FOLDS + """,
u AS (SELECT id, fold, i, vec[i] AS x FROM v JOIN idf USING (id), range(1, 65) t(i)),
sd AS (SELECT f, i, stddev_pop(x) AS s FROM u, range(5) t(f) WHERE fold <> f GROUP BY ALL), sl AS (SELECT f, list(s ORDER BY i) AS s FROM sd GROUP BY 1),
z AS (SELECT sl.f, v.id, idf.fold, list_transform(list_zip(vec, s), lambda e: e[1] / e[2]) AS z FROM v JOIN idf USING (id) CROSS JOIN sl),
d AS (SELECT a.id, a.fold, list_distance(a.z, b.z) AS d FROM z a JOIN z b ON a.f = b.f AND a.fold = a.f AND b.fold <> b.f),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d) AS r FROM d)""", "r WHERE r = 20", "id, fold", [("d", "knn_dist")]))
def _(spark, sf):
    ids = T.embeddings(spark, sf).select(F.col("vec_id").alias("id"), (F.col("label") == 0).cast("int").alias("y"))
    x = vectors(spark, sf).join(stratified_folds(ids, 5, "id").select("id", "fold"), "id")
    return rounded(NB.knn_score_by_fold(cut_lineage(x), 5, 20))


_LOF = _VEC + """,
d AS (SELECT a.id, b.id AS nid, list_distance(a.vec, b.vec) AS dist FROM v a JOIN v b ON a.id <> b.id),
e AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nid) AS r FROM d) WHERE r <= 20),
kd AS (SELECT id, max(dist) AS kdist FROM e GROUP BY 1),
lr AS (SELECT e.id, 1 / (avg(greatest(dist, kdist)) + 1e-10) AS lrd FROM e JOIN kd ON kd.id = e.nid GROUP BY 1),
lof AS (SELECT e.id, avg(n.lrd) / any_value(s.lrd) AS lof FROM e JOIN lr n ON n.id = e.nid JOIN lr s ON s.id = e.id GROUP BY 1)"""


@query("local_outlier_factor", "I-6", sel(_LOF, "lof", "id", "lof", 5))
def _(spark, sf):
    v = vectors(spark, sf)
    e = cut_lineage(NB.nearest_neighbours(v, v, 20))  # read by three joins
    return rounded(NB.local_outlier_factor(e, e), 5)


@query("isolation_forest", "I-7")
def _(spark, sf):
    return rounded(isolation.isolation_scores(vectors(spark, sf)))


@query("combined_outlier_score", "I-8", sel(_LOF + """,
s AS (SELECT id, lof, kdist FROM lof JOIN kd USING (id)),
n AS (SELECT *, (lof - min(lof) OVER ()) / (max(lof) OVER () - min(lof) OVER ()) AS a, (kdist - min(kdist) OVER ()) / (max(kdist) OVER () - min(kdist) OVER ()) AS b FROM s)""", "n", "id", [("a", "lof_n"), ("b", "knn_n"), ("(a + b) / 2", "combined")], 5))
def _(spark, sf):
    v = vectors(spark, sf)
    e = cut_lineage(NB.nearest_neighbours(v, v, 20))
    s = NB.local_outlier_factor(e, e).join(e.groupBy("id").agg(F.max("dist").alias("knn")), "id")
    return rounded(PE.normalize_scores(cut_lineage(s), ["lof", "knn"]).select("id", "lof_n", "knn_n", "combined"), 5)


def weekly_residual(spark, sf):
    # week_z is already centred and scaled per series
    a = cut_lineage(P.series_arrays(C.weekly(T.filled(spark, sf)), "week_z", "week"))
    n = a.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    return PE.low_rank_residual(a, PE.right_vectors(a, min(20, min(n) - 1)))


@query("low_rank_residual", "I-9")
def _(spark, sf):
    return rounded(PE.residual_shape(weekly_residual(spark, sf)), 4)


@query("reconstruction_errors", "I-10")
def _(spark, sf):
    return rounded(PE.reconstruction_errors(cut_lineage(weekly_residual(spark, sf))), 4)


@query("day_medians", "I-11", "WITH " + PANEL + " SELECT day_idx, quantile_cont(value, 0.5) AS median FROM panel WHERE value IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return PE.day_medians(P.with_day_index(T.readings(spark, sf)).where("day_idx is not null"))  # missing days have no value


@query("global_rank", "I-11", sel(READINGS + """,
m AS (SELECT series_id, avg(value) AS m FROM readings GROUP BY 1)""", "m", "series_id", [("(rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0) / count(*) OVER ()", "global_rank")]))
def _(spark, sf):
    return rounded(PE.global_rank(series_means(spark, sf)))
