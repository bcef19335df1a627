"""Streaming forms (extension S)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..sources import tables as T
from ..streaming import jobs as J
from .catalog import query
from .sqlbase import sel


@query("stream_daily_rollup", "S-1", sel("g AS (SELECT user_id, CAST(ts AS DATE) AS day, count(DISTINCT event_id) AS n, sum(value) AS total FROM events GROUP BY ALL)", "g", "user_id, day, n", "total", 4))
def _(spark, sf):
    return rounded(J.run_whole(J.read_events(spark, sf), J.daily_rollup, "daily"), 4)


@query("stream_sliding_stats", "S-2", sel("""s AS (SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY * k AS start, value FROM events, range(3) t(k)),
g AS (SELECT event_type, start, count(*) AS n, avg(value) AS mean, max(value) AS hi FROM s GROUP BY ALL)""", "g", "event_type, start, n", "mean, hi", 5))
def _(spark, sf):
    x = J.run_whole(J.read_events(spark, sf), J.sliding_stats, "sliding")
    return rounded(x.withColumn("start", F.col("start").cast("timestamp_ntz")), 5)


@query("stream_shift_alarms", "S-3", """WITH r AS (SELECT user_id, ts, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
m AS (SELECT user_id, avg(v) AS mu, stddev_pop(v) + 1e-6 AS sd FROM r WHERE n <= 20 GROUP BY 1),
c AS (SELECT r.*, sd, sum(v - mu - 0.2 * sd) OVER w AS a, sum(mu - 0.2 * sd - v) OVER w AS b FROM r JOIN m USING (user_id) WHERE n > 20 WINDOW w AS (PARTITION BY user_id ORDER BY n)),
s AS (SELECT *, a - least(0, min(a) OVER w) AS up, b - least(0, min(b) OVER w) AS down FROM c WINDOW w AS (PARTITION BY user_id ORDER BY n)),
f AS (SELECT user_id, arg_min(struct_pack(ts := ts, n := n, direction := CASE WHEN up > down THEN 'rise' ELSE 'drop' END), n) AS f FROM s WHERE greatest(up, down) > 3 * sd GROUP BY 1)
SELECT user_id, f.ts AS ts, f.n AS n, f.direction AS direction FROM f""")
def _(spark, sf):
    x = J.run_whole(J.read_events(spark, sf), J.shift_alarms, "alarms")
    return x.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_outages", "S-4", """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS fresh FROM events),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a), c AS (SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM b GROUP BY user_id, s)
SELECT user_id, first_ts, last_ts, n FROM c""")
def _(spark, sf):
    x = J.run_whole(J.read_events(spark, sf), J.outages, "outages")
    return x.withColumn("first_ts", F.col("first_ts").cast("timestamp_ntz")).withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))


@query("stream_gated_scores", "S-5", """WITH pr AS (SELECT user_id, avg(value) AS mu, stddev_pop(value) AS sd FROM events GROUP BY 1),
x AS (SELECT event_id, e.user_id, round(1 / (1 + exp(-(value - mu) / (sd + 1e-6))), 6) AS p, 1 / (1 + exp(-(value - mu) / (sd + 1e-6))) AS r FROM events e JOIN pr USING (user_id))
SELECT event_id, user_id, p, CASE WHEN r >= 0.8 THEN 'alert' WHEN r <= 1 - 0.8 THEN 'pass' ELSE 'review' END AS route FROM x""")
def _(spark, sf):
    prof = T.events(spark, sf).groupBy("user_id").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    return J.run_to_table(J.gated_scores(J.read_events(spark, sf), prof), "scores")
