"""Shared pieces of the checking SQL (DuckDB dialect)."""
from __future__ import annotations

READINGS = """readings AS (
  SELECT l_suppkey AS series_id, CAST(l_shipdate AS DATE) AS dt, sum(l_quantity) AS value
  FROM lineitem GROUP BY ALL)"""

PANEL = READINGS + """,
span AS (SELECT min(dt) AS lo, max(dt) AS hi, CAST(date_diff('day', min(dt), max(dt)) + 1 AS INTEGER) AS n_days
         FROM readings),
cal AS (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS dt
        FROM span),
panel AS MATERIALIZED (
  SELECT i.series_id, CAST(date_diff('day', s.lo, c.dt) AS INTEGER) AS day_idx, c.dt, r.value,
         r.value IS NULL AS is_missing, coalesce(r.value, 0) AS f, s.n_days
  FROM (SELECT DISTINCT series_id FROM readings) i CROSS JOIN cal c CROSS JOIN span s
  LEFT JOIN readings r ON r.series_id = i.series_id AND r.dt = c.dt)"""

OBSERVED = READINGS + """,
observed AS MATERIALIZED (
  SELECT series_id, dt, value, row_number() OVER (PARTITION BY series_id ORDER BY dt) - 1 AS pos,
         count(*) OVER (PARTITION BY series_id) AS n
  FROM readings WHERE value IS NOT NULL)"""

SCORES = """scores AS MATERIALIZED (
  SELECT vec_id AS id, CAST(label = 0 AS INTEGER) AS y, 'm' || k AS model, k,
         1.0 / (1.0 + exp(-5.0 * CAST(embedding[k + 1] AS DOUBLE))) AS p
  FROM embeddings CROSS JOIN range(64) t(k))"""

TOTALS = """totals AS (SELECT l_suppkey AS series_id, sum(l_quantity) AS total FROM lineitem GROUP BY 1)"""

LABELS = TOTALS + """,
series_labels AS (SELECT series_id, CAST(total >= (SELECT quantile_cont(total, 0.9) FROM totals) AS INTEGER) AS y
                  FROM totals)"""

FOLDS = LABELS + """,
folds AS (SELECT series_id, y, CAST((row_number() OVER (PARTITION BY y
            ORDER BY (series_id * 7919 + 42) % 10007, series_id) - 1) % 5 AS INTEGER) AS fold FROM series_labels)"""


def rnd(expr: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0"


def sel(ctes: str, source: str, keys: str, floats: str | list[str], digits: int = 6, recursive: bool = False) -> str:
    """WITH ctes SELECT keys, rounded floats FROM source. `floats`: names, or (expr, name) pairs."""
    if isinstance(floats, str):
        floats = [x.strip() for x in floats.split(",") if x.strip()]
    parts = [keys] if keys else []
    for f in floats:
        e, n = f if isinstance(f, tuple) else (f, f)
        parts.append(f"{rnd(e, digits)} AS {n}")
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\nSELECT {', '.join(parts)} FROM {source}"
