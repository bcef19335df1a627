"""Lower convex hulls of cumulative counts, for groups of any size.

Hulls merge: the hull of all points is the hull of the hulls of their ranges. Each range of x holds a bounded number of
points; what is left of neighbouring ranges meets in a range 64 times as wide, until one is left. Counts are whole numbers,
compared exactly. A hull of counts up to n has at most about 3 n^(2/3) corners.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CHUNK, WIDEN = 1 << 17, 64


def lower_corners(x: list[int], y: list[int]) -> list[int]:
    """Indexes of the corners of the lower hull; x rises strictly, and points on an edge are left out."""
    out: list[int] = []
    for i in range(len(x)):
        while len(out) > 1:
            a, b = out[-2], out[-1]
            if (y[b] - y[a]) * (x[i] - x[b]) < (y[i] - y[b]) * (x[b] - x[a]):
                break
            out.pop()
        out.append(i)
    return out


def _corners(x: str, y: str):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(x)
        return table.take(lower_corners(table.column(x).to_pylist(), table.column(y).to_pylist()))

    return run


def lower_hull(points: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Those rows of `points` that are corners of the lower hull of (x, y) in their group; x and y are whole numbers, x is
    distinct in a group. All columns stay."""
    top = points.agg(F.max(x)).first()[0] or 0
    size = CHUNK
    while True:
        ranged = points.withColumn("_range", F.floor(F.col(x) / size))
        points = ranged.groupBy(*by, "_range").applyInArrow(_corners(x, y), ranged.schema).drop("_range")
        if size > top:
            return points
        size *= WIDEN
