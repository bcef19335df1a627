"""Calendar helpers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def header_date(h: Column) -> Column:
    """DATE of an M/D/YYYY header, NULL when malformed."""
    return F.try_to_date(h, "M/d/yyyy")


def parse_headers(df: DataFrame, name: str) -> DataFrame:
    """year, month, day, season (month number), weekday (0 = Monday); malformed headers get 2000-01-01, 6 and 0."""
    d = header_date(F.col(name))
    return df.select(name, F.coalesce(F.year(d), F.lit(2000)).alias("year"), F.coalesce(F.month(d), F.lit(1)).alias("month"),
                     F.coalesce(F.day(d), F.lit(1)).alias("day"), F.coalesce(F.month(d), F.lit(6)).alias("season"),
                     F.coalesce(F.weekday(d), F.lit(0)).alias("weekday"))
