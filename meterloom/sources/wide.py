"""Wide meter tables (one column per day) and hourly building tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dates import header_date


def date_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "/" in c and len(c) <= 10]


def read_wide_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with CONS_NO, FLAG and M/D/YYYY columns; every field is read as text and cast on use (no inference pass)."""
    return spark.read.csv(path, header=True)


def unpivot_meters(df: DataFrame, id_col: str = "CONS_NO", label_col: str = "FLAG") -> DataFrame:
    """series_id, label, dt, value: one row per meter and date column. Narrow: no shuffle."""
    cols = date_columns(df)
    typed = df.select(F.col(id_col).alias("series_id"), F.col(label_col).try_cast("int").alias("label"),
                      *[F.col(f"`{c}`").try_cast("double").alias(c) for c in cols])
    long = typed.unpivot(["series_id", "label"], [f"`{c}`" for c in cols], "header", "value")
    return long.select("series_id", "label",
                       F.coalesce(header_date(F.col("header")), F.to_date(F.lit("2000-01-01"))).alias("dt"), "value")


def read_building_csv(spark: SparkSession, path: str, loads: list[str]) -> DataFrame:
    """Hourly rows; Class '0' is dropped; label = theft differs from 'Normal'."""
    raw = spark.read.csv(path, header=True)
    return (raw.where(F.col("Class") != "0")
            .select(F.col("Class").alias("building"), F.col("theft").alias("kind"),
                    (F.col("theft") != "Normal").cast("int").alias("label"),
                    *[F.col(c).try_cast("double").alias(c) for c in loads]))
