"""Small column helpers shared by the operators."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div(num, den, default=None) -> Column:
    """num/den, NULL (or `default`) where the denominator is 0 or NULL."""
    out = F.try_divide(col(num).cast("double"), col(den).cast("double"))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def share(cond: Column) -> Column:
    """Aggregate: fraction of rows on which `cond` is true (NULL counts as false)."""
    return F.avg(F.coalesce(cond.cast("int"), F.lit(0)).cast("double"))


def avg_if(value, cond: Column) -> Column:
    return F.avg(F.when(cond, col(value)))


def clip(x, lo, hi) -> Column:
    return F.least(F.greatest(col(x), F.lit(float(lo))), F.lit(float(hi)))


def entropy_term(p: Column) -> Column:
    """-p ln p with the limit 0 at p = 0; sum it over the cells of a distribution."""
    return F.when(p > 0, -p * F.log(p)).otherwise(F.lit(0.0))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column; float sums depend on the order of addition."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits).alias(f.name)
        out.append(c)
    return df.select(*out)


def pin(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Add a column that the optimizer does not inline into lambdas, where it would be evaluated once per element."""
    return df.withColumn(name, F.explode(F.array(expr)))
