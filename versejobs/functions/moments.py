"""Mean and deviation that don't depend on the order of rows: values become whole numbers, whose sums are exact."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values are rounded to multiples of 1 / UNIT once, each by itself; they must be below 10, and fewer than 10**12.
UNIT = 1 << 43


def sums(value: Column | str, name: str = "") -> list[Column]:
    """Aggregates: number, sum and sum of squares of a column in units; null and NaN don't count."""
    c = F.nullif(F.col(value) if isinstance(value, str) else value, F.lit(float("nan")))
    m = F.round(c * UNIT).cast("decimal(14,0)")
    return [F.count(m).alias(f"{name}_n"), F.sum(m).cast("decimal(38,0)").alias(f"{name}_s"), F.sum(m * m).cast("decimal(38,0)").alias(f"{name}_q")]


def mean(name: str = "") -> Column:
    return F.expr(f"cast({name}_s AS double) / nullif({name}_n, 0) / {UNIT}D")


def deviation(name: str = "") -> Column:
    """Sample deviation; null for fewer than two values, exactly 0 for equal ones.

    With the whole mean w and what is left of the sum, squares are taken from w, so the large parts cancel in whole numbers.
    """
    n, s, q = f"{name}_n", f"{name}_s", f"{name}_q"
    w = f"cast({s} div nullif({n}, 0) AS decimal(14,0))"
    left = f"({s} - {w} * {n})"
    around = f"({q} - {w} * cast({s} + {left} AS decimal(38,0)))"
    square = f"(cast({around} AS double) - cast({left} AS double) * cast({left} AS double) / nullif({n}, 0)) / nullif({n} - 1, 0)"
    return F.expr(f"if({n} > 1, sqrt(greatest(0D, {square})) / {UNIT}D, NULL)")


def described(rows: DataFrame, value: str, by: tuple = ()) -> DataFrame:
    """The columns of `by`, n, mean, std, least and greatest of a column."""
    found = rows.groupBy(*by).agg(F.count("*").alias("n"), *sums(value), F.min(value).alias("least"), F.max(value).alias("greatest"))
    return found.select(*by, "n", mean().alias("mean"), deviation().alias("std"), "least", "greatest")
