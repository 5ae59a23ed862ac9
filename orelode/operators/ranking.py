"""Ranking kernels: top fraction, min-max rank, keep-best, merge per target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_fraction(df: DataFrame, count: str, tie: str, fraction: float = 0.1) -> DataFrame:
    """The floor(max(n * fraction, 1)) rows of largest count; ties go to the larger `tie`.

    The cut is found on a histogram of counts (a row per distinct count), so the rows above it are a plain filter; only
    rows of the cut's own count are ordered by `tie`.
    """
    sizes = df.groupBy(F.col(count).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    total = df.count()
    wanted = max(int(total * fraction), 1)
    running = sizes.withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("v"))))
    cut = running.filter((F.col("upto") >= wanted) & (F.col("upto") - F.col("n") < wanted)).select("v", (F.lit(wanted) - F.col("upto") + F.col("n")).alias("r")).first()
    if cut is None:
        return df
    return df.filter(F.col(count) > cut["v"]).unionByName(df.filter(F.col(count) == cut["v"]).orderBy(F.desc(tie)).limit(cut["r"]))


def minmax_rank(df: DataFrame, value: str, out: str = "priority") -> DataFrame:
    """1 to 99 by min-max scaling with half-even rounding; 99 for all where the values are equal. The range is a scalar subquery."""
    lo, hi = df.agg(F.min(value)).scalar(), df.agg(F.max(value)).scalar()
    scaled = F.bround(1 + 98 * (F.col(value) - lo) / (hi - lo), 0).cast("int")
    return df.withColumn(out, F.when(hi <= lo, F.lit(99)).otherwise(F.greatest(F.lit(1), scaled)))


def keep_best(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """One row per key: the largest value, the first in `order` among equals; a partial maximum before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(value), -F.col(order))).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.`{c}`").alias(c) for c in rest])


def first_by(value: Column, order: Column) -> Column:
    return F.min_by(value, order)


def mode_by(df: DataFrame, key: str, value: str, greatest_on_tie: bool = True) -> DataFrame:
    """The most frequent value of each key; ties go to the greatest (or least) value. Two partial aggregations, no window."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    pick = F.max_by if greatest_on_tie else F.min_by
    order = F.struct("n", value) if greatest_on_tie else F.struct(-F.col("n"), F.col(value))
    return counts.groupBy(key).agg(pick(F.struct(value, "n"), order).alias("m")).select(key, F.col(f"m.{value}").alias(value), F.col("m.n").alias("n"))


def nearest_before(df: DataFrame, part: str, order: str, flag: Column, value: str, out: str) -> DataFrame:
    """The last value at which flag held, up to each row (logical-line start, fence state)."""
    w = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(F.when(flag, F.col(value)), ignorenulls=True).over(w))
