"""Comparison of two results: keys on one side only, values equal within tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare(left: DataFrame, right: DataFrame, keys: list[str], value: str, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """part, n: rows in left_only, right_only, equal and differs; two nulls are equal.

    One full outer join and one aggregate with map-side combine; parts without
    rows are 0 for the one-sided ones and absent for the others.
    """
    a = left.select(*keys, F.col(value).alias("_l"), F.lit(True).alias("_inl"))
    b = right.select(*keys, F.col(value).alias("_r"), F.lit(True).alias("_inr"))
    both = a.join(b, keys, "full_outer")
    close = F.coalesce(F.abs(F.col("_l") - F.col("_r")) <= atol + rtol * F.abs("_r"), F.col("_l").isNull() & F.col("_r").isNull())
    part = F.when(F.col("_inr").isNull(), "left_only").when(F.col("_inl").isNull(), "right_only").when(close, "equal").otherwise("differs")
    counts = both.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    named = left.sparkSession.range(2).select(F.element_at(F.array(F.lit("left_only"), F.lit("right_only")), (F.col("id") + 1).cast("int")).alias("part"), F.lit(0).cast("bigint").alias("n"))
    return counts.union(named).groupBy("part").agg(F.sum("n").alias("n"))


def set_report(left: DataFrame, right: DataFrame) -> DataFrame:
    """part (both, left, right) with the distinct rows of the intersection and both differences."""
    tag = lambda name, df: df.select(F.lit(name).alias("part"), *left.columns)
    return tag("both", left.intersect(right)).union(tag("left", left.subtract(right))).union(tag("right", right.subtract(left)))
