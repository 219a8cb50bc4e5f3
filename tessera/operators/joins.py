"""Joins by order: for each row the last (or nearest) row of another table with the same key.

A key's rows are cut into buckets of `width` along the order, and each bucket is given the last row before it. A
window then runs within a key and bucket, so that a key with very many rows spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: str, on: str, values: list[str], width: float, forward: bool = False) -> DataFrame:
    """left with the `values` of the last row of right of equal `by` whose `on` is not greater (not less, if forward);
    null where there is none. `on` is a number; of right rows with equal `by` and `on` the one of the greatest values
    counts. Rows of null `by` or `on` have no partner."""
    sign = -1 if forward else 1
    at: Column = F.col(on) * sign
    bucket = F.floor(at / width)
    held = F.struct(at.alias("at"), *values)
    rights = right.where(F.col(by).isNotNull() & F.col(on).isNotNull()).select(F.col(by).alias("by"), bucket.alias("bucket"), held.alias("held"))
    lefts = left.select(F.struct("*").alias("row"), F.col(by).alias("by"), at.alias("at"), bucket.alias("bucket"))
    ends = rights.groupBy("by", "bucket").agg(F.max("held").alias("end"))
    known = ends.unionByName(lefts.where("by is not null and bucket is not null").select("by", "bucket").distinct(), allowMissingColumns=True)
    known = known.groupBy("by", "bucket").agg(F.max("end").alias("end"))
    before = F.last("end", ignorenulls=True).over(Window.partitionBy("by").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    carried = known.select("by", "bucket", before.alias("held")).where("held is not null")
    every = rights.select("by", "bucket", F.col("held.at").alias("at"), "held", F.lit(0).alias("side"))
    every = every.unionByName(carried.select("by", "bucket", F.col("held.at").alias("at"), "held", F.lit(0).alias("side")))
    every = every.unionByName(lefts.select("by", "bucket", "at", "row", F.lit(1).alias("side")), allowMissingColumns=True)
    last = F.last("held", ignorenulls=True).over(Window.partitionBy("by", "bucket").orderBy("at", "side", "held").rowsBetween(Window.unboundedPreceding, 0))
    found = every.withColumn("last", last).where("side = 1")
    none = F.col("by").isNull() | F.col("at").isNull()
    return found.select("row.*", *(F.when(~none, F.col(f"last.{v}")).alias(v) for v in values), F.when(~none, F.col("last.at") * sign).alias("matched"))


def nearest(left: DataFrame, right: DataFrame, by: str, on: str, values: list[str], width: float) -> DataFrame:
    """left with the values of the row of right of equal `by` whose `on` is nearest; of two as near, the earlier."""
    names = left.columns
    back = as_of(left, right, by, on, values, width)
    both = as_of(back.select(F.struct(*names).alias("row"), F.struct(*values, "matched").alias("back"), by, on), right, by, on, values, width, forward=True)
    ahead = F.struct(*values, "matched")
    here = F.col(on)
    nearer = F.col("back.matched").isNull() | (F.abs(F.col("matched") - here) < F.abs(F.col("back.matched") - here))
    chosen = both.withColumn("chosen", F.when(nearer & F.col("matched").isNotNull(), ahead).otherwise(F.col("back")))
    return chosen.select("row.*", *(F.col(f"chosen.{v}").alias(v) for v in [*values, "matched"]))
