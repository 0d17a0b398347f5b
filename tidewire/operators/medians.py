"""Exact medians and log-scale spreads of integer counters for many groups, without gathering a group.

Values are first counted per (group, metric, value) with map-side combine. A coarse monotone bucket of
the value bounds what any window sees: one window runs over the buckets of a group (a few hundred at
most), a second over the distinct values of the one or two buckets that hold the middle ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets an octave.
STEPS = 8


def bucket(value: Column) -> Column:
    """A monotone coarse bucket of a number: sign times eighth-octaves of its size."""
    return (F.signum(value) * F.floor(F.log2(F.abs(value) + 1) * STEPS)).cast("int")


def long_values(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row for each non-null metric: keys, metric, value."""
    stack = ", ".join(f"'{m}', `{m}`" for m in metrics)
    return df.selectExpr(*[f"`{k}`" for k in keys], f"stack({len(metrics)}, {stack}) as (metric, value)").where("value is not null")


def group_medians(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Columns keys, metric, n, median, log_spread.

    ``median`` is exact (mean of the two middle values); ``log_spread`` is half the distance of the 16th
    and 84th percentile on a log scale, read off the bucket counts. Groups without values are absent.
    """
    group = [*keys, "metric"]
    counts = long_values(df, keys, metrics).withColumn("bucket", bucket(F.col("value"))).groupBy(*group, "bucket", "value").agg(F.count("*").alias("c"))
    buckets = counts.groupBy(*group, "bucket").agg(F.sum("c").alias("c"))
    along = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*group)
    placed = buckets.withColumn("upto", F.sum("c").over(along)).withColumn("n", F.sum("c").over(whole)).withColumn("before", F.col("upto") - F.col("c"))
    low, high = F.floor((F.col("n") + 1) / 2).cast("long"), (F.floor(F.col("n") / 2) + 1).cast("long")
    holds = lambda rank: (F.col("before") < rank) & (F.col("upto") >= rank)
    share = lambda p: F.min(F.when(F.col("upto") >= F.col("n") * p, F.col("bucket")))
    spread = placed.groupBy(*group).agg(((share(0.84) - share(0.16)) * F.lit(0.6931471805599453 / (2 * STEPS))).alias("log_spread"))
    middle = placed.where(holds(low) | holds(high)).select(*group, "bucket", "n", "before", low.alias("low"), high.alias("high"))
    inside = Window.partitionBy(*group, "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(middle, [*group, "bucket"]).withColumn("upto", F.sum("c").over(inside) + F.col("before"))
    first = F.col("upto") - F.col("c")
    at = lambda rank: F.max(F.when((first < F.col(rank)) & (F.col("upto") >= F.col(rank)), F.col("value")))
    medians = ranked.groupBy(*group).agg(F.max("n").alias("n"), ((at("low") + at("high")) / 2).alias("median"))
    return medians.join(spread, group)


#: Buckets an octave where the values of a group are many and all different.
FINE = 4096


def fine_bucket(value: Column) -> Column:
    """A monotone bucket of a double: sign times the place of its size on a log scale."""
    place = F.floor((F.log2(F.abs(value)) + 1100) * FINE).cast("long") + 1
    return F.when(value > 0, place).when(value < 0, -place).otherwise(F.lit(0).cast("long"))


def exact_medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n and the exact median of a double in few large groups; a group with a third of all rows is never gathered.

    Rows are counted in fine buckets with map-side combine; only the rows of the one or two buckets that hold the middle
    ranks are ranked, each bucket by itself. Nulls are left out, groups without values are absent.
    """
    rows = df.where(F.col(value).isNotNull()).withColumn("_bucket", fine_bucket(F.col(value)))
    counts = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(*keys)
    placed = counts.withColumn("_upto", F.sum("_c").over(whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("_c").over(whole))
    low, high = F.floor((F.col("n") + 1) / 2).cast("long"), (F.floor(F.col("n") / 2) + 1).cast("long")
    holds = lambda rank: (F.col("_upto") - F.col("_c") < rank) & (F.col("_upto") >= rank)
    middle = placed.where(holds(low) | holds(high)).select(*keys, "_bucket", "n", (F.col("_upto") - F.col("_c")).alias("_before"), low.alias("_low"), high.alias("_high"))
    inside = rows.join(middle, [*keys, "_bucket"]).withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(value)) + F.col("_before"))
    at = lambda rank: F.max(F.when(F.col("_rank") == F.col(rank), F.col(value)))
    return inside.groupBy(*keys).agg(F.max("n").alias("n"), ((at("_low") + at("_high")) / 2).alias("median"))
