"""Medians, spreads, entropies and scores that a tail cannot move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns a median absolute deviation into a standard deviation.
MAD_SCALE = 1.4826


def median(c: Column) -> Column:
    """Exact median with linear interpolation."""
    return F.percentile(c, F.lit(0.5))


def robust_z(df: DataFrame, columns: dict[str, str], clip: float = 4.0) -> DataFrame:
    """Adds <column>_z for each column (with its transform: log, sqrt or none): distance from the table's median in robust
    deviations, clipped; null if nothing varies.

    One row of two numbers a column is broadcast, whatever the table's size; the table is read three times, not once a column.
    """
    value = {c: {"log": F.log1p(c), "sqrt": F.sqrt(F.col(c).cast("double")), "none": F.col(c).cast("double")}[t] for c, t in columns.items()}
    centre = df.agg(*[median(v).alias(f"_{c}_m") for c, v in value.items()])
    spread = df.crossJoin(F.broadcast(centre)).agg(*[median(F.abs(v - F.col(f"_{c}_m"))).alias(f"_{c}_s") for c, v in value.items()])
    rows = df.crossJoin(F.broadcast(centre.crossJoin(spread)))
    for c, v in value.items():
        scaled = (v - F.col(f"_{c}_m")) / (MAD_SCALE * F.col(f"_{c}_s"))
        rows = rows.withColumn(f"{c}_z", F.when((F.col(f"_{c}_s") > 0) & scaled.isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), scaled))))
    return rows.drop(*[f"_{c}_{x}" for c in columns for x in "ms"])


def mean_of(parts: list[Column]) -> Column:
    """The mean of the non-null parts; null if there is none."""
    n = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in parts), F.lit(0))
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    return F.when(n > 0, total / n)


def group_spread(df: DataFrame, keys: list[str], values: list[str], quantile: float = 0.84) -> DataFrame:
    """Adds <value>_median and <value>_spread of each value: the larger of scaled MAD and upper half-spread; null if zero.

    Two aggregations for all values together, joined on the keys; no window holds a whole group's rows.
    """
    first = df.groupBy(*keys).agg(*[x for v in values for x in (median(F.col(v)).alias(f"{v}_median"), F.percentile(F.col(v), F.lit(quantile)).alias(f"_{v}_upper"))])
    rows = df.join(first, keys, "left")
    second = rows.groupBy(*keys).agg(*[median(F.abs(F.col(v) - F.col(f"{v}_median"))).alias(f"_{v}_mad") for v in values])
    rows = rows.join(second, keys, "left")
    for v in values:
        widest = F.greatest(F.col(f"_{v}_mad") * MAD_SCALE, F.col(f"_{v}_upper") - F.col(f"{v}_median"))
        rows = rows.withColumn(f"{v}_spread", F.when(widest > 0, widest)).drop(f"_{v}_mad", f"_{v}_upper")
    return rows


def entropy(share: Column) -> Column:
    """Shannon entropy in bits, as an aggregate over the shares of a distribution."""
    return -F.sum(share * F.log2(share))
