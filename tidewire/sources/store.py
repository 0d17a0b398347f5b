"""Idempotent writes as DataFrame transformations: what a table becomes when a batch arrives.

Each function returns the rows to append or the whole new state; nothing is written here, so batch jobs, streaming
``foreachBatch`` and tests share them. Running any of them twice over the same batch changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same_key(left: str, right: str, keys: list[str]) -> Column:
    """Equality of composite keys with nulls equal."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def absent(batch: DataFrame, table: DataFrame, keys: list[str], first_by: list[str] | None = None) -> DataFrame:
    """Insert if absent: the batch's rows whose key the table lacks, one a key (the first in the given order)."""
    if first_by:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*first_by))
        once = batch.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    else:
        once = batch.dropDuplicates(keys)
    return once.alias("b").join(table.select(*keys).distinct().alias("t"), same_key("b", "t", keys), "left_anti")


def latest(table: DataFrame, batch: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Upsert, latest wins: of all rows of a key the last in the given order; ties go to the greatest row."""
    rows = table.unionByName(batch)
    rest = [c for c in rows.columns if c not in keys and c not in by]
    top = rows.groupBy(*keys).agg(F.max(F.struct(*by, *rest)).alias("_row"))
    return top.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def refresh(table: DataFrame, batch: DataFrame, keys: list[str], fresh: list[str], keep: list[str]) -> DataFrame:
    """Upsert of chosen columns: ``fresh`` come from the batch, ``keep`` stay where set; other columns of old rows stay."""
    old, new = table.alias("o"), batch.dropDuplicates(keys).withColumn("_arrived", F.lit(True)).alias("n")
    joined = old.join(new, same_key("o", "n", keys), "full")
    arrived = F.coalesce("n._arrived", F.lit(False))

    def value(c: str) -> Column:
        mine, theirs = F.col(f"o.{c}"), F.col(f"n.{c}") if c in batch.columns else F.lit(None)
        if c in keys or c in keep:
            return F.coalesce(mine, theirs).alias(c)
        return (F.when(arrived, theirs).otherwise(mine) if c in fresh else F.coalesce(mine, theirs)).alias(c)

    return joined.select(*[value(c) for c in table.columns])


def completed_run(runs: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The newest completed run, at most one row; unfinished runs are invisible."""
    rows = runs.where("completed_at is not null")
    if as_of is not None:
        rows = rows.where(F.col("completed_at") <= as_of)
    return rows.orderBy(F.desc("completed_at"), F.desc("id")).limit(1)


def read_entries(spark, path: str) -> DataFrame:
    """entry: the usernames of a text file, one a line; blank lines and # comments are left out, order lost, repeats once."""
    from tidewire.functions.text import valid_entry

    return spark.read.text(path).select(F.trim("value").alias("entry"), valid_entry("value").alias("username")).where("entry <> '' and not startswith(entry, '#')").distinct()


def public_dialogs(dialogs: DataFrame) -> DataFrame:
    """Public channels and supergroups of an exported dialog list; users, groups and private channels are left out."""
    kinds = F.col("type").isin("channel", "megagroup", "supergroup")
    return dialogs.where(kinds & F.col("username").isNotNull()).select(F.col("id").alias("tg_id"), "username", "title", (F.col("type") != "channel").alias("is_chat"))
