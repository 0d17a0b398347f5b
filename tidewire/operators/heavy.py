"""Work per key without imbalance: fragment-replicate by estimated load.

Loads are estimated by one combined count of all rows. Keys above a share of a task's load are split into
shards in proportion; shards, and the remaining keys in hash buckets, are packed into tasks, largest first
into the emptiest. Only keys above the threshold come to the driver: with T tasks and a threshold of 1/(SPLIT*T)
of all rows there are at most SPLIT*T of them, whatever the data.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.session import materialise

#: A key is split where it holds more than 1/SPLIT of a task's even share; light keys go by BUCKETS a task.
SPLIT = 4
BUCKETS = 8


@dataclass(frozen=True)
class Plan:
    """heavy: key -> tasks of its shards; light: task of each hash bucket of the other keys; load: rows of each task."""

    tasks: int
    heavy: dict[int, list[int]]
    light: list[int]
    load: list[int]


def pack(loads: dict[int, int], buckets: list[int], tasks: int) -> Plan:
    """Largest item first into the emptiest task; a key of s shards adds load/s to each."""
    even = max(1, (sum(loads.values()) + sum(buckets)) / tasks)
    items = []
    for key, n in loads.items():
        shards = max(1, min(tasks, round(SPLIT * n / even)))
        items += [(n / shards, 0, key)] * shards
    items += [(n, 1, b) for b, n in enumerate(buckets)]
    heap = [(0.0, t) for t in range(tasks)]
    heavy: dict[int, list[int]] = {}
    light = [0] * len(buckets)
    for n, kind, what in sorted(items, reverse=True):
        load, t = heapq.heappop(heap)
        if kind:
            light[what] = t
        else:
            heavy.setdefault(what, []).append(t)
        heapq.heappush(heap, (load + n, t))
    load = [0] * tasks
    for n, t in heap:
        load[t] = round(n)
    return Plan(tasks, heavy, light, load)


def tasks_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plan_loads(df: DataFrame, key: str, tasks: int) -> Plan:
    """Estimate loads with one partial count over all rows, and pack them."""
    buckets = BUCKETS * tasks
    counts = materialise(df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")))
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    even = (counts.agg(F.sum("n")).first()[0] or 0) / tasks
    heavy = {r["key"]: r["n"] for r in counts.where(F.col("n") > even / SPLIT).collect()}  # fewer than SPLIT * tasks
    light = [0] * buckets
    for r in counts.where(F.col("n") <= even / SPLIT).groupBy(bucket.alias("b")).agg(F.sum("n").alias("n")).collect():  # one row a bucket
        light[r["b"]] = r["n"]
    return pack(heavy, light, tasks)


def plan_tables(spark: SparkSession, plan: Plan, key: str) -> tuple[DataFrame, DataFrame]:
    """The plan as two tables of a few rows a task: key and its tasks, bucket and its task."""
    kind = f"{key} bigint, heavy_tasks array<int>"
    return spark.createDataFrame(list(plan.heavy.items()), kind), spark.createDataFrame(list(enumerate(plan.light)), "bucket int, light_task int")


def shards_of(df: DataFrame, key: str, plan: Plan) -> DataFrame:
    """Rows with a key, and the tasks that hold rows of it: its shards, or the one task of its bucket.

    Both tables of the plan are bounded by the number of tasks, whatever the data, so they are broadcast.
    """
    heavy, light = plan_tables(df.sparkSession, plan, key)
    rows = df.where(F.col(key).isNotNull()).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(len(plan.light))).cast("int"))
    rows = rows.join(F.broadcast(heavy), key, "left").join(F.broadcast(light), "bucket")
    return rows.withColumn("shards", F.coalesce("heavy_tasks", F.array("light_task"))).drop("bucket", "heavy_tasks", "light_task")


def fragment(df: DataFrame, key: str, by: list[str], plan: Plan) -> DataFrame:
    """Rows with a key, on the tasks of the plan; rows equal in ``by`` stay together. Adds the column ``task``."""
    shard = F.pmod(F.xxhash64(*by), F.size("shards").cast("long")).cast("int")
    placed = shards_of(df, key, plan).withColumn("task", F.get("shards", shard)).drop("shards")
    return placed.repartitionById(plan.tasks, F.col("task"))


def replicate(df: DataFrame, key: str, plan: Plan) -> DataFrame:
    """The matching side: each row goes only to the tasks that hold shards of its key. Adds the column ``task``."""
    placed = shards_of(df, key, plan).withColumn("task", F.explode(F.array_distinct("shards"))).drop("shards")
    return placed.repartitionById(plan.tasks, F.col("task"))


def fragment_join(left: DataFrame, right: DataFrame, key: str, by: list[str], plan: Plan, how: str = "inner") -> DataFrame:
    """Inner or left join of a skewed left side with one row a key on the right; every task reads its even share."""
    if how not in ("inner", "left"):
        raise ValueError("the left side may be kept, the right one not")
    return fragment(left, key, by, plan).join(replicate(right, key, plan).hint("shuffle_hash"), ["task", key], how)
