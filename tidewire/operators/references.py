"""References in and out per channel, with the work of heavy channels spread evenly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.ids import bare_id
from tidewire.operators.heavy import fragment_join, plan_loads, tasks_of

NATURAL = ("src_channel_id", "msg_id", "kind", "dst_channel_id", "dst_msg_id")
SIDES = {"src": "src_channel_id", "dst": "dst_channel_id"}


def bare_edges(edges: DataFrame) -> DataFrame:
    """The natural key with ids in bare form, still with repeats."""
    return edges.select(bare_id("src_channel_id").alias("src_channel_id"), "msg_id", "kind", bare_id("dst_channel_id").alias("dst_channel_id"), "dst_msg_id")


def known_kinds(channels: DataFrame, key: str) -> DataFrame:
    """One row a channel of the inventory: its id under the name ``key`` and the least non-null kind of its rows."""
    return channels.select(bare_id("tg_id").cast("long").alias(key), F.col("kind").alias("channel_kind")).where(F.col(key).isNotNull()).groupBy(key).agg(F.min("channel_kind").alias("channel_kind"), F.lit(True).alias("known"))


def reference_counts(edges: DataFrame, channels: DataFrame, heavy_share: float = 0.02) -> DataFrame:
    """side, channel_id, kind, known, refs (distinct edges), forwards, share, heavy, for all channels at either end.

    An edge counts once for its natural key, nulls being equal; an edge without a channel at one end counts for the
    other end and towards neither side's channels there. ``share`` is of the distinct edges with a channel at that end.
    Edges are fragmented by the load of their channel; the channel's inventory row is replicated to its shards and joined
    there, where each edge is counted once; only one partial count a shard moves on. A channel that the inventory lacks is
    not known and has no kind.
    """
    rows, out = bare_edges(edges), []
    tasks = tasks_of(edges.sparkSession)
    for side, key in SIDES.items():
        plan = plan_loads(rows, key, tasks)
        joined = fragment_join(rows, known_kinds(channels, key), key, list(NATURAL), plan, "left")
        once = joined.groupBy("task", *NATURAL).agg(F.min("channel_kind").alias("channel_kind"), F.max("known").alias("known"))  # on the task that holds them already
        part = once.groupBy("task", key).agg(F.count("*").alias("refs"), F.count_if(F.col("kind") == "forward").alias("forwards"), F.min("channel_kind").alias("channel_kind"), F.max("known").alias("known"))
        sums = [F.min("channel_kind").alias("kind"), F.coalesce(F.max("known"), F.lit(False)).alias("known"), F.sum("refs").alias("refs"), F.sum("forwards").alias("forwards")]
        out.append(part.groupBy(F.lit(side).alias("side"), F.col(key).alias("channel_id")).agg(*sums))
    counts = out[0].unionByName(out[1])
    totals = counts.groupBy("side").agg(F.sum("refs").alias("total"))  # two rows
    share = F.col("refs") / F.col("total")
    return counts.join(F.broadcast(totals), "side").select("side", "channel_id", "kind", "known", "refs", "forwards", share.alias("share"), (share >= heavy_share).alias("heavy"))


def heavy_channels(edges: DataFrame, channels: DataFrame, heavy_share: float = 0.02) -> DataFrame:
    """side, channel_id of the channels that hold at least the given share of all distinct edges at that end."""
    return reference_counts(edges, channels, heavy_share).where("heavy").select("side", "channel_id")


def kinds_referred_to(edges: DataFrame, channels: DataFrame) -> DataFrame:
    """Distinct references into each kind of channel: src_channel_id, kind_of_target, refs.

    The inventory row of a heavy target is copied to the tasks of its shards only. A channel with several rows has the
    least non-null kind of them; targets that the inventory lacks, or of no kind, are left out.
    """
    rows = bare_edges(edges)
    known = known_kinds(channels, "dst_channel_id").where("channel_kind is not null").select("dst_channel_id", F.col("channel_kind").alias("target_kind"))
    plan = plan_loads(rows, "dst_channel_id", tasks_of(edges.sparkSession))
    joined = fragment_join(rows, known, "dst_channel_id", list(NATURAL), plan)
    once = joined.groupBy("task", *NATURAL, "target_kind").agg(F.lit(1).alias("one"))
    return once.groupBy("src_channel_id", F.col("target_kind").alias("kind_of_target")).agg(F.count("*").alias("refs"))
