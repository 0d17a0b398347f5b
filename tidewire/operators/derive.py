"""From stored messages to the directed reference graph.

Everything is one declarative plan: messages are parsed once, forwards and entity references are branches of it, and
channels discovered by any forward are known to every id link (the fixpoint of repeated passes, in one).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.ids import bare_id
from tidewire.functions.payload import moment, parsed
from tidewire.functions.text import entity_references

SOURCE_STATUSES = ("candidate", "seed", "maybe")
KEY = ["src_channel_id", "msg_id", "kind", "dst_channel_id", "dst_msg_id"]


@dataclass(frozen=True)
class Derived:
    edges: DataFrame
    discovered: DataFrame
    pending: DataFrame


def inventory(channels: DataFrame) -> DataFrame:
    """One row a channel in bare id form; of several rows the one seen first, then the least username."""
    rows = channels.withColumn("tg_id", bare_id("tg_id")).where("tg_id is not null")
    order = F.struct("first_seen_at", F.coalesce("username", F.lit("~")).alias("u"), "status", "kind", "title", "is_chat", "username", "linked_to", "discovered_via", "resolved_at", "resolve_attempts", "reject_reason")
    one = rows.groupBy("tg_id").agg(F.min(order).alias("c"))
    return one.select("tg_id", *[F.col(f"c.{c}").alias(c) for c in ("username", "title", "is_chat", "status", "kind", "reject_reason", "discovered_via", "linked_to", "resolved_at", "resolve_attempts", "first_seen_at")])


def usernames(channels: DataFrame) -> DataFrame:
    """name and dst: the channel of each username in lower case; the highest id wins where several hold it."""
    return channels.where("username is not null").groupBy(F.lower("username").alias("name")).agg(F.max("tg_id").alias("dst"))


def source_messages(raw: DataFrame, channels: DataFrame) -> DataFrame:
    """Dated messages of the channels that are sources (not chats and not rejected), as their first fetch shows them.

    References are read before the fetches of a message meet, so texts and documents are never shuffled.
    """
    scope = channels.where(F.col("status").isin(*SOURCE_STATUSES) & ~F.col("is_chat")).select(F.col("tg_id").alias("channel_id"))
    narrow = F.struct("fetched_at", F.col("p.date").alias("date"), F.col("p.grouped_id").alias("grouped_id"), F.col("p.fwd_from").alias("fwd"), entity_references("p.message", "p.entities").alias("refs"))
    first = parsed(raw).groupBy("channel_id", "msg_id").agg(F.min(narrow).alias("m"))
    rows = first.join(scope, "channel_id", "left_semi").withColumn("published_at", moment(F.col("m.date"))).where("published_at is not null")
    return rows.select("channel_id", "msg_id", "published_at", "m.grouped_id", "m.fwd", "m.refs")


def forwards(messages: DataFrame) -> DataFrame:
    """References by forward of another channel's post; users, hidden origins and the channel itself are none."""
    target = F.col("fwd.from_id")
    return messages.where((target["_"] == "PeerChannel") & target["channel_id"].isNotNull() & (target["channel_id"] != F.col("channel_id"))).select(
        F.col("channel_id").alias("src_channel_id"), "msg_id", F.lit("forward").alias("kind"), target["channel_id"].alias("dst_channel_id"), F.col("fwd.channel_post").alias("dst_msg_id"),
        "published_at", moment(F.col("fwd.date")).alias("dst_published_at"), "grouped_id",
    )


def named(messages: DataFrame) -> DataFrame:
    """One row for each entity reference of a message: username or channel_id, and the post's id."""
    rows = messages.select(F.col("channel_id").alias("src_channel_id"), "msg_id", "published_at", "grouped_id", F.explode("refs").alias("r"))
    return rows.select("src_channel_id", "msg_id", "published_at", "grouped_id", "r.username", "r.channel_id", F.col("r.msg_id").alias("dst_msg_id"))


def derive(raw: DataFrame, channels: DataFrame) -> Derived:
    """Edges, newly discovered channels and mentions of unknown names.

    A username resolves by the inventory alone; an id link resolves if the inventory or any forward knows the id. A
    channel's references to itself are dropped; equal references of one message are one edge. Nulls in keys are equal.
    """
    known = inventory(channels)
    messages = source_messages(raw, known)
    fwd, refs = forwards(messages), named(messages)
    ids = known.select(F.col("tg_id").alias("dst_channel_id"))
    discovered = fwd.select("dst_channel_id").distinct().join(ids, "dst_channel_id", "left_anti").select(F.col("dst_channel_id").alias("tg_id"), F.lit("forward").alias("discovered_via"))
    by_name = refs.where("username is not null").join(usernames(known), F.col("username") == F.col("name"), "left")
    pending = by_name.where("dst is null").select("username", F.col("src_channel_id").alias("channel_id")).distinct()
    all_ids = ids.union(discovered.select("tg_id"))
    by_id = refs.where("channel_id is not null").withColumn("dst_channel_id", F.col("channel_id")).join(all_ids, "dst_channel_id", "left_semi")
    columns = ["src_channel_id", "msg_id", F.lit("mention").alias("kind"), "dst_channel_id", "dst_msg_id", "published_at", F.lit(None).cast("timestamp").alias("dst_published_at"), "grouped_id"]
    mentions = by_name.where("dst is not null").withColumn("dst_channel_id", F.col("dst")).select(*columns).unionByName(by_id.select(*columns))
    every = fwd.unionByName(mentions.where("src_channel_id <> dst_channel_id"))
    edges = every.groupBy(*KEY).agg(*[F.min(c).alias(c) for c in ("published_at", "dst_published_at", "grouped_id")])
    return Derived(edges, discovered, pending)


def pending_queue(pending: DataFrame, channels: DataFrame, min_sources: int = 1) -> DataFrame:
    """Unknown usernames by how many channels mention them; names that a channel holds by now are left out."""
    held = channels.where("username is not null").select(F.lower("username").alias("username")).distinct()
    counts = pending.groupBy("username").agg(F.countDistinct("channel_id").alias("sources"))
    return counts.where(F.col("sources") >= min_sources).join(held, "username", "left_anti").orderBy(F.desc("sources"), "username")


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Stored edges in bare id form, each natural key once (the earliest derivation's dates); nulls are equal."""
    rows = edges.withColumn("src_channel_id", bare_id("src_channel_id")).withColumn("dst_channel_id", bare_id("dst_channel_id"))
    return rows.groupBy(*KEY).agg(*[F.min(c).alias(c) for c in ("published_at", "dst_published_at", "grouped_id", "derived_at")])


def missing_edges(derived: DataFrame, stored: DataFrame) -> DataFrame:
    """Derived edges that the store lacks, nulls in the key being equal."""
    old = distinct_edges(stored).select(*[F.col(k).alias(f"_{k}") for k in KEY])
    match = F.lit(True)
    for k in KEY:
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return derived.join(old, match, "left_anti")
