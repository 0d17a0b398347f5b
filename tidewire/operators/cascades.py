"""Posts that travel: distinct families that carry a post soon after it appears."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.timing import seconds


@dataclass(frozen=True)
class CascadeParams:
    """Bands of distinct families and the window in hours (fixed defaults)."""

    bands: tuple[int, ...] = (2, 3)
    window_hours: float = 6.0

    def __post_init__(self) -> None:
        if not self.bands or min(self.bands) < 1 or self.window_hours <= 0:
            raise ValueError("bands and window must be positive")


def family_or_self(df: DataFrame, families: DataFrame, channel: str, name: str) -> DataFrame:
    """Adds the family of a channel; a channel without one is a family of its own."""
    f = families.select(F.col("channel_id").alias(channel), F.col("family_key").alias("_key"))
    return df.join(f, channel, "left").withColumn(name, F.coalesce("_key", channel)).drop("_key")


def albums(posts: DataFrame) -> DataFrame:
    """channel_id, dst_msg_id, first_part: the first part of the album that a post belongs to."""
    parts = posts.where("grouped_id is not null")
    first = parts.groupBy("channel_id", "grouped_id").agg(F.min("msg_id").alias("first_part"))
    return parts.join(first, ["channel_id", "grouped_id"]).select("channel_id", F.col("msg_id").alias("dst_msg_id"), "first_part")


def reposts(edges: DataFrame, families: DataFrame, posts: DataFrame) -> DataFrame:
    """Forwards of posts with both families; parts of an album count for its first part."""
    rows = edges.where("kind = 'forward' and dst_msg_id is not null").withColumnRenamed("dst_channel_id", "channel_id")
    rows = rows.join(albums(posts), ["channel_id", "dst_msg_id"], "left").withColumn("post_msg", F.coalesce("first_part", "dst_msg_id"))
    rows = family_or_self(family_or_self(rows, families, "src_channel_id", "src_family"), families, "channel_id", "dst_family")
    return rows.select("channel_id", F.col("post_msg").alias("msg_id"), "src_channel_id", "src_family", "dst_family", F.col("dst_published_at").alias("post_published_at"), F.col("published_at").alias("reposted_at"))


def family_counts(rows: DataFrame, params: CascadeParams = CascadeParams(), now: Column | None = None) -> DataFrame:
    """Distinct other families that carried each post within the window of its publication.

    With ``now``, only posts published within the window before it count.
    """
    age = seconds("reposted_at") - seconds("post_published_at")
    limit = params.window_hours * 3600
    kept = rows.where((F.col("src_family") != F.col("dst_family")) & (age >= 0) & (age <= limit))
    if now is not None:
        kept = kept.where((seconds("post_published_at") >= seconds(now) - limit) & (seconds("reposted_at") <= seconds(now)))
    return kept.groupBy("channel_id", "msg_id").agg(F.countDistinct("src_family").alias("families"))


def crossings(rows: DataFrame, params: CascadeParams = CascadeParams(), now: Column | None = None, raised: DataFrame | None = None) -> DataFrame:
    """channel_id, msg_id, band, families of every band that a post has reached and that was not raised before."""
    counts = family_counts(rows, params, now)
    bands = counts.withColumn("band", F.explode(F.array(*[F.lit(b) for b in params.bands]))).where("families >= band")
    if raised is not None:
        bands = bands.join(raised, ["channel_id", "msg_id", "band"], "left_anti")
    return bands.select("channel_id", "msg_id", "band", "families")


def cited(rows: DataFrame, min_families: int = 2) -> DataFrame:
    """Posts carried by more than ``min_families`` other families at any time, with sources and first date."""
    counts = rows.where("src_family <> dst_family").groupBy("channel_id", "msg_id")
    found = counts.agg(F.countDistinct("src_family").alias("families"), F.countDistinct("src_channel_id").alias("sources"), F.min("post_published_at").alias("published"))
    return found.where(F.col("families") > min_families)


def cited_order() -> list[Column]:
    return [F.desc("families"), F.desc("sources"), F.desc_nulls_last("published"), F.asc("channel_id"), F.asc("msg_id")]
