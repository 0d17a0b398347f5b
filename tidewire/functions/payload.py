"""The stored message document: its schema and its counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.ids import col

MESSAGE = (
    "`_` string, id bigint, date string, message string, entities array<struct<`_`: string, offset: int, length: int, url: string>>, "
    "fwd_from struct<`_`: string, from_id: struct<`_`: string, channel_id: bigint, user_id: bigint>, from_name: string, channel_post: bigint, date: string>, "
    "grouped_id bigint, views bigint, forwards bigint, replies struct<replies: bigint>, "
    "reactions struct<results: array<struct<count: bigint, reaction: struct<`_`: string, emoticon: string, document_id: bigint>>>>"
)
#: How a consumer reads an absent and an empty reaction list.
MODES = ("strict", "empty_is_null", "absent_is_zero")


def parse(payload: Column | str = "payload") -> Column:
    """The message as a struct; an absent field and a JSON null both give SQL NULL."""
    return F.from_json(col(payload), MESSAGE)


def moment(text: Column) -> Column:
    """An ISO date as a timestamp, null if malformed."""
    return F.try_to_timestamp(text)


def parsed(raw: DataFrame) -> DataFrame:
    """channel_id, msg_id, fetched_at and the parsed message p."""
    return raw.select("channel_id", "msg_id", F.col("fetched_at").cast("timestamp").alias("fetched_at"), parse().alias("p"))


def first_fetches(raw: DataFrame) -> DataFrame:
    """The first stored fetch of each message; of several at one moment, the least payload."""
    first = raw.groupBy("channel_id", "msg_id").agg(F.min(F.struct("fetched_at", "payload")).alias("f"))
    return first.select("channel_id", "msg_id", "f.fetched_at", "f.payload")


def reaction_key(reaction: Column) -> Column:
    """The emoji itself, custom:<id>, paid, or unknown."""
    return (
        F.when(reaction["_"] == "ReactionEmoji", F.coalesce(reaction["emoticon"], F.lit("unknown")))
        .when(reaction["_"] == "ReactionCustomEmoji", F.concat(F.lit("custom:"), F.coalesce(reaction["document_id"].cast("string"), F.lit("None"))))
        .when(reaction["_"] == "ReactionPaid", F.lit("paid"))
        .otherwise(F.lit("unknown"))
    )


def reaction_map(reactions: Column) -> Column:
    """Counts by key, equal keys summed; null where the channel publishes none, empty where nobody reacted."""
    pairs = F.transform(
        F.filter(reactions["results"], lambda r: r["count"].isNotNull() & r["reaction"].isNotNull()),
        lambda r: F.struct(reaction_key(r["reaction"]).alias("k"), r["count"].alias("n")),
    )
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    total = lambda k: F.aggregate(F.filter(pairs, lambda p: p["k"] == k), F.lit(0).cast("bigint"), lambda a, p: a + p["n"])
    return F.map_from_arrays(keys, F.transform(keys, total))


def reaction_total(reactions: Column, mode: str = "strict") -> Column:
    """The sum of all reactions; ``mode`` says how an absent and an empty list read."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    results = reactions["results"]
    total = F.aggregate(results, F.lit(0).cast("bigint"), lambda a, r: a + F.coalesce(r["count"], F.lit(0)))
    if mode == "empty_is_null":
        return F.when(F.size(results) > 0, total)
    return F.coalesce(total, F.lit(0).cast("bigint")) if mode == "absent_is_zero" else total


def counters(p: Column | str = "p", mode: str = "strict") -> list[Column]:
    """views, forwards, reactions, comments; null is not zero."""
    p = col(p)
    return [p["views"].alias("views"), p["forwards"].alias("forwards"), reaction_total(p["reactions"], mode).alias("reactions"), p["replies"]["replies"].alias("comments")]


def observations(raw: DataFrame) -> DataFrame:
    """channel_id, msg_id, observed_at, published_at, album and the counters of every fetch of a post; service messages have none."""
    rows = parsed(raw).where("p._ = 'Message'")
    return rows.select("channel_id", "msg_id", F.col("fetched_at").alias("observed_at"), moment(F.col("p.date")).alias("published_at"), F.col("p.grouped_id").alias("album"), *counters()).distinct()


def posts(raw: DataFrame, mode: str = "strict") -> DataFrame:
    """The newest fetch of each post with text, album, forward source and counters."""
    newest = raw.groupBy("channel_id", "msg_id").agg(F.max(F.struct("fetched_at", "payload")).alias("f"))
    rows = parsed(newest.select("channel_id", "msg_id", "f.fetched_at", "f.payload")).where("p._ = 'Message'")
    return rows.select(
        "channel_id", "msg_id", "fetched_at", moment(F.col("p.date")).alias("published"), F.col("p.message").alias("text"), F.col("p.grouped_id").alias("grouped_id"),
        F.col("p.fwd_from.from_id.channel_id").alias("reposted_from"), F.col("p.fwd_from").isNotNull().alias("is_forward"), F.col("p.entities").alias("entities"), *counters(mode=mode),
    )
