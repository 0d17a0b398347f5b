"""Listings and report sections: what a reader sees of channels, candidates, posts and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.robust import median
from tidewire.functions.timing import seconds
from tidewire.operators.cascades import family_or_self


def volume_shares(posts: DataFrame, channels: DataFrame) -> DataFrame:
    """channel_id, posts, fwd_share, text_share of seeds that are no chats; posts: channel_id, is_forward, text."""
    seeds = channels.where("status = 'seed' and not is_chat").select(F.col("tg_id").alias("channel_id"))
    share = lambda c: F.avg(c.cast("int"))
    return posts.join(seeds, "channel_id", "left_semi").groupBy("channel_id").agg(F.count("*").alias("posts"), share(F.coalesce("is_forward", F.lit(False))).alias("fwd_share"), share(F.coalesce("text", F.lit("")) != "").alias("text_share"))


def collected_spans(posts: DataFrame) -> DataFrame:
    """Posts, first and last publication of each channel."""
    return posts.groupBy("channel_id").agg(F.count("*").alias("posts"), F.min("published").alias("first_at"), F.max("published").alias("last_at"))


def watched_spans(observations: DataFrame) -> DataFrame:
    """Readings, posts read, first and last reading of each channel."""
    return observations.groupBy("channel_id").agg(F.count("*").alias("readings"), F.countDistinct("msg_id").alias("posts"), F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at"))


def outside_family(edges: DataFrame, families: DataFrame) -> DataFrame:
    """Edges between different families: src_channel_id and dst_channel_id with src_family and dst_family."""
    rows = family_or_self(family_or_self(edges, families, "src_channel_id", "src_family"), families, "dst_channel_id", "dst_family")
    return rows.where("src_family <> dst_family")


def incoming_section(edges: DataFrame, channels: DataFrame, families: DataFrame) -> DataFrame:
    """Seeds that reference each channel, without its own family: forwards, mentions, last date."""
    seeds = channels.where("status = 'seed'").select(F.col("tg_id").alias("src_channel_id"), "title", "username")
    count = lambda kind: F.count_if(F.col("kind") == kind)
    rows = outside_family(edges, families).join(seeds, "src_channel_id").groupBy("dst_channel_id", "title", "username")
    return rows.agg(count("forward").alias("forwards"), count("mention").alias("mentions"), F.max("published_at").alias("last_at"))


def outgoing_section(edges: DataFrame, families: DataFrame) -> DataFrame:
    """References of each channel out of its family, by kind, and how many channels they reach; none is named."""
    return outside_family(edges, families).groupBy("src_channel_id", "kind").agg(F.count("*").alias("refs"), F.countDistinct("dst_channel_id").alias("targets"))


def travelled_section(edges: DataFrame, channels: DataFrame, families: DataFrame) -> DataFrame:
    """Posts of each channel that seeds of other families carried: families, sources and the first date of the post."""
    seeds = channels.where("status = 'seed'").select(F.col("tg_id").alias("src_channel_id"))
    rows = outside_family(edges.where("kind = 'forward' and dst_msg_id is not null"), families).join(seeds, "src_channel_id", "left_semi")
    return rows.groupBy("dst_channel_id", "dst_msg_id").agg(F.min("dst_published_at").alias("published_at"), F.countDistinct("src_family").alias("families"), F.countDistinct("src_channel_id").alias("sources"))


def affiliated_section(families: DataFrame, channels: DataFrame, posts: DataFrame) -> DataFrame:
    """family_key and the family's channels with title, username, is_chat and number of posts (zero too)."""
    sizes = posts.groupBy("channel_id").agg(F.count("*").alias("posts"))
    names = channels.select(F.col("tg_id").alias("channel_id"), "title", "username", "is_chat")
    return families.join(names, "channel_id").join(sizes, "channel_id", "left").withColumn("posts", F.coalesce("posts", F.lit(0).cast("bigint")))


def count_families(families: DataFrame) -> DataFrame:
    """One row: families of two or more, channels in them."""
    return families.agg(F.countDistinct("family_key").alias("families"), F.count("*").alias("channels"))


def list_channels(channels: DataFrame, families: DataFrame, status: str | None = None, family: int | None = None) -> DataFrame:
    """The inventory by status and id, of one status or one family (a channel without one is its own)."""
    rows = family_or_self(channels, families, "tg_id", "family_key")
    rows = rows if status is None else rows.where(F.col("status") == status)
    return (rows if family is None else rows.where(F.col("family_key") == family)).orderBy("status", "tg_id")


def list_candidates(candidates: DataFrame, channels: DataFrame, decided: bool = False, seeds_only: bool = True, limit: int | None = None) -> DataFrame:
    """Candidate pairs with names and states of both channels, best score first, then by pair; pending ones unless ``decided``."""
    side = lambda x: channels.select(F.col("tg_id").alias(f"channel_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("username", "title", "status")])
    rows = candidates if decided else candidates.where("decision = 'pending'")
    rows = rows.join(side("a"), "channel_a").join(side("b"), "channel_b")
    rows = rows.where("status_a = 'seed' or status_b = 'seed'") if seeds_only else rows
    rows = rows.orderBy(F.desc("score"), "channel_a", "channel_b")
    return rows if limit is None else rows.limit(limit)


def evidence_line(rows: DataFrame) -> DataFrame:
    """A line of text with what speaks for each candidate pair, the strongest signals first."""
    number = lambda c, d=2: F.format_number(F.col(c), d)
    parts = [
        F.when(F.col("about_direction").isNotNull(), F.concat(F.lit("description "), "about_direction")),
        F.when(F.col("handle_token").isNotNull(), F.concat(F.lit("handle "), "handle_token", F.lit(" in "), F.col("handle_token_channels").cast("string"))),
        F.when(F.col("out_share").isNotNull(), F.concat(F.lit("share "), number("out_share"), F.lit(" of "), F.col("out_share_edges").cast("string"))),
        F.when(F.col("shared_token").isNotNull(), F.concat(F.lit("token "), "shared_token", F.lit(" in "), F.col("shared_token_channels").cast("string"))),
        F.when(F.col("edges_a_to_b").isNotNull(), F.concat(F.lit("mutual "), F.col("edges_a_to_b").cast("string"), F.lit("/"), F.col("edges_b_to_a").cast("string"))),
    ]
    return rows.withColumn("line", F.concat_ws("; ", *parts))


def handle_blocks(candidates: DataFrame) -> DataFrame:
    """Pairs that a shared handle token joins, as one block a token: pairs, channels."""
    rows = candidates.where("handle_token is not null").select("handle_token", "channel_a", "channel_b").distinct()
    ends = rows.select("handle_token", F.explode(F.array("channel_a", "channel_b")).alias("channel"))
    pairs = rows.groupBy("handle_token").agg(F.count("*").alias("pairs"))
    return pairs.join(ends.groupBy("handle_token").agg(F.countDistinct("channel").alias("channels")), "handle_token")


def alert_evidence(alerts: DataFrame, posts: DataFrame, channels: DataFrame, edges: DataFrame, window_hours: float = 6.0) -> DataFrame:
    """channel_id, msg_id, title, username, published, text and the carriers of each post with an alert, one row a carrier.

    Carriers are the channels that forwarded the post up to the window after its publication, each once; a post without
    any has one row of nulls, an alert whose post or channel is not stored none.
    """
    names = channels.select(F.col("tg_id").alias("channel_id"), "title", "username")
    held = alerts.select("channel_id", "msg_id").distinct().join(posts.select("channel_id", "msg_id", "published", "text"), ["channel_id", "msg_id"]).join(names, "channel_id")
    by = channels.select(F.col("tg_id").alias("src_channel_id"), F.col("title").alias("carrier_title"), F.col("username").alias("carrier_username"))
    sent = edges.where("kind = 'forward' and dst_msg_id is not null").select(F.col("dst_channel_id").alias("channel_id"), F.col("dst_msg_id").alias("msg_id"), "src_channel_id", F.col("published_at").alias("carried_at")).join(by, "src_channel_id")
    near = held.select("channel_id", "msg_id", "published").join(sent, ["channel_id", "msg_id"]).where(seconds("carried_at") <= seconds("published") + window_hours * 3600)
    return held.join(near.select("channel_id", "msg_id", "carrier_title", "carrier_username").distinct(), ["channel_id", "msg_id"], "left")


def with_clusters(scorecard: DataFrame, clusters: DataFrame) -> DataFrame:
    """The scorecard with the cluster of each username, null where none."""
    return scorecard.join(clusters.select("username", "cluster").where("username is not null").groupBy("username").agg(F.min("cluster").alias("cluster")), "username", "left")


def texts_of(pairs: list[tuple[int, int]], posts: DataFrame) -> DataFrame:
    """The texts of stated posts in the order in which they are named: place, channel_id, msg_id, text (null if not stored)."""
    wanted = posts.sparkSession.createDataFrame([(i, c, m) for i, (c, m) in enumerate(pairs)], "place int, channel_id bigint, msg_id bigint")
    return wanted.join(posts.select("channel_id", "msg_id", "text"), ["channel_id", "msg_id"], "left").select("place", "channel_id", "msg_id", "text")


def deferred_chats(channels: DataFrame) -> DataFrame:
    """One row: seeds that are chats and belong to no channel."""
    return channels.agg(F.count_if((F.col("status") == "seed") & F.col("is_chat") & F.col("linked_to").isNull()).alias("deferred"))


def totals(messages: DataFrame, posts: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row: stored messages, posts among them, readings."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(messages, "messages").crossJoin(count(posts, "posts")).crossJoin(count(snapshots, "snapshots"))


def live_posts(posts: DataFrame, now: Column, horizon_minutes: float) -> DataFrame:
    """Posts inside the horizon before a moment: channel_id, msg_id, age in minutes (negative for a date ahead)."""
    age = (seconds(now) - seconds("published")) / 60
    return posts.withColumn("age", age).where(F.col("age") <= horizon_minutes).select("channel_id", "msg_id", "age")


def metadata_age(snapshots: DataFrame, now: Column) -> DataFrame:
    """tg_id and the age in seconds of its newest snapshot."""
    return snapshots.groupBy("tg_id").agg(F.max("fetched_at").alias("fetched_at")).select("tg_id", (seconds(now) - seconds("fetched_at")).alias("age_s"))


def cluster_sheet(labels: DataFrame, channels: DataFrame, weights: DataFrame, measures: DataFrame, members: int = 6) -> DataFrame:
    """community, size, medians of the measures, most frequent kind with its count, and the heaviest members by name.

    labels: node, community; weights: node, weight; measures: node and any number of doubles.
    """
    names = channels.select(F.col("tg_id").alias("node"), F.coalesce("title", "username", F.col("tg_id").cast("string")).alias("name"), "kind")
    columns = [c for c in measures.columns if c != "node"]
    rows = labels.join(names, "node").join(weights, "node", "left").join(measures, "node", "left")
    sizes = rows.groupBy("community").agg(F.count("*").alias("size"), *[median(F.col(c)).alias(f"median_{c}") for c in columns])
    kinds = rows.where("kind is not null").groupBy("community", "kind").agg(F.count("*").alias("n")).groupBy("community").agg(F.max(F.struct("n", "kind")).alias("k"))
    top = rows.select("community", F.struct((-F.coalesce("weight", F.lit(0.0))).alias("w"), "node", "name").alias("m"))
    first = top.withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy("m"))).where(F.col("r") <= members)
    heads = first.groupBy("community").agg(F.concat_ws(" · ", F.transform(F.array_sort(F.collect_list("m")), lambda m: m["name"])).alias("members"))  # ``members`` rows a community
    out = sizes.join(kinds, "community", "left").join(heads, "community", "left")
    return out.select("community", "size", *[f"median_{c}" for c in columns], F.col("k.kind").alias("top_kind"), F.col("k.n").alias("top_kind_n"), "members")


def channel_sheet(labels: DataFrame, channels: DataFrame, families: DataFrame, decayed: DataFrame) -> DataFrame:
    """node, title, username, kind, family_key, community, partners, link_weight, inside_share of every channel.

    Shares and partners are null and zero for a channel without links; decayed: src, dst, kind, weight.
    """
    pairs = decayed.where("src <> dst")
    ends = pairs.select(F.col("src").alias("node"), F.col("dst").alias("other"), "weight").unionByName(pairs.select(F.col("dst").alias("node"), F.col("src").alias("other"), "weight"))
    home, away = labels.select("node", "community"), labels.select(F.col("node").alias("other"), F.col("community").alias("there"))
    rows = ends.join(home, "node", "left").join(away, "other", "left")
    inside = F.sum(F.when(F.col("community") == F.col("there"), F.col("weight")).otherwise(0.0)) / F.sum("weight")
    links = rows.groupBy("node").agg(F.countDistinct("other").alias("partners"), F.sum("weight").alias("link_weight"), inside.alias("inside"))
    base = family_or_self(channels.select(F.col("tg_id").alias("node"), "title", "username", "kind"), families, "node", "family_key").join(home, "node", "left").join(links, "node", "left")
    share = F.when(F.col("community").isNotNull(), F.col("inside"))
    return base.select("node", "title", "username", "kind", "family_key", "community", F.coalesce("partners", F.lit(0).cast("bigint")).alias("partners"), "link_weight", share.alias("inside_share"))
