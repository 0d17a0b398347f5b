"""Offline sheets: scorecard, style, anomalous posts, cited posts and the sections of a channel report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.robust import entropy, group_spread, mean_of, median, robust_z
from tidewire.functions.text import CYRILLIC, EMOJI, EMPHATIC, LATIN, SENTENCE_END, count_of, one_line, post_link
from tidewire.operators.cascades import family_or_self
from tidewire.session import materialise


def outward_edges(edges: DataFrame, families: DataFrame) -> DataFrame:
    """src, dst and families of the edges between different families."""
    rows = family_or_self(family_or_self(edges, families, "src_channel_id", "src_family"), families, "dst_channel_id", "dst_family")
    return rows.where("src_family <> dst_family").select(F.col("src_channel_id").alias("src"), F.col("dst_channel_id").alias("dst"), "src_family", "dst_family", "kind")


def variety(edges: DataFrame, collected: DataFrame) -> DataFrame:
    """channel_id, out_variety (bits), out_targets, in_sources, reciprocity over edges between families.

    Reciprocity is the share of targets with collected history (collected: channel_id) that reference back; null without any.
    """
    counts = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    total = counts.groupBy("src").agg(F.sum("n").alias("total"), F.count("*").alias("out_targets"))
    bits = counts.join(total, "src").groupBy("src").agg(entropy(F.col("n") / F.col("total")).alias("out_variety"), F.first("out_targets").alias("out_targets"))
    sources = counts.groupBy(F.col("dst").alias("channel_id")).agg(F.count("*").alias("in_sources"))
    back = counts.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("back"))
    seen = counts.join(collected.select(F.col("channel_id").alias("dst")).distinct(), "dst", "left_semi").join(back, ["src", "dst"], "left")
    answers = seen.groupBy("src").agg((F.count("back") / F.count("*")).alias("reciprocity"))
    out = bits.join(answers, "src", "left").withColumnRenamed("src", "channel_id")
    return out.join(sources, "channel_id", "full").select("channel_id", "out_variety", F.coalesce("out_targets", F.lit(0)).alias("out_targets"), F.coalesce("in_sources", F.lit(0)).alias("in_sources"), "reciprocity")


def post_medians(posts: DataFrame, min_posts: int = 10) -> DataFrame:
    """Medians of counters and of per-post rates of each channel; rates are blank under ``min_posts`` posts.

    posts: absent reaction lists read as zero.
    """
    ratio = lambda c: median(F.when((F.col("views") > 0) & F.col(c).isNotNull(), F.col(c) / F.col("views")))
    rows = posts.groupBy("channel_id").agg(
        F.count("*").alias("posts"), median(F.col("views")).alias("median_views"), median(F.col("reactions")).alias("median_reactions"), median(F.col("forwards")).alias("median_forwards"),
        ratio("reactions").alias("reaction_rate"), ratio("forwards").alias("forward_rate"), ratio("comments").alias("comment_rate"),
    )
    for c in ("reaction_rate", "forward_rate", "comment_rate"):
        rows = rows.withColumn(c, F.when(F.col("posts") >= min_posts, F.col(c)))
    return rows


def scorecard(channels: DataFrame, posts: DataFrame, edges: DataFrame, families: DataFrame, subscribers: DataFrame, min_posts: int = 10) -> DataFrame:
    """One row a seed channel. subscribers: channel_id, subscribers."""
    seeds = channels.where("status = 'seed'").select(F.col("tg_id").alias("channel_id"), "title", "username", "kind")
    rows = family_or_self(seeds, families, "channel_id", "family_key").join(subscribers, "channel_id", "left").join(post_medians(posts, min_posts), "channel_id", "left")
    out = rows.join(variety(outward_edges(edges, families), posts.select("channel_id").distinct()), "channel_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("channel_id", "title", "username", "kind", "family_key", "subscribers", zero("posts"), "median_views", "median_reactions", "median_forwards", "reaction_rate", "forward_rate", "comment_rate", "out_variety", zero("out_targets"), zero("in_sources"), "reciprocity")


def text_measures(posts: DataFrame) -> DataFrame:
    """Style of each channel's own texts (posts: text, entities, is_forward): lengths, shares and densities per 1000 characters."""
    own = posts.where("not is_forward and text <> ''")
    n_of = lambda *kinds: F.size(F.filter(F.coalesce("entities", F.array()), lambda e: e["_"].isin(*kinds)))
    quoted = F.aggregate(F.filter(F.coalesce("entities", F.array()), lambda e: e["_"] == "MessageEntityBlockquote"), F.lit(0), lambda a, e: a + F.coalesce(e["length"], F.lit(0)))
    rows = own.select(
        "channel_id", F.length("text").alias("chars"), F.greatest(count_of("text", SENTENCE_END), F.lit(1)).alias("sentences"), count_of("text", LATIN).alias("latin"), count_of("text", CYRILLIC).alias("cyrillic"),
        count_of("text", EMPHATIC).alias("emphatic"), (count_of("text", EMOJI) + n_of("MessageEntityCustomEmoji")).alias("emoji"), n_of("MessageEntityCode", "MessageEntityPre").alias("code"),
        n_of("MessageEntityUrl", "MessageEntityTextUrl").alias("links"), quoted.alias("quoted"),
    )
    chars = F.nullif(F.sum("chars"), F.lit(0))
    return rows.groupBy("channel_id").agg(
        F.count("*").alias("text_posts"), median(F.col("chars")).alias("median_len"), F.percentile("chars", F.lit(0.9)).alias("p90_len"), median(F.col("chars") / F.col("sentences")).alias("sentence_len"),
        F.least(F.sum("quoted") / chars, F.lit(1.0)).alias("quote_share"), F.avg((F.col("code") > 0).cast("int")).alias("code_share"), (F.sum("latin") / F.nullif(F.sum(F.col("latin") + F.col("cyrillic")), F.lit(0))).alias("latin_share"),
        (1000 * F.sum("links") / chars).alias("link_density"), (1000 * F.sum("emoji") / chars).alias("emoji_density"), (1000 * F.sum("emphatic") / chars).alias("emphatic_density"),
    )


#: (column, transform, sign) of the parts of the two style scores (fixed values).
DEPTH = (("median_len", "log", 1), ("sentence_len", "log", 1), ("quote_share", "sqrt", 1), ("code_share", "sqrt", 1), ("link_density", "sqrt", 1))
DRYNESS = (("emoji_density", "sqrt", -1), ("emphatic_density", "sqrt", -1))


def style_scores(measures: DataFrame, min_posts: int = 50) -> DataFrame:
    """Adds depth and dryness: means of signed robust scores of the channels with enough texts."""
    rows = robust_z(materialise(measures.where(F.col("text_posts") >= min_posts)), {c: t for c, t, _ in (*DEPTH, *DRYNESS)})  # one row a channel
    part = lambda parts: mean_of([F.col(f"{c}_z") * sign for c, _, sign in parts])
    return rows.withColumn("depth", part(DEPTH)).withColumn("dryness", part(DRYNESS)).drop(*[f"{c}_z" for c, _, _ in (*DEPTH, *DRYNESS)])


@dataclass(frozen=True)
class AnomalyParams:
    """Fixed defaults of the offline ranking."""

    min_posts: int = 30
    min_count: int = 10
    pseudo_views: float = 1000.0
    min_z: float = 3.0
    per_channel: int = 5


RATES = (("reactions", "reaction"), ("forwards", "forward"), ("comments", "comment"))


def collapse_albums(posts: DataFrame) -> DataFrame:
    """One row a post: an album is its lowest id, greatest counters and longest text (of equal ones the later part's)."""
    key = F.coalesce(F.col("grouped_id"), -F.col("msg_id"))
    text = F.max(F.struct(F.length(F.coalesce("text", F.lit(""))).alias("l"), "msg_id", "text"))
    out = posts.groupBy("channel_id", key.alias("album")).agg(F.min("msg_id").alias("msg_id"), F.min("published").alias("published"), *[F.max(c).alias(c) for c in ("views", "forwards", "reactions", "comments")], text.alias("t"), F.count("*").alias("parts"))
    return out.withColumn("text", F.col("t.text")).drop("t")


def without_own_family(posts: DataFrame, families: DataFrame) -> DataFrame:
    """Posts that are not reposts of the channel's own family."""
    own = family_or_self(posts, families, "channel_id", "_own")
    source = families.select(F.col("channel_id").alias("reposted_from"), F.col("family_key").alias("_k"))
    rows = own.join(source, "reposted_from", "left").withColumn("_from", F.coalesce("_k", "reposted_from"))
    return rows.where("not (_from <=> _own)").drop("_own", "_k", "_from")


def anomaly_scores(posts: DataFrame, p: AnomalyParams = AnomalyParams()) -> DataFrame:
    """Lift and z of views and of shrunk rates, each against the channel's own level and spread."""
    seen = posts.where("views > 0")
    sizes = seen.groupBy("channel_id").agg(F.count("*").alias("channel_posts"), *[F.count(c).alias(f"_{c}_n") for c in ("reactions", "comments")])
    rows = seen.join(sizes.where(F.col("channel_posts") >= p.min_posts), "channel_id")
    for c in ("reactions", "comments"):
        rows = rows.withColumn(c, F.when(F.col(f"_{c}_n") > 0, F.coalesce(c, F.lit(0)))).drop(f"_{c}_n")
    levels = [x for c, name in RATES for x in (median(F.col(c)).alias(f"_{name}_typical"), (F.sum(c) / F.sum(F.when(F.col(c).isNotNull(), F.col("views")))).alias(f"_{name}_base"))]
    rows = rows.join(rows.groupBy("channel_id").agg(*levels), "channel_id").withColumn("log_views", F.ln("views"))
    for c, name in RATES:
        base = F.when(F.col(f"_{name}_typical") > 0, F.col(f"_{name}_base"))
        rows = rows.withColumn(f"_{name}_base", base).withColumn(f"log_{name}", F.ln((F.col(c) + p.pseudo_views * F.col(f"_{name}_base")) / (F.col("views") + p.pseudo_views)))
    logs = ["log_views", *[f"log_{name}" for _, name in RATES]]
    rows = group_spread(materialise(rows), ["channel_id"], logs)
    rows = rows.withColumn("views_lift", F.col("views") / F.exp("log_views_median")).withColumn("views_z", (F.col("log_views") - F.col("log_views_median")) / F.col("log_views_spread"))
    for c, name in RATES:
        z = (F.col(f"log_{name}") - F.col(f"log_{name}_median")) / F.col(f"log_{name}_spread")
        rows = rows.withColumn(f"{name}_lift", F.exp(f"log_{name}") / F.col(f"_{name}_base")).withColumn(f"{name}_z", F.when(F.col(c) >= p.min_count, z))
    return rows.drop(*[f"{x}{y}" for x in logs for y in ("", "_median", "_spread")], *[f"_{name}_{x}" for _, name in RATES for x in ("typical", "base")])


def pick(scored: DataFrame, z: str, p: AnomalyParams = AnomalyParams()) -> DataFrame:
    """All posts at or over the threshold, the first few of each channel; ties by message id."""
    rank = F.row_number().over(Window.partitionBy("channel_id").orderBy(F.desc(z), "msg_id"))
    return scored.where(F.col(z) >= p.min_z).withColumn("rank", rank).where(F.col("rank") <= p.per_channel)


def cited_sheet(cited: DataFrame, channels: DataFrame, posts: DataFrame) -> DataFrame:
    """Cited posts with channel, link, greatest counters and longest text of all parts."""
    whole = collapse_albums(posts).select("channel_id", "msg_id", "parts", "views", "reactions", "comments", "forwards", one_line("text").alias("text"))
    names = channels.select(F.col("tg_id").alias("channel_id"), "title", "username", "status", "kind")
    return cited.join(names, "channel_id").join(whole, ["channel_id", "msg_id"], "left").withColumn("link", post_link("username", "msg_id"))


def incoming(edges: DataFrame) -> DataFrame:
    """Who references each channel: counts by kind and the last date."""
    count = lambda kind: F.count_if(F.col("kind") == kind)
    return edges.groupBy("dst_channel_id", "src_channel_id").agg(count("forward").alias("forwards"), count("mention").alias("mentions"), F.max("published_at").alias("last_at"))


def outgoing(edges: DataFrame) -> DataFrame:
    """References of each channel by kind and the number of different targets."""
    return edges.groupBy("src_channel_id", "kind").agg(F.count("*").alias("refs"), F.countDistinct("dst_channel_id").alias("targets"))


def spans(posts: DataFrame) -> DataFrame:
    """Collected span of each channel."""
    return posts.groupBy("channel_id").agg(F.count("*").alias("messages"), F.min("published").alias("first_at"), F.max("published").alias("last_at"))


def share_below(df: DataFrame, column: str) -> DataFrame:
    """Adds <column>_below: the share of non-null values strictly below a row's value.

    Distinct values are counted and summed in order within ranges, so no task sorts the table.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    ordered = counts.repartitionByRange(column).withColumn("_part", F.spark_partition_id())
    kept = materialise(ordered)
    before = kept.groupBy("_part").agg(F.sum("n").alias("_size"))  # one row a partition
    parts = before.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"), F.sum("_size").over(Window.partitionBy(F.lit(1))).alias("_total"))
    inside = Window.partitionBy("_part").orderBy(column)
    below = kept.withColumn("_upto", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(F.broadcast(parts), "_part")
    shares = below.select(column, ((F.col("_before") + F.col("_upto") - F.col("n")) / F.col("_total")).alias(f"{column}_below"))
    return df.join(shares, column, "left")


def status_counts(channels: DataFrame, statuses: tuple[str, ...] = ("candidate", "seed", "maybe", "rejected")) -> DataFrame:
    """Channels of each status, with zeros."""
    every = channels.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    return every.join(channels.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("channels"))


def freshness(edges: DataFrame, posts: DataFrame) -> DataFrame:
    """One row: the newest derivation, reference and fetch."""
    return edges.agg(F.max("derived_at").alias("derived_at"), F.max("published_at").alias("referenced_at")).crossJoin(posts.agg(F.max("fetched_at").alias("fetched_at")))
