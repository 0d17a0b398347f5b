"""Evidence that two channels have one author: five signals, merged into ranked candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import handles, text_references, username_tokens


@dataclass(frozen=True)
class Thresholds:
    """Least counts, shares and group sizes of the signals (fixed defaults)."""

    min_out_edges: int = 20
    max_share_min: float = 0.7
    min_token_length: int = 4
    max_token_channels: int = 3
    min_mutual_edges: int = 5
    max_handle_token_channels: int = 10

    def __post_init__(self) -> None:
        if not 0 < self.max_share_min <= 1 or min(self.min_out_edges, self.min_token_length, self.min_mutual_edges) < 1:
            raise ValueError("thresholds must be positive and the share at most 1")
        if min(self.max_token_channels, self.max_handle_token_channels) < 2:
            raise ValueError("a token cap under two channels can give no pair")


@dataclass(frozen=True)
class Weights:
    about: float = 1.0
    handle: float = 1.0
    share: float = 0.8
    token: float = 0.6
    mutual: float = 0.5


def pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("channel_a"), F.greatest(a, b).alias("channel_b")]


def description_targets(about: DataFrame, names: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, target) pairs that descriptions name, and the references that name no known channel.

    about: channel_id, about. names: name, dst. known: tg_id.
    """
    refs = about.select(F.col("channel_id").alias("source"), F.explode(text_references("about")).alias("r")).select("source", "r.username", F.col("r.channel_id").alias("by_id"))
    found = refs.join(names, F.col("username") == F.col("name"), "left").join(known.select(F.col("tg_id").alias("known_id")), F.col("by_id") == F.col("known_id"), "left")
    placed = found.withColumn("target", F.coalesce("known_id", "dst"))
    return placed.where("target is not null and target <> source").select("source", "target").distinct(), placed.where("target is null").select("source", "username", "by_id")


def about_signal(targets: DataFrame) -> DataFrame:
    """Half for a description that names the other channel, one if both name each other."""
    ways = targets.select(*pair("source", "target"), (F.col("source") < F.col("target")).alias("forth")).groupBy("channel_a", "channel_b").agg(F.max("forth").alias("ab"), F.max(~F.col("forth")).alias("ba"))
    direction = F.when(F.col("ab") & F.col("ba"), "mutual").when(F.col("ab"), "a_to_b").otherwise("b_to_a")
    return ways.select("channel_a", "channel_b", F.when(F.col("ab") & F.col("ba"), 1.0).otherwise(0.5).alias("strength"), direction.alias("about_direction"))


def carriers(channels: DataFrame, least: int) -> DataFrame:
    """tg_id, token of every username token of the channels."""
    return channels.where("username is not null").select("tg_id", F.explode(username_tokens("username", least)).alias("token")).distinct()


def token_pairs(tokens: DataFrame, cap: int) -> DataFrame:
    """Pairs of carriers of each token that at least two and at most ``cap`` channels carry, the strongest token of each pair.

    The cap is the rule itself: a token of more carriers says nothing about authors. It bounds the pairs a token can give.
    """
    sizes = tokens.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n").between(2, cap))
    held = tokens.join(sizes, "token")
    both = held.alias("x").join(held.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.tg_id") < F.col("y.tg_id")))
    rows = both.select(F.col("x.tg_id").alias("channel_a"), F.col("y.tg_id").alias("channel_b"), "x.token", "x.n")
    best = Window.partitionBy("channel_a", "channel_b").orderBy("n", F.desc(F.length("token")), "token")
    return rows.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def signed_tokens(channels: DataFrame, about: DataFrame, least: int) -> DataFrame:
    """Tokens that a carrier names as a handle in its own description."""
    named = about.select(F.col("channel_id").alias("tg_id"), F.explode(handles("about")).alias("token"))
    return carriers(channels, least).join(named, ["tg_id", "token"], "left_semi").select("token").distinct()


def token_signal(channels: DataFrame, t: Thresholds, excluding: DataFrame | None = None) -> DataFrame:
    """Username tokens shared by few channels: the rarer the stronger."""
    tokens = carriers(channels, t.min_token_length)
    if excluding is not None:
        tokens = tokens.join(excluding, "token", "left_anti")
    m = t.max_token_channels
    found = token_pairs(tokens, m)
    return found.select("channel_a", "channel_b", ((F.lit(m + 1) - F.col("n")) / F.lit(m)).alias("strength"), F.col("token").alias("shared_token"), F.col("n").cast("int").alias("shared_token_channels"))


def handle_signal(channels: DataFrame, signed: DataFrame, t: Thresholds) -> DataFrame:
    """Pairs of carriers of a signed handle, all of strength one; of several the longest, then the first in order."""
    tokens = carriers(channels, t.min_token_length).join(signed, "token", "left_semi")
    sizes = tokens.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n").between(2, t.max_handle_token_channels))
    held = tokens.join(sizes, "token")
    both = held.alias("x").join(held.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.tg_id") < F.col("y.tg_id")))
    rows = both.select(F.col("x.tg_id").alias("channel_a"), F.col("y.tg_id").alias("channel_b"), "x.token", "x.n")
    best = rows.groupBy("channel_a", "channel_b").agg(F.min(F.struct((-F.length("token")).alias("l"), "token", "n")).alias("t"))
    return best.select("channel_a", "channel_b", F.lit(1.0).alias("strength"), F.col("t.token").alias("handle_token"), F.col("t.n").cast("int").alias("handle_token_channels"))


def pair_counts(edges: DataFrame, kinds: tuple[str, ...] = ("forward", "mention")) -> DataFrame:
    """src, dst and the number of edges."""
    return edges.where(F.col("kind").isin(*kinds)).groupBy(F.col("src_channel_id").alias("src"), F.col("dst_channel_id").alias("dst")).agg(F.count("*").alias("n"))


def top_targets(counts: DataFrame) -> DataFrame:
    """For each source its most referenced target (the lowest id of equal ones), that count and all its references."""
    return counts.groupBy("src").agg(F.sum("n").alias("out_edges"), F.max(F.struct("n", (-F.col("dst")).alias("d"))).alias("t")).select("src", (-F.col("t.d")).alias("dst"), F.col("t.n").alias("n"), "out_edges")


def share_signal(counts: DataFrame, t: Thresholds) -> DataFrame:
    """Channels that send most of their references to one other."""
    rows = top_targets(counts).where("src <> dst").withColumn("share", F.col("n") / F.col("out_edges"))
    rows = rows.where((F.col("out_edges") >= t.min_out_edges) & (F.col("share") >= t.max_share_min)).withColumn("s", F.struct("share", "out_edges", (-F.col("src")).alias("neg"), "src"))
    best = rows.select(*pair("src", "dst"), "s").groupBy("channel_a", "channel_b").agg(F.max("s").alias("s"))
    return best.select("channel_a", "channel_b", F.col("s.share").alias("strength"), F.col("s.share").alias("out_share"), F.col("s.out_edges").alias("out_share_edges"), F.col("s.src").alias("out_share_src"))


def mutual_signal(counts: DataFrame, t: Thresholds) -> DataFrame:
    """Channels that reference each other, by the weaker direction."""
    ways = counts.where("src <> dst").select(*pair("src", "dst"), F.when(F.col("src") < F.col("dst"), F.col("n")).alias("ab"), F.when(F.col("src") > F.col("dst"), F.col("n")).alias("ba"))
    both = ways.groupBy("channel_a", "channel_b").agg(F.sum("ab").alias("edges_a_to_b"), F.sum("ba").alias("edges_b_to_a"))
    weaker = F.least("edges_a_to_b", "edges_b_to_a")
    strong = both.where((F.col("edges_a_to_b") >= t.min_mutual_edges) & (F.col("edges_b_to_a") >= t.min_mutual_edges))
    return strong.select("channel_a", "channel_b", F.least(F.lit(1.0), weaker / F.lit(2.0 * t.min_mutual_edges)).alias("strength"), "edges_a_to_b", "edges_b_to_a")


EVIDENCE = {
    "about": {"about_direction": "string"}, "handle": {"handle_token": "string", "handle_token_channels": "int"}, "share": {"out_share": "double", "out_share_edges": "bigint", "out_share_src": "bigint"},
    "token": {"shared_token": "string", "shared_token_channels": "int"}, "mutual": {"edges_a_to_b": "bigint", "edges_b_to_a": "bigint"},
}


def merge(signals: dict[str, DataFrame], weights: Weights = Weights()) -> DataFrame:
    """One row a pair with the weighted sum of its strengths and all evidence."""
    columns = {c: kind for e in EVIDENCE.values() for c, kind in e.items()}
    rows = None
    for name, df in signals.items():
        part = df.select("channel_a", "channel_b", (F.col("strength") * getattr(weights, name)).alias("part"), *[(F.col(c) if c in EVIDENCE[name] else F.lit(None)).cast(k).alias(c) for c, k in columns.items()])
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("channel_a", "channel_b").agg(F.sum("part").alias("score"), *[F.max(c).alias(c) for c in columns])


def worth_proposing(candidates: DataFrame, channels: DataFrame, families: DataFrame) -> DataFrame:
    """Without a channel and its own discussion chat, and without pairs of one family already."""
    links = channels.where("linked_to is not null").select(F.least("tg_id", "linked_to").alias("channel_a"), F.greatest("tg_id", "linked_to").alias("channel_b"))
    fa, fb = families.select(F.col("channel_id").alias("channel_a"), F.col("family_key").alias("_fa")), families.select(F.col("channel_id").alias("channel_b"), F.col("family_key").alias("_fb"))
    rows = candidates.where("channel_a <> channel_b").join(links, ["channel_a", "channel_b"], "left_anti").join(fa, "channel_a", "left").join(fb, "channel_b", "left")
    return rows.where("_fa is null or _fb is null or _fa <> _fb").drop("_fa", "_fb")


def detect(channels: DataFrame, about: DataFrame, edges: DataFrame, families: DataFrame, t: Thresholds = Thresholds(), w: Weights = Weights()) -> DataFrame:
    """All candidates with score and evidence; order by score desc, channel_a, channel_b to read them."""
    from tidewire.operators.derive import usernames

    targets, _ = description_targets(about, usernames(channels), channels)
    signed = signed_tokens(channels, about, t.min_token_length)
    counts = pair_counts(edges)
    handle = handle_signal(channels, signed, t)
    read = handle.select(F.col("handle_token").alias("token")).distinct()
    signals = {"about": about_signal(targets), "handle": handle, "share": share_signal(counts, t), "token": token_signal(channels, t, excluding=read), "mutual": mutual_signal(counts, t)}
    return worth_proposing(merge(signals, w), channels, families)


def handle_groups(candidates: DataFrame) -> DataFrame:
    """For each signed handle the number of its pairs and of its channels."""
    both = candidates.where("handle_token is not null").select("handle_token", F.explode(F.array("channel_a", "channel_b")).alias("c"), F.struct("channel_a", "channel_b").alias("p"))
    return both.groupBy("handle_token").agg(F.countDistinct("p").alias("pairs"), F.countDistinct("c").alias("members"))


def keep_decisions(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Upsert of candidates: evidence and score from the new run (also where it is null), decisions from the store."""
    old, keys = stored.select("channel_a", "channel_b", F.col("decision").alias("_d")), ["channel_a", "channel_b"]
    return found.join(old, keys, "full").select(*found.columns, F.coalesce("_d", F.lit("pending")).alias("decision"))
