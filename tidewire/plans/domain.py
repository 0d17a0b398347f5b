"""Queries of the message, graph, affiliation, cascade, baseline and ranking operators, each with its oracle in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import payload, text, timing
from tidewire.functions.ids import bare_id
from tidewire.operators import baselines, cascades, communities, derive, families, queues, rankings, signals
from tidewire.sources import store
from tidewire.sources.tables import table

#: The moment of every query that needs one, and parameters fitted to readings days apart.
NOW = "2026-08-01 00:00:00"
CASCADE = cascades.CascadeParams(bands=(1, 2, 3), window_hours=240)
BASELINE = baselines.BaselineParams(mature_days=3, mature_max_days=30, min_channel_posts=8, min_band_samples=3, edges=(0, 2880, 5760, 11520, 57600), reference_age=7200, threshold=1.5)
SIGNAL = signals.Thresholds(min_out_edges=5, max_share_min=0.3, max_token_channels=3, min_mutual_edges=1)
ANOMALY = rankings.AnomalyParams(min_posts=10, min_z=2.0, per_channel=3)


def at(c: str = NOW):
    return F.to_timestamp(F.lit(c))


def epoch(c: str):
    return F.unix_seconds(F.col(c).cast("timestamp")).alias(c)


def channels(spark: SparkSession, folder: str) -> DataFrame:
    return derive.inventory(table(spark, folder, "channels"))


def raw(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "raw_messages")


def edges(spark: SparkSession, folder: str) -> DataFrame:
    return derive.distinct_edges(table(spark, folder, "edges"))


def family(spark: SparkSession, folder: str) -> DataFrame:
    return families.families(table(spark, folder, "affiliation_candidates"))


def about(spark: SparkSession, folder: str) -> DataFrame:
    """The newest good description of each channel."""
    p = F.from_json("payload", "full_chat struct<id: bigint, about: string, participants_count: bigint, linked_chat_id: bigint>")
    rows = table(spark, folder, "raw_channels").select("channel_id", "fetched_at", p.alias("p")).where("p.full_chat.id = channel_id")
    newest = rows.groupBy("channel_id").agg(F.max(F.struct("fetched_at", F.col("p.full_chat.about").alias("about"), F.col("p.full_chat.participants_count").alias("subscribers"))).alias("s"))
    return newest.select("channel_id", "s.about", "s.subscribers")


# ---------------------------------------------------------------- derivation and stores


def derived_edges(spark: SparkSession, folder: str) -> DataFrame:
    out = derive.derive(raw(spark, folder), table(spark, folder, "channels")).edges
    return out.select(*derive.KEY, epoch("published_at"), epoch("dst_published_at"), "grouped_id")


def discovered_channels(spark: SparkSession, folder: str) -> DataFrame:
    return derive.derive(raw(spark, folder), table(spark, folder, "channels")).discovered


def pending_mentions(spark: SparkSession, folder: str) -> DataFrame:
    return derive.pending_queue(derive.derive(raw(spark, folder), table(spark, folder, "channels")).pending, channels(spark, folder))


def missing_edges(spark: SparkSession, folder: str) -> DataFrame:
    found = derive.derive(raw(spark, folder), table(spark, folder, "channels")).edges
    return derive.missing_edges(found, table(spark, folder, "edges")).select(*derive.KEY)


def edge_keys(spark: SparkSession, folder: str) -> DataFrame:
    return edges(spark, folder).select(*derive.KEY, epoch("published_at"), epoch("derived_at"))


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    return channels(spark, folder).select("tg_id", "username", "title", "status", "kind", "is_chat")


def first_wins(spark: SparkSession, folder: str) -> DataFrame:
    rows = raw(spark, folder).select("channel_id", "msg_id", epoch("fetched_at"), F.length("payload").cast("bigint").alias("size"))
    held = table(spark, folder, "cited_posts").select("channel_id", "msg_id")
    return store.absent(rows, held, ["channel_id", "msg_id"], ["fetched_at", "size"])


def latest_wins(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "raw_channels").select("channel_id", epoch("fetched_at"), F.coalesce("payload", F.lit("")).alias("payload"))
    return store.latest(rows.where("payload = ''"), rows.where("payload <> ''"), ["channel_id"], ["fetched_at"])


def post_counters(spark: SparkSession, folder: str) -> DataFrame:
    rows = payload.observations(raw(spark, folder))
    return rows.select("channel_id", "msg_id", epoch("observed_at"), epoch("published_at"), "views", "forwards", "reactions", "comments")


def reaction_kinds(spark: SparkSession, folder: str) -> DataFrame:
    rows = payload.parsed(raw(spark, folder)).where("p._ = 'Message'").select(F.explode(payload.reaction_map(F.col("p.reactions"))).alias("reaction", "n"))
    return rows.groupBy("reaction").agg(F.count("*").alias("posts"), F.sum("n").alias("total"))


def mention_names(spark: SparkSession, folder: str) -> DataFrame:
    rows = payload.parsed(payload.first_fetches(raw(spark, folder)))
    found = rows.select("channel_id", "msg_id", F.explode(text.entity_references("p.message", "p.entities")).alias("r")).where("r.username is not null")
    return found.groupBy("channel_id", "msg_id", F.col("r.username").alias("username")).agg(F.count("*").alias("n"))


def about_names(spark: SparkSession, folder: str) -> DataFrame:
    rows = about(spark, folder).select("channel_id", F.explode(text.text_references("about")).alias("r"))
    return rows.select("channel_id", "r.username").where("username is not null").distinct()


def album_parts(spark: SparkSession, folder: str) -> DataFrame:
    whole = rankings.collapse_albums(payload.posts(raw(spark, folder)))
    return whole.where("parts > 1").select("channel_id", "msg_id", "parts", "views", "forwards", "reactions", "comments", F.length("text").cast("bigint").alias("chars"))


def event_props(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("with_k"), F.sum(k).alias("k"))


# ---------------------------------------------------------------- affiliation


def pair_counts(spark: SparkSession, folder: str) -> DataFrame:
    return signals.pair_counts(edges(spark, folder))


def top_targets(spark: SparkSession, folder: str) -> DataFrame:
    return signals.top_targets(pair_counts(spark, folder))


def share_pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = signals.share_signal(pair_counts(spark, folder), SIGNAL)
    return rows.select("channel_a", "channel_b", F.round("out_share", 9).alias("out_share"), "out_share_edges", "out_share_src")


def mutual_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return signals.mutual_signal(pair_counts(spark, folder), SIGNAL).withColumn("strength", F.round("strength", 9))


def shared_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return signals.token_signal(channels(spark, folder), SIGNAL).withColumn("strength", F.round("strength", 9))


def signing(spark: SparkSession, folder: str) -> DataFrame:
    """Descriptions in which channels of even id sign with the first part of their username, as the stored ones name no handle."""
    names = channels(spark, folder).where("username is not null").select(F.col("tg_id").alias("channel_id"), "username")
    signed = F.when(F.pmod("channel_id", F.lit(2)) == 0, F.concat(F.coalesce("about", F.lit("")), F.lit(" @"), F.coalesce(F.get(text.username_tokens("username"), F.lit(0)), F.lit("?")))).otherwise(F.col("about"))
    return names.join(about(spark, folder).select("channel_id", "about"), "channel_id", "left").select("channel_id", signed.alias("about"))


def signed_handles(spark: SparkSession, folder: str) -> DataFrame:
    known = channels(spark, folder)
    return signals.handle_signal(known, signals.signed_tokens(known, signing(spark, folder), SIGNAL.min_token_length), signals.Thresholds(max_handle_token_channels=40))


def naming(spark: SparkSession, folder: str) -> DataFrame:
    """Descriptions that name the channel each one references most, by handle, link or bare id in turn."""
    names = channels(spark, folder).select(F.col("tg_id").alias("dst"), "username")
    top = top_targets(spark, folder).join(names, "dst").select("src", "dst", "username")
    way = F.pmod("src", F.lit(3))
    written = F.when(way == 0, F.concat(F.lit("by @"), F.col("username"))).when(way == 1, F.concat(F.lit("see https://t.me/"), F.col("username"), F.lit("/5."))).otherwise(F.concat(F.lit("(t.me/c/"), F.col("dst").cast("string"), F.lit("/7)")))
    return top.where("username is not null").select(F.col("src").alias("channel_id"), written.alias("about"))


def about_pairs(spark: SparkSession, folder: str) -> DataFrame:
    known = channels(spark, folder)
    targets, _ = signals.description_targets(naming(spark, folder), derive.usernames(known), known)
    return signals.about_signal(targets)


def detected_pairs(spark: SparkSession, folder: str) -> DataFrame:
    known = channels(spark, folder)
    found = signals.detect(known, about(spark, folder), edges(spark, folder), family(spark, folder), SIGNAL)
    return found.withColumn("score", F.round("score", 9)).withColumn("out_share", F.round("out_share", 9))


def current_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return families.current_pairs(table(spark, folder, "affiliation_candidates"))


def decision_counts(spark: SparkSession, folder: str) -> DataFrame:
    return current_decisions(spark, folder).groupBy("decision").agg(F.count("*").alias("pairs"))


# ---------------------------------------------------------------- cascades


def reposts(spark: SparkSession, folder: str) -> DataFrame:
    return cascades.reposts(edges(spark, folder), family(spark, folder), payload.posts(raw(spark, folder)))


def cascade_crossings(spark: SparkSession, folder: str) -> DataFrame:
    return cascades.crossings(reposts(spark, folder), CASCADE)


def cited_ranking(spark: SparkSession, folder: str) -> DataFrame:
    found = cascades.cited(reposts(spark, folder), 1)
    return found.select("channel_id", "msg_id", "families", "sources", epoch("published"))


def incoming_references(spark: SparkSession, folder: str) -> DataFrame:
    return rankings.incoming(edges(spark, folder)).select("dst_channel_id", "src_channel_id", "forwards", "mentions", epoch("last_at"))


def outgoing_references(spark: SparkSession, folder: str) -> DataFrame:
    return rankings.outgoing(edges(spark, folder))


# ---------------------------------------------------------------- baselines


#: Fits rest on posts published since this moment.
SINCE = "2025-06-01 00:00:00"


def scoped(spark: SparkSession, folder: str) -> DataFrame:
    """Channels with kind and scope; the channels of every seventh id count as failed for good, as no table holds failures."""
    failures = channels(spark, folder).where("tg_id % 7 = 0").select("tg_id", queues.classify_failure(F.lit("ChannelPrivateError")).alias("failure_kind"))
    return baselines.scope(channels(spark, folder), failures)


def readings(spark: SparkSession, folder: str) -> DataFrame:
    return baselines.readings(payload.observations(raw(spark, folder)), scoped(spark, folder), BASELINE)


def mature_medians(spark: SparkSession, folder: str) -> DataFrame:
    return baselines.mature_medians(readings(spark, folder), BASELINE).withColumn("median", F.round("median", 6))


def age_bands(spark: SparkSession, folder: str) -> DataFrame:
    return readings(spark, folder).groupBy("metric", "band").agg(F.count("*").alias("n"))


def default_bands(spark: SparkSession, folder: str) -> DataFrame:
    """The default bands over ages from the message numbers, which reach over all of them."""
    rows = raw(spark, folder).select(timing.band_of(F.pmod("msg_id", F.lit(7000)) / 10.0).alias("band"))
    return rows.groupBy("band").agg(F.count("*").alias("n"))


def growth_curves(spark: SparkSession, folder: str) -> DataFrame:
    rows = baselines.fitted_on(readings(spark, folder), at(SINCE))
    return baselines.curves(rows, baselines.references(rows, BASELINE), BASELINE).withColumn("fraction", F.round("fraction", 6))


def growth_factors(spark: SparkSession, folder: str) -> DataFrame:
    long = readings(spark, folder)
    rows = baselines.fitted_on(long, at(SINCE))
    out = baselines.factors(rows, baselines.references(rows, BASELINE), baselines.mature_medians(long, BASELINE), BASELINE)
    return out.withColumn("factor", F.round("factor", 6))


def baseline_fit(spark: SparkSession, folder: str) -> DataFrame:
    out = baselines.fit(readings(spark, folder), BASELINE, at(SINCE))
    return out.select("kind", "metric", "band", *[F.round(c, 6).alias(c) for c in ("fraction", "factor", "spread")], "borrowed")


def scored(spark: SparkSession, folder: str, now: str = NOW, long: DataFrame | None = None) -> DataFrame:
    """Scores from a baseline that was stored and loaded again."""
    rows = readings(spark, folder) if long is None else long
    kept = baselines.stored(baselines.mature_medians(rows, BASELINE), baselines.fit(rows, BASELINE, at(SINCE)), 1, at(SINCE))
    medians, baseline = baselines.load(kept)
    return baselines.scores(rows, baseline, medians, BASELINE, at(SINCE), at(now))


def spike_scores(spark: SparkSession, folder: str, now: str = NOW) -> DataFrame:
    return baselines.spikes(scored(spark, folder, now), BASELINE).select("channel_id", "msg_id", "metric", F.round("z", 5).alias("z"), F.round("times", 5).alias("times"))


def spike_replay(spark: SparkSession, folder: str) -> DataFrame:
    return spike_scores(spark, folder, "2026-01-01 00:00:00")


def ranked_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every metric's score of each reading, best first; only those that are no near tie are given a place in the oracle's sense."""
    return baselines.ranked(scored(spark, folder)).select("channel_id", "msg_id", epoch("observed_at"), "metric", F.round("z", 5).alias("z"), "place")


def scoring_summary(spark: SparkSession, folder: str) -> DataFrame:
    long = readings(spark, folder)
    rows = scored(spark, folder, NOW, long)
    return baselines.summary(long, rows, baselines.spikes(rows, BASELINE), baselines.mature_medians(long, BASELINE), scoped(spark, folder), BASELINE, at(SINCE), at())


def spike_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts that the spikes of a later moment add to those raised at an earlier one."""
    raised = queues.spike_alerts(baselines.spikes(scored(spark, folder, "2026-01-01 00:00:00"), BASELINE))
    return queues.raise_alerts(queues.spike_alerts(baselines.spikes(scored(spark, folder), BASELINE)), raised).withColumn("value", F.round("value", 5))


# ---------------------------------------------------------------- sheets


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def reference_variety(spark: SparkSession, folder: str) -> DataFrame:
    out = rankings.outward_edges(edges(spark, folder), family(spark, folder))
    return rounded(rankings.variety(out, raw(spark, folder).select("channel_id").distinct()))


def post_medians(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rankings.post_medians(payload.posts(raw(spark, folder), mode="absent_is_zero")))


def scorecard(spark: SparkSession, folder: str) -> DataFrame:
    posts = payload.posts(raw(spark, folder), mode="absent_is_zero")
    return rounded(rankings.scorecard(channels(spark, folder), posts, edges(spark, folder), family(spark, folder), about(spark, folder).select("channel_id", "subscribers")))


def text_measures(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rankings.text_measures(payload.posts(raw(spark, folder))))


def style_scores(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rankings.style_scores(rankings.text_measures(payload.posts(raw(spark, folder))), 5).select("channel_id", "text_posts", "depth", "dryness"))


def anomaly_scores(spark: SparkSession, folder: str) -> DataFrame:
    posts = rankings.collapse_albums(rankings.without_own_family(payload.posts(raw(spark, folder)), family(spark, folder)))
    return rankings.anomaly_scores(posts, ANOMALY)


def anomaly_z(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(anomaly_scores(spark, folder).select("channel_id", "msg_id", "views_lift", "views_z", "reaction_z", "forward_z", "comment_z"), 5)


def anomaly_picks(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rankings.pick(anomaly_scores(spark, folder), "forward_z", ANOMALY).select("channel_id", "msg_id", "rank", "forward_z"), 5)


def views_below(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rankings.share_below(table(spark, folder, "channel_scorecard").select("tg_id", "subscribers"), "subscribers"))


def status_counts(spark: SparkSession, folder: str) -> DataFrame:
    return rankings.status_counts(channels(spark, folder))


def freshness(spark: SparkSession, folder: str) -> DataFrame:
    return rankings.freshness(table(spark, folder, "edges"), raw(spark, folder)).select(epoch("derived_at"), epoch("referenced_at"), epoch("fetched_at"))


# ---------------------------------------------------------------- communities


def decayed(spark: SparkSession, folder: str) -> DataFrame:
    return communities.decayed_pairs(edges(spark, folder), at())


def decayed_edges(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(decayed(spark, folder))


def balanced_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(communities.balanced_pairs(decayed(spark, folder)), 5)


def community_partition(spark: SparkSession, folder: str) -> DataFrame:
    return communities.partition(communities.stored_pairs(table(spark, folder, "edges"), at()))


def label_propagation(spark: SparkSession, folder: str) -> DataFrame:
    return communities.propagate(communities.balanced_pairs(decayed(spark, folder)))


#: Kinds and states of channels, whose places serve as labels of two partitions.
KINDS = ("personal", "company", "vacancies", "aggregator", "community", "media", "event")
STATUSES = ("candidate", "seed", "maybe", "rejected")


def kind_labels(spark: SparkSession, folder: str) -> DataFrame:
    return channels(spark, folder).where("kind is not null").select(F.col("tg_id").alias("node"), F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).alias("community"))


def status_labels(spark: SparkSession, folder: str) -> DataFrame:
    return channels(spark, folder).select(F.col("tg_id").alias("node"), F.array_position(F.array(*[F.lit(k) for k in STATUSES]), F.col("status")).alias("community"))


def partition_nmi(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(communities.nmi(kind_labels(spark, folder), status_labels(spark, folder)))


def inside_share(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(communities.inside_share(decayed(spark, folder), kind_labels(spark, folder)), 5)


def outward_lean(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(communities.outward_lean(decayed(spark, folder), kind_labels(spark, folder)), 4)


def bridge_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(communities.bridges(decayed(spark, folder), kind_labels(spark, folder)), 5)


def term_odds(spark: SparkSession, folder: str) -> DataFrame:
    return communities.term_odds(table(spark, folder, "documents"), "doc_type", "text")


# ---------------------------------------------------------------- queues


def poll_state(spark: SparkSession, folder: str) -> DataFrame:
    """Last fetch of each channel as its due moment."""
    return raw(spark, folder).groupBy(F.col("channel_id").alias("tg_id")).agg(F.max("fetched_at").cast("timestamp").alias("due_at"))


def due_queue(spark: SparkSession, folder: str) -> DataFrame:
    rows = queues.due(queues.in_scope(channels(spark, folder)).select("tg_id"), poll_state(spark, folder), at(), 25)
    return rows.select("tg_id", epoch("due_at"))


def queue_lag(spark: SparkSession, folder: str) -> DataFrame:
    return queues.lag(queues.in_scope(channels(spark, folder)).select("tg_id"), poll_state(spark, folder), at()).select("overdue", epoch("oldest_due"), "tracked")


def post_rates(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(queues.posts_per_day(payload.posts(raw(spark, folder)), at()))


def poll_schedule(spark: SparkSession, folder: str) -> DataFrame:
    rate = F.col("posts_per_day")
    rows = queues.posts_per_day(payload.posts(raw(spark, folder)), at())
    return rounded(rows.select("channel_id", timing.idle_interval(rate).alias("idle"), timing.window_size(rate).alias("window"), timing.next_sample(rate * 60).alias("sample"), timing.backoff(F.lit(2), F.pmod("channel_id", F.lit(3))).alias("backoff")))


def metadata_due(spark: SparkSession, folder: str) -> DataFrame:
    snapshots = table(spark, folder, "raw_channels").select(F.col("channel_id").alias("tg_id"), "fetched_at")
    return queues.metadata_due(channels(spark, folder).select("tg_id"), snapshots, at(), 14).select("tg_id", epoch("fetched_at"))


def awaiting_resolution(spark: SparkSession, folder: str) -> DataFrame:
    return queues.awaiting_resolution(channels(spark, folder)).select("tg_id")


QUERIES = {
    f.__name__: f
    for f in (
        derived_edges, discovered_channels, pending_mentions, missing_edges, edge_keys, inventory, first_wins, latest_wins, post_counters, reaction_kinds, mention_names, about_names, album_parts, event_props,
        pair_counts, top_targets, share_pairs, mutual_pairs, shared_tokens, signed_handles, about_pairs, detected_pairs, current_decisions, decision_counts, cascade_crossings, cited_ranking,
        incoming_references, outgoing_references, mature_medians, age_bands, default_bands, growth_curves, growth_factors, baseline_fit, spike_scores, spike_replay, ranked_scores, scoring_summary, spike_alerts, reference_variety, post_medians, scorecard, text_measures,
        style_scores, anomaly_z, anomaly_picks, views_below, status_counts, freshness, decayed_edges, balanced_pairs, community_partition, label_propagation, partition_nmi, inside_share, outward_lean, bridge_nodes,
        term_odds, due_queue, queue_lag, post_rates, poll_schedule, metadata_due, awaiting_resolution,
    )
}

from tidewire.plans.domain_sql import ORACLES  # noqa: E402, F401
