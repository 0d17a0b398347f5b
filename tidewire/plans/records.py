"""Queries of what is recorded: channels, cursors, candidates, polls, alerts and limits after a batch, each with its oracle.

The tables hold no batches, so each query derives one from stored rows by a stated rule, which its oracle repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import payload, text, timing
from tidewire.operators import baselines, cascades, families, queues, records, signals
from tidewire.plans import domain
from tidewire.plans.domain import at, channels, epoch, raw
from tidewire.plans.domain_sql import EDGES, INVENTORY, MESSAGES, NAMES, PC, POSTS, READINGS, REPOSTS, SHARES
from tidewire.plans.problems import PAIRS
from tidewire.sources import store
from tidewire.sources.tables import table

SPLIT = "2025-12-01 00:00:00"
S = f"timestamp '{SPLIT}'"


def every(c: str, n: int, k: int = 0) -> Column:
    return F.pmod(F.col(c), F.lit(n)) == k


# ---------------------------------------------------------------- schedules


def next_polls(spark: SparkSession, folder: str) -> DataFrame:
    """Live, failing and idle channels, each at a moment some hours after its last post."""
    posts = payload.posts(raw(spark, folder)).where("published is not null")
    own = posts.groupBy("channel_id").agg(F.max("published").alias("last"), (F.count("*") / F.lit(30.0)).alias("rate"))
    own = own.withColumn("now", timing.seconds("last") / 60 + F.pmod("channel_id", F.lit(100)) * 60.0)
    age = F.col("now") - timing.seconds("published") / 60
    live = posts.join(own, "channel_id").withColumn("age", age).where(F.col("age") <= timing.HORIZON).groupBy("channel_id").agg(F.min(F.col("now") + timing.next_sample(F.col("age")) - F.col("age")).alias("next_live"))
    rows = own.join(live, "channel_id", "left")
    due = timing.next_poll(F.col("now"), F.col("now") - F.pmod("channel_id", F.lit(40)), F.col("next_live"), F.col("rate"), F.pmod("channel_id", F.lit(5)), F.pmod("channel_id", F.lit(3)))
    return rows.select("channel_id", F.col("next_live").isNotNull().alias("live"), F.round(due - F.col("now"), 3).alias("wait"))


def quiet_hours(spark: SparkSession, folder: str) -> DataFrame:
    """Fetches in the quiet hours of a zone whose clocks change, and the end of those hours."""
    rows = raw(spark, folder).select("channel_id", "msg_id", F.col("fetched_at").cast("timestamp").alias("t")).distinct()
    until = timing.quiet_until(F.col("t"), 22, 7, "Europe/Berlin")
    return rows.select("channel_id", "msg_id", epoch("t"), timing.in_quiet_window(F.col("t"), 22, 7, "Europe/Berlin").alias("quiet"), F.unix_seconds(until).alias("until"))


def digests_due(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a digest of eight o'clock is due at each channel's last fetch, if the one before went out at its first."""
    rows = raw(spark, folder).groupBy("channel_id").agg(F.min("fetched_at").cast("timestamp").alias("first"), F.max("fetched_at").cast("timestamp").alias("last"))
    return rows.select("channel_id", timing.digest_due(F.col("first"), F.col("last"), 8, "Europe/Berlin").alias("due"), timing.digest_due(F.lit(None).cast("timestamp"), F.col("last"), 20, "UTC").alias("first_ever"))


def age_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return raw(spark, folder).select("msg_id", timing.age_phrase(F.pmod("msg_id", F.lit(5000)).cast("double")).alias("phrase")).distinct()


# ---------------------------------------------------------------- readings and edges


def stored_observations(spark: SparkSession, folder: str) -> DataFrame:
    """Readings that a batch overlapping the store adds: exact repeats are skipped."""
    seen = payload.observations(raw(spark, folder)).select("channel_id", "msg_id", "observed_at")
    fresh = store.absent(seen.where(F.col("observed_at") >= at("2025-10-01 00:00:00")), seen.where(F.col("observed_at") < at(SPLIT)), ["channel_id", "msg_id", "observed_at"])
    return fresh.select("channel_id", "msg_id", epoch("observed_at"))


def half_known(spark: SparkSession, folder: str) -> DataFrame:
    """The inventory without the channels of every third id but the sources of messages, so that forwards discover some."""
    sources = raw(spark, folder).select(F.col("channel_id").alias("tg_id")).distinct().withColumn("source", F.lit(True))
    return channels(spark, folder).join(sources, "tg_id", "left").where(F.col("source").isNotNull() | ~every("tg_id", 3)).drop("source")


def newly_discovered(spark: SparkSession, folder: str) -> DataFrame:
    from tidewire.operators import derive

    return derive.derive(raw(spark, folder), half_known(spark, folder)).discovered


def rederived_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges that a pass over all messages adds to those of the messages of even number, which the store holds already."""
    from tidewire.operators import derive

    found = derive.derive(raw(spark, folder), table(spark, folder, "channels")).edges
    held = found.where(every("msg_id", 2)).withColumns({"id": F.lit(1), "derived_at": at()})
    return derive.missing_edges(found, held).select(*derive.KEY)


def linked_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of messages that link, behind a text, the channel their channel references most: by bare id, by an unknown id or by name."""
    from tidewire.operators import derive

    names = channels(spark, folder).select(F.col("tg_id").alias("dst"), "username")
    top = domain.top_targets(spark, folder).join(names, "dst", "left").select(F.col("src").alias("channel_id"), "dst", "username")
    rows = raw(spark, folder).groupBy("channel_id", "msg_id").agg(F.min("fetched_at").alias("fetched_at")).join(top, "channel_id")
    url = F.when(every("msg_id", 3), F.concat(F.lit("t.me/c/"), F.col("dst").cast("string"), F.lit("/7"))).when(every("msg_id", 3, 1), F.lit("https://t.me/c/999/7")).otherwise(F.concat(F.lit("https://t.me/"), F.col("username"), F.lit("/9")))
    entity = F.struct(F.lit("MessageEntityTextUrl").alias("_"), F.lit(0).alias("offset"), F.lit(8).alias("length"), url.alias("url"))
    message = F.struct(F.lit("Message").alias("_"), F.lit("2026-01-01T00:00:00+00:00").alias("date"), F.lit("see this").alias("message"), F.array(entity).alias("entities"))
    found = derive.derive(rows.select("channel_id", "msg_id", F.to_json(message).alias("payload"), "fetched_at"), table(spark, folder, "channels")).edges
    return found.select(*derive.KEY)


def pending_source_count(spark: SparkSession, folder: str) -> DataFrame:
    """One row: (name, mentioner) pairs that wait for a name to be resolved."""
    from tidewire.operators import derive

    return derive.derive(raw(spark, folder), table(spark, folder, "channels")).pending.agg(F.count("*").alias("pairs"))


def latest_observations(spark: SparkSession, folder: str) -> DataFrame:
    """The newest reading of each channel."""
    return payload.observations(raw(spark, folder)).groupBy("channel_id").agg(F.max("observed_at").alias("observed_at")).select("channel_id", epoch("observed_at"))


def truncated_store(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each table after the derived ones are emptied."""
    kept = records.truncated({n: table(spark, folder, n) for n in ("edges", "raw_messages", "channels")})
    counts = [df.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, df in kept.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# ---------------------------------------------------------------- channels


def imported(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the stored snapshots as an import; every fifth id is moved out of the inventory."""
    p = F.from_json("payload", "chats array<struct<title: string, username: string>>")
    rows = table(spark, folder, "raw_channels").select("channel_id", "fetched_at", F.get(p["chats"], F.lit(0)).alias("c")).where("c is not null and fetched_at is not null")
    tg_id = F.when(every("channel_id", 5), F.col("channel_id") + 5_000_000_000).otherwise(F.col("channel_id"))
    return rows.select(tg_id.alias("tg_id"), F.col("c.username").alias("username"), F.col("c.title").alias("title"), F.lit(False).alias("is_chat"), F.col("fetched_at").cast("timestamp").alias("at"))


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    return channels(spark, folder).withColumn("resolved_at", F.col("resolved_at").cast("timestamp")).withColumn("first_seen_at", F.col("first_seen_at").cast("timestamp"))


def upserted_channels(spark: SparkSession, folder: str) -> DataFrame:
    rows = records.upsert_channels(inventory(spark, folder), imported(spark, folder), "import")
    return rows.select("tg_id", "username", "title", "status", "discovered_via", epoch("resolved_at"))


def upsert_counts(spark: SparkSession, folder: str) -> DataFrame:
    return records.upsert_counts(inventory(spark, folder), imported(spark, folder))


def linked_chats(spark: SparkSession, folder: str) -> DataFrame:
    """Every fourth imported channel becomes the chat of the channel with the next id."""
    chats = imported(spark, folder).where(every("tg_id", 4)).withColumn("parent", F.col("tg_id") + 1)
    return records.link_chats(inventory(spark, folder), chats).where("linked_to is not null").select("tg_id", "linked_to", "discovered_via")


def created_channels(spark: SparkSession, folder: str) -> DataFrame:
    rows = records.create_resolved(inventory(spark, folder), imported(spark, folder), "mention")
    return rows.select("tg_id", "username", "title", "is_chat", "discovered_via", epoch("resolved_at"))


def resolution_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Channels of every third id are resolved, of the next ids fail with a long error."""
    known = inventory(spark, folder).withColumns({"resolve_last_attempt_at": F.lit(None).cast("timestamp"), "resolve_last_error": F.lit(None).cast("string")})
    name, failed = F.concat(F.lit("new_"), F.col("tg_id").cast("string")), every("tg_id", 3, 1)
    tried = known.where(every("tg_id", 3) | failed).select("tg_id", at().alias("at"), name.alias("username"), F.lit("New").alias("title"), F.lit(True).alias("is_chat"), F.when(failed, F.repeat(F.lit("e"), 600)).alias("error"))
    rows = records.record_resolution(known, tried)
    return rows.select("tg_id", "username", "title", "is_chat", "resolve_attempts", F.length("resolve_last_error").cast("bigint").alias("error_length"), epoch("resolved_at"), epoch("resolve_last_attempt_at"))


def pending_after_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Names of even length failed, those of a length of five or ten were resolved."""
    waiting = domain.pending_mentions(spark, folder).select("username", F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("last_error"))
    length = F.length("username")
    failures = waiting.where(length % 2 == 0).select("username", at().alias("at"), F.repeat("username", 100).alias("error"))
    out = records.pending_failures(waiting, failures, waiting.where(length % 5 == 0))
    return out.select("username", "attempts", F.length("last_error").cast("bigint").alias("error_length"))


def known_names(spark: SparkSession, folder: str) -> DataFrame:
    """Which mentioned names a channel holds, in any case."""
    held = channels(spark, folder).where("username is not null").select(F.lower("username").alias("username")).distinct()
    return domain.mention_names(spark, folder).select("username").distinct().join(held, "username", "left_semi")


def cursors_after(spark: SparkSession, folder: str) -> DataFrame:
    """Collection cursors after one event a channel, the kind of event by its id."""
    posts = payload.posts(raw(spark, folder))
    old = posts.groupBy("channel_id").agg(F.lit("complete").alias("status"), F.min("msg_id").alias("oldest_fetched_id"), F.max("msg_id").alias("newest_fetched_id"), F.min("published").alias("cutoff_at"))
    old = old.where(~every("channel_id", 11)).withColumns({"failure_kind": F.when(every("channel_id", 2), "transient"), "failure_detail": F.when(every("channel_id", 2), "old")})
    kind = F.element_at(F.array(*[F.lit(x) for x in ("start", "progress", "newest", "complete", "skip", "failure")]), (F.pmod("channel_id", F.lit(6)) + 1).cast("int"))
    events = posts.groupBy("channel_id").agg(F.max("fetched_at").cast("timestamp").alias("at"), F.avg("msg_id").cast("bigint").alias("oldest_id"))
    events = events.select("channel_id", "at", kind.alias("event"), "oldest_id", F.when(~every("channel_id", 5), F.col("oldest_id") + 1).alias("newest_id"), F.col("at").alias("cutoff"), F.lit("permanent").alias("kind"), F.repeat(F.lit("d"), 700).alias("detail"))
    rows = records.record_cursors(old, events)
    done = records.completed_to(F.col("status"), F.col("cutoff_at"), at(SPLIT))
    return rows.select("channel_id", "status", "oldest_fetched_id", "newest_fetched_id", epoch("cutoff_at"), "failure_kind", F.length("failure_detail").cast("bigint").alias("detail_length"), done.alias("done"))


# ---------------------------------------------------------------- candidates, polls, verdicts


def upserted_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Stored pairs with their decisions after a run that finds the pairs of the share signal."""
    pairs = families.current_pairs(table(spark, folder, "affiliation_candidates"))
    stored = pairs.select(F.col("a").alias("channel_a"), F.col("b").alias("channel_b"), F.lit(0.25).alias("score"), "run_id", F.lit("mutual").alias("about_direction"), F.lit(0.5).alias("out_share"), "decision")
    found = signals.share_signal(domain.pair_counts(spark, folder), domain.SIGNAL).select("channel_a", "channel_b", (F.col("out_share") * 0.8).alias("score"), "out_share")
    out = records.upsert_candidates(stored, found, 99)
    return out.select("channel_a", "channel_b", F.round("score", 9).alias("score"), "run_id", "about_direction", F.round("out_share", 9).alias("out_share"), "decision")


def poll_records(spark: SparkSession, folder: str) -> DataFrame:
    own = raw(spark, folder).groupBy("channel_id").agg(F.max("fetched_at").cast("timestamp").alias("at"), F.min("fetched_at").cast("timestamp").alias("first"))
    state = own.where(~every("channel_id", 7)).select(
        "channel_id", F.col("first").alias("due_at"), F.col("first").alias("last_polled_at"), F.lit(2.5).alias("posts_per_day"), F.col("first").alias("posts_per_day_at"),
        F.pmod("channel_id", F.lit(6)).cast("int").alias("consecutive_empty"), F.pmod("channel_id", F.lit(4)).cast("int").alias("consecutive_failures"), F.lit("old").alias("last_error"),
    )
    polls = own.where(~every("channel_id", 9)).select("channel_id", "at", (F.col("at") + F.expr("interval 1 hour")).alias("due_at"), F.when(~every("channel_id", 3), F.lit(7.0)).alias("posts_per_day"), every("channel_id", 4).alias("found_nothing"), F.when(every("channel_id", 5), "boom").alias("error"))
    out = records.record_polls(state, polls)
    return out.select("channel_id", epoch("due_at"), epoch("last_polled_at"), "posts_per_day", epoch("posts_per_day_at"), "consecutive_empty", "consecutive_failures", "last_error")


def postponed_polls(spark: SparkSession, folder: str) -> DataFrame:
    return queues.postpone(domain.poll_state(spark, folder), at(SPLIT)).select("tg_id", epoch("due_at"))


def verdict_records(spark: SparkSession, folder: str) -> DataFrame:
    """Answers to alerts: the stored ones from before a moment, replaced by the latest."""
    given = table(spark, folder, "cited_posts").where("published is not null").select(F.pmod("msg_id", F.lit(500)).alias("alert_id"), F.element_at(F.array(F.lit("good"), F.lit("bad"), F.lit("later")), (F.pmod("channel_id", F.lit(3)) + 1).cast("int")).alias("verdict"), F.col("published").cast("timestamp").alias("at"))
    stored = records.newest(given.where(F.col("at") < at(SPLIT)), ["alert_id"]).withColumnRenamed("at", "given_at")
    return records.record_verdicts(stored, given.where(F.col("at") >= at(SPLIT))).select("alert_id", "verdict", epoch("given_at"))


# ---------------------------------------------------------------- limits


def floods(spark: SparkSession, folder: str) -> DataFrame:
    """The event stream read as rate limits."""
    return table(spark, folder, "events").select(F.col("event_type").alias("method"), F.floor("value").cast("bigint").alias("seconds"), F.col("ts").cast("timestamp").alias("at"))


def recent_floods(spark: SparkSession, folder: str) -> DataFrame:
    return records.recent_floods(floods(spark, folder)).select("method", "seconds", F.unix_micros("at").alias("at_us"))


def latest_floods(spark: SparkSession, folder: str) -> DataFrame:
    return records.latest_floods(floods(spark, folder)).select("method", "seconds", F.unix_micros("at").alias("at_us"))


def flood_summary(spark: SparkSession, folder: str) -> DataFrame:
    return queues.flood_summary(floods(spark, folder)).select("method", "floods", "longest", F.unix_micros("last_at").alias("last_us"))


# ---------------------------------------------------------------- alerts


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Cascade alerts of the lowest band as a table with earlier attempts, every seventh delivered."""
    rows = queues.cascade_alerts(domain.cascade_crossings(spark, folder)).where("band = 1")
    done = every("msg_id", 7)
    return rows.select(
        (F.col("channel_id") * 100_000 + F.col("msg_id")).alias("id"), "kind", "channel_id", "msg_id", "band", "value", (at() - F.make_dt_interval(mins=F.pmod("msg_id", F.lit(50)).cast("int"))).alias("raised_at"),
        F.when(done, at()).alias("delivered_at"), F.when(done, "direct").alias("delivery"), F.pmod("msg_id", F.lit(3)).cast("int").alias("attempts"), F.when(every("msg_id", 3, 2) & ~done, "old").alias("last_error"),
    )


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return alerts(spark, folder).where(every("msg_id", 4) | every("msg_id", 4, 1)).select("id", at().alias("at"), F.lit("digest").alias("delivery"), F.when(every("msg_id", 4), F.repeat(F.lit("x"), 600)).alias("error"))


def deliveries(spark: SparkSession, folder: str) -> DataFrame:
    out = queues.mark_deliveries(alerts(spark, folder), outcomes(spark, folder))
    return out.select("id", epoch("delivered_at"), "delivery", "attempts", F.length("last_error").cast("bigint").alias("error_length"))


def outstanding_alerts(spark: SparkSession, folder: str) -> DataFrame:
    return queues.outstanding(queues.mark_deliveries(alerts(spark, folder), outcomes(spark, folder))).select("outstanding", "untried", "failing", epoch("oldest"))


def claimed_alerts(spark: SparkSession, folder: str) -> DataFrame:
    return queues.claim(alerts(spark, folder), 10).select("id", epoch("raised_at"))


def delivery_plan(spark: SparkSession, folder: str) -> DataFrame:
    return queues.delivery_plan(alerts(spark, folder), F.col("raised_at"), ("spike",), (23, 6), "Europe/Berlin").select("id", "plan")


def raised_bands(spark: SparkSession, folder: str) -> DataFrame:
    found = queues.raised_bands(queues.cascade_alerts(domain.cascade_crossings(spark, folder)))
    return found.select("channel_id", "msg_id", F.concat_ws(",", F.transform("bands", lambda b: b.cast("string"))).alias("bands"))


def new_cascades(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts that the default window adds to those raised at the lowest band before."""
    found = queues.cascade_alerts(domain.cascade_crossings(spark, folder))
    return queues.raise_alerts(found, found.where("band = 1"))


def default_cascades(spark: SparkSession, folder: str) -> DataFrame:
    """Crossings with the default bands and window."""
    return cascades.crossings(domain.reposts(spark, folder), cascades.CascadeParams())


def rendered_alerts(spark: SparkSession, folder: str) -> DataFrame:
    names = channels(spark, folder).select(F.col("tg_id").alias("channel_id"), "title", "username")
    rows = alerts(spark, folder).join(names, "channel_id").withColumn("link", text.post_link("username", "msg_id"))
    scores = rows.where(every("msg_id", 2)).withColumn("kind", F.lit("spike")).withColumn("value", 3.0 + F.pmod("msg_id", F.lit(40)) / 10.0)
    return queues.render(rows.where(~every("msg_id", 2)).unionByName(scores)).select("id", "line")


def family_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Stored decisions after each stored family of up to five is confirmed whole and odd ones are withdrawn."""
    held = table(spark, folder, "channel_families").select(F.col("family_key").alias("group"), F.col("channel_id").alias("tg_id")).distinct()
    small = held.join(held.groupBy("group").agg(F.count("*").alias("n")).where("n <= 5"), "group", "left_semi")
    stored = families.current_pairs(table(spark, folder, "affiliation_candidates")).select(F.col("a").alias("channel_a"), F.col("b").alias("channel_b"), "decision")
    confirmed = queues.decide(stored, queues.all_pairs(small), "confirmed")
    return queues.decide(confirmed, queues.all_pairs(small.where(every("group", 2, 1))), "withdrawn")


def marked_channels(spark: SparkSession, folder: str) -> DataFrame:
    """Every third candidate becomes a seed, every third after it is rejected with a reason."""
    rows = channels(spark, folder)
    rejected = every("tg_id", 3, 1)
    marks = rows.where((F.col("status") == "candidate") & ~every("tg_id", 3, 2)).select("tg_id", F.when(rejected, "rejected").otherwise("seed").alias("status"), F.when(~rejected, "media").alias("kind"), F.when(rejected, "spam").alias("reason"))
    return queues.mark(rows, marks).select("tg_id", "status", "kind", "reject_reason")


def healthy_scope(spark: SparkSession, folder: str) -> DataFrame:
    return baselines.scope(channels(spark, folder), channels(spark, folder).where(every("tg_id", 7)).select("tg_id", F.lit("permanent").alias("failure_kind"))).where("seed").select("channel_id", "kind", "healthy")


# ---------------------------------------------------------------- documents


def encoded_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Messages parsed, encoded and parsed again: the counters survive."""
    p = payload.parsed(raw(spark, folder)).select("channel_id", "msg_id", "fetched_at", payload.parse(records.encode_payload(F.col("p"))).alias("p"))
    return p.where("p._ = 'Message'").select("channel_id", "msg_id", epoch("fetched_at"), F.col("p.views").alias("views"), F.length("p.message").cast("bigint").alias("chars")).distinct()


def odd_counters(spark: SparkSession, folder: str) -> DataFrame:
    """A counter that is a boolean, a text or a fraction is none; absent and null are alike."""
    value = F.element_at(F.array(*[F.lit(x) for x in ("true", '"12"', "null", "7", "-3", "{}", "[1]")]), (F.pmod("msg_id", F.lit(7)) + 1).cast("int"))
    p = payload.parse(F.concat(F.lit('{"_": "Message", "views": '), value, F.lit(', "forwards": 5}')))
    return raw(spark, folder).select("msg_id", p.alias("p")).distinct().select("msg_id", F.col("p.views").alias("views"), F.col("p.forwards").alias("forwards"))


QUERIES = {
    f.__name__: f
    for f in (
        next_polls, quiet_hours, digests_due, age_phrases, stored_observations, newly_discovered, rederived_edges, linked_edges, pending_source_count, latest_observations, truncated_store, upserted_channels, upsert_counts, linked_chats, created_channels, resolution_attempts,
        pending_after_failures, known_names, cursors_after, upserted_candidates, poll_records, postponed_polls, verdict_records, recent_floods, latest_floods, flood_summary, deliveries, outstanding_alerts, claimed_alerts,
        delivery_plan, raised_bands, new_cascades, default_cascades, rendered_alerts, family_decisions, marked_channels, healthy_scope, encoded_payloads, odd_counters,
    )
}

NOW = "timestamp '2026-08-01 00:00:00'"
IMPORTED = """batch as (
  select tg_id, username, title, ts from (
    select *, row_number() over (partition by tg_id order by ts desc, username desc nulls last, title desc nulls last) rn from (
      select case when channel_id % 5 = 0 then channel_id + 5000000000 else channel_id end tg_id, j->'chats'->0->>'username' username, j->'chats'->0->>'title' title, fetched_at ts
      from (select *, case when json_valid(payload) then payload::json end j from raw_channels) where json_type(j->'chats'->0) = 'OBJECT' and fetched_at is not null)) where rn = 1)"""
FULL = INVENTORY.replace("linked_to from (", "linked_to, discovered_via from (")
CROSSED = f"""{REPOSTS}, fc as (select channel_id, msg_id, count(distinct src_family)::bigint families from rp
  where src_family <> dst_family and published_at >= dst_published_at and epoch_us(published_at) - epoch_us(dst_published_at) <= 240 * 3600 * 1000000::bigint group by 1, 2),
al as (select channel_id * 100000 + msg_id id, channel_id, msg_id, families, {NOW} - to_minutes(msg_id % 50) raised_at, msg_id % 7 = 0 done, (msg_id % 3)::int attempts, case when msg_id % 3 = 2 and msg_id % 7 <> 0 then 'old' end last_error from fc),
sent as (select *, not done and msg_id % 4 in (0, 1) tried, msg_id % 4 = 0 bad from al),
after as (select id, case when done or (tried and not bad) then {NOW} end delivered_at, case when done then 'direct' when tried and not bad then 'digest' end delivery, attempts + tried::int attempts, raised_at,
  case when tried and bad then 500 when tried then null else length(last_error) end::bigint error_length from sent)"""

ORACLES = {
    "next_polls": f"""with {POSTS}, own as (select channel_id, epoch_us(max(published)) / 1e6 / 60 + (channel_id % 100) * 60.0 now, count(*) / 30.0 rate from posts where published is not null group by channel_id),
ages as (select channel_id, now - epoch_us(published) / 1e6 / 60 age from posts join own using (channel_id) where published is not null),
live as (select channel_id, min(list_min(list_filter([15, 30, 60, 120, 240, 480, 1440, 2880], lambda o: o > age)) - age) ahead from ages where age <= 49 * 60 group by 1),
w as (select channel_id, ahead, greatest(30, least(720, 1440 / rate * 0.25)) * pow(1.5, least(channel_id % 5, 4)) * pow(2, channel_id % 3) stretched from own left join live using (channel_id))
select channel_id, ahead is not null live, round(greatest(coalesce(ahead, case when channel_id % 3 > 0 then least(stretched, 1440) else stretched end), 10 - channel_id % 40, 0), 3)::double wait from w""",
    "quiet_hours": """with l as (select distinct channel_id, msg_id, fetched_at, timezone('Europe/Berlin', fetched_at::timestamptz) loc from raw_messages), q as (select *, hour(loc) >= 22 or hour(loc) < 7 quiet from l)
select channel_id, msg_id, epoch(fetched_at)::bigint t, quiet, epoch(case when quiet then timezone('Europe/Berlin', date_trunc('day', loc) + case when hour(loc) >= 22 then interval 31 hour else interval 7 hour end) else fetched_at::timestamptz end)::bigint until from q""".replace("epoch(fetched_at)::bigint t,", "(epoch_us(fetched_at) // 1000000)::bigint t,").replace("else fetched_at::timestamptz end)::bigint until", "else date_trunc('second', fetched_at::timestamptz) end)::bigint until"),
    "digests_due": """with f as (select channel_id, timezone('Europe/Berlin', min(fetched_at)::timestamptz) a, timezone('Europe/Berlin', max(fetched_at)::timestamptz) b, hour(max(fetched_at)) h from raw_messages group by 1)
select channel_id, hour(b) >= 8 and a::date < b::date due, h >= 20 first_ever from f""",
    "age_phrases": "select distinct msg_id, case when m < 60 then m || 'm' when m < 1440 then (m // 60) || 'h' else (m // 1440) || 'd' end phrase from (select msg_id, msg_id % 5000 m from raw_messages)",
    "stored_observations": f"select distinct channel_id, msg_id, epoch(fetched_at)::bigint observed_at from raw_messages where payload::json->>'_' = 'Message' and fetched_at >= {S}".replace("epoch(fetched_at)::bigint", "(epoch_us(fetched_at) // 1000000)::bigint"),
    "newly_discovered": f"with {MESSAGES.replace('), names as', ' and (tg_id % 3 <> 0 or tg_id in (select channel_id from raw_messages))), names as', 1)} select distinct dst tg_id, 'forward' discovered_via from fwd where dst not in (select tg_id from inv)",
    "rederived_edges": f"with {MESSAGES} select distinct src src_channel_id, msg_id, kind, dst dst_channel_id, dst_msg_id from every where msg_id % 2 <> 0",
    "linked_edges": f"""with {INVENTORY}, {NAMES}, {EDGES}, {PC}, top as (select src, arg_max(dst, (n, -dst)) dst from pc group by src),
m as (select distinct r.channel_id, msg_id, top.dst, regexp_replace(lower(trim(i.username)), '^@', '') u from raw_messages r join inv s on s.tg_id = r.channel_id and s.status in ('candidate', 'seed', 'maybe') and not s.is_chat join top on top.src = r.channel_id left join inv i on i.tg_id = top.dst),
t as (select channel_id, msg_id, case msg_id % 3 when 0 then (select tg_id from inv where tg_id = m.dst) when 1 then (select tg_id from inv where tg_id = 999) else n.dst end dst, case msg_id % 3 when 2 then 9 else 7 end::bigint p from m left join names n on n.uname = m.u and regexp_full_match(m.u, '[a-z][a-z0-9_]{{3,31}}'))
select channel_id src_channel_id, msg_id, 'mention' kind, dst dst_channel_id, p dst_msg_id from t where dst is not null and dst <> channel_id""",
    "pending_source_count": f"with {MESSAGES} select count(*)::bigint pairs from (select distinct uname, src from resolved where dst is null)",
    "latest_observations": "select channel_id, (epoch_us(max(fetched_at)) // 1000000)::bigint observed_at from raw_messages where payload::json->>'_' = 'Message' group by 1",
    "truncated_store": "select 'edges' name, 0::bigint n union all select 'raw_messages', count(*)::bigint from raw_messages union all select 'channels', count(*)::bigint from channels",
    "upserted_channels": f"""with {FULL}, {IMPORTED} select coalesce(i.tg_id, b.tg_id) tg_id, case when b.tg_id is null then i.username else b.username end username, case when b.tg_id is null then i.title else b.title end title, case when i.tg_id is null then 'candidate' else i.status end status,
  case when i.tg_id is null then 'import' else i.discovered_via end discovered_via, (epoch_us(coalesce(i.resolved_at, case when b.username is not null then b.ts end)) // 1000000)::bigint resolved_at from inv i full join batch b on b.tg_id = i.tg_id""",
    "upsert_counts": f"with {INVENTORY}, {IMPORTED} select count(*) filter (i.tg_id is null)::bigint inserted, count(i.tg_id)::bigint updated from batch b left join inv i on i.tg_id = b.tg_id",
    "linked_chats": f"with {FULL}, {IMPORTED} select coalesce(i.tg_id, b.tg_id) tg_id, coalesce(b.tg_id + 1, i.linked_to) linked_to, case when i.tg_id is null then 'linked_chat' else i.discovered_via end discovered_via from inv i full join (select * from batch where tg_id % 4 = 0) b on b.tg_id = i.tg_id where coalesce(b.tg_id + 1, i.linked_to) is not null",
    "created_channels": f"""with {FULL}, {IMPORTED} select coalesce(i.tg_id, b.tg_id) tg_id, case when b.tg_id is null then i.username else b.username end username, case when b.tg_id is null then i.title else b.title end title, case when b.tg_id is null then i.is_chat else false end is_chat,
  case when i.tg_id is null then 'mention' else i.discovered_via end discovered_via, (epoch_us(coalesce(b.ts, i.resolved_at)) // 1000000)::bigint resolved_at from inv i full join batch b on b.tg_id = i.tg_id""",
    "resolution_attempts": f"""with {INVENTORY} select tg_id, case when tg_id % 3 = 0 then 'new_' || tg_id else username end username, case when tg_id % 3 = 0 then 'New' else title end title, case when tg_id % 3 = 0 then true else is_chat end is_chat,
  case when tg_id % 3 = 1 then coalesce(resolve_attempts, 0) + 1 else resolve_attempts end::int resolve_attempts, case when tg_id % 3 = 1 then 500 end::bigint error_length,
  (epoch_us(case when tg_id % 3 = 0 then {NOW} else resolved_at end) // 1000000)::bigint resolved_at, case when tg_id % 3 < 2 then epoch({NOW})::bigint end resolve_last_attempt_at from inv""",
    "pending_after_failures": f"""with {MESSAGES}, w as (select distinct uname u from resolved where dst is null and uname not in (select uname from names))
select u username, (length(u) % 2 = 0)::int attempts, case when length(u) % 2 = 0 then least(500, 100 * length(u)) end::bigint error_length from w where length(u) % 5 <> 0""",
    "known_names": f"with {MESSAGES.replace('where channel_id in (select tg_id from inv where status in', 'where true or channel_id in (select tg_id from inv where status in')} select distinct uname username from refs where uname in (select uname from names)",
    "cursors_after": f"""with {POSTS}, ev as (select channel_id, ['start', 'progress', 'newest', 'complete', 'skip', 'failure'][channel_id % 6 + 1] e, max(fetched_at) ts, trunc(avg(msg_id))::bigint o, case when channel_id % 5 <> 0 then trunc(avg(msg_id))::bigint + 1 end n from posts group by channel_id),
old as (select channel_id, 'complete' st, min(msg_id) oldest, max(msg_id) newest, min(published) cut, case when channel_id % 2 = 0 then 'transient' end fk, case when channel_id % 2 = 0 then 3 end fd from posts where channel_id % 11 <> 0 group by channel_id),
r as (select channel_id, case when e in ('start', 'progress') then 'running' when e = 'complete' then 'complete' when e = 'skip' then 'skipped' when e = 'failure' then 'failed' else st end status, case when e = 'progress' then o else oldest end oldest_fetched_id,
  case when e = 'newest' then greatest(coalesce(newest, n), n) when e = 'progress' and n is not null then n else newest end newest_fetched_id, case when e = 'complete' then ts::timestamptz else cut end cut,
  case when e = 'failure' then 'permanent' when e <> 'start' then fk end failure_kind, case when e in ('failure', 'skip') then 500 when e <> 'start' then fd end::bigint detail_length from ev left join old using (channel_id))
select channel_id, status, oldest_fetched_id, newest_fetched_id, (epoch_us(cut) // 1000000)::bigint cutoff_at, failure_kind, detail_length, coalesce(status = 'complete' and cut <= {S}::timestamptz, false) done from r""",
    "upserted_candidates": f"""with recursive {PAIRS}, {EDGES}, {PC}, {SHARES}, run as (select least(x, y) a, greatest(x, y) b, max(run_id) run_id from (
  select case when channel_a < -1000000000000 then -channel_a - 1000000000000 else channel_a end x, case when channel_b < -1000000000000 then -channel_b - 1000000000000 else channel_b end y, run_id from affiliation_candidates) where x <> y group by 1, 2)
select coalesce(p.a, s.channel_a) channel_a, coalesce(p.b, s.channel_b) channel_b, round(coalesce(s.out_share * 0.8, 0.25), 9)::double score, case when s.channel_a is not null then 99 else run_id end::bigint run_id, case when s.channel_a is null then 'mutual' end about_direction,
  round(coalesce(s.out_share, 0.5), 9)::double out_share, case when p.a is null then 'pending' else d end decision from (select pairs.a, pairs.b, d, run_id from pairs join run using (a, b)) p full join share_signal s on s.channel_a = p.a and s.channel_b = p.b""",
    "poll_records": """with o as (select channel_id, max(fetched_at) ts, min(fetched_at) f, channel_id % 7 <> 0 old, channel_id % 9 <> 0 new, channel_id % 5 = 0 bad, channel_id % 4 = 0 nil, channel_id % 3 <> 0 rated from raw_messages group by 1)
select channel_id, (epoch_us(case when new then ts + interval 1 hour else f end) // 1000000)::bigint due_at, (epoch_us(case when new then ts else f end) // 1000000)::bigint last_polled_at, case when new and rated then 7.0 when old then 2.5 end::double posts_per_day,
  (epoch_us(case when new and (rated or not old) then ts when old then f end) // 1000000)::bigint posts_per_day_at, case when not new then channel_id % 6 when bad then case when old then channel_id % 6 else 0 end when nil then case when old then channel_id % 6 else 0 end + 1 else 0 end::int consecutive_empty,
  case when not new then channel_id % 4 when bad then case when old then channel_id % 4 else 0 end + 1 else 0 end::int consecutive_failures, case when new then case when bad then 'boom' end else 'old' end last_error from o where old or new""",
    "postponed_polls": f"select channel_id tg_id, (epoch_us(greatest(max(fetched_at), {S})) // 1000000)::bigint due_at from raw_messages group by 1",
    "verdict_records": "select alert_id, verdict, (epoch_us(published) // 1000000)::bigint given_at from (select msg_id % 500 alert_id, ['good', 'bad', 'later'][channel_id % 3 + 1] verdict, published, row_number() over (partition by msg_id % 500 order by published desc, ['good', 'bad', 'later'][channel_id % 3 + 1] desc) rn from cited_posts where published is not null) where rn = 1",
    "recent_floods": 'select event_type "method", floor("value")::bigint "seconds", epoch_us(ts) at_us from events order by ts desc, event_type, floor("value") desc limit 50',
    "latest_floods": 'select event_type "method", arg_max(floor("value")::bigint, (ts, floor("value"))) "seconds", max(epoch_us(ts)) at_us from events group by 1',
    "flood_summary": 'select event_type "method", count(*)::bigint floods, max(floor("value"))::bigint longest, max(epoch_us(ts)) last_us from events group by 1',
    "deliveries": f"with recursive {CROSSED} select id, epoch(delivered_at)::bigint delivered_at, delivery, attempts, error_length from after",
    "outstanding_alerts": f"with recursive {CROSSED} select count(*) filter (delivered_at is null)::bigint outstanding, count(*) filter (delivered_at is null and attempts = 0)::bigint untried, count(*) filter (delivered_at is null and error_length is not null)::bigint failing, epoch(min(raised_at) filter (delivered_at is null))::bigint oldest from after",
    "claimed_alerts": f"with recursive {CROSSED} select id, epoch(raised_at)::bigint raised_at from al where not done order by raised_at, id limit 10",
    "delivery_plan": f"with recursive {CROSSED} select id, case when hour(timezone('Europe/Berlin', raised_at::timestamptz)) >= 23 or hour(timezone('Europe/Berlin', raised_at::timestamptz)) < 6 then 'held' else 'direct' end plan from al where not done",
    "raised_bands": f"with recursive {CROSSED} select channel_id, msg_id, string_agg(band::varchar, ',' order by band) bands from fc, (select unnest([1, 2, 3]) band) where families >= band group by 1, 2",
    "new_cascades": f"with recursive {CROSSED} select 'cascade' kind, channel_id, msg_id, band::int band, families::double \"value\" from fc, (select unnest([2, 3]) band) where families >= band",
    "default_cascades": f"""with recursive {REPOSTS}, fc as (select channel_id, msg_id, count(distinct src_family)::bigint families from rp
  where src_family <> dst_family and published_at >= dst_published_at and epoch_us(published_at) - epoch_us(dst_published_at) <= 6 * 3600 * 1000000::bigint group by 1, 2) select channel_id, msg_id, band::int band, families from fc, (select unnest([2, 3]) band) where families >= band""",
    "rendered_alerts": f"""with recursive {CROSSED}, {INVENTORY}, r as (select al.id, al.msg_id, families, coalesce(title, '?') title, 'https://t.me/' || username || '/' || al.msg_id link, 3.0 + (al.msg_id % 40) / 10.0 z from al join inv on inv.tg_id = al.channel_id)
select id, case when msg_id % 2 <> 0 then concat_ws(' ', 'carried by', families::varchar, 'families:', title, link) else concat_ws(' ', case when z < 4 then 'unusual' when z < 6 then 'strong' else 'extreme' end, 'spike', format('{{:.1f}}', z), '·', title, link) end line from r""",
    "family_decisions": f"""with recursive {PAIRS}, held as (select distinct family_key g, channel_id c from channel_families), small as (select * from held where g in (select g from held group by 1 having count(*) <= 5)),
ap as (select distinct x.c a, y.c b, max(x.g % 2 = 1) odd from small x join small y on x.g = y.g and x.c < y.c group by 1, 2)
select coalesce(p.a, ap.a) channel_a, coalesce(p.b, ap.b) channel_b, case when ap.a is null then d when odd then 'pending' else 'confirmed' end decision from pairs p full join ap on ap.a = p.a and ap.b = p.b""",
    "marked_channels": f"""with {INVENTORY.replace("linked_to from (", "linked_to, reject_reason from (")}, m as (select *, status = 'candidate' and tg_id % 3 < 2 hit, tg_id % 3 = 1 bad from inv)
select tg_id, case when hit then case when bad then 'rejected' else 'seed' end else status end status, case when hit and not bad then 'media' else kind end kind, case when hit then case when bad then 'spam' end else reject_reason end reject_reason from m""",
    "healthy_scope": f"with {INVENTORY} select tg_id channel_id, kind, tg_id % 7 <> 0 healthy from inv where status = 'seed' and not is_chat",
    "encoded_payloads": "select distinct channel_id, msg_id, (epoch_us(fetched_at) // 1000000)::bigint fetched_at, (j->>'views')::bigint views, length(j->>'message')::bigint chars from (select *, payload::json j from raw_messages) where j->>'_' = 'Message'",
    "odd_counters": "select distinct msg_id, case msg_id % 7 when 3 then 7 when 4 then -3 end::bigint views, 5::bigint forwards from raw_messages",
}
