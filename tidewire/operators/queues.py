"""Work queues, review states and alert delivery as transformations of their tables at an explicit moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.timing import in_quiet_window, seconds

#: Errors after which a channel is not asked again, by class name (fixed values).
PERMANENT = (
    "ChannelPrivateError", "ChannelInvalidError", "ChannelPublicGroupNaError", "UsernameInvalidError", "UsernameNotOccupiedError", "PeerIdInvalidError", "InviteHashExpiredError", "ValueError",
)


def in_scope(channels: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Seeds that are no chats and did not fail for good. failures: tg_id, failure_kind (null is no failure)."""
    rows = channels.where("status = 'seed' and not is_chat")
    if failures is None:
        return rows
    return rows.join(failures, "tg_id", "left").where(~F.col("failure_kind").eqNullSafe("permanent"))


def classify_failure(name: Column) -> Column:
    """permanent or transient, by the error's class name."""
    return F.when(name.isin(*PERMANENT), "permanent").otherwise("transient")


def due(channels: DataFrame, state: DataFrame, now: Column, limit: int | None = 25) -> DataFrame:
    """Channels to poll: never polled first, then the most overdue, then by id. state: tg_id, due_at."""
    rows = channels.join(state, "tg_id", "left").where(F.col("due_at").isNull() | (F.col("due_at") <= now)).orderBy(F.asc_nulls_first("due_at"), "tg_id")
    return rows if limit is None else rows.limit(limit)


def lag(channels: DataFrame, state: DataFrame, now: Column) -> DataFrame:
    """One row: overdue channels, the oldest due moment, tracked channels."""
    rows = channels.join(state, "tg_id", "left")
    late = F.col("due_at").isNull() | (F.col("due_at") <= now)
    return rows.agg(F.count_if(late).alias("overdue"), F.min(F.when(late, F.col("due_at"))).alias("oldest_due"), F.count("due_at").alias("tracked"))


def posts_per_day(posts: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Rate of each channel over the days before now."""
    age = seconds(now) - seconds("published")
    return posts.where((age >= 0) & (age < days * 86_400)).groupBy("channel_id").agg((F.count("*") / F.lit(float(days))).alias("posts_per_day"))


def postpone(state: DataFrame, until: Column) -> DataFrame:
    """Move every due moment to ``until`` or later; none moves back."""
    return state.withColumn("due_at", F.greatest("due_at", until))


def metadata_due(channels: DataFrame, snapshots: DataFrame, now: Column, max_age_days: float) -> DataFrame:
    """Channels whose newest snapshot is missing or older than the limit. snapshots: tg_id, fetched_at."""
    newest = snapshots.groupBy("tg_id").agg(F.max("fetched_at").alias("fetched_at"))
    old = seconds("fetched_at") < seconds(now) - max_age_days * 86_400
    return channels.join(newest, "tg_id", "left").where(F.col("fetched_at").isNull() | old)


def awaiting_resolution(channels: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Channels without identity, by id; those that failed before only on request."""
    rows = channels.where("resolved_at is null")
    return (rows if retry_failed else rows.where("coalesce(resolve_attempts, 0) = 0")).orderBy("tg_id")


class ChannelNotFound(LookupError):
    pass


class AmbiguousChannel(LookupError):
    pass


def find_channel(channels: DataFrame, ref: str) -> DataFrame:
    """The one channel that an id or a username (any case, with or without @) names.

    Raises ChannelNotFound if none does, AmbiguousChannel if several do.
    """
    ref = ref.strip()
    match = F.col("tg_id") == int(ref) if ref.lstrip("-").isdigit() else F.lower("username") == ref.removeprefix("@").lower()
    found = channels.where(match)
    held = found.select("tg_id").distinct().limit(2).count()
    if held != 1:
        raise (AmbiguousChannel if held else ChannelNotFound)(ref)
    return found


def mark(channels: DataFrame, marks: DataFrame) -> DataFrame:
    """Review: status, kind and reason of marked channels (tg_id, status, kind, reason); a rejection, and only it, has a reason.

    Raises on a batch that breaks the rule.
    """
    bad = marks.where("(status = 'rejected') <> (reason is not null)").limit(1).count()
    if bad:
        raise ValueError("a rejection needs a reason, anything else must have none")
    m = marks.select("tg_id", F.col("status").alias("_s"), F.col("kind").alias("_k"), F.col("reason").alias("_r"), F.lit(True).alias("_m"))
    rows = channels.join(m, "tg_id", "left")
    set_to = lambda c, new: F.when(F.col("_m"), new).otherwise(F.col(c)).alias(c)
    new = {"status": F.col("_s"), "kind": F.coalesce("_k", "kind"), "reject_reason": F.col("_r")}
    return rows.select(*[set_to(c, new[c]) if c in new else c for c in channels.columns])


def all_pairs(members: DataFrame, group: str = "group", member: str = "tg_id") -> DataFrame:
    """Every pair of the channels an operator names as one family: channel_a < channel_b. Groups are written by hand and small."""
    x, y = members.select(group, F.col(member).alias("channel_a")).distinct(), members.select(group, F.col(member).alias("channel_b")).distinct()
    return x.join(y, group).where("channel_a < channel_b").select("channel_a", "channel_b").distinct()


def decide(stored: DataFrame, pairs: DataFrame, decision: str) -> DataFrame:
    """Stored decisions after confirming, rejecting or withdrawing pairs; withdrawn pairs are pending again."""
    value = "pending" if decision == "withdrawn" else decision
    fresh = pairs.select("channel_a", "channel_b", F.lit(value).alias("_d"))
    return stored.select("channel_a", "channel_b", "decision").join(fresh, ["channel_a", "channel_b"], "full").select("channel_a", "channel_b", F.coalesce("_d", "decision").alias("decision"))


def raise_alerts(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Alerts to add: those whose (kind, channel_id, msg_id, band) the store lacks, once each."""
    keys = ["kind", "channel_id", "msg_id", "band"]
    return found.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def spike_alerts(spikes: DataFrame) -> DataFrame:
    """Spikes as alerts: one a post, always of band 1, the value its score."""
    return spikes.select(F.lit("spike").alias("kind"), "channel_id", "msg_id", F.lit(1).alias("band"), F.col("z").alias("value"))


def cascade_alerts(crossings: DataFrame) -> DataFrame:
    """Crossed bands as alerts, the value the number of families; in order of post and band."""
    return crossings.select(F.lit("cascade").alias("kind"), "channel_id", "msg_id", "band", F.col("families").cast("double").alias("value")).orderBy("channel_id", "msg_id", "band")


def raised_bands(alerts: DataFrame, kind: str = "cascade") -> DataFrame:
    """The bands already raised of each post, as a set in order."""
    return alerts.where(F.col("kind") == kind).groupBy("channel_id", "msg_id").agg(F.array_sort(F.collect_set("band")).alias("bands"))  # a few bands a post


def mark_deliveries(alerts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Alerts after attempts to send them. outcomes: id, at, delivery (how it went out), error (null if it did).

    A success sets the moment and way of delivery and clears the error; a failure keeps the alert open with the error's
    first 500 characters; both count an attempt. An alert once delivered stays as it is.
    """
    o = outcomes.groupBy("id").agg(F.max(F.struct("at", F.col("delivery").alias("how"), F.col("error").alias("why"))).alias("o"), F.count("*").alias("_tries"))
    rows = alerts.join(o, "id", "left")
    tried = F.col("o").isNotNull() & F.col("delivered_at").isNull()
    sent = tried & F.col("o.why").isNull()
    new = {
        "delivered_at": F.when(sent, F.col("o.at")).otherwise(F.col("delivered_at")), "delivery": F.when(sent, F.col("o.how")).otherwise(F.col("delivery")),
        "attempts": F.when(tried, F.col("attempts") + F.col("_tries").cast("int")).otherwise(F.col("attempts")),
        "last_error": F.when(sent, F.lit(None).cast("string")).when(tried, F.substring("o.why", 1, 500)).otherwise(F.col("last_error")),
    }
    return rows.select(*[new[c].alias(c) if c in new else c for c in alerts.columns])


def claim(alerts: DataFrame, limit: int = 10) -> DataFrame:
    """Undelivered alerts, oldest first."""
    return alerts.where("delivered_at is null").orderBy("raised_at", "id").limit(limit)


def delivery_plan(alerts: DataFrame, now: Column, digest_kinds: tuple[str, ...], quiet: tuple[int, int] = (0, 0), zone: str = "UTC") -> DataFrame:
    """Adds ``plan`` to undelivered alerts: digest, held (quiet hours) or direct."""
    plan = F.when(F.col("kind").isin(*digest_kinds), "digest").when(in_quiet_window(now, *quiet, zone), "held").otherwise("direct")
    return alerts.where("delivered_at is null").withColumn("plan", plan)


def outstanding(alerts: DataFrame) -> DataFrame:
    """One row: undelivered alerts, those never tried, failing ones, the oldest."""
    open_ = F.col("delivered_at").isNull()
    return alerts.agg(F.count_if(open_).alias("outstanding"), F.count_if(open_ & (F.col("attempts") == 0)).alias("untried"), F.count_if(open_ & F.col("last_error").isNotNull()).alias("failing"), F.min(F.when(open_, F.col("raised_at"))).alias("oldest"))


def flood_summary(floods: DataFrame) -> DataFrame:
    """Rate limits by method: how many, the longest wait, the last moment."""
    return floods.groupBy("method").agg(F.count("*").alias("floods"), F.max("seconds").alias("longest"), F.max("at").alias("last_at"))


def render(alerts: DataFrame) -> DataFrame:
    """A line of text for each alert (kind, title, link, value, band)."""
    z = F.col("value")
    size = F.when(z < 4, "unusual").when(z < 6, "strong").otherwise("extreme")
    line = F.when(F.col("kind") == "cascade", F.concat_ws(" ", F.lit("carried by"), F.col("value").cast("int").cast("string"), F.lit("families:"), F.coalesce("title", F.lit("?")), "link"))
    return alerts.withColumn("line", line.otherwise(F.concat_ws(" ", size, F.col("kind"), F.format_number(z, 1), F.lit("·"), F.coalesce("title", F.lit("?")), "link")))
