"""What the tables of channels, cursors, candidates and limits become when something is recorded.

Every function maps the stored table and a batch to the new state. Batches may repeat keys: of equal keys the last one by
``at`` counts (of equal moments the greatest row). Columns that a rule does not name stay as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DERIVED = ("edges", "pending_mentions", "pending_mention_sources")
ERROR_LENGTH = 500
EVIDENCE = ("score", "run_id", "about_direction", "shared_token", "shared_token_channels", "handle_token", "handle_token_channels", "out_share", "out_share_edges", "out_share_src", "edges_a_to_b", "edges_b_to_a")


def newest(batch: DataFrame, keys: list[str], by: str = "at") -> DataFrame:
    """One row a key: the last by a moment."""
    rest = [c for c in batch.columns if c not in keys and c != by]
    top = batch.groupBy(*keys).agg(F.max(F.struct(by, *rest)).alias("_row"))
    return top.select(*keys, F.col(f"_row.{by}").alias(by), *[F.col(f"_row.{c}").alias(c) for c in rest])


def merged(stored: DataFrame, batch: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Full join on the keys; ``values`` are the columns that change, in terms of o.* (stored) and n.* (arrived).

    A stored row that meets none stays; a new row takes the named columns and nulls elsewhere.
    """
    arrived = batch.withColumn("_new", F.lit(True)).alias("n")
    held = stored.withColumn("_old", F.lit(True)).alias("o")
    same = reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
    rows = held.join(arrived, same, "full")
    column = lambda c: F.coalesce(f"o.{c}", f"n.{c}") if c in keys else F.when(F.col("n._new"), values[c]).otherwise(F.col(f"o.{c}")) if c in values else F.col(f"o.{c}")
    return rows.select(*[column(c).alias(c) for c in stored.columns])


def upsert_channels(channels: DataFrame, batch: DataFrame, discovered_via: str) -> DataFrame:
    """Import of channels (tg_id, username, title, is_chat, at): new rows whole, known ones get username and title alone.

    A channel imported with a username is resolved; a known one keeps the moment at which it was.
    """
    known = F.col("o._old")
    born = F.when(F.col("n.username").isNotNull(), F.col("n.at"))
    values = {
        "username": F.col("n.username"), "title": F.col("n.title"), "resolved_at": F.coalesce("o.resolved_at", born),
        "is_chat": F.when(known, F.col("o.is_chat")).otherwise(F.col("n.is_chat")), "discovered_via": F.when(known, F.col("o.discovered_via")).otherwise(F.lit(discovered_via)),
        "status": F.when(known, F.col("o.status")).otherwise(F.lit("candidate")), "resolve_attempts": F.when(known, F.col("o.resolve_attempts")).otherwise(F.lit(0)),
        "first_seen_at": F.when(known, F.col("o.first_seen_at")).otherwise(F.col("n.at")),
    }
    return merged(channels, newest(batch, ["tg_id"]), ["tg_id"], {c: v for c, v in values.items() if c in channels.columns})


def upsert_counts(channels: DataFrame, batch: DataFrame) -> DataFrame:
    """One row: how many channels of a batch are new and how many are known."""
    ids = batch.select("tg_id").distinct().join(channels.select("tg_id", F.lit(True).alias("known")).distinct(), "tg_id", "left")
    return ids.agg(F.count_if(F.col("known").isNull()).alias("inserted"), F.count_if("known").alias("updated"))


def link_chats(channels: DataFrame, chats: DataFrame) -> DataFrame:
    """Discussion chats (tg_id, username, title, is_chat, at, parent): created or refreshed, then linked to their channel."""
    refreshed = upsert_channels(channels, chats.drop("parent"), "linked_chat")
    return merged(refreshed, newest(chats.select("tg_id", "at", "parent"), ["tg_id"]), ["tg_id"], {"linked_to": F.col("n.parent")})


def create_resolved(channels: DataFrame, batch: DataFrame, discovered_via: str) -> DataFrame:
    """Channels just resolved by name (tg_id, username, title, is_chat, at): identity and moment are refreshed on known rows too."""
    fresh = upsert_channels(channels, batch, discovered_via)
    return merged(fresh, newest(batch, ["tg_id"]), ["tg_id"], {c: F.col(f"n.{c}") for c in ("username", "title", "is_chat")} | {"resolved_at": F.col("n.at")})


def record_resolution(channels: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Attempts to resolve stored channels (tg_id, at, username, title, is_chat, error): identity on success, one more attempt on failure.

    channels may hold resolve_last_attempt_at and resolve_last_error; an error keeps its first 500 characters.
    """
    o = newest(outcomes, ["tg_id"])
    failed = F.col("n.error").isNotNull()
    values = {
        **{c: F.when(failed, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")) for c in ("username", "title", "is_chat")}, "resolved_at": F.when(failed, F.col("o.resolved_at")).otherwise(F.col("n.at")),
        "resolve_attempts": F.when(failed, F.coalesce("o.resolve_attempts", F.lit(0)) + 1).otherwise(F.col("o.resolve_attempts")),
        "resolve_last_attempt_at": F.col("n.at"), "resolve_last_error": F.when(failed, F.substring("n.error", 1, ERROR_LENGTH)),
    }
    known = o.join(channels.select("tg_id"), "tg_id", "left_semi")
    return merged(channels, known, ["tg_id"], {c: v for c, v in values.items() if c in channels.columns})


def pending_failures(pending: DataFrame, failures: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """Names waiting to be resolved (username, attempts, last_error) after failures (username, at, error); resolved names leave."""
    o = newest(failures, ["username"]).join(pending.select("username"), "username", "left_semi")
    out = merged(pending, o, ["username"], {"attempts": F.col("o.attempts") + 1, "last_error": F.substring("n.error", 1, ERROR_LENGTH)})
    return out if resolved is None else out.join(resolved.select("username").distinct(), "username", "left_anti")


def truncated(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A store whose derived tables, and only those, are empty: what a rebuild starts from."""
    return {name: df.limit(0) if name in DERIVED else df for name, df in tables.items()}


def record_cursors(cursors: DataFrame, events: DataFrame) -> DataFrame:
    """Collection cursors (channel_id, status, oldest_fetched_id, newest_fetched_id, cutoff_at, failure_kind, failure_detail) after events.

    events: channel_id, at, event (start, progress, newest, complete, skip, failure), oldest_id, newest_id, cutoff, kind,
    detail; one event a channel counts. The forward cursor never moves back by ``newest``; a start clears the failure.
    """
    n = lambda c: F.col(f"n.{c}")
    kind = n("event")
    status = F.when(kind.isin("start", "progress"), "running").when(kind == "complete", "complete").when(kind == "skip", "skipped").when(kind == "failure", "failed").otherwise(F.col("o.status"))
    ahead = F.greatest(F.coalesce("o.newest_fetched_id", n("newest_id")), n("newest_id"))
    values = {
        "status": status, "oldest_fetched_id": F.when(kind == "progress", n("oldest_id")).otherwise(F.col("o.oldest_fetched_id")),
        "newest_fetched_id": F.when(kind == "newest", ahead).when((kind == "progress") & n("newest_id").isNotNull(), n("newest_id")).otherwise(F.col("o.newest_fetched_id")),
        "cutoff_at": F.when(kind == "complete", n("cutoff")).otherwise(F.col("o.cutoff_at")),
        "failure_kind": F.when(kind == "failure", n("kind")).when(kind != "start", F.col("o.failure_kind")),
        "failure_detail": F.when(kind.isin("failure", "skip"), F.substring(n("detail"), 1, ERROR_LENGTH)).when(kind != "start", F.col("o.failure_detail")),
    }
    return merged(cursors, newest(events, ["channel_id"]), ["channel_id"], values)


def completed_to(status: Column, cutoff_at: Column, cutoff: Column) -> Column:
    """Whether a collection is complete back to a moment; no cursor is not."""
    return F.coalesce((status == "complete") & (cutoff_at <= cutoff), F.lit(False))


def upsert_candidates(stored: DataFrame, found: DataFrame, run_id: int) -> DataFrame:
    """Candidates after a run: its evidence replaces the old one whole, nulls too; decisions stay; new pairs are pending.

    A run's record is its number in ``run_id``; pairs that the run did not find stay as they were.
    """
    fresh = found.withColumn("run_id", F.lit(run_id).cast("bigint")).withColumn("at", F.lit(0))
    value = lambda c: F.col(f"n.{c}") if c in fresh.columns else F.lit(None)
    values = {c: value(c) for c in EVIDENCE if c in stored.columns} | {"decision": F.coalesce("o.decision", F.lit("pending"))}
    return merged(stored, newest(fresh, ["channel_a", "channel_b"]), ["channel_a", "channel_b"], values)


def record_polls(state: DataFrame, polls: DataFrame) -> DataFrame:
    """Poll state (channel_id, due_at, last_polled_at, posts_per_day, posts_per_day_at, consecutive_empty, consecutive_failures, last_error) after one poll each.

    polls: channel_id, at, due_at, posts_per_day (null keeps the known rate), found_nothing, error. Failures count up and
    leave the empty ones alone; a success resets failures, and posts reset the empty ones.
    """
    failed = F.col("n.error").isNotNull()
    old = lambda c: F.coalesce(f"o.{c}", F.lit(0))
    rated = F.col("n.posts_per_day").isNotNull()
    values = {
        "due_at": F.col("n.due_at"), "last_polled_at": F.col("n.at"), "posts_per_day": F.coalesce("n.posts_per_day", "o.posts_per_day"),
        "posts_per_day_at": F.when(rated | F.col("o._old").isNull(), F.col("n.at")).otherwise(F.col("o.posts_per_day_at")),
        "consecutive_failures": F.when(failed, old("consecutive_failures") + 1).otherwise(0),
        "consecutive_empty": F.when(failed, old("consecutive_empty")).when(F.col("n.found_nothing"), old("consecutive_empty") + 1).otherwise(0), "last_error": F.col("n.error"),
    }
    return merged(state, newest(polls, ["channel_id"]), ["channel_id"], values)


def record_verdicts(stored: DataFrame, given: DataFrame) -> DataFrame:
    """Verdicts (alert_id, verdict, given_at) after new answers (alert_id, verdict, at): the latest answer replaces."""
    return merged(stored, newest(given, ["alert_id"]), ["alert_id"], {"verdict": F.col("n.verdict"), "given_at": F.col("n.at")})


def recent_floods(floods: DataFrame, limit: int = 50, since: Column | None = None) -> DataFrame:
    """Rate limits (method, seconds, at, halted), newest first."""
    rows = floods if since is None else floods.where(F.col("at") >= since)
    return rows.orderBy(F.desc("at"), "method", F.desc("seconds")).limit(limit)


def latest_floods(floods: DataFrame, since: Column | None = None) -> DataFrame:
    """The latest rate limit of each method: method, at, seconds."""
    rows = floods if since is None else floods.where(F.col("at") >= since)
    return rows.groupBy("method").agg(F.max(F.struct("at", "seconds")).alias("f")).select("method", "f.at", "f.seconds")


def encode_payload(row: Column) -> Column:
    """A document as JSON text without its null fields, which parse back to null."""
    return F.to_json(row)
