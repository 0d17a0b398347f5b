from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire.functions import timing
from tidewire.operators import queues, records, reports

T0 = datetime(2026, 8, 6, 12)
CHANNEL = "tg_id bigint, username string, title string, is_chat boolean, status string, discovered_via string, resolved_at timestamp, resolve_attempts int, first_seen_at timestamp, linked_to bigint"


def channel(tg_id, username, resolved=None, **more):
    return (tg_id, username, "old", False, "seed", "manual", resolved, 2, T0, None)


def test_import_refreshes_names_and_keeps_the_rest(spark):
    held = spark.createDataFrame([channel(1, None), channel(2, "b", T0), channel(3, "c", T0)], CHANNEL)
    later = T0 + timedelta(days=1)
    batch = spark.createDataFrame([(1, "a", "new", True, later), (2, "bb", "new", True, later), (9, None, "new", True, later), (9, None, "newer", True, later + timedelta(hours=1))], "tg_id bigint, username string, title string, is_chat boolean, at timestamp")
    got = {r["tg_id"]: r for r in records.upsert_channels(held, batch, "import").collect()}
    assert (got[1]["username"], got[1]["resolved_at"], got[1]["is_chat"], got[1]["discovered_via"], got[1]["resolve_attempts"]) == ("a", later, False, "manual", 2)
    assert (got[2]["username"], got[2]["resolved_at"]) == ("bb", T0) and got[3]["title"] == "old"
    assert (got[9]["title"], got[9]["resolved_at"], got[9]["status"], got[9]["is_chat"], got[9]["discovered_via"]) == ("newer", None, "candidate", True, "import")
    assert records.upsert_counts(held, batch).first().asDict() == {"inserted": 1, "updated": 2}
    linked = {r["tg_id"]: r["linked_to"] for r in records.link_chats(held, batch.withColumn("parent", F.col("tg_id") + 100)).collect()}
    assert linked == {1: 101, 2: 102, 3: None, 9: 109}
    fresh = {r["tg_id"]: r for r in records.create_resolved(held, batch, "mention").collect()}
    assert fresh[2]["resolved_at"] == later and fresh[2]["is_chat"] and fresh[3]["resolved_at"] == T0


def test_cursor_never_moves_back(spark):
    held = spark.createDataFrame([(1, "complete", 5, 90, T0, "transient", "old")], "channel_id bigint, status string, oldest_fetched_id bigint, newest_fetched_id bigint, cutoff_at timestamp, failure_kind string, failure_detail string")
    event = lambda *rows: spark.createDataFrame([(c, T0 + timedelta(minutes=i), e, o, n, T0, k, d) for i, (c, e, o, n, k, d) in enumerate(rows)], "channel_id bigint, at timestamp, event string, oldest_id bigint, newest_id bigint, cutoff timestamp, kind string, detail string")
    after = lambda *rows: {r["channel_id"]: r for r in records.record_cursors(held, event(*rows)).collect()}
    assert after((1, "newest", None, 80, None, None))[1]["newest_fetched_id"] == 90
    assert after((1, "newest", None, 95, None, None))[1]["newest_fetched_id"] == 95
    got = after((2, "newest", None, 7, None, None), (1, "start", None, None, None, None))
    assert got[2]["newest_fetched_id"] == 7 and got[2]["status"] is None
    assert (got[1]["status"], got[1]["failure_kind"], got[1]["failure_detail"]) == ("running", None, None)
    assert len(after((1, "failure", None, None, "permanent", "x" * 900))[1]["failure_detail"]) == 500
    done = spark.createDataFrame([("complete", T0), ("complete", T0 + timedelta(days=1)), ("running", T0), (None, None)], "status string, cutoff_at timestamp")
    assert [r[0] for r in done.select(records.completed_to(F.col("status"), F.col("cutoff_at"), F.lit(T0))).collect()] == [True, False, False, False]


def test_truncating_empties_the_derived_tables_alone(spark):
    df = spark.createDataFrame([(1,)], "a int")
    kept = records.truncated({"edges": df, "pending_mentions": df, "raw_messages": df, "channels": df})
    assert {n: t.count() for n, t in kept.items()} == {"edges": 0, "pending_mentions": 0, "raw_messages": 1, "channels": 1}


def test_candidates_keep_decisions_and_lose_stale_evidence(spark, rows):
    stored = spark.createDataFrame([(1, 2, 1.0, 3, "mutual", "confirmed"), (3, 4, 1.0, 3, "mutual", "pending")], "channel_a bigint, channel_b bigint, score double, run_id bigint, about_direction string, decision string")
    found = spark.createDataFrame([(1, 2, 0.4, None), (5, 6, 0.3, "a_to_b")], "channel_a bigint, channel_b bigint, score double, about_direction string")
    assert rows(records.upsert_candidates(stored, found, 7)) == [(1, 2, 0.4, 7, None, "confirmed"), (3, 4, 1.0, 3, "mutual", "pending"), (5, 6, 0.3, 7, "a_to_b", "pending")]


def test_find_channel_names_one(spark):
    df = spark.createDataFrame([(1, "Alpha"), (2, "beta"), (3, "BETA")], "tg_id bigint, username string")
    assert queues.find_channel(df, "@alpha").first()["tg_id"] == 1 and queues.find_channel(df, " 2 ").first()["username"] == "beta"
    with pytest.raises(queues.AmbiguousChannel):
        queues.find_channel(df, "Beta")
    with pytest.raises(queues.ChannelNotFound):
        queues.find_channel(df, "gamma")


def poll(spark, now=0.0, last=None, live=None, rate=None, empty=0, failures=0):
    c = lambda v: F.lit(v).cast("double")
    return spark.range(1).select(timing.next_poll(c(now), c(last), c(live), c(rate), F.lit(empty), F.lit(failures))).first()[0]


def test_next_poll(spark):
    assert poll(spark, live=15.0, failures=3) == 15.0  # backoff does not delay a live post
    assert poll(spark, rate=0.0, empty=4) == 720 * 1.5**4  # a quiet channel is not capped
    assert poll(spark, rate=0.0, failures=4) == 1440.0  # a failing one is
    assert poll(spark, live=1.0, last=-2.0) == 8.0 and poll(spark, now=100.0, live=50.0) == 100.0
    assert poll(spark, rate=1440.0) == 30.0


def test_deliveries(spark):
    alerts = spark.createDataFrame([(1, None, None, 0, None), (2, None, None, 1, "old"), (3, T0, "direct", 1, None)], "id bigint, delivered_at timestamp, delivery string, attempts int, last_error string")
    out = spark.createDataFrame([(1, T0, None, "x" * 600), (1, T0 + timedelta(minutes=1), "digest", None), (2, T0, None, "bad"), (3, T0, None, "late")], "id bigint, at timestamp, delivery string, error string")
    got = {r["id"]: tuple(r)[1:] for r in queues.mark_deliveries(alerts, out).collect()}
    assert got[1] == (T0 + timedelta(minutes=1), "digest", 2, None) and got[2] == (None, None, 2, "bad") and got[3] == (T0, "direct", 1, None)


def test_texts_keep_the_stated_order(spark):
    posts = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "channel_id bigint, msg_id bigint, text string")
    got = reports.texts_of([(1, 2), (9, 9), (1, 1)], posts).orderBy("place").collect()
    assert [r["text"] for r in got] == ["b", None, "a"]


def test_empty_batches_change_nothing(spark, rows):
    held = spark.createDataFrame([channel(1, "a", T0)], CHANNEL)
    batch = spark.createDataFrame([], "tg_id bigint, username string, title string, is_chat boolean, at timestamp")
    assert rows(records.upsert_channels(held, batch, "x")) == rows(held) and rows(records.create_resolved(held, batch, "x")) == rows(held)
