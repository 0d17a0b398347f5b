from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest

from tidewire.operators import cascades, derive, queues, records, signals
from tidewire.sources import store

T0 = datetime(2026, 8, 4, 12)
CHANNEL = "tg_id bigint, username string, title string, is_chat boolean, status string, kind string, reject_reason string, discovered_via string, linked_to bigint, resolved_at timestamp, resolve_attempts int, first_seen_at timestamp"


def channel(tg_id, username=None, status="seed", is_chat=False, linked_to=None):
    return (tg_id, username, f"t{tg_id}", is_chat, status, "personal", None, "manual", linked_to, T0, 0, T0)


def message(channel_id, msg_id, at=T0, **fields):
    doc = {"_": "Message", "id": msg_id, "date": "2026-08-01T00:00:00+00:00", "message": "", "entities": []} | fields
    return (channel_id, msg_id, json.dumps(doc), at)


def fwd(channel_id, post=None):
    return {"_": "MessageFwdHeader", "from_id": {"_": "PeerChannel", "channel_id": channel_id}, "channel_post": post, "date": "2026-07-01T00:00:00+00:00"}


def mention(name):
    return {"message": f"@{name}", "entities": [{"_": "MessageEntityMention", "offset": 0, "length": len(name) + 1}]}


@pytest.fixture
def derived(spark):
    channels = spark.createDataFrame([channel(1, "First_one"), channel(2, "second"), channel(3, "third", status="rejected"), channel(4, "chat", is_chat=True)], CHANNEL)
    raw = [
        message(1, 1, fwd_from=fwd(2, 7), **mention("second")),  # two edges
        message(1, 2, fwd_from=fwd(1, 7)),  # itself
        message(1, 3, fwd_from={"_": "MessageFwdHeader", "from_id": {"_": "PeerUser", "user_id": 5}}),
        message(1, 4, fwd_from={"_": "MessageFwdHeader", "from_name": "hidden"}),
        message(1, 5, fwd_from=fwd(99)),  # discovers 99
        message(2, 1, message="t.me/c/99/3", entities=[{"_": "MessageEntityUrl", "offset": 0, "length": 11}]),
        message(2, 2, message="t.me/c/77", entities=[{"_": "MessageEntityUrl", "offset": 0, "length": 9}]),  # unknown id
        message(2, 3, **mention("nobody_here")),
        message(2, 4, **mention("second")),
        message(1, 6, **mention("nobody_here")),
        message(3, 1, fwd_from=fwd(2, 1)), message(4, 1, fwd_from=fwd(2, 1)),  # not sources
        message(1, 7, date=None, fwd_from=fwd(2, 9)),
        message(1, 8, at=T0 + timedelta(days=1), fwd_from=fwd(2, 5)), message(1, 8, at=T0, fwd_from=fwd(2, 4)),  # first fetch wins
        (5, 1, None, T0), (1, 9, "{broken", T0),
    ]
    df = spark.createDataFrame(raw, "channel_id bigint, msg_id bigint, payload string, fetched_at timestamp")
    return derive.derive(df, channels), channels


def test_derive(derived, rows):
    out, channels = derived
    assert rows(out.edges, *derive.KEY) == [
        (1, 1, "forward", 2, 7), (1, 1, "mention", 2, None), (1, 5, "forward", 99, None), (1, 8, "forward", 2, 4), (2, 1, "mention", 99, 3),
    ]
    assert rows(out.discovered) == [(99, "forward")]
    assert rows(derive.pending_queue(out.pending, channels)) == [("nobody_here", 2)]
    assert rows(derive.pending_queue(out.pending, channels, 3)) == []


def test_second_derivation_adds_nothing(derived, spark, rows):
    out, _ = derived
    assert derive.missing_edges(out.edges, out.edges.withColumnRenamed("grouped_id", "grouped_id").selectExpr("*", "published_at as derived_at")).count() == 0


def test_null_keys_are_equal_in_stores(spark, rows):
    kind = "a bigint, b bigint, v int"
    table = spark.createDataFrame([(1, None, 1), (2, 2, 1)], kind)
    batch = spark.createDataFrame([(1, None, 2), (2, None, 3), (2, None, 4), (None, None, 5)], kind)
    assert rows(store.absent(batch, table, ["a", "b"], ["v"])) == [(2, None, 3), (None, None, 5)]
    assert rows(store.latest(table, batch, ["a", "b"], ["v"])) == [(1, None, 2), (2, 2, 1), (2, None, 4), (None, None, 5)]
    fresh = store.refresh(table, batch.where("v <> 4"), ["a", "b"], fresh=["v"], keep=[])
    assert rows(fresh) == [(1, None, 2), (2, 2, 1), (2, None, 3), (None, None, 5)]


def test_unfinished_runs_are_invisible(spark, rows):
    runs = spark.createDataFrame([(1, T0), (2, None), (3, T0 - timedelta(days=1))], "id int, completed_at timestamp")
    assert rows(store.completed_run(runs), "id") == [(1,)]


EDGE = "src_channel_id bigint, dst_channel_id bigint, kind string, msg_id bigint, published_at timestamp, dst_msg_id bigint, dst_published_at timestamp"
POST = "channel_id bigint, msg_id bigint, grouped_id bigint"


def test_cascade_rules(spark, rows):
    at = lambda h: T0 + timedelta(hours=h)
    repost = lambda src, h, msg=500: (src, 1, "forward", 1, at(h), msg, T0)
    data = [repost(10, 1), repost(11, 2), repost(12, 6), repost(13, 6.01), repost(14, -1), repost(15, 1), repost(10, 2, 501), (16, 1, "mention", 1, at(1), 500, T0), (17, 1, "forward", 1, at(1), None, T0)]
    families = spark.createDataFrame([(10, 10), (11, 10), (15, 1), (1, 1)], "channel_id bigint, family_key bigint")
    posts = spark.createDataFrame([(1, 500, 3), (1, 501, 3), (1, 502, None), (2, 501, 3)], POST)
    found = cascades.reposts(spark.createDataFrame(data, EDGE), families, posts)
    # 10 and 11 are one family, 12 lies on the edge of the window, 15 is the post's own family; both album parts are one post
    assert rows(cascades.crossings(found)) == [(1, 500, 2, 2)]
    raised = spark.createDataFrame([(1, 500, 2)], "channel_id bigint, msg_id bigint, band int")
    assert rows(cascades.crossings(found, raised=raised)) == []
    assert rows(cascades.cited(found, 1), "channel_id", "msg_id", "families", "sources") == [(1, 500, 4, 5)]
    with pytest.raises(ValueError):
        cascades.CascadeParams(bands=())


def test_signals(spark, rows):
    channels = spark.createDataFrame([channel(1, "gonzo_main"), channel(2, "gonzo_talk"), channel(3, "other_talk"), channel(4, "some_talk"), channel(5, "tg_1red2"), channel(6, "1red2_pod", linked_to=5)], CHANNEL)
    about = spark.createDataFrame([(1, "see @gonzo_talk and @nobody_x"), (2, "by t.me/gonzo_main"), (3, "@gonzo_main"), (5, "blog @1red2"), (6, None)], "channel_id bigint, about string")
    names = derive.usernames(channels)
    targets, outside = signals.description_targets(about, names, channels)
    assert rows(signals.about_signal(targets)) == [(1, 2, 1.0, "mutual"), (1, 3, 0.5, "b_to_a")]
    assert {r["username"] for r in outside.collect()} == {"nobody_x"}
    t = signals.Thresholds(max_token_channels=2)
    assert rows(signals.token_signal(channels, t), "channel_a", "channel_b", "shared_token") == [(1, 2, "gonzo"), (5, 6, "1red2")]
    signed = signals.signed_tokens(channels, about, 4)
    assert rows(signals.handle_signal(channels, signed, t), "channel_a", "channel_b", "handle_token") == [(5, 6, "1red2")]
    counts = spark.createDataFrame([(1, 2, 20), (1, 3, 5), (2, 1, 6), (4, 1, 3)], "src bigint, dst bigint, n bigint")
    assert rows(signals.share_signal(counts, t), "channel_a", "channel_b", "out_share", "out_share_src") == [(1, 2, 0.8, 1)]
    assert rows(signals.mutual_signal(counts, t)) == [(1, 2, 0.6, 20, 6)]
    found = signals.detect(channels, about, spark.createDataFrame([], EDGE), spark.createDataFrame([], "channel_id bigint, family_key bigint"), t)
    # 5 and 6 are a channel and its chat; a signed token is not read twice
    assert rows(found, "channel_a", "channel_b", "score") == [(1, 2, 1.3), (1, 3, 0.5)]
    kept = signals.keep_decisions(spark.createDataFrame([(1, 2, "rejected"), (8, 9, "confirmed")], "channel_a bigint, channel_b bigint, decision string"), found)
    assert rows(kept, "channel_a", "channel_b", "decision") == [(1, 2, "rejected"), (1, 3, "pending"), (8, 9, "confirmed")]
    with pytest.raises(ValueError):
        signals.Thresholds(max_share_min=1.5)


def test_queues(spark, rows):
    from pyspark.sql import functions as F

    now = F.lit(T0)
    channels = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "tg_id bigint")
    state = spark.createDataFrame([(1, T0 - timedelta(hours=1)), (2, T0 + timedelta(hours=1)), (3, T0 - timedelta(hours=9))], "tg_id bigint, due_at timestamp")
    assert [r["tg_id"] for r in queues.due(channels, state, now).collect()] == [4, 3, 1]
    assert tuple(queues.lag(channels, state, now).select("overdue", "tracked").first()) == (3, 3)
    assert [r["due_at"] for r in queues.postpone(state, F.lit(T0)).orderBy("tg_id").collect()] == [T0, T0 + timedelta(hours=1), T0]
    polled = spark.createDataFrame([(1, 2, 0, None, 1.5), (2, 0, 3, "old", 1.5)], "channel_id bigint, consecutive_empty int, consecutive_failures int, last_error string, posts_per_day double").withColumns({c: F.lit(None).cast("timestamp") for c in ("due_at", "last_polled_at", "posts_per_day_at")})
    polls = spark.createDataFrame([(1, T0, T0, None, False, "boom"), (2, T0, T0, 4.0, True, None), (3, T0, T0, None, False, None)], "channel_id bigint, at timestamp, due_at timestamp, posts_per_day double, found_nothing boolean, error string")
    got = {r["channel_id"]: (r["consecutive_empty"], r["consecutive_failures"], r["last_error"], r["posts_per_day"]) for r in records.record_polls(polled, polls).collect()}
    assert got == {1: (2, 1, "boom", 1.5), 2: (1, 0, None, 4.0), 3: (0, 0, None, None)}
    with pytest.raises(ValueError):
        queues.mark(spark.createDataFrame([(1, "seed", None, None)], "tg_id bigint, status string, kind string, reject_reason string"), spark.createDataFrame([(1, "rejected", None, None)], "tg_id bigint, status string, kind string, reason string"))
    pairs = queues.all_pairs(spark.createDataFrame([("f", 3), ("f", 1), ("f", 2), ("f", 2)], "group string, tg_id bigint"))
    assert rows(pairs) == [(1, 2), (1, 3), (2, 3)]
    stored = spark.createDataFrame([(1, 2, "rejected"), (5, 6, "pending")], "channel_a bigint, channel_b bigint, decision string")
    assert rows(queues.decide(stored, pairs, "confirmed")) == [(1, 2, "confirmed"), (1, 3, "confirmed"), (2, 3, "confirmed"), (5, 6, "pending")]
    alerts = spark.createDataFrame([(1, "cascade", 1, 1, 2, T0, None, 0, None), (2, "views", 1, 2, 1, T0 - timedelta(hours=1), None, 2, "x"), (3, "views", 1, 3, 1, T0, T0, 1, None)], "id int, kind string, channel_id int, msg_id int, band int, raised_at timestamp, delivered_at timestamp, attempts int, last_error string")
    assert [r["id"] for r in queues.claim(alerts).collect()] == [2, 1]
    assert tuple(queues.outstanding(alerts).first())[:3] == (2, 1, 1)
    assert rows(queues.delivery_plan(alerts, now, ("views",), (11, 13)), "id", "plan") == [(1, "held"), (2, "digest")]
    again = queues.raise_alerts(alerts.select("kind", "channel_id", "msg_id", "band"), alerts)
    assert again.count() == 0
