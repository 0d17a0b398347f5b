from __future__ import annotations

import json
from datetime import datetime, timedelta

from tidewire.operators.cascades import CascadeParams
from tidewire.streaming import alerts, ingest, polling

T0 = datetime(2026, 8, 4, 12)


def raw(spark, path, *items):
    data = [(c, m, json.dumps({"_": kind, "date": "2026-08-04T11:00:00+00:00", "views": v}), at) for c, m, kind, v, at in items]
    spark.createDataFrame(data, ingest.RAW).coalesce(1).write.mode("append").parquet(str(path))


def test_observations_are_appended_once(spark, tmp_path, rows):
    source, table, schema = tmp_path / "raw", str(tmp_path / "table"), "channel_id bigint, msg_id bigint, observed_at timestamp, published_at timestamp, views bigint, forwards bigint, reactions bigint, comments bigint"
    raw(spark, source, (1, 1, "Message", 5, T0), (1, 1, "Message", 5, T0), (1, 2, "MessageService", 1, T0))
    sink = ingest.append_absent(table, ["channel_id", "msg_id", "observed_at"], schema)
    run = lambda at: ingest.run_once(ingest.observations(ingest.raw_stream(spark, str(source), 1)), sink, at)
    run(tmp_path / "c1")
    raw(spark, source, (1, 1, "Message", 9, T0 + timedelta(hours=1)), (1, 1, "Message", 5, T0))
    run(tmp_path / "c1")
    run(tmp_path / "c2")  # a new checkpoint reads everything again
    assert rows(ingest.stored(spark, table, schema), "channel_id", "msg_id", "views") == [(1, 1, 5), (1, 1, 9)]


def test_windowed_readings(spark, tmp_path, rows):
    source = tmp_path / "raw"
    raw(spark, source, (1, 1, "Message", 5, T0), (1, 2, "Message", 8, T0 + timedelta(minutes=10)), (1, 3, "Message", 1, T0 + timedelta(hours=2)))
    stream = ingest.posts_by_window(ingest.observations(ingest.raw_stream(spark, str(source))), "1 hour")
    query = stream.writeStream.outputMode("append").format("memory").queryName("windowed").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    raw(spark, source, (1, 4, "Message", 1, T0 + timedelta(days=3)))
    query.processAllAvailable()
    query.processAllAvailable()
    query.stop()
    got = rows(spark.table("windowed"), "channel_id", "readings", "most_views")
    assert got == [(1, 1, 1), (1, 2, 8)]


def test_bands_by_window(spark, tmp_path, rows):
    source = tmp_path / "raw"
    minutes = lambda m: datetime(2026, 8, 4, 11) + timedelta(minutes=m)
    raw(spark, source, (1, 1, "Message", 5, minutes(12)), (1, 2, "Message", 8, minutes(14)), (1, 3, "Message", 9, minutes(50)), (1, 4, "Message", 1, minutes(-5)))
    stream = ingest.bands_by_window(ingest.observations(ingest.raw_stream(spark, str(source))), "1 day")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("bands").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert rows(spark.table("bands"), "band", "readings", "most_views") == [("10m", 2, 8), ("48m", 1, 9)]


def test_sinks_read_only_the_days_of_their_batch(spark, tmp_path):
    schema = "channel_id bigint, msg_id bigint, observed_at timestamp"
    path, sink = str(tmp_path / "t"), ingest.append_absent(str(tmp_path / "t"), ["channel_id", "msg_id", "observed_at"], schema)
    for day in range(4):
        batch = spark.createDataFrame([(1, 1, T0 + timedelta(days=day)), (1, 2, None)], schema)
        sink(batch, day)
        sink(batch, day)
    assert ingest.stored(spark, path, schema).count() == 5
    near = ingest.stored_near(spark, path, schema, spark.createDataFrame([(T0.date(),)], "day date"))
    assert near.count() == 2 and {r["day"] for r in near.select("day").distinct().collect()} == {T0.date(), datetime(1970, 1, 1).date()}


def test_cascade_alerts_are_raised_once(spark, tmp_path, rows):
    schema = "src_channel_id bigint, dst_channel_id bigint, kind string, msg_id bigint, published_at timestamp, dst_msg_id bigint, dst_published_at timestamp"
    source, edges, out = tmp_path / "in", str(tmp_path / "edges"), str(tmp_path / "alerts")
    families = spark.createDataFrame([], "channel_id bigint, family_key bigint")
    posts = spark.createDataFrame([], "channel_id bigint, msg_id bigint, grouped_id bigint")
    sink = alerts.cascade_sink(edges, schema, out, families, posts, CascadeParams())
    for batch in ([10], [11, 10], [12]):
        spark.createDataFrame([(s, 1, "forward", s, T0 + timedelta(hours=1), 500, T0) for s in batch], schema).coalesce(1).write.mode("append").parquet(str(source))
        ingest.run_once(spark.readStream.schema(schema).parquet(str(source)), sink, tmp_path / "c")
    ingest.run_once(spark.readStream.schema(schema).parquet(str(source)), sink, tmp_path / "again")
    assert rows(ingest.stored(spark, out, alerts.ALERT), "channel_id", "msg_id", "band") == [(1, 500, 2), (1, 500, 3)]


def test_poll_state(spark, tmp_path):
    schema, source = "tg_id bigint, polled_at timestamp, new_posts int, error string", tmp_path / "polls"
    put = lambda *r: spark.createDataFrame(list(r), schema).coalesce(1).write.mode("append").parquet(str(source))
    put((1, T0, 0, None), (1, T0 + timedelta(hours=1), 0, None), (2, T0, 0, "boom"))
    stream = polling.poll_state(spark.readStream.schema(schema).parquet(str(source)))
    query = stream.writeStream.outputMode("update").format("memory").queryName("polls").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    put((2, T0 + timedelta(hours=2), 4, None), (1, T0 + timedelta(hours=2), 1, None))
    query.processAllAvailable()
    query.stop()
    last = {}
    for r in spark.table("polls").collect():
        last[r["tg_id"]] = max(last.get(r["tg_id"], ()), (r["polls"], r["consecutive_empty"], r["consecutive_failures"]))
    assert last == {1: (3, 0, 0), 2: (2, 0, 0)}
