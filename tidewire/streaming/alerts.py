"""Cascade alerts from a stream of edges: each batch re-evaluates the posts it touches over the stored days of those posts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators import cascades, queues
from tidewire.sources import store
from tidewire.streaming.ingest import day_of, stored, stored_near

ALERT = "kind string, channel_id bigint, msg_id bigint, band int, value bigint"


def cascade_sink(edges_path: str, edge_schema: str, alerts_path: str, families: DataFrame, posts: DataFrame, params: cascades.CascadeParams) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: append the batch's new edges, count families of the touched posts, append new alerts.

    Edges are laid out by the day of the post they refer to (of mentions, by their own), so a batch reads only the days of
    the posts it touches. An alert is keyed by (kind, channel, post, band), so neither a repeated batch nor a further
    repost raises it twice; a batch that broke between its two writes runs again and raises what it still owes, as the posts
    of all its edges are re-evaluated, stored before or not.
    """
    keys = ["src_channel_id", "msg_id", "kind", "dst_channel_id", "dst_msg_id", "day"]

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_at", F.coalesce("dst_published_at", "published_at")).withColumn("day", day_of("_at")).drop("_at").persist()
        try:
            store.absent(rows, stored_near(spark, edges_path, edge_schema, rows), keys).write.mode("append").partitionBy("day").parquet(edges_path)
            forwards = rows.where("kind = 'forward'")
            near = stored_near(spark, edges_path, edge_schema, forwards).join(forwards.select("dst_channel_id").distinct(), "dst_channel_id", "left_semi")
            found = cascades.crossings(cascades.reposts(near, families, posts), params)
            alerts = found.select(F.lit("cascade").alias("kind"), "channel_id", "msg_id", "band", F.col("families").alias("value"))
            queues.raise_alerts(alerts, stored(spark, alerts_path, ALERT)).write.mode("append").parquet(alerts_path)
        finally:
            rows.unpersist()

    return write
