"""Streams of raw messages: observations without repeats, idempotent appends, windowed counts."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.payload import counters, moment, parse
from tidewire.functions.timing import BAND_EDGES, age_minutes, band_of
from tidewire.sources import store

RAW = "channel_id bigint, msg_id bigint, payload string, fetched_at timestamp"


def raw_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of raw messages; ``files_per_trigger`` holds the batches back."""
    reader = spark.readStream.schema(RAW)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def observations(raw: DataFrame, late: str = "1 day") -> DataFrame:
    """Counters of each fetch of a post; a repeat of the same reading is dropped while the watermark holds it."""
    rows = raw.withColumn("p", parse()).where("p._ = 'Message'").withColumn("published_at", moment(F.col("p.date")))
    out = rows.select("channel_id", "msg_id", F.col("fetched_at").cast("timestamp").alias("observed_at"), "published_at", *counters())
    return out.withWatermark("observed_at", late).dropDuplicatesWithinWatermark(["channel_id", "msg_id", "observed_at"])


def posts_by_window(observed: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Readings and views of each channel by event-time window; the stream carries its watermark."""
    window = F.window("observed_at", size, slide) if slide else F.window("observed_at", size)
    return observed.groupBy(window, "channel_id").agg(F.count("*").alias("readings"), F.max("views").alias("most_views"))


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at a path, empty while nothing was written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def day_of(column: str) -> Column:
    """The day by which a table is laid out; rows without a moment share one of their own."""
    return F.coalesce(F.to_date(F.col(column).cast("timestamp")), F.lit("1970-01-01").cast("date"))


def stored_near(spark: SparkSession, path: str, schema: str, batch: DataFrame, days: int = 0) -> DataFrame:
    """The rows of a table laid out by ``day`` from ``days`` before the batch's first day to its last: a bounded look back.

    Only the folders of those days are read, however much is stored. batch: has the column day.
    """
    first, last = batch.agg(F.min("day"), F.max("day")).first()
    table = stored(spark, path, f"{schema}, day date")
    if first is None:
        return table.limit(0)
    return table.where(F.col("day").between(F.date_sub(F.lit(first), days), F.lit(last)) | (F.col("day") == F.lit("1970-01-01").cast("date")))


def append_absent(path: str, keys: list[str], schema: str, prepare: Callable[[DataFrame], DataFrame] | None = None, moment_column: str = "observed_at") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that appends only rows whose key the table lacks, so a batch that runs again adds nothing.

    The table is laid out by the day of ``moment_column``, which must be one of the keys or follow from them; only the days
    of the batch are read to look for its keys.
    """

    def write(batch: DataFrame, _: int) -> None:
        rows = (prepare(batch) if prepare else batch).withColumn("day", day_of(moment_column)).persist()
        try:
            store.absent(rows, stored_near(batch.sparkSession, path, schema, rows), [*keys, "day"]).write.mode("append").partitionBy("day").parquet(path)
        finally:
            rows.unpersist()

    return write


def with_bands(observed: DataFrame, edges: tuple[int, ...] = BAND_EDGES) -> DataFrame:
    """Readings of a stream with age in minutes and age band; readings from before publication are left out."""
    return observed.withColumn("age", age_minutes("observed_at", "published_at")).where("age >= 0").withColumn("band", band_of(F.col("age"), edges))


def bands_by_window(observed: DataFrame, size: str = "1 hour", edges: tuple[int, ...] = BAND_EDGES) -> DataFrame:
    """Readings and most views of each age band by event-time window."""
    return with_bands(observed, edges).groupBy(F.window("observed_at", size), "band").agg(F.count("*").alias("readings"), F.max("views").alias("most_views"))


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str | Path, mode: str = "append") -> None:
    """Process all that is there and stop: the form of a scheduled pass."""
    stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()
