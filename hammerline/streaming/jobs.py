"""Incremental jobs as structured streams; each is restartable from its checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from hammerline.sources.buckets import read_table, upsert_table


def unseen(stream: DataFrame, key: str, ts: str | None = None, late: str = "1 day") -> DataFrame:
    """ST1: each record id once; with an event time, ids are forgotten after the lateness, so state stays bounded."""
    if ts:
        return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


def per_minute(stream: DataFrame, ts: str = "ts", late: str = "10 minutes", by: list[str] = ()) -> DataFrame:
    """ST4: rows per minute of event time."""
    kind = dict(stream.dtypes)[ts]
    # A watermark needs a timestamp with a zone; the minute comes back in the column's own type.
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if stream.isStreaming else stream
    counted = rows.groupBy(F.window(ts, "1 minute").alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").cast(kind).alias("minute"), *by, "n")


def upsert_into(stream: DataFrame, path: str, schema: str, keys: list[str], order: list[str], checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """ST2, ST3: each micro-batch replaces the rows of its keys; a batch that is run again gives the same table.

    Only the buckets that hold a batch's keys are written, and a new manifest
    makes them the table's, so a reader never sees a half-written one.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        upsert_table(batch, path, schema, keys, order, epoch, buckets)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_version(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest version of an upserted table, empty before the first batch; a damaged one raises."""
    return read_table(spark, path, schema)


def append_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """ST1, ST3: what is new since the last run, appended exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
