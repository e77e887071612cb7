"""Tables of work: what is to be fetched, its state and how fast it moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hammerline.sources.tables import insert_absent, latest_per_key

STATUSES = ["pending", "in_progress", "done", "failed"]


def seeded(spark: SparkSession, existing: DataFrame, pages: int) -> DataFrame:
    """pending rows for the pages 1..n that are not there yet."""
    new = spark.range(1, pages + 1).select(F.col("id").cast("int").alias("page"), F.lit("pending").alias("status"))
    return new.join(existing.select("page").distinct(), "page", "left_anti")


def new_tasks(tasks: DataFrame, rows: DataFrame, keys: list[str] = ["detail_url"]) -> DataFrame:
    """pending tasks for list rows with a URL that has none; with more keys, for those whose keys have none."""
    found = rows.where(F.coalesce("detail_url", F.lit("")) != "").select("detail_url", "vin", F.lit("pending").alias("status"))
    return insert_absent(tasks, found, keys, ["vin"])


def state(events: DataFrame, key: str, order: list[str], label: str = "label", retryable: tuple[str, ...] = ("rate_limited", "challenge", "auth")) -> DataFrame:
    """the status of each task after its last event; failures that may pass are pending again."""
    last = latest_per_key(events.select(key, label, *order), [key], order)
    status = F.when(F.col(label).isin("queued"), "pending").when(F.col(label) == "started", "in_progress").when(F.col(label) == "valid", "done").when(F.col(label).isin(*retryable), "pending").otherwise("failed")
    return last.select(key, status.alias("status"))


def backlog(df: DataFrame, table: str = "tbl", status: str = "status") -> DataFrame:
    """Counts by table and status, zero where there are none."""
    return df.groupBy(table).pivot(status, STATUSES).count().na.fill(0)


def oldest_pending(df: DataFrame, order: list[str], n: int = 1) -> DataFrame:
    """T4: the n pending rows that come first."""
    return df.where("status = 'pending'").orderBy(*order).limit(n)


def seconds(ts: str) -> Column:
    """A timestamp, with or without a zone, as seconds."""
    return F.col(ts).cast("timestamp").cast("double")


def throughput(snapshots: DataFrame, by: list[str], ts: str = "ts", done: str = "done", ties: list[str] = ()) -> DataFrame:
    """Done per minute between successive snapshots; null for the first. Snapshots of one time are in the order of `ties`."""
    w = Window.partitionBy(*by).orderBy(ts, *ties)
    passed = F.greatest(F.lit(1.0), seconds(ts) - F.lag(seconds(ts)).over(w))
    return snapshots.withColumn("per_minute", (F.col(done) - F.lag(done).over(w)) * 60.0 / passed)


def unprocessed(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done; null keys stay."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def stamped(df: DataFrame, now: Column, name: str = "updated_at") -> DataFrame:
    """DT1: a timestamp that the caller passes, so that a run can be repeated."""
    return df.withColumn(name, now)
