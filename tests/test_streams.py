"""Streams give what the batch operators give, and a second run adds nothing."""

from hammerline.sources.tables import latest_per_key
from hammerline.streaming import jobs

SF = "/root/testdata/sf0.001"


def events(spark, tmp_path, files=1):
    rows = spark.read.parquet(f"{SF}/events.parquet")
    folder = str(tmp_path / "in")
    rows.repartition(3).write.mode("overwrite").parquet(folder)
    return rows, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


def test_upsert_stream(spark, tmp_path):
    # One batch holds all files: across batches the one that arrives last wins, whatever its time.
    rows, stream = events(spark, tmp_path, 9)
    out, schema = str(tmp_path / "out"), "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    for _ in range(2):
        jobs.upsert_into(stream, out, schema, ["user_id"], ["ts", "event_id"], str(tmp_path / "c")).awaitTermination()
    got = jobs.latest_version(spark, out, schema).select(*rows.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, latest_per_key(rows, ["user_id"], ["ts", "event_id"]).collect()))


def test_append_once(spark, tmp_path):
    rows, stream = events(spark, tmp_path)
    out = str(tmp_path / "out")
    for _ in range(2):
        jobs.append_once(jobs.unseen(stream, "event_id"), out, str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(out).count() == rows.count()


def test_rate_stream(spark, tmp_path):
    rows, stream = events(spark, tmp_path)
    q = jobs.per_minute(stream, "ts").writeStream.format("memory").queryName("rate").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("rate").collect())) == sorted(map(tuple, jobs.per_minute(rows, "ts").collect()))
