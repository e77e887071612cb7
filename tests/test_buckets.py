"""Upserts by bucket: what is written, runs again, and damage."""

import glob
import os
import shutil

import pytest

from hammerline.sources import buckets as B
from hammerline.sources.tables import read_or_empty
from hammerline.streaming import jobs

SCHEMA = "k long, t int, v string"


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def table(spark, path):
    return sorted(map(tuple, B.read_table(spark, path, SCHEMA).collect()))


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/v=*/_bucket=*/*.parquet")}


def test_upserts_write_their_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    assert table(spark, path) == []
    first = [(k, 1, "a") for k in range(2000)]
    assert len(B.upsert_table(batch(spark, first), path, SCHEMA, ["k"], ["t"], 0, buckets=16)) == 16
    before = files(path)
    second = [(5, 1, "old"), (5, 2, "b"), (5, 2, "b"), (70, 3, "b"), (9999, 1, "new")]
    touched = B.upsert_table(batch(spark, second), path, SCHEMA, ["k"], ["t"], 1)
    assert 1 <= len(touched) <= 3
    after = files(path)
    new = set(after) - set(before)
    assert {int(f.split("_bucket=")[1].split("/")[0]) for f in new} == set(touched)
    want = {k: (k, t, v) for k, t, v in first} | {5: (5, 2, "b"), 70: (70, 3, "b"), 9999: (9999, 1, "new")}
    assert table(spark, path) == sorted(want.values())
    # The same epoch again adds nothing; an overlapping batch replaces, whatever its times.
    assert B.upsert_table(batch(spark, [(5, 9, "again")]), path, SCHEMA, ["k"], ["t"], 1) == []
    assert table(spark, path) == sorted(want.values())
    B.upsert_table(batch(spark, [(5, 0, "c"), (71, 1, "c")]), path, SCHEMA, ["k"], ["t"], 2)
    want |= {5: (5, 0, "c"), 71: (71, 1, "c")}
    assert table(spark, path) == sorted(want.values())
    # Files that the last two manifests don't name are gone.
    held = len(files(path))
    for e in range(3, 7):
        B.upsert_table(batch(spark, [(5, e, "d")]), path, SCHEMA, ["k"], ["t"], e)
    assert len(files(path)) <= held + 2 and len(glob.glob(f"{path}/manifest-*")) == 2


def test_a_batch_that_was_cut_off(spark, tmp_path):
    path = str(tmp_path / "t")
    B.upsert_table(batch(spark, [(1, 1, "a"), (2, 1, "a")]), path, SCHEMA, ["k"], ["t"], 0, buckets=4)
    # Folders without their manifest, as a lost driver leaves them.
    batch(spark, [(1, 1, "half")]).write.parquet(f"{path}/v=1/_bucket=0")
    assert table(spark, path) == [(1, 1, "a"), (2, 1, "a")]
    B.upsert_table(batch(spark, [(2, 2, "b")]), path, SCHEMA, ["k"], ["t"], 1)
    assert table(spark, path) == [(1, 1, "a"), (2, 2, "b")]


def test_damage_raises(spark, tmp_path):
    path = str(tmp_path / "t")
    B.upsert_table(batch(spark, [(k, 1, "a") for k in range(50)]), path, SCHEMA, ["k"], ["t"], 0, buckets=4)
    lost = glob.glob(f"{path}/v=0/_bucket=*")[0]
    shutil.move(lost, str(tmp_path / "away"))
    with pytest.raises(ValueError, match="damaged"):
        B.read_table(spark, path, SCHEMA)
    with pytest.raises(ValueError, match="damaged"):
        B.upsert_table(batch(spark, [(k, 2, "b") for k in range(50)]), path, SCHEMA, ["k"], ["t"], 1)
    shutil.move(str(tmp_path / "away"), lost)
    assert len(table(spark, path)) == 50
    (tmp_path / "t" / "manifest-000000000").write_text('{"version": 0, "epo')
    (tmp_path / "t" / ".manifest-000000000.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="damaged"):
        B.read_table(spark, path, SCHEMA)


def test_read_or_empty(spark, tmp_path):
    path = str(tmp_path / "p")
    assert read_or_empty(spark, path, SCHEMA).count() == 0
    batch(spark, [(1, 1, "a")]).write.parquet(path)
    assert read_or_empty(spark, path, SCHEMA).count() == 1
    (tmp_path / "p" / "_SUCCESS").unlink()
    with pytest.raises(ValueError, match="finished"):
        read_or_empty(spark, path, SCHEMA)
    (tmp_path / "p" / "_SUCCESS").touch()
    for f in glob.glob(f"{path}/*.parquet"):
        open(f, "wb").write(b"no parquet")
    for f in glob.glob(f"{path}/.*.crc"):
        os.unlink(f)
    with pytest.raises(Exception, match=r"(?i)parquet"):
        read_or_empty(spark, path, SCHEMA).collect()


def test_streamed_batches_overlap(spark, tmp_path):
    path, source = str(tmp_path / "out"), str(tmp_path / "in")
    for e, rows in enumerate([[(1, 1, "a"), (2, 1, "a")], [(2, 2, "b"), (3, 1, "b")]]):
        batch(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        for _ in range(2):
            jobs.upsert_into(stream, path, SCHEMA, ["k"], ["t"], str(tmp_path / "c"), 8).awaitTermination()
        assert len(table(spark, path)) == 2 + e
    assert table(spark, path) == [(1, 1, "a"), (2, 2, "b"), (3, 1, "b")]
