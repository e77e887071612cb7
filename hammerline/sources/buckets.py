"""Tables that are upserted in part: rows lie in buckets of their keys, and a manifest names each bucket's folder.

A batch writes new folders for the buckets that it touches and then one new
manifest, by a rename, which makes it visible at once or not at all.  A reader
takes the newest manifest; folders that neither it nor the one before names are
removed with the next batch.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hammerline.sources.tables import latest_per_key, upsert


class Folder:
    """A folder in any store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self._path, self._jvm = path, spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self._path}/{name}" if name else self._path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        return [x.getPath().getName() for x in self._fs.listStatus(self._at(name))] if self.exists(name) else []

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """The whole file under its name, or none."""
        out = self._fs.create(self._at(f".{name}.tmp"), True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(self._at(f".{name}.tmp"), self._at(name)):
            raise RuntimeError(f"{name} could not be put into {self._path}")


_PREFIX = "manifest-"


def _manifests(folder: Folder) -> list[int]:
    return sorted(int(n.removeprefix(_PREFIX)) for n in folder.names() if n.startswith(_PREFIX))


def _manifest(folder: Folder, version: int) -> dict:
    try:
        return json.loads(folder.read(f"{_PREFIX}{version:09d}"))
    except ValueError as e:
        raise ValueError(f"manifest {version} is damaged") from e


def _newest(folder: Folder) -> dict | None:
    """The newest manifest; None for a table that does not exist.  Data without a manifest of its own, beside none at all, is no table yet either."""
    versions = _manifests(folder)
    return _manifest(folder, versions[-1]) if versions else None


def _read(spark: SparkSession, path: str, manifest: dict, schema: str, buckets: list[int] | None = None) -> DataFrame:
    wanted = [f"{path}/v={v}/_bucket={b}" for b, v in manifest["buckets"].items() if buckets is None or int(b) in buckets]
    folder = Folder(spark, path)
    lost = [w for w in wanted if not folder.exists(w.removeprefix(f"{path}/"))]
    if lost:
        raise ValueError(f"the table in {path} is damaged: {len(lost)} of its folders are gone, {lost[0]} first")
    return spark.read.schema(schema).parquet(*wanted) if wanted else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the newest manifest; an absent table is empty, a damaged one raises."""
    manifest = _newest(Folder(spark, path))
    return spark.createDataFrame([], schema) if manifest is None else _read(spark, path, manifest, schema)


def _bucket(keys: list[str], n: int) -> Column:
    return F.pmod(F.hash(*keys), F.lit(n)).alias("_bucket")


def upsert_table(batch: DataFrame, path: str, schema: str, keys: list[str], order: list[str], epoch: int, buckets: int = 64) -> list[int]:
    """S5 on files: the batch's last row of each key replaces the table's; the buckets that were written.

    An epoch that is already in the manifest is not applied again; one that was
    cut off writes its folders anew.  The number of buckets is the table's own
    from its first batch on.
    """
    spark, folder = batch.sparkSession, Folder(batch.sparkSession, path)
    before = _newest(folder)
    if before and before["epoch"] >= epoch:
        return []
    n, version = (before["count"], before["version"] + 1) if before else (buckets, 0)
    rows = latest_per_key(batch, keys, order).persist()
    try:
        touched = [r["_bucket"] for r in rows.select(_bucket(keys, n)).distinct().collect()]  # at most n numbers
        held = before["buckets"] if before else {}
        old = _read(spark, path, {"buckets": held}, schema, touched) if before else spark.createDataFrame([], schema)
        whole = upsert(old, rows, keys, order).withColumn("_bucket", _bucket(keys, n))
        whole.repartition(max(1, len(touched)), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/v={version}")
    finally:
        rows.unpersist()
    now = {"version": version, "epoch": epoch, "count": n, "buckets": {**held, **{str(b): version for b in touched}}}
    folder.publish(f"{_PREFIX}{version:09d}", json.dumps(now))
    _clean(folder, now, before)
    return sorted(touched)


def _clean(folder: Folder, *manifests: dict | None) -> None:
    """Removes what neither of the manifests names."""
    named = {(v, int(b)) for m in manifests if m for b, v in m["buckets"].items()}
    versions = {v for v, _ in named}
    for name in folder.names():
        if name.startswith("v="):
            v = int(name[2:])
            gone = [x for x in folder.names(name) if x.startswith("_bucket=") and (v, int(x.removeprefix("_bucket="))) not in named]
            for x in [f"{name}/{x}" for x in gone] if v in versions else [name]:
                folder.remove(x)
    kept = {m["version"] for m in manifests if m}
    for v in _manifests(folder):
        if v not in kept:
            folder.remove(f"{_PREFIX}{v:09d}")
