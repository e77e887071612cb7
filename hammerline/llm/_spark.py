"""Session helpers: where lineage is cut, and how tables become task-sized."""

from __future__ import annotations

import gc
import tempfile
import time

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

#: Bytes of a small table that a task reads at least, if that leaves every core a task.
TASK_BYTES = 8 << 20
#: Rows and bytes of a batch that goes to a Python worker: a worker holds two of them beside its own tables.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where none is configured, one is made, but only for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="spark-")


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder; the plan starts anew from those files."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def cut_to_tasks(df: DataFrame) -> DataFrame:
    """As cut, but what was written in many small parts is read in as few tasks as its size asks for, one per core at least.

    A task costs events, a log line and files of its shuffle, however few rows it has.  Sizes are told by what was
    written; parts are put together as they lie, so this is not for tables whose parts mean something.  Columns are
    numbers, binaries or strings.
    """
    seen = Observation()
    long = [f.name for f in df.schema if f.dataType.typeName() in ("binary", "string")]
    size = sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in long), F.lit(8 * len(df.columns)).cast("long"))
    out = cut(df.observe(seen, F.sum(size).alias("bytes")))
    return out.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-(seen.get["bytes"] or 0) // TASK_BYTES)))


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files that no table needs any more.

    It removes them when the driver's garbage is collected, which a driver with
    little work does seldom (spark.cleaner.periodicGC.interval: half an hour).
    The events of the last queries hold their plans until they are told, so it
    is done once more a moment later.
    """
    for wait in (0.3, 0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(wait)


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows; from here on the session hands them to Python in batches of bounded size."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def most_frequent(counts: DataFrame, most: int, key: str = "word", value: str = "n") -> tuple[int, np.ndarray, np.ndarray]:
    """The least count from which on there are at most so many keys; those keys, sorted, and their values."""
    sizes = counts.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count(F.lit(1)).alias("k")).collect()
    least, held = 100_001, 0
    for r in sorted(sizes, key=lambda r: -r["n"]):
        held += r["k"]
        if held > most:
            break
        least = r["n"]
    got = counts.where(F.col("n") >= least).select(key, value).toArrow() if sizes else None
    found = got.column(key).to_numpy().view(np.uint64) if got else np.empty(0, np.uint64)
    o = np.argsort(found)
    return least, found[o], got.column(value).to_numpy()[o] if got else np.empty(0, np.int64)


def contracted(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table as (node, comp), comp the smallest node reachable; that node itself has no row.

    Alternates large-star and small-star contractions until all links go straight
    to the smallest node, so the number of rounds grows with the logarithm of the
    longest path; every round is a pre-aggregated min per node and the links are
    cut to storage, never collected.  The edges are read once.
    """
    e = cut_to_tasks(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while not _stars(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: every larger neighbour of u links to the least of u's neighbourhood.
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours link to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_to_tasks(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """As contracted, with a row for each component's smallest node too."""
    e = contracted(edges, a, b)
    return e.union(e.select(F.col("comp").alias("node"), "comp").distinct())


def _stars(e: DataFrame) -> bool:
    """Whether each node of the distinct links (u, v), v < u, either has one link, to a smaller node, or only larger neighbours: then v is the least of its component."""
    end = lambda node, up: F.struct(F.col(node).alias("node"), F.lit(up).alias("up"))
    ends = e.select(F.explode(F.array(end("u", 1), end("v", 0))).alias("x")).groupBy("x.node").agg(F.sum("x.up").alias("up"), F.count(F.lit(1)).alias("n"))
    return ends.where("up > 1 or up = 1 and n > 1").isEmpty()
