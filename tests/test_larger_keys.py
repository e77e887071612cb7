"""Queries against their SQL where the small tables don't reach: repeated URLs, runtimes of 100 hours and more."""

import duckdb
from pyspark.sql import functions as F

from hammerline import registry
from hammerline.functions import text as X


def agree(spark, folder, name, table):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    want = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = [tuple(r) for r in registry.queries()[name](spark, str(folder)).select(*names).collect()]
    assert sorted(got) == sorted(want.fetchall())
    return got


def test_tasks_of_repeated_urls(spark, tmp_path):
    rows = [(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "c"), (6, "d"), (10, "e"), (8, "e")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r[1] for r in agree(spark, tmp_path, "f2_new_tasks", "pages")} == {"1", "2", "4", "5", "10", "8"}
    assert {r[:2] for r in agree(spark, tmp_path, "f2_new_tasks_by_url", "pages")} == {("a", "1"), ("c", "5"), ("e", "10")}


def test_runtimes_from_100_hours_on(spark, tmp_path):
    spark.createDataFrame([(k,) for k in (0, 8, 600, 51428, 51429)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    # Of 100 hours and 3 seconds the SQL's field of two characters has the first two.
    assert dict(agree(spark, tmp_path, "x24_runtime", "part"))[51429] == "10:00:03"
    assert dict(agree(spark, tmp_path, "x24_runtime_whole", "part"))[600] == "601:10:00"
    assert spark.range(1).select(X.runtime(F.lit(360003))).first()[0] == "100:00:03"
