"""Reading and writing tables: declared schemas, column checks, appends, upserts and bundles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Declared schemas (all columns nullable) of the tables that jobs exchange.
SCHEMAS = {
    "list_pages": "page int, status string, worker string, error string, updated_at timestamp",
    "detail_tasks": "detail_url string, vin string, status string, worker string, error string, updated_at timestamp",
    "listings": "sold_price double, currency string, make string, model string, fuel_type string, transmission string, drive_type string, primary_damage string, secondary_damage string, seller_type string, color string, mileage double, engine_volume double, cylinders double, year double",
    "severity": "vin string, auction string, damage_primary_severity double, damage_secondary_severity double",
    "errors": "vin string, stage string, error string, url string",
    "titles": "title string",
}


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """A CSV with a declared schema; nothing is inferred, so no extra pass is made."""
    return spark.read.schema(schema).option("header", header).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """S3: overwrite with a header."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def fixed_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """Exactly these fields as text, absent ones and nulls as empty strings, others dropped."""
    return df.select([F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) if f in df.columns else F.lit("").alias(f) for f in fields])


def append_fixed(df: DataFrame, path: str, fields: list[str]) -> None:
    """Append those fields to a Parquet folder."""
    fixed_fields(df, fields).write.mode("append").parquet(path)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the given total order; aggregated before the shuffle, so hot keys stay cheap."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Incoming rows replace existing ones of their key; among incoming rows of a key the last stays."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest_per_key(both, keys, ["_new", *order]).drop("_new")


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Incoming rows whose key is new, the first of each key."""
    rest = [c for c in incoming.columns if c not in keys]
    first = incoming.groupBy(*keys).agg(F.min_by(F.struct(*rest, F.lit(0).alias("_")), F.struct(*order)).alias("_row"))
    first = first.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*incoming.columns)
    return first.join(existing.select(*keys).distinct(), keys, "left_anti")


def with_lineage(df: DataFrame, name: str = "raw_json") -> DataFrame:
    """The whole row as JSON beside its columns."""
    return df.withColumn(name, F.to_json(F.struct(*df.columns)))


def split_results(df: DataFrame, is_error) -> tuple[DataFrame, DataFrame]:
    """The good and the failed rows of one result; null conditions count as good."""
    bad = F.coalesce(is_error, F.lit(False))
    return df.where(~bad), df.where(bad)


def require_columns(df: DataFrame, names: list[str], either: list[tuple[str, str]] = ()) -> DataFrame:
    """Raises unless all names are there; of each pair one must be, and gets the first's name."""
    missing = [n for n in names if n not in df.columns]
    missing += ["/".join(p) for p in either if not set(p) & set(df.columns)]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return reduce(lambda d, p: d if p[0] in d.columns else d.withColumnRenamed(p[1], p[0]), either, df)


def numbered(df: DataFrame, start: int, order: list[str], name: str = "id") -> DataFrame:
    """Ids from start on in the given order, without sorting in one task.

    Rows are range-partitioned by the order; each partition counts its own rows,
    and the partitions' offsets (a row for each) are added.
    """
    parts = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    from hammerline.sources.fix import fixed

    parts = fixed(parts)
    offsets = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = offsets.select("_p", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return parts.join(F.broadcast(offsets), "_p").withColumn(name, (F.col("_before") + own + F.lit(start - 1)).cast("long")).drop("_p", "_before")


def next_id(df: DataFrame, name: str = "id") -> int:
    """The largest id plus one, 1 for an empty table."""
    return int(df.agg(F.max(name)).first()[0] or 0) + 1


def first_rows(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows in the given order."""
    return df.orderBy(*order).limit(n)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet folder, or an empty table of that schema where there is no such folder.

    A folder that a writer has not finished, or whose files cannot be read, raises.
    """
    from hammerline.sources.buckets import Folder

    folder = Folder(spark, path)
    if not folder.exists():
        return spark.createDataFrame([], schema)
    if not (folder.exists("_SUCCESS") or folder.exists("_spark_metadata")):
        raise ValueError(f"{path} is no finished table: it has neither _SUCCESS nor a stream's log")
    return spark.read.schema(schema).parquet(path)
