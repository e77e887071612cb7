"""Preparing listings: cleaning, filters, fitted statistics and leakage-free price features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType

from hammerline.functions import numbers as N, text as X
from hammerline.operators.quantiles import counted, exact_quantiles
from hammerline.sources import tables as T
from hammerline.sources.fix import fixed

# The columns of a listing that are texts and numbers, and what a model is given.
CATEGORIES = ["make", "model", "fuel_type", "transmission", "drive_type", "primary_damage", "secondary_damage", "seller_type", "color"]
NUMBERS = ["sold_price", "mileage", "year", "engine_volume", "cylinders"]
FEATURES = ["make", "model", "fuel_type", "transmission", "drive_type", "primary_damage", "color", "mileage", "year", "engine_volume", "cylinders", "primary_damage_severity", "secondary_damage_severity", "make_model_year_price_median"]
KEYS = ["make", "model", "year"]
#: How often a value must occur to be kept as it is.
KEEP_AT_LEAST = {"make": 100, "model": 20, "color": 100}
#: Keep tables and median tables are broadcast up to this many rows.
BROADCAST_ROWS = 1_000_000


def with_missing(df: DataFrame, defaults: dict) -> DataFrame:
    """Absent columns with their default."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def _double(df: DataFrame, name: str) -> Column:
    """The column as finite doubles; only texts need to be parsed."""
    return N.number(F.col(name)) if isinstance(df.schema[name].dataType, StringType) else N.finite(F.col(name).cast("double"))


def rowwise(df: DataFrame, rate: float = 0.73) -> DataFrame:
    """M3: categories cleaned, numbers coerced, sentinels to null, prices in USD and their currency relabelled."""
    df = with_missing(df, {c: None for c in [*CATEGORIES, *NUMBERS, "currency", "primary_damage_severity", "secondary_damage_severity"]})
    out = {c: X.clean_category(F.col(c).cast("string")) for c in [*CATEGORIES, "currency"]} | {c: _double(df, c) for c in NUMBERS}
    # The code of a currency has no inner white space, so its price needs no collapsing of it.
    out["sold_price"] = N.in_usd(out["sold_price"], F.upper(F.btrim(F.col("currency").cast("string"), F.lit(X.WHITE_SPACE))), rate)
    df = df.withColumns(out)
    return df.withColumns({"mileage": N.real_mileage(F.col("mileage")), "currency": F.when(F.col("currency") == "CAD", "USD").otherwise(F.col("currency"))})


def plausible_year(c: Column) -> Column:
    """P4."""
    return c.isNotNull() & c.between(1980, 2026)


def plausible_mileage(c: Column) -> Column:
    """P5."""
    return c.isNotNull() & c.between(0, 400_000)


def price_between(c: Column, lo: float, hi) -> Column:
    """P3."""
    return c.between(F.lit(lo), hi if isinstance(hi, Column) else F.lit(hi))


def not_canadian(c: Column) -> Column:
    """Unknown currencies stay."""
    return ~c.eqNullSafe("CAD")


@dataclass
class PrepStats:
    """M4: a one-row table of numbers and a long table (column, value) of values to keep."""

    numbers: DataFrame
    keep: DataFrame


def fit(train: DataFrame, keep_at_least: dict[str, int] = KEEP_AT_LEAST) -> PrepStats:
    """M4: statistics of cleaned training rows: A4, A5 and A6 from one count over all columns, made once."""
    rows = train.where(F.col("sold_price").isNotNull() & plausible_year(F.col("year")) & plausible_mileage(F.col("mileage")) & (F.col("sold_price") >= 1000))
    # The quantile of each number, and what stands in for it where there is none.
    wanted = {"sold_price": (0.995, 100_000.0, "upper_price_quantile"), "engine_volume": (0.5, 2.0, "engine_volume_median"), "cylinders": (0.5, 4.0, "cylinders_median")}
    # One pass counts the numbers' values and the texts: each row is a struct of (column, q, number) or (column, least, text).
    part = lambda c, **own: F.struct(F.lit(c).alias("column"), *[own.get(k, F.lit(None)).cast(t).alias(k) for k, t in (("q", "double"), ("number", "double"), ("least", "long"), ("text", "string"))])
    parts = [part(c, q=F.lit(q), number=F.col(c)) for c, (q, _, _) in wanted.items()] + [part(c, least=F.lit(n), text=F.col(c)) for c, n in keep_at_least.items()]
    counts = fixed(rows.select(F.explode(F.array(*parts)).alias("x")).select("x.*").groupBy("column", "q", "number", "least", "text").count())
    found = exact_quantiles(counts.where("q IS NOT NULL"), ["column", "q"], "number", F.col("q"), {"median": F.col("count")})
    numbers = found.agg(*[F.coalesce(F.max(F.when(F.col("column") == c, F.col("median"))), F.lit(default)).alias(name) for c, (_, default, name) in wanted.items()])
    keep = counts.where("count >= least").select("column", F.col("text").alias("value"))
    return PrepStats(fixed(numbers), fixed(keep))


def checked_broadcast(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table, made once and marked for broadcast where it has at most so many rows; the count stops there."""
    table = fixed(table)
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def rare_to_other(df: DataFrame, keep: DataFrame, *columns: str) -> DataFrame:
    """Values that are not in the keep table (column, value) become OTHER; the table's bound is checked once for all columns."""
    keep = keep.where(F.col("column").isin(*columns))
    small = (keep := fixed(keep)).limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    for column in columns:
        own = keep.where(F.col("column") == column).select(F.col("value").alias("_kept"))
        df = df.join(F.broadcast(own) if small else own, F.col(column).eqNullSafe(F.col("_kept")), "left")
        df = df.withColumn(column, F.when(F.col("_kept").isNull(), "OTHER").otherwise(F.col(column))).drop("_kept")
    return df


def apply(df: DataFrame, stats: PrepStats, training: bool) -> DataFrame:
    """M5: filters, imputed numbers, repaired severities, zeros for electric cars, rare values to OTHER."""
    df = df.where(plausible_year(F.col("year")) & plausible_mileage(F.col("mileage"))).crossJoin(F.broadcast(stats.numbers))
    if training:
        df = df.where(price_between(F.col("sold_price"), 1000, F.col("upper_price_quantile")))
    electric = F.col("fuel_type").isin("ELECTRIC", "OTHER")
    df = df.withColumns(
        {c: F.when(electric, F.lit(0.0)).otherwise(F.coalesce(F.col(c), F.col(f"{c}_median"))) for c in ("engine_volume", "cylinders")}
        | {f"{k}_damage_severity": N.repaired_severity(F.col(f"{k}_damage"), F.col(f"{k}_damage_severity").cast("double")) for k in ("primary", "secondary")}
    ).drop("upper_price_quantile", "engine_volume_median", "cylinders_median")
    return rare_to_other(df, stats.keep, *KEEP_AT_LEAST)


def with_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are neither null nor NaN, by conditions that the optimizer can tell from the columns' own rules."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
        if isinstance(df.schema[k].dataType, (DoubleType, FloatType)):
            df = df.where(~F.isnan(k))
    return df


def group_median(df: DataFrame, keys: list[str] = KEYS, target: str = "sold_price") -> DataFrame:
    """A1: exact median per key; rows with a null key are left out."""
    return exact_quantiles(with_keys(df, keys), keys, target)


def overall_median(df: DataFrame, target: str = "sold_price") -> DataFrame:
    """A2: the exact median of all rows, as a one-row table with `median`."""
    return exact_quantiles(df, [], target)


def upper_quantile(df: DataFrame, column: str, q: float = 0.995, default: float | None = None) -> DataFrame:
    """A4, A5: an exact quantile of all rows, as a one-row table with `q`; the default where no row has a value."""
    found = exact_quantiles(df, [], column, q, name="q")
    return found if default is None else found.select(F.coalesce("q", F.lit(default)).alias("q"))


def with_group_median(df: DataFrame, medians: DataFrame, overall: DataFrame, keys: list[str] = KEYS, name: str = "make_model_year_price_median") -> DataFrame:
    """The key's median, for unseen keys the overall one (a one-row table with `median`)."""
    found = df.join(checked_broadcast(medians.select(*keys, F.col("median").alias("_m"))), keys, "left")
    return found.crossJoin(F.broadcast(overall.select(F.col("median").alias("_all")))).withColumn(name, F.coalesce("_m", "_all")).drop("_m", "_all").select(*df.columns, name)


def oof_group_median(df: DataFrame, fold: Column, k: int, keys: list[str] = KEYS, target: str = "sold_price", name: str = "make_model_year_price_median") -> DataFrame:
    """A3: per row the median of its key over the rows of the other folds, else those rows' overall median.

    A key's values are counted and sorted once for all folds: for each fold the
    ranks count the rows of the others.
    """
    rows = df.withColumn("_fold", fold)
    return _out_of_fold(rows, counted(rows, [*keys, "_fold"], target), k, keys, target, name).select(*df.columns, name)


def _out_of_fold(rows: DataFrame, taught: DataFrame, k: int, keys: list[str], target: str, name: str) -> DataFrame:
    """A3 for rows with a `_fold`, from the counted values of their keys and folds."""
    others = {f"_m{i}": F.when(F.col("_fold") != i, F.col("_n")).otherwise(0) for i in range(k)}
    by_fold = lambda kind: F.array(*others).alias(kind)
    own = exact_quantiles(with_keys(taught, keys), keys, target, weights=others).select(*keys, by_fold("_own"))
    overall = exact_quantiles(taught, [], target, weights=others).select(by_fold("_all"))
    out = rows.join(checked_broadcast(own), keys, "left").crossJoin(F.broadcast(overall))
    at = lambda kind: F.get(F.col(kind), F.col("_fold"))
    return out.withColumn(name, F.coalesce(at("_own"), at("_all")))


def feature_columns(df: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """The feature columns alone, in their order; an absent one is an error."""
    return T.require_columns(df, columns).select(*columns)


def scoring_rows(df: DataFrame, stats: PrepStats, medians: DataFrame, overall: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """M7: raw listings prepared for scoring with saved statistics only: cleaned, filtered by year and mileage, the saved median of
    their key, null categories UNKNOWN, numbers finite or null."""
    rows = with_group_median(apply(rowwise(df), stats, training=False), medians, overall)
    texts = {c: F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN")) for c in CATEGORIES}
    return feature_columns(rows.withColumns(texts | {c: _double(rows, c) for c in columns if c not in CATEGORIES}), columns)


def with_parsed_title(df: DataFrame, column: str = "title", prefix: str = "") -> DataFrame:
    """The row with year, make, model and rest of its title; steps are columns, so that each pattern is matched once."""
    made: dict[str, Column] = {}
    out = df
    for name, step in X.title_steps(F.col(column)):
        out = out.withColumn(f"_title_{name}", step(made))
        made[name] = F.col(f"_title_{name}")
    kept = {f"{prefix}{n}": made[n] for n in ("year", "make", "model", "rest")}
    return out.select(*[c for c in df.columns if c not in kept], *[v.alias(n) for n, v in kept.items()])


def listing_detail_severity(listings: DataFrame, details: DataFrame, severity: DataFrame, details_order: list[str], severity_order: list[str]) -> DataFrame:
    """Listings beside the last detail of their detail_url and the last severity of their vin, in the orders given.

    Of columns on both sides the listing's stays; damage_*_severity becomes *_damage_severity. Null keys find nothing.
    """
    lone = T.latest_per_key(details.where("detail_url IS NOT NULL"), ["detail_url"], details_order)
    lone = lone.drop(*[c for c in lone.columns if c in listings.columns and c != "detail_url"])
    out = listings.join(lone, "detail_url", "left")
    last = T.latest_per_key(severity.where("vin IS NOT NULL"), ["vin"], severity_order)
    for k in ("primary", "secondary"):
        last = last.withColumnRenamed(f"damage_{k}_severity", f"{k}_damage_severity")
    return out.join(last.drop(*[c for c in last.columns if c in out.columns and c != "vin"]), "vin", "left")


def bucket(key: str, n: int, seed: int | str = 42) -> Column:
    """A number below n (at most 2**32) by the MD5 of `seed:key`, as other engines have it too; a null key counts as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % n


def hash_split(df: DataFrame, key: str, percent: int = 20, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """M1: train and test by a hash of the key: the same under any partitioning."""
    test = bucket(key, 100, seed) < percent
    return df.where(~test), df.where(test)


def stratified_split(df: DataFrame, cls: str, key: str, percent: int = 20, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """M2: as hash_split, with the same share of each class: its test rows are those up to the exact quantile of their hashes."""
    rows = df.withColumn("_h", bucket(key, 1 << 30, seed))
    limit = checked_broadcast(exact_quantiles(rows, [cls], "_h", percent / 100, name="_limit").withColumnRenamed(cls, "_cls"))
    rows = rows.join(limit, F.col(cls).eqNullSafe(F.col("_cls"))).withColumn("_test", F.col("_h") <= F.col("_limit")).drop("_h", "_limit", "_cls")
    return rows.where("not _test").drop("_test"), rows.where("_test").drop("_test")


def winsorised(df: DataFrame, column: str, q: float = 0.995) -> DataFrame:
    """Clipped at an exact upper quantile; rows are kept."""
    top = upper_quantile(df, column, q).withColumnRenamed("q", "_top")
    return df.crossJoin(F.broadcast(top)).withColumn(column, F.when(F.col(column).isNotNull(), F.least(column, "_top"))).drop("_top")


def features(train: DataFrame, test: DataFrame, key: str, k: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """M6: out-of-fold medians for training rows, full medians for test rows; all come from one count of the training rows."""
    rows = train.withColumn("_fold", bucket(key, k, f"fold:{seed}").cast("int"))
    taught, name = counted(rows, [*KEYS, "_fold"], "sold_price"), "make_model_year_price_median"
    times = {"median": F.col("_n")}
    medians, overall = exact_quantiles(with_keys(taught, KEYS), KEYS, "sold_price", weights=times), exact_quantiles(taught, [], "sold_price", weights=times)
    return _out_of_fold(rows, taught, k, KEYS, "sold_price", name).select(*train.columns, name), with_group_median(test, medians, overall, name=name)
