"""All queries of the listings engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hammerline.plans import catalog

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings cleaned and filtered, with the price median of their make, model and year from the other folds."""
    return catalog.QUERIES["a3_oof_group_median"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.ORACLES)
