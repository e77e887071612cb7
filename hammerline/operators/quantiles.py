"""Exact quantiles of groups of any size, without a buffer of a group's values.

Values are counted first, so that equal ones are one row from the tasks that
read them on.  Groups of up to GROUP_ROWS different values are sorted by a
window, which spills.  Larger ones, of which there are few, are selected from in
parallel: their values are dealt out by range, and only the partitions in which
a wanted rank lies are searched.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from hammerline.sources.fix import fixed

#: Different values of a group that one window sorts; larger groups are selected from in parallel.
GROUP_ROWS = 500_000


def _picked(rows: DataFrame, sorted_by: list[str], keys: list[str], weights: list[str], q: Column, total, before) -> DataFrame:
    """Per key and weight the values at both ranks around the quantile (null where the rank lies in no row given), and the position."""
    order = Window.partitionBy(*sorted_by).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = {f"_upto_{w}": before(w) + F.sum(w).over(order) for w in weights} | {f"_at_{w}": (total(w) - 1) * q for w in weights}
    rows = rows.withColumns(steps)
    picks = []
    for w in weights:
        holds = lambda rank, w=w: (F.col(f"_upto_{w}") - F.col(w) <= rank) & (rank < F.col(f"_upto_{w}"))
        at = F.col(f"_at_{w}")
        picks += [F.max(at).alias(f"_at_{w}"), F.max(F.when(holds(F.floor(at)), F.col("_v"))).alias(f"_low_{w}"), F.max(F.when(holds(F.ceil(at)), F.col("_v"))).alias(f"_high_{w}")]
    return rows.groupBy(*keys).agg(*picks)


def _between(found: DataFrame, keys: list[str], weights: list[str]) -> DataFrame:
    def value(w: str) -> Column:
        at, low, high = F.col(f"_at_{w}"), F.col(f"_low_{w}"), F.col(f"_high_{w}")
        return F.when(F.floor(at) == F.ceil(at), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return found.select(*keys, *[value(w).alias(w) for w in weights])


def _large(rows: DataFrame, keys: list[str], weights: list[str], q: Column) -> DataFrame:
    """Selection for groups that are too large for one task: by counts of distinct values in ranges."""
    counts = fixed(rows.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()))
    sums = counts.groupBy(*keys, "_part").agg(*[F.sum(w).alias(w) for w in weights])
    # One row for each key and range, so a key has at most as many as there are partitions.
    upto = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    of_key = Window.partitionBy(*keys)
    sums = sums.withColumns({f"_before_{w}": F.coalesce(F.sum(w).over(upto), F.lit(0)) for w in weights} | {f"_total_{w}": F.sum(w).over(of_key) for w in weights})
    wanted = F.lit(False)
    for w in weights:
        at = (F.col(f"_total_{w}") - 1) * q
        wanted |= (F.col(f"_before_{w}") <= F.ceil(at)) & (F.floor(at) < F.col(f"_before_{w}") + F.col(w))
    hit = fixed(sums.where(wanted).drop(*weights).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_in"), *[f"_{x}_{w}" for w in weights for x in ("before", "total")]))
    same = F.col("_part") == F.col("_in")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    found = _picked(counts.join(F.broadcast(hit), same), [*keys, "_part"], keys, weights, q, lambda w: F.col(f"_total_{w}"), lambda w: F.col(f"_before_{w}"))
    return _between(found, keys, weights)


def counted(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The different values of each key with their number `_n`, written once: with it as a weight, all quantiles of these rows come from them."""
    return fixed(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, q: float | Column = 0.5, weights: Mapping[str, Column] | None = None, name: str = "median") -> DataFrame:
    """One row per key with the exact, linearly interpolated quantile of `value`; without keys one row.

    `weights` gives several quantiles of the same rows, each with a row taken as
    often as its column says: with 0 and 1, a leave-one-fold-out median needs no
    copies of the rows.
    q may depend on the keys.  Null values are left out, a null key is a key of its
    own, and of a group without values the quantile is null or the group absent.
    The table is read once; the counts of its values are written.
    """
    chosen = {w: c.cast("long") for w, c in (weights or {name: F.lit(1)}).items()}
    q = F.lit(q) if not isinstance(q, Column) else q
    own = keys or ["_all"]
    rows = df.where(F.col(value).isNotNull()).select(*([*keys] if keys else [F.lit(0).alias("_all")]), F.col(value).cast("double").alias("_v"), *[c.alias(w) for w, c in chosen.items()])
    rows, names = fixed(rows.groupBy(*own, "_v").agg(*[F.sum(w).alias(w) for w in chosen])), list(chosen)
    # Few groups can have so many values: at most one for each GROUP_ROWS rows.
    large = fixed(rows.groupBy(*own).count().where(F.col("count") > GROUP_ROWS).select(*[F.col(k).alias(f"_k_{k}") for k in own]))
    whole = Window.partitionBy(*own)
    total = lambda w: F.sum(w).over(whole)
    if large.isEmpty():
        out = _between(_picked(rows, own, own, names, q, total, lambda w: F.lit(0)), own, names)
    else:
        same = F.lit(True)
        for k in own:
            same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        small = _between(_picked(rows.join(F.broadcast(large), same, "left_anti"), own, own, names, q, total, lambda w: F.lit(0)), own, names)
        out = small.unionByName(_large(rows.join(F.broadcast(large), same, "left_semi"), own, names, q))
    if keys:
        return out
    # A table without values has a quantile too, null.
    return out.agg(*[F.max(w).alias(w) for w in names])
