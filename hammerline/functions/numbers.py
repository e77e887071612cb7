"""Numeric and array column expressions; nulls pass through unless stated."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Damage labels that photos cannot show.
NON_VISUAL = [
    "BIOHAZARD", "DAMAGE HISTORY", "ELECTRICAL", "ENGINE DAMAGE", "FRAME DAMAGE", "MECHANICAL", "MISSING/ALTERED VIN", "NORMAL WEAR & TEAR", "CASH FOR CLUNKERS",
    "REPOSSESSION", "SUSPENSION", "THEFT", "MINOR", "TRANSMISSION DAMAGE", "UNKNOWN", "WATER/FLOOD", "REPLACED VIN", "UNDERCARRIAGE",
]
# Edges of the price classes.
PRICE_EDGES = [100, 2000, 5000, 10000, 20000, 40000, 80000, 100001]


def number(c: Column) -> Column:
    """A text as a finite double; anything else is null."""
    n = F.when(~F.coalesce(c.cast("string"), F.lit("")).rlike("[dDfF]\\s*$"), c.cast("string").try_cast("double"))
    return finite(n)


def finite(c: Column) -> Column:
    """NaN and infinities to null."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def real_mileage(c: Column) -> Column:
    """The placeholder 1 is no mileage."""
    return F.nullif(c, F.lit(1.0))


def in_usd(price: Column, currency: Column, rate: float = 0.73) -> Column:
    """Canadian prices at a fixed rate; other and unknown currencies as they are."""
    return F.when(currency.eqNullSafe("CAD"), price * F.lit(rate)).otherwise(price)


def clip(c: Column, lo: float, hi: float) -> Column:
    """Bounded on both sides; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(c, F.lit(hi))))


def blend(linear: Column, log: Column, w_linear: float = 0.4, w_log: float = 0.6, lo: float = 0.0, hi: float = 100_000.0) -> Column:
    """Weighted mean of two predictions, clipped; the weights must sum to 1."""
    if abs(w_linear + w_log - 1) > 1e-9:
        raise ValueError("the weights must sum to 1")
    return clip(linear * F.lit(w_linear) + log * F.lit(w_log), lo, hi)


def price_class(c: Column, edges: list[int] = PRICE_EDGES) -> Column:
    """The half-open price class as text, "nan" outside."""
    out = F.lit("nan")
    for a, b in zip(edges, edges[1:], strict=False):
        out = F.when((c >= a) & (c < b), f"[{a}, {b})").otherwise(out)
    return out


def softened(p: Column, temperature: float) -> Column:
    """Probabilities to the power 1/T, summing to 1 again; an all-zero vector stays."""
    if temperature <= 0:
        raise ValueError("the temperature must be positive")
    return scaled(F.transform(p, lambda x: F.pow(x, F.lit(1 / temperature))))


def scaled(p: Column) -> Column:
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return F.transform(p, lambda x: F.when(total > 0, x / total).otherwise(x))


def entropy(p: Column) -> Column:
    """The routing entropy of a probability vector."""
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - x * F.log(x + F.lit(1e-12)))


def top_k(p: Column, k: int) -> Column:
    """T5: the k largest entries (the first of equal ones), the rest zero, scaled to sum 1."""
    ranked = F.array_sort(F.transform(p, lambda x, i: F.struct((-x).alias("v"), i.alias("i"))))
    kept = F.transform(F.slice(ranked, 1, k), lambda r: r["i"])
    return scaled(F.transform(p, lambda x, i: F.when(F.array_contains(kept, i), x).otherwise(F.lit(0.0))))


def first_max(p: Column) -> Column:
    """The 0-based position of the largest entry, the first of equal ones."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def repaired_severity(damage: Column, severity: Column) -> Column:
    """Null to 0; damage that photos cannot show has at least 1 where there is no positive severity."""
    label = F.upper(F.trim(F.coalesce(damage, F.lit("UNKNOWN"))))
    return F.when(label.isin(NON_VISUAL) & (severity.isNull() | (severity <= 0)), F.lit(1.0)).otherwise(F.coalesce(severity, F.lit(0.0)))


def ramp(c: Column, lo: float, hi: float) -> Column:
    """0 up to lo, 1 from hi, linear between; a step at lo when the ends meet."""
    if hi <= lo:
        return F.when(c >= lo, 1.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c - F.lit(lo)) / F.lit(hi - lo)))


def saturated(c: Column, k: float) -> Column:
    """X / (x + k) of the non-negative part."""
    x = F.greatest(c, F.lit(0.0))
    return x / (x + F.lit(k))


def half_steps(c: Column) -> Column:
    """To the nearest half, ties to even."""
    return F.rint(c * 2) / 2


def photo_list(c: Column) -> Column:
    """JS2: a JSON (or single-quoted) list of texts, trimmed, without blanks; anything else is an empty list."""
    items = F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")


def json_field(c: Column, name: str, kind: str = "string") -> Column:
    """JS1: one field of a JSON object; null where the text is none or has no such field of that type."""
    return F.from_json(c, f"`{name}` {kind}")[name]
