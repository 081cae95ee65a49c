"""Units, steps and buckets."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit -> (dimension, factor).
UNITS = {
    "ml": ("volume_ml", 1.0), "毫升": ("volume_ml", 1.0), "l": ("volume_ml", 1000.0), "升": ("volume_ml", 1000.0),
    "g": ("mass_g", 1.0), "克": ("mass_g", 1.0), "kg": ("mass_g", 1000.0), "千克": ("mass_g", 1000.0), "公斤": ("mass_g", 1000.0),
    "mm": ("length_mm", 1.0), "毫米": ("length_mm", 1.0), "cm": ("length_mm", 10.0), "厘米": ("length_mm", 10.0), "m": ("length_mm", 1000.0), "米": ("length_mm", 1000.0),
}
#: First step, last step, cost of each.
STEP_COSTS = ((16, 20, 0.01), (21, 25, 0.02), (26, 30, 0.03), (31, 35, 0.04), (36, 40, 0.05), (41, 45, 0.06))


def _lookup(key: Column, table: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])[key]


def to_base(value: Column, unit: Column) -> Column:
    """NUM1: struct (dimension, amount in the base unit); null for unknown units."""
    u = F.lower(F.trim(unit))
    return F.struct(_lookup(u, {k: d for k, (d, _) in UNITS.items()}).alias("dimension"), (value * _lookup(u, {k: f for k, (_, f) in UNITS.items()})).alias("amount"))


def measurements(text: Column) -> Column:
    """NUM3: array of (dimension, amount) of every number with a unit."""
    names = "|".join(sorted(UNITS, key=lambda u: -len(u)))
    pattern = F.lit(f"([0-9]+(?:\\.[0-9]+)?)\\s*({names})(?![a-z])")
    low = F.lower(text)
    pairs = F.arrays_zip(F.regexp_extract_all(low, pattern, F.lit(1)).alias("n"), F.regexp_extract_all(low, pattern, F.lit(2)).alias("u"))
    return F.transform(pairs, lambda p: to_base(p["n"].cast("double"), p["u"]))


def satisfies(value: Column, operator: str, low: Column, high: Column | None = None, tolerance: float = 0.0) -> Column:
    """NUM2 / NUM5: eq, min, max or range, with a relative tolerance."""
    slack = F.abs(low) * tolerance
    if operator == "eq":
        return F.abs(value - low) <= slack
    if operator == "min":
        return value >= low - slack
    if operator == "max":
        return value <= low + slack
    return (value >= low - slack) & (value <= high + F.abs(high) * tolerance)


def step_penalty(steps: Column, costs: tuple = STEP_COSTS) -> Column:
    """NUM15: cumulative, not positive, to ten places."""
    n = F.greatest(F.lit(0), steps)
    total = F.lit(0.0)
    for first, last, rate in costs:
        total = total + F.greatest(F.lit(0), F.least(n, F.lit(last)) - (first - 1)) * F.lit(rate)
    return F.round(-total, 10)


def difficulty_bucket(score: Column) -> Column:
    """NUM19."""
    return F.when(score < 10, "lt10").when(score < 15, "10_15").when(score < 18, "15_18").otherwise("ge18")


def rank_bucket(rank: Column) -> Column:
    """RET14: below 1 is an error; null or above 150 is missing."""
    return (
        F.when(rank.isNull() | (rank > 150), "missing")
        .when(rank < 1, F.raise_error(F.lit("rank below 1")).cast("string"))
        .when(rank == 1, "rank1").when(rank <= 5, "2_5").when(rank <= 20, "6_20").otherwise("21_150")
    )


def length_bucket(steps: Column) -> Column:
    """X19."""
    return F.when(steps <= 10, "short").when(steps <= 20, "medium").otherwise("long")


def around(value: Column) -> Column:
    """NUM8: struct (low, high), a fifth either way."""
    return F.struct(F.greatest(F.lit(0.0), value - value * 0.2).alias("low"), (value + value * 0.2).alias("high"))
