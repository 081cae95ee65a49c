"""Run summaries, strata, comparisons and pivots.  Missing tasks count as failures where a rate has
a fixed denominator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouping_sets(df: DataFrame, sets: list[str], aggs: list[Column]) -> DataFrame:
    """AG2 / AG4: one row per value of each single column: (dimension, value, aggregates)."""
    exploded = df.withColumn("__d", F.explode(F.array(*[F.struct(F.lit(s).alias("dimension"), F.col(s).cast("string").alias("value")) for s in sets])))
    return exploded.filter("__d.value is not null").groupBy(F.col("__d.dimension").alias("dimension"), F.col("__d.value").alias("value")).agg(*aggs)


def fixed_rate(expected: DataFrame, results: DataFrame, key: str, success: str) -> DataFrame:
    """AG1 / AG3: one row: expected, completed, successes, and the rate over what was expected."""
    rows = expected.select(key).distinct().join(results, key, "left")
    return rows.agg(F.count(F.lit(1)).alias("expected"), F.count(success).alias("completed"), F.count(F.when(F.col(success), 1)).alias("successes")).withColumn("rate", F.col("successes") / F.greatest("expected", F.lit(1)))


def transitions(left: DataFrame, right: DataFrame, key: str, kind: str) -> DataFrame:
    """AG13: (from, to, n) over the tasks of either run; no row is ``missing``."""
    both = left.select(key, F.col(kind).alias("from")).join(right.select(key, F.col(kind).alias("to")), key, "full_outer")
    return both.groupBy(F.coalesce("from", F.lit("missing")).alias("from_kind"), F.coalesce("to", F.lit("missing")).alias("to_kind")).count().withColumnRenamed("count", "n")


def paired_deltas(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """AG12 / JN5: one row over the tasks of both runs."""
    d = left.select(key, F.col(value).alias("__l")).join(right.select(key, F.col(value).alias("__r")), key).withColumn("__d", F.col("__r") - F.col("__l"))
    sign = lambda s: F.count(F.when(F.signum("__d") == s, 1))
    return d.agg(F.count(F.lit(1)).alias("n"), sign(1).alias("improved"), sign(0).alias("unchanged"), sign(-1).alias("worsened"), F.avg("__d").alias("mean_delta"))


def all_pairs(runs: DataFrame, label: str, position: str, key: str, value: str) -> DataFrame:
    """JN6: deltas of every pair of runs, the earlier first."""
    a, b = runs.alias("a"), runs.alias("b")
    both = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"a.{position}") < F.col(f"b.{position}")))
    d = F.col(f"b.{value}") - F.col(f"a.{value}")
    return both.groupBy(F.col(f"a.{label}").alias("source"), F.col(f"b.{label}").alias("target")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(d > 0, 1)).alias("improved"), F.count(F.when(d < 0, 1)).alias("worsened"))


def spread(df: DataFrame, key: str, value: str) -> DataFrame:
    """NUM20 to NUM22: mean, median, interpolated p90, nearest-rank p95 and extremes."""
    return df.groupBy(key).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.expr(f"percentile_cont(0.9) within group (order by {value})").alias("p90"),
        F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95"), F.min(value).alias("least"), F.max(value).alias("most"),
    )


def overlay(base: DataFrame, over: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """JN12: the overlay's values win where it has a row."""
    o = over.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    rows = base.join(o, key, "left")
    return rows.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def keyed_merge(retained: DataFrame, replacement: DataFrame, key: str) -> DataFrame:
    """JN13 / JN14: replacement rows in place of rows of their key."""
    return retained.join(replacement.select(key), key, "left_anti").unionByName(replacement)


def share_audit(df: DataFrame, key: str, policy: DataFrame, n_col: str = "share") -> DataFrame:
    """AG11: ``policy`` (key value, kind min_share or max_share, share) against the counts: the count
    wanted (ceil for least, floor for most) and what is lacking or over."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = policy.join(counts, key, "left").crossJoin(F.broadcast(total)).withColumn("n", F.coalesce("n", F.lit(0)))  # total: one row
    least = F.col("kind") == "min_share"
    rows = rows.withColumn("wanted", F.when(least, F.ceil(F.col("total") * F.col(n_col) - 1e-9)).otherwise(F.floor(F.col("total") * F.col(n_col) + 1e-9)))
    return rows.withColumn("gap", F.greatest(F.lit(0), F.when(least, F.col("wanted") - F.col("n")).otherwise(F.col("n") - F.col("wanted"))))


def reason_codes(checks: dict[str, Column]) -> Column:
    """FLT4 / FLT5: the names of the checks that fail, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks.items()]))
