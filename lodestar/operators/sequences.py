"""Operators on ordered sequences.  The order is a position column, never time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def duplicate_counts(df: DataFrame, key: str, pos: str, signature: Column) -> DataFrame:
    """AG7 / WN1: per key the rows, the repeats of an earlier signature, and those right after it."""
    w = W.partitionBy(key).orderBy(pos)
    rows = df.withColumn("__s", signature).withColumn("__p", F.lag("__s").over(w))
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), (F.count("__s") - F.countDistinct("__s")).alias("duplicates"), F.count(F.when(F.col("__s") == F.col("__p"), 1)).alias("consecutive")
    )


def repeats_within(df: DataFrame, key: str, pos: str, signature: Column, back: int = 3) -> DataFrame:
    """WN3 / WN6: ``repeat``: the signature occurs in the ``back`` rows before."""
    w = W.partitionBy(key).orderBy(pos).rowsBetween(-back, -1)
    return df.withColumn("__s", signature).withColumn("repeat", F.array_contains(F.collect_list("__s").over(w), F.col("__s"))).drop("__s")


def removable_duplicates(df: DataFrame, key: str, pos: str, columns: list[str]) -> DataFrame:
    """WN2: rows equal to the row before in every one of the columns."""
    w = W.partitionBy(key).orderBy(pos)
    same = F.lit(True)
    for c in columns:
        same = same & F.coalesce(F.col(c) == F.lag(c).over(w), F.lit(False))
    return df.withColumn("removable", same)


def ordered_path(df: DataFrame, key: str, pos: str, kind: str, path: tuple[str, str, str]) -> DataFrame:
    """WN5: per key, whether the three kinds come in this order."""
    a, b, c = path
    ends = df.groupBy(key).agg(F.min(F.when(F.col(kind) == a, F.col(pos))).alias("__a"), F.max(F.when(F.col(kind) == c, F.col(pos))).alias("__c"))
    mid = df.filter(F.col(kind) == b).join(ends, key).filter((F.col(pos) > F.col("__a")) & (F.col(pos) < F.col("__c"))).select(key).distinct()
    return df.select(key).distinct().join(mid.withColumn("__m", F.lit(True)), key, "left").select(key, F.coalesce("__m", F.lit(False)).alias("has_path"))


def no_progress(df: DataFrame, key: str, pos: str, progress: Column) -> DataFrame:
    """ST1, window form: ``idle``: rows since the last progress (islands), and ``step``."""
    w = W.partitionBy(key).orderBy(pos)
    rows = df.withColumn("__p", progress.cast("int")).withColumn("step", F.row_number().over(w)).withColumn("__i", F.sum("__p").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.withColumn("idle", F.row_number().over(W.partitionBy(key, "__i").orderBy(pos)) - F.when(F.col("__i") > 0, 1).otherwise(0)).drop("__p", "__i")


def first_distinct(df: DataFrame, key: str, pos: str, value: str, n: int) -> DataFrame:
    """ST3: the first ``n`` different values of each key, in order."""
    first = df.groupBy(key, value).agg(F.min(pos).alias(pos))
    w = W.partitionBy(key).orderBy(pos)
    return first.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def previous_value(df: DataFrame, key: str, pos: str, value: Column) -> DataFrame:
    """WN15: the last non-null value before a row."""
    return df.withColumn("previous", F.last(value, ignorenulls=True).over(W.partitionBy(key).orderBy(pos).rowsBetween(W.unboundedPreceding, -1)))


def suffix_budget(df: DataFrame, key: str, pos: str, cost: Column, budget: int, anchor: Column | None = None) -> DataFrame:
    """WN9: the longest run of last rows within the budget; anchors stay and cost first; the last row
    always stays."""
    w = W.partitionBy(key)
    a = F.lit(False) if anchor is None else anchor
    rows = df.withColumn("__a", a).withColumn("__c", cost)
    rows = rows.withColumn("__room", budget - F.sum(F.when(F.col("__a"), F.col("__c")).otherwise(0)).over(w))
    back = F.sum(F.when(F.col("__a"), 0).otherwise(F.col("__c"))).over(w.orderBy(F.desc(pos)).rowsBetween(W.unboundedPreceding, 0))
    last = F.col(pos) == F.max(pos).over(w)
    return rows.withColumn("kept", F.col("__a") | last | (back <= F.col("__room"))).drop("__a", "__c", "__room")


def event_stream(steps: DataFrame, blocked: DataFrame, key: str, index: str) -> DataFrame:
    """WN8: blocked calls come before the step of their index, those without one last; numbered."""
    rows = steps.withColumn("__k", F.lit(1)).unionByName(blocked.withColumn("__k", F.lit(0)), allowMissingColumns=True)
    w = W.partitionBy(key).orderBy(F.col(index).asc_nulls_last(), "__k")
    return rows.withColumn("event_id", F.concat(F.lit("e"), F.lpad(F.row_number().over(w).cast("string"), 4, "0"))).withColumn("event_type", F.when(F.col("__k") == 1, "tool_step").otherwise("guard_rejection")).drop("__k")


def pair_calls(calls: DataFrame, returns: DataFrame, key: str, call: str) -> DataFrame:
    """JN15: calls and returns of equal id; ``problem`` names what has no partner."""
    both = calls.withColumn("__c", F.lit(1)).join(returns.withColumn("__r", F.lit(1)), [key, call], "full_outer")
    return both.withColumn("problem", F.when(F.col("__c").isNull(), "return_without_call").when(F.col("__r").isNull(), "call_without_return")).drop("__c", "__r")
