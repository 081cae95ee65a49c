"""Filters of groups of attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_verdicts(df: DataFrame, key: str, utility: str, invalid: str, unverifiable: str, success: str, tolerance: float, need_success: bool = False) -> DataFrame:
    """Per group: the spread of utility, the first reason to drop it (null: it stays), and whether it is worth
    another attempt.  A row that cannot be verified drops its whole group, for good; rows invalid for other
    reasons count in spread and success, and drop a group only if nothing else does."""
    rows = df.groupBy(key).agg(
        F.max(F.col(unverifiable).cast("int")).alias("unknown"),
        F.max(F.col(success).cast("int")).alias("won"),
        F.max(F.col(invalid).cast("int")).alias("bad"),
        (F.max(utility) - F.min(utility)).alias("spread"),
        F.stddev_pop(utility).alias("sd"),
    )
    why = F.when(F.col("unknown") == 1, "forbidden_trajectory_in_group")
    if need_success:
        why = why.when(F.col("won") == 0, "no_purchase_success")
    why = why.when(F.col("spread") <= tolerance, "low_reward_variation").when(F.col("bad") == 1, "sampling_invalid")
    again = why.isin("no_purchase_success", "low_reward_variation")
    return rows.select(key, "spread", "sd", why.alias("drop_reason"), F.coalesce(again, F.lit(False)).alias("retryable"))


def varying_groups(df: DataFrame, key: str, **kw) -> DataFrame:
    """Rows of the groups that stay."""
    return df.join(group_verdicts(df, key, **kw).filter("drop_reason is null").select(key), key, "left_semi")


def admission(df: DataFrame, key: str, attempt: str, utility: str, success: str, reasons: str, size: int = 4, most: int = 3, tolerance: float = 0.025) -> DataFrame:
    """NUM23: accept, probe again or reject a task by its attempts in rounds of ``size``.

    A round counts if it is complete (each of its attempts once), no row has a reason against it
    (``reasons``: array) and utilities vary by more than ``tolerance``; the first of ``most`` rounds that
    counts and has a success admits the task.  One row a task: decision, reason, probe_role,
    accepted_round, and spread and population deviation of the admitting round."""
    rows = df.withColumn("round", F.floor(F.col(attempt) / size))
    rounds = rows.groupBy(key, "round").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(attempt).alias("places"), F.max(F.size(F.coalesce(reasons, F.array().cast("array<string>")))).alias("against"),
        (F.max(utility) - F.min(utility)).alias("spread"), F.stddev_pop(utility).alias("sd"), F.count(F.when(F.col(success), 1)).alias("won"),
    )
    varied = (F.col("n") == size) & (F.col("places") == size) & (F.col("against") == 0) & F.coalesce(F.col("spread") > tolerance, F.lit(False))
    first = rounds.withColumn("varied", varied & (F.col("round") < most))
    tasks = first.groupBy(key).agg(
        F.min(F.when(F.col("varied") & (F.col("won") > 0), F.struct("round", "won", "spread", "sd"))).alias("first"),
        F.coalesce(F.bool_or(F.col("varied") & (F.col("won") == 0)), F.lit(False)).alias("lost"), F.count(F.lit(1)).alias("rounds"),
    )
    good, more, won = F.col("first").isNotNull(), F.col("rounds") < most, F.col("first")["won"]
    decision = F.when(good, "accept").when(more, "reprobe").otherwise("reject")
    reason = (
        F.when(good, "valid_reward_variation")
        .when(F.col("lost") & more, "no_gold_trajectory_yet").when(F.col("lost"), "three_attempts_without_gold_or_valid_purchase")
        .when(more, "attempt_invalid_or_low_reward_variation").otherwise("three_attempts_without_valid_reward_variation")
    )
    role = F.when(good & (won < size), "frontier").when(good, "regression_guard").when(more, "unresolved").otherwise("quarantine")
    return tasks.select(key, decision.alias("decision"), reason.alias("reason"), role.alias("probe_role"), F.col("first")["round"].alias("accepted_round"), F.col("first")["spread"].alias("spread"), F.col("first")["sd"].alias("sd"))


def decide(candidates: DataFrame, attempts: DataFrame, key: str, **kw) -> DataFrame:
    """JN7: every candidate with its decision; without any attempt it is to be probed again."""
    out = candidates.select(key).join(admission(attempts, key, **kw), key, "left")
    return out.withColumn("decision", F.coalesce("decision", F.lit("reprobe"))).withColumn("reason", F.coalesce("reason", F.lit("no_trajectories"))).withColumn("probe_role", F.coalesce("probe_role", F.lit("unresolved")))
