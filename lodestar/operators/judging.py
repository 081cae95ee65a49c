"""Evaluation of runs: rubrics, judges, panels and their summaries.

A panel is one row a task: reward and ending, rubric with the judge's assessments, quality scores and
deterministic metrics.  ``rubrics``: array of (rubric_id, hardness, constraint_type, field_path);
``assessments``: array of (rubric_id, status).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import step_penalty
from .scoring import WORTH, fixed_ending

#: Statuses of an assessment, and words by which an option's field tells its category.
RUBRIC_STATUSES = ("satisfied", "violated", "unknown", "not_applicable")
FIELD_WORDS = {
    "color_option": ("color", "颜色"), "flavor_option": ("flavor", "口味", "香味"),
    "size_option": ("size", "capacity", "dimensions", "specification", "net_content", "长度", "直径", "容量", "规格", "数量", "参考身高", "适用人数"),
}
PURCHASES = ("gold_purchase", "valid_alternative_purchase", "partial_alternative_purchase", "wrong_purchase")


def default_rubric(task: Column, query: Column) -> Column:
    """The row of a task whose rubric was not curated."""
    q = F.trim(query)
    return F.struct(F.lit("rubric-not-curated-v1").alias("rubric_version"), q.alias("query"), F.sha2(F.concat(task.cast("string"), F.lit("\0"), q), 256).alias("task_data_hash"), F.sha2(q, 256).alias("query_hash"))


def not_judged(reason: Column) -> Column:
    """The row of a trajectory that no judge saw: no scores, and an error only if the infrastructure failed."""
    return F.struct(F.lit("not_judged").alias("judge_status"), reason.alias("not_judged_reason"), F.when(reason == "infrastructure_invalid", reason).alias("primary_error"))


def panels(expected: DataFrame, metrics: DataFrame, rubrics: DataFrame, judges: DataFrame) -> DataFrame:
    """JN1, PL4: expected tasks with their run (tasks without one are left out, runs of other tasks too),
    rubric and judge; a missing rubric or judge is replaced by its default row.

    ``metrics``: task_id, trajectory_id, query, infrastructure_invalid, ...; ``rubrics``: task_id, rubric_version,
    rubrics; ``judges``: trajectory_id, judge_status, assessments."""
    rows = metrics.join(expected.select("task_id").distinct(), "task_id", "left_semi").join(rubrics, "task_id", "left").join(judges, "trajectory_id", "left")
    none = default_rubric(F.col("task_id"), F.col("query"))
    why = F.when(F.col("infrastructure_invalid"), "infrastructure_invalid").otherwise("judge_not_requested")
    unjudged = F.col("judge_status").isNull() | F.col("infrastructure_invalid")
    return (
        rows.withColumn("rubric_version", F.coalesce("rubric_version", none["rubric_version"]))
        .withColumn("not_judged_reason", F.when(unjudged, why))
        .withColumn("judge_status", F.when(unjudged, "not_judged").otherwise(F.col("judge_status")))
        .withColumn("assessments", F.when(~unjudged, F.col("assessments")))
    )


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """JN1: keys that must be unique and are not."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def hard_violations(judge_status: Column, rubrics: Column, assessments: Column) -> Column:
    """Violated hard rubrics; null unless the judge is valid."""
    hard = F.transform(F.filter(rubrics, lambda r: r["hardness"] == "hard"), lambda r: r["rubric_id"])
    return F.when(judge_status == "valid", F.size(F.filter(assessments, lambda a: (a["status"] == "violated") & F.array_contains(hard, a["rubric_id"]))))


def dimension_score(judge_status: Column, scores: Column, name: str) -> Column:
    """Null unless the judge is valid."""
    return F.when(judge_status == "valid", scores[name].cast("int"))


def disagreement(judge_status: Column, reward_type: Column, purchase_success: Column, rubrics: Column, assessments: Column) -> Column:
    """AG26: where reward and rubric contradict each other: names of the contradictions."""
    hard = F.transform(F.filter(rubrics, lambda r: r["hardness"] == "hard"), lambda r: r["rubric_id"])
    is_hard = lambda a: F.array_contains(hard, a["rubric_id"])
    valid = F.coalesce(judge_status == "valid", F.lit(False))
    won = F.coalesce(purchase_success, F.lit(False))
    used = F.filter(assessments, lambda a: a["status"] != "not_applicable")
    used_hard = F.filter(used, is_hard)
    all_good = lambda rows: (F.size(rows) > 0) & F.forall(rows, lambda a: a["status"] == "satisfied")
    violated = F.filter(assessments, lambda a: a["status"] == "violated")
    found = [
        (won & (F.size(violated) > 0), "reward_success_with_rubric_violation"), (won & F.exists(violated, is_hard), "reward_success_with_hard_rubric_violation"),
        ((reward_type == "wrong_purchase") & all_good(used_hard), "wrong_purchase_with_all_hard_rubrics_satisfied"), ((reward_type == "partial_alternative_purchase") & all_good(used), "partial_reward_with_all_rubrics_satisfied"),
    ]
    return F.array_compact(F.array(*[F.when(valid & F.coalesce(c, F.lit(False)), n) for c, n in found]))


def rubric_category(constraint_type: Column, field_path: Column) -> Column:
    """The reporting category of a rubric: of options by words of their field."""
    path = F.lower(F.coalesce(field_path, F.lit("")))
    out = F.when(constraint_type.isin("category", "core_function", "brand", "model"), constraint_type).when(constraint_type.isin("price_preference", "budget_upper", "price_range"), "price").when(~F.coalesce(constraint_type == "option", F.lit(False)), "other")
    for name, words in FIELD_WORDS.items():
        out = out.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(path, w)), name)
    return out.otherwise("other_option")


def category_statuses(df: DataFrame) -> DataFrame:
    """JN11: (category, status, n): assessments joined to the rubric they are of; others are dropped."""
    asked = df.select("task_id", F.explode("rubrics").alias("r")).select("task_id", F.col("r.rubric_id").alias("rubric_id"), rubric_category(F.col("r.constraint_type"), F.col("r.field_path")).alias("category"))
    given = df.select("task_id", F.explode("assessments").alias("a")).select("task_id", "a.rubric_id", "a.status")
    status = F.when(F.col("status").isin(*RUBRIC_STATUSES), F.col("status")).otherwise("unknown")
    return given.join(asked, ["task_id", "rubric_id"]).groupBy("category", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def nested_statuses(df: DataFrame, constraints: str) -> DataFrame:
    """AG5: (by, value, status, n): statuses of constraints by role and by type; what is missing is ``unknown``."""
    c = df.select(F.explode(constraints).alias("c"))
    name = lambda f: F.coalesce(F.nullif(F.col(f"c.{f}"), F.lit("")), F.lit("unknown"))
    both = F.explode(F.array(*[F.struct(F.lit(by).alias("by"), name(f).alias("value")) for by, f in (("role", "role"), ("type", "constraint_type"))]))
    return c.select(both.alias("k"), name("status").alias("status")).groupBy("k.by", "k.value", "status").agg(F.count(F.lit(1)).alias("n"))


def summary(expected: DataFrame, rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AG1, AG3, AG4: one row (or one a stratum of ``expected``): rates and means over what was expected, the
    mean reward also over what was completed, steps of successes and failures, tokens and seconds over what is
    known.  ``rows``: task_id, strict, won, valid, reward, utility, steps, duplicates, guards, truncated, tokens,
    seconds, invalid; of repeated tasks the last by ``at`` counts."""
    last = rows.groupBy("task_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "task_id"]), "at").alias("r")).select("task_id", "r.*")
    all_ = expected.dropDuplicates(["task_id"]).join(last, "task_id", "left")
    n, yes = F.count(F.lit(1)), lambda c: F.count(F.when(F.col(c), 1))
    sum0 = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    done = F.count("at")
    group = all_.groupBy(*by) if by else all_.groupBy()
    return group.agg(
        n.alias("expected"), done.alias("completed"), yes("strict").alias("strict"), (yes("strict") / n).alias("gold_rate"), yes("won").alias("won"), (yes("won") / n).alias("success_rate"), (yes("valid") / n).alias("valid_rate"),
        (sum0("reward") / n).alias("mean_reward_fixed"), (sum0("reward") / F.greatest(done, F.lit(1))).alias("mean_reward_completed"), (sum0("utility") / n).alias("mean_utility_fixed"),
        F.avg(F.when(F.col("strict"), F.col("steps"))).alias("steps_of_successes"), F.avg(F.when(~F.col("strict"), F.col("steps"))).alias("steps_of_failures"),
        sum0("duplicates").cast("long").alias("duplicates"), sum0("guards").cast("long").alias("guards"), yes("truncated").alias("truncated"), F.avg("tokens").alias("mean_tokens"), F.count("tokens").alias("token_tasks"), F.avg("seconds").alias("mean_seconds"), yes("invalid").alias("infrastructure_invalid"),
    )


def kinds(rows: DataFrame, key: str = "reward_type") -> DataFrame:
    """AG16, AG25: counts and mean reward by ending."""
    return rows.groupBy(F.coalesce(key, F.lit("unknown")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.avg("reward").alias("mean_reward"))


def step_metrics(df: DataFrame, step: str, means: list[str], extremes: list[str], kind: str) -> DataFrame:
    """AG10: (step, name, value): means, extremes and counts by kind, of every optimizer step."""
    aggs = [F.avg(F.col(c).cast("double")).alias(f"{c}_mean") for c in means]
    aggs += [f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in extremes for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max))]
    wide = df.groupBy(step).agg(*aggs)
    names = [c for c in wide.columns if c != step]
    long = wide.select(step, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])).alias("m")).select(step, "m.name", "m.value")
    counted = df.groupBy(step, F.concat(F.lit("type_count/"), F.coalesce(kind, F.lit("unknown"))).alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return long.unionByName(counted)


def replayed_ending(reward_type: Column, reason: Column, invalid_limit: Column, steps: Column, reward: Column) -> Column:
    """Struct (kind, reward) of an ending without purchase under today's values: a limit of invalid actions
    is a final answer of the assistant; fixed endings are charged their steps; the rest keeps its reward."""
    fixed = F.when(reason.isin("assistant_final", "repeat_loop", "max_steps"), reason).otherwise(reward_type)
    of = lambda kind, value: F.struct(kind.alias("kind"), value.alias("reward"))
    blocked = of(F.lit("guard_rejection"), F.round(F.lit(WORTH["assistant_final"]) + step_penalty(steps), 10))
    return F.when(F.coalesce(invalid_limit, F.lit(False)), blocked).when(fixed.isin("assistant_final", "repeat_loop", "max_steps"), of(fixed, fixed_ending(fixed, steps))).otherwise(of(F.coalesce(reward_type, F.lit("unknown")), F.coalesce(reward, F.lit(0.0))))


def overlay_reason(reward_type: Column, source: Column) -> Column:
    """The ending that an overlaid reward stands for."""
    return F.when(reward_type.isin(*PURCHASES), reward_type).when(reward_type == "guard_rejection", "invalid_action_limit").otherwise(F.coalesce(F.nullif(reward_type, F.lit("")), source, F.lit("")))


def metadata_totals(df: DataFrame) -> DataFrame:
    """AG24: one row over results with ``validation_repairs`` and ``calls`` (latency, retry_wait, prompt, completion, total)."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = lambda f, z: F.aggregate(F.coalesce("calls", F.array()), F.lit(z), lambda a, c: a + F.coalesce(c[f], F.lit(z)))
    whole = F.lit(0).cast("long")
    count = lambda f: F.aggregate("calls", whole, lambda a, c: a + F.coalesce(c[f].cast("long"), whole))
    return df.agg(
        F.count(F.lit(1)).alias("results"), zero(F.sum(F.size("calls"))).alias("provider_calls"), zero(F.sum(total("latency", 0.0))).alias("latency_seconds"), zero(F.sum(count("prompt"))).alias("prompt_tokens"),
        zero(F.sum(count("completion"))).alias("completion_tokens"), zero(F.sum(count("total"))).alias("total_tokens"), zero(F.sum("validation_repairs")).alias("validation_repairs"),
    )


def top_names(df: DataFrame, name: str, n: str, limit: int = 10) -> DataFrame:
    """Names with the largest sums over all runs; ties by name."""
    return df.groupBy(name).agg(F.sum(n).alias("total")).orderBy(F.desc("total"), name).limit(limit)


def same_contract(a: Column, b: Column, free: tuple[str, ...] = ("workers", "missing_tasks_count_as_failures")) -> Column:
    """Two protocols (maps) are equal but for entries that do not change results."""
    shown = lambda m: F.array_sort(F.map_entries(F.map_filter(m, lambda k, v: ~k.isin(*free))))
    return shown(a) == shown(b)


def context_usage(calls: Column, budget: Column) -> Column:
    """JN19: the largest prompt of a run as a share of the budget."""
    return F.when(budget > 0, F.array_max(F.transform(calls, lambda c: c["prompt_tokens"])) / budget)


def judge_violations(df: DataFrame) -> DataFrame:
    """JSN8: rows of judge results that break their contract, each with all it breaks: closed vocabularies,
    assessments of exactly the rubrics asked, evidence among the trajectory's events.  Columns: judge_status,
    rubric_ids, assessments (rubric_id, status, evidence), scores (map), event_ids."""
    ids = F.transform("assessments", lambda a: a["rubric_id"])
    checks = {
        "unknown_judge_status": ~F.col("judge_status").isin("valid", "not_judged", "invalid"), "repeated_rubric": F.size(F.array_distinct(ids)) < F.size(ids), "rubric_not_assessed": (F.col("judge_status") == "valid") & (F.size(F.array_except("rubric_ids", ids)) > 0),
        "unknown_rubric": F.size(F.array_except(ids, F.col("rubric_ids"))) > 0, "unknown_status": F.exists("assessments", lambda a: ~a["status"].isin(*RUBRIC_STATUSES)),
        "unknown_event": F.exists("assessments", lambda a: F.size(F.array_except(a["evidence"], F.col("event_ids"))) > 0), "score_out_of_range": F.exists(F.map_values("scores"), lambda s: ~s.isin(0, 1, 2)), "scores_without_judge": (F.col("judge_status") != "valid") & (F.size("scores") > 0),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), n) for n, c in checks.items()]))
    return df.withColumn("broken", broken).filter(F.size("broken") > 0)
