"""Three-valued constraint scoring and terminal classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import step_penalty

#: What an ending is worth before steps are charged.
WORTH = {
    "gold_purchase": 1.0, "valid_alternative_purchase": 0.8, "assistant_final": -0.8, "early_abstain": -0.4,
    "max_steps": 0.0, "repeat_loop": -0.6, "wrong_purchase": -1.0, "reward_unverifiable": 0.0,
}
PARTIAL_BASE, PARTIAL_SCALE = 0.5, 0.3
MATCH, COVERAGE = 0.70, 0.75


#: Roles of constraints that are not scored.
REFERENCES = ("gold_variant_reference", "gold_annotation_reference", "query_preference_reference")


def strength(given: Column, role: Column) -> Column:
    """SC16: the given strength if it is one, else by role."""
    return F.when(given.isin("hard", "soft", "ignore", "needs_review"), given).when(role.isin(*REFERENCES), "ignore").otherwise("hard")


def scored(df: DataFrame, wanted: str, given: str = "strength", role: str = "role", enforcement: str = "enforcement") -> DataFrame:
    """SC17: the constraints of one strength that are scored, not only audited."""
    usual = F.coalesce(F.nullif(F.col(enforcement), F.lit("")), F.lit("scored")) == "scored"
    return df.filter(usual & (strength(F.col(given), F.col(role)) == wanted))


def combine(df: DataFrame, key: str, status: str = "status", strength: str = "strength") -> DataFrame:
    """Counts of hard and soft verdicts, and of those to be reviewed.  Not a boolean AND: a failure wins over
    an unverifiable."""
    of = lambda s, v: F.count(F.when((F.col(strength) == s) & (F.col(status) == v), 1))
    rows = df.groupBy(key).agg(
        of("hard", "fail").alias("hard_fail"), of("hard", "unverifiable").alias("hard_unknown"), of("hard", "pass").alias("hard_pass"), F.count(F.when(F.col(strength) == "hard", 1)).alias("hard_total"),
        of("soft", "pass").alias("soft_pass"), of("soft", "fail").alias("soft_fail"), F.count(F.when(F.col(strength) == "needs_review", 1)).alias("review"),
    )
    known = F.col("soft_pass") + F.col("soft_fail")
    return rows.withColumn("soft_score", F.when(known > 0, F.col("soft_pass") / known).otherwise(1.0))


def terminal_class(df: DataFrame, is_target: Column, steps: Column, fallback: Column | None = None) -> DataFrame:
    """SC18 / X31 over the columns of :func:`combine`: the class, and its utility less the steps.  The target is
    gold whatever its soft verdicts; ``fallback`` tells if all gates hold where there is no hard constraint."""
    satisfied = F.when(F.col("hard_total") > 0, F.col("hard_pass") == F.col("hard_total")).otherwise(F.lit(False) if fallback is None else F.coalesce(fallback, F.lit(False)))
    kind = (
        F.when(F.col("hard_fail") > 0, "wrong_purchase")
        .when((F.col("review") > 0) | (F.col("hard_unknown") > 0), "reward_unverifiable")
        .when(~satisfied, "wrong_purchase")
        .when(is_target, "gold_purchase")
        .when(F.col("soft_fail") > 0, "partial_alternative_purchase")
        .otherwise("valid_alternative_purchase")
    )
    rows = df.withColumn("reward_type", kind)
    worth = F.when(F.col("reward_type") == "partial_alternative_purchase", PARTIAL_BASE + PARTIAL_SCALE * F.col("soft_score"))
    for name, value in WORTH.items():
        worth = worth.when(F.col("reward_type") == name, F.lit(value))
    valid = F.col("reward_type") != "reward_unverifiable"
    return rows.withColumn("utility", F.round(worth + F.when(valid, step_penalty(steps)).otherwise(0.0), 10))


def acceptable(hard: Column, match: Column, coverage: Column) -> Column:
    """SC19: all hard gates (an array of verdicts) hold, and match and coverage reach their thresholds."""
    return F.forall(hard, lambda s: s == "pass") & (match >= MATCH) & (coverage >= COVERAGE)


def fixed_ending(reason: Column, steps: Column) -> Column:
    """SC20: utility of an ending without a purchase."""
    worth = F.lit(None).cast("double")
    for name, value in WORTH.items():
        worth = F.when(reason == name, F.lit(value)).otherwise(worth)
    return F.round(worth + step_penalty(steps), 10)


def active_mean(scores: dict[str, tuple[Column, float, Column]]) -> Column:
    """SC15: weighted mean over active dimensions (score, weight, active); 1 if none is."""
    top, low = F.lit(0.0), F.lit(0.0)
    for score, weight, active in scores.values():
        top = top + F.when(active, score * weight).otherwise(0.0)
        low = low + F.when(active, F.lit(weight)).otherwise(0.0)
    return F.when(low > 0, top / low).otherwise(1.0)


def price_gate(price: Column, want: Column) -> Column:
    """SC11 over a constraint struct (operator, value, min, max).  No constraint is always met; a price that
    is unknown, negative or not finite, and a bound that makes no sense, cannot be verified."""
    op, v, lo, hi = want["operator"], want["value"], want["min"], want["max"]
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    one_sided, two_sided = op.isin("lt", "lte", "gt", "gte"), op.isin("between", "approximately")
    usable = F.coalesce(finite(price) & (price >= 0) & ((one_sided & finite(v) & (v > 0)) | (two_sided & finite(lo) & finite(hi) & (lo >= 0) & (hi >= lo))), F.lit(False))
    ok = F.when(op == "lte", price <= v).when(op == "lt", price < v).when(op == "gte", price >= v).when(op == "gt", price > v).otherwise((price >= lo) & (price <= hi))
    return F.when(want.isNull(), "pass").when(~usable, "unverifiable").when(ok, "pass").otherwise("fail")


def category_verdict(want: Column, have: Column) -> Column:
    """SC3 over category arrays: equal leaves, and shared ancestors unless a side has none."""
    leaf = F.element_at(want, -1) == F.element_at(have, -1)
    up = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
    kin = (F.size(up(want)) == 0) | (F.size(up(have)) == 0) | F.arrays_overlap(up(want), up(have))
    return F.when((F.size(want) == 0) | (F.size(have) == 0), "unverifiable").when(leaf & kin, "pass").otherwise("fail")


def cheapest_options(options: Column) -> Column:
    """SC9: for each axis the available value of least price (unpriced last), then of least name."""
    free = lambda vs: F.filter(vs, lambda v: ~F.coalesce(~v["is_available"], F.lit(False)))
    best = lambda vs: F.array_min(F.transform(free(vs), lambda v: F.struct(v["price"].isNull().alias("u"), v["price"].alias("p"), v["value"].alias("v"))))["v"]
    return F.transform_values(options, lambda k, vs: best(vs))
