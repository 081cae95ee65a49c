"""Queries over builder features and evaluation panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import builders, judging
from .catalog import query, read
from .trajectory_queries import _BASE, _steps

_FEATURES = """WITH r AS (SELECT p_partkey AS task, (p_size % 10) / 10.0 AS lexical_overlap, 40 + p_size AS query_chars, p_size % 12 AS category_pool_size, p_size % 8 AS attribute_count, p_size % 5 = 0 AS hard_budget, p_size % 7 = 0 AS approximate_price,
 p_size % 4 AS option_axes, p_size % 12 AS variant_count, p_retailprice / 100 AS difficulty_score, CASE WHEN p_size % 6 = 0 THEN 'missing' ELSE 'rank1' END AS retrieval_bucket FROM part)
"""


def _features(spark, sf_dir):
    s = F.col("p_size")
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("task"),
        F.struct(
            ((s % 10) / 10.0).alias("lexical_overlap"), (s + 40).alias("query_chars"), (s % 12).alias("category_pool_size"), (s % 8).alias("attribute_count"), (s % 5 == 0).alias("hard_budget"), (s % 7 == 0).alias("approximate_price"),
            (s % 4).alias("option_axes"), (s % 12).alias("variant_count"), (F.col("p_retailprice") / 100).alias("difficulty_score"), F.when(s % 6 == 0, "missing").otherwise("rank1").alias("retrieval_bucket"),
        ).alias("r"),
    )


@query(_FEATURES + """SELECT task, array_to_string(list_filter([CASE WHEN lexical_overlap <= 0.30 AND query_chars >= 55 THEN 'search_reformulation' END, CASE WHEN category_pool_size >= 8 AND attribute_count >= 4 THEN 'candidate_comparison' END,
 CASE WHEN hard_budget OR approximate_price THEN 'price_semantics' END, CASE WHEN option_axes >= 2 OR variant_count >= 6 THEN 'multi_option' END, CASE WHEN attribute_count >= 6 AND query_chars >= 65 THEN 'evidence_verification' END,
 CASE WHEN difficulty_score >= 9 THEN 'long_horizon' END], lambda x: x IS NOT NULL), ',') AS slices,
 round((1 - lexical_overlap) + query_chars / 150 + category_pool_size / 50 + attribute_count / 10 + 2 * approximate_price::INT + hard_budget::INT + query_chars / 200 + 2 * option_axes + variant_count / 5 + attribute_count + query_chars / 40 + difficulty_score, 6)::DOUBLE AS severities,
 ((difficulty_score >= 18)::INT + (retrieval_bucket = 'missing')::INT + (option_axes >= 3)::INT + (variant_count >= 10)::INT + (lexical_overlap <= 0.10 AND attribute_count >= 6)::INT)::INTEGER AS extremes FROM r""")
def challenge_features(spark, sf_dir):
    """FLT1, FLT2, FLT3, X17."""
    r = F.col("r")
    slices = F.array_compact(F.array(*[F.when(builders.strategy_eligible(k, r), s) for k, s in builders.PROXIES.items()]))
    total = sum((builders.severity(s, r) for s in builders.SLICES), F.lit(0.0))
    return _features(spark, sf_dir).select("task", F.array_join(slices, ",").alias("slices"), F.round(total, 6).alias("severities"), builders.extreme_factors(r).alias("extremes"))


@query(_FEATURES + "SELECT task, row_number() OVER (ORDER BY 2 * option_axes + variant_count / 5 DESC, task)::INTEGER AS place FROM r WHERE option_axes >= 2 OR variant_count >= 6 ORDER BY place LIMIT 50")
def hardest_tasks(spark, sf_dir):
    """The fifty hardest of one challenge."""
    rows = _features(spark, sf_dir).filter(builders.eligible("multi_option", F.col("r"))).withColumn("key", builders.hardest_first("multi_option", F.col("r"), F.col("task")))
    best = rows.orderBy("key").limit(50).select(F.array_sort(F.collect_list("key")).alias("keys"))
    return best.select(F.posexplode("keys").alias("place", "key")).select("key.task", (F.col("place") + 1).alias("place"))


_SIG = """, s AS (SELECT *, CASE kind WHEN 'view' THEN 'o' || k % 3 WHEN 'click' THEN 's' || k % 2 WHEN 'signup' THEN 'x' || k % 5 WHEN 'purchase' THEN 'b' END AS sig, coalesce(pk % 2, 0) AS state FROM w),
d AS (SELECT a.t, true AS again FROM s a JOIN s b ON a.t = b.t AND b.pos BETWEEN a.pos - 3 AND a.pos - 1 AND a.sig = b.sig AND a.state = b.state GROUP BY a.t),
f AS (SELECT s.t, count(*) AS n, count(DISTINCT k % 2) FILTER (kind = 'click') AS q, count(DISTINCT k % 3) FILTER (kind = 'view') AS c, count(*) FILTER (kind = 'signup') AS o, bool_or(kind = 'error') AS nx, bool_or(k % 7 = 0) AS g, arg_max(kind, pos) = 'purchase' AS bought,
 count(*) FILTER (kind = 'click') AS nq, count(*) FILTER (kind = 'view') AS nc, bool_or(coalesce(again, false)) AS again FROM s LEFT JOIN d USING (t) GROUP BY s.t)
"""


@query(_BASE + _SIG + """SELECT t, q >= 2 AS search_reformulation, c >= 2 AS candidate_comparison, o >= 2 AS multiple_options, g AS guard_recovery, q >= 2 AND (c >= 2 OR nx) AS loop_recovery, o > 0 AS variant_selection, bought AS explicit_terminal_buy, NOT again AS clean_critical_actions,
 array_to_string(list_filter([CASE WHEN NOT bought THEN 'quality_missing_explicit_terminal_buy' END, CASE WHEN again THEN 'quality_repeated_critical_action' END], lambda x: x IS NOT NULL), ',') AS reasons,
 (4 * (nq >= 2)::INT + 4 * (nc >= 2)::INT + 2 * nx::INT + 2 * (o >= 2)::INT + 8 * (nq >= 2 AND (nc >= 2 OR nx))::INT + 4 * (o > 0)::INT + 2 * bought::INT + 2 * (NOT again)::INT)::INTEGER AS score FROM f""")
def trajectory_behaviour(spark, sf_dir):
    """WN3, WN4, X3, X21, X22, SM22."""
    state = F.lit('{"s":0}')
    # arguments that do not parse count as none
    rows = _steps(spark, sf_dir).withColumn("b", builders.behaviour(F.col("steps"), F.col("blocked"), state)).withColumn("tools", F.transform("steps", lambda s: s["tool_name"]))
    names = ("search_reformulation", "candidate_comparison", "multiple_options", "guard_recovery", "loop_recovery", "variant_selection", "explicit_terminal_buy", "clean_critical_actions")
    score = builders.coverage_score(F.col("tools"), F.col("b")["clean_critical_actions"])
    return rows.select("t", *[F.col("b")[n].alias(n) for n in names], F.array_join(builders.quality_reasons(F.col("steps"), state), ",").alias("reasons"), score.alias("score"))


_JUDGED = """WITH x AS (SELECT p_partkey AS t, p_size AS s, CASE WHEN p_size % 5 = 4 THEN 'not_judged' ELSE 'valid' END AS judge,
 CASE p_size % 3 WHEN 0 THEN 'wrong_purchase' WHEN 1 THEN 'partial_alternative_purchase' ELSE 'gold_purchase' END AS kind, p_size % 2 = 0 AS won,
 CASE p_size % 4 WHEN 0 THEN 'violated' ELSE 'satisfied' END AS a1, CASE p_size % 6 WHEN 0 THEN 'violated' WHEN 1 THEN 'not_applicable' ELSE 'satisfied' END AS a2 FROM part)
"""


def _judged(spark, sf_dir):
    s = F.col("p_size")
    rubric = lambda i, h, k, p: F.struct(F.lit(i).alias("rubric_id"), F.lit(h).alias("hardness"), F.lit(k).alias("constraint_type"), F.lit(p).alias("field_path"))
    status = lambda i, c: F.struct(F.lit(i).alias("rubric_id"), c.alias("status"))
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("task_id"), F.when(s % 5 == 4, "not_judged").otherwise("valid").alias("judge_status"), F.when(s % 3 == 0, "wrong_purchase").when(s % 3 == 1, "partial_alternative_purchase").otherwise("gold_purchase").alias("kind"), (s % 2 == 0).alias("won"),
        F.array(rubric("r1", "hard", "brand", None), rubric("r2", "soft", "option", "options.颜色")).alias("rubrics"),
        F.array(status("r1", F.when(s % 4 == 0, "violated").otherwise("satisfied")), status("r2", F.when(s % 6 == 0, "violated").when(s % 6 == 1, "not_applicable").otherwise("satisfied")), status("r9", F.lit("violated"))).alias("assessments"),
        F.create_map(F.lit("planning"), s % 3).alias("scores"), "p_size",
    )


@query(_JUDGED + """SELECT t AS task_id, CASE WHEN judge = 'valid' THEN (a1 = 'violated')::INTEGER END AS hard, CASE WHEN judge = 'valid' THEN s % 3 END::INTEGER AS planning,
 array_to_string(list_filter([CASE WHEN judge = 'valid' AND won THEN 'reward_success_with_rubric_violation' END, CASE WHEN judge = 'valid' AND won AND a1 = 'violated' THEN 'reward_success_with_hard_rubric_violation' END,
  CASE WHEN judge = 'valid' AND kind = 'wrong_purchase' AND a1 = 'satisfied' THEN 'wrong_purchase_with_all_hard_rubrics_satisfied' END], lambda x: x IS NOT NULL), ',') AS disagreement FROM x""")
def judge_disagreement(spark, sf_dir):
    """AG26, X4, X6: r9 is an assessment of no rubric, always violated."""
    r, a, j = F.col("rubrics"), F.col("assessments"), F.col("judge_status")
    return _judged(spark, sf_dir).select("task_id", judging.hard_violations(j, r, a).alias("hard"), judging.dimension_score(j, F.col("scores"), "planning").alias("planning"), F.array_join(judging.disagreement(j, F.col("kind"), F.col("won"), r, a), ",").alias("disagreement"))


@query(_JUDGED + "SELECT 'brand' AS category, a1 AS status, count(*) AS n FROM x GROUP BY 2 UNION ALL SELECT 'color_option', a2, count(*) FROM x GROUP BY 2")
def rubric_categories(spark, sf_dir):
    """JN11."""
    return judging.category_statuses(_judged(spark, sf_dir))


@query("""SELECT p_partkey AS task_id, CASE WHEN p_size % 3 = 0 THEN 'curated' ELSE 'rubric-not-curated-v1' END AS rubric_version, CASE WHEN p_size % 4 = 0 OR p_size % 7 = 0 THEN 'not_judged' ELSE 'valid' END AS judge_status,
 CASE WHEN p_size % 7 = 0 THEN 'infrastructure_invalid' WHEN p_size % 4 = 0 THEN 'judge_not_requested' END AS reason, sha256(p_partkey || chr(0) || p_name) AS task_hash FROM part WHERE p_partkey % 5 <> 0""")
def evaluation_panels(spark, sf_dir):
    """JN1, PL4, X7, X8."""
    p, s = read(spark, sf_dir, "part"), F.col("p_size")
    metrics = p.select(F.col("p_partkey").alias("task_id"), F.concat(F.lit("t"), "p_partkey").alias("trajectory_id"), F.col("p_name").alias("query"), (s % 7 == 0).alias("infrastructure_invalid"))
    rubrics = p.filter(s % 3 == 0).select(F.col("p_partkey").alias("task_id"), F.lit("curated").alias("rubric_version"))
    judges = p.filter(s % 4 != 0).select(F.concat(F.lit("t"), "p_partkey").alias("trajectory_id"), F.lit("valid").alias("judge_status"), F.array(F.lit("x")).alias("assessments"))
    out = judging.panels(p.filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("task_id")), metrics, rubrics, judges)
    return out.select("task_id", "rubric_version", "judge_status", F.col("not_judged_reason").alias("reason"), judging.default_rubric(F.col("task_id"), F.col("query"))["task_data_hash"].alias("task_hash"))


@query("""WITH l AS (SELECT o_custkey AS task_id, arg_max(struct_pack(s := o_orderstatus, p := o_totalprice), o_orderkey) AS r FROM orders GROUP BY 1), c AS (SELECT c_mktsegment AS segment, r.s AS s, r.p AS p FROM customer LEFT JOIN l ON task_id = c_custkey)
SELECT segment, count(*) AS expected, count(s) AS completed, count(*) FILTER (s = 'F') AS strict, round(count(*) FILTER (s = 'F') / count(*), 6) AS gold_rate, round(coalesce(sum(p), 0) / count(*), 3) AS mean_reward_fixed, round(coalesce(sum(p), 0) / greatest(count(s), 1), 3) AS mean_reward_completed,
 round(avg(p / 1000) FILTER (s = 'F'), 4) AS steps_of_successes, count(p) FILTER (p > 100000) AS token_tasks FROM c GROUP BY segment""")
def run_summary(spark, sf_dir):
    """AG1, AG3, AG4: customers as tasks, orders as runs; the last run of a task counts."""
    p, f = F.col("o_totalprice"), F.lit(False)
    rows = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("at"), (F.col("o_orderstatus") == "F").alias("strict"), f.alias("won"), f.alias("valid"), p.alias("reward"), p.alias("utility"), (p / 1000).alias("steps"),
        F.lit(0).alias("duplicates"), F.lit(0).alias("guards"), f.alias("truncated"), F.when(p > 100000, p).alias("tokens"), p.alias("seconds"), f.alias("invalid"),
    )
    expected = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id"), F.col("c_mktsegment").alias("segment"))
    out = judging.summary(expected, rows, ["segment"])
    return out.select("segment", "expected", "completed", "strict", F.round("gold_rate", 6).alias("gold_rate"), F.round("mean_reward_fixed", 3).alias("mean_reward_fixed"), F.round("mean_reward_completed", 3).alias("mean_reward_completed"), F.round("steps_of_successes", 4).alias("steps_of_successes"), "token_tasks")


@query("""WITH c AS (SELECT CASE WHEN event_type = 'view' THEN 'unknown' ELSE event_type END AS role, CASE WHEN value > 150 THEN 'a' ELSE 'b' END AS kind, CASE WHEN value > 100 THEN 'pass' ELSE 'fail' END AS status FROM events)
SELECT 'role' AS "by", role AS value, status, count(*) AS n FROM c GROUP BY ALL UNION ALL SELECT 'type', kind, status, count(*) FROM c GROUP BY ALL""")
def constraint_statuses(spark, sf_dir):
    """AG5."""
    v = F.col("value")
    c = F.struct(F.when(F.col("event_type") != "view", F.col("event_type")).alias("role"), F.when(v > 150, "a").otherwise("b").alias("constraint_type"), F.when(v > 100, "pass").otherwise("fail").alias("status"))
    return judging.nested_statuses(read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.collect_list(c).alias("cs")), "cs")


@query("""WITH g AS (SELECT user_id % 7 AS step, * FROM events) SELECT step, 'value_mean' AS name, round(avg(value), 6) AS value FROM g GROUP BY 1 UNION ALL SELECT step, 'event_id_min', min(event_id) FROM g GROUP BY 1 UNION ALL SELECT step, 'event_id_max', max(event_id) FROM g GROUP BY 1
 UNION ALL SELECT step, 'event_id_mean', round(avg(event_id), 6) FROM g GROUP BY 1 UNION ALL SELECT step, 'type_count/' || event_type, count(*) FROM g GROUP BY 1, event_type""")
def optimizer_metrics(spark, sf_dir):
    """AG10."""
    rows = read(spark, sf_dir, "events").withColumn("step", F.col("user_id") % 7)
    return judging.step_metrics(rows, "step", ["value"], ["event_id"], "event_type").withColumn("value", F.round("value", 6))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'guard_rejection' WHEN p_size % 4 = 1 THEN 'repeat_loop' WHEN p_size % 4 = 2 THEN 'max_steps' ELSE 'odd' END AS kind,
 round(CASE WHEN p_size % 4 = 3 THEN p_retailprice ELSE CASE p_size % 4 WHEN 0 THEN -0.8 WHEN 1 THEN -0.6 ELSE 0.0 END - (greatest(0, least(p_size, 20) - 15) * 0.01 + greatest(0, least(p_size, 25) - 20) * 0.02 + greatest(0, least(p_size, 30) - 25) * 0.03
  + greatest(0, least(p_size, 35) - 30) * 0.04 + greatest(0, least(p_size, 40) - 35) * 0.05 + greatest(0, least(p_size, 45) - 40) * 0.06) END, 6)::DOUBLE AS reward,
 CASE WHEN p_size % 4 = 0 THEN 'invalid_action_limit' WHEN p_size % 4 = 1 THEN 'repeat_loop' WHEN p_size % 4 = 2 THEN 'max_steps' ELSE 'odd' END AS reason FROM part""")
def replayed_endings(spark, sf_dir):
    """X27, X29, SC20."""
    s = F.col("p_size")
    e = judging.replayed_ending(F.when(s % 4 == 1, "repeat_loop").otherwise("odd"), F.when(s % 4 == 2, "max_steps"), s % 4 == 0, s, F.col("p_retailprice"))
    rows = read(spark, sf_dir, "part").select("p_partkey", e.alias("e"))
    return rows.select("p_partkey", "e.kind", F.round("e.reward", 6).alias("reward"), judging.overlay_reason(F.col("e.kind"), F.lit("x")).alias("reason"))


@query("""SELECT count(*) AS results, sum(c) AS provider_calls, round(sum(v), 3) AS latency_seconds, sum(p)::BIGINT AS prompt_tokens, 0::BIGINT AS completion_tokens, sum(p)::BIGINT AS total_tokens, (count(*) FILTER (user_id % 3 = 0))::BIGINT AS validation_repairs
 FROM (SELECT user_id, count(*) AS c, sum(value) AS v, sum(event_id % 10) AS p FROM events GROUP BY user_id)""")
def judge_usage(spark, sf_dir):
    """AG24."""
    k = F.col("event_id") % 10
    call = F.struct(F.col("value").alias("latency"), k.alias("prompt"), F.lit(None).cast("long").alias("completion"), k.alias("total"))
    rows = read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(call).alias("calls")).withColumn("validation_repairs", (F.col("user_id") % 3 == 0).cast("long"))
    return judging.metadata_totals(rows).withColumn("latency_seconds", F.round("latency_seconds", 3))


@query("SELECT event_type AS name, sum(event_id % 100)::BIGINT AS total FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def top_error_names(spark, sf_dir):
    """A report of the three largest."""
    return judging.top_names(read(spark, sf_dir, "events").select(F.col("event_type").alias("name"), (F.col("event_id") % 100).alias("n")), "name", "n", 3)


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 7 = 0 THEN 'unknown_judge_status' END, CASE WHEN p_size % 7 <> 0 AND p_size % 5 = 0 THEN 'rubric_not_assessed' END, CASE WHEN p_size % 5 = 0 THEN 'unknown_rubric' END, CASE WHEN p_size % 4 = 0 THEN 'unknown_status' END,
 CASE WHEN p_size % 9 = 0 THEN 'unknown_event' END, CASE WHEN p_size % 11 = 0 THEN 'score_out_of_range' END, CASE WHEN p_size % 7 = 0 THEN 'scores_without_judge' END], lambda x: x IS NOT NULL), ',') AS broken FROM part WHERE p_size % 7 = 0 OR p_size % 5 = 0 OR p_size % 4 = 0 OR p_size % 9 = 0 OR p_size % 11 = 0""")
def judge_contract(spark, sf_dir):
    """JSN8."""
    s = F.col("p_size")
    a = F.struct(F.when(s % 5 == 0, "r2").otherwise("r1").alias("rubric_id"), F.when(s % 4 == 0, "odd").otherwise("satisfied").alias("status"), F.array(F.when(s % 9 == 0, "e9").otherwise("e1")).alias("evidence"))
    rows = read(spark, sf_dir, "part").select("p_partkey", F.when(s % 7 == 0, "odd").otherwise("valid").alias("judge_status"), F.array(F.lit("r1")).alias("rubric_ids"), F.array(a).alias("assessments"), F.create_map(F.lit("a"), F.when(s % 11 == 0, 3).otherwise(2)).alias("scores"), F.array(F.lit("e1")).alias("event_ids"))
    return judging.judge_violations(rows).select("p_partkey", F.array_join("broken", ",").alias("broken"))
