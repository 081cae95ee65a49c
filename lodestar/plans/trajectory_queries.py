"""Queries over trajectories: ten events of a user in a row are the steps of one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import trajectories as tr
from .catalog import query, read

_PAGE = '1|10000000|a|\n2|10000001|b|\n可点击的按钮: ["Buy Now", "Next >", "opt_0000000000000000", "opt_0000000000000001", "opt_0000000000000002"]'
_BASE = """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn, json_extract_string(props, '$.k')::INT AS k FROM events),
e AS (SELECT user_id * 100000 + rn // 10 AS t, (rn % 10)::INTEGER AS pos, event_type AS kind, value AS v, k,
 CASE event_type WHEN 'view' THEN 'click[' || (10000000 + k % 3) || ']' WHEN 'click' THEN 'search[q' || k % 2 || ']' WHEN 'signup' THEN 'click[opt_000000000000000' || k % 5 || ']' WHEN 'purchase' THEN 'click[buy now]' ELSE 'click[next >]' END AS act FROM n),
w AS (SELECT *, lag(act) OVER o AS pact, lag(k) OVER o AS pk, lag(kind) OVER o AS pkind, lag(v) OVER o AS pv FROM e WINDOW o AS (PARTITION BY t ORDER BY pos))
"""


def _step(e):
    """A step of an event (pos, k, v, kind)."""
    kind, k, bad = e["kind"], e["k"], (e["kind"] == "error") & (e["v"] > 300)
    asin, opt = (10000000 + k % 3).cast("string"), F.concat(F.lit("opt_000000000000000"), (k % 5).cast("string"))
    tool = F.when(kind == "view", "open_product").when(kind == "click", "search_products").when(kind == "signup", "select_option").when(kind == "purchase", "buy_now").otherwise("next_page")
    arguments = F.when(kind == "view", F.concat(F.lit('{"asin": "'), asin, F.lit('"}'))).when(kind == "click", F.concat(F.lit('{"query": "q'), (k % 2).cast("string"), F.lit('"}')))
    arguments = arguments.when(kind == "signup", F.concat(F.lit('{"value":"'), opt, F.lit('"}'))).when(k % 29 == 28, "[1").otherwise("")
    action = F.when(kind == "view", F.concat(F.lit("click["), asin, F.lit("]"))).when(kind == "click", F.concat(F.lit("search[q"), (k % 2).cast("string"), F.lit("]")))
    action = action.when(kind == "signup", F.concat(F.lit("click["), opt, F.lit("]"))).when(kind == "purchase", "click[Buy  Now]".replace("  ", " ")).otherwise("click[Next >]")
    call = F.concat(F.lit("c"), e["pos"].cast("string"))
    return F.struct(
        *[e[n].alias(n) for n in ("pos", "k", "v", "kind")], tool.alias("tool_name"), action.alias("env_action"), call.alias("call_id"), tool.alias("call_name"), arguments.alias("arguments"), F.lit(_PAGE).alias("observation"),
        F.concat(F.lit('{"s":'), (k % 2).cast("string"), F.lit("}")).alias("state"), F.when(bad, "boom").alias("error"), F.lit(False).alias("done"), (kind == "purchase").alias("over"), F.lit(False).alias("purchase"),
        F.when(k % 3 > 0, k.cast("long")).alias("raw_tokens"), F.when(k % 3 > 0, F.floor(k / 2).cast("long")).alias("visible_tokens"), (e["v"] > 100).alias("truncated"), (k % 2 == 0).alias("footer"), e["v"].alias("latency"),
    )


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, steps, messages, blocked, calls, k of the first event)."""
    w = W.partitionBy("user_id").orderBy("event_id")
    e = read(spark, sf_dir, "events").withColumn("rn", F.row_number().over(w) - 1).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    e = e.select((F.col("user_id") * 100000 + F.floor(F.col("rn") / 10)).alias("t"), (F.col("rn") % 10).alias("pos"), F.col("event_type").alias("kind"), F.col("value").alias("v"), "k")
    # only what differs is shuffled; the rest of a step is made of it after
    slim = e.groupBy("t").agg(F.sort_array(F.collect_list(F.struct("pos", "k", "v", "kind"))).alias("steps"))
    rows = slim.withColumn("steps", F.transform("steps", _step))
    none = F.array().cast("array<string>")
    pair = lambda s: F.array(
        F.struct(F.lit("assistant").alias("role"), F.concat(F.lit("say "), s["call_id"]).alias("content"), F.array(s["call_id"]).alias("call_ids"), F.lit(None).cast("string").alias("call_id"), F.lit(False).alias("guard")),
        F.struct(F.lit("tool").alias("role"), s["observation"].alias("content"), none.alias("call_ids"), s["call_id"].alias("call_id"), F.lit(False).alias("guard")),
    )
    user = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit(" instruction:  buy "), F.col("t").cast("string")).alias("content"), none.alias("call_ids"), F.lit(None).cast("string").alias("call_id"), F.lit(False).alias("guard")))
    stopped = F.transform(F.filter("steps", lambda s: s["k"] % 7 == 0), lambda s: F.struct(F.when(s["k"] % 2 == 0, s["pos"]).otherwise(-1).alias("step_index"), F.concat(F.lit("b"), s["pos"].cast("string")).alias("call_id"), F.lit("open_product").alias("call_name"), F.lit("{}").alias("arguments"), F.lit("schema_missing_arguments:asin").alias("reason")))
    return rows.withColumn("messages", F.concat(user, F.flatten(F.transform("steps", pair)))).withColumn("blocked", stopped)


def _reward(t):
    return F.struct(
        F.when(t % 5 != 4, tr.REWARD).alias("reward_version"), F.when(t % 3 != 2, tr.GOLD).otherwise("wrong_purchase").alias("reward_type"), (t % 7 != 6).alias("reward_valid"),
        F.when(t % 2 == 0, True).alias("purchase_success"), F.when(t % 4 != 3, tr.GOLD).alias("termination_reason"),
    )


_GATES = _BASE + """, x AS (SELECT t,
 array_to_string(list_filter([CASE WHEN t % 11 = 10 THEN 'has_error' END, CASE WHEN t % 13 = 12 THEN 'environment_not_done' END, CASE WHEN NOT bool_or(kind = 'purchase') THEN 'missing_buy' END, CASE WHEN t % 5 = 4 THEN 'reward_v4_required' END,
  CASE WHEN t % 3 = 2 THEN 'reward_v4_not_gold_purchase' END, CASE WHEN t % 7 = 6 THEN 'reward_v4_invalid' END], lambda c: c IS NOT NULL), ',') AS result,
 array_to_string(list_filter([CASE WHEN t % 4 = 1 THEN 'trajectory_not_done' END, CASE WHEN t % 2 = 1 THEN 'purchase_not_successful' END, CASE WHEN t % 4 = 3 THEN 'termination_not_gold_purchase' END], lambda c: c IS NOT NULL), ',') AS warnings,
 array_to_string(list_filter([CASE WHEN t % 9 = 8 OR bool_or(kind <> 'click' AND pos = 0) OR bool_or(kind = 'view' AND k % 3 = 2) OR bool_or(kind = 'signup' AND k % 5 > 2) OR bool_or(kind IN ('purchase', 'error') AND k % 29 = 28) THEN 'process_invalid_action' END,
  CASE WHEN bool_or(kind = 'error' AND v > 300) THEN 'process_step_error' END,
  CASE WHEN NOT coalesce(bool_or(kind = 'view' AND pos > a AND pos < b), false) THEN 'process_missing_search_open_buy_path' END,
  CASE WHEN coalesce(bool_or(act = pact AND NOT (k % 2 = pk % 2 AND kind <> 'purchase' AND NOT (kind = 'error' AND (v > 300 OR pv > 300)))), false) THEN 'process_consecutive_duplicate_action' END], lambda c: c IS NOT NULL), ',') AS process
 FROM (SELECT *, min(pos) FILTER (kind = 'click') OVER (PARTITION BY t) AS a, max(pos) FILTER (kind = 'purchase') OVER (PARTITION BY t) AS b FROM w) GROUP BY t)
"""


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    rows = _steps(spark, sf_dir).withColumn("reward", _reward(t)).withColumn("done", t % 13 != 12).withColumn("over", F.lit(True))
    rows = rows.withColumn("result", tr.result_gate(F.when(t % 11 == 10, "x"), F.col("done"), F.col("over"), F.col("steps"), F.col("reward")))
    rows = rows.withColumn("process", tr.process_gate(F.col("steps"), F.col("messages"), F.when(t % 9 == 8, 1).otherwise(0)))
    return rows.withColumn("warnings", tr.consistency_warnings(F.lit("done"), t % 4 != 1, F.lit(None), F.col("reward")))


@query(_GATES + "SELECT t, result, process, warnings, CASE WHEN result <> '' THEN result ELSE process END AS reasons FROM x")
def trajectory_gates(spark, sf_dir):
    """FLT4, FLT5, FLT6, FLT7, FLT8, FLT9, WN2, WN5, WN15, X2, JSN5."""
    rows = _gated(spark, sf_dir).withColumn("a", tr.acceptance(F.col("result"), F.col("process")))
    listed = lambda c: F.array_join(c, ",")
    return rows.select("t", listed("result").alias("result"), listed("process").alias("process"), listed("warnings").alias("warnings"), listed(F.col("a")["reasons"]).alias("reasons"))


@query(_GATES + """, g AS (SELECT t, t % 50 AS task, CASE WHEN result <> '' THEN result ELSE process END AS reasons FROM x),
h AS (SELECT *, task % 10 = 9 AS held FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY task, reasons = '' AND NOT held ORDER BY t) AS place FROM h)
SELECT CASE WHEN reasons <> '' THEN reasons WHEN held THEN 'held_out_task' WHEN place > 1 THEN 'duplicate_task' ELSE 'accepted' END AS why, count(*) AS n FROM r GROUP BY 1""")
def collection_plan(spark, sf_dir):
    """PL1, PL2: what becomes of every trajectory, in order of arrival; its counts."""
    rows = _gated(spark, sf_dir).select("t", (F.col("t") % 50).alias("task_id"), tr.acceptance(F.col("result"), F.col("process"))["reasons"].alias("reasons"))
    held = rows.filter("task_id % 10 = 9").select("task_id")
    out = tr.collect(rows, held, "t")
    return out.groupBy(F.when(F.col("accepted"), "accepted").otherwise(F.array_join("reject_reasons", ",")).alias("why")).agg(F.count(F.lit(1)).alias("n"))


@query(_BASE + """SELECT t, 1 + 2 * count(*) FILTER (NOT coalesce(act = pact AND k % 2 = pk % 2 AND kind <> 'purchase' AND NOT (kind = 'error' AND (v > 300 OR pv > 300)), false)) AS messages,
 (count(*) FILTER (kind = 'purchase') > 0)::INTEGER AS closings, 'c' || max(pos) FILTER (kind = 'purchase') AS closing FROM w GROUP BY t""")
def training_rows(spark, sf_dir):
    """PL3, FLT14, FLT15, WN14: blocked calls have no messages here, idle repeats lose theirs."""
    rows = _steps(spark, sf_dir).select(F.col("t").alias("trajectory_id"), F.col("t").alias("task_id"), "steps", "messages", "blocked", F.lit(True).alias("done"), F.lit(True).alias("over"))
    out = tr.training_row(rows).join(rows.select("trajectory_id", tr.terminal_call(F.col("done"), F.col("over"), F.col("steps")).alias("closing")), "trajectory_id")
    return out.select(F.col("trajectory_id").alias("t"), F.size("messages").cast("long").alias("messages"), F.size(F.filter("messages", lambda m: m["content"] == tr.CLOSING)).alias("closings"), "closing")


_EVENTS = _BASE + """, b AS (SELECT t, pos AS no, CASE WHEN k % 2 = 0 THEN pos ELSE 999 END AS spot FROM e WHERE k % 7 = 0),
a AS (SELECT t, pos AS spot, 1 AS kind, pos AS no FROM e UNION ALL SELECT t, spot, 0, no FROM b), o AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY spot, kind, no) AS place FROM a)
"""


@query(_EVENTS + """SELECT t, 'e' || lpad(place::VARCHAR, 4, '0') AS event_id, CASE kind WHEN 1 THEN 'c' || no ELSE 'b' || no END AS call_id, CASE kind WHEN 1 THEN 'say c' || no ELSE '' END AS said FROM o""")
def trajectory_events(spark, sf_dir):
    """WN8, JN16, JSN2."""
    rows = _steps(spark, sf_dir).select("t", F.explode(tr.events(F.col("steps"), F.col("blocked"), F.col("messages"))).alias("e"))
    return rows.select("t", F.col("e")["event_id"].alias("event_id"), F.col("e")["call_id"].alias("call_id"), F.col("e")["text"].alias("said"))


@query(_EVENTS + """, g AS (SELECT t, count(*) AS blocked FROM b GROUP BY t), s AS (SELECT o.t, o.place, e.act FROM o JOIN e ON o.kind = 1 AND o.t = e.t AND o.no = e.pos UNION ALL SELECT t, place, 'blocked' FROM o WHERE kind = 0),
d AS (SELECT t, count(*) - count(DISTINCT act) AS again, count(*) FILTER (act = p) AS consecutive FROM (SELECT *, lag(act) OVER (PARTITION BY t ORDER BY place) AS p FROM s) GROUP BY t)
SELECT e.t AS t, count(*)::INTEGER AS executed, (count(*) + coalesce(max(blocked), 0))::INTEGER AS attempts, (count(*) FILTER (kind = 'click'))::INTEGER AS searches, (greatest(0, count(*) FILTER (kind = 'click') - count(DISTINCT k % 2) FILTER (kind = 'click')))::INTEGER AS repeated_searches,
 (count(DISTINCT k % 3) FILTER (kind = 'view'))::INTEGER AS opened_candidates, (CASE WHEN bool_or(kind = 'click') THEN 2 ELSE 0 END)::INTEGER AS visible_candidates, max(again)::INTEGER AS repeated_actions, max(consecutive)::INTEGER AS consecutive_actions,
 coalesce(max(blocked), 0)::INTEGER AS schema_rejections, (count(*) FILTER (kind = 'error' AND v > 300))::INTEGER AS step_errors, coalesce(sum(k) FILTER (k % 3 > 0), 0)::BIGINT AS raw_tokens, (count(*) FILTER (k % 3 > 0 AND v > 100))::INTEGER AS truncated,
 (count(*) FILTER (k % 3 > 0 AND k % 2 = 1))::INTEGER AS footer_failures, (count(*) FILTER (kind IN ('purchase', 'error') AND k % 29 = 28))::INTEGER AS malformed, round(sum(v), 4) AS tool_seconds
 FROM e LEFT JOIN g ON g.t = e.t JOIN d ON d.t = e.t GROUP BY e.t""")
def trajectory_metrics(spark, sf_dir):
    """AG6, AG7, X2."""
    rows = _steps(spark, sf_dir).select("t", tr.metrics(tr.events(F.col("steps"), F.col("blocked"), F.col("messages"))).alias("m"))
    names = ("executed", "attempts", "searches", "repeated_searches", "opened_candidates", "visible_candidates", "repeated_actions", "consecutive_actions", "schema_rejections", "step_errors", "raw_tokens", "truncated", "footer_failures", "malformed")
    return rows.select("t", *[F.col("m")[n].alias(n) for n in names], F.round(F.col("m")["tool_seconds"], 4).alias("tool_seconds"))


@query(_BASE + """SELECT t, count(*)::INTEGER AS calls, sum(k) FILTER (k % 4 <> 0)::DOUBLE AS prompt, sum(v) FILTER (k % 4 = 1) AS completion, round(sum(CASE WHEN k % 4 = 2 THEN 7 WHEN k % 4 = 1 THEN k + v WHEN k % 4 = 3 THEN k END), 6)::DOUBLE AS total,
 NULL::DOUBLE AS cached, round(coalesce(sum(v) FILTER (v >= 100), 0), 4) AS seconds FROM e GROUP BY t""")
def model_call_totals(spark, sf_dir):
    """AG8."""
    k, v, none = lambda s: s["k"].cast("double"), lambda s: s["v"], F.lit(None).cast("double")
    call = lambda s: F.struct(
        F.when(s["k"] % 4 == 1, k(s)).alias("prompt_tokens"), F.when(s["k"] % 4 > 1, k(s)).alias("input_tokens"), none.alias("completion_tokens"), F.when(s["k"] % 4 == 1, v(s)).alias("output_tokens"),
        F.when(s["k"] % 4 == 2, F.lit(7.0)).alias("total_tokens"), none.alias("cached"), F.lit(-1.0).alias("cached_tokens"), F.when(v(s) >= 100, v(s)).otherwise(-1.0).alias("latency"),
    )
    rows = _steps(spark, sf_dir).select("t", tr.call_totals(F.transform("steps", call)).alias("c"))
    return rows.select("t", "c.calls", "c.prompt", "c.completion", F.round("c.total", 6).alias("total"), "c.cached", F.round("c.seconds", 4).alias("seconds"))


@query(_BASE + """SELECT t, count(*)::INTEGER AS total, (count(*) FILTER (kind = 'error'))::INTEGER AS failed, array_to_string(list_concat(CASE WHEN t % 2 = 0 AND t % 3 = 0 THEN ['missing_or_unexpected_query_constraint_version'] ELSE [] END,
  coalesce(list('constraint_result_' || pos || '_invalid_status' ORDER BY pos) FILTER (kind = 'signup'), []),
  CASE WHEN t % 5 = 0 THEN CASE WHEN t % 2 = 0 THEN ['missing_constraint_summary'] ELSE [] END WHEN t % 5 = 1 THEN ['constraint_summary_mismatch'] ELSE [] END), ',') AS issues FROM e GROUP BY t""")
def constraint_checks(spark, sf_dir):
    """AG9, X5."""
    t = F.col("t")
    kinds = F.transform("steps", lambda s: F.when(s["kind"] == "error", "fail").when(s["kind"] == "signup", "odd").when(s["kind"] == "view", "unverifiable").otherwise("pass"))
    of = lambda s: F.size(F.filter("r", lambda x: x == s))
    rows = _steps(spark, sf_dir).select("t", kinds.alias("r"))
    declared = F.when(t % 5 != 0, F.create_map(F.lit("pass"), of("pass") + F.when(t % 5 == 1, 1).otherwise(0), F.lit("fail"), of("fail"), F.lit("unverifiable"), of("unverifiable")))
    rows = rows.select("t", tr.constraint_check(F.when(t % 2 == 0, tr.REWARD), F.when(t % 3 != 0, "shopping-query-constraints-v1"), F.col("r"), F.size("r"), declared).alias("c"))
    return rows.select("t", "c.total", F.col("c.counts")["fail"].alias("failed"), F.array_join("c.issues", ",").alias("issues"))


@query(_BASE + """, g AS (SELECT t, count(*) AS n FROM e GROUP BY t) SELECT t, CASE WHEN t % 2 = 0 THEN 'wants ' || t ELSE 'buy ' || t END AS query, t % 3 = 0 AS done, CASE WHEN t % 5 = 0 THEN 0.5 WHEN t % 5 = 1 THEN 0.25 ELSE 0.0 END::DOUBLE AS reward,
 CASE WHEN t % 4 = 0 THEN 'gold_purchase' WHEN t % 4 = 1 THEN 'max_steps' ELSE '' END AS reason, t % 6 IN (1, 2, 3) AS infrastructure FROM g""")
def terminal_views(spark, sf_dir):
    """X11, X12, X40, PL5."""
    t = F.col("t")
    view = tr.terminal_view(F.when(t % 3 == 0, True), F.lit(None), F.when(t % 5 == 0, 0.5), F.when(t % 5 < 2, 0.25), F.when(t % 4 == 0, tr.GOLD).otherwise(""), F.when(t % 4 == 1, "max_steps"))
    fails = tr.infrastructure_failure(F.when(t % 6 == 1, True), F.when(t % 6 == 2, "TimeoutError").when(t % 6 == 4, "ValueError"), F.when(t % 6 == 3, "x"))
    rows = _steps(spark, sf_dir).select("t", tr.query_text(F.when(t % 2 == 0, F.concat(F.lit(" wants "), t.cast("string"))), F.col("messages")).alias("query"), view.alias("v"), fails.alias("infrastructure"))
    return rows.select("t", "query", "v.done", "v.reward", F.col("v.termination_reason").alias("reason"), "infrastructure")
