"""Queries over contracts of tasks and runs: parts, orders and events stand in for tasks, runs and observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import measures
from ..operators import contracts, requests
from .catalog import query, read


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '{"action":"search","argument":"size ' || p_size || ' 元"}' WHEN 1 THEN '{"action":"click","argument":"b' || p_size || '"}' ELSE '{"action":"open","argument":""}' END AS signature FROM part""")
def action_signatures(spark, sf_dir):
    """STR21."""
    s = F.col("p_size") % 3
    name = F.when(s == 0, "search").when(s == 1, " Click ").otherwise("OPEN")
    n = F.col("p_size").cast("string")
    said = F.when(s == 0, F.concat(F.lit(" Size， "), n, F.lit("！ 元"))).when(s == 1, F.concat(F.lit(" B"), n, F.lit(" ")))
    return read(spark, sf_dir, "part").select("p_partkey", contracts.action_signature(name, said).alias("signature"))


@query("""SELECT p_partkey, sha256('{"brand":"' || p_brand || '","size":"' || p_size || '"}') AS digest FROM part""")
def canonical_digests(spark, sf_dir):
    """STR19."""
    fields = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"))
    return read(spark, sf_dir, "part").select("p_partkey", F.sha2(contracts.canonical_map(fields), 256).alias("digest"))


@query("""SELECT p_partkey, CASE WHEN length(t) <= 24 THEN t ELSE rtrim(left(t, 23)) || '…' END AS shown, coalesce(CASE WHEN contains(p_name, 'red') THEN 'red' WHEN contains(p_name, 'green') THEN 'green' END, p_name) AS colour
 FROM (SELECT p_partkey, p_name, '(memory) ' || p_name || ' 按钮：' AS t FROM part)""")
def guarded_texts(spark, sf_dir):
    """STR12, STR15."""
    text = F.concat(F.lit(" [memory]\t "), F.col("p_name"), F.lit("  按钮: "))
    return read(spark, sf_dir, "part").select("p_partkey", contracts.guarded_text(text, ("[memory]", "按钮:"), 24).alias("shown"), contracts.first_listed(F.col("p_name"), ("red", "green")).alias("colour"))


@query("""SELECT p_partkey, p_size % 4 = 0 AS intact, CASE WHEN p_size % 5 IN (0, 1) THEN 'pass' ELSE 'unverifiable' END AS price_status FROM part""")
def intact_contracts(spark, sf_dir):
    """SC21, X32: hashes of the text, of another one, missing, and of an empty text."""
    s = F.col("p_size") % 4
    text = F.when(s == 3, F.lit("")).otherwise(F.col("p_name"))
    own = F.sha2(text, 256)
    price = F.when(F.col("p_size") % 5 == 0, F.lit("0")).when(F.col("p_size") % 5 == 1, F.lit("12.5")).when(F.col("p_size") % 5 == 2, F.lit("-1")).when(F.col("p_size") % 5 == 3, F.lit("inf"))
    intact = contracts.instruction_intact(text, own, F.when(s == 1, F.sha2(F.concat(text, F.lit("x")), 256)).when(s != 2, own))
    return read(spark, sf_dir, "part").select("p_partkey", intact.alias("intact"), contracts.explicit_price(price)["status"].alias("price_status"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'C1' WHEN 1 THEN 'C2' WHEN 2 THEN 'C3' ELSE 'c2' END AS id FROM part""")
def candidate_slots(spark, sf_dir):
    """No entry, the first taken, the first two taken, all taken (the second seen longest ago)."""
    entry = lambda name, seen: F.struct(F.lit(name).alias("candidate_id"), F.lit(seen).alias("last_seen_step"))
    every = F.array(entry("C3", 4), entry("C1", 7), entry("c2", 4))
    s = F.col("p_size") % 4
    held = F.when(s == 1, F.slice(every, 2, 1)).when(s == 2, F.slice(every, 2, 2)).when(s == 3, every)
    return read(spark, sf_dir, "part").select("p_partkey", contracts.next_candidate_id(held, 3).alias("id"))


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'budget_upper:lte:hard:explicit_upper_budget_rule' WHEN 1 THEN 'price_lower:gte:hard:explicit_lower_price_rule' WHEN 2 THEN 'price_range:between:hard:explicit_price_range_rule'
 WHEN 3 THEN 'price_preference:approximately:soft:approximate_price_preference_rule' ELSE 'price_preference:approximately:soft:open_ended_price_preference_rule' END AS rubric FROM part""")
def price_rubrics(spark, sf_dir):
    """Its kinds."""
    s = F.col("p_size") % 5
    kind = F.when(s == 0, "upper").when(s == 1, "lower").when(s == 2, "range").when(s == 3, "around").otherwise("preference")
    found = read(spark, sf_dir, "part").select("p_partkey", contracts.price_rubric(kind, s == 4).alias("r"))
    return found.select("p_partkey", F.concat_ws(":", *[F.col("r")[n] for n in ("constraint_type", "operator", "hardness", "source")]).alias("rubric"))


@query("""SELECT p_partkey, p_size % 4 IN (0, 3) AS renderable, CASE p_size % 3 WHEN 0 THEN 'Reward-X_API_KEY;secret' WHEN 1 THEN '' ELSE 'Password' END AS secrets, CASE p_size % 3 WHEN 0 THEN 'reward' ELSE '' END AS training FROM part""")
def checked_payloads(spark, sf_dir):
    """X42, JSN9, FLT16."""
    s, t = F.col("p_size") % 4, F.col("p_size") % 3
    args = F.when(s == 0, F.array(F.lit('{"query": "a"}'), F.lit(None).cast("string"))).when(s == 1, F.array(F.lit("{}"), F.lit("[1]"))).when(s == 2, F.array(F.lit("{bad")))
    body = F.when(t == 0, '{"a": [{"secret": 1}, {"b": {"Reward-X_API_KEY": "", "reward": 2}}]}').when(t == 1, "{bad").otherwise('[[{"Password": null, "secrets": 1}]]')
    secrets = contracts.keys_found(contracts.SECRETS, contracts.SECRET_SUFFIX, fold=True)(body)
    training = contracts.keys_found(contracts.NOT_FOR_TRAINING)(body)
    return read(spark, sf_dir, "part").select("p_partkey", contracts.argument_objects(args).alias("renderable"), F.array_join(secrets, ";").alias("secrets"), F.array_join(training, ";").alias("training"))


@query("""SELECT user_id, count(*) AS observations, count(*) FILTER (event_type = 'click') AS truncated_count, sum(event_id % 50)::BIGINT AS raw_tokens, sum(event_id % 40)::BIGINT AS visible_tokens,
 max(event_id % 50) AS max_raw_tokens, max(event_id % 40) AS max_visible_tokens, sum(event_id % 3)::BIGINT AS asins, sum(event_id % 5)::BIGINT AS buttons, bool_or(event_type = 'click') AS any_truncated,
 arg_max(event_type = 'click', event_id) AS latest_truncated, count(*) FILTER (event_id % 7 = 0) AS footer_failures FROM events GROUP BY user_id""")
def projection_counters(spark, sf_dir):
    """ST4: events as observations."""
    e = F.col("event_id")
    rows = read(spark, sf_dir, "events").select("user_id", e, (e % 50).alias("raw_tokens"), (e % 40).alias("visible_tokens"), (F.col("event_type") == "click").alias("truncated"), (e % 3).alias("asins"), (e % 5).alias("buttons"), (e % 7 != 0).alias("footer_kept"))
    return contracts.projection_totals(rows, "user_id", "event_id")


@query("""WITH first AS (SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS g, arg_min(trim(o_orderpriority), o_orderkey) AS q FROM orders WHERE o_custkey % 3 > 0 GROUP BY o_custkey)
 SELECT p_partkey AS task_id, c_custkey AS asin, g AS goal_order, CASE WHEN g IS NOT NULL THEN CASE WHEN g % 4 = 0 THEN '' ELSE q END END AS query,
 CASE WHEN c_custkey IS NULL THEN 'outside_pool' WHEN g IS NULL THEN 'no_goal' WHEN g % 4 = 0 THEN 'no_instruction' END AS problem FROM part LEFT JOIN customer ON p_partkey = c_custkey LEFT JOIN first ON c_custkey = o_custkey""")
def facts_of_tasks(spark, sf_dir):
    """JN17: parts as task ids, customers as products, orders as goals."""
    tasks = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("task_id"))
    products = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ordinal"), F.col("c_custkey").alias("asin"))
    said = F.when(F.col("o_orderkey") % 4 == 0, F.lit("  ")).otherwise(F.col("o_orderpriority"))
    goals = read(spark, sf_dir, "orders").filter("o_custkey % 3 > 0").select(F.col("o_orderkey").alias("goal_order"), F.col("o_custkey").alias("asin"), said.alias("instruction_text"))
    return contracts.task_facts(tasks, products, goals)


@query("""SELECT DISTINCT o_custkey AS task_id FROM orders WHERE o_totalprice > 100000 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def accepted_tasks(spark, sf_dir):
    """Dear orders as accepted runs, a segment's customers as held out."""
    runs = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task_id"), "o_totalprice")
    out = read(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("task_id"))
    return contracts.accepted_ids(runs, out, F.col("o_totalprice") > 100000)


_SAID = ("容量不超过5升，高15厘米以下", "至少 2kg", "长10-12cm以内", "3个左右", "1升到500毫升以上", "红色", None, "直径最大为８寸")


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'lte:volume:5.0;lte:length:0.15' WHEN 1 THEN 'gte:weight:2.0' WHEN 2 THEN 'between:length:0.1-0.12' WHEN 3 THEN 'around:count:3.0' WHEN 4 THEN 'gte:volume:0.5' WHEN 7 THEN 'lte:cun:8.0' ELSE '' END AS said FROM part""")
def said_measures(spark, sf_dir):
    """NUM4."""
    k = F.col("p_partkey") % len(_SAID)
    text = F.element_at(F.array(*[F.lit(t) for t in _SAID]), (k + 1).cast("int"))
    amount = lambda b: F.coalesce(F.round(b["value"], 6).cast("string"), F.concat_ws("-", F.round(b["low"], 6).cast("string"), F.round(b["high"], 6).cast("string")))
    found = read(spark, sf_dir, "part").select("p_partkey", measures.said_bounds(text).alias("b"))
    return found.select("p_partkey", F.array_join(F.transform("b", lambda b: F.concat_ws(":", b["operator"], b["dimension"], amount(b))), ";").alias("said"))


_CLAUSES = ("不需要必须", "必须最好", "不要太贵", "不要红色", "约三百", "约会穿", None, "越轻便越好")


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'ambiguous_negative' WHEN 1 THEN 'mixed_hard_soft' WHEN 2 THEN 'soft_like' WHEN 3 THEN 'hard_like' WHEN 4 THEN 'soft_like' WHEN 7 THEN 'soft_like' ELSE 'contextual_marker' END AS class FROM part""")
def clause_classes(spark, sf_dir):
    """X26."""
    k = (F.col("p_partkey") % len(_CLAUSES) + 1).cast("int")
    return read(spark, sf_dir, "part").select("p_partkey", requests.clause_class(F.element_at(F.array(*[F.lit(t) for t in _CLAUSES]), k)).alias("class"))


_BRANDED = [
    ("要小米手机x20 750", "小米x20手机750", "小米官方旗舰店", "Mi,小米", "750,x20"), ("要海澜衬衫", "海澜之家衬衫x20", "海澜之家专卖店", "海澜", ""), ("要mi的", "手机", "mi店", "Mi", ""),
    ("要衬衫 A-1", "衬衫 a-1", "衬衫", "衬衫", "a-1"), (None, "小米", "小米店", "", ""), ("小米", "手机", None, "", ""),
]


@query("SELECT p_partkey, " + ", ".join("CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '{c[k]}'" for i, c in enumerate(_BRANDED)) + f" END AS {n}" for k, n in ((3, "brands"), (4, "models"))) + " FROM part")
def said_names(spark, sf_dir):
    """SC26."""
    k = (F.col("p_partkey") % len(_BRANDED) + 1).cast("int")
    of = lambda n: F.element_at(F.array(*[F.lit(c[n]) for c in _BRANDED]), k)
    brands = requests.said_brands(of(0), of(1), of(2), {"小米": "Mi", "mi": "Mi", "米": "Rice"})
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(brands, ",").alias("brands"), F.array_join(requests.said_models(of(0), of(1)), ",").alias("models"))
