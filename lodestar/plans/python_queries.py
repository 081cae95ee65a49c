"""Queries whose operators need Python; the tests hold them against plain versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, price, text
from ..functions.rows import small_batches
from ..operators import selection
from ..streaming import tracker

#: Requests in the price language, invented here.
REQUESTS = (
    "预算不超过300元", "三百元到四百元之间", "价格300元左右", "300多元就行", "每包价格约1.5元", "预算两千五以内", "价格低于1万2元", "至少50元的礼盒",
    "大约一百三块钱", "预算200元，运费20元", "高于80元低于120元", "3k元以下", "没有价格要求",
)


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests, and the text of every document (with ``doc_id`` in place of ``request_id``)."""
    own = small_batches(spark).createDataFrame(list(enumerate(REQUESTS)), "request_id int, text string").withColumn("doc_id", F.lit(None).cast("long"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.unionByName(docs, allowMissingColumns=True)


def price_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NUM6 to NUM9."""
    return _requests(spark, sf_dir).select("request_id", "doc_id", F.explode(price.extract_prices("text")).alias("e")).select("request_id", "doc_id", "e.*")


def price_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NUM10 to NUM12."""
    rows = _requests(spark, sf_dir).select("request_id", "doc_id", "text", price.extract_prices("text").alias("found"))
    return rows.select("request_id", "doc_id", price.budget(F.col("found")).alias("budget"), price.constraint(F.col("found")).alias("want"), price.basis(F.col("text")).alias("unit"))


def normalized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET1, RET2, STR1, STR2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.normalize_query("text").alias("q"), text.normalize_option("source").alias("source"))
    return docs.select("doc_id", F.sha2("q", 256).alias("normal_sha256"), F.size(text.tokens(F.col("q"))).alias("n_tokens"), "source")


def semantic_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR7: parts whose name matches a requirement."""
    match = text.semantic_match({"ring": "band", "band": "band"})
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", match(F.lit("red ring"), F.col("p_name")).alias("matches"))


def name_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR26: every part's name against its type and name, and against the name of the part before it."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    before = part.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_name").alias("before"))
    rows = part.join(before, "p_partkey", "left")
    return rows.select("p_partkey", text.fuzzy_ratio("p_name", F.concat_ws(" ", "p_type", "p_name")).alias("with_type"), text.fuzzy_ratio("p_name", "before").alias("with_before"))


def greedy_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM10: turns over priority bands, with quotas and a cap on orders of a customer.  With one
    order a customer only the best of each customer in a band can be taken (orders without a customer
    have no cap), and of these no more than the total of a band: the group in Python is bounded, and
    nothing is lost."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("band"), "o_totalprice")
    order, total = [F.desc("o_totalprice"), "o_orderkey"], 100
    own = selection.top_per_group(orders.filter("o_custkey is not null"), ["band", "o_custkey"], order, 1)
    best = selection.top_per_group(own.unionByName(orders.filter("o_custkey is null")), ["band"], order, total)
    ordered = best.withColumn("cost", -F.col("o_totalprice"))
    quotas = {"1-URGENT": 40, "2-HIGH": 30, "3-MEDIUM": 20, "4-NOT SPECIFIED": 20, "5-LOW": 10}
    take = selection.capped_round_robin(quotas, {"o_custkey": 1}, total)
    return selection.greedy(ordered, ["cost", "o_orderkey"], "o_orderkey long, o_custkey long, band string, o_totalprice double, cost double", take).drop("cost")


def session_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1, ST5 in batch: events as actions."""
    e = F.col("event_type")
    ids = F.when(e.isin("click", "view"), F.array((F.floor("value").cast("long") + 10_000_000).cast("string"))).otherwise(F.array().cast("array<string>"))
    actions = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("pos"), F.when(e == "view", "search").otherwise(e).alias("action_name"), F.get_json_object("props", "$.k").alias("action_argument"),
        ids.alias("visible_asins"), F.lit(None).cast("string").alias("page_type"), F.lit(None).cast("map<string,string>").alias("selected_options"), F.array().cast("array<string>").alias("constraint_evidence"),
    )
    return tracker.track(actions)


def measured_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NUM3: measurements in part descriptions."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    described = F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit("cm 净重 1.5kg"))
    return part.select("p_partkey", F.explode(numbers.measurements(described)).alias("m")).select("p_partkey", "m.dimension", "m.amount")


QUERIES = {f.__name__: f for f in (price_expressions, price_constraints, normalized_texts, semantic_matches, name_ratios, greedy_selection, session_progress, measured_texts)}
