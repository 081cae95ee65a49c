"""Queries over token arrays, denied values and exclusions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arrays
from .catalog import query, read


@query("""SELECT p_partkey, (SELECT min(i) FROM (SELECT unnest(range(0, p_size % 7 + 1)) AS i) WHERE i = p_size % 7 OR i = p_size % 4)::INTEGER AS shared FROM part""")
def common_prefixes(spark, sf_dir):
    """ARR2: a run of numbers against one that differs at a place."""
    a = F.slice(F.sequence(F.lit(1), F.lit(10)), F.lit(1), F.col("p_size") % 7)
    b = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda x: F.when(x == F.col("p_size") % 4 + 1, -x).otherwise(x))
    return read(spark, sf_dir, "part").select("p_partkey", arrays.common_prefix(a, b).alias("shared"))


@query("""SELECT user_id, sum(CASE WHEN event_type = 'click' THEN event_id ELSE -100 END)::BIGINT AS labels FROM events GROUP BY user_id""")
def assistant_labels(spark, sf_dir):
    """ARR1: clicks are the assistant's tokens."""
    one = F.struct("event_id", F.when(F.col("event_type") == "click", "assistant").otherwise("user").alias("role"))
    rows = read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(one)).alias("e"))
    labels = arrays.assistant_labels(F.transform("e", lambda x: x["event_id"]), F.transform("e", lambda x: x["role"]))
    return rows.select("user_id", F.aggregate(labels, F.lit(0).cast("long"), lambda a, x: a + x).alias("labels"))


@query("""SELECT p_partkey, CASE WHEN 12 + p_size <= 40 THEN 0 WHEN 8 + p_size <= 40 THEN 4 WHEN 3 + p_size <= 40 THEN 9 END::INTEGER AS dropped FROM part""")
def dropped_prefixes(spark, sf_dir):
    """WN10: twelve tokens in three groups of four, five and three."""
    mask = F.lit([1, 1, 0, 0, 1, 0, 0, 0, 0, 1, 1, 0])
    return read(spark, sf_dir, "part").select("p_partkey", arrays.drop_leading_groups(mask, mask, F.col("p_size"), 40).alias("dropped"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 3 THEN true END AS stated FROM part""")
def stated_values(spark, sf_dir):
    """STR8: said, not said, denied, denied once and said once."""
    s = F.col("p_size") % 4
    text = F.when(s == 0, "很防水的表").when(s == 1, "表").when(s == 2, "不支持防水，无防水").otherwise("不含防水盒，防水")
    return read(spark, sf_dir, "part").select("p_partkey", arrays.stated(text, F.lit("防水")).alias("stated"))


@query("""SELECT DISTINCT doc_id FROM (SELECT doc_id FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id FROM documents WHERE lang = 'en') WHERE doc_id IS NOT NULL""")
def exclusions(spark, sf_dir):
    """SET2."""
    return arrays.excluded([read(spark, sf_dir, "labels").filter("toxic = 1"), read(spark, sf_dir, "documents").filter("lang = 'en'")], "doc_id")


@query("""SELECT count(n_chars) AS n, count(*) FILTER (n_chars > 3000) AS over, sum(n_chars)::BIGINT AS total, round(avg(n_chars), 6) AS mean, min(n_chars) AS least, max(n_chars) AS most, quantile_disc(n_chars, 0.95) AS p95 FROM documents""")
def token_audits(spark, sf_dir):
    """X13, NUM21."""
    return arrays.token_audit(read(spark, sf_dir, "documents"), "n_chars", 3000).withColumn("mean", F.round("mean", 6)).withColumn("p95", F.col("p95").cast("long"))


@query("""SELECT p_partkey, list_filter([900.0, 950.0, 1000.0, 1100.0, 1500.0, 2500.0], lambda s: s > p_retailprice)[1:2]::DOUBLE[] AS steps FROM part""")
def price_ladders(spark, sf_dir):
    """NUM16."""
    return read(spark, sf_dir, "part").select("p_partkey", arrays.price_steps(F.col("p_retailprice"), [900, 950, 1000, 1100, 1500, 2500], 2).alias("steps"))


@query("""SELECT p_partkey, 'a|n|' || p_name || '|t|s|' || p_size || '|t|' || p_type || '|b|' || p_brand AS words FROM part""")
def flat_texts(spark, sf_dir):
    """RET4, STR11."""
    json = F.to_json(F.struct(F.col("p_brand").alias("b"), F.struct(F.col("p_name").alias("n"), F.array(F.struct(F.col("p_size").alias("s"), F.col("p_type").alias("t"))).alias("t")).alias("a")))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(arrays.flat_text(json), "|").alias("words"))
