"""Queries over feature operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import features
from .catalog import query, read


@query("""SELECT p_partkey, round(p_size % 7 + (p_size % 3) * 1.5 + least(p_size, 12) / 4.0 + length(p_name) / 45.0 + (1.0 - (p_size % 10) / 10.0) * 2.5, 6)::DOUBLE AS score FROM part""")
def difficulty_scores(spark, sf_dir):
    """NUM18."""
    s = F.col("p_size")
    score = features.difficulty(s % 7, s % 3, s, F.length("p_name"), (s % 10) / 10.0)
    return read(spark, sf_dir, "part").select("p_partkey", F.round(score, 6).alias("score"))


@query("""SELECT doc_id, (CASE WHEN n_chars > 3000 THEN 1 ELSE 0 END + CASE WHEN lang = 'en' THEN 1 ELSE 0 END + CASE WHEN contains(text, '|') THEN 1 ELSE 0 END)::INTEGER AS n,
 list_filter([CASE WHEN lang = 'en' THEN 'english' END, CASE WHEN n_chars > 3000 THEN 'long' END, CASE WHEN contains(text, '|') THEN 'table' END], lambda x: x IS NOT NULL) AS tags FROM documents""")
def feature_tags(spark, sf_dir):
    """FLT1, X17, X23, SM22."""
    flags = {"long": F.col("n_chars") > 3000, "english": F.col("lang") == "en", "table": F.contains("text", F.lit("|"))}
    return read(spark, sf_dir, "documents").select("doc_id", features.count_true(*flags.values()).alias("n"), features.tags(flags).alias("tags"))


@query("""SELECT p_partkey, left(sha256(regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') || '|' || regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') || '|'
 || left(regexp_replace(regexp_replace(lower(p_name || ' 2.5x' || p_size), '[0-9]+(\\.[0-9]+)?', '#', 'g'), '[^a-z0-9]', '', 'g'), 48)), 20) AS family FROM part""")
def family_ids(spark, sf_dir):
    """SM21."""
    category, shop = F.concat(F.lit("all›"), "p_type"), F.concat("p_brand", F.lit("官方旗舰店"))
    return read(spark, sf_dir, "part").select("p_partkey", features.family_id(category, shop, F.concat("p_name", F.lit(" 2.5x"), F.col("p_size").cast("string"))).alias("family"))


@query("""WITH l AS (SELECT user_id, coalesce(lag(event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id), false) AS f FROM events) SELECT user_id, count(*) FILTER (f) AS n FROM l GROUP BY user_id""")
def after_error(spark, sf_dir):
    """WN7."""
    return features.after_flag(read(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "error")


@query("SELECT user_id, max(event_id) FILTER (event_type = 'purchase') AS last FROM events GROUP BY user_id")
def last_terminal(spark, sf_dir):
    """WN14."""
    return features.last_of_kind(read(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "purchase")


@query("SELECT user_id, bool_or(event_type = 'view') AS viewed, bool_or(event_type = 'purchase') AS bought FROM events GROUP BY user_id")
def behaviour_flags(spark, sf_dir):
    """WN4, X21."""
    return features.coverage(read(spark, sf_dir, "events"), "user_id", "event_type", {"viewed": "view", "bought": "purchase"})


@query("""SELECT doc_id, count(DISTINCT s) AS sources FROM (SELECT doc_id, 'a' AS s FROM labels UNION ALL SELECT doc_id, 'b' FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 'c' FROM documents WHERE n_chars > 2000) GROUP BY doc_id HAVING count(DISTINCT s) > 1""")
def shared_ids(spark, sf_dir):
    """SET3."""
    docs = read(spark, sf_dir, "documents")
    return features.shared_keys({"a": read(spark, sf_dir, "labels"), "b": docs.filter("lang = 'en'"), "c": docs.filter("n_chars > 2000")}, "doc_id")


@query("SELECT p_brand, regexp_replace(lower(p_name), '[^a-z]', '', 'g') AS normal, count(DISTINCT p_name || p_size) AS n FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_name || p_size) > 1")
def name_collisions(spark, sf_dir):
    """FLT11."""
    part = read(spark, sf_dir, "part").withColumn("raw", F.concat("p_name", F.col("p_size").cast("string")))
    return features.collisions(part, ["p_brand"], "raw", F.regexp_replace(F.lower("p_name"), "[^a-z]", ""))


@query("""WITH r AS (SELECT user_id, bool_or(event_type = 'view') AS v, bool_or(event_type = 'click' AND value > 100) AS c, bool_or(event_type = 'purchase' AND value > 150) AS p FROM events GROUP BY user_id)
SELECT 'view' AS stage, count(*) FILTER (v) AS n FROM r UNION ALL SELECT 'click', count(*) FILTER (v AND c) FROM r UNION ALL SELECT 'purchase', count(*) FILTER (v AND c AND p) FROM r""")
def recovery_funnel(spark, sf_dir):
    """AG17."""
    e, v = F.col("event_type"), F.col("value")
    stages = [("view", e == "view"), ("click", (e == "click") & (v > 100)), ("purchase", (e == "purchase") & (v > 150))]
    return features.funnel(read(spark, sf_dir, "events"), "user_id", stages)


@query("""SELECT o_orderkey, list_filter([CASE WHEN NOT o_totalprice > 5000 THEN 'price' END, CASE WHEN NOT o_orderstatus IN ('F', 'O') THEN 'status' END], lambda x: x IS NOT NULL) AS broken FROM orders WHERE NOT (o_totalprice > 5000 AND o_orderstatus IN ('F', 'O'))""")
def invariant_audit(spark, sf_dir):
    """AG22, X14."""
    rows = features.violations(read(spark, sf_dir, "orders"), {"price": F.col("o_totalprice") > 5000, "status": F.col("o_orderstatus").isin("F", "O")})
    return rows.select("o_orderkey", "broken")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) - 1 AS n, count(*) OVER (PARTITION BY o_orderstatus) AS c FROM orders),
m AS (SELECT o_orderstatus, o_totalprice AS mid FROM r WHERE n = c // 2), k AS (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY abs(o_totalprice - mid), o_orderkey) AS k FROM orders JOIN m USING (o_orderstatus))
SELECT o_orderstatus, o_orderkey FROM k WHERE k = 1""")
def typical_cases(spark, sf_dir):
    """X36."""
    return features.typical(read(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice", "o_orderkey").select("o_orderstatus", "o_orderkey")


@query("SELECT doc_id, coalesce(quality = 1, false) AND coalesce(toxic = 0, false) AS ok FROM labels")
def strict_success(spark, sf_dir):
    """X1."""
    return read(spark, sf_dir, "labels").select("doc_id", features.strict(F.col("quality") == 1, F.col("toxic") == 0).alias("ok"))


@query("""SELECT p_partkey, p_name || ' ' || p_brand AS title, len(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_brand), '[a-z0-9]+'))) AS n FROM part""")
def distinct_words(spark, sf_dir):
    """RET2 on plain words."""
    title = F.concat("p_name", F.lit(" "), "p_brand")
    return read(spark, sf_dir, "part").select("p_partkey", title.alias("title"), F.size(F.array_distinct(text.words(title))).cast("long").alias("n"))
