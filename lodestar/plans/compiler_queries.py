"""Queries that compile requests: each part is a product, its request is put together from its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clauses
from ..functions.rows import kept, spread
from ..operators import compiler, products, visible
from .catalog import query, read

COLOURS = ("红色", "黑色", "蓝色", "白色", "灰色")
_COLOUR = "['红色', '黑色', '蓝色', '白色', '灰色'][p_size % 5 + 1]"
#: A request by SQL: what is bought, a word about the colour by key, a budget, for every second size a clause nobody can score.
_PIECES = f"""list_filter(['购买' || p_type, CASE p_partkey % 4 WHEN 0 THEN '必须是' || {_COLOUR} WHEN 1 THEN '最好是' || {_COLOUR} WHEN 2 THEN {_COLOUR} || '也可以' ELSE '不要' || {_COLOUR} END,
 '预算不超过' || (100 + p_size * 10) || '元', CASE WHEN p_size % 2 = 0 THEN '不需要售后' END], lambda x: x IS NOT NULL)"""


def requests_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, with what ``compile_contracts`` reads."""
    colour = F.element_at(F.array(*map(F.lit, COLOURS)), F.col("p_size") % 5 + 1)
    kind = F.col("p_partkey") % 4
    said = F.when(kind == 0, F.concat(F.lit("必须是"), colour)).when(kind == 1, F.concat(F.lit("最好是"), colour)).when(kind == 2, F.concat(colour, F.lit("也可以"))).otherwise(F.concat(F.lit("不要"), colour))
    pieces = [F.concat(F.lit("购买"), "p_type"), said, F.concat(F.lit("预算不超过"), (F.col("p_size") * 10 + 100).cast("string"), F.lit("元")), F.when(F.col("p_size") % 2 == 0, F.lit("不需要售后"))]
    listed = F.array(*[F.struct(F.lit(c).alias("value"), F.lit(1.0).alias("price")) for c in COLOURS])
    none = F.lit(None)
    return spread(read(spark, sf_dir, "part"), "p_partkey").select(
        "p_partkey", "p_type", "p_brand", "p_name", "p_size", F.concat_ws("，", *pieces).alias("request"), F.concat(F.lit("parts › "), "p_type").alias("category"), F.col("p_name").alias("title"), none.cast("string").alias("shop"),
        none.cast("string").alias("description"), none.cast("array<string>").alias("attributes"), F.array(colour).alias("wanted"), F.create_map(F.lit("颜色分类"), listed).alias("options"),
    )


@query(f"""SELECT p_partkey, i, p[i] AS clause FROM (SELECT p_partkey, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT p_partkey, list_concat({_PIECES}, ['绝对不要' || p_brand, '最好要' || p_name]) AS p FROM part))""")
def request_clauses(spark, sf_dir):
    """STR23: the clauses of each request; the last two have no punctuation between them."""
    rows = requests_of_parts(spark, sf_dir)
    whole = F.concat("request", F.lit("；"), F.lit("绝对不要"), "p_brand", F.lit("但最好要"), "p_name", F.lit("。"))
    said = rows.select("p_partkey", clauses.segments(whole).alias("s"))
    return said.select("p_partkey", F.posexplode("s").alias("i", "s")).select("p_partkey", (F.col("i") + 1).cast("long").alias("i"), F.col("s.text").alias("clause"))


#: Other words for types of parts; one letter is too short to count.
TYPE_ALIASES = products.flat_aliases({"new": ["promo", "New Arrival"], "small": ["economy", "mini"], "standard": ["old", "Ｒｅｄ"], "large": ["big"], "medium": ["M"]})


def parts_with_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, with the type of the next part by (size, key) as ``beside``: nulls first, after the last the first.  Ranges
    of that order are walked each for itself; the last part of a range takes the first of the next one."""
    order = ("p_size", "p_partkey", "p_type", "p_brand", "p_name")
    parts, n = read(spark, sf_dir, "part").select(*order), int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = kept(parts.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()), "ranged")
    here = rows.withColumn("after", F.lead(F.struct("p_type")).over(W.partitionBy("range").orderBy(*order)))
    # one row a range: the type that each begins with, and the one that the next begins with
    firsts = rows.groupBy("range").agg(F.min(F.struct(*order)).alias("first"))
    turn = W.orderBy("range")
    nexts = firsts.select("range", F.coalesce(F.lead("first").over(turn), F.first("first").over(turn))["p_type"].alias("next"))
    beside = F.when(F.col("after").isNotNull(), F.col("after.p_type")).otherwise(F.col("next"))
    return spread(here.join(F.broadcast(nexts), "range").withColumn("beside", beside), "p_partkey")


@query()
def evidence_spans(spark, sf_dir):
    """STR24: what each part's name holds of its own type and brand and of the type of its neighbour by size, whole,
    in parts, by an alias or aligned; a test holds it against a plain aligner.  ``evidence`` is what all steps find,
    ``spans`` is that without what only an alias finds."""
    values = F.array("p_type", "p_brand", F.concat(F.substring("p_name", 3, 9), F.lit("x")), F.reverse("p_name"), "beside")
    rows = parts_with_neighbours(spark, sf_dir).select("p_partkey", "p_name", values.alias("wanted"))
    found = rows.select("p_partkey", "p_name", "wanted", clauses.evidence_by_step(TYPE_ALIASES)("p_name", "wanted").alias("f"))
    pairs = found.select("p_partkey", "p_name", F.posexplode(F.arrays_zip("wanted", "f")).alias("i", "x"))
    texts = lambda steps: F.array_distinct(F.transform(steps, lambda s: s["text"]))
    return pairs.select("p_partkey", "p_name", "i", F.col("x.wanted").alias("value"), texts(F.filter("x.f", lambda s: s["step"] != "alias")).alias("spans"), texts(F.col("x.f")).alias("evidence"))


_CONTRACT = f"""
WITH b AS (SELECT *, {_PIECES} AS p, {_COLOUR} AS colour, p_partkey % 4 AS k FROM part), r AS (
 SELECT p_partkey, 1 AS n, 'category' AS constraint_type, 'hard_gate' AS role, NULL AS axis, 'parts › ' || p_type AS expected, 'hard' AS strength, 'require' AS polarity, 'scored' AS enforcement, 'category_contract' AS semantics_reason,
  p[1] AS query_quote, p_type AS evidence, '' AS optional FROM b
 UNION ALL SELECT p_partkey, 2, 'budget_upper', 'required_constraint', NULL, (100 + p_size * 10) || '.0', 'hard', 'require', 'scored', 'explicit_hard_boundary', p[3], p[3], '' FROM b
 UNION ALL SELECT p_partkey, 3, 'option', CASE WHEN k IN (0, 3) THEN 'strict_query_variant' ELSE 'query_preference_reference' END, 'color', colour, ['hard', 'soft', 'ignore', 'hard'][k + 1], ['require', 'prefer', 'indifferent', 'forbid'][k + 1],
  ['scored', 'scored', 'audit_only', 'scored'][k + 1], ['explicit_hard_require_marker', 'explicit_soft_preference', 'explicit_indifference', 'explicit_forbid_marker'][k + 1], p[2],
  CASE WHEN k IN (0, 3) THEN colour ELSE '' END, CASE WHEN k IN (1, 2) THEN colour ELSE '' END FROM b
 UNION ALL SELECT p_partkey, 4, 'query_clause', 'query_semantic_audit', NULL, p[4], 'needs_review', 'unknown', 'audit_only', 'ambiguous_negation', p[4], p[4], '' FROM b WHERE p_size % 2 = 0)
SELECT * REPLACE ('q' || lpad(n::VARCHAR, 4, '0') AS n) FROM r"""


@query(_CONTRACT)
def compiled_contracts(spark, sf_dir):
    """SC22, SC23, SC24, STR25, X34: the constraints of every part's request."""
    rows = compiler.compile_contracts(requests_of_parts(spark, sf_dir))
    c = compiler.constraints(rows, "p_partkey", "price_upper")
    shown = F.when(F.col("constraint_type") == "budget_upper", F.col("price_upper").cast("string")).otherwise(F.col("expected"))
    return c.select(
        "p_partkey", F.col("constraint_id").alias("n"), "constraint_type", "role", "axis", shown.alias("expected"), "strength", "polarity", "enforcement", "semantics_reason", "query_quote",
        F.array_join("query_evidence", "|").alias("evidence"), F.array_join("optional_query_evidence", "|").alias("optional"),
    )


@query("SELECT p_partkey, p_size % 3 <> 0 AS intact FROM part")
def recompiled_contracts(spark, sf_dir):
    """Contracts compiled anew; every third request says something else by then."""
    stored = compiler.compile_contracts(requests_of_parts(spark, sf_dir)).drop("contract")
    now = stored.withColumn("request", F.when(F.col("p_size") % 3 == 0, F.concat("request", F.lit("，至少5斤"))).otherwise(F.col("request")))
    return compiler.recompiled(now, "contract_sha256").select("p_partkey", "intact")


@query("""WITH p AS (SELECT p_partkey, p_name, p_size, 1 + p_size % 7 AS n, 1 + p_partkey % 7 AS m, p_partkey % 3 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN CASE WHEN n = m THEN 'public_query_option_visible_evidence_v3' END WHEN 1 THEN CASE WHEN n = m THEN 'public_query_option_visible_evidence_v3' END
 ELSE CASE WHEN n = m THEN 'public_query_option_visible_evidence_v3' WHEN m <= 4 AND n <= 4 THEN 'instruction_numeric_option_constraint_v1' END END AS matched FROM p""")
def visible_options(spark, sf_dir):
    """SC12: a required number of boxes that the selection (k = 0) or the product (k = 1) shows, unless another number
    was chosen; or a length that the request bounds (k = 2)."""
    n, m, k = (F.col("p_size") % 7 + 1).cast("string"), (F.col("p_partkey") % 7 + 1).cast("string"), F.col("p_partkey") % 3
    text = lambda number, unit: F.concat(number, F.lit(unit))
    required = F.when(k == 2, text(n, "0cm")).otherwise(text(n, "盒装"))
    selected = F.when(k == 2, text(m, "0cm")).otherwise(text(m, "盒装"))
    shown = F.when(k == 1, F.array("p_name", required)).otherwise(F.array("p_name"))
    rows = read(spark, sf_dir, "part").select("p_partkey", required.alias("r"), F.array(required).alias("e"), F.array(selected).alias("s"), shown.alias("p"), F.lit("长度不超过40厘米").alias("q"))
    return rows.select("p_partkey", visible.visible_match()("r", "e", "s", "p", "q").alias("matched"))
