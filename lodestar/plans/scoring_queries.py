"""Queries over option, brand and constraint scoring: parts as products, each by a case of its number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rows import spread
from ..operators import options, products, scoring
from .catalog import query, read

_OPTIONS = "map<string,array<struct<value:string,price:double>>>"


def _parts(spark: SparkSession, sf_dir: str, cases: list[tuple], schema: str) -> DataFrame:
    """Parts with the case (a row of a dozen) of their number."""
    table = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"c int, {schema}")
    return spread(read(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_partkey").withColumn("c", (F.col("p_partkey") % len(cases)).cast("int")).join(F.broadcast(table), "c")


_SIZES = {"尺码": [("S", 0.0), ("Ｌ", 2.0)]}
_PRICES = [
    (_SIZES, {"size": "l"}, []), (_SIZES, {}, []), (_SIZES | {"颜色": [("红", 1.0), ("蓝", 3.0)]}, {"尺码": "S", "颜色": "红"}, []), (_SIZES, {"尺码": "L"}, [({"size": "L"}, 5.0)]),
    ({"尺码": [("S", 4.0), ("L", 4.0)]}, {}, []), ({}, {}, []), ({"尺码": [("S", None)]}, {"尺码": "S"}, []), ({"颜色": [("红", 1.0)], "颜色分类": [("红", 1.0)]}, {}, []), (_SIZES, {"尺码": "M"}, []), (_SIZES, {"尺码": "S", "鞋码": "S"}, []),
]


@query("""SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN p_retailprice + 2 WHEN 3 THEN p_retailprice + 5 WHEN 4 THEN p_retailprice + 4 WHEN 5 THEN p_retailprice END AS price,
 CASE p_partkey % 10 WHEN 0 THEN 'unique_effective_price_axis' WHEN 1 THEN 'effective_price_axis_unselected' WHEN 2 THEN 'multiple_effective_price_axes' WHEN 3 THEN 'full_variant_combination' WHEN 4 THEN 'constant_option_price'
  WHEN 5 THEN 'single_base_price' WHEN 6 THEN 'price_not_deterministic' WHEN 7 THEN 'invalid_option_axes' WHEN 8 THEN 'selected_variant_price_missing' ELSE 'invalid_option_axes' END AS method FROM part""")
def variant_prices(spark, sf_dir):
    """SC6, SC10, STR3: every rung of the ladder; option prices are what a case adds to the part's."""
    rows = _parts(spark, sf_dir, _PRICES, f"o {_OPTIONS}, s map<string,string>, k array<struct<options:map<string,string>,price:double>>")
    base = F.col("p_retailprice")
    o = F.transform_values("o", lambda _, vs: F.transform(vs, lambda v: F.struct(v["value"].alias("value"), (v["price"] + base).alias("price"))))
    k = F.transform("k", lambda c: F.struct(c["options"].alias("options"), (c["price"] + base).alias("price")))
    found = rows.select("p_partkey", options.resolve_price(o, F.col("s"), k, F.array(base)).alias("r"))
    return found.select("p_partkey", F.col("r")["price"].alias("price"), F.col("r")["method"].alias("method"))


_REQUIRED = [
    (_SIZES, {"size": "L"}, {"尺码": "l"}), (_SIZES, {"size": "L"}, {"尺码": "S"}), (_SIZES, {"color": "红"}, {}), (_SIZES, {"size": "XL"}, {"尺码": "XL"}), (_SIZES, {"size": "L"}, {}),
    ({"鞋码": [("40", None)]}, {"size": "40"}, {}), (_SIZES, {"size": "XL", "color": "红"}, {}), ({"颜色": [("红", 1.0)], "颜色分类": []}, {"color": "红"}, {"颜色": "红"}), (_SIZES | {"颜色": [("蓝", None), ("红", 9.0), ("青", 9.0)]}, {"size": "s"}, {}),
]


@query("""SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'unverifiable' WHEN 3 THEN 'fail' WHEN 4 THEN 'fail' WHEN 5 THEN 'pass' WHEN 6 THEN 'unverifiable' WHEN 7 THEN 'unverifiable' ELSE 'fail' END AS verdict,
 CASE p_partkey % 9 WHEN 2 THEN 'candidate_axis_missing' WHEN 3 THEN 'candidate_required_value_missing' WHEN 7 THEN 'candidate_axis_collision' END AS reason,
 CASE p_partkey % 9 WHEN 0 THEN '尺码=Ｌ' WHEN 1 THEN '尺码=Ｌ' WHEN 4 THEN '尺码=Ｌ' WHEN 5 THEN '鞋码=40' WHEN 8 THEN '尺码=S;颜色=红' ELSE '' END AS filled FROM part""")
def required_options(spark, sf_dir):
    """SC7, SC8, SC9."""
    rows = _parts(spark, sf_dir, _REQUIRED, f"o {_OPTIONS}, r map<string,string>, s map<string,string>")
    found = rows.select("p_partkey", options.required_verdict(F.col("o"), F.col("r"), F.col("s")).alias("verdict"), options.candidate_options(F.col("o"), F.col("r")).alias("f"))
    pairs = F.array_sort(F.transform(F.map_entries(F.col("f")["selected"]), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    reason = F.when(F.col("p_partkey") % 9 != 6, F.col("f")["reason"])  # of two bad values either may come first: a literal map has no order
    return found.select("p_partkey", "verdict", reason.alias("reason"), F.array_join(pairs, ";").alias("filled"))


_AXES_OF = [(["L", "红"], _SIZES | {"颜色": [("红", 1.0)]}), (["x"], _SIZES), (["红"], {"颜色": [("红", 1.0)], "规格": [("红", 1.0)]}), (["S", "L"], _SIZES)]


@query("""SELECT p_partkey, unnest(CASE p_partkey % 4 WHEN 0 THEN ['L>size', '红>color'] WHEN 1 THEN ['x>axis_not_found'] WHEN 2 THEN ['红>axis_ambiguous'] ELSE ['S>size', 'L>canonical_axis_collision'] END) AS found FROM part""")
def required_value_axes(spark, sf_dir):
    """SC25."""
    rows = _parts(spark, sf_dir, _AXES_OF, f"v array<string>, o {_OPTIONS}").select("p_partkey", F.explode(options.required_axes(F.col("v"), F.col("o"))).alias("x"))
    return rows.select("p_partkey", F.concat(F.col("x")["value"], F.lit(">"), F.coalesce(F.col("x")["axis"], F.col("x")["reason"])).alias("found"))


_UNITS = [({"规格": "抽纸50包"}, "包"), ({"规格": "整箱×24"}, "包"), ({"规格": "3x10 x 4"}, ""), ({"规格": "12平米"}, "平方米"), ({"规格": "50包装"}, "包"), ({"规格": "红"}, None)]


@query("""SELECT p_partkey, round(CASE p_partkey % 6 WHEN 0 THEN p_retailprice / 50 WHEN 1 THEN p_retailprice / 24 WHEN 2 THEN p_retailprice / 4 WHEN 3 THEN p_retailprice / 12 ELSE p_retailprice END, 6) AS price,
 CASE p_partkey % 6 WHEN 0 THEN 50 WHEN 1 THEN 24 WHEN 2 THEN 4 WHEN 3 THEN 12 END::INTEGER AS units FROM part""")
def unit_prices(spark, sf_dir):
    """NUM13, NUM14."""
    rows = _parts(spark, sf_dir, _UNITS, "s map<string,string>, u string")
    found = F.struct(F.lit("pass").alias("status"), F.col("p_retailprice").alias("price"), F.lit("m").alias("method"))
    return rows.select("p_partkey", F.round(options.price_for_basis(found, F.col("u"), F.col("s"))["price"], 6).alias("price"), options.unit_count(F.col("s"), F.col("u")).alias("units"))


_DIMENSIONS = [
    ({"size": "L", "color": "红"}, ["快充"], None), ({"size": "L", "color": "红"}, [], [("size", "L")]), ({}, [], None), ({"flavor": "甜"}, [], None), ({"size": "S"}, ["S"], [(None, "s")]),
]


@query("""SELECT p_partkey, round(CASE p_partkey % 5 WHEN 0 THEN 1.0 / 3 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 WHEN 3 THEN 0.0 ELSE 0.0 END, 6)::DOUBLE AS score, CASE p_partkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 WHEN 3 THEN 0.0 ELSE 1.0 END::DOUBLE AS coverage,
 p_partkey % 5 = 2 AS exact, p_partkey % 5 IN (1, 2) AS strict_exact FROM part""")
def option_dimensions(spark, sf_dir):
    """SC13, SC14, X30: selected L and blue."""
    rows = _parts(spark, sf_dir, _DIMENSIONS, "r map<string,string>, u array<string>, t array<struct<axis:string,value:string>>")
    o = F.from_json(F.lit('{"尺码":[{"value":"S"},{"value":"L"}],"颜色":[{"value":"红"},{"value":"蓝"}]}'), _OPTIONS)
    s = F.create_map(F.lit("尺码"), F.lit("L"), F.lit("颜色"), F.lit("蓝"))
    found = rows.select("p_partkey", options.option_dimension(o, F.col("r"), F.col("u"), F.col("t"), s).alias("d"))
    d = F.col("d")["dimension"]
    return found.select("p_partkey", F.round(d["score"], 6).alias("score"), d["coverage"].alias("coverage"), F.col("d")["exact"].alias("exact"), F.col("d")["strict_exact"].alias("strict_exact"))


@query("""SELECT p_partkey, (p_size % 3 + 1) * (p_size % 4 + 1) AS n FROM part WHERE (p_size % 3 + 1) * (p_size % 4 + 1) <= 8""")
def option_selections(spark, sf_dir):
    """FLT13."""
    values = lambda n: F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(i.cast("string").alias("value"), F.lit(1.0).alias("price")))
    o = F.create_map(F.lit("a"), values(F.col("p_size") % 3), F.lit("b"), values(F.col("p_size") % 4))
    rows = read(spark, sf_dir, "part").select("p_partkey", options.selections(o, 8).alias("s")).filter("s is not null")
    return rows.select("p_partkey", F.size(F.array_distinct(F.transform("s", lambda m: F.array_join(F.map_values(m), "|")))).cast("long").alias("n"))


_ALIASES = products.flat_aliases({"acme": ["ＡＣＭＥ 官方", "艾克米"], "bolt": ["bt"]})
_BRANDS = [
    ("Acme", "other", "acme", "x", []), ("Acme", "", "艾克米", "x", []), ("acme", None, None, "适用acme手机壳", []), ("acme", None, None, "适用acme 正品acme", []), ("bolt", "z", "", "y", ["BT"]), ("", "acme", "", "", []),
    ("acme", "acme官方店", "", "", []),
]


@query("""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'fail' WHEN 1 THEN 'pass' WHEN 2 THEN 'unverifiable' WHEN 3 THEN 'unverifiable' WHEN 4 THEN 'fail' WHEN 5 THEN 'unverifiable' ELSE 'fail' END AS verdict,
 CASE p_partkey % 7 WHEN 0 THEN 'pass' WHEN 1 THEN 'pass' WHEN 2 THEN 'fail' WHEN 3 THEN 'pass' WHEN 4 THEN 'pass' WHEN 5 THEN 'fail' ELSE 'pass' END AS evidence FROM part""")
def brand_verdicts(spark, sf_dir):
    """SC1, SC5, MAP1."""
    rows = _parts(spark, sf_dir, _BRANDS, "w string, b string, s string, t string, a array<string>")
    w, b, s, t, a = (F.col(x) for x in "wbsta")
    return rows.select("p_partkey", products.brand_verdict(w, b, s, _ALIASES).alias("verdict"), products.brand_evidence(w, b, s, t, a, _ALIASES).alias("evidence"))


_MODELS = [("gpt-4", None, "4 port gpt hub"), ("gpt-4", "", "new GPT-4 hub"), ("gpt-4", None, "gpt-40"), ("gpt-4", "gpt-5", "gpt-4"), ("型号a", "型号A", ""), ("型号a", None, "新型号a"), ("", "a", ""), ("a b", None, "A  B")]


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 1 THEN 'pass' WHEN 4 THEN 'pass' WHEN 7 THEN 'pass' WHEN 6 THEN 'unverifiable' ELSE 'fail' END AS verdict FROM part""")
def model_verdicts(spark, sf_dir):
    """SC2."""
    return _parts(spark, sf_dir, _MODELS, "w string, m string, t string").select("p_partkey", products.model_verdict(F.col("w"), F.col("m"), F.col("t")).alias("verdict"))


@query("""SELECT strength, count(*) AS n FROM (SELECT CASE WHEN event_type IN ('error') THEN 'hard' WHEN event_type = 'click' THEN 'soft' WHEN event_type = 'view' THEN 'ignore' ELSE 'hard' END AS strength, value FROM events) WHERE value < 150 AND strength <> 'ignore' GROUP BY 1""")
def scored_constraints(spark, sf_dir):
    """SC16, SC17."""
    e = F.col("event_type")
    rows = read(spark, sf_dir, "events").select(F.when(e == "error", "hard").when(e == "click", "soft").otherwise("odd").alias("strength"), F.when(e == "view", "gold_variant_reference").alias("role"), F.when(F.col("value") >= 150, "audit_only").alias("enforcement"))
    parts = [scoring.scored(rows, s).select(F.lit(s).alias("strength")) for s in ("hard", "soft")]
    return parts[0].unionByName(parts[1]).groupBy("strength").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, p_size > 10 AND p_retailprice / 1500 >= 0.7 AND p_size / 50 >= 0.75 AS ok FROM part""")
def acceptable_candidates(spark, sf_dir):
    """SC19."""
    hard = F.array(F.lit("pass"), F.when(F.col("p_size") > 10, "pass").otherwise("unverifiable"))
    return read(spark, sf_dir, "part").select("p_partkey", scoring.acceptable(hard, F.col("p_retailprice") / 1500, F.col("p_size") / 50).alias("ok"))
