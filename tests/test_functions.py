import random
import time

import pytest
from pyspark.sql import functions as F

from lodestar.functions import measures, numbers, price, text
from lodestar.operators import options, scoring
from lodestar.plans import python_queries


@pytest.mark.parametrize(
    "said, value",
    [("三百", 300), ("两千五", 2500), ("一万二", 12000), ("两万三千五", 23500), ("一千零五", 1005), ("一百三", 130), ("十五", 15), ("一百零三", 103), ("二十", 20), ("三点五", 3.5), ("一亿二千万", 120_000_000), ("三千二百五", 3205)],
)
def test_chinese_amounts(said, value):
    assert price.chinese_amount(said) == pytest.approx(value)


@pytest.mark.parametrize("said, unit, value", [("1万2", None, 12000), ("3", "k", 3000), ("1.5", "万", 15000), ("3千500", None, 3500), ("12", None, 12)])
def test_amounts(said, unit, value):
    assert price.amount(said, unit) == pytest.approx(value)


@pytest.mark.parametrize(
    "said, kind, value, lower, upper",
    [
        ("不超过300元", "upper", 300, None, None), ("三百元到四百元", "range", None, 300, 400), ("300元左右", "around", 300, 240, 360), ("300多元", "preference", 300, None, None),
        ("至少50元", "lower", 50, None, None), ("预算200元", "upper", 200, None, None), ("价格在100元以上", "lower", 100, None, None),
    ],
)
def test_price_expressions(said, kind, value, lower, upper):
    (e,) = price.expressions(said)
    assert (e.kind, e.value, e.lower, e.upper) == (kind, value, lower, upper)


@pytest.mark.parametrize("said", ["", None, "没有要求", "运费20元以内", "5个左右"])
def test_no_price(said):
    assert price.expressions(said) == []


def test_constraint_reduction(spark):
    rows = spark.createDataFrame([(0, "高于80元，不超过120元"), (1, "低于120元"), (2, "300多元"), (3, "每包价格约1.5元"), (4, "高于200元，不超过120元")], "i int, t string").withColumn("f", price.extract_prices("t"))
    got = {r.i: r for r in rows.select("i", price.constraint(F.col("f")).alias("c"), price.budget(F.col("f")).alias("b"), price.basis(F.col("t")).alias("u")).collect()}
    assert (got[0].c.operator, got[0].c.min, got[0].c.max) == ("between", 80, 120)
    assert (got[1].c.operator, got[1].c.value) == ("lt", 120)
    assert got[2].c is None and got[4].c is None
    assert got[3].u == "包" and got[3].c.operator == "approximately"


def test_tokens_and_normal_forms(spark):
    rows = spark.createDataFrame([("连衣裙 GPT-4 12.5 红 连衣裙",), ("ＡＢＣ，300 RMB",), ("",), (None,)], "t string").withColumn("q", text.normalize_query("t"))
    got = [r for r in rows.select("q", text.tokens(F.col("q")).alias("k"), text.normalize_option("t").alias("o")).collect()]
    assert got[0].k == ["连衣", "衣裙", "红", "gpt-4", "12.5"]
    assert got[1].q == "abc 300元" and got[1].o == "abc,300rmb"
    assert got[2].k == [] and got[3].k == []


def test_semantic_ladder():
    match = lambda a, b: text.texts_match(a, b, {"毛衣": "针织衫", "针织衫": "针织衫"})
    assert match("纯棉", "100%纯棉面料") and match("毛衣", "女士针织衫") and match("棉质材质", "棉质") and match("abcdefgh", "abcdefgx")
    assert not match("羊毛", "纯棉") and not match("", "x")


def test_units_and_steps(spark):
    df = spark.createDataFrame([(0, "500ml 瓶, 1.5kg 3cm 2x"), (45, "")], "n int, t string")
    a, b = df.select(numbers.measurements(F.col("t")).alias("m"), numbers.step_penalty(F.col("n")).alias("p")).collect()
    assert [(m.dimension, m.amount) for m in a.m] == [("volume_ml", 500), ("mass_g", 1500), ("length_mm", 30)]
    assert a.p == 0 and b.p == pytest.approx(-1.05)


def test_rank_bucket_rejects_zero(spark):
    with pytest.raises(Exception, match="rank below 1"):
        spark.range(1).select(numbers.rank_bucket(F.lit(0))).collect()


def test_failure_wins_over_unverifiable(spark):
    rows = spark.createDataFrame([("a", "hard", "fail"), ("a", "hard", "unverifiable"), ("b", "hard", "unverifiable"), ("c", "soft", "fail"), ("c", "soft", "pass"), ("c", "hard", "pass"), ("d", "hard", "pass"), ("d", "soft", "fail"), ("e", "soft", "pass"), ("f", "hard", "pass"), ("f", "needs_review", "unverifiable")], "k string, strength string, status string")
    out = scoring.terminal_class(scoring.combine(rows, "k"), F.col("k") == "d", F.lit(0))
    got = {r.k: (r.reward_type, r.utility) for r in out.collect()}
    assert got == {"a": ("wrong_purchase", -1.0), "b": ("reward_unverifiable", 0.0), "c": ("partial_alternative_purchase", 0.65), "d": ("gold_purchase", 1.0), "e": ("wrong_purchase", -1.0), "f": ("reward_unverifiable", 0.0)}


def test_variant_price_ladder(spark):
    schema = "i int, o map<string,array<struct<value:string,price:double,is_available:boolean>>>, s map<string,string>, c array<struct<options:map<string,string>,price:double>>, b array<double>"
    two = {"size": [("S", 10.0, True), ("L", 12.0, None)]}
    rows = [(0, two, {"size": "L"}, [({"size": "L"}, 11.0)], [9.0]), (1, two, {"size": "L"}, [], [9.0]), (2, {"size": [("S", 7.0, True)]}, {}, [], []), (3, {}, {}, [], [9.0]), (4, {}, {}, [], [9.0, 10.0])]
    df = spark.createDataFrame(rows, schema)
    got = {r.i: r.p for r in df.select("i", options.resolve_price(F.col("o"), F.col("s"), F.col("c"), F.col("b"))["price"].alias("p")).collect()}
    assert got == {0: 11.0, 1: 12.0, 2: 7.0, 3: 9.0, 4: None}
    assert df.select(scoring.cheapest_options(F.col("o")).alias("x")).first().x == {"size": "S"}


@pytest.mark.parametrize("text, found", [("12 34.5 678, " * 80_000, 0), ("plain words 3 " * 70_000, 0), ("预算不超过300元，" + "字 1 " * 100_000, 1), ("1" * 1_000_000 + ".", 0), ("三" * 300_000 + "点元", 0), (("价格" + " " * 2000 + "x5") * 400, 0), ("亿" * 300_000, 0)])
def test_long_texts_are_read_once(text, found):
    began = time.process_time()
    assert len(price.expressions(text)) == found
    measures.bounds(text)
    assert time.process_time() - began < 10


def test_a_line_break_is_no_part_of_a_price():
    (e,) = price.expressions("红色\n300元左右")
    assert e.text == "300元左右" and e.start == 3


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *row[1:]]
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_length_against_a_table():
    rng = random.Random(5)
    for _ in range(400):
        a, b = ("".join(rng.choice("ab c红") for _ in range(rng.randint(0, 90))) for _ in range(2))
        assert text.common_length(a, b) == longest(a, b)


@pytest.mark.parametrize("a, b, want", [("fuzzy was a bear", "fuzzy fuzzy was a bear", 100), ("red ring", "Red  ring!", 100), ("red", "blue ring red", 100), ("", "x", 0), (None, None, 0), ("...", "x", 0), ("abc", "abd", 67), ("abc x", "abd x", 80), ("ab", "cd", 0)])
def test_token_set_ratio(a, b, want):
    assert text.token_set_ratio(a, b) == text.token_set_ratio(b, a) == want


def test_name_ratios(spark):
    rows = {r.p_partkey: r for r in python_queries.name_ratios(spark, "/root/testdata/sf0.001").collect()}
    names = {r.p_partkey: r.p_name for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect()}
    assert len(rows) == len(names) and {r.with_type for r in rows.values()} == {100}
    for k, r in rows.items():
        a, b = set(names[k].split()), set((names.get(k - 1) or "").split())
        own, other, both = (" ".join(sorted(x)) for x in (a - b, b - a, a & b))
        if not b or both and not (own and other):
            assert r.with_before == (100 if b else 0)
        else:
            full = [" ".join(x for x in (both, y) if x) for y in (own, other)]
            near = lambda x, y, lcs: 100 * 2 * lcs / (len(x) + len(y))
            best = [near(*full, (len(both) + 1 if both else 0) + longest(own, other))] + ([near(both, f, len(both)) for f in full] if both else [])
            assert r.with_before == round(max(best))
