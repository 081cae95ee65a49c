import pytest
from pyspark.sql import functions as F

from lodestar.operators import products

SCHEMA = """task_id long, asin string, title string, brand string, shop_name string, category string, query string, attribute array<string>, small_description array<string>, pricing array<double>,
customization_options map<string,array<struct<value:string,price:double,is_available:boolean>>>"""


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [
        (0, "10000001", "Acme 耳机 GPT-4", "", "acme旗舰店", "数码›耳机", "earphones", ["无线"], ["降噪"], [], {"Color/Tint": [("Red/Pink", 10.0, True), ("Blue", 12.0, False)]}),
        (1, "10000001", "later copy", "x", "x", "x", "x", None, None, [1.0], None),
        (2, "nan", "no id", None, None, None, None, None, None, None, None),
        (3, "1" * 21, "long id", None, None, None, None, None, None, None, None),
        (4, "10000002", "毛衣 女", "Bolt", None, "服饰›毛衣", "sweater", None, ["纯棉"], [5.0, 9.0, 11.0], {"size": [("s", 5.0, None), ("l", 9.0, None)]}),
    ]
    return products.clean(spark.createDataFrame(rows, SCHEMA))


def test_clean(catalog):
    got = {r.asin: r for r in catalog.collect()}
    assert set(got) == {"10000001", "10000002"} and got["10000001"].task_id == 0
    assert got["10000001"].pricing == [100.0] and got["10000002"].pricing == [5.0, 9.0]
    assert [v.value for v in got["10000001"].customization_options["color | tint"]] == ["red | pink", "blue"]


def test_fields_and_search(catalog):
    f = {r.asin: r for r in products.fields(catalog).collect()}
    assert f["10000001"].brand == "acme旗舰店" and f["10000001"].model == "gpt-4" and f["10000001"].options == "color | tint red | pink 10.0"
    index = products.index(catalog)
    assert [r.asin for r in products.search(catalog, index, "无线耳机 gpt-4").collect()] == ["10000001"]
    assert [r.asin for r in products.search(catalog, index, "毛衣").collect()] == ["10000002"]
    assert [r.asin for r in products.search(catalog, index, "<c> 服饰›毛衣").collect()] == ["10000002"]
    assert products.search(catalog, index, "<r>").count() == 2
    with pytest.raises(ValueError):
        products.index(catalog, {"title": 1.0})


def test_verdicts(catalog):
    aliases = {"acme旗舰店": "acme"}
    out = catalog.select("asin", products.brand_verdict(F.lit("ACME"), F.col("brand"), F.col("shop_name"), aliases).alias("b"), products.model_verdict(F.lit("gpt-4"), F.lit(None).cast("string"), F.col("title")).alias("m"), products.range_mismatch(F.col("pricing"), F.col("customization_options")).alias("r"))
    got = {r.asin: (r.b, r.m, r.r) for r in out.collect()}
    assert got == {"10000001": ("pass", "pass", True), "10000002": ("fail", "fail", False)}
