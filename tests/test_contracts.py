import math

import pytest

from lodestar.functions import measures
from lodestar.operators import contracts, selection


def test_bounds_of_a_request():
    said = lambda t: [(b.operator, b.dimension, b.text) for b in measures.bounds(t)]
    assert said("不超过5升以内") == [("lte", "volume", "不超过5升"), ("lte", "volume", "5升以内")]
    assert said("10cm到12cm以内") == [("between", "length", "10cm到12cm")]
    assert said("5克-3克以上") == [("gte", "weight", "3克以上")] and said("1米-5克") == [] == said(None) == said("")
    assert said("至少2个，最大到 3 米 左右") == [("lte", "length", "最大到 3 米"), ("gte", "count", "至少2个"), ("around", "length", "3 米 左右")]
    (b,) = measures.bounds("20ML上下")
    assert math.isclose(b.low, 0.018) and math.isclose(b.high, 0.022) and math.isclose(b.value, 0.02)


def test_guards_of_rows_and_targets(spark):
    rows = spark.createDataFrame([(1, 2), (2, 0), (3, None)], "id int, wins int")
    contracts.assert_every(rows.filter("id = 1"), rows["wins"] > 0, "wins")
    with pytest.raises(ValueError, match="wins"):
        contracts.assert_every(rows, rows["wins"] > 0, "wins")
    assert contracts.residual_targets({"a": 5, "b": 2}, {"a": 5}) == {"a": 0, "b": 2}
    with pytest.raises(ValueError, match="above"):
        contracts.residual_targets({"a": 5}, {"b": 1})


def test_nearest_feasible_columns():
    rows, wish = {"r": 6, "s": 4}, {"long": 2, "short": 5, "medium": 3}
    wide = {(r, c): 9 for r in rows for c in wish}
    target, cells = selection.feasible_columns(wide, rows, {}, wish, {"long": range(0, 5), "short": range(0, 8)})
    assert target == wish and sum(cells.values()) == 10
    scarce = wide | {("r", "long"): 0, ("s", "long"): 1}
    target, cells = selection.feasible_columns(scarce, rows, {}, wish, {"long": range(0, 5), "short": range(0, 8)})
    assert target["long"] == 1 and sum(n for (_, c), n in cells.items() if c == "short") == target["short"]
    assert sum(abs(target[k] - wish[k]) for k in wish) == 2
    with pytest.raises(ValueError, match="no column"):
        selection.feasible_columns({k: 0 for k in wide}, rows, {}, wish, {"long": range(0, 5), "short": range(0, 8)})


def test_edges_of_contract_columns(spark):
    df = spark.createDataFrame([("nan",), ("x",), (None,), (" 3 ",), ("1e999",)], "p string")
    assert [r[0] for r in df.select(contracts.explicit_price(df.p)["status"]).collect()] == ["unverifiable"] * 3 + ["pass", "unverifiable"]
    one = spark.range(1)
    from pyspark.sql import functions as F

    assert one.select(contracts.guarded_text(F.lit(None).cast("string"), ["[m]"], 5), contracts.guarded_text(F.lit("ab   cdef"), [], 4)).first()[:] == ("", "ab…")
    assert one.select(contracts.argument_objects(F.lit(None).cast("array<string>")), contracts.argument_objects(F.array(F.lit("")))).first()[:] == (True, False)
