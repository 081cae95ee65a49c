"""Options met by what a product shows."""

import pytest

from lodestar.operators import visible


@pytest.mark.parametrize(
    "required, evidence, selected, shown, request_, want",
    [
        ("深灰色", ["深灰色"], ["F511【枫叶深灰色】"], [], "", visible.SHOWN), ("M", ["M"], ["M【推荐90-110斤】"], [], "", visible.SHOWN), ("M", None, ["XM"], [], "", None),
        ("红色", None, ["黑色"], ["红色外壳"], "", None), ("红色", None, ["款式一"], ["红色外壳"], "", visible.SHOWN), ("3罐装", None, ["5罐装"], ["3罐装"], "", None), ("3罐装", None, ["标准"], ["3罐装"], "", visible.SHOWN),
        ("12厘米", None, ["10cm"], [], "15厘米以下的刀", visible.MEASURED), ("12厘米", None, ["18cm"], [], "15厘米以下的刀", None), ("12厘米", None, ["10cm"], [], "一把刀", None), ("20厘米", None, ["10cm"], [], "15厘米以下的刀", None),
        ("500ml", None, ["0.48L"], [], "500ml左右", visible.MEASURED), (None, None, [None, " "], [None], None, None), ("", [], ["x"], ["y"], "z", None),
    ],
)
def test_matches(required, evidence, selected, shown, request_, want):
    assert visible.shown_match(required, evidence, selected, shown, request_, {}) == want


def test_nulls_and_repeats(spark):
    rows = [("红色", None, None, ["红色外壳"], None), ("红色", None, None, ["红色外壳"], None), (None, None, None, None, None), ("蓝色", ["蓝色"], ["天蓝色"], None, "x")]
    df = spark.createDataFrame(rows, "r string, e array<string>, s array<string>, p array<string>, q string")
    got = [r[0] for r in df.select(visible.visible_match()("r", "e", "s", "p", "q")).collect()]
    assert got == [visible.SHOWN, visible.SHOWN, None, visible.SHOWN]
    assert df.limit(0).select(visible.visible_match()("r", "e", "s", "p", "q")).count() == 0
