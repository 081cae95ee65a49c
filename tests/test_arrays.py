import pytest
from pyspark.sql import functions as F

from lodestar.operators import arrays


def test_guards_fail_on_overlap_and_on_missing_rows(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(2, "x"), (3, "y")], "id long, v string")
    with pytest.raises(ValueError, match=r"held out: \[2\]"):
        arrays.assert_disjoint(a, b, "id", "held out")
    arrays.assert_disjoint(a.filter("id = 1"), b, "id", "held out")
    with pytest.raises(ValueError, match=r"\[1\]"):
        arrays.recover(a, b, "id")
    assert [r.v for r in arrays.recover(a.filter("id = 2"), b, "id").collect()] == ["x"]


def test_batches_keep_their_columns(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    assert arrays.concat_batches([a, a.select("y", "x")]).count() == 2
    with pytest.raises(ValueError, match="columns"):
        arrays.concat_batches([a, a.select("x")])


def test_rows_of_kept_groups_and_groups_to_retry(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "uid string, v int")
    kept = spark.createDataFrame([("a", None, False), ("b", "low_reward_variation", True), ("c", "sampling_invalid", False)], "uid string, drop_reason string, retryable boolean")
    stay, again = arrays.split_rewards(rows, "uid", kept)
    assert [r.uid for r in stay.collect()] == ["a"] and [r.uid for r in again.collect()] == ["b"]


def test_nested_texts_are_walked(spark):
    deep = "[" * 200 + '"x"' + "]" * 200
    rows = [('{"b": [1, {"z": null, "y": ["p", {}]}], "a": true, "b2": 2.5}',), (deep,), (None,), ("",), ("{bad",), ("null",), ('"t"',), ('{"k": 1, "k": 2}',)]
    df = spark.createDataFrame(rows, "j string").coalesce(1)
    got = [tuple(r) for r in df.select(arrays.flat_text(F.col("j")), arrays.flat_text(F.col("j"), by_key=False)).collect()]
    first = (["a", "True", "b", "1", "y", "p", "z", "b2", "2.5"], ["b", "1", "z", "y", "p", "a", "True", "b2", "2.5"])
    assert got == [first, (["x"], ["x"]), (None, None), (None, None), (None, None), ([], []), (["t"], ["t"]), (["k", "2"], ["k", "2"])]
