"""Byte ranges give the places and objects that a plain reader finds."""

import json

import pytest

from lodestar.sources import ranges


@pytest.fixture
def small(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(k) for k in keys]
    for k, v in zip(keys, ("150", "1")):
        spark.conf.set(k, v)
    yield
    for k, v in zip(keys, old):
        spark.conf.set(k, v)


ITEMS = [{"a": i, "t": "x}{\"[\\]" * (i % 4) + "茶\n", "n": {"k": [{"z": 1}, {}, "}"], "e": {}}} for i in range(60)] + [{}, {"a": 7, "t": "\\"}, {"long": "y" * 900}]


@pytest.mark.parametrize("indent", [None, 2])
def test_objects_and_places(spark, tmp_path, small, indent):
    for name, items in (("one", ITEMS), ("two", ITEMS[:3]), ("none", [])):
        (tmp_path / f"{name}.json").write_text(json.dumps(items, ensure_ascii=indent is None, indent=indent) + "\n", encoding="utf-8")
    rows = ranges.array_objects(spark, str(tmp_path)).collect()
    for name, items in (("one", ITEMS), ("two", ITEMS[:3]), ("none", [])):
        raw = (tmp_path / f"{name}.json").read_bytes()
        got = sorted((r for r in rows if r.file.endswith(f"{name}.json")), key=lambda r: r.task_id)
        assert [json.loads(r.value) for r in got] == items and [r.task_id for r in got] == list(range(len(items)))
        assert [json.loads(raw[r.offset : r.offset + r.length]) for r in got] == items
    read = ranges.read_array(spark, str(tmp_path / "one.json"), "a long, t string").collect()
    assert {r.task_id: (r.a, r.t) for r in read} == {i: (x.get("a"), x.get("t")) for i, x in enumerate(ITEMS)}


@pytest.mark.parametrize("text", ['{"a": 1}', '[{"a": 1}', '[{"a": 1}, 5]', '[7, {"a": 1}]', '[{"a": 1}, {"b"', '[{"a": "}', "[", "5"])
def test_bad_arrays_fail(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match="is no JSON array|no object|no end|cut short"):
        ranges.array_objects(spark, str(tmp_path / "bad.json")).collect()


def test_numbered_lines(spark, tmp_path, small):
    lines = [json.dumps({"k": i, "t": "é" * (i % 40)}, ensure_ascii=False) if i % 7 else ["", "  ", "{bad", "[1]"][i // 7 % 4] for i in range(1, 120)]
    raw = "\r\n".join(lines).encode()
    (tmp_path / "x.jsonl").write_bytes(raw)
    got = {r.line: r for r in ranges.numbered_lines(spark, str(tmp_path)).collect()}
    assert {n: r.value for n, r in got.items()} == {n: s for n, s in enumerate(lines, 1) if s.strip()}
    assert all(raw[r.offset : r.offset + r.length].decode() == r.value for r in got.values())
    assert {(r.line, r.value) for r in ranges.bad_objects(spark, str(tmp_path)).collect()} == {(n, s) for n, s in enumerate(lines, 1) if s in ("{bad", "[1]")}
