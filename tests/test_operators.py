import itertools

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar.operators import evaluate, groups, selection, sequences
from lodestar.sources import tables
from lodestar.streaming import tracker


def test_group_filter_precedence(spark):
    rows = [("a", 0.0, False, False, True), ("a", 0.02, False, False, True), ("b", 0.0, False, False, False), ("b", 1.0, False, False, True), ("c", 0.0, True, False, False), ("c", 1.0, False, False, True), ("d", 0.0, True, True, False), ("d", 0.0, True, False, False)]
    df = spark.createDataFrame(rows, "uid string, u double, bad boolean, unknown boolean, won boolean")
    got = {r.uid: r.drop_reason for r in groups.group_verdicts(df, "uid", "u", "bad", "unknown", "won", 0.021).collect()}
    assert got == {"a": "low_reward_variation", "b": None, "c": "sampling_invalid", "d": "forbidden_trajectory_in_group"}
    kept = groups.varying_groups(df, "uid", utility="u", invalid="bad", unverifiable="unknown", success="won", tolerance=0.021, need_success=True)
    assert {r.uid for r in kept.collect()} == {"b"}


def test_suffix_budget_keeps_anchor_and_last(spark):
    df = spark.createDataFrame([(0, 10, True), (1, 50, False), (2, 30, False), (3, 200, False)], "pos int, n int, a boolean").withColumn("k", F.lit(1))
    got = {r.pos: r.kept for r in sequences.suffix_budget(df, "k", "pos", F.col("n"), 100, F.col("a")).collect()}
    assert got == {0: True, 1: False, 2: False, 3: True}


def test_round_robin_respects_caps():
    rows = pd.DataFrame({"band": list("aaabbb"), "seq": ["x", "x", "y", "x", "z", "z"], "i": range(6)})
    out = selection.capped_round_robin({"a": 2, "b": 2}, {"seq": 1}, 4)(rows)
    assert out["seq"].is_unique and set(out["i"]) == {0, 2, 4}


def test_max_flow_meets_what_it_can():
    supply = {("r1", "c1"): 2, ("r1", "c2"): 1, ("r2", "c1"): 1}
    out = selection.max_flow(supply, {"r1": 2, "r2": 1}, {"c1": 2, "c2": 1})
    best = max(sum(f) for f in itertools.product(range(3), range(2), range(2)) if f[0] + f[1] <= 2 and f[2] <= 1 and f[0] + f[2] <= 2)
    assert sum(out.values()) == best == 3


def test_nearest_without_replacement():
    match = selection.nearest_without_replacement(["d"], lambda row, c: (c["x"] - row["x"]).abs())
    old, new = pd.DataFrame({"d": ["a", "a"], "x": [1, 2]}), pd.DataFrame({"d": ["a", "a", "b"], "x": [2, 9, 1]})
    assert match(old, new) == [(0, 0), (1, 1)]


def test_overlay_and_transitions(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    assert sorted(map(tuple, evaluate.overlay(a, b, "k", ["v"]).collect())) == [(1, "x"), (2, "z")]
    assert sorted(map(tuple, evaluate.transitions(a, b, "k", "v").collect())) == [("missing", "w", 1), ("x", "missing", 1), ("y", "z", 1)]


def _actions():
    base = {"page_type": None, "selected_options": None, "constraint_evidence": []}
    search = {"action_name": "search", "action_argument": "a"}
    rows = [search | {"visible_asins": ["1", "2", "3"]}, search | {"visible_asins": ["1", "2", "3"]}, search | {"visible_asins": ["1", "2", "3"]}]
    return [base | r for r in rows]


def test_third_identical_action_ends_a_session():
    state = tracker.begin()
    out = [tracker.step(state, r) for r in _actions()]
    assert [o["subreason"] for o in out] == [None, None, "exact_action_repeat"]
    assert [len(o["credited"]) for o in out] == [1, 0, 0] and out[2]["idle"] == 2


def test_idle_steps_and_credit():
    state, base = tracker.begin(), {"page_type": None, "selected_options": None, "constraint_evidence": []}
    opened = [tracker.step(state, base | {"action_name": "click", "action_argument": f"1000000{i}", "visible_asins": []}) for i in range(6)]
    assert sum(len(o["credited"]) for o in opened) == 5 and all(o["progress"] for o in opened)
    idle = [tracker.step(state, base | {"action_name": "click", "action_argument": f"tab {i}", "visible_asins": []}) for i in range(6)]
    assert [o["subreason"] for o in idle] == [None] * 5 + ["no_progress_loop"]
    assert tracker.reset_idle(state)["idle"] == 0 and state["seen"]
    for i in range(40):
        last = tracker.step(state, base | {"action_name": "click", "action_argument": "x", "visible_asins": [], "constraint_evidence": [i, f"r{state['step']}"]} if i % 2 else base | {"action_name": "think", "action_argument": str(i), "visible_asins": [], "constraint_evidence": [f"s{i}"]})
    assert last["reason"] == "max_steps"


def test_stream_equals_batch(spark, tmp_path):
    schema = "session_id string, pos long, action_name string, action_argument string, visible_asins array<string>, page_type string, selected_options map<string,string>, constraint_evidence array<string>"
    rows = [(s, p, "search", "q" if p % 3 else "z", [str(p)], None, {"c": "v"}, ["e"]) for s in "ab" for p in range(8)]
    df = spark.createDataFrame(rows, schema)
    want = sorted(map(tuple, tracker.track(df).collect()))
    src = str(tmp_path / "in")
    df.filter("pos < 4").coalesce(1).write.mode("append").parquet(src)
    stream = tracker.track_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src))
    q = stream.writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    df.filter("pos >= 4").coalesce(1).write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("tracked").collect())) == want


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\n{"k": 1}\n{"k": 2}\n')
    (tmp_path / "bad.jsonl").write_text('{"k": 1}\n{nope\n')
    (tmp_path / "a.json").write_text('[{"k": 5}, {"k": 6}]')
    df = tables.read_jsonl(spark, str(tmp_path / "a.jsonl"), "k int")
    assert df.count() == 3 and tables.keyed(df, "k")["repeated"].first().k == 1
    with pytest.raises(Exception):
        tables.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "k int", strict=True).collect()
    assert tables.bad_lines(spark, str(tmp_path / "bad.jsonl"), "k int").first()._corrupt_record == "{nope"
    assert sorted(map(tuple, tables.read_json_array(spark, str(tmp_path / "a.json"), "k int").collect())) == [(0, 5), (1, 6)]
    out = str(tmp_path / "out")
    tables.publish(df, out)
    with pytest.raises(Exception):
        tables.publish(df, out)
    tables.publish(df, out, force=True)
    with pytest.raises(ValueError):
        tables.assert_empty(df, "rows")
    ids = tables.task_ids(spark.createDataFrame([(None, '{"task_id": 7}'), (3, None)], "task_id long, extra_info string"))
    assert sorted(r.task_id for r in ids.collect()) == [3, 7]
    assert tables.content_digest(df).first().digest == tables.content_digest(df.orderBy("k")).first().digest


def test_the_same_search_in_other_punctuation_is_a_repeat():
    state = tracker.begin()
    base = {"action_name": "search", "visible_asins": [], "page_type": None, "selected_options": None, "constraint_evidence": []}
    out = [tracker.step(state, base | {"action_argument": q}) for q in ("红色，裙子 300rmb", "红色 裙子！ 300元", "红色 裙子 300 RMB")]
    assert [o["repeats"] for o in out] == [0, 1, 2]
    assert tracker.step(state, base | {"action_name": "Search", "action_argument": "红色，裙子 300元"})["repeats"] == 0
