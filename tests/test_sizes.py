"""What keeps queries in step with their input: expressions that are computed once a row, rows dealt over all cores."""

import math

import pytest
from pyspark.sql import functions as F

from lodestar.operators import frontier, retrieval
from lodestar.plans import catalog, compiler_queries, python_queries, scoring_queries, trajectory_queries  # noqa: F401
from lodestar.streaming import tracker

SF = "/root/testdata/sf0.001"


def optimized(spark, name):
    spark.conf.set("spark.sql.maxPlanStringLength", "50000000")
    return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["option_dimensions", "variant_prices", "required_options"])
def test_option_forms_are_written_once(spark, name):
    """1508, 244 and 277 times before, many of them within lambdas over lambdas."""
    plan = optimized(spark, name)
    assert plan.count("regexp_replace(") <= 12
    assert "Repartition" in plan  # a small file is one split


def test_trajectory_events_are_made_once(spark):
    """every count of the metrics made the whole event stream anew; steps are shuffled without what is the same for all."""
    plan = optimized(spark, "trajectory_metrics")
    assert plan.count("array_contains(") <= 4
    assert len(plan) < 60_000


@pytest.mark.parametrize("name", ["bm25_topk", "bm25_page_two", "target_ranks"])
def test_few_terms_shuffle_no_postings(spark, name):
    """postings times queries went through a shuffle by term."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables: only what was counted is broadcast
    try:
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not [line for line in plan.splitlines() if "SortMergeJoin" in line and "term" in line]


@pytest.mark.parametrize("limit", [0, 200_000])
def test_scores_do_not_depend_on_how_terms_are_joined(spark, monkeypatch, limit):
    monkeypatch.setattr(retrieval, "SMALL_TERMS", limit)
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, []), (4, ["c", "d", "e"])], "id long, w array<string>")
    index = retrieval.postings(docs, "id", {"w": (F.col("w"), 1.0)})
    terms = spark.createDataFrame([("q", "b"), ("q", "a"), ("r", "c"), ("r", "z")], "query string, term string")
    found = {(r.query, r.id): round(r.score, 9) for r in retrieval.bm25_scores(index, terms).collect()}
    rare = lambda dl: math.log(3.5 / 1.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / 1.5))
    common = lambda dl: 1e-6 * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / 1.5))
    assert found == {("q", 1): round(rare(2) + common(2), 9), ("q", 2): round(common(1), 9), ("r", 4): round(rare(3), 9)}


def test_sessions_are_walked_across_batches(spark):
    """a frame was made for every session; now sessions follow one another, cut by batches of any size."""
    schema = "session_id string, pos long, action_name string, action_argument string, visible_asins array<string>, page_type string, selected_options map<string,string>, constraint_evidence array<string>"
    rows = [(None if s == 3 else f"s{s}", p, "search", f"q{p % 3}", [str(10_000_000 + p % 5)], None, {"a": str(p % 4)}, [f"e{p % 7}"]) for s in range(8) for p in range(12)]
    df = spark.createDataFrame(rows[::-1], schema)
    assert "FlatMapGroupsInPandas" not in tracker.track(df)._jdf.queryExecution().optimizedPlan().toString()
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "5")
    try:
        found = {(r.session_id, r.pos): (r.step, r.repeats, r.idle, r.progress, r.credited, r.reason, r.subreason) for r in tracker.track(df).collect()}
    finally:
        spark.conf.set(key, before)
    want = {}
    for s in {r[0] for r in rows}:
        state = tracker.begin()
        for r in sorted((r for r in rows if r[0] == s), key=lambda r: r[1]):
            want[s, r[1]] = tuple(tracker.step(state, dict(zip([f.split()[0] for f in schema.split(", ")], r))).values())
    assert found == want


@pytest.mark.parametrize("name", ["compiled_contracts", "recompiled_contracts", "evidence_spans"])
def test_dear_rows_of_parts_are_dealt(spark, name):
    """the requests of a file of parts were compiled in its one split."""
    assert "Repartition" in optimized(spark, name)


@pytest.mark.parametrize("name", ["price_expressions", "price_constraints"])
def test_texts_come_in_small_batches(spark, name):
    """F8: a worker held ten thousand documents with all that was found in them."""
    keys = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = [spark.conf.get(k) for k in keys]
    spark.conf.set(keys[0], "10000")
    try:
        python_queries.QUERIES[name](spark, SF)
        assert int(spark.conf.get(keys[0])) <= 1000 and 0 < int(spark.conf.get(keys[1])) <= 8 << 20
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


def test_places_are_given_once(spark):
    """every window of a slice numbered all rows anew, with a shuffle of them."""
    df = spark.range(500).select("id", (F.col("id") % 7).cast("double").alias("score"))
    rows, total = frontier.placed(df, F.col("score"), pieces=4)
    assert "Window" not in rows._jdf.queryExecution().optimizedPlan().toString()
    want = sorted((r.score, r.id) for r in df.collect())
    assert total == 500 and [(r.score, r.id) for r in sorted(rows.collect(), key=lambda r: r.place)] == want
