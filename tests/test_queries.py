"""Every query with SQL gives the rows of its SQL."""

import math
import os
from pathlib import Path

import pytest

from lodestar.plans import array_queries, budget_queries, builder_queries, catalog, compiler_queries, contract_queries, feature_queries, python_queries, scoring_queries, selection_queries, trajectory_queries  # noqa: F401

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
duckdb = pytest.importorskip("duckdb")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted(tuple(repr(plain(r[c])) for c in cols) for r in df.collect())
    cur = con.execute(catalog.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(repr(plain(r[names.index(c)])) for c in cols) for r in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(python_queries.QUERIES))
def test_python_queries_run(spark, name):
    assert python_queries.QUERIES[name](spark, str(DATA)).count() > 0


def test_greedy_selection_of_hot_customers(spark, tmp_path):
    bands = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    rows = [(b * 10_000 + k, 1 + k % 2 if k < 900 else 10 + k % 150, name, float(5000 - k)) for b, name in enumerate(bands) for k in range(1200)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = [r.o_orderkey for r in python_queries.greedy_selection(spark, str(tmp_path)).collect()]
    quotas, used, want = dict(zip(bands, (40, 30, 20, 20, 10))), set(), []
    left = {name: sorted((r for r in rows if r[2] == name), key=lambda r: (-r[3], r[0])) for name in bands}
    taken = dict.fromkeys(bands, 0)
    while len(want) < 100 and any(left.values()):
        for name in bands:
            left[name] = [r for r in left[name] if r[1] not in used] if taken[name] < quotas[name] else []
            if left[name] and len(want) < 100:
                row = left[name].pop(0)
                used.add(row[1])
                taken[name] += 1
                want.append(row[0])
    assert len(want) == 100 and got == want


def test_prices_of_documents(spark, tmp_path):
    from lodestar.functions import price

    docs = [(1, "预算不超过300元，每包价格约1.5元"), (2, None), (3, ""), (4, "no price"), (5, "价格在三百元到四百元之间 " * 40), (6, "高于80元低于120元"), (None, "至少50元的礼盒")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    every = [(k, None, t) for k, t in enumerate(python_queries.REQUESTS)] + [(None, i, t) for i, t in docs]
    got = python_queries.price_expressions(spark, str(tmp_path)).collect()
    want = [(k, i, *e) for k, i, t in every for e in price.expressions(t)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and sum(r.doc_id == 5 for r in got) == 40
    found = {(r.request_id, r.doc_id): r for r in python_queries.price_constraints(spark, str(tmp_path)).collect()}
    assert set(found) == {(k, i) for k, i, _ in every} and len(found) == len(every)
    for k, i, t in every:
        tops = [e.value if e.upper is None else e.upper for e in price.expressions(t) if e.kind in ("upper", "range", "around")]
        assert found[k, i].budget == (min(tops) if tops else None)
    assert found[None, 1].unit == "包" and found[None, 2].want is None and tuple(found[None, 6].want)[:4] == ("between", None, 80.0, 120.0)


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_same_split_whatever_the_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = []
    for n in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows.append(sorted(map(tuple, catalog.stable_split(spark, str(DATA)).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert rows[0] == rows[1]
