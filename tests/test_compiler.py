"""Clauses, evidence and contracts of requests."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from lodestar.functions import clauses
from lodestar.operators import compiler
from lodestar.plans import compiler_queries


@pytest.mark.parametrize(
    "request_, want",
    [
        ("尽量别超过760元", ["尽量别超过760元"]), ("预期价格不超过100元", ["预期价格不超过100元"]), ("价格在120元以内最好", ["价格在120元以内最好"]),
        ("绝对不要5升以上最好要黑色的电饭煲", ["绝对不要5升以上", "最好要黑色的电饭煲"]), ("最好要黑色但绝对不要5升以上的电饭煲", ["最好要黑色", "绝对不要5升以上的电饭煲"]),
        ("座椅不需要带有高度调节功能但必须有扶手。", ["座椅不需要带有高度调节功能", "必须有扶手"]), ("红色，红色；蓝色!  ", ["红色", "蓝色"]), (None, []), ("", []), ("，。", []),
        ("希望价格预算必须控制在约100元", ["希望价格预算必须控制在约100元"]),
    ],
)
def test_clauses(request_, want):
    assert clauses.split_clauses(request_) == want


def test_linking_words_are_every_split_of_a_text():
    rng = random.Random(1)
    words = list(clauses.LINKS)
    def made(t):  # noqa: E306
        return not t or any(t.startswith(w) and made(t[len(w):]) for w in words)

    for _ in range(3000):
        t = "".join(rng.choice([*words, *"需要但是择x"]) for _ in range(rng.randint(0, 6)))
        linking = clauses.Linking()
        for part in (t[: len(t) // 2], t[len(t) // 2 :]):
            linking.add(part)
        assert bool(linking) == made(t)
    began = time.process_time()
    assert len(clauses.scopes("必须" + "需要" * 20000 + "x最好黑色" + "最好" * 20000)) == 3
    assert time.process_time() - began < 5


def blocks(a, b):
    """Longest common blocks, the earliest of equal ones, then left and right of it."""
    best = max(((n, -i, -j) for i, j in itertools.product(range(len(a)), range(len(b))) for n in [next(k for k in range(min(len(a) - i, len(b) - j) + 1) if k == min(len(a) - i, len(b) - j) or a[i + k] != b[j + k])] if n), default=None)
    if best is None:
        return []
    n, i, j = best[0], -best[1], -best[2]
    return blocks(a[:i], b[:j]) + [a[i : i + n]] + blocks(a[i + n :], b[j + n :])


def test_evidence_against_a_plain_aligner():
    rng = random.Random(2)
    hits = 0
    for _ in range(1500):
        value = "".join(rng.choice("红黑色加厚防水款") for _ in range(rng.randint(3, 8)))
        request = "".join(rng.choice("红黑色加厚防水款要买") for _ in range(rng.randint(0, 14)))
        got = clauses.found_evidence(request, value, {}, {})
        if value in request:
            assert got == [value]
            continue
        found = [x for x in blocks(value, request) if len(x) > 1]
        want = list(dict.fromkeys(found)) if sum(map(len, found)) >= 0.6 * len(value) else []
        hits += bool(want)
        assert got == want
    assert hits > 30


@pytest.mark.parametrize(
    "request_, value, want",
    [
        ("购买深灰色M码洗地机", "深灰色", ["深灰色"]), ("买 ＡＢＣ-12 键盘", "abc-12", ["abc-12"]), ("买a键盘", "XK-900", []), ("要毛衣一件", "针织衫", ["毛衣"]), ("红色 加厚", "加厚/红色", ["加厚", "红色"]),
        ("x", "", []), ("x", None, []), ("5l装", "5L", ["5L"]),
    ],
)
def test_evidence(request_, value, want):
    aliases = {"毛衣": "针织衫", "针织衫": "针织衫"}
    assert clauses.found_evidence(clauses.form(request_), value, aliases, {"针织衫": ["毛衣", "针织衫"]}) == want


FIELDS = "request string, category string, title string, shop string, description string, attributes array<string>, wanted array<string>, options map<string,array<struct<value:string,price:double>>>, name string"


def compiled(spark, *rows, **kw):
    made = [{"request": None, "category": "家电›洗地机", "title": "海狮 S12 洗地机", "shop": "海狮官方旗舰店", "description": None, "attributes": None, "wanted": None, "options": None, "name": str(i)} | r for i, r in enumerate(rows)]
    out = compiler.compile_contracts(spark.createDataFrame(made, FIELDS), **kw)
    return sorted(out.collect(), key=lambda r: int(r.name))


def one(row, kind):
    return [c for c in row.contract if c.constraint_type == kind]


def test_contracts(spark):
    colours = {"颜色分类": [("红色", 1.0), ("黑色", 2.0)], "尺码": [("M", 3.0)], "大小": [("M", 1.0)]}
    rows = compiled(
        spark,
        {"request": "购买一台洗地机，红色也可以，预算2200元以内。", "wanted": ["红色", "M", "绿"], "options": colours},
        {"request": "购买一台洗地机，也可以用于热洗，最好是加宽设计。", "attributes": ["热洗", " 加宽", "加宽", None]},
        {"request": "必须支持热洗，外观最好也标明热洗模式。", "attributes": ["热洗"]},
        {"request": "座椅不需要带有高度调节功能但必须有扶手。", "attributes": ["高度调节", "扶手"]},
        {"request": "学生准备去旅游了，购买一台白色相机。", "attributes": ["旅游"]},
        {"request": "海狮S12洗地机，预期价格在100元以内，不要人工合成的那种", "attributes": ["热洗"]},
        {"request": "洗地机300元左右，无需售后"},
        {"request": None, "category": None, "title": None, "shop": None},
        {"request": "购买一台可以用于热洗的洗地机，80元到120元之间", "attributes": ["热洗"]},
    )
    r = rows[0]
    assert [c.constraint_id for c in r.contract] == [f"q{i:04d}" for i in range(1, len(r.contract) + 1)]
    assert [(c.constraint_type, c.role) for c in r.contract] == [("category", "hard_gate"), ("budget_upper", "required_constraint"), ("option", "query_preference_reference"), ("option", "gold_variant_reference"), ("option", "gold_variant_reference")]
    red, size, green = one(r, "option")
    assert (red.query_evidence, red.optional_query_evidence, red.axis, red.strength) == ([], ["红色"], "color", "ignore") and red.semantics_reason == "explicit_indifference"
    assert size.axis is None and green.axis is None and green.semantics_reason == "gold_only_reference"
    assert (r.price_upper, one(r, "budget_upper")[0].semantics_reason) == (2200, "explicit_hard_boundary")
    assert rows[1].expected_functions == [] and rows[1].optional_functions == ["热洗", "加宽"]
    assert {c.expected for c in rows[1].contract if c.role == "query_preference_reference"} == {"热洗", "加宽"}
    assert (rows[2].expected_functions, rows[2].optional_functions) == (["热洗"], [])
    assert one(rows[2], "core_function")[0].query_quote == "必须支持热洗；最好也标明热洗模式" or one(rows[2], "core_function")[0].query_quote == "必须支持热洗；外观最好也标明热洗模式"
    assert rows[3].expected_functions == ["扶手"] and rows[3].optional_functions == ["高度调节"]
    assert [c.strength for c in one(rows[3], "core_function") if c.expected == "扶手"] == ["hard"]
    assert rows[4].expected_functions == [] and rows[4].optional_functions == []
    assert rows[5].expected_brand == ["海狮"] and rows[5].expected_model == ["s12"] and rows[5].expected_functions == []
    assert [c.strength for c in one(rows[5], "budget_upper")] == ["soft"]
    (clause,) = one(rows[5], "query_clause")
    assert (clause.expected, clause.strength, clause.polarity, clause.enforcement) == ("不要人工合成的那种", "hard", "forbid", "audit_only")
    assert (one(rows[6], "price_range")[0].semantics_reason, rows[6].price_upper) == ("explicit_soft_preference", 360)
    assert one(rows[6], "query_clause")[0].strength == "needs_review"
    assert [c.constraint_type for c in rows[7].contract] == ["category"] and rows[7].price_upper is None
    assert one(rows[8], "price_range")[0].semantics_reason == "explicit_hard_boundary" and rows[8].price_upper == 120 and rows[8].expected_functions == ["热洗"]


@pytest.mark.parametrize("approach", ["clause"])
def test_semantics_of_clauses(spark, approach):
    cases = {
        "要不用工具也能快速拆装的": ("hard", "require"), "安装时无需破坏原车线路就能改装": ("hard", "forbid"), "不需要有售后": ("ignore", "indifferent"), "不用参与活动": ("ignore", "indifferent"), "不用减脂": ("ignore", "indifferent"),
        "不用花里胡哨的": ("hard", "forbid"), "不需要售后": ("needs_review", "unknown"), "别太重": ("soft", "prefer"), "特别要好看": ("needs_review", "unknown"), "严禁含酒精": ("hard", "forbid"), "大约5斤": ("soft", "prefer"), "普通的": ("needs_review", "unknown"),
        "最好不超过5斤": ("soft", "prefer"), "至少5斤": ("hard", "require"), "颜色不限": ("ignore", "indifferent"), "别让人看见": ("hard", "forbid"), "非红色不可": ("hard", "forbid"), "非红色莫属": ("needs_review", "unknown"),
    }
    df = spark.createDataFrame([(q,) for q in cases], "q string").withColumn("said", clauses.segments("q"))
    none, row = F.array().cast("array<struct<text:string,form:string>>"), F.array(F.struct(F.col("q").alias("text"), F.regexp_replace("q", " ", "").alias("form")))
    out = df.select("q", compiler.semantics(F.lit("query_clause"), F.lit("query_semantic_audit"), F.col("q"), row, none, F.get(none, F.lit(0)), F.col("said"), F.lit(False)).alias("s"))
    assert {r.q: (r.s.strength, r.s.polarity) for r in out.collect()} == cases


def test_compiling_again_gives_the_same_hash(spark):
    rows = [("必须支持热洗，预算300元", "家电", "热洗机", "店", "", ["热洗"], None, None, "a"), ("颜色不限", None, None, None, None, None, ["红"], None, "b")]
    df = compiler.compile_contracts(spark.createDataFrame(rows, FIELDS).withColumn("__form", F.lit("kept")))
    assert df.select("__form").first()[0] == "kept"
    stored = df.select("request", "category", "title", "shop", "description", "attributes", "wanted", "options", "name", "contract_sha256")
    assert [r.intact for r in compiler.recompiled(stored, "contract_sha256").select("intact").collect()] == [True, True]
    changed = stored.withColumn("request", F.concat("request", F.lit("，至少5斤")))
    assert [r.intact for r in compiler.recompiled(changed, "contract_sha256").select("intact").collect()] == [False, False]
    assert compiler.constraints(df, "name").filter("constraint_id = 'q0001'").count() == 2


def test_evidence_spans_of_parts(spark):
    rows = compiler_queries.evidence_spans(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) > 400
    for r in rows:
        name, want = clauses.form(r.p_name), clauses.form(r.value)
        if want in name:
            assert r.spans == [r.value]
            continue
        parts = [p for p in r.value.replace("#", " ").split() if len(p) > 1 and clauses.form(p) in name]
        coded = any(c.isdigit() for c in want)
        found = [] if coded else [x for x in blocks(want, name) if len(x) > 1]
        assert r.spans == list(dict.fromkeys(parts + (found if sum(map(len, found)) >= 0.6 * len(want) else [])))


def spans_by_the_rule(name, value, listed):
    """STR24 in plain words; ``listed``: sets of forms that mean the same."""
    name, want = clauses.form(name), clauses.form(value)
    if not want or want in name:
        return [value] if want else []
    parts = [p for p in value.replace("#", " ").split() if len(p) > 1 and clauses.form(p) in name]
    same = [a for forms in listed if want in forms for a in forms if len(a) > 1 and a in name]
    found = [] if any(c.isdigit() for c in want) else [x for x in blocks(want, name) if len(x) > 1]
    return list(dict.fromkeys(parts + same + (found if sum(map(len, found)) >= 0.6 * len(want) else [])))


LISTED = [["new", "promo", "newarrival"], ["small", "economy", "mini"], ["standard", "old", "red"], ["large", "big"], ["medium", "m"]]


def test_evidence_spans_take_aliases_and_neighbours(spark):
    """no alias was looked for, and no neighbour's type."""
    parts = sorted(spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect(), key=lambda r: (r.p_size, r.p_partkey))
    beside = {r.p_partkey: n.p_type for r, n in zip(parts, [*parts[1:], parts[0]])}
    rows = compiler_queries.evidence_spans(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.p_partkey, r.i) for r in rows) == [(r.p_partkey, i) for r in sorted(parts, key=lambda r: r.p_partkey) for i in range(5)]
    for r in rows:
        assert r.evidence == spans_by_the_rule(r.p_name, r.value, LISTED)
        assert r.i != 4 or r.value == beside[r.p_partkey]
    for i in (0, 4):
        assert {e for r in rows if r.i == i and r.evidence != r.spans for e in r.evidence} >= {"new", "small", "old", "red"}
    assert all(e == clauses.form(e) for r in rows for e in set(r.evidence) - set(r.spans))


@pytest.mark.parametrize("rows", [[], [(1, "small rod", "Brand#1", "ECONOMY", 3)], [(2, None, None, None, None), (1, "old rod", None, "STANDARD", None), (5, "new gear", "Brand#2", " ", 1), (4, "a medium bolt", "x", "M", 1)]])
def test_evidence_spans_of_odd_parts(spark, tmp_path, rows):
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    order = sorted(rows, key=lambda r: (-1 if r[4] is None else r[4], r[0]))
    beside = {r[0]: n[3] for r, n in zip(order, [*order[1:], *order[:1]])}
    found = {(r.p_partkey, r.i): r for r in compiler_queries.evidence_spans(spark, str(tmp_path)).collect()}
    assert len(found) == 5 * len(rows)
    for key, name, brand, kind, _ in rows:
        for i, value in ((0, kind), (1, brand), (4, beside[key])):
            assert found[key, i].value == value and found[key, i].evidence == spans_by_the_rule(name, value, LISTED)


def test_steps_of_evidence():
    aliases = {"针织衫": "针织衫", "毛衣": "针织衫", "衫": "针织衫", "": ""}
    others = {"针织衫": ["针织衫", "毛衣", "衫"], "": ["x"]}
    steps = lambda request, value: clauses.evidence_steps(clauses.form(request), value, aliases, others)
    assert steps("毛衣一件", "针织衫") == [("alias", "毛衣")] and steps("衫一件", "毛衣") == []
    assert steps("买毛衣", "毛衣") == [("whole", "毛衣")] and steps("x", "") == []
    assert steps("红色 加厚", "加厚/红色") == [("part", "加厚"), ("part", "红色")]
    assert steps("要黑色防水的", "黑色的防水") == [("block", "黑色"), ("block", "防水")]
    assert clauses.found_evidence("红色x加厚", "加厚/红色", {}, {}) == ["加厚", "红色"]
