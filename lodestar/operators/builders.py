"""Features that builders of task and training sets pick by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .trajectories import _codes, _given, _true, canonical_json, spaced

#: Weights of coverage flags.
WEIGHTS = {"multiple_searches": 4, "multiple_candidates": 4, "back_to_search": 3, "reviews": 3, "attributes": 3, "next_page": 2, "multiple_options": 2, "longer_than_10": 2}
PROBLEM_WEIGHTS = {"loop_recovery": 8, "evidence_verification": 5, "variant_selection": 4, "explicit_terminal_buy": 2, "clean_critical_actions": 2}
EVIDENCE = ("view_features", "view_description", "view_attributes", "view_reviews")
CRITICAL = ("search_products", "open_product", "select_option", "buy_now")
SLICES = ("search_reformulation", "candidate_comparison", "price_semantics", "multi_option", "evidence_verification", "long_horizon")


def eligible(slice_name: str, r: Column) -> Column:
    """FLT1: whether a task with features ``r`` may stand for a challenge."""
    rules = {
        "search_reformulation": (r["lexical_overlap"] <= 0.30) & (r["query_chars"] >= 55), "candidate_comparison": (r["category_pool_size"] >= 8) & (r["attribute_count"] >= 4),
        "price_semantics": r["hard_budget"] | r["approximate_price"], "multi_option": (r["option_axes"] >= 2) | (r["variant_count"] >= 6),
        "evidence_verification": (r["attribute_count"] >= 6) & (r["query_chars"] >= 65), "long_horizon": r["difficulty_score"] >= 9,
    }
    return _true(rules[slice_name]) if slice_name in rules else F.lit(False)


def severity(slice_name: str, r: Column) -> Column:
    """FLT2."""
    one = lambda c: c.cast("int")
    return {
        "search_reformulation": (1 - r["lexical_overlap"]) + r["query_chars"] / 150, "candidate_comparison": r["category_pool_size"] / 50 + r["attribute_count"] / 10,
        "price_semantics": 2 * one(r["approximate_price"]) + one(r["hard_budget"]) + r["query_chars"] / 200, "multi_option": 2 * r["option_axes"] + r["variant_count"] / 5,
        "evidence_verification": r["attribute_count"] + r["query_chars"] / 40, "long_horizon": r["difficulty_score"],
    }[slice_name].cast("double")


#: FLT3: the challenge that tells whether a strategy has a task (names of our own; callers may give theirs).
PROXIES = {"search": "search_reformulation", "compare": "candidate_comparison", "price": "price_semantics", "options": "multi_option", "evidence": "evidence_verification", "long": "long_horizon"}


def strategy_eligible(strategy: str, r: Column, proxies: dict[str, str] | None = None) -> Column:
    """FLT3: a strategy takes what its proxy challenge takes; without a proxy, everything."""
    proxy = (PROXIES if proxies is None else proxies).get(strategy)
    return F.lit(True) if proxy is None else eligible(proxy, r)


def hardest_first(slice_name: str, r: Column, task: Column) -> Column:
    """Ascending key: hardest first, then by task."""
    return F.struct((-severity(slice_name, r)).alias("severity"), task.alias("task"))


def extreme_factors(r: Column) -> Column:
    """How many of five extremes a task has."""
    flags = (
        r["difficulty_score"] >= 18, r["retrieval_bucket"].isin("rank21_150", "21_150", "missing"), r["option_axes"] >= 3, r["variant_count"] >= 10, (r["lexical_overlap"] <= 0.10) & (r["attribute_count"] >= 6)
    )
    out = F.lit(0)
    for f in flags:
        out = out + _true(f).cast("int")
    return out


def critical_signature(step: Column) -> Column:
    """Tool and arguments of the four critical tools (which need arguments, but for the purchase); null for others."""
    shown = F.lower(F.coalesce(canonical_json(F.coalesce(F.nullif(step["arguments"], F.lit("")), F.lit("{}"))), F.lit("{}")))
    shown = F.when(shown.startswith("{"), shown).otherwise("{}")
    return F.when(step["tool_name"].isin(*CRITICAL) & ((step["tool_name"] == "buy_now") | (shown != "{}")), F.concat_ws("\0", step["tool_name"], shown))


def local_repeat(steps: Column, first_state: Column, window: int = 3) -> Column:
    """WN3: a critical action again within ``window`` positions, from the same or an unknown state."""
    seen = F.transform(steps, lambda s, i: F.struct(i.alias("i"), critical_signature(s).alias("sig"), canonical_json(F.when(i == 0, first_state).otherwise(F.get(steps, i - 1)["state"])).alias("state")))
    same = lambda a, b: a.isNull() | b.isNull() | (a == b)
    back = lambda s: F.slice(seen, F.greatest(s["i"] - window, F.lit(0)) + 1, F.least(s["i"], F.lit(window)))
    return F.exists(seen, lambda s: s["sig"].isNotNull() & F.exists(back(s), lambda p: _true(p["sig"] == s["sig"]) & same(p["state"], s["state"])))


def _arguments(steps: Column, tool: str, key: str) -> Column:
    found = F.transform(F.filter(steps, lambda s: s["tool_name"] == tool), lambda s: spaced(F.coalesce(F.get_json_object(s["arguments"], f"$.{key}"), F.lit(""))))
    return F.size(F.array_distinct(F.filter(found, lambda x: x != "")))


def behaviour(steps: Column, blocked: Column, first_state: Column) -> Column:
    """WN4: eleven flags of a trajectory."""
    n, tool = F.size(steps), F.transform(steps, lambda s: F.coalesce(s["tool_name"], F.lit("")))
    queries, candidates = _arguments(steps, "search_products", "query"), _arguments(steps, "open_product", "asin")
    has = lambda *t: F.exists(tool, lambda x: x.isin(*t))
    flags = {
        "search_reformulation": queries >= 2, "candidate_comparison": candidates >= 2, "multiple_options": F.size(F.filter(tool, lambda x: x == "select_option")) >= 2, "guard_recovery": F.coalesce(F.size(blocked), F.lit(0)) > 0,
        "medium_or_long": n > 10, "long": n > 20, "loop_recovery": (queries >= 2) & ((candidates >= 2) | has("back_to_search", "next_page")), "evidence_verification": has(*EVIDENCE), "variant_selection": has("select_option"),
        "explicit_terminal_buy": _true(F.get(tool, n - 1) == "buy_now"), "clean_critical_actions": ~local_repeat(steps, first_state),
    }
    return F.struct(*[c.alias(k) for k, c in flags.items()])


def quality_reasons(steps: Column, first_state: Column) -> Column:
    """X22."""
    bought = _true(F.get(steps, F.size(steps) - 1)["tool_name"] == "buy_now")
    return _codes((~bought, "quality_missing_explicit_terminal_buy"), (local_repeat(steps, first_state), "quality_repeated_critical_action"))


def sequence_coverage(tools: Column) -> Column:
    """X21, sequence: eight flags of a list of tools."""
    n = lambda t: F.size(F.filter(tools, lambda x: x == t))
    flags = {
        "multiple_searches": n("search_products") >= 2, "multiple_candidates": n("open_product") >= 2, "back_to_search": n("back_to_search") > 0, "reviews": n("view_reviews") > 0, "attributes": n("view_attributes") > 0,
        "next_page": n("next_page") > 0, "multiple_options": n("select_option") >= 2, "longer_than_10": F.size(tools) > 10,
    }
    return F.struct(*[c.alias(k) for k, c in flags.items()])


def problem_coverage(tools: Column, clean: Column) -> Column:
    """X21, problems: five flags."""
    s = sequence_coverage(tools)
    flags = {
        "loop_recovery": s["multiple_searches"] & (s["multiple_candidates"] | s["back_to_search"] | s["next_page"]), "evidence_verification": F.exists(tools, lambda x: x.isin(*EVIDENCE)), "variant_selection": F.array_contains(tools, "select_option"),
        "explicit_terminal_buy": _true(F.get(tools, F.size(tools) - 1) == "buy_now"), "clean_critical_actions": clean,
    }
    return F.struct(*[c.alias(k) for k, c in flags.items()])


def coverage_score(tools: Column, clean: Column) -> Column:
    """SM22: weighted flags of :func:`sequence_coverage` and :func:`problem_coverage`."""
    out = F.lit(0)
    for of, weights in ((sequence_coverage(tools), WEIGHTS), (problem_coverage(tools, clean), PROBLEM_WEIGHTS)):
        for name, w in weights.items():
            out = out + F.when(of[name], w).otherwise(0)
    return out


def product_summary(p: Column, rank: Column, most: int = 5) -> Column:
    """JSN6: what is shown of a product: bounded lists, the price range."""
    some = lambda c: F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, most)
    return F.struct(
        rank.alias("rank"), p["asin"].alias("asin"), p["title"].alias("title"), F.coalesce(F.nullif(p["brand"], F.lit("")), p["shop_name"]).alias("brand"), F.array_min(p["pricing"]).alias("price_low"), F.array_max(p["pricing"]).alias("price_high"),
        some(p["attribute"]).alias("attributes"), some(p["small_description"]).alias("bullets"),
    )


def option_records(asin: Column, options: Column, most: int = 100) -> Column:
    """JSN7, STR18: records (axis, label, option_id) of the first ``most`` available values of each axis, as
    the page shows them; the id is of the canonical JSON of product, axis and value."""
    free = lambda vs: F.filter(vs, lambda v: ~F.coalesce(~v["is_available"], F.lit(False)) & _given(v["value"]))
    payload = lambda k, v: F.to_json(F.struct(asin.alias("asin"), k.alias("axis"), v.alias("value")))
    record = lambda k, v: F.struct(k.alias("axis"), v["value"].alias("label"), F.concat(F.lit("opt_"), F.left(F.sha2(payload(k, v["value"]), 256), F.lit(16))).alias("option_id"))
    return F.flatten(F.transform(F.array_sort(F.map_entries(options)), lambda e: F.transform(F.slice(free(e["value"]), 1, most), lambda v: record(e["key"], v))))
