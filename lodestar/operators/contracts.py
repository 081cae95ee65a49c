"""Contracts of tasks and runs: signatures, integrity, guards, allocation and rubric kinds of prices.

Null inputs give what the docstrings say; nothing here looks at more than one row but the two
aggregations ``projection_totals`` and ``task_facts``.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_query

#: Field names that are secrets, and the ending of others.
SECRETS = ("api_key", "apikey", "authorization", "bearer_token", "access_token", "client_secret", "secret", "password")
SECRET_SUFFIX = "_api_key"
#: Fields that training rows must not hold.
NOT_FOR_TRAINING = ("reasoning_content", "teacher_reasoning", "terminal_result", "reward", "reward_valid", "reward_breakdown")
#: Kind of a price expression -> (constraint, operator, hardness, rule).
PRICE_RUBRICS = {
    "upper": ("budget_upper", "lte", "hard", "explicit_upper_budget_rule"),
    "lower": ("price_lower", "gte", "hard", "explicit_lower_price_rule"),
    "range": ("price_range", "between", "hard", "explicit_price_range_rule"),
}
#: The same for all other kinds, without and with an open end above.
PRICE_WISHES = {
    False: ("price_preference", "approximately", "soft", "approximate_price_preference_rule"),
    True: ("price_preference", "approximately", "soft", "open_ended_price_preference_rule"),
}


def canonical_map(fields: Column) -> Column:
    """STR19 for flat maps of strings: JSON with sorted keys and no spaces; null for a null map."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields))))


def action_signature(name: Column, argument: Column) -> Column:
    """STR21: JSON of action and argument; the words of a search are normalized as a query, other arguments
    trimmed and in lower case; nulls are empty."""
    plain = F.lower(F.trim(F.coalesce(argument, F.lit(""))))
    # the form of a search is decided by the name as it stands, before it is trimmed
    said = F.when(name == "search", normalize_query(F.coalesce(argument, F.lit("")))).otherwise(plain)
    return F.to_json(F.struct(F.lower(F.trim(F.coalesce(name, F.lit("")))).alias("action"), said.alias("argument")))


def guarded_text(text: Column, markers: Sequence[str], limit: int) -> Column:
    """STR15: white space collapsed, the brackets and colons of ``markers`` made harmless, then cut to
    ``limit`` characters, the last an ellipsis; null is empty."""
    out = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s　 ]+", " "))
    for m in markers:
        out = F.replace(out, F.lit(m), F.lit(m.translate(str.maketrans(":[]", "：()"))))
    return F.when(F.length(out) <= limit, out).otherwise(F.concat(F.rtrim(F.left(out, F.lit(limit - 1))), F.lit("…")))


def first_listed(text: Column, names: Sequence[str]) -> Column:
    """STR12: the first of ``names`` that the text holds, else the text itself; null is empty."""
    said = F.coalesce(text, F.lit(""))
    return F.coalesce(*[F.when(F.contains(said, F.lit(n)), F.lit(n)) for n in names], said)


def instruction_intact(text: Column, feature_hash: Column, contract_hash: Column) -> Column:
    """SC21: both hashes are of this very instruction; false where one is missing or the text is empty."""
    own = F.sha2(text, 256)
    return F.coalesce((text != "") & (feature_hash == own) & (contract_hash == own), F.lit(False))


def explicit_price(price: Column) -> Column:
    """Struct (status, price); only a finite price of zero or more passes."""
    value = price.try_cast("double")
    fine = value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < float("inf"))
    return F.struct(F.when(fine, "pass").otherwise("unverifiable").alias("status"), value.alias("price"))


def next_candidate_id(entries: Column, most: int) -> Column:
    """The first free id of C1, C2, ... up to ``most``; if none is free, that of the entry seen longest
    ago, the lower number first.  ``entries``: array of (candidate_id, last_seen_step)."""
    name = lambda e: F.upper(F.trim(F.coalesce(e["candidate_id"], F.lit(""))))
    used = F.transform(F.coalesce(entries, F.array()), name)
    free = F.get(F.array_except(F.array(*[F.lit(f"C{i}") for i in range(1, most + 1)]), used), F.lit(0))
    number = lambda e: F.coalesce(F.substr(name(e), F.lit(2)).try_cast("int"), F.lit(2**31 - 1))
    aged = F.transform(entries, lambda e: F.struct(F.coalesce(e["last_seen_step"], F.lit(-1)).cast("long").alias("seen"), number(e).alias("number"), e["candidate_id"].alias("id")))
    return F.coalesce(free, F.array_min(aged)["id"])


def price_rubric(kind: Column, open_above: Column) -> Column:
    """Struct (constraint_type, operator, hardness, source) of a price expression's kind."""

    def row(values: tuple) -> Column:
        return F.struct(*[F.lit(v).alias(n) for n, v in zip(("constraint_type", "operator", "hardness", "source"), values)])

    out = F.when(F.coalesce(open_above, F.lit(False)), row(PRICE_WISHES[True])).otherwise(row(PRICE_WISHES[False]))
    for k, values in PRICE_RUBRICS.items():
        out = F.when(kind == k, row(values)).otherwise(out)
    return out


def argument_objects(arguments: Column) -> Column:
    """Whether every text of the array ``arguments`` is a JSON object, as a chat template needs; null
    entries need no conversion, an empty or null array holds."""
    is_object = lambda a: F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(a)), F.lit("OBJECT")), F.lit(False))
    return F.coalesce(F.forall(arguments, lambda a: a.isNull() | is_object(a)), F.lit(True))


def keys_found(names: Sequence[str], suffix: str | None = None, fold: bool = False):
    """FLT16, JSN9: an Arrow UDF from JSON to the sorted forbidden keys at any depth (``names``, or ending
    in ``suffix``; with ``fold`` in lower case and with _ for -).  Null and bad JSON have none."""
    wanted = frozenset(names)

    def walk(text: str | None) -> list[str]:
        try:
            todo, found = [json.loads(text)] if text else [], set()
        except ValueError:
            return []
        while todo:
            node = todo.pop()
            if isinstance(node, dict):
                for k, v in node.items():
                    form = k.casefold().replace("-", "_") if fold else k
                    if form in wanted or (suffix and form.endswith(suffix)):
                        found.add(k)
                    todo.append(v)
            elif isinstance(node, list):
                todo.extend(node)
        return sorted(found)

    @F.pandas_udf("array<string>")
    def keys(texts: pd.Series) -> pd.Series:
        return texts.map(walk)

    return keys


def projection_totals(rows: DataFrame, key: str, order: str) -> DataFrame:
    """ST4: counters of the observations (raw_tokens, visible_tokens, truncated, asins, buttons, footer_kept)
    of every ``key``; ``latest_truncated`` is that of the greatest ``order``."""
    cut = F.coalesce(F.col("truncated"), F.lit(False))
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("observations"),
        F.sum(cut.cast("long")).alias("truncated_count"),
        F.sum("raw_tokens").alias("raw_tokens"),
        F.sum("visible_tokens").alias("visible_tokens"),
        F.max("raw_tokens").alias("max_raw_tokens"),
        F.max("visible_tokens").alias("max_visible_tokens"),
        F.sum("asins").alias("asins"),
        F.sum("buttons").alias("buttons"),
        F.bool_or(cut).alias("any_truncated"),
        F.max_by(cut, order).alias("latest_truncated"),
        F.sum((~F.coalesce(F.col("footer_kept"), F.lit(False))).cast("long")).alias("footer_failures"),
    )


def task_facts(tasks: DataFrame, products: DataFrame, goals: DataFrame) -> DataFrame:
    """JN17: tasks (task_id) with the product of that ordinal and the first goal of its asin; ``problem`` says
    what is missing: ``outside_pool``, ``no_goal`` or ``no_instruction``.  ``products``: (ordinal, asin);
    ``goals``: (goal_order, asin, instruction_text)."""
    first = goals.groupBy("asin").agg(F.min_by(F.struct("goal_order", "instruction_text"), "goal_order").alias("goal"))
    rows = tasks.select("task_id").join(products.select(F.col("ordinal").alias("task_id"), "asin", F.lit(True).alias("known")), "task_id", "left").join(first, "asin", "left")
    query = F.trim(F.col("goal")["instruction_text"])
    problem = F.when(F.col("known").isNull(), "outside_pool").when(F.col("goal").isNull(), "no_goal").when(F.coalesce(query, F.lit("")) == "", "no_instruction")
    return rows.select("task_id", "asin", F.col("goal")["goal_order"].alias("goal_order"), query.alias("query"), problem.alias("problem"))


def accepted_ids(runs: DataFrame, excluded: DataFrame, accepted: Column) -> DataFrame:
    """Distinct task_id of accepted runs that are not ``excluded`` (task_id)."""
    return runs.filter(F.coalesce(accepted, F.lit(False))).select("task_id").join(excluded.select("task_id"), "task_id", "left_anti").distinct()


def assert_every(rows: DataFrame, holds: Column, label: str) -> None:
    """Fails if a row does not hold (nulls do not); at most five such rows come to the driver."""
    bad = rows.filter(~F.coalesce(holds, F.lit(False))).limit(5).collect()
    if bad:
        raise ValueError(f"{label}: {[r.asDict() for r in bad]}")


def residual_targets(targets: dict[str, int], fixed: dict[str, int]) -> dict[str, int]:
    """What is left of each bucket's target after the fixed rows; fails where these exceed it."""
    over = {k: n for k, n in fixed.items() if n > targets.get(k, 0)}
    if over:
        raise ValueError(f"above the target: {over}")
    return {k: n - fixed.get(k, 0) for k, n in targets.items()}
