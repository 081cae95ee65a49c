"""SC12: a required option that no option value equals may still be met by what the product shows.

Every fragment of the requirement has to be found among the selected values, or among selected values and
the product's texts unless the selection speaks against it: another number of the same unit, or
other colours.  Failing that, measures of the selection may satisfy the bounds that the request sets
and the required value satisfies too.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import measures
from ..functions.text import fold, texts_match

# Counted units, colours, and the names of the two ways to match.
QUANTITY = re.compile(r"([一二三四五六七八九十百\d]+)\s*(阶|罐|瓶|桶|支|包|盒|套|个|片|g|kg|ml|l|cm|mm|英寸|寸)", re.I)
COLOURS = ("黑色", "白色", "红色", "橙色", "黄色", "绿色", "蓝色", "紫色", "粉色", "灰色", "银色", "金色")
SHOWN, MEASURED = "public_query_option_visible_evidence_v3", "instruction_numeric_option_constraint_v1"


def option_form(text: str | None) -> str:
    return "".join(fold(text).replace("/", "|").split())


def fragments(required: str | None, evidence: list[str] | None) -> list[str]:
    """The evidence, or the parts of the required value, in option form; of one character only letters and digits."""
    parts = re.split(r"[^0-9a-zA-Z一-鿿]+", required or "") if evidence is None else evidence
    return [f for f in map(option_form, parts) if len(f) > 1 or re.fullmatch("[a-z0-9]", f)]


def conflicts(wanted: str, selected: str) -> bool:
    """A number of a unit that the selection gives otherwise, or colours with none in common."""
    chosen: dict[str, set[str]] = {}
    for n, unit in QUANTITY.findall(selected):
        chosen.setdefault(unit.casefold(), set()).add(n)
    if any(n not in chosen.get(unit.casefold(), {n}) for n, unit in QUANTITY.findall(wanted)):
        return True
    asked, taken = ({c for c in COLOURS if c in t} for t in (wanted, selected))
    return bool(asked and taken) and asked.isdisjoint(taken)


def satisfies(measure: tuple[str, float], bound: measures.Bound) -> bool:
    dimension, value = measure
    if dimension != bound.dimension:
        return False
    if bound.operator in ("lte", "gte"):
        return value <= bound.value if bound.operator == "lte" else value >= bound.value
    return bound.low <= value <= bound.high


def shown_match(required: str | None, evidence: list[str] | None, selected: list[str], shown: list[str], request: str | None, aliases: dict[str, str]) -> str | None:
    wanted, selected = fragments(required, evidence), [s for s in selected if s and s.strip()]

    def one(fragment: str, value: str) -> bool:
        if len(fragment) == 1:
            return re.search(rf"(?<![a-z0-9]){fragment}(?![a-z0-9])", option_form(value)) is not None
        return texts_match(fragment, value, aliases)

    every = lambda values: bool(wanted) and all(any(one(f, v) for v in values) for f in wanted)
    if every(selected) or every([*selected, *(s for s in shown if s)]) and not conflicts(" ".join(wanted), " ".join(selected)):
        return SHOWN
    have, want = measures.amounts(" ".join(selected)), measures.amounts(required)
    applicable = [b for b in measures.bounds(request) if any(satisfies(m, b) for m in want)] if have and want else []
    return MEASURED if applicable and all(any(satisfies(m, b) for m in have) for b in applicable) else None


def visible_match(aliases: dict[str, str] | None = None):
    """An Arrow function (required, evidence, selected values, product texts, request) -> how they match, null if
    they do not.  Null evidence stands for the parts of the required value; other nulls are empty."""

    @F.pandas_udf(T.StringType())
    def match(required: pd.Series, evidence: pd.Series, selected: pd.Series, shown: pd.Series, request: pd.Series) -> pd.Series:
        listed = lambda x: [] if x is None else list(x)
        return pd.Series([shown_match(r, None if e is None else list(e), listed(s), listed(p), q, aliases or {}) for r, e, s, p, q in zip(required, evidence, selected, shown, request)], dtype=object)

    return match
