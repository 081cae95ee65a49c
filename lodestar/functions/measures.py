"""Measurements that a request bounds: at most, at least, about, between."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unit -> (dimension, factor).
SAID_UNITS = {
    "毫米": ("length", 0.001), "mm": ("length", 0.001), "厘米": ("length", 0.01), "cm": ("length", 0.01), "米": ("length", 1.0), "m": ("length", 1.0),
    "克": ("weight", 0.001), "g": ("weight", 0.001), "千克": ("weight", 1.0), "公斤": ("weight", 1.0), "kg": ("weight", 1.0),
    "毫升": ("volume", 0.001), "ml": ("volume", 0.001), "升": ("volume", 1.0), "l": ("volume", 1.0),
    "英寸": ("inch", 1.0), "寸": ("cun", 1.0), "支": ("count", 1.0), "个": ("count", 1.0), "片": ("count", 1.0), "只": ("count", 1.0), "套": ("count", 1.0), "包": ("count", 1.0),
}
#: Operator -> words before and words behind an amount.
CUES = {
    "lte": (("不超过", "不能超过", "至多", "最大", "最大为", "最大到", "小于等于"), ("以内", "以下", "及以下")),
    "gte": (("不少于", "不低于", "至少", "最小", "最小为", "最小到", "大于等于"), ("以上", "及以上", "起")),
    "around": ((), ("左右", "上下")),
}
#: Signs between the ends of a range, and how far about reaches.
BETWEEN, ABOUT = "-~～至到", 0.1

_UNIT = "|".join(sorted(SAID_UNITS, key=len, reverse=True))
# Runs are possessive and no amount starts within one, so a text is read once.
_AMOUNT = re.compile(rf"(?P<n>(?<!\d)\d++(?:\.\d++)?)\s*+(?P<u>{_UNIT})")
_WHOLE = re.compile(rf"{_AMOUNT.pattern}(?![a-z])")
_LOW = re.compile(rf"(?P<n>(?<!\d)\d++(?:\.\d++)?)\s*+(?:(?P<u>{_UNIT})\s*+)?[{BETWEEN}]\s*+{_AMOUNT.pattern.replace('<n>', '<m>').replace('<u>', '<v>')}")


class Bound(NamedTuple):
    operator: str
    dimension: str
    value: float | None
    low: float | None
    high: float | None
    text: str


def _in_base(number: str, unit: str) -> tuple[str, float]:
    dimension, factor = SAID_UNITS[unit]
    return dimension, float(number) * factor


def amounts(text: str | None) -> list[tuple[str, float]]:
    """(dimension, value) of each measure of a text; no letter follows its unit."""
    folded = unicodedata.normalize("NFKC", text or "").casefold()
    return [_in_base(m["n"], m["u"]) for m in _WHOLE.finditer(folded)]


def bounds(request: str | None) -> list[Bound]:
    """NUM4: ranges first, then at most, at least and about, cues in front before those behind; an amount
    with its cue that touches a range is a part of it.  Nulls and texts without a cue have none."""
    text = unicodedata.normalize("NFKC", request or "").casefold()
    out, taken = [], []
    for m in _LOW.finditer(text):
        kind, low = _in_base(m["n"], m["u"] or m["v"])
        other, high = _in_base(m["m"], m["v"])
        if kind == other and low <= high:
            taken.append(m.span())
            out.append(Bound("between", kind, None, low, high, m[0]))
    amounts, solid = list(_AMOUNT.finditer(text)), [m.start() for m in re.finditer(r"\S", text)] + [len(text)]
    for operator, (before, behind) in CUES.items():
        found = []
        for m in amounts:
            at = bisect_left(solid, m.start())
            head, tail = solid[at - 1] + 1 if at else 0, solid[bisect_left(solid, m.end())]
            cue = max((c for c in before if text.endswith(c, 0, head)), key=len, default=None)
            if cue:
                found.append((0, head - len(cue), m.end(), m))
            cue = next((c for c in behind if text.startswith(c, tail)), None)
            if cue:
                found.append((1, m.start(), tail + len(cue), m))
        for _, a, b, m in sorted(found, key=lambda f: f[:2]):
            k = bisect_left(taken, (b,))  # ranges do not overlap: of those that start before b the last ends last
            if not k or taken[k - 1][1] <= a:
                kind, value = _in_base(m["n"], m["u"])
                reach = value * ABOUT if operator == "around" else None
                out.append(Bound(operator, kind, value, None if reach is None else value - reach, None if reach is None else value + reach, text[a:b]))
    return out


_BOUND = T.StructType([T.StructField(n, T.StringType() if n in ("operator", "dimension", "text") else T.DoubleType()) for n in Bound._fields])


@F.pandas_udf(T.ArrayType(_BOUND))
def said_bounds(texts: pd.Series) -> pd.Series:
    """The bounds of each request."""
    return texts.map(lambda t: [b._asdict() for b in bounds(t)])
