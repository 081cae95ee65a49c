"""Price language of requests: amounts, expressions and the one constraint they come to."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, insort
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import let

# Fixed values -------------------------------------------------------------------------------
DIGITS = dict(zip("零〇一二两三四五六七八九", (0, 0, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9)))
SMALL = {"十": 10, "百": 100, "千": 1000}
LARGE = {"万": 10_000, "亿": 100_000_000}
LABEL = r"(?:预算|价格|售价|价位|价钱)"
CURRENCY = r"(?:元|块(?:钱)?)"
SOFT = r"(?:大约|大概|约莫|约摸|差不多|大致|将近|接近|近|约)"
UPPER = r"(?:不超过|不要超过|别超过|别超|不能超过|不得超过|不可超过|不高于|最高|至多|最多|上限|封顶|低于|小于)"
LOWER = r"(?:不低于|至少|最低|不少于|高于|大于|超过|起码)"
AROUND = r"(?:左右|上下|前后|附近|差不多)"
ABOVE = r"(?:多(?:一点|一些)?|出头|开外|往上|以上|起)"
LOOSE = r"(?:多|来|余)"
WITHIN = r"(?:以内|以下|之内|内)"
FEES = r"(?:(?:设计|手工|加工|安装|配送|服务|定制|补|尾|订|定|工|运|邮)费|补款|尾款|订金|定金)(?:在|为|是)?$"
UNIT_PRICE = r"每\s*(平方米|平米|㎡|包|罐|瓶|盒|袋|条|件|个|只|支|斤|公斤|千克|克|杯)\s*(?:的)?\s*(?:价格|售价|价钱|单价)"
PIECES = r"(?:米|件|个|只|支|包|罐|斤|克|公斤|套|箱)\s*\d"
TOTALS = r"(?:一共|总共|合计|共|每|单价)"
TOLERANCE = 0.20
# --------------------------------------------------------------------------------------------

# Runs are possessive and amounts start no run in its middle, so a text is read once.
_PLAIN = r"\d++(?:\.\d++)?"
_MIXED = rf"{_PLAIN}\s*+[万千]\s*+{_PLAIN}(?:\s*+千)?"
_HAN_MARKS = "零〇一二两三四五六七八九十百千万亿"
_HAN = rf"(?<![{_HAN_MARKS}])[{_HAN_MARKS}]++(?:点[零〇一二两三四五六七八九]++)?"
_SET = rf"(?:{LABEL}\s*+(?:控制)?\s*+(?:在|为|是)?\s*+)"
#: Characters, white space aside, that the cues on one side of an amount span at most, and those of an amount.
CUES, DIGITS_MOST = 16, 40


def plain(text: object) -> str:
    return unicodedata.normalize("NFKC", "" if text is None else str(text)).translate({ord(","): None, ord("，"): None})


def _whole(text: str) -> int:
    for mark, size in (("亿", LARGE["亿"]), ("万", LARGE["万"])):
        *left, right = text.split(mark)
        if left:
            return [*accumulate(map(_whole, left), lambda a, b: a * size + b)][-1] * size + _whole(right)
    total = 0
    for digit, unit in re.findall(r"([零〇一二两三四五六七八九]*)([十百千]?)", text):
        last = DIGITS[digit[-1]] if digit else 0
        total += (last or 1) * SMALL[unit] if unit else last
    return total


def chinese_amount(text: str) -> float:
    """NUM6: written amounts, with the omitted last place of speech (两千五, 一百三)."""
    text = plain(text).strip()
    head, _, tail = text.partition("点")
    if not head or re.search(r"[^零〇一二两三四五六七八九十百千万亿]", head) or re.search(r"[^零〇一二两三四五六七八九]", tail):
        raise ValueError(f"no amount: {text!r}")
    value = float(_whole(head))
    short = re.search(r"([十百千万亿])[零〇一二两三四五六七八九]*?([零〇一二两三四五六七八九])$", head)
    if short and head[-2] != "零":
        unit, digit = (SMALL | LARGE)[short[1]], DIGITS[short[2]]
        if unit >= 1000:
            value += digit * (unit // 10 - 1)
        elif unit == 100 and len(head) == 3 and head[0] in DIGITS:
            value += digit * 9
    return value + (float("0." + "".join(str(DIGITS[c]) for c in tail)) if tail else 0.0)


def _multiple(unit: str | None) -> int:
    return {"万": 10_000, "千": 1000, "k": 1000}.get(plain(unit).casefold(), 1)


def amount(number: str, unit: str | None = None) -> float:
    """NUM7: plain, mixed (1万2) and Chinese amounts, times the unit.  What follows the large unit of a mixed
    amount counts as it says if it is ten or more or has a 千 of its own, else in tenths of the large unit."""
    text = "".join(plain(number).split())
    head, mark, rest = next(((h, m, r) for h, m, r in map(text.partition, "万千") if m and r and h[:1].isdigit()), (text, "", ""))
    if not mark:
        return (float(text) if text[:1].isdigit() else chinese_amount(text)) * _multiple(unit)
    tail = float(rest.removesuffix("千"))
    scale = 1000 if rest.endswith("千") else _multiple(mark) / 10 if tail < 10 else 1
    return (float(head) * _multiple(mark) + tail * scale) * _multiple(unit)


class Expression(NamedTuple):
    kind: str
    value: float | None
    lower: float | None
    upper: float | None
    text: str
    start: int
    end: int
    approximate: bool
    inclusive: bool


#: An amount as a whole: no digit, unit or point goes on after it.
_AMOUNT = re.compile(rf"((?<!\d)(?:{_MIXED}|{_PLAIN})|{_HAN})\s*(万|千|[kK])?(?![零〇一二两三四五六七八九十百千万亿点\d.kK])")
_CUR = rf"\s*{CURRENCY}?"
#: What may stand right before an amount, by name.
_BEFORE = {
    name: re.compile(rf"{cue}\Z")
    for name, cue in {"any": rf"{_SET}?(?:{SOFT}\s*+)?", "at_most": rf"{_SET}?{UPPER}\s*+", "at_least": rf"{_SET}?{LOWER}\s*+", "about": rf"{_SET}?{SOFT}\s*+(?:在|为|是)?\s*+", "label": _SET}.items()
}
#: What may stand right after it.
_HINTS = rf"{AROUND}|{WITHIN}|以上|起|{ABOVE}"
_AFTER = {
    name: re.compile(cue)
    for name, cue in {
        "any": _CUR, "within": rf"{_CUR}\s*{WITHIN}", "upward": rf"{_CUR}\s*(?:以上|起步|起)", "around": rf"{_CUR}\s*{AROUND}", "loose": rf"\s*{LOOSE}\s*{CURRENCY}?", "plus": rf"\s*(?:{CURRENCY}\s*)?\+",
        "and_more": rf"\s*(?:{LOOSE}\s*{CURRENCY}?|{CURRENCY}?\s*{ABOVE})(?:\s*(?:就行|即可|可以|能接受))?", "no_hint": rf"{_CUR}(?!\s*(?:{_HINTS}))", "alone": rf"{_CUR}(?!\s*(?:[-~～—至到+]|{LOOSE}|{_HINTS}))",
    }.items()
}
_TO = re.compile(rf"{_CUR}\s*(?:-|~|～|—|至|到)\s*")
_RANGE_END = re.compile(rf"{_CUR}(?:之间|区间|范围内|以内|之内)?")
#: Readings of one amount, the stronger first: (kind, cue before, cue after).  A range is stronger than all.
READINGS = (
    ("preference", "at_most", "loose"), ("upper", "at_most", "any"), ("lower", "at_least", "any"), ("upper", "any", "within"), ("lower", "any", "upward"), ("preference", "any", "and_more"),
    ("around", "any", "around"), ("around", "about", "no_hint"), ("upper", "label", "alone"), ("preference", "any", "plus"),
)


class Reading(NamedTuple):
    """An amount (or two) with the span of its cues, and how strong that is (0 the most)."""

    rank: int
    start: int
    end: int
    kind: str
    low: float
    high: float | None


_LABELLED = re.compile(f"{LABEL}|{CURRENCY}")


def _readings(text: str) -> list[Reading]:
    """Every reading of every amount that has a label or a currency within reach of its cues."""
    out, last = [], None
    named = [m.start() for m in _LABELLED.finditer(text)]
    solid = [m.start() for m in re.finditer(r"\S", text)] if named else []
    if not named:
        return out
    for m in _AMOUNT.finditer(text):
        if len(m[1]) > DIGITS_MOST:
            continue
        at = bisect_left(solid, m.start())
        first = solid[max(0, at - CUES)]
        beyond = bisect_left(solid, m.end()) + CUES
        until = solid[beyond] if beyond < len(solid) else len(text)
        k = bisect_left(named, first)
        near, value = k < len(named) and named[k] < until, amount(m[1], m[2])
        if last is not None and (near or last[2]) and _TO.fullmatch(text, last[0].end(), m.start()):
            out.append(Reading(0, _BEFORE["any"].search(text, last[3], last[0].start()).start(), _RANGE_END.match(text, m.end()).end(), "range", last[1], value))
        if near:
            cues = {name: cue.search(text, first, m.start()) for name, cue in _BEFORE.items()}
            for rank, (kind, before, after) in enumerate(READINGS, 1):
                cue, rest = cues[before], cues[before] and _AFTER[after].match(text, m.end())
                if cue and rest:
                    out.append(Reading(rank, cue.start(), rest.end(), kind, value, None))
        last = m, value, near, first
    return out


def _is_price(r: Reading, text: str) -> bool:
    """A fee is no price; an amount needs a label or a currency; a labelled one alone is neither a count nor a part."""
    span = text[r.start : r.end]
    if re.search(FEES, text[max(0, r.start - 8) : r.start]):
        return False
    if r.rank and READINGS[r.rank - 1][1] == "label":
        rest = text[r.end : r.end + 20]
        return not re.match(TOTALS, rest) and bool(re.search(CURRENCY, span) or not re.match(PIECES, rest))
    return bool(re.search(LABEL, span) or re.search(CURRENCY, span))


def expressions(text: object) -> list[Expression]:
    """NUM9: price expressions that do not overlap, by place: of readings that overlap the stronger counts."""
    text, out, taken = plain(text), [], []
    for r in sorted(_readings(text)):
        if r.low <= 0 or (r.high is not None and r.high < r.low) or not _is_price(r, text):
            continue
        k = bisect_left(taken, (r.end,))  # those before k start before this reading ends; they do not overlap, so the last ends last
        if k and taken[k - 1][1] > r.start:
            continue
        insort(taken, (r.start, r.end))
        span = text[r.start : r.end]
        low, high = (max(0.0, r.low - r.low * TOLERANCE), r.low + r.low * TOLERANCE) if r.kind == "around" else (None, None) if r.high is None else (r.low, r.high)
        strict = {"upper": r"低于|小于", "lower": r"高于|大于|超过"}.get(r.kind)
        out.append(Expression(r.kind, r.low if r.high is None else None, low, high, span, r.start, r.end, r.kind in ("around", "preference"), not (strict and re.search(strict, span))))
    return sorted(out, key=lambda e: e.start)


_TYPES = (T.StringType(), T.DoubleType(), T.DoubleType(), T.DoubleType(), T.StringType(), T.IntegerType(), T.IntegerType(), T.BooleanType(), T.BooleanType())


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, t) for n, t in zip(Expression._fields, _TYPES)])))
def extract_prices(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [e._asdict() for e in expressions(t)])


def budget(found: Column) -> Column:
    """NUM10: the least upper price."""
    return F.array_min(F.transform(F.filter(found, lambda e: e["kind"].isin("upper", "range", "around")), lambda e: F.coalesce(e["upper"], e["value"])))


def constraint(found: Column) -> Column:
    """NUM11: a range, else upper and lower together, else either, else the last that is around; with what the
    request says, and of two bounds whether each is included."""
    of = lambda kind: F.filter(found, lambda e: e["kind"] == kind)
    best = lambda kind, sign: F.array_sort(of(kind), lambda a, b: F.when(a["value"] * sign < b["value"] * sign, -1).when(a["value"] * sign > b["value"] * sign, 1).otherwise(a["start"] - b["start"]))[0]
    best_of = F.struct(
        F.get(F.filter(F.array(F.when(F.size(of("upper")) > 0, best("upper", 1))), lambda e: e.isNotNull()), F.lit(0)).alias("up"),
        F.get(F.filter(F.array(F.when(F.size(of("lower")) > 0, best("lower", -1))), lambda e: e.isNotNull()), F.lit(0)).alias("low"),
        F.get(of("range"), F.lit(0)).alias("rng"),
        F.element_at(F.when(F.size(of("around")) > 0, of("around")), -1).alias("near"),
    )
    none, plain_text = F.lit(None).cast("double"), F.lit(None).cast("boolean")

    def out(op: Column, value: Column, lo: Column, hi: Column, approx: bool, said: Column, lo_in: Column = plain_text, hi_in: Column = plain_text) -> Column:
        return F.struct(op.alias("operator"), value.alias("value"), lo.alias("min"), hi.alias("max"), lo_in.alias("min_inclusive"), hi_in.alias("max_inclusive"), F.lit(approx).alias("approximate"), said.alias("text"))

    def chosen(x: Column) -> Column:
        up, low, rng, near = (x[n] for n in ("up", "low", "rng", "near"))
        both = F.when(low["value"] <= up["value"], out(F.lit("between"), none, low["value"], up["value"], False, F.concat(low["text"], F.lit("；"), up["text"]), low["inclusive"], up["inclusive"]))
        return (
            F.when(rng.isNotNull(), out(F.lit("between"), none, rng["lower"], rng["upper"], False, rng["text"], F.lit(True), F.lit(True)))
            .when(up.isNotNull() & low.isNotNull(), both)
            .when(up.isNotNull(), out(F.when(up["inclusive"], "lte").otherwise("lt"), up["value"], none, none, False, up["text"]))
            .when(low.isNotNull(), out(F.when(low["inclusive"], "gte").otherwise("gt"), low["value"], none, none, False, low["text"]))
            .when(near.isNotNull(), out(F.lit("approximately"), near["value"], near["lower"], near["upper"], True, near["text"]))
        )

    return let(best_of, chosen)


def basis(text: Column) -> Column:
    """NUM12: the unit of a unit price, null for the whole."""
    unit = F.regexp_extract(text, UNIT_PRICE, 1)
    return F.when(unit == "", None).when(unit.isin("平米", "㎡"), "平方米").otherwise(unit)
