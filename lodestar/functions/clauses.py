"""Clauses of a request: how they are cut, and what in the request speaks for a value.

Texts here come with their ``form``: compatibility form, case folded, without white space.
"""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import let
from .text import fold

# Fixed values -------------------------------------------------------------------------------
#: Punctuation between clauses.
PUNCTUATION = r"[\n\r，。；！？,;!?]+"
#: Words that open the scope of a requirement, a bound or a preference.
SCOPE = (
    r"绝对(?:不要|不能|不许)|坚决不要|严禁|禁止|一定(?:不要|不能|不需要|要|得|需)|必须|务必"
    r"|不要超过|别超过|不能超过|不得超过|不可超过|不超过|不高于|至少|不低于|不少于|控制在|不得|不可|不能有|不要(?!太)"
    r"|不需要|无需|不用|无所谓|不要求|没要求|无要求|不限|不限制|不限定|任意|随意|随便|不挑|可有可无|也可以|也行|都可以|都行|均可"
    r"|最好|优先|尽量|希望|偏好|倾向|预期|预计|预估|大概|大约|约莫|约摸|差不多|大致|将近|接近|附近|不要太|别太|比较合适"
    r"|约(?=[零一二两三四五六七八九十百千万\d])"
)
#: Words that only link one scope to the next.
LINKS = (
    "的 地 得 要 需 需要 能 能够 可以 可 是 为 在 有 带 用 使用 选 选择 采用 控制 保持 落在 做成 设为 并 且 并且 而且 同时 还 也 又 或 或者 以及 但 但是 不过 "
    "价格 价位 预算 金额 总价 单价 定金 规格 尺寸 大小 容量 重量 长度 宽度 高度 厚度 功率 电压 数量 颜色 材质 款式 型号 品牌 功能 属性 范围 区间 整体 目前 我的"
).split()
#: What a segment loses at its ends.
EDGES = " \t、和及并且但也"
#: Words that make a value optional: anywhere in its clause, in the characters before it, in those after it.
OPTIONAL = r"无所谓|不要求|没要求|无要求|不限|不限制|不限定|任意|随意|随便|不挑|可有可无|不需要(?:有|带有|具备)|不用参与|不用减脂"
OPTIONAL_BEFORE = r"也可以|也行|可以是|可选|最好(?:是|用|选|要|能|有)?|优先(?:是|用|选|要)?|尽量(?:是|用|选|要)?"
OPTIONAL_AFTER = r"也可以|也行|都行"
NEAR = 16
#: A plan right before a value: the value is background.
BACKGROUND = r"(?:准备|打算|计划|正要|将要|快要)去.{0,8}$"
#: A number with a unit, which may be aligned in parts.
MEASURE = r"\d+(?:\.\d+)?(?:mm|cm|m|ml|l|g|kg)"
#: Part of a value that its aligned blocks must cover.
COVERED = 0.60
# --------------------------------------------------------------------------------------------

_SCOPE, _LINKS, _LONGEST = re.compile(SCOPE), frozenset(LINKS), max(map(len, LINKS))
SAID = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("form", T.StringType())]))
FOUND = T.ArrayType(T.StructType([T.StructField("step", T.StringType()), T.StructField("text", T.StringType())]))


def form(text: str | None) -> str:
    return "".join(fold(text).split())


class Linking:
    """Whether all text since the last cut is made of linking words; text is added as it is read."""

    def __init__(self):
        self.tail, self.ends = "", [True]

    def add(self, text: str) -> None:
        for c in text:
            self.tail = (self.tail + c)[-_LONGEST:]
            hit = any(self.ends[-k] and self.tail[-k:] in _LINKS for k in range(1, min(_LONGEST, len(self.ends), len(self.tail)) + 1))
            self.ends = [*self.ends[1 - _LONGEST :], hit] if _LONGEST > 1 else [hit]

    def __bool__(self) -> bool:
        return self.ends[-1]


def scopes(clause: str) -> list[str]:
    """A clause without punctuation, cut where a scope opens after the one before it has said something."""
    clause = clause.strip()
    marks = list(_SCOPE.finditer(clause))
    if not clause or len(marks) < 2:
        return [clause] if clause else []
    cuts, linking, read = [0], Linking(), 0
    for here, mark in enumerate(marks):
        linking.add(_SCOPE.sub("", form(clause[read : mark.start()])))
        if here and not linking:
            cuts.append(mark.start())
            linking = Linking()
        read = mark.end()
    if len(cuts) == 1:
        return [clause]
    return [s for s in (clause[a:b].strip(EDGES) for a, b in zip(cuts, [*cuts[1:], None])) if s] or [clause]


def split_clauses(text: str | None) -> list[str]:
    """STR23: the clauses of a request, each once, in order."""
    return list(dict.fromkeys(s for clause in re.split(PUNCTUATION, text or "") for s in scopes(clause)))


def evidence_steps(request_form: str, value: str | None, aliases: dict[str, str], others: dict[str, list[str]]) -> list[tuple[str, str]]:
    """STR24: what of a request speaks for a value, each with its step: the value itself (``whole``), else its parts
    (``part``), aliases of it (``alias``), and the blocks of an alignment if they cover enough of it (``block``)."""
    value = (value or "").strip()
    want = form(value)
    if not want:
        return []
    if want in request_form:
        return [("whole", value)]
    out = [("part", p) for p in re.split(r"[^0-9a-zA-Z一-鿿]+", value) if len(form(p)) >= 2 and form(p) in request_form]
    name = aliases.get(want)
    out += [("alias", a) for a in (others.get(name, ()) if name else ()) if len(a) >= 2 and a in request_form]
    coded = re.search("[a-z]", want) and re.search(r"\d", want) and not re.fullmatch(MEASURE, want)
    if not coded:
        blocks = [want[b.a : b.a + b.size] for b in difflib.SequenceMatcher(None, want, request_form, autojunk=False).get_matching_blocks() if b.size > 1]
        if sum(map(len, blocks)) >= COVERED * len(want):
            out += [("block", b) for b in blocks]
    return list(dict.fromkeys(out))


def found_evidence(request_form: str, value: str | None, aliases: dict[str, str], others: dict[str, list[str]]) -> list[str]:
    """STR24: what all steps find, in their order, each text once."""
    return list(dict.fromkeys(text for _, text in evidence_steps(request_form, value, aliases, others)))


def _said(texts: list[str]) -> list[dict]:
    return [{"text": t, "form": form(t)} for t in texts]


@F.pandas_udf(SAID)
def segments(requests: pd.Series) -> pd.Series:
    """STR23: clauses with their forms; none of a null."""
    return requests.map(lambda t: _said(split_clauses(t)))


def _searched(find, kind: T.DataType, aliases: dict[str, str] | None):
    aliases = aliases or {}
    others: dict[str, list[str]] = {}
    for a, c in aliases.items():
        others.setdefault(c, []).append(a)

    @F.pandas_udf(T.ArrayType(kind))
    def search(requests: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for request, wanted in zip(requests, values):
            whole = form(request)
            out.append([find(whole, v, aliases, others) for v in (wanted if wanted is not None else ())])
        return pd.Series(out)

    return search


def evidence(aliases: dict[str, str] | None = None):
    """STR24 as an Arrow UDF (request, values) -> for each value what of the request speaks for it.
    ``aliases``: form -> canonical form.  Nulls are empty."""
    return _searched(lambda *a: _said(found_evidence(*a)), SAID, aliases)


def evidence_by_step(aliases: dict[str, str] | None = None):
    """STR24 as ``evidence``, but each text with the step that finds it, once a step."""
    return _searched(lambda *a: [{"step": s, "text": t} for s, t in evidence_steps(*a)], FOUND, aliases)


def _apart(clause: Column, said: Column) -> tuple[Column, Column, Column]:
    """(the clause holds it, what stands before its first place, what stands after it), of forms."""
    at = F.position(said, clause)
    return (at > 0) & (said != ""), F.substr(clause, F.lit(1), at - 1), F.substr(clause, at + F.length(said))


def is_optional(clause: Column, said: Column) -> Column:
    """The clause makes the evidence a preference or says that it does not matter."""
    here, before, after = _apart(clause, said)
    return here & (clause.rlike(OPTIONAL) | F.right(before, F.lit(NEAR)).rlike(OPTIONAL_BEFORE) | F.left(after, F.lit(NEAR)).rlike(OPTIONAL_AFTER))


def is_background(clause: Column, said: Column) -> Column:
    """The clause tells of a plan, and the evidence is part of it."""
    here, before, _ = _apart(clause, said)
    return here & before.rlike(BACKGROUND)


def partition(found: Column, clauses: Column) -> Column:
    """STR25: struct (required, optional) of evidence.  Evidence is optional if every clause with it makes it
    so, and none at all if every clause is background."""
    def weighed(e: Column) -> Column:
        having = F.filter(clauses, lambda c: F.contains(c["form"], e["form"]))
        told = lambda h: F.transform(h, lambda c: F.when(is_background(c["form"], e["form"]), 2).when(is_optional(c["form"], e["form"]), 1).otherwise(0))
        # how light the clauses with it make it: 2 all background, 1 all optional or background, 0 one requires it
        return F.struct(e.alias("e"), F.when(F.size(having) > 0, F.array_min(told(having))).otherwise(0).alias("light"))

    of = lambda all_, n: F.transform(F.filter(all_, lambda x: x["light"] == n), lambda x: x["e"])
    return let(F.transform(found, weighed), lambda all_: F.struct(of(all_, 0).alias("required"), of(all_, 1).alias("optional")))
