"""What a request says outright: brands, models, and how strong its words are.

Texts are taken in normal form (STR1, no white space) where a docstring says so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a model token, of 2 to 24 characters with a digit.
MODEL = r"(?<![a-z0-9])(?=[a-z0-9._+-]{2,24}(?![a-z0-9]))(?=[a-z0-9._+-]*\d)[a-z0-9._+-]+"
#: Endings of shop names, in the order they are tried.
SHOP_ENDINGS = ("官方旗舰店", "旗舰店", "专卖店", "专营店", "企业店", "店")
#: Words of a clause that is unclear, hard or soft.
UNCLEAR = "不需要|无需|不用|没有需求|没需求"
HARD = "绝对|必须|务必|一定|不得|不可|不能|不要(?!太)|不超过|不高于|至少|不低于|以内|以下|以上|之间|控制在|别超过|别让"
SOFT = (
    "最好|优先|尽量|希望|偏好|倾向|预期|预计|预估|左右|上下|大概|大约|约莫|约摸|差不多|大致|将近|接近|附近|比较合适|不要太|别太|越.{0,8}越好"
    "|约(?=[零一二两三四五六七八九十百千万\\d])"
)
#: Fixed value: the longest beginning of a shop name that is looked for.
LONGEST_NAME = 12


def clause_class(clause: Column) -> Column:
    """X26, of a clause in normal form: what kind of words it holds; null is a clause without any."""
    has = lambda words: F.coalesce(clause.rlike(words), F.lit(False))
    plain = F.when(has(HARD), "hard_like").when(has(SOFT), "soft_like").otherwise("contextual_marker")
    return F.when(has(UNCLEAR), "ambiguous_negative").when(has(HARD) & has(SOFT), "mixed_hard_soft").otherwise(plain)


def said_models(request: Column, *target: Column) -> Column:
    """SC26: the sorted model tokens of a request that its product's texts hold as well; nulls hold none."""
    tokens = lambda t: F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(MODEL), F.lit(0))
    return F.array_sort(F.array_intersect(tokens(request), tokens(F.concat_ws(" ", *target))))


def said_brands(request: Column, title: Column, shop: Column, aliases: dict[str, str]) -> Column:
    """SC26, of texts in normal form: sorted brands whose alias (two characters or more) is in the request and
    in title or shop, and the longest beginning of the shop's name, without its ending, that request and
    title hold.  Nulls are empty."""
    said, name, own = (F.coalesce(c, F.lit("")) for c in (request, title, shop))
    target = F.concat(name, own)
    known = [F.when(F.contains(said, F.lit(a)) & F.contains(target, F.lit(a)), F.lit(b)) for a, b in aliases.items() if len(a) > 1]
    stem = own
    for ending in reversed(SHOP_ENDINGS):
        stem = F.when(F.endswith(own, F.lit(ending)), F.left(own, F.length(own) - len(ending))).otherwise(stem)
    heads = F.transform(F.sequence(F.lit(LONGEST_NAME), F.lit(2)), lambda n: F.when(F.length(stem) >= n, F.substr(stem, F.lit(1), n)))
    head = F.get(F.filter(heads, lambda h: F.contains(said, h) & F.contains(name, h)), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(F.array(*known, head), lambda b: b.isNotNull())))
