"""Text functions.

Regular expressions name their character classes, since the JVM's shorthands are ASCII.
"""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HAN = "㐀-䶿一-鿿"
#: Names of the currency, and what they are written as.
_CURRENCY_NAMES = (("人民币", "元"), ("块钱", "元"))


def fold(text: str | None) -> str:
    """Compatibility form, case folded."""
    return unicodedata.normalize("NFKC", text or "").casefold()


def query_form(text: str | None) -> str:
    out = fold(text)
    for a, b in _CURRENCY_NAMES:
        out = out.replace(a, b)
    out = re.sub(r"(?<=\d)\s*(?:rmb|cny|yuan)\b", "元", out)
    return " ".join(re.sub(r"[，,。；;：:！!？?、|\s]+", " ", out).split())


@F.pandas_udf(T.StringType())
def normalize_text(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """STR1: folded, without white space."""
    for s in texts:
        yield s.map(lambda t: "".join(fold(t).split()))


@F.pandas_udf(T.StringType())
def normalize_option(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """STR2: folded, without white space, ``/`` written ``|``."""
    for s in texts:
        yield s.map(lambda t: "".join(fold(t).replace("/", "|").split()))


@F.pandas_udf(T.StringType())
def normalize_query(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """RET1: folded, one currency name, punctuation to single spaces."""
    for s in texts:
        yield s.map(query_form)


def tokens(text: Column) -> Column:
    """RET2 over a normalised text: Han bigrams (a lone Han stays), then Latin and number runs with
    inner ``._+-/``; each once, in order."""
    runs = F.regexp_extract_all(text, F.lit(f"([{HAN}]+)"), F.lit(1))
    pairs = F.flatten(
        F.transform(runs, lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(r) - 1)), lambda i: F.substr(r, i, F.lit(2)))))
    )
    return F.array_distinct(F.concat(pairs, F.regexp_extract_all(text, F.lit("([a-z0-9]+(?:[._+\\-/][a-z0-9]+)*)"), F.lit(1))))


def words(text: Column) -> Column:
    """Lower-case ASCII letter and digit runs, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def trigrams(text: Column) -> Column:
    """STR5: distinct character trigrams; a shorter text is its own."""
    n = F.length(text)
    return F.when(n == 0, F.array().cast("array<string>")).when(n < 3, F.array(text)).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 2)), lambda i: F.substr(text, i, F.lit(3))))
    )


def jaccard(a: Column, b: Column) -> Column:
    """STR6: 0 if either side is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def letters_only(text: Column) -> Column:
    """STR4: lower-case letters, digits and Han."""
    return F.regexp_replace(F.lower(text), f"[^a-z0-9{HAN}]", "")


def category_parts(path: Column) -> Column:
    """STR10: trimmed non-empty parts of a ``›`` path."""
    return F.filter(F.transform(F.split(path, "›"), lambda x: F.trim(x)), lambda x: x != "")


def clean_list(values: Column) -> Column:
    """STR16: trimmed, non-empty, each once, in order."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def compact_title(title: Column, limit: int) -> Column:
    """STR14: a long title keeps its head (two thirds) and tail around an ellipsis."""
    head = (limit - 1) * 2 // 3
    tail = limit - 1 - head
    return F.when(F.length(title) <= limit, title).otherwise(F.concat(F.substr(title, F.lit(1), F.lit(head)), F.lit("…"), F.right(title, F.lit(tail))))


def order_key(seed: str, *parts: Column) -> Column:
    """STR20: sha256 of seed and parts, joined by bars."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]), 256)


def result_fingerprint(ids: Column) -> Column:
    """STR22."""
    return F.sha2(F.array_join(ids, "\0"), 256)


def short_id(prefix: str, payload: Column) -> Column:
    """STR18: prefix and 16 hex digits of a sha256."""
    return F.concat(F.lit(prefix), F.left(F.sha2(payload, 256), F.lit(16)))


#: Endings that a requirement may lose.
SUFFIXES = ("材质", "成分", "设计", "功能", "场景", "专用", "款式", "测试剂")


def texts_match(required: str | None, actual: str | None, aliases: dict[str, str]) -> bool:
    """STR7, a ladder from containment to similarity; cheap rungs first."""
    want, seen = "".join(fold(required).split()), "".join(fold(actual).split())
    if not want or not seen:
        return False
    name = aliases.get(want, want)
    forms = {want, *(a for a, c in aliases.items() if c == name)}
    if name == aliases.get(seen, seen) or any(f and f in seen for f in forms):
        return True
    stems = (want.removesuffix(s) for s in SUFFIXES if want.endswith(s))
    if any(len(s) >= 2 and s in seen for s in stems):
        return True
    if len(want) < 4:
        return False
    pairs = {want[i : i + 2] for i in range(len(want) - 1)}
    if sum(p in seen for p in pairs) >= 0.75 * len(pairs):
        return True
    return len(seen) >= 4 and difflib.SequenceMatcher(None, want, seen).ratio() >= 0.86


def semantic_match(aliases: dict[str, str]):
    """An Arrow UDF (required, actual) -> boolean over an alias table."""

    @F.pandas_udf(T.BooleanType())
    def match(required: pd.Series, actual: pd.Series) -> pd.Series:
        return pd.Series([texts_match(a, b, aliases) for a, b in zip(required, actual)])

    return match


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def exact_spans(text: pd.Series, value: pd.Series) -> pd.Series:
    """STR17: all places of a value, whatever the case."""

    def spans(t, v):
        return [{"start": m.start(), "end": m.end()} for m in re.finditer(re.escape(v), t, re.I)] if t and v else []

    return pd.Series([spans(t, v) for t, v in zip(text, value)])


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of ``a`` at a time: a zero bit is a character
    of ``a`` that the subsequence has."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for c in b:
        both = row & masks.get(c, 0)
        row = ((row + both) | (row - both)) & every
    return len(a) - row.bit_count()


def token_set_ratio(left: str | None, right: str | None) -> int:
    """STR26: 0 to 100, how much of two texts' sorted distinct tokens agree: 100 if one has all of the other's, else
    the best of the tokens that differ, with the shared ones before them, and of the shared ones against either
    side.  Letters and digits count, in lower case; a text without any has 0."""
    a, b = ({*"".join(c if c.isalnum() else " " for c in (t or "")).lower().split()} for t in (left, right))
    if not a or not b:
        return 0
    shared = len(" ".join(sorted(a & b)))
    own, other = (" ".join(sorted(x)) for x in (a - b, b - a))
    if shared and not (own and other):
        return 100
    gap = 1 if shared else 0
    whole = 2 * (shared + gap) + len(own) + len(other)
    apart = [((len(own) + len(other) - 2 * common_length(own, other)), whole)]
    if shared:
        apart += [(gap + len(x), 2 * shared + gap + len(x)) for x in (own, other)]
    return round(max(100 - 100 * d / n for d, n in apart))


@F.pandas_udf(T.IntegerType())
def fuzzy_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """STR26 of each pair."""
    return pd.Series([token_set_ratio(a, b) for a, b in zip(left, right)])
