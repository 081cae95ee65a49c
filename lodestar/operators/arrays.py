"""Token arrays, aligned batches and measurements in texts."""

from __future__ import annotations

from json import loads

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that deny what follows them.
NEGATIONS = ("不支持", "不含", "不具备", "没有", "无", "非")


def common_prefix(a: Column, b: Column) -> Column:
    """ARR2: how many first elements are equal."""
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.arrays_zip(F.slice(a, F.lit(1), n).alias("x"), F.slice(b, F.lit(1), n).alias("y")), lambda p: p["x"].eqNullSafe(p["y"]))
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1).otherwise(n).cast("int")


def assistant_labels(tokens: Column, roles: Column, ignore: int = -100) -> Column:
    """ARR1: labels of a token array: the token where the assistant wrote it, else ``ignore``."""
    return F.zip_with(tokens, roles, lambda t, r: F.when(r == "assistant", t).otherwise(F.lit(ignore)))


def concat_batches(parts: list[DataFrame]) -> DataFrame:
    """ARR3: batches of attempts one after the other; all must have the same columns."""
    if len({tuple(sorted(p.columns)) for p in parts}) > 1:
        raise ValueError("batches differ in their columns")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def drop_leading_groups(ids: Column, mask: Column, prompt: int, most: int, keep: int = 1) -> Column:
    """WN10: how many leading tokens of a response go so that the rest fits ``most`` beside the prompt: a group is
    a run of generated tokens (mask 1) with the run of observed ones (0) after it; the smallest number of whole
    groups goes, the last ``keep`` stay; null if even that does not fit."""
    n = F.size(mask)
    starts = F.filter(F.transform(mask, lambda m, i: F.when((m == 1) & ((i == 0) | (F.get(mask, i - 1) == 0)), i)), lambda i: i.isNotNull())
    cuts = F.concat(F.array(F.lit(0)), F.slice(starts, F.lit(2), F.greatest(F.size(starts) - keep, F.lit(0))))
    return F.get(F.filter(cuts, lambda c: n - c + prompt <= most), F.lit(0))


def token_audit(df: DataFrame, tokens: str, most: int) -> DataFrame:
    """One row: rows, rows above ``most``, total, mean, least, most and nearest-rank p95 of token counts."""
    c = F.col(tokens)
    return df.agg(F.count(c).alias("n"), F.count(F.when(c > most, 1)).alias("over"), F.sum(c).alias("total"), F.avg(c).alias("mean"), F.min(c).alias("least"), F.max(c).alias("most"), F.expr(f"percentile_disc(0.95) within group (order by {tokens})").alias("p95"))


def stated(text: Column, value: Column) -> Column:
    """STR8: a value stands in a text and is not denied: true, false where it does not stand there, null where
    every place is denied by a word of ``NEGATIONS`` right before it."""
    pieces = F.split(text, F.concat(F.lit("\\Q"), value, F.lit("\\E")))
    before = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))
    denied = lambda p: F.regexp_like(F.right(p, F.lit(4)), F.lit(f"({'|'.join(NEGATIONS)})$"))
    return F.when(F.size(before) == 0, False).when(F.exists(before, lambda p: ~denied(p)), True)


def flat_text(json: Column, by_key: bool = True) -> Column:
    """RET4 (keys sorted), STR11 (keys as they come): keys and values of nested JSON, in order and without nulls.  Of a
    repeated key the last value counts; null where the text is no JSON."""

    @F.pandas_udf("array<string>")
    def walk(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _walked(t, by_key))

    return walk(json)


def _walked(text: str | None, by_key: bool) -> list[str] | None:
    try:
        todo, out = [loads(text)], []
    except (TypeError, ValueError, RecursionError):
        return None
    while todo:  # a stack, so depth is no matter; what is to come first lies on top
        value = todo.pop()
        if isinstance(value, dict):
            keys = sorted(value) if by_key else list(value)
            todo += [x for k in reversed(keys) for x in (value[k], k)]
        elif isinstance(value, list):
            todo += reversed(value)
        elif value is not None:
            out.append(str(value))
    return out


def price_steps(price: Column, steps: list[float], count: int = 4) -> Column:
    """NUM16: the first ``count`` steps of a ladder that are above a price."""
    return F.slice(F.filter(F.lit([float(s) for s in steps]), lambda s: s > price), 1, count)


def excluded(sources: list[DataFrame], key: str) -> DataFrame:
    """SET2: the distinct keys of all sources."""
    out = sources[0].select(key)
    for s in sources[1:]:
        out = out.unionByName(s.select(key))
    return out.filter(F.col(key).isNotNull()).distinct()


def assert_disjoint(a: DataFrame, b: DataFrame, key: str, what: str) -> None:
    """JN10, SET1: fails if any key is on both sides, and names a few."""
    found = a.select(key).intersect(b.select(key)).limit(5).collect()
    if found:
        raise ValueError(f"{what}: {sorted(r[0] for r in found)}")


def recover(selected: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """SRC10: the full rows of selected keys; fails if one is missing."""
    lost = selected.select(key).join(rows.select(key), key, "left_anti").limit(5).collect()
    if lost:
        raise ValueError(f"no rows for {sorted(r[0] for r in lost)}")
    return rows.join(selected.select(key).distinct(), key, "left_semi")


def split_rewards(df: DataFrame, key: str, kept: DataFrame, retryable: str = "retryable") -> tuple[DataFrame, DataFrame]:
    """(rows of the groups that stay, keys of dropped groups worth another attempt); ``kept``: key,
    drop_reason, retryable."""
    return df.join(kept.filter("drop_reason is null").select(key), key, "left_semi"), kept.filter(F.col("drop_reason").isNotNull() & F.col(retryable)).select(key)
