"""Feature columns, predicates and small relational shapes used by builders and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import letters_only


def difficulty(attributes: Column, axes: Column, variants: Column, chars: Column, overlap: Column) -> Column:
    """NUM18."""
    return attributes + axes * 1.5 + F.least(variants, F.lit(12)) / 4.0 + chars / 45.0 + (1.0 - overlap) * 2.5


def count_true(*flags: Column) -> Column:
    """X17, SM22: how many hold; null does not."""
    out = F.lit(0)
    for f in flags:
        out = out + F.coalesce(f.cast("int"), F.lit(0))
    return out


def tags(flags: dict[str, Column]) -> Column:
    """Sorted names of the flags that hold."""
    return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()])))


#: Endings of shop names (the last only at the end).
SHOP_WORDS = "官方旗舰店|旗舰店|专卖店|专营店|企业店|店$"


def family_id(category: Column, shop: Column, title: Column) -> Column:
    """SM21: 20 hex digits over the leaf of a ``›`` path, the shop without its kind, and the title with numbers
    masked; each as letters, digits and Han only, the title cut to 48 of them after that."""
    part = lambda c: letters_only(F.coalesce(c, F.lit("")))
    leaf = F.element_at(F.split(F.coalesce(category, F.lit("")), "›"), -1)
    masked = F.regexp_replace(F.coalesce(title, F.lit("")), "[0-9]+(?:\\.[0-9]+)?", "#")
    name = F.regexp_replace(F.coalesce(shop, F.lit("")), SHOP_WORDS, "")
    return F.left(F.sha2(F.concat_ws("|", part(leaf), part(name), F.substring(part(masked), 1, 48)), 256), F.lit(20))


def strict(*checks: Column) -> Column:
    """All are true, and null is not."""
    out = F.lit(True)
    for c in checks:
        out = out & F.coalesce(c, F.lit(False))
    return out


def after_flag(df: DataFrame, key: str, pos: str, flag: Column) -> DataFrame:
    """WN7: per key, rows whose row before had the flag."""
    rows = df.withColumn("__f", F.coalesce(F.lag(flag).over(W.partitionBy(key).orderBy(pos)), F.lit(False)))
    return rows.groupBy(key).agg(F.count(F.when(F.col("__f"), 1)).alias("n"))


def last_of_kind(df: DataFrame, key: str, pos: str, kind: Column) -> DataFrame:
    """WN14: the last position of a kind, null if none."""
    return df.groupBy(key).agg(F.max(F.when(kind, F.col(pos))).alias("last"))


def coverage(df: DataFrame, key: str, kind: str, flags: dict[str, str]) -> DataFrame:
    """WN4, X21: one boolean a flag: the key has a row of that kind."""
    return df.groupBy(key).agg(*[F.coalesce(F.bool_or(F.col(kind) == v), F.lit(False)).alias(n) for n, v in flags.items()])


def shared_keys(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """SET3: keys that more than one source has, with their number."""
    rows = None
    for name, df in sources.items():
        one = df.select(key, F.lit(name).alias("__s"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(key).agg(F.countDistinct("__s").alias("sources")).filter("sources > 1")


def collisions(df: DataFrame, key: list[str], raw: str, normal: Column) -> DataFrame:
    """FLT11: normal forms that stand for more than one raw value."""
    return df.withColumn("normal", normal).groupBy(*key, "normal").agg(F.countDistinct(raw).alias("n")).filter("n > 1")


def funnel(df: DataFrame, key: str, stages: list[tuple[str, Column]]) -> DataFrame:
    """AG17: (stage, n) of keys that reach each stage and all before it."""
    reached = df.groupBy(key).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in stages])
    test, parts = F.lit(True), []
    for n, _ in stages:
        test = test & F.col(n)
        parts.append(F.struct(F.lit(n).alias("stage"), test.cast("int").alias("y")))
    return reached.select(F.explode(F.array(*parts)).alias("p")).groupBy("p.stage").agg(F.sum("p.y").alias("n"))


def violations(df: DataFrame, invariants: dict[str, Column]) -> DataFrame:
    """AG22, X14: rows that break an invariant, with the names of all they break."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in invariants.items()]))
    return df.withColumn("broken", broken).filter(F.size("broken") > 0)


def typical(df: DataFrame, group: str, value: str, key: str) -> DataFrame:
    """Of each group the row nearest to the upper median (element n // 2), ties by key."""
    w = W.partitionBy(group)
    rows = df.withColumn("__n", F.row_number().over(w.orderBy(value, key)) - 1).withColumn("__c", F.count(F.lit(1)).over(w))
    mid = rows.filter(F.col("__n") == F.floor(F.col("__c") / 2)).select(group, F.col(value).alias("__m"))
    near = df.join(mid, group).withColumn("__k", F.row_number().over(w.orderBy(F.abs(F.col(value) - F.col("__m")), key)))
    return near.filter("__k = 1").drop("__k", "__m")
