"""Deduplication, splits, quotas, bands, allocation and greedy selection."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """WN13 / SRC8: one row per key, the first in order."""
    n = "__n"
    return df.withColumn(n, F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter(F.col(n) == 1).drop(n)


def top_per_group(df: DataFrame, group: list[str], order: list, n: int | Column) -> DataFrame:
    """SM4, SM17, SM18: the first n of each group."""
    at = "__n"
    return df.withColumn(at, F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col(at) <= n).drop(at)


def stable_split(df: DataFrame, key: str, seed: str, ratio: float, digits: int = 8) -> DataFrame:
    """SM1: ``df`` (one row per key) with ``split``: the keys least by sha256(seed:key) are validation,
    max(1, round half even of n * ratio) of them but never all.

    The hash is cut into ranges by its first digits; counts of these ranges give every row its
    place, so no row order of all keys is made in one task but in the range of the border.
    """
    h = F.sha2(F.concat(F.lit(seed + ":"), F.col(key).cast("string")), 256)
    rows = df.withColumn("__h", h).withColumn("__r", F.substring("__h", 1, 2))
    counts = {r["__r"]: r["count"] for r in rows.groupBy("__r").count().collect()}  # 256 at most
    total = sum(counts.values())
    wanted = min(max(1, round(total * ratio)), max(0, total - 1))
    border, left = None, wanted
    for r in sorted(counts):
        if counts[r] >= left:
            border = r
            break
        left -= counts[r]
    place = F.row_number().over(W.partitionBy("__r").orderBy("__h", key))
    inside = F.when(F.col("__r") < F.lit(border), True).when(F.col("__r") > F.lit(border), False).otherwise(place <= left) if border is not None else F.lit(False)
    return rows.withColumn("split", F.when(inside, "validation").otherwise("train")).drop("__h", "__r")


def largest_remainder(counts: DataFrame, key: str, count: str, total: int, ties: list) -> DataFrame:
    """SM2 / SM3: (key, count, quota), quotas in proportion; what is left goes to the largest
    remainders, ties in the given order.  ``counts`` has one row per stratum."""
    all_ = W.partitionBy()
    exact = F.col(count) * total  # over the sum: kept whole, so remainders are exact
    rows = counts.withColumn("__s", F.sum(count).over(all_)).withColumn("__f", F.floor(exact / F.col("__s")))
    rows = rows.withColumn("__m", exact % F.col("__s")).withColumn("__left", total - F.sum("__f").over(all_))
    n = F.row_number().over(W.partitionBy().orderBy(F.desc("__m"), *ties))
    return rows.withColumn("quota", (F.col("__f") + (n <= F.col("__left")).cast("int")).cast("long")).select(key, count, "quota")


def percentile_bands(df: DataFrame, group: list[str], order: list, bands: list[tuple[str, float, float]]) -> DataFrame:
    """WN11: rows int(n a) to max(int(n b), int(n a) + 1) of each group, with the band's name."""
    w = W.partitionBy(*group)
    rows = df.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    low = lambda a: F.floor(F.col("__n") * a)
    marks = F.array_compact(F.array(*[F.when((F.col("__i") >= low(a)) & (F.col("__i") < F.greatest(low(b), low(a) + 1)), F.lit(name)) for name, a, b in bands]))
    return rows.withColumn("band", F.explode(marks)).drop("__i", "__n")


def interleave(df: DataFrame, group: list[str], order: list) -> DataFrame:
    """WN12: ``position``, by which groups mix in proportion."""
    w = W.partitionBy(*group)
    return df.withColumn("position", (F.row_number().over(w.orderBy(*order)) - 1) / F.count(F.lit(1)).over(w))


def blocked_overlap(left: DataFrame, right: DataFrame, block: str, similar: Column, key: str) -> DataFrame:
    """JN8 / JN9: rows of ``left`` without a similar row of ``right`` in their block (``right``'s other
    columns must be named apart, as ``similar`` uses both)."""
    hit = left.alias("l").join(right.withColumnRenamed(block, "__b"), (F.col(f"l.{block}") == F.col("__b")) & similar).select(F.col(f"l.{key}").alias("__k")).distinct()
    return left.join(hit, left[key] == hit["__k"], "left_anti")


def decontaminate(df: DataFrame, held_out: list[str], text: str) -> DataFrame:
    """Rows whose text contains none of a bounded list of passages."""
    bad = F.lit(False)
    for t in held_out:
        bad = bad | F.contains(F.col(text), F.lit(t))
    return df.filter(~F.coalesce(bad, F.lit(False)))


def greedy(df: DataFrame, order: list[str], schema: str, take: Callable[[pd.DataFrame], pd.DataFrame], group: str | None = None) -> DataFrame:
    """The shape of the order-dependent selections (SM6 to SM11, SM14 to SM16, JN18): features of the
    candidates, ordered, in one group (or in independent ones), through a Python loop."""
    key = F.lit(0) if group is None else F.col(group)
    return df.withColumn("__g", key).groupBy("__g").applyInPandas(lambda p: take(p.sort_values(order, kind="stable").drop(columns="__g")), schema)


def capped_round_robin(quotas: dict[str, int], caps: dict[str, int], total: int, band: str = "band"):
    """SM10: turns over bands; a row is taken unless its band's quota or a cap on the count of its
    value in a column is reached."""

    def take(rows: pd.DataFrame) -> pd.DataFrame:
        queues = {b: deque(g.index) for b, g in rows.groupby(band, sort=True)}
        used: dict = {}
        taken: list = []
        per_band = dict.fromkeys(queues, 0)
        while len(taken) < total and any(queues.values()):
            for b, queue in queues.items():
                while queue and per_band[b] < quotas.get(b, 0) and len(taken) < total:
                    i = queue.popleft()
                    marks = [(c, rows.at[i, c]) for c in caps]
                    if all(used.get(m, 0) < caps[m[0]] for m in marks):
                        for m in marks:
                            used[m] = used.get(m, 0) + 1
                        per_band[b] += 1
                        taken.append(i)
                        break
                if per_band[b] >= quotas.get(b, 0):
                    queue.clear()
        return rows.loc[taken]

    return take


def nearest_without_replacement(exact: list[str], cost: Callable[[pd.Series, pd.DataFrame], pd.Series]):
    """JN18: each old row takes the candidate of least cost among those equal in ``exact``."""

    def match(old: pd.DataFrame, candidates: pd.DataFrame) -> list[tuple]:
        free, out = candidates.copy(), []
        for i, row in old.iterrows():
            fit = free
            for c in exact:
                fit = fit[fit[c] == row[c]]
            if len(fit):
                best = cost(row, fit).idxmin()
                out.append((i, best))
                free = free.drop(index=best)
        return out

    return match


def max_flow(supply: dict[tuple[str, str], int], rows: dict[str, int], columns: dict[str, int]) -> dict[tuple[str, str], int]:
    """SM12: allocation of cell counts that meets row and column demands as far as cells allow, by
    augmenting paths (a few cells on the driver)."""
    room: dict = {}
    for r, n in rows.items():
        room[("s", ("r", r))] = n
    for c, n in columns.items():
        room[(("c", c), "t")] = n
    for (r, c), n in supply.items():
        room[(("r", r), ("c", c))] = n
    room |= {(b, a): 0 for a, b in list(room) if (b, a) not in room}
    near: dict = {}
    for a, b in room:
        near.setdefault(a, []).append(b)
    while True:
        came, todo = {"s": None}, deque(["s"])
        while todo and "t" not in came:
            a = todo.popleft()
            for b in sorted(near.get(a, ()), key=str):
                if b not in came and room[(a, b)] > 0:
                    came[b] = a
                    todo.append(b)
        if "t" not in came:
            break
        path, b = [], "t"
        while came[b] is not None:
            path.append((came[b], b))
            b = came[b]
        least = min(room[e] for e in path)
        for a, b in path:
            room[(a, b)] -= least
            room[(b, a)] += least
    return {(r, c): n - room[(("r", r), ("c", c))] for (r, c), n in supply.items()}


def feasible_columns(
    supply: dict[tuple[str, str], int], rows: dict[str, int], fixed: dict[str, int], wish: dict[str, int], ranges: dict[str, range]
) -> tuple[dict[str, int], dict[tuple[str, str], int]]:
    """SM13: the column targets nearest to ``wish`` (sum of differences) that cells can meet, and their
    allocation; of equally near ones the first by the distance of each ranged column to its wish, then by the
    target of the next.  Two columns run over ``ranges``, the third takes what the sum of ``wish`` leaves;
    ``fixed`` rows are in the targets already.  Candidates are tried from the nearest on."""
    (p, first), (q, second) = ranges.items()
    (rest,) = set(wish) - set(ranges)
    total, options = sum(wish.values()), []
    for x in first:
        for y in second:
            target = {p: x, q: y, rest: total - x - y}
            if all(target[k] >= fixed.get(k, 0) for k in target):
                options.append((sum(abs(target[k] - wish[k]) for k in wish), abs(x - wish[p]), y, target))
    for *_, target in sorted(options, key=lambda o: o[:3]):
        need = {k: n - fixed.get(k, 0) for k, n in target.items()}
        cells = max_flow(supply, rows, need)
        if sum(cells.values()) == sum(rows.values()) == sum(need.values()):
            return target, cells
    raise ValueError("no column targets can be met")


def weighted_sample(df: DataFrame, weight: str, n: int, seed: int) -> DataFrame:
    """SM19: without replacement, by exponential keys."""
    return df.orderBy(-F.log(F.rand(seed)) / F.col(weight)).limit(n)
