"""Selections whose costs change with every pick, on candidates that are proven to be enough.

What a pick costs is a fixed part of the row and a part of its cell (its values in the balanced columns), which
alone changes.  So in each cell only the first rows by fixed cost can be picked: Spark finds them for all cells,
and the picks themselves are made among at most cells x quota x quota rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rows import kept

#: Fixed costs are counted in these parts of one, so sums and ties are exact.
PARTS = 1_000_000


@dataclass(frozen=True)
class Balance:
    """Wanted counts of the values of a column: a pick costs ``slope`` times the share filled, and ``over`` more
    where the wanted count is reached.  With ``scope`` only picks of that scope count."""

    column: str
    wanted: dict[str, int]
    slope: int
    over: int
    scope: str | None = None


@dataclass
class Picks:
    """What was picked so far (bounded by the sum of quotas): rows, and their counts by scope, column and value."""

    balances: tuple[Balance, ...]
    rows: list[Row] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    counts: Counter = field(default_factory=Counter)

    def cost(self, row: Row, scope: str) -> Fraction:
        """The exact cost of ``row`` now, in parts."""
        total = Fraction(row["cost"])
        for b in self.balances:
            if b.scope in (None, scope):
                n, wanted = self.counts[b.scope, b.column, row[b.column]], b.wanted[row[b.column]]
                total += PARTS * (Fraction(b.slope * n, wanted) + (b.over if n >= wanted else 0))
        return total

    def add(self, row: Row, scope: str, label: str) -> None:
        self.rows.append(row)
        self.labels.append(label)
        for b in self.balances:
            if b.scope in (None, scope):
                self.counts[b.scope, b.column, row[b.column]] += 1

    def frame(self, spark: SparkSession, id_type: str = "long") -> DataFrame:
        """The picks with their position from 1 and the label they were picked under."""
        rows = [(n, label, r["id"], r["family"], r["cost"]) for n, (label, r) in enumerate(zip(self.labels, self.rows), 1)]
        return spark.createDataFrame(rows, f"position long, label string, id {id_type}, family string, cost long")

    def without(self, df: DataFrame) -> DataFrame:
        """Rows of ``df`` whose id and family were not picked (a null family is nobody's)."""
        ids, families = [r["id"] for r in self.rows], sorted({r["family"] for r in self.rows if r["family"] is not None})
        df = df.filter(~F.col("id").isin(ids)) if ids else df
        return df.filter(F.col("family").isNull() | ~F.col("family").isin(families)) if families else df


def placed(df: DataFrame, score: Column, pieces: int = 64) -> tuple[DataFrame, int]:
    """``df`` with ``place``, its number from 0 by (score, id), and the count of rows.  Rows without a score are
    left out.  Ranges between splitters (from a bounded sample by hash, which only balances the ranges) are
    counted first, then numbered each for itself: no order of all rows is made in one task."""
    rows = df.withColumn("__at", F.struct(score.alias("score"), F.col("id"))).filter(F.col("__at.score").isNotNull())
    sample = sorted((r["__at"] for r in rows.select("__at").orderBy(F.xxhash64("__at"), "__at").limit(pieces * 32).collect()), key=tuple)
    marks = sample[32::32]
    kind = rows.schema["__at"].dataType.simpleString()
    at = F.lit(0)
    if marks:
        fields = [f.name for f in rows.schema["__at"].dataType.fields]
        borders = F.array(*[F.struct(*[F.lit(m[f]).alias(f) for f in fields]).cast(kind) for m in marks])
        at = F.size(F.filter(borders, lambda m: m <= F.col("__at")))
    rows = rows.withColumn("__range", at)
    sizes = {r["__range"]: r["count"] for r in rows.groupBy("__range").count().collect()}
    total, before = 0, []
    for i in range(len(marks) + 1):
        before.append(F.lit(total).cast("long"))
        total += sizes.get(i, 0)
    number = F.row_number().over(W.partitionBy("__range").orderBy("__at")) - 1
    # written in ranges of places: each window reads its own, none numbers all rows again
    return kept(rows.withColumn("place", F.element_at(F.array(*before), F.col("__range") + 1) + number).drop("__at", "__range"), "placed"), total


def window(df: DataFrame, total: int, start: float, end: float) -> DataFrame:
    """Rows of a percentile window: truncated borders, at least one place."""
    low = int(total * start)
    return df.filter((F.col("place") >= low) & (F.col("place") < max(int(total * end), low + 1)))


def first_of_cells(df: DataFrame, cell: list[str], cost: Column, keys: list[str], takes: list[int]) -> list[Row]:
    """Per cell the first ``takes[i]`` rows by (cost, sha256 of ``keys[i]`` | id), for every i: what picks from the cell
    need if the i-th breaks ties of cost by the i-th key.  Rows dearer than the last place of their cell
    go first, before the shuffle; only ties of that place are hashed for every key."""
    rows = df.filter(cost.isNotNull()).select("id", "family", *cell, F.round(cost * PARTS).cast("long").alias("cost"))
    near = rows.withColumn("__r", F.rank().over(W.partitionBy(*cell).orderBy("cost"))).filter(F.col("__r") <= max(takes)).drop("__r")
    turns = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("key"), F.lit(n).alias("n")) for i, (k, n) in enumerate(zip(keys, takes))])
    each = near.withColumn("__t", F.explode(turns)).withColumn("__h", F.sha2(F.concat("__t.key", F.lit("|"), F.col("id").cast("string")), 256))
    at = F.row_number().over(W.partitionBy(*cell, "__t.i").orderBy("cost", "__h", "id"))
    first = each.withColumn("__n", at).filter((F.col("__n") <= max(takes)) & (F.col("__n") <= F.col("__t.n")))
    return first.select("id", "family", *cell, "cost").distinct().collect()


def _hash(key: str, i) -> str:
    return hashlib.sha256(f"{key}|{i}".encode()).hexdigest()


def pick_slice(df: DataFrame, picks: Picks, name: str, severity: Column, cost: Column, windows: list[tuple[float, float, int]], seed: str) -> None:
    """SM8: from every percentile window (start, end, quota) of ``severity`` the rows that are cheapest when the window
    begins, added to ``picks`` under the scope ``slice``; costs are not renewed and families not looked at again within a
    window.  ``df`` holds the eligible rows: id (unique), family and the balanced columns; those with a null
    severity or cost take no part."""
    cell = list(dict.fromkeys(b.column for b in picks.balances))
    rows, total = placed(df, severity)
    for i, (start, end, quota) in enumerate(windows):
        key = f"{seed}|band={i}|slice|{name}"
        found = first_of_cells(picks.without(window(rows, total, start, end)), cell, cost, [key], [quota])
        ranked = sorted(found, key=lambda r: (picks.cost(r, "slice"), _hash(key, r["id"]), r["id"]))[:quota]
        if len(ranked) < quota:
            raise ValueError(f"only {len(ranked)} of {quota} rows for {name} in window {i}")
        for r in ranked:
            picks.add(r, "slice", name)


def pick_core(df: DataFrame, picks: Picks, name: str, score: Column, cost: Callable[[int], Column], quotas: list[int], seed: str) -> None:
    """SM9: from every part of ``df`` by ``score`` (equal parts, one a quota) the cheapest row, again and again, costs
    renewed after each pick, ties by a hash of seed, part, turn and id.  Families picked before a part begins are left out;
    within a part they are not looked at again.  ``cost(i)`` is the fixed cost in part i.  Columns as in ``pick_slice``."""
    cell = list(dict.fromkeys(b.column for b in picks.balances))
    rows, total = placed(picks.without(df), score)
    turn, parts = 0, len(quotas)
    for i, quota in enumerate(quotas):
        keys = [f"{seed}|core|{i}|{turn + s}" for s in range(quota)]
        left = first_of_cells(picks.without(window(rows, total, i / parts, (i + 1) / parts)), cell, cost(i), keys, list(range(1, quota + 1)))
        for key in keys:
            if not left:
                raise ValueError(f"fewer than {quota} rows in part {i}")
            best = min(left, key=lambda r: (picks.cost(r, "core"), _hash(key, r["id"]), r["id"]))
            left.remove(best)
            picks.add(best, "core", name)
        turn += quota


def pick_roles(df: DataFrame, quotas: dict[str, dict[str, int]], domain_cap: int, seed: str) -> list[tuple[str, str, Row]]:
    """SM16: (role, band, row) for the quota of every role and band, in their order: the least used strategy of the role,
    then the least used domain, then a hash; a domain gives ``domain_cap`` rows at most over all roles.

    ``df`` has id (unique), band, strategy and domain.  A pick's cost is its cell's (strategy, domain) but for the
    hash, so the first rows of each cell, as many as the quota, hold every pick.
    """
    domains: Counter = Counter()
    out: list[tuple[str, str, Row]] = []
    for role, bands in quotas.items():
        strategies: Counter = Counter()
        for band, quota in bands.items():
            key, ids = f"{seed}|{role}|{band}", [r["id"] for *_, r in out]
            rows = df.filter(F.col("band") == band).withColumn("family", F.lit(None).cast("string"))
            rows = rows.filter(~F.col("id").isin(ids)) if ids else rows
            left = {r["id"]: r for r in first_of_cells(rows, ["strategy", "domain"], F.lit(0), [key], [quota])}
            hashes = {i: _hash(key, i) for i in left}
            for _ in range(quota):
                fit = [r for r in left.values() if domains[r["domain"]] < domain_cap]
                if not fit:
                    raise ValueError(f"too few rows for {role} in {band} under the cap of domains")
                best = min(fit, key=lambda r: (strategies[r["strategy"]], domains[r["domain"]], hashes[r["id"]], r["id"]))
                del left[best["id"]]
                strategies[best["strategy"]] += 1
                domains[best["domain"]] += 1
                out.append((role, band, best))
    return out


def replacements(old: DataFrame, candidates: DataFrame, exact: list[str], costs: Callable[[str, str], list[Column]], eligible: Callable[[str, str], Column], blocked: DataFrame, seed: str, most: int = 1000) -> list[tuple]:
    """JN18: (old id, new id) for every row of ``old`` in the order of ``at``: the candidate of least ``costs`` (then a hash of both ids)
    among those equal in ``exact`` and ``eligible``; no candidate and no family serves twice, none of ``blocked`` (family) at all.

    ``old`` (id, at, family and what costs need) is a list of at most ``most`` rows, which is checked, so it is sent to
    the candidates.  When the n-th old row has its turn fewer than n families are used, so its n best families hold its pick:
    an aggregate by old row and family, combined before the shuffle, and a cut to n rows are all that is exchanged.
    """
    rows = old.select("*", F.row_number().over(W.orderBy("at", "id")).alias("turn")) if old.limit(most + 1).count() <= most else None
    if rows is None:
        raise ValueError(f"more than {most} rows to replace")
    left, right = rows.alias("o"), candidates.join(blocked.select("family").distinct(), "family", "left_anti").alias("c")
    same = F.lit(True)
    for c in exact:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"c.{c}"))
    pairs = right.join(F.broadcast(left), same & eligible("o", "c"))
    key = F.sha2(F.concat_ws("|", F.lit(seed), F.lit("final"), F.col("o.id").cast("string"), F.col("c.id").cast("string")), 256)
    cost = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(costs("o", "c"))], key.alias("key"), F.col("c.id").alias("id"))
    best = pairs.groupBy(F.col("o.id").alias("old"), F.col("o.turn").alias("turn"), F.coalesce(F.col("c.family"), F.concat(F.lit("\0"), F.col("c.id").cast("string"))).alias("family")).agg(F.min(cost).alias("cost"))
    n = F.row_number().over(W.partitionBy("old").orderBy("cost"))
    near = best.withColumn("n", n).filter((F.col("n") <= most) & (F.col("n") <= F.col("turn"))).collect()
    offers: dict = {}
    for r in sorted(near, key=lambda r: (r["turn"], r["n"])):
        offers.setdefault(r["old"], []).append(r)
    used, out = set(), []
    for (i,) in rows.orderBy("turn").select("id").collect():
        pick = next((r for r in offers.get(i, []) if r["family"] not in used), None)
        if pick is None:
            raise ValueError(f"no replacement for {i}")
        used.add(pick["family"])
        out.append((i, pick["cost"]["id"]))
    return out
