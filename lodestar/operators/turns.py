"""Queues that take turns: the rows that can be picked at all are found by Spark, the turns run over these."""

from __future__ import annotations

import heapq
from collections import Counter

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from . import selection


def reachable(df: DataFrame, order: list[Column], quotas: dict[str, int], total: int, flag: Column | None = None) -> list[Row]:
    """Rows (queue, value, id, flag, order, which ends with the id) among which every pick of ``take_turns`` is found, at most
    2 x queues^2 x total x quota of them, whatever the input.

    ``df`` has ``queue``, ``value`` and ``id``; ``flag`` depends on the value alone.  Before a pick fewer than ``total`` values are
    in use, so the best row of an unused value is among the best rows of the first ``total`` values (flagged and
    others apart, as flags may be barred); and of a value in use a queue can give no more than its quota.
    Values are combined before the shuffle; rows of one value are cut to the quota before it.
    """
    rows = df.filter(F.col("queue").isin(list(quotas))).select("queue", "value", "id", F.coalesce(flag if flag is not None else F.lit(False), F.lit(False)).alias("flag"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], "id").alias("order"))
    heads = rows.groupBy("queue", "value", "flag").agg(F.min("order").alias("order"))
    values = selection.top_per_group(heads, ["queue", "flag"], ["order", "value"], total).select(F.col("value").alias("__v")).distinct()
    near = rows.join(values, F.col("value").eqNullSafe(F.col("__v")), "left_semi")
    quota = F.element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col("queue"))
    cut = selection.top_per_group(near, ["queue", "value"], ["order"], max(quotas.values()))
    return selection.top_per_group(cut, ["queue", "value"], ["order"], quota).collect()


def take_turns(rows: list[Row], cycle: list[str], quotas: dict[str, int], total: int, cap: int, flag_cap: int | None = None, strict: bool = False) -> list[tuple[str, Row]]:
    """SM6, SM11: queues pick in the order of ``cycle``, again and again: the row of the least used value, then the
    first in order; values are used ``cap`` times at most, flagged rows ``flag_cap`` times.  A queue with its quota is passed over,
    one without rows too (or raises, if ``strict``).  Uses only grow, so a heap of the heads of values is right when a
    head that went stale is put back with its new cost."""
    queues: dict = {q: {} for q in quotas}
    for r in sorted(rows, key=lambda r: tuple(r["order"]), reverse=True):
        queues[r["queue"]].setdefault(r["value"], []).append(r)  # the best is last
    entry = lambda q, v, used: (used, tuple(queues[q][v][-1]["order"]), v)
    heaps = {q: [entry(q, v, 0) for v in values] for q, values in queues.items()}
    for h in heaps.values():
        heapq.heapify(h)
    used: Counter = Counter()
    taken: Counter = Counter()
    gone, flagged, out = set(), 0, []
    while len(out) < total and not all(q in gone or taken[q] >= n for q, n in quotas.items()):
        for q in cycle:
            if len(out) >= total or q in gone or taken[q] >= quotas[q]:
                continue
            best, heap = None, heaps[q]
            while heap and best is None:
                uses, _, v = heapq.heappop(heap)
                row = queues[q][v][-1]
                if used[v] >= cap or (row["flag"] and flag_cap is not None and flagged >= flag_cap):
                    continue
                if used[v] > uses:
                    heapq.heappush(heap, entry(q, v, used[v]))
                    continue
                best = queues[q][v].pop()
            if best is None:
                if strict:
                    raise ValueError(f"no row left for {q}")
                gone.add(q)
                continue
            used[v] += 1
            taken[q] += 1
            flagged += best["flag"]
            out.append((q, best))
            if queues[q][v]:
                heapq.heappush(heap, entry(q, v, used[v]))
    return out
