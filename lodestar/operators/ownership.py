"""Claims of strategies on tasks: one owner a task, and filling the last strategy evenly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import selection


def owned_claims(claims: DataFrame, strategies: list[str], order: list[Column], required: Column, carry: list[str]) -> DataFrame:
    """SM15: the best claim (least by ``order``) of each (strategy, task_id) with the ``owner`` of its task,
    ``kept`` and the ``reason`` of those that lose (null otherwise), and the columns ``carry``.

    A task belongs to the strategy whose best claim is ``required`` (the last such in ``strategies``), else to the
    first of ``strategies`` that claims it.  All of it is one aggregate by task, a column a strategy, combined
    before the shuffle: many claims on one task cost no more than one.  Claims without a task or of another
    strategy take no part; of claims equal in ``order`` the least by ``carry`` stands for both.
    """
    best = F.struct(*[c.alias(f"__o{i}") for i, c in enumerate(order)], F.coalesce(required, F.lit(False)).alias("__required"), *carry)
    marks = [f"__s{i}" for i in range(len(strategies))]
    rows = claims.filter(F.col("task_id").isNotNull() & F.col("strategy").isin(strategies)).withColumn("__best", best)
    tasks = rows.groupBy("task_id").agg(*[F.min(F.when(F.col("strategy") == s, F.col("__best"))).alias(m) for s, m in zip(strategies, marks)])
    held = [(F.lit(s), F.col(m)) for s, m in zip(strategies, marks)]
    must = F.coalesce(*[F.when(c["__required"], s) for s, c in reversed(held)])
    tasks = tasks.withColumn("__must", must).withColumn("owner", F.coalesce("__must", *[F.when(c.isNotNull(), s) for s, c in held]))
    each = F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(s.alias("strategy"), c.alias("c"))) for s, c in held]))
    out = tasks.withColumn("__e", F.explode(each)).select("task_id", "__e.strategy", "owner", "__must", *[F.col(f"__e.c.{c}").alias(c) for c in carry])
    kept = F.col("strategy") == F.col("owner")
    why = F.when(F.col("__must").isNotNull(), F.concat(F.lit("required_existing_owned_by_"), "owner")).otherwise(F.concat(F.lit("owned_by_"), "owner"))
    return out.withColumn("kept", kept).withColumn("reason", F.when(~kept, why)).drop("__must")


def even_fill(rows: DataFrame, kept: Column, value: str, bucket: str, order: dict[str, Column], limit: int, minimums: dict[str, int]) -> DataFrame:
    """SM15: ``limit`` rows (more only if more are ``kept``) with ``stage``: 0 for those kept, then one stage for
    every bucket of ``minimums`` that is short, in their order, then one for the rest.  Each pick is of the least
    used ``value``, then the least by ``order`` (named columns, a total order without nulls).

    Picking the least used value over and over merges one queue a value, and the n-th row of a queue comes at
    (uses before + n): a window by value gives every row its turn and the rows up to the border are taken.
    Only the border of a stage (one row) reaches the driver.  Of a value and bucket only the first ``limit`` rows can be
    taken, which Spark cuts before the shuffle, so a value that holds a third of all rows is no large window.
    """
    names = list(order)
    rows = rows.withColumns({f"__{k}": c for k, c in order.items()}).withColumn("__kept", F.coalesce(kept, F.lit(False)))
    old = rows.filter("__kept")
    counts = {r[0]: r[1] for r in old.filter(F.col(bucket).isin(list(minimums))).groupBy(bucket).count().collect()} if minimums else {}
    sizes = rows.agg(F.count_if("__kept"), F.count(F.lit(1))).first()
    room = min(limit, sizes[1]) - sizes[0]
    queue = [f"__{k}" for k in names]
    free = selection.top_per_group(rows.filter("NOT __kept"), [value, bucket], queue, limit)
    before = old.groupBy(F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__before"))
    free = free.join(before, F.col(value).eqNullSafe(F.col("__v")), "left").drop("__v").withColumn("stage", F.lit(None).cast("int"))
    stages = [(b, min(n - counts.get(b, 0), limit), F.col(bucket) == b) for b, n in minimums.items()]
    free = _in_turns(free, value, queue, [*stages, (None, limit, F.lit(True))], room)
    drop = [*queue, "__kept"]
    return old.withColumn("stage", F.lit(0)).drop(*drop).unionByName(free.filter("stage IS NOT NULL").drop("__before", *drop))


def fill_cells(rows: DataFrame, before: DataFrame, value: str, cell: str, order: dict[str, Column], allocation: list[tuple[str, int]], cap: int, flag: str, flag_cap: int) -> DataFrame:
    """SM14: of every cell as many rows as ``allocation`` says, cell after cell, with ``stage`` (the place of the cell from
    1).  Each pick is of the least used ``value`` (uses of ``before``, taken already, count), then the least by ``order``; a value is
    used ``cap`` times at most, and ``flag`` rows, which depend on the value alone, ``flag_cap`` times in all.  Raises if
    the caps leave too few rows.  As in ``even_fill`` a cell costs one window by value and one border on the driver.
    """
    queue = [f"__{k}" for k in order]
    most = max((n for _, n in allocation), default=0)
    rows = rows.withColumns({f"__{k}": c for k, c in order.items()}).filter(F.col(cell).isin([c for c, n in allocation if n]))
    free = selection.top_per_group(rows, [value, cell], queue, min(most, cap)).withColumn("stage", F.lit(None).cast("int"))
    uses = before.groupBy(F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__before"))
    free = free.join(uses, F.col(value).eqNullSafe(F.col("__v")), "left").drop("__v")
    flagged = before.agg(F.count_if(F.col(flag))).first()[0]
    stages = [(c, n, F.col(cell) == c) for c, n in allocation]
    free = _in_turns(free, value, queue, stages, sum(n for _, n in allocation), cap, flag, flag_cap - flagged)
    return free.filter("stage IS NOT NULL").drop("__before", *queue)


def _in_turns(free: DataFrame, value: str, queue: list[str], stages: list, room: int, cap: int | None = None, flag: str | None = None, flags: int = 0) -> DataFrame:
    """Mark the picks of each stage (name, rows, fit): rows get their turn (uses of the value before, and their place in its
    queue), those up to the border of a stage are taken.  Named stages must be filled."""
    for at, (name, wanted, fits) in enumerate(stages, 1):
        n = min(wanted, room)
        if n <= 0:
            continue
        open_ = F.col("stage").isNull() & F.coalesce(fits, F.lit(False))
        used = F.coalesce("__before", F.lit(0)) + F.count("stage").over(W.partitionBy(value))
        turn = used + F.row_number().over(W.partitionBy(value, open_).orderBy(*queue))
        barred = F.lit(False) if cap is None else turn > cap
        free = free.withColumn("__turn", F.when(open_ & ~barred, F.struct(turn.alias("t"), *queue)))
        if flag is not None and flags < n:  # flagged values are queues of their own: those beyond the allowance go, and no other turn changes
            last = _literal(_first(free.filter(flag), flags)["b"], free) if flags > 0 else None
            over = F.lit(True) if last is None else F.col("__turn") > last
            free = free.withColumn("__turn", F.when(F.coalesce(F.col(flag), F.lit(False)) & over, None).otherwise(F.col("__turn")))
        got = _first(free, n, flag)
        if name is not None and got["n"] < n:
            raise ValueError(f"only {got['n']} of {n} rows left for {name}")
        if got["n"]:
            free = free.withColumn("stage", F.when(F.col("__turn") <= _literal(got["b"], free), F.lit(at)).otherwise(F.col("stage")))
        free = free.drop("__turn")
        room -= got["n"]
        flags -= got["flags"]
    return free


def _first(df: DataFrame, n: int, flag: str | None = None):
    """Of the first n turns the last (``b``), their count and how many are flagged: a bounded sort in each task, then one row."""
    marks = F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(False)
    first = df.filter("__turn IS NOT NULL").select("__turn", marks.alias("f")).orderBy("__turn").limit(n)
    return first.agg(F.max("__turn").alias("b"), F.count(F.lit(1)).alias("n"), F.count_if("f").alias("flags")).first()


def _literal(turn, df: DataFrame) -> Column | None:
    """A turn as a literal of its type."""
    return None if turn is None else F.struct(*[F.lit(turn[i]).cast(f.dataType).alias(f.name) for i, f in enumerate(df.schema["__turn"].dataType.fields)])
