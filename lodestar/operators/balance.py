"""A training set balanced by length: what is retained, what is added in order of arrival, and why the rest is not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import selection


def length_balance(base: DataFrame, new: DataFrame, targets: dict[str, int], seed: str, ratio: float) -> DataFrame:
    """SM5: every row of ``base`` (task_id, unique; bucket) and ``new`` (task_id, bucket, pos, its place of arrival, accepted,
    held_out) with ``origin``, ``status`` and ``split`` (null if not used).

    ``targets`` names three buckets; the first is filled from ``base`` alone, and last.  Of the others ``base`` rows are retained in
    the order of a hash, then new rows are added as they arrive unless their task is used or their bucket is full.
    Statuses: retained, not_retained; added, rejected, held_out_task, duplicate_task, new_<first>_not_used,
    <bucket>_quota_full.  Targets that cannot be met stay short, so the caller compares counts.

    Arrival needs no loop: until a bucket is full every task adds its first row, so the bucket that fills first does so at the
    row that is its last place by arrival; after it the other bucket adds the first rows of tasks not yet used.  These two
    borders are bounded sorts; the rest is one aggregate by task and a join.
    """
    spare, *grown = targets
    hashed = F.sha2(F.concat_ws(":", F.lit(seed), F.col("task_id").cast("string")), 256)
    base = base.select("task_id", "bucket", hashed.alias("__h"))
    wanted = F.element_at(F.create_map(*[F.lit(x) for kv in targets.items() for x in kv]), F.col("bucket"))
    largest = max(targets[b] for b in grown)
    first = selection.top_per_group(base.filter(F.col("bucket").isin(grown)), ["bucket"], ["__h", "task_id"], largest)
    kept = selection.top_per_group(first, ["bucket"], ["__h", "task_id"], wanted)
    counts = {r["bucket"]: r["count"] for r in kept.groupBy("bucket").count().collect()}
    room = {b: targets[b] - counts.get(b, 0) for b in grown}

    used = kept.select("task_id", F.lit(True).alias("__used"))
    rows = new.select("task_id", "bucket", "pos", "accepted", "held_out").join(used, "task_id", "left")
    open_ = F.coalesce("accepted", F.lit(False)) & ~F.coalesce("held_out", F.lit(False)) & F.col("__used").isNull()
    live = rows.filter(open_ & F.col("bucket").isin(grown) & F.col("task_id").isNotNull())
    firsts = live.groupBy("task_id").agg(F.min(F.struct("pos", "bucket")).alias("f")).select("task_id", "f.*")
    borders = {b: _nth(firsts.filter(F.col("bucket") == b), room[b]) for b in grown}
    full = [b for b in grown if borders[b] is not None]
    chosen = firsts.select("task_id", F.col("pos").alias("__sel"))
    if full:
        b1 = min(full, key=lambda b: borders[b])
        p1, other = borders[b1], next(b for b in grown if b != b1)
        had = firsts.filter((F.col("bucket") == other) & (F.col("pos") <= p1)).count()
        early = F.min(F.when(F.col("pos") <= p1, F.col("pos")))
        later = F.min(F.when((F.col("pos") > p1) & (F.col("bucket") == other), F.col("pos")))
        tasks = live.groupBy("task_id").agg(early.alias("early"), later.alias("later"))
        p2 = _nth(tasks.filter("early IS NULL").select(F.col("later").alias("pos")).filter("pos IS NOT NULL"), room[other] - had)
        late = F.col("later") if p2 is None else F.when(F.col("later") <= p2, F.col("later"))
        chosen = tasks.select("task_id", F.coalesce("early", late).alias("__sel")).filter("__sel IS NOT NULL")
    rows = rows.join(chosen, "task_id", "left")
    status = (
        F.when(~F.coalesce("accepted", F.lit(False)), "rejected").when(F.col("held_out"), "held_out_task").when(F.col("__used") | (F.col("__sel") < F.col("pos")), "duplicate_task")
        .when(F.col("bucket") == spare, f"new_{spare}_not_used").when(F.col("__sel") == F.col("pos"), "added").otherwise(F.concat("bucket", F.lit("_quota_full")))
    )
    added = rows.select("task_id", "bucket", "pos", F.lit("new").alias("origin"), status.alias("status"))

    short = base.filter(F.col("bucket") == spare).join(chosen.select("task_id"), "task_id", "left_anti")
    short = selection.top_per_group(short, ["bucket"], ["__h", "task_id"], targets[spare])
    used = kept.unionByName(short).select("task_id", F.lit(True).alias("__kept"))
    old = base.join(used, "task_id", "left").select("task_id", "bucket", F.lit(None).cast(new.schema["pos"].dataType).alias("pos"), F.lit("base").alias("origin"), F.when(F.col("__kept"), "retained").otherwise("not_retained").alias("status"))
    every = old.unionByName(added)
    ours = F.col("status").isin("retained", "added")
    validation = F.element_at(F.create_map(*[F.lit(x) for b, n in targets.items() for x in (b, round(n * ratio))]), F.col("bucket"))
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.lit("split"), F.col("task_id").cast("string")), 256)
    train = selection.top_per_group(every.filter(ours), ["bucket"], [order, "task_id"], validation).select("task_id", F.lit(True).alias("__v"))
    return every.join(train, "task_id", "left").withColumn("split", F.when(ours, F.when(F.col("__v"), "validation").otherwise("train"))).drop("__v")


def _nth(df: DataFrame, n: int):
    """The n-th least ``pos``; -1 if no place is left, None if there are fewer rows."""
    if n <= 0:
        return -1
    got = df.select("pos").orderBy("pos").limit(n).agg(F.max("pos").alias("p"), F.count(F.lit(1)).alias("n")).first()
    return got["p"] if got["n"] == n else None
