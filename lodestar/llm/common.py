"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows times bytes up to which a side may be broadcast once it has been counted.
BROADCAST_BYTES = 24 << 20
#: Rows and bytes of an Arrow batch.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where none is configured and all runs in
    one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("lodestar.work.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("lodestar.work.dir", found)
    return found.rstrip("/")


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: lineage ends here, and a lost
    executor costs a reread, not a recomputation."""
    path = f"{work_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stashed = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the table behind a stash that nothing reads any more."""
    spark, path = df.sparkSession, df._stashed
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession) -> SparkSession:
    """Arrow batches of ``ARROW_ROWS`` rows and ``ARROW_BYTES`` bytes at most, unless the session asks for
    less: a Python worker holds a batch, what it makes of it, and the next one."""
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key)
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
    return spark


@contextmanager
def arrow_limits(spark: SparkSession) -> Iterator[None]:
    """``small_batches`` for the jobs that run inside, with the session's own settings put back after."""
    keys = [f"spark.sql.execution.arrow.{name}" for name in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = {k: spark.conf.get(k, None) for k in keys}
    small_batches(spark)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """A broadcast hint only for a side whose counted size is under ``BROADCAST_BYTES``; beyond it
    the join shuffles, with AQE splitting skewed partitions."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def longs(spark: SparkSession, values: list[int]) -> DataFrame:
    """A small table (i int, value long) of driver-side numbers, without Python on executors."""
    return spark.range(1).select(F.posexplode(F.from_json(F.lit(str([int(v) for v in values])), "array<bigint>")).alias("i", "value"))


def small_table(spark: SparkSession, rows: list[list[int]], names: list[str]) -> DataFrame:
    """A small table of driver-side longs, without Python on executors."""
    text = str([[int(v) for v in r] for r in rows])
    one = spark.range(1).select(F.explode(F.from_json(F.lit(text), "array<array<bigint>>")).alias("r"))
    return one.select(*[F.col("r")[i].alias(n) for i, n in enumerate(names)])


def _bisect(key: Column, cuts: list[int], lo: int, hi: int) -> Column:
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(key < F.lit(cuts[mid]), _bisect(key, cuts, lo, mid)).otherwise(_bisect(key, cuts, mid + 1, hi))


def place(key: Column, cuts: list[int], each: int) -> Column:
    """Number of ascending ``cuts`` at or below ``key``: bisection over every ``each``-th one, then a
    look through the few between."""
    outer = cuts[each - 1 :: each]
    inner = [cuts[s : s + each - 1] for s in range(0, len(cuts) + 1, each)]
    inner += [[]] * (len(outer) + 1 - len(inner))
    s = _bisect(key, outer, 0, len(outer))
    own = F.element_at(F.array(*[F.array(*[F.lit(x) for x in part]).cast("array<long>") for part in inner]), s + 1)
    return s * each + F.size(F.filter(own, lambda x: x <= key))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names built on ``names`` that ``df`` does not have, so extra columns never clash."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, each as it is called in ``df``."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def words(text: Column) -> Column:
    """Maximal runs of characters other than space and the controls 9 to 13."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often and in whatever lambda
    ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)
