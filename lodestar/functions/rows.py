"""Helpers of expressions over one row, and of how rows are dealt."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch of texts.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often and in whatever lambda
    ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over all shuffle partitions: rows that cost milliseconds each stand by the
    million in a file of a few splits."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def small_batches(spark: SparkSession) -> SparkSession:
    """Arrow batches of ``ARROW_ROWS`` rows and ``ARROW_BYTES`` bytes at most, unless the session asks for less: a
    Python worker holds a batch of texts, what it makes of it, and the next one."""
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key)
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
    return spark


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once below ``spark.checkpoint.dir`` and read again, for jobs that come back to it (a temporary
    folder only where none is set and all runs in one process)."""
    spark = df.sparkSession
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lodestar.work.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("lodestar.work.dir", found)
    path = f"{found.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
