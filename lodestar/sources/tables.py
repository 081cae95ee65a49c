"""JSON-lines, keyed and Parquet sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """SRC3 / SRC4: blank lines are skipped; a strict read fails at a bad line."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC4, diagnosis: the lines that do not parse, with their file."""
    rows = spark.read.text(path).filter("trim(value) <> ''").select(F.col("_metadata.file_path").alias("file"), "value")
    parsed = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return rows.select("file", parsed["_corrupt_record"].alias("_corrupt_record")).filter("_corrupt_record is not null")


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC1 / SRC8: objects of a top-level array with their place as ``task_id``."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.posexplode(F.from_json("value", f"array<struct<{schema}>>", {"mode": "FAILFAST"})).alias("task_id", "o")).select("task_id", "o.*")


def keyed(df: DataFrame, key: str, allowed: DataFrame | None = None) -> dict[str, DataFrame]:
    """SRC5: rows that break the contract: keys that repeat, keys that are not allowed."""
    out = {"repeated": df.groupBy(key).count().filter("count > 1")}
    if allowed is not None:
        out["unknown"] = df.join(allowed.select(key), key, "left_anti")
    return out


def assert_empty(violations: DataFrame, what: str) -> None:
    found = violations.limit(3).collect()
    if found:
        raise ValueError(f"{what}: {found}")


def task_ids(df: DataFrame) -> DataFrame:
    """SRC6 / SRC7: distinct ids found at the top level or in ``extra_info`` (a struct or JSON)."""
    have = set(df.columns)
    found = [F.col("task_id").cast("long")] if "task_id" in have else []
    if "extra_info" in have:
        text = dict(df.dtypes)["extra_info"] == "string"
        found.append(F.get_json_object("extra_info", "$.task_id").cast("long") if text else F.col("extra_info.task_id").cast("long"))
    return df.select(F.coalesce(*found).alias("task_id")).filter("task_id is not null").distinct()


def publish(df: DataFrame, path: str, kind: str = "json", force: bool = False) -> None:
    """SNK1, SNK4, SNK5: all or nothing by the commit protocol; refuses to overwrite unless forced."""
    out = df.write.mode("overwrite" if force else "errorifexists")
    {"json": lambda: out.json(path), "parquet": lambda: out.option("compression", "zstd").parquet(path), "csv": lambda: out.option("header", True).csv(path)}[kind]()


def append(df: DataFrame, path: str) -> None:
    """SNK2."""
    df.write.mode("append").json(path)


def pending(tasks: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """ST6: what a resumed run has still to do."""
    return tasks.join(done.select(*key), key, "left_anti")


def content_digest(df: DataFrame) -> DataFrame:
    """SNK6: one row: rows, and an order-free digest."""
    return df.select(F.xxhash64(*df.columns).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("digest"))
