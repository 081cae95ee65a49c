"""Text read by byte ranges with exact places: numbered lines, and the objects of one top-level JSON array.

A file is split at a byte (a line feed, or a closing brace) by Spark's splittable text source, so no task holds more than its range.
Each piece has a small effect on the state of the scan (bytes, quotes, depth); effects are summed per range, the sums of the
ranges of a file are added up, and each range then continues from the state it starts in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_RANGE = ["file", "range"]


def _pieces(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(file, file_size, range, at, value, size): pieces in order of (range, at) within a file; ``size`` in bytes with the separator."""
    meta = [F.col(f"_metadata.{a}").alias(b) for a, b in (("file_path", "file"), ("file_size", "file_size"), ("file_block_start", "range"))]
    rows = spark.read.option("lineSep", sep).text(path).select("value", *meta, F.monotonically_increasing_id().alias("at"))
    return rows.withColumn("size", F.octet_length("value").cast("long") + 1)


def _before(rows: DataFrame, effects: dict[str, Column]) -> DataFrame:
    """``rows`` with the sum of each effect over all pieces of the file that come before: within the range by a window, over the ranges
    before by one row a range."""
    sums = rows.groupBy(*_RANGE).agg(*[F.sum(e).alias(f"__{k}") for k, e in effects.items()])
    ahead = W.partitionBy("file").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*_RANGE, *[F.coalesce(F.sum(f"__{k}").over(ahead), F.lit(0)).alias(f"__{k}") for k in effects])
    inside = W.partitionBy(*_RANGE).orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    local = rows.withColumns({k: F.coalesce(F.sum(e).over(inside), F.lit(0)) for k, e in effects.items()})
    return local.join(sums, _RANGE).withColumns({k: F.col(k) + F.col(f"__{k}") for k in effects}).drop(*[f"__{k}" for k in effects])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """SRC4, SRC9: (file, line, offset, length, value): every line of text files with its number from 1 and its place in bytes.
    Blank lines count but are left out; a carriage return at an end goes.  Files must not begin with a byte order mark."""
    rows = _before(_pieces(spark, path, "\n"), {"offset": F.col("size"), "line": F.lit(1)})
    rows = rows.withColumn("value", F.regexp_replace("value", "\r$", "")).filter(F.trim(F.regexp_replace("value", r"\s+", " ")) != "")
    return rows.select("file", (F.col("line") + 1).alias("line"), "offset", F.octet_length("value").alias("length"), "value")


def bad_objects(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: (file, line, value): the lines that are no JSON object."""
    value = F.try_parse_json("value")
    return numbered_lines(spark, path).filter(value.isNull() | ~F.schema_of_variant(value).startswith("OBJECT")).select("file", "line", "value")


def array_objects(spark: SparkSession, path: str) -> DataFrame:
    """SRC1, SRC9: (file, task_id, offset, length, value): the objects of a file that is one JSON array, numbered from 0, with their
    place in bytes and their text.  Fails when read if the file is no array, holds anything but objects, or is cut short.

    Without escapes a piece flips the state of being in a string by its quotes, and its braces and brackets outside strings
    change the depth in one of two ways, by the state it starts in.  An object ends with a piece that
    closes it; a group is one object, so what is held at once is bounded by the largest one.
    """
    rows = _pieces(spark, path, "}")
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"')
    weigh = lambda s: F.char_length(F.regexp_replace(s, r"[^{\[]", "")) - F.char_length(F.regexp_replace(s, r"[^}\]]", ""))
    outside = lambda odd: F.aggregate(F.filter(F.col("parts"), lambda s, i: i % 2 == odd), F.lit(0), lambda a, s: a + weigh(s))
    rows = rows.withColumn("parts", parts).withColumn("quotes", F.size("parts") - 1)
    rows = rows.select("file", "file_size", "range", "at", "value", "size", "quotes", outside(0).alias("plain"), outside(1).alias("quoted"))
    rows = _before(rows, {"offset": F.col("size"), "strings": F.col("quotes")}).withColumn("last", F.col("offset") + F.col("size") > F.col("file_size"))
    closes = ((F.col("strings") + F.col("quotes")) % 2 == 0) & ~F.col("last")  # the brace at the end of the piece is no text
    change = F.when(F.col("strings") % 2 == 0, F.col("plain")).otherwise(F.col("quoted")) - closes.cast("int")
    rows = _before(rows.withColumn("closes", closes).withColumn("change", change), {"depth": F.col("change")})
    ends = F.col("closes") & (F.col("depth") + F.col("change") == 1)
    rows = _before(rows.withColumn("ends", ends.cast("int")), {"task_id": F.col("ends")})
    # a piece after the last brace may hold the end of the array alone; without it the last object of the file says so
    whole = F.when(F.col("last"), F.col("value")).otherwise(F.concat("value", F.lit("}")))
    piece = F.struct("range", "at", whole.alias("text"))
    found = rows.groupBy("file", "task_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["text"]), "").alias("raw"), F.min("offset").alias("start"),
        F.max("ends").alias("ended"), F.max("last").alias("tail"), F.max(F.col("offset") + F.col("size") >= F.col("file_size")).alias("stops"),
    )
    head = F.regexp_extract("raw", r"^(?:\s*\[)?[\s,]*", 0)
    begins = F.when(F.col("task_id") == 0, F.col("raw").rlike(r"^\s*\[[\s,]*\{")).otherwise(F.col("raw").rlike(r"^[\s,]*\{"))
    ending = F.when(F.col("task_id") == 0, F.col("raw").rlike(r"^\s*\[[\s,]*\]")).otherwise(F.col("raw").rlike(r"^[\s,]*\]"))
    wrong = (
        F.when((F.col("task_id") == 0) & ~F.col("raw").rlike(r"^\s*\["), "is no JSON array")
        .when((F.col("ended") == 1) & ~begins, "has an entry that is no object").when((F.col("ended") == 1) & F.col("stops"), "has no end")
        .when((F.col("ended") == 0) & ~ending, "is cut short or has an entry that is no object")
    )
    found = found.withColumn("ended", F.when(wrong.isNull(), F.col("ended")).otherwise(F.raise_error(F.concat("file", F.lit(" "), wrong)).cast("int")))
    size = F.octet_length(head)
    return found.filter("ended = 1").select("file", F.col("task_id").cast("long").alias("task_id"), (F.col("start") + size).alias("offset"), (F.octet_length("raw") - size).alias("length"), F.substring("raw", F.char_length(head) + 1, F.char_length("raw")).alias("value"))


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC1: the objects of one JSON array as rows of ``schema`` with their ``task_id``; a value that does not fit fails."""
    return array_objects(spark, path).select("task_id", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("o")).select("task_id", "o.*")
