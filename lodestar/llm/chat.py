"""Chat formatting in budgeted windows.

The turns of a conversation are rendered as ``<|role|>text<|end|>``.  Prefix sums of the turns'
tokens cut the conversation into turn-aligned spans; each window holds the leading system turn,
a limited stretch of history, and the new turns of its span.  Only assistant turns that are new in
a window are under its loss mask, so each target is learned once.

Control strings in roles and texts are escaped reversibly: ``~`` becomes ``~0`` and ``<`` ``~1``
and ``[`` ``~2``, so that neither the template's marks nor marks of other templates survive.

Null roles and texts count as empty; turns are ordered by turn, then role and text; repeated rows
are repeated turns; rows of a null conversation id form one conversation; a turn over the budget
has a window of its own; an empty table gives no windows; other columns are ignored.  A turn is
never split, so a window exceeds the budget only by a turn that does so alone.  A conversation is
held in one row, as its digests need it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "<|end|>"
BUDGET, HISTORY = 512, 128
#: Tokens that the marks of a turn cost.
TURN_COST = 4


def escape(c: Column) -> Column:
    for a, b in (("~", "~0"), ("<", "~1"), ("[", "~2")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in (("[", "~2"), ("<", "~1"), ("~", "~0")):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def header(role: Column) -> Column:
    return F.concat(F.lit("<|"), escape(role), F.lit("|>"))


def _range(lo: Column, hi: Column) -> Column:
    """lo to hi, empty if hi is below lo."""
    return F.when(hi < lo, F.array().cast("array<int>")).otherwise(F.sequence(lo.cast("int"), hi.cast("int")))


def windows(df: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: str | None = None) -> DataFrame:
    """``tokens`` names a column of token counts of the turns; without one, a quarter of a text's bytes is taken
    as an estimate, as no tokenizer runs in built-in expressions.  One row per window: conv_id, window (from 0), formatted, n_repeated (turns at its head that
    stood in an earlier window), loss (array of start, length in code points of ``formatted``)."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    count = F.ceil(F.octet_length(text) / 4) if tokens is None else F.coalesce(F.col(f"`{tokens}`"), F.lit(0))
    turns = df.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text"), count.alias("count")))).alias("turns")
    )
    shown = F.transform(
        "turns",
        lambda t: F.struct(
            t["role"].alias("role"),
            F.concat(header(t["role"]), escape(t["text"]), F.lit(END)).alias("out"),
            F.length(header(t["role"])).alias("head"),
            F.length(escape(t["text"])).alias("body"),
            (t["count"] + TURN_COST).cast("long").alias("tokens"),
        ),
    )
    rows = turns.select("conv_id", shown.alias("t")).withColumn("n", F.size("t")).withColumn("system", (F.col("t")[0]["role"] == "system").cast("int"))
    # sums[i]: tokens of the first i turns
    sums = F.aggregate("t", F.array(F.lit(0).cast("long")), lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + t["tokens"])))
    rows = rows.withColumn("sums", sums).withColumn("room", F.greatest(F.lit(1).cast("long"), F.lit(budget - history) - F.when(F.col("system") == 1, F.col("t")[0]["tokens"]).otherwise(0)))
    # a span starts where the tokens since the last start would pass the room
    starts = F.aggregate(
        _range(F.lit(1), F.col("n") - 1),
        F.array(F.lit(0)),
        lambda acc, i: F.when(
            (F.col("sums")[i + 1] - F.col("sums")[F.greatest(F.element_at(acc, -1), F.col("system"))] > F.col("room")) & (i > F.greatest(F.element_at(acc, -1), F.col("system"))),
            F.concat(acc, F.array(i)),
        ).otherwise(acc),
    )
    rows = rows.withColumn("starts", starts).select("conv_id", "t", "n", "system", "sums", "starts", F.posexplode("starts").alias("window", "lo"))
    hi = F.coalesce(F.get("starts", F.col("window") + 1), F.col("n"))
    past = F.filter(_range(F.col("system"), F.col("lo") - 1), lambda j: F.col("sums")[F.col("lo")] - F.col("sums")[j] <= history)
    rows = rows.withColumn("hi", hi).withColumn(
        "before", F.when(F.col("window") == 0, F.array().cast("array<int>")).otherwise(F.concat(F.when(F.col("system") == 1, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), past))
    )
    rows = rows.withColumn("use", F.concat("before", _range(F.col("lo"), F.col("hi") - 1)))
    ends = F.aggregate("use", F.array(F.lit(0)), lambda acc, j: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(F.col("t")[j]["out"]))))
    rows = rows.withColumn("ends", ends)
    loss = F.transform(
        F.filter(_range(F.size("before"), F.size("use") - 1), lambda k: F.col("t")[F.col("use")[k]]["role"] == "assistant"),
        lambda k: F.struct((F.col("ends")[k] + F.col("t")[F.col("use")[k]]["head"]).alias("start"), F.col("t")[F.col("use")[k]]["body"].alias("length")),
    )
    return rows.select(
        "conv_id",
        "window",
        F.concat_ws("", F.transform("use", lambda j: F.col("t")[j]["out"])).alias("formatted"),
        F.size("before").alias("n_repeated"),
        loss.alias("loss"),
    )


def read_back(shown: DataFrame) -> DataFrame:
    """The turns (array of role, text) and the texts under the loss mask, from the windows alone."""
    pieces = F.split("formatted", r"<\|end\|>")
    new = F.slice(pieces, F.col("n_repeated") + 1, F.size(pieces) - 1 - F.col("n_repeated"))
    turns = F.transform(
        new,
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(3)), "|>", 1)).alias("role"),
            unescape(F.substr(p, F.instr(p, F.lit("|>")) + 2)).alias("text"),
        ),
    )
    lost = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    parts = shown.select("conv_id", F.struct("window", turns.alias("turns"), lost.alias("lost"), F.length("formatted").cast("long").alias("chars")).alias("w"))
    return (
        parts.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("w")).alias("w"))
        .select(
            "conv_id",
            F.flatten(F.transform("w", lambda w: w["turns"])).alias("turns"),
            F.flatten(F.transform("w", lambda w: w["lost"])).alias("lost"),
            F.aggregate("w", F.lit(0).cast("long"), lambda a, w: a + w["chars"]).alias("formatted_chars"),
        )
    )


def op9_budgeted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of all conversations, read back.  Null texts and roles are empty, a null conversation id is one
    conversation, equal turns are ordered by role and text, repeated rows are repeated turns, a very long turn
    has a window of its own; an empty table gives conversation -7 alone; other columns are not read."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(windows(rows))
    whole = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    lost = F.concat_ws("", "lost")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"),
        F.sha2(lost, 256).alias("loss_sha256"),
        "formatted_chars",
    )

