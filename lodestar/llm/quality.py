"""Quality rules learned as a decision list.

Statistics of a text are built from array functions.  Labelled statistics teach an ordered list of
rules by sequential covering: a rule starts empty and takes, one at a time, the threshold condition
with the best information gain on the growing rows; its last conditions go again as long as that
helps on the pruning rows; rows it covers leave, and the next rule is grown, until a rule is no
longer right often enough.  The list becomes one ordered Spark conditional expression.

Counts for all candidate conditions of a step come from one aggregation.  Learning uses a bounded
sample (``LABELLED`` rows by a hash of the id); the rules apply to every row.

Null and empty texts have no words: they fail the base rule and are not kept.  Several labels of a
document count as the lowest; null labels as none.  Without labels the list is empty and only the
base rule decides.  Repeated rows and other columns stay as they are.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, let, stash, words

LABELLED = 6000
MOST_RULES, MOST_CONDITIONS, PRECISION = 6, 3, 0.97
BASE_WORDS, BASE_REPEAT_PERCENT, WINDOW = 10, 20, 5
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
PARTS = (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.93, 0.95, 0.97, 0.98, 0.99, 0.995)


def _count_of(text: Column, chars: str) -> Column:
    """How often one-byte characters occur."""
    out = F.lit(0)
    for c in chars:
        out = out + F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))
    return out.cast("long")


def _repeated(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more."""

    def covered(starts: Column) -> Column:
        steps = F.transform(F.slice(starts, 2, F.size(starts)), lambda p, k: F.least(F.lit(WINDOW), p - starts[k]))
        return F.aggregate(steps, F.lit(WINDOW), lambda a, s: a + s)

    def starts(ordered: Column) -> Column:
        same = lambda j, d: F.coalesce(F.get(ordered, j + d)["x"] == ordered[j]["x"], F.lit(False))
        found = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda j: same(j, -1) | same(j, 1))
        return F.sort_array(F.transform(found, lambda j: ordered[j]["i"]))

    some = let(F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), lambda o: let(starts(o), covered))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(some)


def statistics(text: Column) -> Column:
    """Struct of the five statistics, all long."""
    text = F.coalesce(text, F.lit(""))
    lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))

    def of_words(w: Column) -> Column:
        hashes = F.when(F.size(w) < WINDOW, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[w[i + d] for d in range(WINDOW)]))
        )
        return F.struct(F.size(w).cast("long").alias("n"), let(hashes, _repeated).cast("long").alias("r"))

    return let(
        let(words(text), of_words),
        lambda x: F.struct(
            x["n"].alias("n_words"),
            (F.length(text) - _count_of(text, WHITE)).cast("long").alias("word_chars"),
            _count_of(text, SYMBOLS).alias("n_symbols"),
            lines.cast("long").alias("n_dup_lines"),
            x["r"].alias("n_repeat_words"),
        ),
    )


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the statistics and ``base_failed`` (any columns of these names are replaced)."""
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in (*STATISTICS, "base_failed")], statistics(F.col(f"`{text}`")).alias("__s"))
    out = kept.select(*[F.col(f"`{c}`") for c in kept.columns if c != "__s"], *[F.col("__s")[n].alias(n) for n in STATISTICS])
    return out.withColumn("base_failed", (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words")))


def measures() -> dict[str, Column]:
    """What rules compare with thresholds."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "dup_lines_per_word": F.col("n_dup_lines") / n,
        "repeat_share": F.col("n_repeat_words") / n,
    }


class Condition(NamedTuple):
    measure: str
    above: bool
    threshold: float

    def column(self) -> Column:
        m = measures()[self.measure]
        return m >= self.threshold if self.above else m <= self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>=' if self.above else '<='} {self.threshold:g}"


def learn(labelled: DataFrame, bad: str = "bad", doc_id: str = "doc_id") -> list[list[Condition]]:
    """Ordered rules that tell bad rows, from a stored table of statistics and a boolean label."""
    names = list(measures())
    cuts = labelled.agg(*[F.percentile_approx(measures()[n], list(PARTS), 10_000).alias(n) for n in names]).first()
    conditions = [Condition(n, up, t) for n in names for t in sorted(set(cuts[n] or [])) for up in (True, False)]
    if not conditions:
        return []
    holds = F.array_compact(F.array(*[F.when(c.column(), F.lit(i)) for i, c in enumerate(conditions)]))
    rows = stash(labelled.select(F.col(bad).alias("bad"), (F.pmod(F.xxhash64(doc_id, F.lit(3)), F.lit(3)) < 2).alias("grow"), holds.alias("holds")), "rule-rows")
    bads, goods = F.sum(F.col("bad").cast("long")), F.sum((~F.col("bad")).cast("long"))
    has = lambda rule: F.forall(F.array(*[F.lit(i) for i in rule]), lambda i: F.array_contains("holds", i)) if rule else F.lit(True)
    rules: list[list[int]] = []
    while len(rules) < MOST_RULES:
        left = rows
        for r in rules:
            left = left.filter(~has(r))
        rule: list[int] = []
        p, n = (x or 0 for x in left.filter("grow").agg(bads, goods).first())
        while p and n and len(rule) < MOST_CONDITIONS:
            found = left.filter("grow").filter(has(rule)).select("bad", F.explode("holds").alias("c")).groupBy("c").agg(bads.alias("p"), goods.alias("n")).collect()
            gain = lambda r: r.p * (math.log2(r.p / (r.p + r.n)) - math.log2(p / (p + n))) if r.p else -1.0
            best = max(found, key=lambda r: (round(gain(r), 9), -r.c))
            if gain(best) <= 1e-9:
                break
            rule.append(best.c)
            p, n = best.p, best.n
        if not rule:
            break
        held = left.filter(~F.col("grow")).agg(*[F.sum((F.col("bad") & has(rule[:k])).cast("long")) for k in range(1, len(rule) + 1)], *[F.sum((~F.col("bad") & has(rule[:k])).cast("long")) for k in range(1, len(rule) + 1)]).first()
        worth = lambda k: ((held[k - 1] or 0) - (held[k - 1 + len(rule)] or 0)) / max(1, (held[k - 1] or 0) + (held[k - 1 + len(rule)] or 0))
        k = max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))
        p, n = held[k - 1] or 0, held[k - 1 + len(rule)] or 0
        if not p or p / (p + n) < PRECISION:
            break
        rules.append(rule[:k])
    return [[conditions[i] for i in r] for r in rules]


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as an ordered conditional expression: true for rows to keep."""
    if not rules:
        return F.lit(True)
    out = F
    for r in rules:
        test = F.lit(True)
        for c in r:
            test = test & c.column()
        out = out.when(test, F.lit(False))
    return out.otherwise(F.lit(True))


def labelled_statistics(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """Statistics and label of about ``most`` labelled documents, picked by a hash of the id."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    n = usable.count()
    scale = 1 << 30
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(scale)) < int(scale * min(1.0, most / max(1, n))))
    chosen = chosen.groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most about ``most`` rows
    return stash(with_statistics(own).drop("text"), "labelled")


def learned_rules(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> list[list[Condition]]:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return learn(labelled_statistics(documents(spark, sf_dir) if docs is None else docs, labels))


def op7_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document.  Null texts have no words and fail the base rule; conditions of
    equal worth are taken in order of their names; repeated rows are judged alike; very long texts are read whole; an empty
    table gives no rows, and without labels nothing but the base rule rejects; other columns are not read."""
    rules = learned_rules(spark, sf_dir)
    out = with_statistics(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", *STATISTICS, "base_failed", (~F.col("base_failed") & verdict(rules)).alias("kept"))
