"""A corpus from raw documents to packed sequences.

Each stage takes what the one before it kept, as a table, and returns a table: language
identification, quality rules, line deduplication, the n-gram join, best-fit packing.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import join, langid, lines, packing, quality
from lodestar.llm.common import documents, stash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document stays if one language has this share of its words.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: texts without a letter, or of no prevailing language, go."""
    found = langid.identify(docs.select(*COLUMNS), langid.learn(langid.sample(docs)))
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the decision list learned from labelled ones."""
    rules = quality.learned_rules(spark, sf_dir, docs)
    rows = quality.with_statistics(docs.select(*COLUMNS))
    return rows.filter(~F.col("base_failed") & quality.verdict(rules)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each fuzzy line once; documents that had no other lines go."""
    rows = lines.drop_lines(docs.select(*COLUMNS)).filter(F.col("text").rlike(r"[^ \t-\r]"))
    return rows.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    return join.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("best_fit_packing", best_fit_packing),
]

#: No stage but the last can be expressed in SQL; the tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stash(docs, name)
    return docs
