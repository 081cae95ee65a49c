"""Lexical retrieval: postings, BM25 top-k, ranks and pages.

Postings are (term, id, f, dl): one shuffle by id makes them, none to read them again.  A search
joins the distinct terms of the queries with the postings, sums per (query, id) and ranks.  The
query side is broadcast only if its counted size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
FLOOR = 1e-6
SMALL_TERMS = 200_000


def _terms(fields: dict[str, tuple[Column, float]]) -> list[tuple[Column, float]]:
    return [(F.array_distinct(F.coalesce(t, F.array().cast("array<string>"))), w) for t, w in fields.values()]


def postings(df: DataFrame, id_col: str, fields: dict[str, tuple[Column, float]]) -> DataFrame:
    """IDX1: (id, dl, term, f).  ``fields``: name -> (array of terms, weight); a field holds a term
    once, and f is the sum of the weights of the fields that hold it.  A document without a term has one
    row, of a null term: it counts in the statistics."""
    each = _terms(fields)
    length = sum((F.size(t) for t, _ in each), F.lit(0))

    def weighed(terms: Column, weight: float) -> Column:
        return F.transform(terms, lambda x: F.struct(x.alias("term"), F.lit(float(weight)).alias("w")))

    pairs = F.flatten(F.array(*[weighed(t, w) for t, w in each]))
    # arrays and length below the explode: beside it they would be made for every term
    rows = df.select(F.col(id_col).alias("id"), length.alias("dl"), pairs.alias("pairs")).select("id", "dl", F.explode_outer("pairs").alias("p"))
    if len(each) == 1:
        return rows.select("id", "dl", F.col("p")["term"].alias("term"), F.col("p")["w"].alias("f"))
    return rows.groupBy("id", "dl", F.col("p")["term"].alias("term")).agg(F.sum("p.w").alias("f"))


def statistics(index: DataFrame) -> DataFrame:
    """One row: n documents, avgdl, from postings alone."""
    return index.select("id", "dl").distinct().agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def sizes(df: DataFrame, fields: dict[str, tuple[Column, float]]) -> DataFrame:
    """The same from the documents (one row each): no term is exploded for it."""
    length = sum((F.size(t) for t, _ in _terms(fields)), F.lit(0))
    return df.select(length.alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def bm25_scores(index: DataFrame, terms: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """(query, id, score) of all that share a term; ``terms``: (query, term) without repeats.  With few terms only
    sums of a query and document are shuffled, else the postings of the queries' terms."""
    stats = statistics(index) if stats is None else stats
    small = terms.count() <= SMALL_TERMS
    asked = terms.select("term").distinct()
    hits = index.join(F.broadcast(asked) if small else asked, "term", "left_semi")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # what the terms of a query weigh is no larger than the queries: where these are few, no posting is shuffled by term
    weighed = (F.broadcast(terms) if small else terms).join(df, "term").crossJoin(F.broadcast(stats))  # stats: one row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = weighed.select("query", "term", F.when(idf > 0, idf).otherwise(FLOOR).alias("idf"), "avgdl")
    hit = index.join(F.broadcast(weighed), "term") if small else hits.join(weighed, "term")
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hit.groupBy("query", "id").agg(F.sum(part).alias("score"))


def top_k(scores: DataFrame, k: int = 150, digits: int = 9) -> DataFrame:
    """RET6: ranked by score, then id."""
    w = W.partitionBy("query").orderBy(F.desc("score"), "id")
    return scores.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def page(ranked: DataFrame, number: int, rows: int = 20) -> DataFrame:
    """RET10: a page is a filter on the rank."""
    return ranked.filter((F.col("rank") > (number - 1) * rows) & (F.col("rank") <= number * rows))


def target_ranks(ranked: DataFrame, targets: DataFrame) -> DataFrame:
    """RET12: ``targets`` (query, id) with the rank, null if not found."""
    return targets.join(ranked.select("query", "id", "rank"), ["query", "id"], "left")


def members(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """RET7."""
    return df.join(ids, key, "left_semi")
