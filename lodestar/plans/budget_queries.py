"""Queries over pages cut to a budget, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import budget
from .catalog import query, read

#: Characters of a page of results, and bytes of a page of text.
RESULTS, TEXT = 330, 900
FOOTER = ["", "search: True", "buttons: []"]


@query(f"""WITH RECURSIVE parts AS (SELECT p_partkey // 8 AS page, p_partkey, p_partkey::VARCHAR AS id, p_size::VARCHAR AS price, p_brand || ' ' || p_name || ' ' || p_type || ' ' || repeat(p_name, p_size % 4) AS title FROM part),
pages AS (SELECT page, max(length(title)) AS longest, count(*) AS n FROM parts GROUP BY page),
s AS (SELECT page, 0::BIGINT AS low, longest::BIGINT AS high, -1::BIGINT AS best FROM pages
 UNION ALL SELECT page, CASE WHEN fits THEN mid + 1 ELSE low END, CASE WHEN fits THEN high ELSE mid - 1 END, CASE WHEN fits THEN mid ELSE best END
 FROM (SELECT s.*, (low + high) // 2 AS mid, (SELECT sum(length(id) + length(price) + 2 + 3 + least(length(title), (low + high) // 2)) FROM parts WHERE parts.page = s.page) + length(concat_ws(chr(10), '{budget.PROJECTION}', 'page_type: search_results', 'query: part', 'page: Page ' || (s.page + 1), 'products_shown: ' || n || '/' || n))
  + CASE WHEN longest > (low + high) // 2 THEN {len(budget.MARKER) + 31} ELSE 0 END + n + {1 + len(chr(10).join(FOOTER))} <= {RESULTS} AS fits FROM s JOIN pages USING (page) WHERE low <= high))
SELECT page, CASE WHEN best >= 0 THEN best END AS title_limit FROM s WHERE low > high""")
def fitted_results(spark, sf_dir):
    """JSN4: pages of eight parts."""
    title = F.concat_ws(" ", "p_brand", "p_name", "p_type", F.expr("repeat(p_name, p_size % 4)"))
    row = F.struct(F.col("p_partkey").alias("at"), F.col("p_partkey").cast("string").alias("id"), F.col("p_size").cast("string").alias("price"), title.alias("title"))
    pages = read(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 8).alias("page")).agg(F.array_sort(F.collect_list(row)).alias("products"))  # eight at most
    name, footer = F.concat(F.lit("Page "), (F.col("page") + 1).cast("string")), F.array(*[F.lit(x) for x in FOOTER])
    fit = budget.fit_search_page(F.col("products"), F.lit("part"), name, footer, RESULTS, F.char_length)
    return pages.select("page", fit.alias("f")).select("page", F.col("f.limit").alias("title_limit"))


@query()
def fitted_texts(spark, sf_dir):
    """JSN4: every document within a budget of bytes; no SQL for the white space at its cuts; the tests hold its operator against a plain search."""
    fit = budget.fit_body(F.col("text"), F.array(*[F.lit(x) for x in FOOTER]), TEXT, F.octet_length)
    return read(spark, sf_dir, "documents").select("doc_id", fit.alias("t")).select("doc_id", F.octet_length("t").alias("n_bytes"), F.sha2("t", 256).alias("text_sha256"))
