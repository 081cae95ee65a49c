"""Named queries over the standard tables and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import evaluate, groups, retrieval, scoring, selection, sequences

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- retrieval ------------------------------------------------------------------------------

_BM25 = """
WITH t AS (SELECT doc_id AS id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS ts FROM documents),
d AS (SELECT id, coalesce(len(ts), 0) AS dl, ts FROM t),
p AS (SELECT id, dl, unnest(ts) AS term FROM d),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT item_id AS query, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM benchmark),
sc AS (
  SELECT query, id, round(sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END
    * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM q JOIN p USING (term) JOIN df USING (term), s GROUP BY query, id),
r AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM sc)
"""


def _ranked(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    docs, fields = read(spark, sf_dir, "documents"), {"text": (text.words(F.col("text")), 1.0)}
    index = retrieval.postings(docs, "doc_id", fields)
    terms = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.explode(F.array_distinct(text.words(F.col("text")))).alias("term"))
    return retrieval.top_k(retrieval.bm25_scores(index, terms, retrieval.sizes(docs, fields)), k)


@query(_BM25 + "SELECT query, id, round(score, 6) AS score, rank::INTEGER AS rank, CASE WHEN rank = 1 THEN 'rank1' WHEN rank <= 5 THEN '2_5' ELSE '6_20' END AS bucket FROM r WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    """IDX1, RET2, RET6, RET14."""
    rows = _ranked(spark, sf_dir, 10)
    return rows.select("query", "id", F.round("score", 6).alias("score"), "rank", numbers.rank_bucket(F.col("rank")).alias("bucket"))


@query(_BM25 + "SELECT query, id, rank::INTEGER AS rank FROM r WHERE rank BETWEEN 21 AND 40")
def bm25_page_two(spark, sf_dir):
    """RET10, RET11."""
    return retrieval.page(_ranked(spark, sf_dir, 150), 2).select("query", "id", "rank")


@query(_BM25 + """, tg AS (SELECT b.item_id AS query, min(d.doc_id) AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1)
SELECT tg.query, tg.id, CASE WHEN rank <= 150 THEN rank END::INTEGER AS rank,
  CASE WHEN rank IS NULL OR rank > 150 THEN 'missing' WHEN rank = 1 THEN 'rank1' WHEN rank <= 5 THEN '2_5' WHEN rank <= 20 THEN '6_20' ELSE '21_150' END AS bucket
FROM tg LEFT JOIN r ON r.query = tg.query AND r.id = tg.id""")
def target_ranks(spark, sf_dir):
    """RET12, RET13: rank of the first document that holds the query's passage."""
    items = [(r.item_id, r.text) for r in read(spark, sf_dir, "benchmark").collect()]  # the benchmark is a fixed, small table
    docs = read(spark, sf_dir, "documents")
    hits = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(t)), F.lit(i)) for i, t in items]))
    targets = docs.select("doc_id", F.explode(hits).alias("query")).groupBy("query").agg(F.min("doc_id").alias("id"))
    out = retrieval.target_ranks(_ranked(spark, sf_dir, 150), targets)
    return out.select("query", "id", "rank", numbers.rank_bucket(F.col("rank")).alias("bucket"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def membership(spark, sf_dir):
    """RET7."""
    return retrieval.members(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"), "doc_id").select("doc_id")


@query("""SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY term""")
def document_frequency(spark, sf_dir):
    """IDX1."""
    index = retrieval.postings(read(spark, sf_dir, "documents"), "doc_id", {"text": (text.words(F.col("text")), 1.0)})
    return index.filter("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


# --- text functions -------------------------------------------------------------------------


@query("""WITH a AS (SELECT p_partkey, lower(p_name) AS n FROM part),
g AS (SELECT p_partkey, n, list_distinct(list_transform(range(1, len(n) - 1), lambda i: substr(n, i, 3))) AS t FROM a)
SELECT l.p_partkey AS p_partkey, round(len(list_intersect(l.t, r.t)) / len(list_distinct(list_concat(l.t, r.t))), 9) AS similarity
FROM g l, (SELECT t FROM g WHERE p_partkey = 0) r""")
def trigram_similarity(spark, sf_dir):
    """STR5, STR6: parts against the first part."""
    part = read(spark, sf_dir, "part").select("p_partkey", text.trigrams(F.lower("p_name")).alias("t"))
    first = part.filter("p_partkey = 0").select(F.col("t").alias("u"))
    return part.crossJoin(F.broadcast(first)).select("p_partkey", F.round(text.jaccard(F.col("t"), F.col("u")), 9).alias("similarity"))  # one row


@query("SELECT doc_id, sha256('s1|' || doc_id || '|' || coalesce(lang, '')) AS order_key FROM documents")
def stable_keys(spark, sf_dir):
    """STR20."""
    return read(spark, sf_dir, "documents").select("doc_id", text.order_key("s1", F.col("doc_id"), F.coalesce("lang", F.lit(""))).alias("order_key"))


@query("SELECT p_partkey, CASE WHEN length(p_name) <= 8 THEN p_name ELSE substr(p_name, 1, 4) || '…' || right(p_name, 3) END AS short_name FROM part")
def compact_titles(spark, sf_dir):
    """STR14."""
    return read(spark, sf_dir, "part").select("p_partkey", text.compact_title(F.col("p_name"), 8).alias("short_name"))


@query("SELECT p_partkey, regexp_replace(lower(p_brand || ' / ' || p_type), '[^a-z0-9]', '', 'g') AS name, 'opt_' || left(sha256(p_brand || p_type), 16) AS option_id FROM part")
def option_ids(spark, sf_dir):
    """STR4, STR18."""
    return read(spark, sf_dir, "part").select("p_partkey", text.letters_only(F.concat("p_brand", F.lit(" / "), "p_type")).alias("name"), text.short_id("opt_", F.concat("p_brand", "p_type")).alias("option_id"))


@query("""SELECT user_id, sha256(string_agg(event_id::VARCHAR, chr(0) ORDER BY event_id)) AS fingerprint FROM events GROUP BY user_id""")
def result_fingerprints(spark, sf_dir):
    """STR22."""
    ids = F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string"))
    return read(spark, sf_dir, "events").groupBy("user_id").agg(ids.alias("ids")).select("user_id", text.result_fingerprint(F.col("ids")).alias("fingerprint"))


@query("""SELECT s_suppkey, list_filter(list_transform(string_split(s_name || '› ' || s_nationkey || ' ›', '›'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM supplier""")
def category_paths(spark, sf_dir):
    """STR10."""
    return read(spark, sf_dir, "supplier").select("s_suppkey", text.category_parts(F.concat("s_name", F.lit("› "), F.col("s_nationkey").cast("string"), F.lit(" ›"))).alias("parts"))


# --- numbers --------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'mass_g' ELSE 'length_mm' END AS dimension, round(p_size * CASE WHEN p_size % 2 = 0 THEN 1000.0 ELSE 10.0 END, 6)::DOUBLE AS amount FROM part")
def unit_conversion(spark, sf_dir):
    """NUM1."""
    size = F.col("p_size").cast("double")
    base = numbers.to_base(size, F.when(F.col("p_size") % 2 == 0, "KG").otherwise("厘米"))
    return read(spark, sf_dir, "part").select("p_partkey", base.alias("b")).select("p_partkey", F.col("b.dimension").alias("dimension"), F.round("b.amount", 6).alias("amount"))


@query("""SELECT user_id, count(*) AS steps, round(-(greatest(0, least(count(*), 20) - 15) * 0.01 + greatest(0, least(count(*), 25) - 20) * 0.02 + greatest(0, least(count(*), 30) - 25) * 0.03
 + greatest(0, least(count(*), 35) - 30) * 0.04 + greatest(0, least(count(*), 40) - 35) * 0.05 + greatest(0, least(count(*), 45) - 40) * 0.06), 6)::DOUBLE AS penalty FROM events GROUP BY user_id""")
def step_penalties(spark, sf_dir):
    """NUM15."""
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("steps")).select("user_id", "steps", F.round(numbers.step_penalty(F.col("steps")), 6).alias("penalty"))


@query("""SELECT o_orderkey, CASE WHEN s < 10 THEN 'lt10' WHEN s < 15 THEN '10_15' WHEN s < 18 THEN '15_18' ELSE 'ge18' END AS difficulty FROM (SELECT o_orderkey, o_totalprice / 20000 AS s FROM orders)""")
def difficulty_buckets(spark, sf_dir):
    """NUM19."""
    return read(spark, sf_dir, "orders").select("o_orderkey", numbers.difficulty_bucket(F.col("o_totalprice") / 20000).alias("difficulty"))


@query("""SELECT o_orderpriority, count(o_totalprice) AS n, round(median(o_totalprice), 4) AS median, round(quantile_cont(o_totalprice, 0.9), 4) AS p90, quantile_disc(o_totalprice, 0.95) AS p95,
  min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY 1""")
def quantiles(spark, sf_dir):
    """NUM20, NUM21, NUM22, AG18."""
    out = evaluate.spread(read(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")
    return out.select("o_orderpriority", "n", F.round("median", 4).alias("median"), F.round("p90", 4).alias("p90"), "p95", "least", "most")


@query("SELECT p_partkey, round(greatest(0, p_retailprice * 0.8), 6) AS low, round(p_retailprice * 1.2, 6) AS high FROM part")
def approximate_bounds(spark, sf_dir):
    """NUM8."""
    return read(spark, sf_dir, "part").select("p_partkey", numbers.around(F.col("p_retailprice")).alias("b")).select("p_partkey", F.round("b.low", 6).alias("low"), F.round("b.high", 6).alias("high"))


# --- deduplication, decontamination ------------------------------------------------------------


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_keep_first(spark, sf_dir):
    """SRC8, WN13: by a digest of the text, so that texts do not move."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("digest"))
    return docs.groupBy("digest").agg(F.min(F.struct("doc_id", "lang")).alias("first")).select("first.doc_id", "first.lang")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def dedup_keep_best(spark, sf_dir):
    """WN13: keep-best."""
    return selection.keep_first(read(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text))")
def decontam_anti(spark, sf_dir):
    """JN9, JN10, exact rung."""
    held = [r.text for r in read(spark, sf_dir, "benchmark").filter("text is not null").collect()]  # a fixed, small table
    return selection.decontaminate(read(spark, sf_dir, "documents"), held, "text").select("doc_id")


@query("""WITH g AS (SELECT p_partkey, p_brand, list_distinct(list_transform(range(1, len(p_name) - 1), lambda i: substr(p_name, i, 3))) AS t FROM part)
SELECT l.p_partkey FROM g l WHERE l.p_partkey % 2 = 1 AND NOT EXISTS (SELECT 1 FROM g r WHERE r.p_partkey % 2 = 0 AND r.p_brand = l.p_brand
  AND len(list_intersect(l.t, r.t)) / len(list_distinct(list_concat(l.t, r.t))) >= 0.88)""")
def blocked_decontam(spark, sf_dir):
    """JN8: blocked on brand, title trigrams of 0.88 or more."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand", text.trigrams(F.col("p_name")).alias("t"))
    left, right = part.filter("p_partkey % 2 = 1"), part.filter("p_partkey % 2 = 0").select("p_brand", F.col("t").alias("u")).distinct()
    return selection.blocked_overlap(left, right, "p_brand", text.jaccard(F.col("t"), F.col("u")) >= 0.88, "p_partkey").select("p_partkey")


# --- splits, quotas, bands --------------------------------------------------------------------------


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('7:' || doc_id), doc_id) AS n, count(*) OVER () AS c FROM documents)
SELECT doc_id, CASE WHEN n <= least(greatest(1, round_even(c * 0.1, 0)), c - 1) THEN 'validation' ELSE 'train' END AS split FROM r""")
def stable_split(spark, sf_dir):
    """SM1."""
    return selection.stable_split(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", "7", 0.1)


_QUOTA = """WITH c AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang), t AS (SELECT *, sum(n) OVER () AS s FROM c),
f AS (SELECT lang, n, (n * 100) // s AS q, (n * 100) % s AS m FROM t),
r AS (SELECT *, row_number() OVER (ORDER BY m DESC, {ties}) AS k, 100 - sum(q) OVER () AS rest FROM f)
SELECT lang, n, (q + CASE WHEN k <= rest THEN 1 ELSE 0 END)::BIGINT AS quota FROM r"""


@query(_QUOTA.format(ties="n DESC, lang DESC"))
def quota_largest_remainder(spark, sf_dir):
    """SM2."""
    counts = read(spark, sf_dir, "documents").filter("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return selection.largest_remainder(counts, "lang", "n", 100, [F.desc("n"), F.desc("lang")])


@query(_QUOTA.format(ties="lang"))
def quota_band_order(spark, sf_dir):
    """SM3."""
    counts = read(spark, sf_dir, "documents").filter("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return selection.largest_remainder(counts, "lang", "n", 100, ["lang"])


@query("SELECT doc_id, quality FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY sha256('q|' || doc_id), doc_id) AS n FROM labels) WHERE n <= 25")
def topn_per_stratum(spark, sf_dir):
    """SM4, SM17."""
    return selection.top_per_group(read(spark, sf_dir, "labels"), ["quality"], [text.order_key("q", F.col("doc_id")), "doc_id"], 25).select("doc_id", "quality")


@query("SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS n, count(*) OVER () AS c FROM orders) WHERE n <= c // 10")
def domain_cap(spark, sf_dir):
    """SM7, window form: no domain over a tenth."""
    rows = read(spark, sf_dir, "orders")
    cap = rows.count() // 10
    return selection.top_per_group(rows, ["o_orderstatus"], [F.desc("o_totalprice"), "o_orderkey"], cap).select("o_orderkey", "o_orderstatus")


@query("""WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders),
b AS (SELECT * FROM (VALUES ('low', 0.0, 0.1), ('mid', 0.45, 0.55), ('top', 0.9, 1.0)) AS v(band, a, z))
SELECT o_orderkey, o_orderstatus, band FROM r, b WHERE i >= floor(n * a) AND i < greatest(floor(n * z), floor(n * a) + 1)""")
def percentile_bands(spark, sf_dir):
    """WN11."""
    bands = [("low", 0.0, 0.1), ("mid", 0.45, 0.55), ("top", 0.9, 1.0)]
    return selection.percentile_bands(read(spark, sf_dir, "orders"), ["o_orderstatus"], ["o_totalprice", "o_orderkey"], bands).select("o_orderkey", "o_orderstatus", "band")


@query("SELECT o_orderkey, round((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) / count(*) OVER (PARTITION BY o_orderpriority), 9) AS position FROM orders")
def proportional_interleave(spark, sf_dir):
    """WN12."""
    return selection.interleave(read(spark, sf_dir, "orders"), ["o_orderpriority"], ["o_orderkey"]).select("o_orderkey", F.round("position", 9).alias("position"))


# --- sequences ----------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)
SELECT user_id, count(*) AS n, count(event_type) - count(DISTINCT event_type) AS duplicates, count(*) FILTER (event_type = p) AS consecutive FROM l GROUP BY user_id""")
def consecutive_dups(spark, sf_dir):
    """AG7, WN1."""
    return sequences.duplicate_counts(read(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type"))


@query("""SELECT event_id, coalesce(list_contains(list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), event_type), false) AS repeat FROM events""")
def repeat_within_3(spark, sf_dir):
    """WN3, WN6."""
    return sequences.repeats_within(read(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type")).select("event_id", "repeat")


@query("""SELECT event_id, coalesce(event_type = lag(event_type) OVER w AND json_extract(props, '$.k') = lag(json_extract(props, '$.k')) OVER w, false) AS removable FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def removable_duplicates(spark, sf_dir):
    """WN2, JSN1."""
    rows = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return sequences.removable_duplicates(rows, "user_id", "event_id", ["event_type", "k"]).select("event_id", "removable")


@query("""WITH e AS (SELECT user_id, min(event_id) FILTER (event_type = 'signup') AS a, max(event_id) FILTER (event_type = 'purchase') AS c FROM events GROUP BY user_id)
SELECT e.user_id, EXISTS (SELECT 1 FROM events v WHERE v.user_id = e.user_id AND v.event_type = 'view' AND v.event_id > a AND v.event_id < c) AS has_path FROM e""")
def ordered_path(spark, sf_dir):
    """WN5."""
    return sequences.ordered_path(read(spark, sf_dir, "events"), "user_id", "event_id", "event_type", ("signup", "view", "purchase"))


@query("""WITH i AS (SELECT *, sum(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS isl FROM events)
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INTEGER AS step, (row_number() OVER (PARTITION BY user_id, isl ORDER BY event_id) - CASE WHEN isl > 0 THEN 1 ELSE 0 END)::INTEGER AS idle FROM i""")
def noprogress_islands(spark, sf_dir):
    """ST1, window form."""
    return sequences.no_progress(read(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type").isin("purchase", "signup")).select("event_id", "step", "idle")


@query("""SELECT user_id, event_type, event_id, place FROM (SELECT user_id, event_type, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id))::INTEGER AS place
 FROM (SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL)) WHERE place <= 3""")
def first_n_distinct(spark, sf_dir):
    """ST3."""
    return sequences.first_distinct(read(spark, sf_dir, "events"), "user_id", "event_id", "event_type", 3)


@query("""SELECT event_id, last_value(CASE WHEN event_type <> 'error' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM events""")
def previous_observation(spark, sf_dir):
    """WN15."""
    return sequences.previous_value(read(spark, sf_dir, "events"), "user_id", "event_id", F.when(F.col("event_type") != "error", F.col("value"))).select("event_id", "previous")


@query("""WITH c AS (SELECT conv_id, turn, role, length(coalesce(text, '')) AS n FROM conversations),
r AS (SELECT *, 600 - sum(CASE WHEN role = 'system' THEN n ELSE 0 END) OVER (PARTITION BY conv_id) AS room,
  sum(CASE WHEN role = 'system' THEN 0 ELSE n END) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, turn = max(turn) OVER (PARTITION BY conv_id) AS last FROM c)
SELECT conv_id, turn, coalesce(role = 'system', false) OR last OR back <= room AS kept FROM r""")
def suffix_budget(spark, sf_dir):
    """WN9."""
    rows = read(spark, sf_dir, "conversations")
    cost = F.length(F.coalesce("text", F.lit("")))
    return sequences.suffix_budget(rows, "conv_id", "turn", cost, 600, F.coalesce(F.col("role") == "system", F.lit(False))).select("conv_id", "turn", "kept")


@query("""WITH u AS (SELECT conv_id, turn AS call FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn - 1 AS call FROM conversations WHERE role = 'assistant')
SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, coalesce(u.call, a.call) AS call, CASE WHEN u.conv_id IS NULL THEN 'return_without_call' WHEN a.conv_id IS NULL THEN 'call_without_return' END AS problem
FROM u FULL JOIN a ON u.conv_id = a.conv_id AND u.call = a.call""")
def tool_pairing(spark, sf_dir):
    """JN15: a user turn calls, the assistant turn after it returns."""
    rows = read(spark, sf_dir, "conversations")
    calls = rows.filter("role = 'user'").select("conv_id", F.col("turn").alias("call"))
    returns = rows.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("call"))
    return sequences.pair_calls(calls, returns, "conv_id", "call")


@query("""WITH a AS (SELECT user_id, event_id, 1 AS k FROM events WHERE event_type <> 'error' UNION ALL SELECT user_id, event_id + 1, 0 FROM events WHERE event_type = 'error')
SELECT user_id, event_id, 'e' || lpad((row_number() OVER (PARTITION BY user_id ORDER BY event_id, k))::VARCHAR, 4, '0') AS seq, CASE WHEN k = 1 THEN 'tool_step' ELSE 'guard_rejection' END AS kind FROM a""")
def event_interleave(spark, sf_dir):
    """WN8."""
    rows = read(spark, sf_dir, "events")
    steps = rows.filter("event_type <> 'error'").select("user_id", F.col("event_id").alias("at"))
    blocked = rows.filter("event_type = 'error'").select("user_id", (F.col("event_id") + 1).alias("at"))
    out = sequences.event_stream(steps, blocked, "user_id", "at")
    return out.select("user_id", F.col("at").alias("event_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_args(spark, sf_dir):
    """JSN1, JSN2."""
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


# --- scoring ------------------------------------------------------------------------------------------

_TERMINAL = """WITH c AS (SELECT user_id, count(*) AS steps,
  count(*) FILTER (event_type = 'error' AND value > 200) AS hard_fail, count(*) FILTER (event_type = 'error' AND value BETWEEN 150 AND 200) AS hard_unknown,
  count(*) FILTER (event_type = 'error' AND value < 150) AS hard_pass, count(*) FILTER (event_type = 'view' AND value > 250) AS review,
  count(*) FILTER (event_type = 'click' AND value < 60) AS soft_pass, count(*) FILTER (event_type = 'click' AND value >= 60) AS soft_fail FROM events GROUP BY user_id),
k AS (SELECT *, CASE WHEN soft_pass + soft_fail > 0 THEN soft_pass / (soft_pass + soft_fail) ELSE 1.0 END AS soft,
  CASE WHEN hard_fail > 0 THEN 'wrong_purchase' WHEN hard_unknown > 0 OR review > 0 THEN 'reward_unverifiable' WHEN hard_pass = 0 THEN 'wrong_purchase'
   WHEN user_id % 2 = 0 THEN 'gold_purchase' WHEN soft_fail > 0 THEN 'partial_alternative_purchase' ELSE 'valid_alternative_purchase' END AS reward_type FROM c)
SELECT user_id, reward_type, round(CASE reward_type WHEN 'wrong_purchase' THEN -1.0 WHEN 'reward_unverifiable' THEN 0.0 WHEN 'partial_alternative_purchase' THEN 0.5 + 0.3 * soft WHEN 'gold_purchase' THEN 1.0 ELSE 0.8 END
  - CASE WHEN reward_type = 'reward_unverifiable' THEN 0 ELSE greatest(0, least(steps, 20) - 15) * 0.01 + greatest(0, least(steps, 25) - 20) * 0.02 + greatest(0, least(steps, 30) - 25) * 0.03
   + greatest(0, least(steps, 35) - 30) * 0.04 + greatest(0, least(steps, 40) - 35) * 0.05 + greatest(0, least(steps, 45) - 40) * 0.06 END, 6)::DOUBLE AS utility FROM k"""


@query(_TERMINAL)
def terminal_class(spark, sf_dir):
    """SC18, NUM15, X31: events as constraint verdicts."""
    e, v = F.col("event_type"), F.col("value")
    strength = F.when(e == "error", "hard").when(e == "click", "soft").when((e == "view") & (v > 250), "needs_review")
    status = F.when((e == "error") & (v > 200), "fail").when((e == "error") & v.between(150, 200), "unverifiable").when(e == "error", "pass").when((e == "click") & (v < 60), "pass").when(e == "click", "fail")
    rows = read(spark, sf_dir, "events").select("user_id", strength.alias("strength"), status.alias("status"))
    counts = scoring.combine(rows, "user_id").join(rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("steps")), "user_id")
    out = scoring.terminal_class(counts, F.col("user_id") % 2 == 0, F.col("steps"))
    return out.select("user_id", "reward_type", F.round("utility", 6).alias("utility"))


@query("""SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN 'pass' WHEN 1 THEN 'unverifiable' WHEN 2 THEN 'unverifiable' WHEN 3 THEN 'unverifiable' WHEN 4 THEN CASE WHEN p_retailprice < 950 THEN 'pass' ELSE 'fail' END
 WHEN 5 THEN CASE WHEN p_retailprice >= 950 THEN 'pass' ELSE 'fail' END WHEN 6 THEN CASE WHEN p_retailprice BETWEEN 900 AND 1000 THEN 'pass' ELSE 'fail' END WHEN 7 THEN 'unverifiable' WHEN 8 THEN 'unverifiable'
 ELSE CASE WHEN p_retailprice <= 950 THEN 'pass' ELSE 'fail' END END AS verdict FROM part""")
def price_gate(spark, sf_dir):
    """SC11: no budget, unknown and negative prices, bounds that make no sense, and the operators."""
    cases = [(0, None, None, None, None), (1, "lte", 950.0, None, None), (2, "lte", 950.0, None, None), (3, "lte", 0.0, None, None), (4, "lt", 950.0, None, None), (5, "gte", 950.0, None, None), (6, "between", None, 900.0, 1000.0), (7, "approximately", None, 1000.0, 900.0), (8, "eq", 950.0, None, None), (9, "lte", 950.0, None, None)]
    table = spark.createDataFrame(cases, "c int, operator string, value double, min double, max double")
    rows = read(spark, sf_dir, "part").withColumn("c", (F.col("p_partkey") % 10).cast("int")).join(F.broadcast(table), "c")  # ten rows
    want = F.when(F.col("operator").isNotNull(), F.struct("operator", "value", "min", "max"))
    price = F.when(F.col("c") == 1, F.lit(None)).when(F.col("c") == 2, -1.0).otherwise(F.col("p_retailprice"))
    return rows.select("p_partkey", scoring.price_gate(price, want).alias("verdict"))


@query("""SELECT p_partkey, round(CASE WHEN p_size > 10 THEN ((CASE WHEN p_size > 10 THEN 0.25 * (p_size / 50.0) ELSE 0 END) + 0.25 * (p_retailprice / 2000.0)) / 0.5 ELSE p_retailprice / 2000.0 END, 6) AS score FROM part""")
def active_dimensions(spark, sf_dir):
    """SC15."""
    dims = {"size": (F.col("p_size") / 50.0, 0.25, F.col("p_size") > 10), "price": (F.col("p_retailprice") / 2000.0, 0.25, F.lit(True))}
    return read(spark, sf_dir, "part").select("p_partkey", F.round(scoring.active_mean(dims), 6).alias("score"))


@query("""SELECT doc_id, list_filter([CASE WHEN n_chars < 200 THEN 'too_short' END, CASE WHEN lang IS NULL OR lang <> 'en' THEN 'not_english' END, CASE WHEN contains(text, '$') THEN 'symbols' END], lambda x: x IS NOT NULL) AS reasons FROM documents""")
def reason_codes(spark, sf_dir):
    """FLT4, FLT5, FLT6."""
    checks = {"too_short": F.col("n_chars") < 200, "not_english": F.col("lang") != "en", "symbols": F.contains("text", F.lit("$"))}
    return read(spark, sf_dir, "documents").select("doc_id", evaluate.reason_codes(checks).alias("reasons"))


# --- groups ---------------------------------------------------------------------------------------------


@query("""WITH g AS (SELECT user_id, bool_or(event_type = 'error' AND value > 300) AS u, bool_or(event_type = 'purchase') AS w, bool_or(event_type = 'error') AS i, max(value) - min(value) AS spread FROM events GROUP BY user_id)
SELECT user_id, round(spread, 6) AS spread, CASE WHEN u THEN 'forbidden_trajectory_in_group' WHEN NOT w THEN 'no_purchase_success' WHEN spread <= 150 THEN 'low_reward_variation' WHEN i THEN 'sampling_invalid' END AS drop_reason FROM g""")
def group_variation_filter(spark, sf_dir):
    """The group filter of §2.8."""
    rows = read(spark, sf_dir, "events").select("user_id", "value", (F.col("event_type") == "error").alias("bad"), ((F.col("event_type") == "error") & (F.col("value") > 300)).alias("unknown"), (F.col("event_type") == "purchase").alias("won"))
    return groups.group_verdicts(rows, "user_id", "value", "bad", "unknown", "won", 150.0, True).select("user_id", F.round("spread", 6).alias("spread"), "drop_reason")


_ADMISSION = """WITH a AS (SELECT user_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS attempt FROM events),
f AS (SELECT * FROM a WHERE attempt < 10 + user_id % 5 AND user_id % 11 <> 0 UNION ALL SELECT * FROM a WHERE attempt = 1 AND user_id % 13 = 0 AND user_id % 11 <> 0),
r AS (SELECT user_id, attempt // 4 AS round, count(*) AS n, count(DISTINCT attempt) AS d, bool_or(event_type = 'error') AS bad, max(value) - min(value) AS spread, stddev_pop(value) AS sd, count(*) FILTER (event_type IN ('purchase', 'click')) AS won FROM f GROUP BY ALL),
v AS (SELECT *, n = 4 AND d = 4 AND NOT bad AND spread > 80 AND round < 3 AS varied FROM r),
t AS (SELECT user_id, min(round) FILTER (varied AND won > 0) AS hit, coalesce(bool_or(varied AND won = 0), false) AS lost, count(*) AS rounds FROM v GROUP BY user_id)
SELECT u.user_id, CASE WHEN hit IS NOT NULL THEN 'accept' WHEN t.user_id IS NULL OR rounds < 3 THEN 'reprobe' ELSE 'reject' END AS decision,
 CASE WHEN t.user_id IS NULL THEN 'no_trajectories' WHEN hit IS NOT NULL THEN 'valid_reward_variation' WHEN lost AND rounds < 3 THEN 'no_gold_trajectory_yet' WHEN lost THEN 'three_attempts_without_gold_or_valid_purchase'
  WHEN rounds < 3 THEN 'attempt_invalid_or_low_reward_variation' ELSE 'three_attempts_without_valid_reward_variation' END AS reason,
 CASE WHEN hit IS NOT NULL THEN CASE WHEN v.won < 4 THEN 'frontier' ELSE 'regression_guard' END WHEN t.user_id IS NULL OR rounds < 3 THEN 'unresolved' ELSE 'quarantine' END AS probe_role, hit AS accepted_round, round(v.sd, 6) AS sd
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN t ON t.user_id = u.user_id LEFT JOIN v ON v.user_id = u.user_id AND v.round = t.hit"""


@query(_ADMISSION)
def admission_rounds(spark, sf_dir):
    """NUM23, JN7, admission of §2.8: events as attempts, some of them missing or doubled."""
    e = read(spark, sf_dir, "events")
    a = e.withColumn("attempt", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).filter("user_id % 11 <> 0")
    a = a.filter(F.col("attempt") < 10 + F.col("user_id") % 5).unionByName(a.filter("attempt = 1 and user_id % 13 = 0"))
    a = a.select("user_id", "attempt", "value", F.col("event_type").isin("purchase", "click").alias("won"), F.when(F.col("event_type") == "error", F.array(F.lit("error"))).alias("reasons"))
    out = groups.decide(e.select("user_id").distinct(), a, "user_id", attempt="attempt", utility="value", success="won", reasons="reasons", tolerance=80.0)
    return out.select("user_id", "decision", "reason", "probe_role", "accepted_round", F.round("sd", 6).alias("sd"))


# --- evaluation -----------------------------------------------------------------------------------------


@query("""WITH j AS (SELECT o.o_totalprice AS price, o.o_orderstatus AS status, c.c_mktsegment AS segment, n.n_name AS nation FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey)
SELECT dimension, value, count(*) AS n, count(*) FILTER (price > 200000) AS high, max(price) AS most FROM (
 SELECT 'status' AS dimension, status AS value, price FROM j UNION ALL SELECT 'segment', segment, price FROM j UNION ALL SELECT 'nation', nation, price FROM j) GROUP BY 1, 2""")
def summary_grouping_sets(spark, sf_dir):
    """AG2, AG4, AG5, AG15."""
    o, c, n = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    # nation is 25 rows by its definition
    j = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"))
    return evaluate.grouping_sets(j, ["status", "segment", "nation"], [F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("price") > 200000, 1)).alias("high"), F.max("price").alias("most")])


@query("""SELECT count(*) AS expected, count(l.doc_id) AS completed, count(*) FILTER (l.quality = 1) AS successes, round(count(*) FILTER (l.quality = 1) / count(*), 9) AS rate FROM documents d LEFT JOIN labels l USING (doc_id)""")
def fixed_denominator(spark, sf_dir):
    """AG1, AG3."""
    labels = read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("success"))
    return evaluate.fixed_rate(read(spark, sf_dir, "documents"), labels, "doc_id", "success").withColumn("rate", F.round("rate", 9))


def _runs(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    a = o.filter("o_orderkey % 2 = 0").select((F.col("o_orderkey") / 2).cast("long").alias("task"), "o_orderstatus", "o_totalprice")
    b = o.filter("o_orderkey % 2 = 1 and o_orderkey % 10 <> 1").select(F.floor(F.col("o_orderkey") / 2).alias("task"), "o_orderstatus", "o_totalprice")
    return a, b


_RUNS = """WITH a AS (SELECT o_orderkey // 2 AS task, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey // 2 AS task, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 10 <> 1)"""


@query(_RUNS + " SELECT coalesce(a.o_orderstatus, 'missing') AS from_kind, coalesce(b.o_orderstatus, 'missing') AS to_kind, count(*) AS n FROM a FULL JOIN b USING (task) GROUP BY 1, 2")
def transition_matrix(spark, sf_dir):
    """AG13, X28."""
    return evaluate.transitions(*_runs(spark, sf_dir), "task", "o_orderstatus")


@query(_RUNS + " SELECT count(*) AS n, count(*) FILTER (b.o_totalprice > a.o_totalprice) AS improved, count(*) FILTER (b.o_totalprice = a.o_totalprice) AS unchanged, count(*) FILTER (b.o_totalprice < a.o_totalprice) AS worsened, round(avg(b.o_totalprice - a.o_totalprice), 3) AS mean_delta FROM a JOIN b USING (task)")
def paired_deltas(spark, sf_dir):
    """AG12, JN5."""
    return evaluate.paired_deltas(*_runs(spark, sf_dir), "task", "o_totalprice").withColumn("mean_delta", F.round("mean_delta", 3))


@query("""WITH r AS (SELECT event_type AS label, CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS pos, user_id AS task, max(value) AS v FROM events WHERE event_type <> 'error' GROUP BY ALL)
SELECT a.label AS source, b.label AS target, count(*) AS n, count(*) FILTER (b.v > a.v) AS improved, count(*) FILTER (b.v < a.v) AS worsened FROM r a JOIN r b ON a.task = b.task AND a.pos < b.pos GROUP BY 1, 2""")
def all_run_pairs(spark, sf_dir):
    """JN6."""
    e = F.col("event_type")
    pos = F.when(e == "signup", 0).when(e == "view", 1).when(e == "click", 2).otherwise(3)
    runs = read(spark, sf_dir, "events").filter("event_type <> 'error'").groupBy(e.alias("label"), pos.alias("pos"), F.col("user_id").alias("task")).agg(F.max("value").alias("v"))
    return evaluate.all_pairs(runs, "label", "pos", "task", "v")


@query("""SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id""")
def tool_pivot(spark, sf_dir):
    """AG14, AG19."""
    out = read(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "error", "view"]).count()
    return out.fillna(0)


@query("""SELECT o.o_orderkey, CASE WHEN o.o_orderkey % 5 = 0 THEN 'X' ELSE o.o_orderstatus END AS o_orderstatus, o.o_totalprice FROM orders o""")
def overlay(spark, sf_dir):
    """JN12, X38."""
    base = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    over = base.filter("o_orderkey % 5 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"))
    return evaluate.overlay(base, over, "o_orderkey", ["o_orderstatus"])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'replaced' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def keyed_merge(spark, sf_dir):
    """JN13, JN14."""
    base = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return evaluate.keyed_merge(base, base.filter("o_orderkey % 7 = 0").withColumn("o_orderstatus", F.lit("replaced")), "o_orderkey")


@query("""WITH p AS (SELECT * FROM (VALUES ('en', 'min_share', 0.7), ('de', 'max_share', 0.1), ('fr', 'min_share', 0.1)) AS v(lang, kind, share)), c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), t AS (SELECT count(*) AS total FROM documents),
w AS (SELECT p.lang, kind, coalesce(n, 0) AS n, (CASE WHEN kind = 'min_share' THEN ceil(total * share - 1e-9) ELSE floor(total * share + 1e-9) END)::BIGINT AS wanted FROM p LEFT JOIN c USING (lang), t)
SELECT lang, kind, n, wanted, greatest(0, CASE WHEN kind = 'min_share' THEN wanted - n ELSE n - wanted END)::BIGINT AS gap FROM w""")
def share_audit(spark, sf_dir):
    """AG11."""
    policy = spark.sql("SELECT * FROM VALUES ('en', 'min_share', 0.7D), ('de', 'max_share', 0.1D), ('fr', 'min_share', 0.1D) AS t(lang, kind, share)")
    out = evaluate.share_audit(read(spark, sf_dir, "documents"), "lang", policy)
    return out.select("lang", "kind", "n", F.col("wanted").cast("long").alias("wanted"), F.col("gap").cast("long").alias("gap"))


@query("SELECT n_name, count(*) AS n, (SELECT count(*) FROM customer) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 10")
def category_frequency(spark, sf_dir):
    """AG20."""
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    out = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 10").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    return out.select("n_name", "n").crossJoin(F.broadcast(c.agg(F.count(F.lit(1)).alias("total"))))  # one row


@query("""WITH e AS (SELECT user_id * 1000000 + (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 3 AS t, event_id, event_type FROM events), s AS (SELECT t, string_agg(event_type, ',' ORDER BY event_id) AS seq FROM e GROUP BY t),
c AS (SELECT seq, count(*) AS n, min(t) AS first_seen FROM s GROUP BY seq), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, first_seen) AS place, sum(n) OVER () AS total, count(*) OVER () AS unique_sequences FROM c)
SELECT seq, n, first_seen, unique_sequences, round(n / total, 9) AS share FROM r WHERE place <= 10""")
def top_sequences(spark, sf_dir):
    """SM20, AG23: every event of a user in sessions of three; the ten most common whole sequences, ties by first seen."""
    w = W.partitionBy("user_id").orderBy("event_id")
    rows = read(spark, sf_dir, "events").withColumn("t", F.col("user_id") * 1000000 + F.floor((F.row_number().over(w) - 1) / 3))
    seq = rows.groupBy("t").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]), ",").alias("seq"))
    counts = seq.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_seen"))
    totals = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("unique_sequences"))  # one row
    top = counts.orderBy(F.desc("n"), "first_seen").limit(10).crossJoin(F.broadcast(totals))
    return top.select("seq", "n", "first_seen", "unique_sequences", F.round(F.col("n") / F.col("total"), 9).alias("share"))


@query("SELECT doc_id FROM labels WHERE toxic = 0 INTERSECT SELECT doc_id FROM documents WHERE lang = 'en'")
def id_intersection(spark, sf_dir):
    """SET1, SET2."""
    return read(spark, sf_dir, "labels").filter("toxic = 0").select("doc_id").intersect(read(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id"))
