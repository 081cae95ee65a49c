"""Queries over selections with owners, running counters and changing costs, with their SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import balance, frontier, ownership, turns
from .catalog import query, read

#: The order in which strategies own a task; the last one takes what is left.
STRATEGIES = ["2-HIGH", "1-URGENT", "4-NOT SPECIFIED", "3-MEDIUM", "5-LOW"]


@query("""WITH c AS (SELECT o_custkey AS task_id, o_orderpriority AS strategy, list_position(['2-HIGH', '1-URGENT', '4-NOT SPECIFIED', '3-MEDIUM', '5-LOW'], o_orderpriority) AS pos,
  o_orderstatus = 'P' AND o_orderkey % 16 = 0 AS must, o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 16 = 0 THEN -100 WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END AS priority
  FROM orders WHERE o_custkey IS NOT NULL),
b AS (SELECT *, max(CASE WHEN must THEN pos END) OVER t AS required, min(pos) OVER t AS first FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY task_id, strategy ORDER BY priority, o_totalprice DESC, o_orderkey) = 1) WINDOW t AS (PARTITION BY task_id)),
o AS (SELECT *, ['2-HIGH', '1-URGENT', '4-NOT SPECIFIED', '3-MEDIUM', '5-LOW'][coalesce(required, first)] AS owner FROM b)
SELECT task_id, strategy, owner, o_orderkey, strategy = owner AS kept, CASE WHEN strategy <> owner THEN CASE WHEN required IS NULL THEN 'owned_by_' ELSE 'required_existing_owned_by_' END || owner END AS reason FROM o""")
def claim_owners(spark, sf_dir):
    """SM15: orders as claims of their priority on their customer."""
    must, status = (F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 16 == 0), F.col("o_orderstatus")
    priority = F.when(must, -100).when(status == "F", 0).when(status == "O", 1).otherwise(2)
    claims = read(spark, sf_dir, "orders").withColumns({"task_id": F.col("o_custkey"), "strategy": F.col("o_orderpriority")})
    return ownership.owned_claims(claims, STRATEGIES, [priority, -F.col("o_totalprice"), F.col("o_orderkey")], must, ["o_orderkey"])


def _stage(n: int, source: str, fits: str, size: str) -> str:
    """The next stage of picks by least use: rows of ``source`` that fit, in the order of their turns."""
    return f"""u{n} AS (SELECT *, count(stage) OVER (PARTITION BY value) AS used FROM {source}),
t{n} AS (SELECT *, used + row_number() OVER (PARTITION BY value, stage IS NULL AND {fits} ORDER BY o_totalprice DESC, o_orderkey) AS turn FROM u{n}),
g{n} AS (SELECT *, row_number() OVER (PARTITION BY stage IS NULL AND {fits} ORDER BY turn, o_totalprice DESC, o_orderkey) AS pos FROM t{n}),
s{n} AS (SELECT o_orderkey, o_totalprice, value, bucket, CASE WHEN stage IS NULL AND {fits} AND pos <= {size} THEN {n} ELSE stage END AS stage FROM g{n})"""


_EVEN = ",\n".join([
    "WITH s0 AS (SELECT o_orderkey, o_totalprice, year(o_orderdate::DATE) || o_orderstatus AS value, o_orderpriority AS bucket, CASE WHEN o_orderkey < 40 THEN 0 END AS stage FROM orders)",
    _stage(1, "s0", "bucket = '1-URGENT'", "120 - (SELECT count(*) FROM s0 WHERE stage = 0 AND bucket = '1-URGENT')"),
    _stage(2, "s1", "bucket = '5-LOW'", "100 - (SELECT count(*) FROM s0 WHERE stage = 0 AND bucket = '5-LOW')"),
    _stage(3, "s2", "true", "400 - (SELECT count(stage) FROM s2)"),
])


@query(_EVEN + " SELECT o_orderkey, value, bucket, stage::INTEGER AS stage FROM s3 WHERE stage IS NOT NULL")
def even_fill(spark, sf_dir):
    """SM15: the least used year and status first, with minimums for two priorities, beside 40 orders taken before."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.concat(F.year(F.to_date("o_orderdate")).cast("string"), "o_orderstatus").alias("value"), F.col("o_orderpriority").alias("bucket"))
    order = {"price": -F.col("o_totalprice"), "id": F.col("o_orderkey")}
    return ownership.even_fill(orders, F.col("o_orderkey") < 40, "value", "bucket", order, 400, {"1-URGENT": 120, "5-LOW": 100}).drop("o_totalprice")


# Wanted counts of the evaluation set and of its challenge slices, windows and quotas.
DIFFICULTY = {"under_10": 48, "10_15": 138, "15_18": 44, "18_plus": 10}
RETRIEVAL = {"rank1": 144, "rank2_5": 60, "rank6_20": 24, "rank21_150": 10, "missing": 2}
CHALLENGE_DIFFICULTY = {"under_10": 2, "10_15": 32, "15_18": 22, "18_plus": 4}
CHALLENGE_RETRIEVAL = {"rank1": 36, "rank2_5": 15, "rank6_20": 6, "rank21_150": 2, "missing": 1}
CHALLENGE_WINDOWS = [(0.30, 0.45, 1), (0.45, 0.60, 2), (0.60, 0.75, 3), (0.75, 0.90, 3), (0.90, 0.98, 1)]
CORE_QUOTAS = [4, 10, 6]
CORE_TARGETS = [9.5, 12.5, 15.5]
BALANCES = (
    frontier.Balance("difficulty_bucket", DIFFICULTY, 12, 100), frontier.Balance("retrieval_bucket", RETRIEVAL, 8, 80),
    frontier.Balance("difficulty_bucket", CHALLENGE_DIFFICULTY, 10, 40, "slice"), frontier.Balance("retrieval_bucket", CHALLENGE_RETRIEVAL, 8, 32, "slice"),
)
SEED = "evaluation"


def tasks(spark, sf_dir):
    """Orders as tasks: a difficulty from the price, a retrieval bucket from the key, a family a customer and status."""
    key, score = F.pmod(F.crc32(F.col("o_orderkey").cast("string")), F.lit(100)), F.round(7 + F.col("o_totalprice") / 40_000, 6)
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("long").alias("id"), F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderstatus").alias("family"), F.col("o_orderpriority").alias("domain"), score.alias("score"),
        F.when(score < 10, "under_10").when(score < 15, "10_15").when(score < 18, "15_18").otherwise("18_plus").alias("difficulty_bucket"),
        F.when(key < 50, "rank1").when(key < 72, "rank2_5").when(key < 88, "rank6_20").when(key < 97, "rank21_150").otherwise("missing").alias("retrieval_bucket"),
    )


def _fixed(weight, extreme, missing, far, target):
    score, bucket = F.col("score"), F.col("retrieval_bucket")
    factors = (score >= 18).cast("int") + bucket.isin("rank21_150", "missing").cast("int")
    return weight * F.abs(score - target) + 5 * factors + F.when(score >= 21, extreme).otherwise(0) + F.when(bucket == "missing", missing).when(bucket == "rank21_150", far).otherwise(0)


def select(df) -> frontier.Picks:
    """Two challenge slices, then the core of every domain in order of name."""
    picks = frontier.Picks(BALANCES)
    for name, fits, severity, target in (("long_horizon", F.col("score") >= 9, F.col("score"), 17.0), ("late_ids", F.col("domain") != "5-LOW", F.col("id"), 14.5)):
        frontier.pick_slice(df.filter(fits), picks, name, severity, _fixed(1.5, 40, 12, 5, target), CHALLENGE_WINDOWS, SEED)
    for domain in sorted(STRATEGIES):
        frontier.pick_core(df.filter(F.col("domain") == domain), picks, domain, F.col("score"), lambda i: _fixed(1, 50, 20, 6, CORE_TARGETS[i]), CORE_QUOTAS, SEED)
    return picks


@query()
def evaluation_tasks(spark, sf_dir):
    """SM8, SM9: no SQL, as every pick changes the costs of the next; the tests hold it against the plain greedy."""
    return select(tasks(spark, sf_dir)).frame(spark)


# Quotas of strategies, uses of one sequence, of long sequences.
CORRECTIVE = dict(zip(STRATEGIES, (52, 64, 32, 12)))
SEQUENCE_CAP, LONG_CAP = 40, 100
#: Turns of the strategies, one of them twice as often.
CYCLE = ["dear", "early", "dear", "open"]


def sequences(spark, sf_dir):
    """Orders with the month and status as their sequence; one in eight of these is long."""
    orders = read(spark, sf_dir, "orders").withColumn("value", F.concat(F.substring(F.to_date("o_orderdate").cast("string"), 1, 7), "o_orderstatus"))
    return orders.withColumn("long", F.pmod(F.crc32("value"), F.lit(8)) == 0)


@query()
def corrective_turns(spark, sf_dir):
    """SM11: no SQL, as each pick changes what the next costs; the tests hold its operator against the plain greedy."""
    df = sequences(spark, sf_dir).select(F.col("o_orderpriority").alias("queue"), "value", F.col("o_orderkey").cast("long").alias("id"), "long", "o_totalprice")
    order = [F.col("long"), F.pmod(F.crc32(F.col("id").cast("string")), F.lit(2)) == 0, -F.col("o_totalprice")]
    total = sum(CORRECTIVE.values())
    picks = turns.take_turns(turns.reachable(df, order, CORRECTIVE, total, F.col("long")), list(CORRECTIVE), CORRECTIVE, total, SEQUENCE_CAP, LONG_CAP, strict=True)
    return spark.createDataFrame([(n, q, r["id"], r["value"]) for n, (q, r) in enumerate(picks, 1)], "position long, queue string, id long, value string")


@query()
def strategy_rounds(spark, sf_dir):
    """SM6: three strategies take turns, each by its own order, and no customer comes twice."""
    orders, price = read(spark, sf_dir, "orders"), F.col("o_totalprice")
    ways = {"dear": (price > 100_000, -price), "early": (F.col("o_orderpriority") != "5-LOW", F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01")).cast("double")), "open": (F.col("o_orderstatus") == "O", price)}
    each = F.array_compact(F.array(*[F.when(fits, F.struct(F.lit(q).alias("queue"), rank.alias("rank"))) for q, (fits, rank) in ways.items()]))
    df = orders.select(F.col("o_custkey").cast("string").alias("value"), F.col("o_orderkey").cast("long").alias("id"), F.explode(each).alias("e")).filter("value IS NOT NULL").select("value", "id", "e.*")
    quotas = dict.fromkeys(ways, 80)
    picks = turns.take_turns(turns.reachable(df, [F.col("rank")], quotas, 80), CYCLE, quotas, 80, 1)
    return spark.createDataFrame([(n, q, r["id"], r["value"]) for n, (q, r) in enumerate(picks, 1)], "position long, queue string, id long, value string")


#: Quotas of roles and bands, and the share of the plan that one domain may hold.
ROLES = {"main": {"1-URGENT": 20, "3-MEDIUM": 25}, "reserve": {"1-URGENT": 10, "5-LOW": 15}}
DOMAIN_CAP = 14


@query()
def role_plan(spark, sf_dir):
    """SM16: the status of an order as its strategy, its year as its domain."""
    df = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_orderpriority").alias("band"), F.col("o_orderstatus").alias("strategy"), F.year(F.to_date("o_orderdate")).cast("string").alias("domain"))
    picks = frontier.pick_roles(df, ROLES, DOMAIN_CAP, SEED)
    return spark.createDataFrame([(n, role, band, r["id"], r["strategy"], r["domain"]) for n, (role, band, r) in enumerate(picks, 1)], "position long, role string, band string, id long, strategy string, domain string")


def _cells(prefix: str) -> list[tuple[str, int]]:
    return [(f"{prefix}{s}", n) for s, n in (("F", 30), ("O", 20), ("P", 12))]


CELLS = [*_cells("1-URGENT|"), *_cells("5-LOW|")]
_CELLS = ",\n".join([
    "WITH o AS (SELECT o_orderkey, o_totalprice, left(o_orderdate::VARCHAR, 7) || o_orderstatus AS value, o_orderpriority || '|' || o_orderstatus AS bucket, CASE WHEN o_orderkey < 40 THEN 0 END AS stage FROM orders), s0 AS (SELECT * FROM o)",
    *[_stage(n, f"s{n - 1}", f"bucket = '{c}'", str(size)) for n, (c, size) in enumerate(CELLS, 1)],
])


@query(_CELLS + " SELECT o_orderkey, value, bucket, stage::INTEGER AS stage FROM s6 WHERE stage > 0")
def cell_fill(spark, sf_dir):
    """SM14: cells of priority and status, beside 40 orders taken before (caps wide enough for SQL without them; the tests bind them)."""
    df = sequences(spark, sf_dir).withColumn("bucket", F.concat_ws("|", "o_orderpriority", "o_orderstatus"))
    order = {"price": -F.col("o_totalprice"), "id": F.col("o_orderkey")}
    picks = ownership.fill_cells(df.filter("o_orderkey >= 40"), df.filter("o_orderkey < 40"), "value", "bucket", order, CELLS, 60, "long", 150)
    return picks.select("o_orderkey", "value", "bucket", "stage")


LENGTHS = {"short": 30, "medium": 24, "long": 16}


def length_inputs(spark, sf_dir):
    """Customers as the base set, orders as what arrives."""
    base = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id"), F.when(F.col("c_acctbal") < 7000, "short").when(F.col("c_acctbal") < 9500, "medium").otherwise("long").alias("bucket"))
    price = F.col("o_totalprice")
    new = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("task_id"), F.when(price < 150_000, "short").when(price < 300_000, "medium").otherwise("long").alias("bucket"), F.col("o_orderkey").alias("pos"),
        (F.col("o_orderstatus") != "P").alias("accepted"), (F.col("o_custkey") % 10 == 0).alias("held_out"),
    )
    return base, new


@query()
def length_balanced(spark, sf_dir):
    """SM5: no SQL, as rows are taken in order of arrival; the tests hold it against the plain loop."""
    return balance.length_balance(*length_inputs(spark, sf_dir), LENGTHS, SEED, 0.1)


def _tagged(df):
    """Tasks with their feature tags and a retrieval rank."""
    key = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(100))
    flags = {"hard": F.col("score") >= 12, "far": key >= 72, "even": F.col("id") % 2 == 0}
    return df.withColumn("tags", F.array_compact(F.array(*[F.when(c, t) for t, c in flags.items()]))).withColumn("rank", F.when(key < 97, key))


def replaced(df, first: int):
    tagged = _tagged(df)
    far = lambda c: F.coalesce(F.col(f"{c}.rank"), F.lit(999))
    apart = lambda o, c: F.size(F.array_except(f"{o}.tags", f"{c}.tags")) + F.size(F.array_except(f"{c}.tags", f"{o}.tags"))
    costs = lambda o, c: [apart(o, c), F.abs(F.col(f"{o}.score") - F.col(f"{c}.score")), F.abs(far(o) - far(c))]
    old, rest = tagged.filter(F.col("id") < first).withColumn("at", F.col("id")), tagged.filter(F.col("id") >= first)
    return frontier.replacements(old, rest, ["domain", "difficulty_bucket"], costs, lambda o, c: (F.col(f"{o}.score") < 14) | (F.col(f"{c}.score") >= 9), old.select("family"), SEED)


@query()
def replaced_tasks(spark, sf_dir):
    """JN18, X44: the first 40 orders give way to the nearest of all others; no SQL, as no candidate serves twice."""
    return spark.createDataFrame(replaced(tasks(spark, sf_dir), 40), "old long, new long")
