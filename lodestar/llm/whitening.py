"""Whitening of embeddings by a one-sided Jacobi SVD.

The covariance matrix is never formed.  Every task compresses its centred rows, block by block, to
the triangle of a QR factorisation; triangles are stacked and factored again, ``FAN`` at a time,
until few are left (TSQR).  Plane rotations then make the columns of the last triangle orthogonal:
the accumulated rotations are the components, the lengths of the columns the standard deviations
(times the root of the number of rows), both as accurate as the data allow, as nothing is squared.

Entries become whole numbers first (``floor(SCALE * c) + SHIFT``), so sums and deviations are exact.
Rows whose vector is null, or holds null or non-finite entries, are dropped; so are vectors of
another length than most have (of two equally frequent lengths the smaller one counts) and empty
ones.  Components of no variance are left out: constant vectors, a single vector and an empty table
give no rows.  Ids may be null or repeat, every row gets its own result; equal eigenvalues may have
any basis of their space; other columns are ignored.  Entries of 2^28 / SCALE or more from the mean
raise an error, as sums would leave 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_limits, forget, stash

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Rows of a block, triangles factored together, and the part of the largest deviation below which there is none.
BLOCK, FAN, NOTHING = 2048, 32, 64 * np.finfo(float).eps
FAR = 1 << 28


def is_whole(vector: str) -> Column:
    """Neither null nor empty, and all entries are finite numbers."""
    v = F.col(vector)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad


def _entries(column: pa.Array) -> np.ndarray:
    """Whole numbers of a batch of vectors of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    c = np.floor(flat * float(SCALE))
    if len(c) and np.abs(c).max() >= 1 << 52:
        raise ValueError("an entry is too large for exact sums")
    return (c.astype(np.int64) + SHIFT).reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = None, 0
    for batch in batches:
        x = _entries(batch.column(0))
        if len(x):
            total, n = x.sum(0) + (0 if total is None else total), n + len(x)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total), pa.array(np.full(len(total), n))], ["i", "s", "n"])


class Centre:
    """Exact mean of whole vectors: ``low`` plus ``rest`` / ``n``."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.low = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def apart(self, x: np.ndarray) -> np.ndarray:
        a = x - self.low
        if len(a) and np.abs(a).max() >= FAR:
            raise ValueError("an entry is too far from the mean for exact deviations")
        return a

    def centred(self, a: np.ndarray) -> np.ndarray:
        return a - self.rest / self.n


def triangle(rows: np.ndarray) -> np.ndarray:
    """The square upper triangle R of a QR factorisation, with zeros below if rows are few."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))])


def _triangles(centre: Centre):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            rows = centre.centred(centre.apart(_entries(batch.column(0))))
            for k in range(0, len(rows), BLOCK):
                part = rows[k : k + BLOCK]
                r = triangle(part if r is None else np.vstack([r, part]))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()])], ["part", "r"])

    return run


def _stacked(rs: list[bytes], d: int) -> np.ndarray:
    return triangle(np.vstack([np.frombuffer(r).reshape(d, d) for r in rs]))


def tsqr(vectors: DataFrame, centre: Centre) -> np.ndarray:
    """R of all centred rows of ``vectors``, one column of vectors; the driver gets ``FAN`` triangles at most."""
    d = len(centre.low)
    now = stash(vectors.mapInArrow(_triangles(centre), "part long, r binary"), "triangles")
    while now.count() > FAN:

        def fold(g: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"part": g["part"].iloc[:1], "r": [_stacked(g.sort_values("part")["r"].tolist(), d).tobytes()]})

        group = F.floor(F.col("part") / FAN)
        last, now = now, stash(now.groupBy(group.alias("part_group")).applyInPandas(fold, "part long, r binary").withColumn("part", F.floor(F.col("part") / FAN).cast("long")), "triangles")
        forget(last)
    rs = [bytes(r.r) for r in now.orderBy("part").collect()]
    forget(now)
    return _stacked(rs, d)


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(column lengths, falling; rotations, a column each) that one-sided plane rotations give for the square ``r``.

    Pairs of columns that do not overlap turn together, in the rounds of a tournament."""
    d = r.shape[1]
    a, v = r.astype(float), np.eye(d)
    ring = list(range(d)) + [-1] * (d % 2)
    rounds = []
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        pairs = [(p, q) for p, q in zip(ring[:half], ring[::-1]) if p >= 0 and q >= 0]
        rounds.append(tuple(map(list, zip(*pairs))) if pairs else ([], []))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    eps = np.finfo(float).eps
    for _ in range(100):
        worst = 0.0
        for left, right in rounds:
            if not left:
                continue
            p, q = a[:, left], a[:, right]
            alpha, beta, gamma = (p * p).sum(0), (q * q).sum(0), (p * q).sum(0)
            size = np.sqrt(alpha) * np.sqrt(beta)
            skew = np.divide(np.abs(gamma), size, out=np.zeros_like(size), where=size > 0)
            worst = max(worst, skew.max())
            turn = skew > eps
            zeta = np.divide(beta - alpha, 2 * gamma, out=np.zeros_like(gamma), where=turn)
            t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            s = c * t
            for m in (a, v):
                p, q = m[:, left].copy(), m[:, right].copy()
                m[:, left], m[:, right] = c * p - s * q, s * p + c * q
        if worst <= 4 * eps:
            break
    lengths = np.sqrt((a * a).sum(0))
    order = np.argsort(-lengths, kind="stable")
    return lengths[order], v[:, order]


def _projected(centre: Centre, parts: np.ndarray, schema: pa.Schema):
    """Kept columns, and w1, w2 ..., and the sums of a^2 and of a * rest, whose exact combination is the deviation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = centre.apart(_entries(batch.column(batch.num_columns - 1)))
            w = centre.centred(a) @ parts
            # a * rest may pass 64 bits in a sum when rows are very many: two halves of 31 bits
            high, low = centre.rest >> 31, centre.rest & ((1 << 31) - 1)
            sums = [(a * a).sum(1), (a * high).sum(1), (a * low).sum(1)]
            arrays = [*batch.columns[:-1], *[pa.array(w[:, k]) for k in range(w.shape[1])], *map(pa.array, sums)]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(arrays, schema)], schema=schema)

    return run


def whiten(df: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",), components: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component: the kept columns, ``component``, ``n``, ``deviation`` (decimal, exact),
    ``whitened``, ``explained``, ``identity_error``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    rows = df.filter(is_whole(vector)).select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{vector}`").cast("array<double>").alias("__vector"))
    none = rows.select(*keep, *[F.lit(None).cast(t).alias(n) for n, t in (("component", "int"), ("n", "long"), ("deviation", "decimal(38,0)"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))]).limit(0)
    usual = rows.groupBy(F.size("__vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if usual is None:
        return none
    rows = rows.filter(F.size("__vector") == usual.d)
    with arrow_limits(spark):
        per = rows.select("__vector").mapInArrow(_sums, "i int, s long, n long")
        sums = per.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
        centre = Centre(sums[0].n, [int(r.s) for r in sums])
        lengths, turns = jacobi(tsqr(rows.select("__vector"), centre))
        k = min(components, int((lengths > max(NOTHING * usual.d * lengths[0], 0.0)).sum()))
        if not k:
            return none
        parts = turns[:, :k] * (np.sqrt(centre.n) / lengths[:k])
        names = [f"__w{i}" for i in range(k)]
        schema = ", ".join([f"`{c}` {t}" for c, t in rows.dtypes[:-1]] + [f"{x} double" for x in names] + [f"__{x} long" for x in ("aa", "ah", "al")])
        kind = to_arrow_schema(rows.select(*keep, *[F.lit(0.0).alias(x) for x in names], *[F.lit(0).cast("long").alias(f"__{x}") for x in ("aa", "ah", "al")]).schema)
        done = stash(rows.mapInArrow(_projected(centre, parts, kind), schema), "whitened")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cov = done.agg(*[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(cov[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    e = lengths**2
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    n, const = centre.n, sum(int(x) ** 2 for x in centre.rest.tolist())
    cross = (whole("__ah") * F.lit(Decimal(1 << 31)) + whole("__al")).cast("decimal(38,0)")
    exact = (whole("__aa") * F.lit(Decimal(n * n))).cast("decimal(38,0)") - (cross * F.lit(Decimal(2 * n))).cast("decimal(38,0)") + F.lit(Decimal(const))
    each = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("component"), F.col(names[i]).alias("whitened"), F.lit(float(e[i] / e.sum())).alias("explained")) for i in range(k)]))
    return done.select(*keep, each.alias("__c"), exact.cast("decimal(38,0)").alias("deviation")).select(
        *keep, "__c.component", F.lit(n).cast("long").alias("n"), "deviation", "__c.whitened", "__c.explained", F.lit(float(error)).alias("identity_error")
    )


def op11_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every usable vector.  Nulls, odd lengths, ties, repeated rows, an empty
    table and other columns as in the module's text; vectors of any length are taken whole."""
    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))
