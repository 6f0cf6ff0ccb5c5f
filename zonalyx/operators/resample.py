"""Resampling of any number of rows: bootstrap intervals and permutation nulls.

All chance comes from hashes of the seed, the replicate and the row's key, so that a
run repeats and SQL can repeat it. A row's number is 31 bits of MD5(key); replicate r
turns it into (a * number + b) mod P with two numbers of its own.

Bootstrap: a row counts Poisson(1) times in a replicate, as it does when a table of
any size is drawn from with replacement. Tasks add up the weighted sums of all
replicates while they read; what leaves a task is a few numbers a replicate.

Permutation: rows are numbered 0 to n - 1; in replicate r row i meets the y of row
pi(i), where pi is a keyed Feistel network on the smallest square that holds n, walked
until it falls below n again: a bijection that needs no sort. Only the sum of products
changes between replicates. Values of y up to BROADCAST_ROWS go to all tasks; beyond
that, rows of all replicates are joined by number.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalyx.operators.ship import ship
from zonalyx.operators.store import dense_id, keep

P = (1 << 31) - 1
#: Numbers sent to all tasks at most, eight bytes each.
BROADCAST_ROWS = 1 << 21
ROUNDS = 6
#: Cells of a matrix of rows by replicates.
CELLS = 1 << 20


def md5_number(text: str) -> int:
    """31 bits of MD5, below P."""
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % P


def draws(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The two numbers of each replicate; the first is not 0."""
    a = np.array([1 + md5_number(f"{seed}:{r}:a") % (P - 1) for r in range(n)], np.int64)
    return a, np.array([md5_number(f"{seed}:{r}:b") for r in range(n)], np.int64)


def poisson_steps() -> list[int]:
    """A 16-bit number at or above k of these steps counts k times: Poisson(1) to 1/65536."""
    steps, total = [], 0.0
    for k in range(12):
        total += math.exp(-1) / math.factorial(k)
        steps.append(round(total * (1 << 16)))
    return [s for s in steps if s < 1 << 16]


def _number(key: str):
    return (F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % P).alias("__h")


def bootstrap_sums(df: DataFrame, key: str, columns: list[str], n: int, seed: int) -> DataFrame:
    """replicate, column, weight, total: of the rows where column is finite, the sums of weights and of weighted values."""
    ship(df.sparkSession)
    steps = np.array(poisson_steps())
    weights = np.searchsorted(steps, np.arange(1 << 16), side="right").astype(np.float64)
    a, b = draws(seed, n)
    names = [f"v{k}" for k in range(len(columns))]
    rows = df.select(_number(key), *[F.col(c).cast("double").alias(m) for c, m in zip(columns, names, strict=True)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, total = np.zeros((len(names), n)), np.zeros((len(names), n))
        step = max(1, CELLS // max(1, n))
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False)
            values = [batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(len(names))]
            for start in range(0, len(h), step):
                w = weights[((h[start : start + step, None] * a + b) % P) >> 15]
                for k, v in enumerate(values):
                    v = v[start : start + step]
                    fine = np.isfinite(v)
                    if not fine.all():
                        weight[k] += w[fine].sum(0)
                        total[k] += v[fine] @ w[fine]
                    else:
                        weight[k] += w.sum(0)
                        total[k] += v @ w
        at, r = np.divmod(np.arange(len(names) * n), max(1, n))
        yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(at), pa.array(weight.ravel()), pa.array(total.ravel())], ["replicate", "at", "weight", "total"])

    parts = rows.mapInArrow(add, "replicate long, at long, weight double, total double")
    named = F.element_at(F.array(*[F.lit(c) for c in columns]), (F.col("at") + 1).cast("int")).alias("column")
    return parts.groupBy("replicate", "at").agg(F.sum("weight").alias("weight"), F.sum("total").alias("total")).select("replicate", named, "weight", "total")


def bootstrap_means(df: DataFrame, key: str, columns: list[str], n: int = 200, seed: int = 42) -> DataFrame:
    """column, replicates, mean, deviation, low, middle and high (2.5, 50 and 97.5 percent) of each column's mean under n resamplings.

    key tells rows apart; rows that repeat it are drawn together. Null, NaN and infinite
    values are left out. A replicate that draws no row has no mean and does not count.
    """
    means = bootstrap_sums(df, key, columns, n, seed).select("column", F.try_divide("total", "weight").alias("m"))
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    g = means.groupBy("column").agg(F.count("m").alias("replicates"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("deviation"), q.alias("q"))
    every = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("column"))
    g = every.join(g, "column", "left").withColumn("replicates", F.coalesce("replicates", F.lit(0)))
    return g.select("column", "replicates", "mean", "deviation", F.col("q")[0].alias("low"), F.col("q")[1].alias("middle"), F.col("q")[2].alias("high"))


def feistel_keys(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The two numbers of each replicate and round."""
    number = lambda r, k, x: md5_number(f"{seed}:{r}:{k}:{x}")
    a = np.array([[1 + number(r, k, "a") % (P - 1) for k in range(ROUNDS)] for r in range(n)], np.int64).reshape(n, ROUNDS)
    return a, np.array([[number(r, k, "b") for k in range(ROUNDS)] for r in range(n)], np.int64).reshape(n, ROUNDS)


def permuted(i: np.ndarray, size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """pi(i) for every i (below size) and every replicate, a column each."""
    side = math.isqrt(max(size, 1) - 1) + 1
    x = np.repeat(i[:, None], len(a), 1)
    todo = np.ones(x.shape, bool)
    while todo.any():
        where = np.nonzero(todo)
        left, right = np.divmod(x[where], side)
        for k in range(ROUNDS):
            left, right = right, (left + ((a[where[1], k] * right + b[where[1], k]) % P) % side) % side
        x[where] = left * side + right
        todo = x >= size
    return x


def permutation_null(df: DataFrame, key: str, x: str, targets: list[str], n: int = 200, seed: int = 42) -> DataFrame:
    """target, observed, p_value, p_greater, exceed, permutations, null_mean, null_deviation, low, middle and high of Pearson's r under n permutations.

    x is permuted against each target; rows are numbered by key, which tells them apart.
    A target uses the rows where x and it are finite. p_value is (exceed + 1) / (n + 1),
    where exceed counts replicates with an absolute r not below the observed one's, and
    p_greater the same with signs. Without two distinct values on both sides all is NULL.
    """
    spark = ship(df.sparkSession)
    a, b = feistel_keys(seed, n)
    parts = []
    for target in targets:
        u, v = F.col(x).cast("double"), F.col(target).cast("double")
        fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
        rows = keep(dense_id(df.where(fine(u) & fine(v)).select(F.col(key).alias("__k"), u.alias("x"), v.alias("y")), "i", "__k").select("i", "x", "y"), "permute")
        s = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"), F.covar_pop("x", "y").alias("c")).first()
        if s.n and s.sx and s.sy:
            centred = rows.select("i", (F.col("x") - s.mx).alias("x"), (F.col("y") - s.my).alias("y"))
            sums = _products(centred, s.n, n, a, b)
            r = sums.select((F.col("xy") / (s.n * s.sx * s.sy)).alias("r"))
        else:
            r = spark.createDataFrame([], "r double")
        seen = s.c / (s.sx * s.sy) if s.n and s.sx and s.sy else None
        near = F.lit(1e-12)  # the observed order itself is one of the permutations
        q = F.percentile("r", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
        known = F.lit(seen).cast("double")
        exceed, above = F.count_if(F.abs("r") >= F.abs(known) - near), F.count_if(F.col("r") >= known - near)
        total = F.count("r")
        p = lambda c: F.when(known.isNotNull(), (c + 1) / (total + 1))
        parts.append(r.agg(p(exceed).alias("p_value"), p(above).alias("p_greater"), exceed.alias("exceed"), total.alias("permutations"), F.avg("r").alias("null_mean"), F.stddev_samp("r").alias("null_deviation"), q.alias("q")).select(
            F.lit(target).alias("target"), known.alias("observed"), "p_value", "p_greater", "exceed", "permutations", "null_mean", "null_deviation", F.col("q")[0].alias("low"), F.col("q")[1].alias("middle"), F.col("q")[2].alias("high")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _products(rows: DataFrame, size: int, n: int, a: np.ndarray, b: np.ndarray) -> DataFrame:
    """replicate, xy: the sum of x of row i times y of row pi(i)."""
    step = max(1, CELLS // max(1, n))
    if size <= BROADCAST_ROWS:
        held = np.zeros(size)
        table = rows.select("i", "y").toArrow()
        held[table.column("i").to_numpy()] = table.column("y").to_numpy()
        sent = rows.sparkSession.sparkContext.broadcast(held)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, y = np.zeros(n), sent.value
            for batch in batches:
                i, x = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                for start in range(0, len(i), step):
                    total += x[start : start + step] @ y[permuted(i[start : start + step], size, a, b)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(total)], ["replicate", "xy"])

        parts = rows.select("i", "x").mapInArrow(add, "replicate long, xy double")
        return parts.groupBy("replicate").agg(F.sum("xy").alias("xy"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, x = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for start in range(0, len(i), step):
                j = permuted(i[start : start + step], size, a, b)
                r = np.broadcast_to(np.arange(n), j.shape)
                yield pa.RecordBatch.from_arrays([pa.array(r.ravel()), pa.array(j.ravel()), pa.array(np.repeat(x[start : start + step], n))], ["replicate", "i", "x"])

    met = rows.select("i", "x").mapInArrow(send, "replicate long, i long, x double").join(rows.select("i", "y"), "i")
    return met.groupBy("replicate").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
