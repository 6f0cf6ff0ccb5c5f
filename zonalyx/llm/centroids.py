"""Centroid clustering in whole numbers by delta Lloyd rounds.

What a round leaves is written: each vector with its owner and squared distance.
The sums and counts of the k clusters, k times dim integers, stay with the driver.
The next round sends the centroids and says which of them changed. A vector whose
owner is unchanged compares its known distance with the changed centroids alone;
one whose owner moved compares all. Vectors that went to another owner are summed
in the tasks as signed transfers, minus for the old and plus for the new owner, and
added to the kept sums; no vector that stays is summed again.

All arithmetic is exact: squares are summed in float64 only while every sum stays
below 2^53, else in int64.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonalyx.llm.arrow import ship
from zonalyx.llm.store import discard, keep

#: Up to this size float64 holds all sums of squares of MAX_DIM components.
FLOAT_COMPONENT = 1 << 20
MAX_DIM = 1 << 8
#: Numbers in a matrix of distances at most.
CELLS = 1 << 20


@dataclass
class Clusters:
    """assigned: id, v, was, owner, distance (written); centroids: integers; counts: members when the centroids were last set."""

    assigned: DataFrame
    centroids: list[tuple[int, ...]]
    counts: list[int]


def max_component(dim: int) -> int:
    """Components up to this size keep squared distances inside 64 bits."""
    return min(1 << 30, math.isqrt(((1 << 63) - 1) // dim) // 2)


def whole_vectors(df: DataFrame, dim: int, scale: float, vector_col: str, id_col: str) -> DataFrame:
    """id, v of the rows whose vector has dim components, none null or non-finite; v holds floor(scale * component)."""
    x = F.col("x")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"))
    rows = rows.where((F.size(x) == dim) & F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(c)))
    most = max_component(dim)
    far = F.exists(x, lambda c: F.abs(c * float(scale)) > most)
    v = F.when(far, F.raise_error(F.lit(f"a component is beyond {most}")).cast("array<int>"))
    return rows.select("id", v.otherwise(F.transform(x, lambda c: F.floor(c * float(scale)).cast("int"))).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[tuple[int, ...]]:
    """The k vectors with the smallest SHA-256 of "seed:id", in that order; equal ids by their components. A null id counts as empty."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return [tuple(r.v) for r in vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    fits = dim <= MAX_DIM and (not flat.size or max(-int(flat.min()), int(flat.max())) <= FLOAT_COMPONENT)
    return flat.astype(np.float64 if fits else np.int64)


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to rows, in the type of x."""
    if x.dtype == np.float64 and np.abs(centroids).max() <= FLOAT_COMPONENT:
        c = centroids.astype(np.float64)
        return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
    out = np.empty((len(x), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        gap = x.astype(np.int64) - c
        out[:, j] = (gap * gap).sum(1)
    return out


def nearest(x: np.ndarray, centroids: np.ndarray, changed: np.ndarray, owner: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New owners and distances; owner -1 has none yet. Of equal distances the smaller number wins."""
    owner, distance = owner.copy(), distance.copy()
    all_of_them = (owner < 0) | changed[np.maximum(owner, 0)]
    if all_of_them.any():
        d = _distances(x[all_of_them], centroids)
        best = d.argmin(1)
        owner[all_of_them], distance[all_of_them] = best, d[np.arange(len(d)), best].astype(np.int64)
    some = np.flatnonzero(changed)
    rest = np.flatnonzero(~all_of_them)
    if len(some) and len(rest):
        d = _distances(x[rest], centroids[some])
        at = d.argmin(1)
        best, least = some[at], d[np.arange(len(d)), at].astype(np.int64)
        wins = (least < distance[rest]) | ((least == distance[rest]) & (best < owner[rest]))
        owner[rest[wins]], distance[rest[wins]] = best[wins], least[wins]
    return owner, distance


def _assign(table: DataFrame, dim: int, centroids: list[tuple[int, ...]], changed: list[bool], first: bool) -> DataFrame:
    """id, v, was, owner, distance: every vector with the owner it had and the one it has now."""
    sent, news = np.array(centroids, np.int64).reshape(-1, dim), np.array(changed)
    rows = max(1, CELLS // (dim + len(centroids)))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                n = batch.num_rows
                was = np.full(n, -1, np.int64) if first else batch.column("owner").to_numpy(zero_copy_only=False).astype(np.int64)
                had = np.zeros(n, np.int64) if first else batch.column("distance").to_numpy(zero_copy_only=False)
                owner, distance = nearest(_matrix(batch.column("v"), dim), sent, news, was, had)
                columns = [batch.column("id"), batch.column("v"), pa.array(was.astype(np.int32)), pa.array(owner.astype(np.int32)), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "v", "was", "owner", "distance"])

    kinds = [("v", T.ArrayType(T.IntegerType())), ("was", T.IntegerType()), ("owner", T.IntegerType()), ("distance", T.LongType())]
    schema = T.StructType([table.schema["id"], *[T.StructField(n, t) for n, t in kinds]])
    return table.select("id", "v", *([] if first else ["owner", "distance"])).mapInArrow(step, schema)


def _transfers(assigned: DataFrame, dim: int, k: int) -> list[tuple[int, int, int]]:
    """(cluster, place, change) of sums and, at place dim, of counts; summed over the vectors that went to another owner."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = np.zeros((k, dim + 1), np.int64)
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            for name, sign in (("was", -1), ("owner", 1)):
                at = batch.column(name).to_numpy(zero_copy_only=False)
                for j in np.unique(at[at >= 0]):
                    own = at == j
                    change[j, :dim] += sign * v[own].sum(0, dtype=np.int64)
                    change[j, dim] += sign * int(own.sum())
        at = np.argwhere(change)
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0].astype(np.int32)), pa.array(at[:, 1].astype(np.int32)), pa.array(change[at[:, 0], at[:, 1]])], ["cluster", "place", "change"])

    went = assigned.where("was <> owner").select("v", "was", "owner").mapInArrow(total, "cluster int, place int, change long")
    got = went.groupBy("cluster", "place").agg(F.sum(F.col("change").cast("decimal(38,0)")).alias("change")).collect()
    return [(r.cluster, r.place, int(r.change)) for r in got]


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64.0, seed: int = 1, vector_col: str = "embedding", id_col: str = "vec_id") -> Clusters:
    """Lloyd's rounds from k hashed starting vectors, then one more assignment.

    Rows whose vector is null, has another length or a component that is null, NaN
    or infinite are left out; a component beyond max_component(dim) after scaling raises an error.
    Null and repeated ids are vectors like any other. Fewer than k vectors make
    fewer clusters, none make none. An empty cluster keeps its centroid. Equal
    distances go to the smaller number. Other columns are ignored. The state is one
    table the size of the vectors, rewritten without a shuffle in each round.
    """
    ship(df.sparkSession)
    table = keep(whole_vectors(df, dim, scale, vector_col, id_col), "vectors")
    centroids = first_centroids(table, k, seed)
    if not centroids:
        empty = table.select("id", "v", *[F.lit(None).cast(t).alias(c) for c, t in (("was", "int"), ("owner", "int"), ("distance", "long"))])
        return Clusters(empty, [], [])
    sums, counts = [[0] * dim for _ in centroids], [0] * len(centroids)
    changed, first = [True] * len(centroids), True
    for last in [False] * rounds + [True]:
        now = keep(_assign(table, dim, centroids, changed, first), "assigned")
        discard(table)
        table, first = now, False
        if last:
            break
        for j, place, change in _transfers(table, dim, len(centroids)):
            if place == dim:
                counts[j] += change
            else:
                sums[j][place] += change
        new = [tuple(s // n for s in total) if n else old for total, n, old in zip(sums, counts, centroids, strict=True)]
        changed, centroids = [a != b for a, b in zip(new, centroids, strict=True)], new
    return Clusters(table, centroids, counts)


def digest(found: Clusters) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector; inertia is the sum of distances."""
    rows = found.assigned
    if not found.centroids:
        return rows.selectExpr("id", "owner AS cluster", "distance", "distance AS cluster_inertia", "distance AS inertia", "CAST(NULL AS string) AS centroid_sha256")
    held = {r.owner: int(r.d) for r in rows.groupBy("owner").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    of = lambda values: F.element_at(F.array(*values), F.col("owner") + 1)
    return rows.select(
        "id",
        F.col("owner").alias("cluster"),
        "distance",
        of([F.lit(held.get(j, 0)).cast("long") for j in range(len(shas))]).alias("cluster_inertia"),
        F.lit(sum(held.values())).cast("long").alias("inertia"),
        of([F.lit(s) for s in shas]).alias("centroid_sha256"),
    )
