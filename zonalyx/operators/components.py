"""Connected components of an edge table, by alternating large and small stars.

Each round rewires the edges around the smallest neighbour; no node's neighbours
are gathered in one place, and every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalyx.operators.store import discard, keep

MAX_ROUNDS = 60


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges: (u, v) with u > v. large: each node's larger neighbours to its least one; small: the others."""
    if small:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return out.union(least.select("u", F.col("m").alias("v"))).distinct()
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
    out = both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge to another; component is the smallest node.

    Loops and rows with a null end are ignored, repeated edges count once. No
    edges give no rows.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = keep(e.distinct(), "edges")
    before = None
    for k in range(MAX_ROUNDS):
        e, last = keep(_star(_star(e, small=False), small=True), "edges"), e
        discard(last)
        if k == 0:
            continue
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
