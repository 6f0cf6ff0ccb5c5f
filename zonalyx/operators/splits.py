"""Train, validation and test parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonalyx.operators.store import dense_id


def temporal(period: Column, train_end: str, validation_end: str, test_end: str | None = None) -> Column:
    """By month (yyyy-MM), ends included; after test_end NULL."""
    out = F.when(period <= train_end, "train").when(period <= validation_end, "validation")
    return out.when(period <= test_end, "test") if test_end else out.otherwise("test")


def random_rows(df: DataFrame, key: str, parts: tuple[float, float] = (0.70, 0.15), seed: int = 42, out: str = "split") -> DataFrame:
    """round(70 %) train, round(15 %) validation and the rest test, in the order of a hash of the key."""
    n = df.count()
    a, b = round(n * parts[0]), round(n * parts[1])
    placed = dense_id(df.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed))), "__i", "__h", key)
    return placed.withColumn(out, F.when(F.col("__i") < a, "train").when(F.col("__i") < a + b, "validation").otherwise("test")).drop("__h", "__i")


def spatial_blocks(df: DataFrame, zone: str, x: str, y: str, bins: int = 5, parts: tuple[float, float] = (0.70, 0.15), seed: int = 42) -> DataFrame:
    """zone, block, split: whole blocks of a bins x bins quantile grid, in hashed order, until the parts are full."""
    z = df.select(zone, x, y).dropDuplicates([zone])
    n = z.count()
    for c, i in ((x, "__ix"), (y, "__iy")):
        z = dense_id(z, i, c, zone)
    cell = lambda i: F.floor(F.col(i) * bins / F.lit(max(n, 1)))
    z = z.withColumn("block", (cell("__ix") * bins + cell("__iy")).cast("long"))
    sizes = z.groupBy("block").agg(F.count(F.lit(1)).alias("m"))
    # bins x bins blocks at most, so a window over all of them is small
    order = Window.partitionBy().orderBy(F.xxhash64("block", F.lit(seed)), "block")
    before = F.coalesce(F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / F.sum("m").over(Window.partitionBy())
    split = F.when(before < parts[0], "train").when(before < sum(parts), "validation").otherwise("test")
    return z.join(F.broadcast(sizes.withColumn("split", split).select("block", "split")), "block").select(zone, "block", "split")


#: Parts of names of columns that a forecast may not use.
FORBIDDEN = (
    "same_month_water_drainage",
    "water_drainage_binary_same_month",
    "share_water_drainage",
    "share_water_drainage_requests",
    "total_311_count_all",
    "reporting_retro__",
    "same_month_reporting_retrospective",
)
#: Marks of names that tell the target or the future.
MARKS = ("target", "future", "next_", "_complete", "observed", "predicted")


def leaking_columns(columns: list[str], target: str, forbidden: tuple[str, ...] = FORBIDDEN, marks: tuple[str, ...] = MARKS) -> list[str]:
    """The target, and columns with a forbidden part or a mark in their name."""
    return [c for c in columns if c.lower() == target.lower() or any(m in c.lower() for m in (*forbidden, *marks))]


def leaking_lineage(lineage: DataFrame, target: str, feature: str = "feature", source: str = "source", lag: str = "lag") -> DataFrame:
    """feature, reason of rows of a lineage table that break the rules: a feature made from the target of its own month or a later one."""
    bad = F.when((F.col(source) == target) & (F.coalesce(lag, F.lit(0)) < 1), F.concat(F.lit("uses "), F.lit(target), F.lit(" without a lag"))).when(
        F.col(lag) < 0,
        "looks ahead",
    )
    return lineage.withColumn("reason", bad).where("reason is not null").select(feature, "reason")
