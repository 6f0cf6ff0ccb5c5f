"""Running sums, ranks and joins over range partitions: no group, however large, lies in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonalyx.operators.store import keep

#: A key with more than 1/HOT_SHARE of all rows is joined by broadcast; there are HOT_SHARE such keys at most.
HOT_SHARE = 4096
MIN_HOT_ROWS = 256


def hot_limit(rows: int) -> int:
    """Rows above which a key of a table with so many rows is hot."""
    return max(MIN_HOT_ROWS, rows // HOT_SHARE)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys in which null equals null; the keys are those of left."""
    if not keys:
        return left.crossJoin(right)  # one row of sums
    names = {k: f"__right_{n}" for n, k in enumerate(keys)}
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return left.join(right.withColumnsRenamed(names), on, how).drop(*names.values())


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], weight: str, limit: int) -> DataFrame:
    """Inner join of many with one, where keys are unique in one and weight counts their rows in many; null equals null.

    Keys of more than limit rows are few, as their rows add up to the table's:
    they are sent to the rows of many, which stay where they are. The others are
    shuffled.
    """
    hot, rest = one.where(F.col(weight) > limit), one.where(F.col(weight) <= limit)
    return null_safe_join(many, F.broadcast(hot), keys).unionByName(null_safe_join(many, rest, keys))


def running(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column], tag: str = "running") -> DataFrame:
    """df with one column per entry of sums: its sum over the rows of the group up to and with this one.

    Rows are range-partitioned by group and order and written; a range is summed on
    its own, and what a group has in the ranges before it is added. Only groups that
    reach over a border of ranges need that, one or two a range. Rows that tie in
    order lie in one range; which of them comes first is open.
    """
    if not by:
        return running(df.withColumn("__all", F.lit(0)), ["__all"], order, sums, tag).drop("__all")
    ranged = keep(df.repartitionByRange(*by, *order).withColumn("__p", F.spark_partition_id()), tag)
    group = F.struct(*by)
    ends = sorted(ranged.groupBy("__p").agg(F.min(group).alias("low"), F.max(group).alias("high")).collect(), key=lambda r: r[0])
    torn = {tuple(a.high) for a, b in zip(ends, ends[1:], strict=False) if a.high == b.low}
    w = Window.partitionBy("__p", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.select("*", *[F.sum(c).over(w).alias(name) for name, c in sums.items()])
    if torn:
        types = {f.name: f.dataType.simpleString() for f in out.schema.fields}
        column = lambda names, prefix="": ", ".join(f"`{prefix}{c}` {types[c]}" for c in names)
        keys = df.sparkSession.createDataFrame(list(torn), column(by))
        held = null_safe_join(ranged, F.broadcast(keys), by).groupBy("__p", *by).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
        before: dict[tuple, list] = {}
        rows = []
        for r in sorted(held.collect(), key=lambda r: r[0]):
            had = before.setdefault(tuple(r[b] for b in by), [0] * len(sums))
            rows.append((r[0], *[r[b] for b in by], *[float(x) if types[s] == "double" else x for x, s in zip(had, sums, strict=True)]))
            had[:] = [x + (r[s] or 0) for x, s in zip(had, sums, strict=True)]
        shift = df.sparkSession.createDataFrame(rows, f"__p int, {column(by)}, {column(sums, '__')}")
        out = null_safe_join(out, F.broadcast(shift), ["__p", *by], "left")
        out = out.withColumns({s: F.col(s) + F.coalesce(F.col(f"__{s}"), F.lit(0)) for s in sums}).drop(*[f"__{s}" for s in sums])
    return out.drop("__p")


def rank_table(df: DataFrame, by: list[str], value: str, weight: Column | None = None, order: Column | None = None) -> DataFrame:
    """One row per group and distinct value: n, its rows; rows, those of df; before and values_before, rows and distinct values that come first.

    Ties are counted in the tasks that read them and need no sort. Null is a value;
    order is ascending with null first unless given. weight: rows that a row of df stands for.
    """
    counts = df.groupBy(*by, value).agg(F.sum(F.lit(1).cast("long") if weight is None else weight).alias("n"), F.count(F.lit(1)).alias("rows"))
    got = running(counts, by, [F.col(value).asc_nulls_first() if order is None else order], {"before": F.col("n"), "values_before": F.lit(1).cast("long")}, "ranks")
    return got.withColumns({"before": F.col("before") - F.col("n"), "values_before": F.col("values_before") - 1})


def rank_of(method: str) -> Column:
    """The rank that a row of rank_table gives: min, max, average or dense."""
    before, n = F.col("before"), F.col("n")
    return {"min": before + 1, "max": before + n, "average": before + (n + 1) / 2, "dense": F.col("values_before") + 1}[method]
