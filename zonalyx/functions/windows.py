"""Ranks, classes and time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from zonalyx.operators.ranges import hot_limit, rank_of, rank_table, spread_join
from zonalyx.operators.store import dense_id, keep

#: Rows up to which a rank over the whole table is one window.
SINGLE_WINDOW_ROWS = 100_000


def rank_over(
    df: DataFrame,
    value: str,
    out: str,
    by: list[str] | None = None,
    ascending: bool = True,
    method: str = "min",
    rows: int | None = None,
) -> DataFrame:
    """df with the rank (long) of value from 1, in each group of by; NULL for NULL; method min, max, average or dense.

    Tables longer than SINGLE_WINDOW_ROWS are written, and the ranks of their distinct
    values come from sums over ranges (rank_table): neither a group nor a value that
    many rows share lies in one task. rows: the table's length, where the caller knows it.
    """
    return _ranked(df, value, out, by or [], ascending, method, rows).drop("__n")


def _ranked(df: DataFrame, value: str, out: str, by: list[str], ascending: bool, method: str, rows: int | None) -> DataFrame:
    """df with the rank and, as __n, the number of values of the group."""
    order = F.col(value).asc_nulls_last() if ascending else F.col(value).desc_nulls_last()
    kind = "double" if method == "average" else "long"
    known = F.col(value).isNotNull()
    rows = df.count() if rows is None else rows
    if rows <= SINGLE_WINDOW_ROWS:
        w = Window.partitionBy(*by, known).orderBy(order)
        if method == "dense":
            rank = F.dense_rank().over(w)
        else:
            ties = F.count(F.lit(1)).over(w.rangeBetween(0, 0))
            rank = F.rank().over(w) + {"min": F.lit(0), "max": ties - 1, "average": (ties - 1) / 2}[method]
        return df.withColumn(out, F.when(known, rank.cast(kind))).withColumn("__n", F.count(value).over(Window.partitionBy(*by)))
    df = keep(df, "rank")
    table = keep(rank_table(df, by, value, order=order), "ranks")
    values = F.sum(F.when(known, F.col("n")).otherwise(0)).alias("__n")
    if by:
        groups = table.groupBy(*by).agg(values, F.count(F.lit(1)).alias("__rows"))
        table = spread_join(table, groups, by, "__rows", hot_limit(rows)).drop("__rows")
    else:
        table = table.withColumn("__n", F.lit(table.agg(values).first()[0] or 0))
    ranks = table.select(*by, value, F.when(known, rank_of(method).cast(kind)).alias(out), "__n", F.col("n").alias("__ties"))
    return spread_join(df, ranks, [*by, value], "__ties", hot_limit(rows)).drop("__ties")


def percentile_rank(
    df: DataFrame,
    value: str,
    out: str,
    by: list[str] | None = None,
    ascending: bool = True,
    method: str = "min",
    single: float = 0.0,
    rows: int | None = None,
) -> DataFrame:
    """(rank - 1) / (N - 1) with N the number of values that are not NULL; single if N is 1; NULL stays NULL.

    With rows at hand, ranks of a short table are columns only and start no job.
    """
    n = F.col("__n")
    share = F.when(n > 1, (F.col("__rank") - 1) / (n - 1)).otherwise(F.lit(single))
    return _ranked(df, value, "__rank", by or [], ascending, method, rows).withColumn(out, F.when(F.col(value).isNotNull(), share)).drop("__rank", "__n")


def competition_rank(df: DataFrame, value: str, out: str, by: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """Rank of the largest first; all NULLs share the rank after the last value."""
    ranked = _ranked(df, value, out, by or [], False, "min", rows)
    return ranked.withColumn(out, F.coalesce(F.col(out), F.col("__n") + 1).cast("long")).drop("__n")


def position(value: str, key: str, by: list[str]) -> Column:
    """1-based place in the group, largest value first, NULLs last, ties by key as text."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.col(value).desc_nulls_last(), F.col(key).cast("string"))).cast("long")


def overall_position(df: DataFrame, value: str, key: str, out: str) -> DataFrame:
    """df with the same place in the whole table, by a sort over all tasks."""
    return dense_id(df, out, F.col(value).desc_nulls_last(), F.col(key).cast("string")).withColumn(out, F.col(out) + 1)


# -- time windows inside a zone -----------------------------------------------------------------


def _in(zone: list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*zone).orderBy(order)


def lag(value: str, k: int, zone: list[str], order: str) -> Column:
    return F.lag(value, k).over(_in(zone, order))


def rolling_before(value: str, width: int, zone: list[str], order: str, how: str = "mean") -> Column:
    """Mean or sum of the width rows before the current one; fewer at the start, none is NULL."""
    f = F.avg if how == "mean" else F.sum
    return f(value).over(_in(zone, order).rowsBetween(-width, -1))


def rolling_with(value: str, width: int, zone: list[str], order: str) -> Column:
    """Sum of the current row and the width - 1 before it."""
    return F.sum(value).over(_in(zone, order).rowsBetween(1 - width, 0))


def expanding_before(value: str, zone: list[str], order: str) -> Column:
    return F.avg(value).over(_in(zone, order).rowsBetween(Window.unboundedPreceding, -1))


def future_sum(value: str, h: int, zone: list[str], order: str) -> Column:
    """Sum of the next h rows; NULL if there are fewer."""
    w = _in(zone, order).rowsBetween(1, h)
    return F.when(F.count(F.lit(1)).over(w) == h, F.sum(value).over(w))


def share_of_total(value: str, by: list[str]) -> Column:
    return F.try_divide(F.col(value).cast("double"), F.nullif(F.sum(value).over(Window.partitionBy(*by)).cast("double"), F.lit(0.0)))


def running_sum(value: str, by: list[str], *order: Column) -> Column:
    return F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


# -- classes ------------------------------------------------------------------------------------


def quantile_class(df: DataFrame, value: str, key: str, out: str, classes: int = 5) -> DataFrame:
    """clamp(ceil((r - 1) q / (n - 1)), 1, q) for the place r among n values, q = min(classes, n); ties by key."""
    n, distinct = df.agg(F.count(value), F.count_distinct(value)).first()
    q = min(classes, n)
    if n < 2 or distinct < 2:
        return df.withColumn(out, F.when(F.col(value).isNotNull(), 1))
    # NULLs come last and so do not move the places of values
    placed = dense_id(df, "__i", F.col(value).asc_nulls_last(), key)
    c = F.greatest(F.least(F.ceil(F.col("__i") * F.lit(q) / F.lit(float(n - 1))), F.lit(q)), F.lit(1))
    return placed.withColumn(out, F.when(F.col(value).isNotNull(), c.cast("int"))).drop("__i")


def equal_interval_class(df: DataFrame, value: str, out: str, classes: int = 5) -> DataFrame:
    """Right-closed classes of one width between the least and the largest value; a constant is class 1."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None or low == high:
        return df.withColumn(out, F.when(F.col(value).isNotNull(), 1))
    c = F.greatest(F.least(F.ceil((F.col(value) - low) * classes / (high - low)), F.lit(classes)), F.lit(1))
    return df.withColumn(out, F.when(F.col(value).isNotNull(), c.cast("int")))


def deviation_band(z: Column) -> Column:
    """least, low, moderate, high or most by standard deviations."""
    return F.when(z < -1, "least").when(z < -0.5, "low").when(z <= 0.5, "moderate").when(z <= 1, "high").when(z > 1, "most")


def magnitude_class(y: Column, quartiles: list[float]) -> Column:
    """0 for no event, else 1 to 4 by the quartiles of positive training values."""
    a, b, c = quartiles
    return F.when(y.isNull(), None).when(y <= 0, 0).when(y <= a, 1).when(y <= b, 2).when(y <= c, 3).otherwise(4)
