"""Grouped aggregates with the null rules of area statistics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonalyx.functions.windows import competition_rank
from zonalyx.operators.frames import ContractError, assert_unique
from zonalyx.operators.quantiles import quantiles
from zonalyx.operators.store import keep


def sum_or_null(x: Column) -> Column:
    """NULL for a group of NULLs only."""
    return F.sum(x)


def sum_or_zero(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0))


def weighted_mean(v: Column, w: Column) -> Column:
    """Sum of v w over that of w; the plain mean if the weights are not positive. Rows without v are left out."""
    weight = F.when(v.isNotNull(), F.coalesce(w, F.lit(0.0)))
    return F.when(F.sum(weight) > 0, F.sum(v * weight) / F.sum(weight)).otherwise(F.avg(v))


def area_weighted_mean(v: Column, w: Column) -> Column:
    """Only rows with both and a positive weight; NULL without any."""
    ok = v.isNotNull() & (w > 0)
    return F.try_divide(F.sum(F.when(ok, v * w)), F.sum(F.when(ok, w)))


def allocated(count: Column, overlap: Column, area: Column) -> Column:
    """Counts dealt out by the share of their area."""
    return F.sum(F.try_divide(count * overlap, F.nullif(area, F.lit(0.0))))


def dominant(key: Column, size: Column) -> Column:
    """The key of the largest size, ties by the smallest key."""
    return F.min_by(key, F.struct(-size, key))


def share(n: Column, d: Column) -> Column:
    """Of sums; 0 without a denominator."""
    return F.coalesce(F.try_divide(n.cast("double"), F.nullif(d.cast("double"), F.lit(0.0))), F.lit(0.0))


def pivot_counts(df: DataFrame, keys: list[str], column: str, values: list) -> DataFrame:
    return df.groupBy(*keys).pivot(column, values).count().fillna(0)


def unstack(df: DataFrame, keys: list[str], column: str, value: str, values: list) -> DataFrame:
    """One column per value; a repeated (keys, column) is an error."""
    assert_unique(df, [*keys, column], "long table")
    return df.groupBy(*keys).pivot(column, values).agg(F.first(value))


def reconcile(df: DataFrame, aliases: list[str], out: str, tolerance: float = 1e-9) -> DataFrame:
    """One column out of aliases, which must agree where more than one has a value."""
    most, least = F.greatest(*aliases), F.least(*aliases)
    if df.where(most - least > tolerance).limit(1).count():
        raise ContractError(f"{aliases} disagree")
    return df.withColumn(out, F.coalesce(*aliases)).drop(*[a for a in aliases if a != out])


def winsorise(df: DataFrame, column: str, q: float | None) -> DataFrame:
    if q is None:
        return df
    cap = quantiles(df, column, [q]).first()[0]
    return df if cap is None else df.withColumn(column, F.when(F.col(column) > cap, cap).otherwise(F.col(column)))


def surge_months(df: DataFrame, period: str, value: str, q: float) -> DataFrame:
    """Months whose total is at or above the quantile q of all months' totals."""
    totals = df.groupBy(period).agg(F.sum(value).alias("total"))
    limit = quantiles(totals, "total", [q], names=["cut"])
    return totals.crossJoin(F.broadcast(limit)).where("total >= cut").drop("cut")


def value_counts(df: DataFrame, column: str, missing: str = "<MISSING>") -> DataFrame:
    c = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias(column)).agg(F.count(F.lit(1)).alias("n"))
    total = df.count()
    return c.withColumn("share", F.col("n") / F.lit(total))


def missingness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, non_missing, missing, missing_share; one pass."""
    columns = columns or df.columns
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(c) for c in columns])
    flat = one.select("__n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("non_missing")) for c in columns])).alias("s"))
    return flat.select(
        "s.column",
        "s.non_missing",
        (F.col("__n") - F.col("s.non_missing")).alias("missing"),
        F.try_divide((F.col("__n") - F.col("s.non_missing")).cast("double"), F.col("__n")).alias("missing_share"),
    )


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, non_missing, missing, min, max, mean, median; one pass."""
    stats = lambda c: F.struct(
        F.lit(c).alias("column"),
        F.count(c).alias("non_missing"),
        (F.count(F.lit(1)) - F.count(c)).alias("missing"),
        F.min(c).cast("double").alias("min"),
        F.max(c).cast("double").alias("max"),
        F.avg(c).alias("mean"),
        F.median(c).alias("median"),
    )
    one = df.agg(*[stats(c).alias(c) for c in columns])
    return one.select(F.explode(F.array(*columns)).alias("s")).select("s.*")


def missing_per_row(columns: Iterable[str]) -> Column:
    out = F.lit(0)
    for c in columns:
        out = out + F.col(c).isNull().cast("int")
    return out


def hierarchical_means(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Means by all keys, by each key and over all, in one grouping-sets pass; level is the bitmap of absent keys."""
    sets = [list(map(F.col, keys)), *[[F.col(k)] for k in keys], []]
    return df.groupingSets(sets, *keys).agg(F.grouping_id().alias("level"), F.avg(value).alias("mean"), F.count(value).alias("n"))


def burden(df: DataFrame, zone: str, period: str, y: str, score: str, population: str) -> DataFrame:
    """Per zone: total, mean, positive months, months, score, rate per 1000 and ranks of the three."""
    g = df.groupBy(zone).agg(
        F.sum(y).alias("total"),
        F.avg(y).alias("mean"),
        F.count_if(F.col(y) > 0).alias("positive"),
        F.count_distinct(period).alias("months"),
        F.first(score, ignorenulls=True).alias("score"),
        F.max(population).alias("population"),
    )
    g = g.withColumn("rate", F.when(F.col("population") > 0, F.col("total") / F.col("population") * 1000.0))
    g = keep(g, "burden")
    rows = g.count()
    for c in ("total", "mean", "rate"):
        g = competition_rank(g, c, f"{c}_rank", rows=rows)
    return g


def winners(df: DataFrame, by: list[str], name: str, value: str, higher_is_better: str) -> DataFrame:
    """Best and second of each group, direction-aware, with absolute and relative margin."""
    key = F.when(F.col(higher_is_better), -F.col(value)).otherwise(F.col(value))
    w = Window.partitionBy(*by).orderBy(key.asc_nulls_last(), name)
    r = df.withColumn("__n", F.row_number().over(w)).withColumn("second", F.lead(name).over(w)).withColumn("second_value", F.lead(value).over(w)).withColumn(
        "compared",
        F.count(value).over(Window.partitionBy(*by)),
    )
    margin = F.abs(F.col(value) - F.col("second_value"))
    return r.where("__n = 1").select(
        *by,
        F.col(name).alias("best"),
        F.col(value).alias("best_value"),
        "second",
        "second_value",
        margin.alias("margin"),
        F.try_divide(margin, F.nullif(F.abs("second_value"), F.lit(0.0))).alias("relative_margin"),
        "compared",
    )
