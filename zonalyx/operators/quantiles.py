"""Exact quantiles by distributed selection.

A quantile of n sorted values lies between the values at two neighbouring places. A
mergeable sketch of GRID + 1 values gives, for every group and quantile, two that
should enclose those places. One pass then counts exactly what lies below the lower
one and between them; where the sketch was wrong, the bracket opens to all values.
Only the values strictly inside go on, and are bracketed again, until so few are left
that one task sorts them or a place falls on an end, where ties of any number lie. Rows are never sorted or shuffled as such,
and all quantiles of all groups share the passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonalyx.operators.ranges import hot_limit, null_safe_join, spread_join
from zonalyx.operators.store import discard, keep

#: Values of a group and quantile that one task sorts.
SORT_VALUES = 10_000
#: A round keeps about 3/GRID of the values.
GRID = 1000
#: The sketch's places are wrong by 1/ACCURACY of the rows at most.
ACCURACY = 10_000
#: Rounds after which what is left is sorted, whatever its size.
MAX_ROUNDS = 20


def _sketch(v: str) -> Column:
    return F.percentile_approx(v, F.array(*[F.lit(k / GRID) for k in range(GRID + 1)]), F.lit(ACCURACY))


def _bracket(share: Column) -> tuple[Column, Column]:
    """The sketch's values around a share of the rows."""
    at = lambda c: F.element_at("__s", F.least(F.greatest(c, F.lit(0)), F.lit(GRID)).cast("int") + 1)
    return at(F.floor(share * GRID) - 1), at(F.ceil(share * GRID) + 1)


def quantiles(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """One row per group: by, and for every share the exact quantile (double), with linear interpolation, named names (q0, q1, ...).

    Null and NaN values are left out; a group of nothing else has NULL. Without by
    there is one row, of NULLs if there are no values.
    """
    keys, names = list(by or []) or ["__all"], list(names or [f"q{k}" for k in range(len(shares))])
    rows = df if by else df.withColumn("__all", F.lit(0))
    rows = rows.select(*keys, F.col(value).cast("double").alias("__v"))
    groups = rows.select(*keys).distinct() if by else df.sparkSession.range(1).select(F.lit(0).alias("__all"))
    rows = rows.where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("__q"), F.lit(float(p)).alias("__share")) for k, p in enumerate(shares)])).alias("x")
    state = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"), _sketch("__v").alias("__s"))
    low, high = _bracket(F.col("__share"))
    state = state.select("*", each).select(*keys, "x.*", "__rows", "__s")
    place = F.col("__share") * (F.col("__rows") - 1)
    # each row of a group meets all of its brackets
    state = keep(state.select(*keys, "__q", place.alias("__place"), low.alias("__low"), high.alias("__high"), F.lit(0).cast("long").alias("__below"), F.col("__rows").alias("__n")), "quantile-state")
    found, rounds = [], 0
    join, pool = keys, rows
    limit = hot_limit(int(state.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]) // max(1, len(shares)))
    while True:
        rounds += 1
        met = _meet(pool, state, join, keys, limit)
        v, low, high = F.col("__v"), F.col("__low"), F.col("__high")
        inside = (v >= low) & (v <= high)
        held = met.groupBy(*keys, "__q").agg(
            F.count_if(v < low).alias("__under"),
            F.count_if(inside).alias("__in"),
            F.count_if(v == low).alias("__lows"),
            F.count_if(v == high).alias("__highs"),
            F.min(F.when(inside & (v > low), v)).alias("__next"),
            F.max(F.when(inside & (v < high), v)).alias("__last"),
        )
        now = null_safe_join(state, held, [*keys, "__q"]).withColumn("__under", F.col("__below") + F.col("__under"))
        first, second = F.floor("__place"), F.ceil("__place")
        right = (first >= F.col("__under")) & (second < F.col("__under") + F.col("__in"))
        now = keep(now.withColumn("__right", right), "quantile-counts")
        if now.where(~F.col("__right")).limit(1).count():
            open_ = lambda c, x: F.when(F.col("__right"), F.col(c)).otherwise(F.lit(float(x))).alias(c)
            state = keep(now.select(*keys, "__q", "__place", open_("__low", "-inf"), open_("__high", "inf"), "__below", "__n"), "quantile-state")
            continue
        # places among the rows that tie at an end, or next to them, are known
        after_low, before_high = F.col("__under") + F.col("__lows"), F.col("__under") + F.col("__in") - F.col("__highs")
        a = F.when(first < after_low, low).when(second >= before_high, F.when(first >= before_high, high).otherwise(F.col("__last")))
        b = F.when(first < after_low, F.when(second < after_low, low).otherwise(F.col("__next"))).when(second >= before_high, high)
        now = now.withColumn("__a", a).withColumn("__b", b)
        found.append(now.where("__a IS NOT NULL").select(*keys, "__q", _between(F.col("__a"), F.col("__b")).alias("__value")))
        now = now.where("__a IS NULL")
        left = now.select(*keys, "__q", "__place", "__low", "__high", after_low.alias("__below"), "__n", (F.col("__in") - F.col("__lows") - F.col("__highs")).alias("__rows"))
        if left.isEmpty():
            break
        values = keep(_meet(pool, left, join, keys, limit).where((v > low) & (v < high)).select(*keys, "__q", "__v"), "quantile-values")
        if pool is not rows:
            discard(pool)
        pool, join = values, [*keys, "__q"]
        left = left.withColumn("__n", F.col("__rows"))  # the rows that the pool has of it
        short = (F.col("__rows") <= SORT_VALUES) | F.lit(rounds >= MAX_ROUNDS)
        found.append(keep(_read(pool, left.where(short), keys, limit), "quantile-found"))
        many = left.where(~short)
        if many.isEmpty():
            break
        again = null_safe_join(many, _meet(pool, many, join, keys, limit).groupBy(*join).agg(_sketch("__v").alias("__s")), join)
        low, high = _bracket((F.col("__place") - F.col("__below")) / (F.col("__rows") - 1))
        state = keep(again.select(*keys, "__q", "__place", low.alias("__low"), high.alias("__high"), "__below", "__n"), "quantile-state")
    got = found[0]
    for more in found[1:]:
        got = got.unionByName(more)
    wide = got.groupBy(*keys).agg(*[F.max(F.when(F.col("__q") == k, F.col("__value"))).alias(n) for k, n in enumerate(names)])
    out = null_safe_join(groups, wide, keys, "left")
    return out if by else out.drop("__all")


def _meet(pool: DataFrame, state: DataFrame, join: list[str], keys: list[str], limit: int) -> DataFrame:
    """Rows of pool with the brackets of their group, or of their group and quantile."""
    if "__q" in join:
        return spread_join(pool, state, join, "__n", limit)
    of_group = state.groupBy(*keys).agg(F.max("__n").alias("__n"), F.collect_list(F.struct("__q", "__place", "__low", "__high", "__below")).alias("__w"))
    return spread_join(pool, of_group, keys, "__n", limit).select(*keys, "__v", F.explode("__w").alias("w")).select(*keys, "__v", "w.*")


def _read(pool: DataFrame, few: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The values at the two places of each quantile, from at most SORT_VALUES sorted rows, and what lies between them."""
    met = spread_join(pool, few, [*keys, "__q"], "__n", limit)
    at = F.row_number().over(Window.partitionBy(*keys, "__q").orderBy("__v")) - 1 + F.col("__below")
    near = met.withColumn("__at", at).where(F.col("__at").between(F.floor("__place"), F.ceil("__place")))
    g = near.groupBy(*keys, "__q").agg(F.min("__v").alias("a"), F.max("__v").alias("b"), F.first("__place").alias("__place"))
    return g.select(*keys, "__q", _between(F.col("a"), F.col("b")).alias("__value"))


def _between(a: Column, b: Column) -> Column:
    """What lies at the place between the values at its two neighbours."""
    part = F.col("__place") - F.floor("__place")
    return F.when(a == b, a).otherwise((1 - part) * a + part * b)
