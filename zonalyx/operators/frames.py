"""Relational building blocks: projections, filters, joins, sets, grids."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonalyx.functions.scalar import month_of, month_ordinal, normal_name
from zonalyx.operators.store import ROWS_A_TASK, by_rows, dense_id, keep  # noqa: F401  part of this module's operators

#: Rows of a lookup side that may be broadcast.
BROADCAST_ROWS = 1_000_000


class ContractError(ValueError):
    """A table breaks what an operator was promised about it."""


# -- columns ------------------------------------------------------------------------------------


def canonical(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """The columns named, under their new names, in that order."""
    return df.select(*[F.col(f"`{a}`").alias(b) for a, b in names.items()])


def normalise_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[normal_name(c) for c in df.columns])


def choose_column(columns: Iterable[str], candidates: Iterable[str], label: str, required: bool = True) -> str | None:
    """The first candidate that is a column, whatever its case and outer blanks."""
    have = {c.strip().lower(): c for c in reversed(list(columns))}
    candidates = list(candidates)
    for c in candidates:
        if c.strip().lower() in have:
            return have[c.strip().lower()]
    if required:
        raise ContractError(f"no column for {label}: looked for {', '.join(candidates)}")
    return None


def numeric_columns(df: DataFrame, deny: Iterable[str] = ()) -> list[str]:
    kinds = ("int", "bigint", "smallint", "tinyint", "float", "double")
    return [c for c, t in df.dtypes if (t in kinds or t.startswith("decimal")) and not any(d in c.lower() for d in deny)]


def column_family(name: str, rules: list[tuple[str, list[str]]], other: str = "other") -> str:
    """The first family of which a mark is in the column's name."""
    return next((family for family, marks in rules if any(m in name.lower() for m in marks)), other)


def feature_vector(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in columns]))


def static_columns(df: DataFrame, key: str, columns: list[str]) -> list[str]:
    """Columns with one value at most in each group of key."""
    per = df.groupBy(key).agg(*[F.count_distinct(c).alias(c) for c in columns])
    most = per.agg(*[F.max(c).alias(c) for c in columns]).first()
    return [c for c in columns if (most[c] or 0) <= 1]


# -- filters ------------------------------------------------------------------------------------


def level_filter(df: DataFrame, column: str, level: str, ids: str, wanted: Iterable) -> DataFrame:
    return df.where((F.trim(column) == level) & F.col(ids).isin(list(wanted)))


def has_prefix(column: Column, prefix: str) -> Column:
    return F.coalesce(F.startswith(F.trim(column), F.lit(prefix)), F.lit(False))


def zero_population(df: DataFrame, column: str, policy: str = "exclude", least: float = 0.0) -> DataFrame:
    """Rows without a population above least: excluded, flagged (bad_population) or an error."""
    bad = F.col(column).isNull() | (F.col(column) <= least)
    if policy == "exclude":
        return df.where(~bad)
    if policy == "flag":
        return df.withColumn("bad_population", bad)
    if df.where(bad).limit(1).count():
        raise ContractError(f"{column}: rows without a population above {least}")
    return df


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, the same for the same seed."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


# -- joins --------------------------------------------------------------------------------------


def assert_unique(df: DataFrame, keys: list[str], what: str = "table") -> DataFrame:
    bad = df.groupBy(*keys).count().where("count > 1").limit(20).collect()
    if bad:
        raise ContractError(f"{what}: repeated keys {[tuple(r[k] for k in keys) for r in bad]}")
    return df


def lookup_side(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it is small enough, else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def left_join(left: DataFrame, right: DataFrame, keys: list[str], validate: str = "m:1", marker: str | None = None) -> DataFrame:
    """Left equi-join; the right keys must be unique, with 1:1 the left ones too. marker: whether a row matched."""
    assert_unique(right, keys, "right side")
    if validate == "1:1":
        assert_unique(left, keys, "left side")
    if marker:
        right = right.withColumn(marker, F.lit(True))
    out = left.join(right, keys, "left")
    return out.withColumn(marker, F.coalesce(marker, F.lit(False))) if marker else out


def outer_audit(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of either side with side: both, left_only or right_only."""
    a = left.select(*keys).distinct().withColumn("__l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("__r", F.lit(1))
    side = F.when(F.col("__l").isNull(), "right_only").when(F.col("__r").isNull(), "left_only").otherwise("both")
    return a.join(b, keys, "full_outer").select(*keys, side.alias("side"))


def complete_grid(
    df: DataFrame,
    zone: str,
    period: str,
    zones: DataFrame | None = None,
    start: str | None = None,
    end: str | None = None,
    zeros: list[str] | None = None,
) -> DataFrame:
    """Every zone in every month (yyyy-MM): those from start to end, or those the table has; zeros are filled with 0."""
    zones = (zones if zones is not None else df).select(zone).distinct()
    if start and end:
        a, b = (int(p[:4]) * 12 + int(p[5:7]) - 1 for p in (start, end))
        grid = zones.withColumn("__o", F.explode(F.sequence(F.lit(a), F.lit(b)))).withColumn(period, month_of(F.col("__o"))).drop("__o")
    else:
        months = sorted(r[0] for r in df.select(period).distinct().collect() if r[0] is not None)
        grid = zones.withColumn(period, F.explode(F.array(*map(F.lit, months))))
    return grid.join(df, [zone, period], "left").fillna(0, subset=zeros or [])


def lag_join(df: DataFrame, zone: str, period: str, value: str, k: int, out: str) -> DataFrame:
    """The value k calendar months earlier; NULL where that month has no row."""
    o = df.withColumn("__o", month_ordinal(F.col(period)))
    past = o.select(zone, (F.col("__o") + k).alias("__o"), F.col(value).alias(out))
    return o.join(past, [zone, "__o"], "left").drop("__o")


def fallback_lookup(df: DataFrame, lookups: list[tuple[DataFrame, list[str], str]], default, out: str) -> DataFrame:
    """The first value that a lookup (table, keys, column) has for the row, else default."""
    found = []
    for k, (table, keys, column) in enumerate(lookups):
        df = df.join(lookup_side(table.select(*keys, F.col(column).alias(f"__v{k}"))), keys, "left")
        found.append(F.col(f"__v{k}"))
    return df.withColumn(out, F.coalesce(*found, F.lit(default))).drop(*[f"__v{k}" for k in range(len(lookups))])


def repair_names(df: DataFrame, lookup: DataFrame, key: str, name: str, missing: Iterable[str] = ("", "nan", "none")) -> DataFrame:
    blank = F.col(name).isNull() | F.lower(F.trim(name)).isin(list(missing))
    out = df.join(lookup_side(lookup.select(key, F.col(name).alias("__name"))), key, "left")
    return out.withColumn(name, F.when(blank, F.col("__name")).otherwise(F.col(name))).drop("__name")


def overlay(df: DataFrame, repairs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Values by hand, where there are any, over those of the table."""
    r = repairs.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    out = df.join(lookup_side(r), key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"__{c}", c))
    return out.drop(*[f"__{c}" for c in columns])


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, start: str, end: str, bucket: float | None = None) -> DataFrame:
    """left joined with the rows of right that hold then: start <= at < end (an open end holds on).

    A left join: a row of left that no interval holds at keeps its place with NULLs,
    whether its key has other intervals or none. With bucket (of the unit of at, as
    a number or in seconds), closed intervals meet rows in the buckets that they
    reach, so a key with many intervals is not compared with all its rows. Longer
    intervals take buckets 4, 16, ... times as long, so that none reaches over more
    than six, and rows look into each length that some interval has. left is written
    first, since rows are told apart by a number.
    """
    holds = (F.col(start) <= F.col(at)) & (F.col(end).isNull() | (F.col(at) < F.col(end)))
    if bucket is None:
        a, b = left.alias("l"), right.alias("r")
        same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
        rest = [F.col(f"r.{c}") for c in right.columns if c not in keys]
        return a.join(b, [*same, holds], "left").select("l.*", *rest)
    kinds = {**dict(right.dtypes), **dict(left.dtypes)}

    def number_of(c: str) -> Column:
        x = F.col(c).cast("timestamp") if kinds[c] in ("timestamp", "timestamp_ntz", "date") else F.col(c)
        return x.cast("double")

    at_bucket = lambda c: F.floor(number_of(c) / (F.lit(float(bucket)) * F.pow(F.lit(4.0), F.col("__level"))))
    number = keep(left.withColumn("__uid", F.monotonically_increasing_id()), "interval")
    rest = [c for c in right.columns if c not in keys]
    longer = F.ceil(F.log(4.0, F.greatest((number_of(end) - number_of(start)) / F.lit(float(bucket)), F.lit(1.0))))
    closed = right.where(F.col(end).isNotNull() & (F.col(start) < F.col(end))).withColumn("__level", longer.cast("int"))
    levels = sorted(r[0] for r in closed.select("__level").distinct().collect())  # logarithms: a few dozen
    closed = closed.withColumn("__b", F.explode(F.sequence(at_bucket(start), at_bucket(end))))
    opened = right.where(F.col(end).isNull())
    looks = number.withColumn("__level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("__b", at_bucket(at))
    met = looks.join(closed, [*keys, "__level", "__b"]).where(holds).drop("__b", "__level")
    met = met.unionByName(number.join(opened, keys).where(holds))
    alone = number.join(met.select("__uid").distinct(), "__uid", "left_anti")
    return met.unionByName(alone, allowMissingColumns=True).select(*left.columns, *rest)


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, out: str) -> DataFrame:
    """The latest value of right at or before each row of left, by one sort of both sides."""
    a = left.withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__side", F.lit(1))
    b = right.select(*keys, at, F.col(value).alias("__v")).withColumn("__side", F.lit(0))
    w = Window.partitionBy(*keys).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(out, F.last("__v", ignorenulls=True).over(w))
    return both.where("__side = 1").drop("__v", "__side")


#: Grids that points are counted in, each with a quarter of the cell size of the one before.
GRID_LEVELS = 13


def nearest(points: DataFrame, key: str, x: str, y: str, k: int) -> DataFrame:
    """(source, target, distance, knn_rank) of the k nearest other points, ties by target.

    Each point takes the finest of GRID_LEVELS grids whose cell has k other points at
    least: its neighbours then lie within two cells, and the cell has few more than
    k points, however unevenly points are spread. Of points at one and the same
    place, the k + 1 smallest keys can be neighbours. Points without coordinates
    have none.
    """
    points = points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    n, x0, x1, y0, y1 = points.agg(F.count(F.lit(1)), F.min(x), F.max(x), F.min(y), F.max(y)).first()
    k = min(k, n - 1)
    if k < 1:
        return points.select(F.col(key).alias("source"), F.col(key).alias("target"), F.lit(0.0).alias("distance"), F.lit(1).alias("knn_rank")).limit(0)
    extent = max(float(x1) - float(x0), float(y1) - float(y0), 1e-9) * (1 + 1e-9)
    level = F.explode(F.sequence(F.lit(0), F.lit(GRID_LEVELS - 1)))
    cell = lambda c, low: F.floor((F.col(c) - low) * F.pow(F.lit(4.0), F.col("level")) / extent)
    flat = keep(points.select(F.col(key).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), "nearest")
    gridded = flat.withColumn("level", level).withColumn("cx", cell("x", float(x0))).withColumn("cy", cell("y", float(y0)))
    counts = gridded.groupBy("level", "cx", "cy").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > k)
    held = by_rows(gridded.join(counts, ["level", "cx", "cy"]), "id", rows=GRID_LEVELS * n, most=ROWS_A_TASK // 4)
    own = held.groupBy("id").agg(F.max(F.struct("level", "x", "y", "cx", "cy")).alias("g")).select("id", "g.*")
    step = F.explode(F.sequence(F.lit(-2), F.lit(2)))
    asked = keep(
        own.withColumn("dx", step).withColumn("dy", step).select(
            "id",
            "x",
            "y",
            "level",
            (F.col("cx") + F.col("dx")).alias("cx"),
            (F.col("cy") + F.col("dy")).alias("cy"),
        ),
        "nearest",
    )
    salt = F.pmod(F.xxhash64("id"), F.lit(64))
    first = lambda *by: F.row_number().over(Window.partitionBy("x", "y", *by).orderBy("id")) <= k + 1
    some = flat.withColumn("salt", salt).withColumn("ok", first("salt")).where("ok").withColumn("ok", first()).where("ok").drop("salt", "ok")
    other = some.withColumn("level", level).withColumn("cx", cell("x", float(x0))).withColumn("cy", cell("y", float(y0)))
    other = other.join(asked.select("level", "cx", "cy").distinct(), ["level", "cx", "cy"], "left_semi")
    other = other.select(F.col("id").alias("target"), F.col("x").alias("tx"), F.col("y").alias("ty"), "level", "cx", "cy")
    d = F.sqrt(F.pow(F.col("x") - F.col("tx"), 2) + F.pow(F.col("y") - F.col("ty"), 2))
    # a cell that is asked has few points, so pairs are as many as cells asked times some k
    cells = ["level", "cx", "cy"]
    asked, other = (by_rows(c, *cells, rows=25 * n, most=ROWS_A_TASK // 25) for c in (asked, other))
    near = asked.join(other, cells).where("id <> target").select(F.col("id").alias("source"), "target", d.alias("distance"))
    w = Window.partitionBy("source").orderBy("distance", "target")
    return near.withColumn("knn_rank", F.row_number().over(w)).where(F.col("knn_rank") <= k)


# -- sets ---------------------------------------------------------------------------------------


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def assert_subset(have: DataFrame, wanted: DataFrame, key: str) -> None:
    missing = [r[0] for r in wanted.select(key).subtract(have.select(key)).limit(20).collect()]
    if missing:
        raise ContractError(f"{key}: missing {missing}")
