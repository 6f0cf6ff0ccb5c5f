"""Validators: one pass over a table gives a table of issues."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ISSUE = "code string, column string, severity string, n long"


def _issues(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, ISSUE)


NUMERIC = ("int", "bigint", "smallint", "tinyint", "float", "double")


def is_numeric(kind: str) -> bool:
    return kind in NUMERIC or kind.startswith("decimal")


def feature_table(
    df: DataFrame,
    zone: str,
    variables: dict[str, str],
    required: set[str] | None = None,
    strategy: str = "error",
    high: float = 0.2,
) -> DataFrame:
    """code, column, severity, n of a table with a row per zone.

    variables: name to number, nonnegative, proportion or percentage (text for those
    that need not be numbers). Values that fall outside their kind's range, or look
    as if they were on the other scale, are warnings; structure is an error for
    required variables. One pass over the table.
    """
    spark, rows = df.sparkSession, []
    rows += [("duplicate_columns", c, "error", n) for c, n in Counter(df.columns).items() if n > 1]
    required = set(variables) if required is None else required
    kinds, severe = dict(df.dtypes), (lambda v: "error" if v in required else "warning")
    twice = {c for _, c, _, _ in rows}
    for v in variables:
        if v not in kinds:
            rows.append(("missing_required_variable" if v in required else "missing_optional_variable", v, severe(v), 1))
        elif variables[v] != "text" and not is_numeric(kinds[v]):
            rows.append(("nonnumeric_variable", v, severe(v), 1))
    have = [v for v in variables if v in kinds and v not in twice and (variables[v] == "text" or is_numeric(kinds[v]))]
    stats = [F.count(F.lit(1)).alias("n")]
    known = zone in kinds and zone not in twice
    if known:
        stats += [F.count(zone).alias("ids"), F.count_distinct(zone).alias("distinct")]
    elif zone not in kinds:
        rows.append(("missing_spatial_id_column", zone, "error", 1))
    for i, v in enumerate(have):
        c = F.col(f"`{v}`")
        value = c.cast("double") if variables[v] != "text" else F.lit(None).cast("double")
        stats += [F.count(c).alias(f"n{i}"), F.count_distinct(c).alias(f"d{i}"), F.min(value).alias(f"min{i}"), F.max(value).alias(f"max{i}")]
        stats += [
            F.count_if(value < 0).alias(f"neg{i}"),
            F.count_if((value < 0) | (value > 1)).alias(f"out{i}"),
            F.count_if((value < 0) | (value > 100)).alias(f"pct{i}"),
        ]
    r = df.agg(*stats).first()
    if known and r.n > r.ids:
        rows.append(("missing_spatial_id_values", zone, "error", r.n - r.ids))
    if known and r.ids > r.distinct:
        rows.append(("duplicate_spatial_ids", zone, "error", r.ids - r.distinct))
    for i, v in enumerate(have):
        absent, present, low, top = r.n - r[f"n{i}"], r[f"n{i}"], r[f"min{i}"], r[f"max{i}"]
        if absent:
            rows.append(("missing_values_detected", v, "error" if v in required and strategy == "error" else "warning", absent))
        if absent and absent / r.n >= high:
            rows.append(("high_missingness", v, "warning", absent))
        if not present:
            rows.append(("all_null_variable", v, severe(v), r.n))
            continue
        if r[f"d{i}"] <= 1:
            rows.append(("constant_column", v, "warning", present))
        if variables[v] in ("nonnegative", "proportion", "percentage") and low is not None and low < 0:
            rows.append(("negative_values_for_nonnegative_variable", v, "warning", r[f"neg{i}"]))
        if variables[v] == "proportion":
            if r[f"out{i}"]:
                rows.append(("proportion_out_of_range", v, "warning", r[f"out{i}"]))
            if 1 < top <= 100:
                rows.append(("suspicious_percentage_scale", v, "warning", present))
        if variables[v] == "percentage":
            if r[f"pct{i}"]:
                rows.append(("percent_out_of_range", v, "warning", r[f"pct{i}"]))
            if low >= 0 and top <= 1:
                rows.append(("suspicious_proportion_scale", v, "warning", present))
    return _issues(spark, rows)


def _partial(issues: DataFrame, label: str, partial: bool) -> DataFrame:
    """Where an index may be partial, an absent variable is a warning under a code of its own."""
    if not partial:
        return issues
    absent = F.col("code") == "missing_required_variable"
    return issues.withColumn("severity", F.when(absent, "warning").otherwise(F.col("severity"))).withColumn(
        "code",
        F.when(absent, f"missing_required_variable_partial_{label}").otherwise(F.col("code")),
    )


def rank_index_table(
    df: DataFrame,
    zone: str,
    variables: dict[str, str],
    population: str | None = None,
    groups: list[str] | None = None,
    partial: bool = False,
    expected: list[str] | None = None,
    **options,
) -> DataFrame:
    """feature_table's issues, and those of a rank-based index: population, columns of comparison groups, completeness.

    expected: the variables that a full index has; any that variables lacks is an error unless the index may be partial.
    """
    rows, kinds = [], dict(df.dtypes)
    if population:
        if population not in kinds:
            rows.append(("missing_population_column", population, "error", 1))
        elif not is_numeric(kinds[population]):
            rows.append(("nonnumeric_population_column", population, "error", 1))
        else:
            n = df.where(F.col(population) <= 0).count()
            if n:
                rows.append(("nonpositive_population_units", population, "warning", n))
    rows += [("missing_comparison_group_column", g, "error", 1) for g in groups or [] if g not in kinds]
    rows += [("missing_expected_variable", v, "error", 1) for v in expected or [] if v not in variables and not partial]
    return _partial(feature_table(df, zone, variables, **options), "svi_like", partial).unionByName(_issues(df.sparkSession, rows))


def factor_index_table(df: DataFrame, zone: str, variables: dict[str, str], partial: bool = False, **options) -> DataFrame:
    """feature_table's issues, and those of a factor-based index: enough rows and numeric variables, and more rows than variables."""
    n, kinds = df.count(), dict(df.dtypes)
    usable = sum(v in kinds and is_numeric(kinds[v]) for v in variables)
    rows = []
    if n < 2:
        rows.append(("too_few_observations", "", "error", n))
    if usable < 2:
        rows.append(("too_few_usable_variables", "", "error", usable))
    if n <= usable:
        rows.append(("small_n_relative_to_variables", "", "warning", n))
    return _partial(feature_table(df, zone, variables, **options), "sovi_like", partial).unionByName(_issues(df.sparkSession, rows))


def panel(df: DataFrame, zone: str, period: str, target: str) -> DataFrame:
    """check, n (0 is fine): repeated keys, missing cells of the grid, negative and missing targets."""
    r = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(zone, period).alias("k"),
        F.count_distinct(zone).alias("z"),
        F.count_distinct(period).alias("p"),
        F.count_if(F.col(target) < 0).alias("neg"),
        F.count_if(F.col(target).isNull()).alias("nul"),
    )
    checks = {
        "repeated_keys": F.col("n") - F.col("k"),
        "missing_cells": F.col("z") * F.col("p") - F.col("k"),
        "negative_target": F.col("neg"),
        "missing_target": F.col("nul"),
    }
    return r.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), x.cast("long").alias("n")) for c, x in checks.items()])).alias("c")).select("c.*")


def splits(df: DataFrame, zone: str, period: str, split: str, constant_in_zone: bool = False) -> DataFrame:
    """check, n: repeated keys, missing split, absent parts, zones in more than one part."""
    parts = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(zone, period).alias("k"), F.count_if(F.col(split).isNull()).alias("nul"), F.size(F.collect_set(split)).alias("s")).select(
        (F.col("n") - F.col("k")).alias("repeated_keys"),
        F.col("nul").alias("missing_split"),
        (3 - F.col("s")).cast("long").alias("absent_parts"),
    )
    mixed = df.groupBy(zone).agg(F.count_distinct(split).alias("m")).agg(F.count_if(F.col("m") > 1).alias("mixed_zones"))
    one = parts.crossJoin(F.broadcast(mixed)) if constant_in_zone else parts
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("n")) for c in one.columns])).alias("c")).select("c.*")


def edges(df: DataFrame, node_table: DataFrame) -> DataFrame:
    """check, n of an edge table: loops, repeats, unknown ends, bad weights, unknown types."""
    from zonalyx.operators.graph import KINDS

    known = node_table.select("node_id").distinct()
    flat = df.agg(
        F.count_if(F.col("source") == F.col("target")).alias("self_loops"),
        (F.count(F.lit(1)) - F.count_distinct("source", "target", "edge_type")).alias("repeated_edges"),
        F.count_if(F.col("edge_weight").isNull() | (F.col("edge_weight") < 0) | F.isnan("edge_weight")).alias("bad_weights"),
        F.count_if(~F.col("edge_type").isin(list(KINDS))).alias("unknown_types"),
    )
    ends = df.select(F.col("source").alias("node_id")).union(df.select("target")).join(known, "node_id", "left_anti").agg(
        F.count(F.lit(1)).alias("unknown_ends")
    )
    one = flat.crossJoin(F.broadcast(ends))
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("n")) for c in one.columns])).alias("c")).select("c.*")
