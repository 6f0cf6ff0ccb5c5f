"""Queries: composite indices, factors, regressions, graphs, splits and validators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from zonalyx.functions import scalar as s
from zonalyx.operators import frames as fr
from zonalyx.operators import graph as g
from zonalyx.operators import index as ix
from zonalyx.operators import models as mo
from zonalyx.operators import splits as sp
from zonalyx.operators import validate as va
from zonalyx.plans.base import PANEL, SPLIT, TRAIN_END, VALIDATION_END, ZONES, Register, panel, r6, table, zones

query = Register()
O = "period_month"
FOUR = ["balance", "debt_share", "building_share", "spread"]


@query("r123_derived_ratio", f"WITH {ZONES} SELECT zone_id, round(100.0 * balance / nullif(spread, 0), 6) AS ratio FROM zones")
def _(spark, d):
    return zones(spark, d).select("zone_id", r6(s.safe_divide(F.col("balance"), F.col("spread")) * 100, "ratio"))


@query("r125_normalise", f"""WITH {ZONES}, m AS (SELECT min(balance) AS lo, max(balance) AS hi, avg(spread) AS a, stddev_pop(spread) AS sd, sqrt(sum(population * population)) AS n FROM zones)
    SELECT zone_id, round((balance - lo) / (hi - lo), 6) AS minmax, round((spread - a) / sd, 6) AS zscore, round(population / n, 6) AS vector FROM zones, m""")
def _(spark, d):
    z = ix.normalise(zones(spark, d), ["balance"], "minmax", suffix="_n")
    z = ix.normalise(ix.normalise(z, ["spread"], "zscore", suffix="_n"), ["population"], "vector", suffix="_n")
    return z.select("zone_id", r6("balance_n", "minmax"), r6("spread_n", "zscore"), r6("population_n", "vector"))


@query(
    "r126_standardise_many",
    f"WITH {ZONES} SELECT zone_id, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in FOUR) + " FROM zones",
)
def _(spark, d):
    return ix.normalise(zones(spark, d), FOUR, "zscore").select("zone_id", *[r6(c, c) for c in FOUR])


@query("r127_orient", f"WITH {ZONES} SELECT zone_id, round(1 - debt_share, 6) AS turned, round(-balance, 6) AS minus FROM zones")
def _(spark, d):
    return zones(spark, d).select(
        "zone_id",
        r6(ix.orient(F.col("debt_share"), "negative"), "turned"),
        r6(ix.orient(F.col("balance"), "negative", unit=False), "minus"),
    )


@query(
    "r128_row_aggregate",
    "SELECT event_id, coalesce(CASE WHEN value > 10 THEN value END, 0) + coalesce(CASE WHEN value < 50 THEN value END, 0) AS total, (coalesce(CASE WHEN value > 10 THEN value END, 0) + coalesce(CASE WHEN value < 50 THEN value END, 0)) / nullif(CAST(value > 10 AS INTEGER) + CAST(value < 50 AS INTEGER), 0) AS mean FROM events",
)
def _(spark, d):
    e = table(spark, d, "events").withColumn("a", F.when(F.col("value") > 10, F.col("value"))).withColumn("b", F.when(F.col("value") < 50, F.col("value")))
    return e.select("event_id", ix.combine(["a", "b"], "sum").alias("total"), ix.combine(["a", "b"], "mean").alias("mean"))


@query(
    "r129_impute_median",
    "WITH e AS (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN value END AS v FROM events) SELECT event_id, coalesce(v, (SELECT median(v) FROM e)) AS v, v IS NULL AS v__missing_flag FROM e",
)
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("v"))
    return ix.impute(e, ["v"], "median")[0]


@query(
    "r130_train_only_scaler",
    f"WITH {PANEL}, m AS (SELECT avg(y) AS a, stddev_pop(y) AS sd FROM panel WHERE period_month <= '{TRAIN_END}') SELECT zone_id, period_month, round((y - a) / sd, 6) AS z FROM panel, m",
)
def _(spark, d):
    p = panel(spark, d)
    fit = ix.fit_normaliser(p.where(F.col(O) <= TRAIN_END), ["y"], "zscore")
    return ix.normalise(p, ["y"], "zscore", fit, suffix="_z").select("zone_id", O, r6("y_z", "z"))


@query("r131_flags", "SELECT p_partkey, CAST((rank() OVER (ORDER BY p_size) - 1) / (count(*) OVER () - 1.0) >= 0.9 AS INTEGER) AS flag FROM part")
def _(spark, d):
    from zonalyx.functions.windows import percentile_rank

    return percentile_rank(table(spark, d, "part"), "p_size", "pr").select("p_partkey", F.coalesce((F.col("pr") >= 0.9).cast("int"), F.lit(0)).alias("flag"))


_PR = lambda c, up=True: f"(rank() OVER (ORDER BY {c} {'ASC' if up else 'DESC'}) - 1) / (count({c}) OVER () - 1.0)"
RANK_RECIPE = ix.Recipe(
    "rank",
    (
        ix.Variable("balance", "negative", domain="money"),
        ix.Variable("debt_share", domain="money"),
        ix.Variable("building_share", domain="market"),
        ix.Variable("spread", domain="market"),
    ),
    population="population",
)
_RANK_SQL = f"""WITH {ZONES}, v AS (SELECT zone_id, {_PR("balance", False)} AS a, {_PR("debt_share")} AS b, {_PR("building_share")} AS c, {_PR("spread")} AS d FROM zones),
    s AS (SELECT *, round(a + b, 12) AS money, round(c + d, 12) AS market FROM v), p AS (SELECT *, {_PR("money")} AS mp, {_PR("market")} AS kp FROM s), t AS (SELECT *, round(mp + kp, 12) AS total FROM p)"""


@query(
    "r188_rank_index",
    f"{_RANK_SQL} SELECT zone_id, CAST(a >= 0.9 AS INTEGER) + CAST(b >= 0.9 AS INTEGER) + CAST(c >= 0.9 AS INTEGER) + CAST(d >= 0.9 AS INTEGER) AS flags, round(total, 6) AS total, round({_PR('total')}, 6) AS score FROM t",
)
def _(spark, d):
    return ix.get_index("rank-based")(zones(spark, d), RANK_RECIPE).select("zone_id", "flags", r6("total", "total"), r6("score", "score"))


@query("r190_additive_index", f"""WITH {ZONES}, m AS (SELECT min(balance) AS a0, max(balance) AS a1, min(debt_share) AS b0, max(debt_share) AS b1, min(spread) AS c0, max(spread) AS c1 FROM zones)
    SELECT zone_id, round(0.4 * (1 - (balance - a0) / (a1 - a0)) + 0.3 * (debt_share - b0) / (b1 - b0) + 0.3 * (spread - c0) / (c1 - c0), 6) AS score FROM zones, m""")
def _(spark, d):
    recipe = ix.Recipe.from_mapping(
        {"name": "additive", "variables": {"balance": {"direction": "negative", "weight": 0.4}, "debt_share": {"weight": 0.3}, "spread": {"weight": 0.3}}}
    )
    return ix.get_index("additive")(zones(spark, d), recipe).select("zone_id", r6("score", "score"))


@query("r192_standard_output", f"""WITH {ZONES} SELECT CAST(zone_id AS VARCHAR) AS zone_id, 'balance' AS index_name, 'run' AS run_id, round(balance, 6) AS score_raw, round((balance - min(balance) OVER ()) / (max(balance) OVER () - min(balance) OVER ()), 6) AS score_normalized_0_1,
    'higher_is_worse' AS score_direction, CAST(rank() OVER (ORDER BY balance DESC) AS BIGINT) AS rank, round({_PR('balance')}, 6) AS percentile, CAST(0 AS BIGINT) AS missing_count, 'ok' AS quality_flag, 'full' AS reproduction_level FROM zones""")
def _(spark, d):
    o = ix.standard_output(zones(spark, d), "zone_id", "balance", "balance")
    for c in ("score_raw", "score_normalized_0_1", "percentile"):
        o = o.withColumn(c, r6(c))
    return o


@query("r193_explain", f"WITH {ZONES} SELECT zone_id, round(balance, 6) AS balance FROM zones WHERE zone_id = 7")
def _(spark, d):
    o = ix.standard_output(zones(spark, d), "zone_id", "balance", "balance")
    row = ix.explain(o, "7")
    return spark.createDataFrame([(int(row["zone_id"]), round(row["score_raw"], 6))], "zone_id int, balance double")


@query(
    "r183_covariance",
    f"WITH {ZONES} SELECT round(covar_samp(balance, debt_share), 4) AS ab, round(var_samp(balance), 3) AS aa, round(covar_samp(spread, building_share), 4) AS cd FROM zones",
)
def _(spark, d):
    _, cov, _n = ix.covariance(zones(spark, d), FOUR)
    return spark.createDataFrame([(round(float(cov[0, 1]), 4), round(float(cov[0, 0]), 3), round(float(cov[3, 2]), 4))], "ab double, aa double, cd double")


@query("r189_factor_index")
def _(spark, d):
    recipe = ix.Recipe("factors", tuple(ix.Variable(c) for c in FOUR), missing="median", flags=False)
    return ix.get_index("factor_based")(zones(spark, d), recipe, keep=2)[0].select("zone_id", "factor_1", "factor_2", "score", "band")


@query(
    "r194_ridge",
    f"WITH {PANEL}, {ZONES}, t AS (SELECT population AS x, ln(1 + y) AS v FROM panel JOIN zones USING (zone_id)), c AS (SELECT covar_samp(x, v) * (count(*) - 1) / (var_samp(x) * (count(*) - 1) + 1.0) AS w, avg(x) AS mx, avg(v) AS mv FROM t) SELECT round(w, 6) AS slope, round(mv - w * mx, 6) AS intercept FROM c",
)
def _(spark, d):
    j = panel(spark, d).join(zones(spark, d).select("zone_id", "population"), "zone_id")
    intercept, w = ix.ridge_log_counts(j, ["population"], "y")
    return spark.createDataFrame([(round(w["population"], 6), round(intercept, 6))], "slope double, intercept double")


@query("r195_poisson_regression")
def _(spark, d):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    j = panel(spark, d).join(zones(spark, d).select("zone_id", "population"), "zone_id").withColumn("x", F.col("population") / 100.0)
    v = VectorAssembler(inputCols=["x"], outputCol="features").transform(j)
    m = GeneralizedLinearRegression(family="poisson", link="log", labelCol="y", maxIter=25).fit(v)
    return m.transform(v).select("zone_id", O, r6("prediction", "predicted"))


def _counts(spark, d):
    """Orders of nations by month with split, month and two figures of the nation."""
    j = panel(spark, d).join(zones(spark, d).select("zone_id", "population", "balance"), "zone_id")
    return j.withColumn("month", F.substring(O, 6, 2).cast("int")).withColumn("split", sp.temporal(F.col(O), TRAIN_END, VALIDATION_END))


ALPHAS = (0.0, 1.0, 100.0, 10_000.0)


@query(
    "r195_ridge_path",
    f"""WITH {PANEL}, {ZONES}, j AS (SELECT {SPLIT} AS split, population * 1.0 AS a, CAST(substr(period_month, 6, 2) AS INTEGER) * 1.0 AS b, y * 1.0 AS y FROM panel JOIN zones USING (zone_id)),
    t AS (SELECT * FROM j WHERE split = 'train'), s AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb, covar_pop(a, b) AS cab, covar_pop(a, y) AS cay, covar_pop(b, y) AS cby FROM t),
    w AS (SELECT *, n + alpha AS d, n * cab / (sa * sb) AS o, n * cay / sa AS p, n * cby / sb AS q FROM s, (VALUES (0.0), (1.0), (100.0), (10000.0)) v(alpha)),
    c AS (SELECT alpha, (p * d - q * o) / (d * d - o * o) / sa AS wa, (q * d - p * o) / (d * d - o * o) / sb AS wb, ma, mb, my FROM w),
    e AS (SELECT alpha, wa, wb, my - wa * ma - wb * mb AS b0 FROM c), l AS (SELECT alpha, avg(pow(y - b0 - wa * a - wb * b, 2)) AS loss FROM e, j WHERE split = 'validation' GROUP BY 1)
    SELECT alpha, round(wa, 6) AS population, round(wb, 6) AS month, round(b0, 6) AS intercept, round(loss, 6) AS loss, loss = (SELECT min(loss) FROM l) AS chosen FROM e JOIN l USING (alpha)""",
)
def _(spark, d):
    m = mo.ridge_path(_counts(spark, d), ["population", "month"], "y", list(ALPHAS))
    rows = [(a, round(w[0], 6), round(w[1], 6), round(b, 6), round(loss, 6), k == m.best) for k, (a, w, b, loss) in enumerate(zip(m.alphas, m.weights, m.intercepts, m.losses, strict=True))]
    return spark.createDataFrame(rows, "alpha double, population double, month double, intercept double, loss double, chosen boolean")


@query(
    "r195_poisson_path",
    f"""WITH {PANEL}, {ZONES}, j AS (SELECT {SPLIT} AS split, population, y FROM panel JOIN zones USING (zone_id)), t AS (SELECT * FROM j WHERE split = 'train')
    SELECT 'gradient' AS what, 0.0 AS v UNION ALL SELECT 'total', round(sum(y), 4) FROM t UNION ALL SELECT 'weights shrink', 1.0""",
)
def _(spark, d):
    """What holds at the optimum: the slope without a penalty is 0, totals agree, and a larger penalty gives smaller weights."""
    c = _counts(spark, d)
    m = mo.poisson_path(c, ["population", "month"], "y", [0.0, 0.1, 10.0])
    t = c.where("split = 'train'").withColumn("mu", m.predict(0))
    s = t.agg(F.sum((F.col("y") - F.col("mu")) * F.col("population")).alias("g"), F.sum("mu").alias("total")).first()
    size = [abs(w[0]) + abs(w[1]) for w in m.weights]
    rows = [("gradient", round(abs(s.g), 3)), ("total", round(s.total, 4)), ("weights shrink", float(size[0] > size[1] > size[2]))]
    return spark.createDataFrame(rows, "what string, v double")


@query(
    "r196_boosted_counts",
    f"""WITH {PANEL}, {ZONES}, t AS (SELECT population * 1.0 AS population, CAST(substr(period_month, 6, 2) AS INTEGER) * 1.0 AS month, y * 1.0 AS y FROM panel JOIN zones USING (zone_id) WHERE {SPLIT} = 'train'),
    b AS (SELECT avg(y) AS mu, count(*) AS n FROM t), f AS (SELECT 0 AS k, population AS x, y FROM t UNION ALL SELECT 1, month, y FROM t),
    r AS (SELECT k, x, row_number() OVER (PARTITION BY k ORDER BY x) AS i, count(*) OVER (PARTITION BY k) AS n FROM f),
    cuts AS (SELECT DISTINCT k, x AS cut FROM r, generate_series(1, 7) s(s) WHERE i = greatest(1, ceil(s / 8.0 * n))),
    g AS (SELECT c.k, cut, count(*) FILTER (x <= cut) AS nl, count(*) FILTER (x > cut) AS nr, sum(mu - y) FILTER (x <= cut) AS gl, sum(mu - y) FILTER (x > cut) AS gr, any_value(mu) AS mu FROM cuts c JOIN f USING (k), b GROUP BY 1, 2),
    v AS (SELECT *, round((gl * gl / (mu * nl) + gr * gr / (mu * nr) - (gl + gr) * (gl + gr) / (mu * (nl + nr))) / 2, 9) AS gain FROM g WHERE nl >= 20 AND nr >= 20)
    SELECT CASE k WHEN 0 THEN 'population' ELSE 'month' END AS feature, cut, round(gain, 6) AS gain, round(-0.1 * gl / (mu * nl), 6) AS left_value, round(-0.1 * gr / (mu * nr), 6) AS right_value, true AS falls
    FROM v ORDER BY v.gain DESC, k, cut LIMIT 1""",
)
def _(spark, d):
    """The first tree's first split, and whether boosting lowers the validation loss."""
    m = mo.boost(_counts(spark, d), ["population", "month"], "y", trees=6, depth=1, bins=8, patience=6)
    t = m.trees[0]
    row = (m.features[t.feature[0]], t.cut[0], round(t.gain[0], 6), round(t.value[t.left[0]], 6), round(t.value[t.right[0]], 6), bool(min(m.losses[1:]) < m.losses[0]))
    return spark.createDataFrame([row], "feature string, cut double, gain double, left_value double, right_value double, falls boolean")


@query("r196_tree_models")
def _(spark, d):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    j = panel(spark, d).join(zones(spark, d).drop("period_month"), "zone_id")
    v = VectorAssembler(inputCols=["population", *FOUR], outputCol="features").transform(j)
    m = RandomForestRegressor(labelCol="y", numTrees=10, maxDepth=4, seed=42).fit(v.where(F.col(O) <= TRAIN_END))
    return m.transform(v).select("zone_id", O, r6("prediction", "predicted"))


# -- splits -------------------------------------------------------------------------------------


@query("r200_temporal_split", f"WITH {PANEL} SELECT zone_id, period_month, {SPLIT} AS split FROM panel")
def _(spark, d):
    return panel(spark, d).select("zone_id", O, sp.temporal(F.col(O), TRAIN_END, VALIDATION_END).alias("split"))


@query(
    "r201_random_split",
    "SELECT 'train' AS split, CAST(round_even(count(*) * 0.7, 0) AS BIGINT) AS n FROM customer UNION ALL SELECT 'validation', CAST(round_even(count(*) * 0.15, 0) AS BIGINT) FROM customer UNION ALL SELECT 'test', CAST(count(*) - round_even(count(*) * 0.7, 0) - round_even(count(*) * 0.15, 0) AS BIGINT) FROM customer",
)
def _(spark, d):
    return sp.random_rows(table(spark, d, "customer"), "c_custkey").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("r202_spatial_blocks")
def _(spark, d):
    return sp.spatial_blocks(table(spark, d, "supplier").withColumn("y", F.col("s_suppkey") * 37 % 101), "s_suppkey", "s_acctbal", "y")


@query(
    "r203_leaking_columns",
    f"""WITH {PANEL}, w AS (SELECT y, lag(y) OVER w AS y_lag_1, lead(y) OVER w AS target_next_1, total AS share_water_drainage_lag FROM panel WINDOW w AS (PARTITION BY zone_id ORDER BY period_month))
    SELECT 'y' AS column_name, count(y) AS n FROM w UNION ALL SELECT 'target_next_1', count(target_next_1) FROM w UNION ALL SELECT 'share_water_drainage_lag', count(share_water_drainage_lag) FROM w""",
)
def _(spark, d):
    """Of a table of features, the columns that a forecast must not use, with the values that they hold."""
    w = Window.partitionBy("zone_id").orderBy(O)
    t = panel(spark, d).select("zone_id", "y", F.lag("y").over(w).alias("y_lag_1"), F.lead("y").over(w).alias("target_next_1"), F.col("total").alias("share_water_drainage_lag"))
    found = sp.leaking_columns(t.columns, "y")
    held = t.agg(*[F.count(c).alias(c) for c in found])
    return held.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in found])).alias("s")).select("s.*")


# -- validators ---------------------------------------------------------------------------------


@query(
    "r205_feature_table_issues",
    "SELECT * FROM (VALUES ('missing_values_detected', 'value', 'error', (SELECT count(*) FROM events WHERE value <= 10)), ('nonnumeric_variable', 'event_type', 'error', 1), ('duplicate_spatial_ids', 'user_id', 'error', (SELECT count(*) - count(DISTINCT user_id) FROM events)), ('missing_required_variable', 'absent', 'error', 1)) t(code, \"column\", severity, n) UNION ALL SELECT 'high_missingness', 'value', 'warning', count(*) FROM events WHERE value <= 10 HAVING count(*) >= 0.2 * (SELECT count(*) FROM events)",
)
def _(spark, d):
    e = table(spark, d, "events").withColumn("value", F.when(F.col("value") > 10, F.col("value")))
    return va.feature_table(e, "user_id", {"value": "number", "event_type": "number", "absent": "number"})


@query(
    "r208_panel_checks",
    f"WITH {PANEL} SELECT * FROM (VALUES ('repeated_keys', 0), ('missing_cells', (SELECT count(DISTINCT zone_id) * count(DISTINCT period_month) - count(*) FROM panel)), ('negative_target', 0), ('missing_target', 0)) t(\"check\", n)",
)
def _(spark, d):
    return va.panel(panel(spark, d), "zone_id", O, "y")


@query("r209_split_checks", "SELECT * FROM (VALUES ('repeated_keys', 0), ('missing_split', 0), ('absent_parts', 0), ('mixed_zones', 25)) t(\"check\", n)")
def _(spark, d):
    p = panel(spark, d).withColumn("split", sp.temporal(F.col(O), TRAIN_END, VALIDATION_END))
    return va.splits(p, "zone_id", O, "split", constant_in_zone=True)


# -- graphs -------------------------------------------------------------------------------------


def _nodes(spark, d):
    p = panel(spark, d).withColumn("m", s.month_ordinal(F.col(O))).withColumn("split", sp.temporal(F.col(O), TRAIN_END, VALIDATION_END))
    return p.withColumn("node_id", F.col("m") * 100 + F.col("zone_id"))


def _pairs(spark, d):
    n = spark.range(25).select(F.col("id").cast("int").alias("source"))
    return n.withColumn("target", F.explode(F.array((F.col("source") + 1) % 25, (F.col("source") + 5) % 25))).withColumn(
        "edge_weight",
        F.when(F.col("target") == (F.col("source") + 1) % 25, 1.0).otherwise(0.5),
    )


_N = f"""{PANEL}, nodes AS (SELECT *, CAST(left(period_month, 4) AS INTEGER) * 12 + CAST(right(period_month, 2) AS INTEGER) - 1 AS m, {SPLIT} AS split FROM panel), n AS (SELECT *, CAST(m * 100 + zone_id AS BIGINT) AS node_id FROM nodes),
    pairs AS (SELECT CAST(i AS INTEGER) AS source, CAST((i + k) % 25 AS INTEGER) AS target, CASE k WHEN 1 THEN 1.0 ELSE 0.5 END AS w FROM generate_series(0, 24) t(i), (VALUES (1), (5)) u(k)),
    edges AS (SELECT a.node_id AS source, b.node_id AS target, 'knn' AS edge_type, CAST(w AS DOUBLE) AS edge_weight FROM pairs JOIN n a ON a.zone_id = source JOIN n b ON b.zone_id = target AND a.m = b.m
        UNION ALL SELECT a.node_id, b.node_id, 'lag_1', 1.0 FROM n a JOIN n b ON a.zone_id = b.zone_id AND b.m = a.m + 1)"""


def _edges(spark, d, nodes):
    knn = g.month_edges(_pairs(spark, d), nodes, "zone_id", "m", "knn")
    return fr.union_all(knn, g.lag_edges(nodes, "zone_id", "m", 1))


@query("r046_month_edges", f"WITH {_N} SELECT source, target, edge_type, edge_weight FROM edges WHERE edge_type = 'knn'")
def _(spark, d):
    return g.month_edges(_pairs(spark, d), _nodes(spark, d), "zone_id", "m", "knn")


@query("r047_lag_edges", f"WITH {_N} SELECT source, target, edge_type, edge_weight FROM edges WHERE edge_type = 'lag_1'")
def _(spark, d):
    return g.lag_edges(_nodes(spark, d), "zone_id", "m", 1)


@query(
    "r048_annotated_edges",
    f"WITH {_N} SELECT e.source, e.target, a.split AS source_split, b.split AS target_split, a.split <> b.split AS crosses_split, a.split = 'train' AND b.split = 'train' AS train_train, a.split = 'test' OR b.split = 'test' AS touches_test FROM edges e JOIN n a ON a.node_id = e.source JOIN n b ON b.node_id = e.target",
)
def _(spark, d):
    n = _nodes(spark, d)
    return g.annotate(_edges(spark, d, n), n, "split").select(
        "source",
        "target",
        "source_split",
        "target_split",
        "crosses_split",
        "train_train",
        "touches_test",
    )


@query(
    "r084_degrees",
    f"WITH {_N} SELECT node_id, (SELECT count(*) FROM edges WHERE target = node_id) AS in_degree, (SELECT count(*) FROM edges WHERE source = node_id) AS out_degree, NOT EXISTS (SELECT 1 FROM edges WHERE source = node_id OR target = node_id) AS isolated FROM n",
)
def _(spark, d):
    n = _nodes(spark, d)
    return g.degrees(n, _edges(spark, d, n))


@query(
    "r104_mutual_flag",
    "WITH p AS (SELECT DISTINCT l_partkey AS source, l_suppkey AS target FROM lineitem) SELECT source, target, EXISTS (SELECT 1 FROM p q WHERE q.source = p.target AND q.target = p.source) AS mutual FROM p",
)
def _(spark, d):
    """Parts point to their suppliers; numbers that point to each other are mutual."""
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"))
    return g.mutual(lines, rows=lines.count()).distinct()


@query(
    "r114_edge_table",
    f"WITH {_N} SELECT source, target, edge_type, CAST(row_number() OVER (ORDER BY edge_type, source, target) - 1 AS BIGINT) AS edge_id FROM edges",
)
def _(spark, d):
    n = _nodes(spark, d)
    return g.edge_table(_edges(spark, d, n)).select("source", "target", "edge_type", "edge_id")


@query("r161_placebo_edges")
def _(spark, d):
    n = _nodes(spark, d)
    return g.placebo_edges(g.month_edges(_pairs(spark, d), n, "zone_id", "m", "knn"), n, "m")


@query(
    "r162_connected_components",
    "WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, o_custkey // 7 * 7 AS b FROM orders WHERE o_custkey % 7 <> 0) SELECT a AS node, b AS component FROM e UNION SELECT b, b FROM e",
)
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("source"), (F.floor(F.col("o_custkey") / 7) * 7).alias("target")).where("source <> target")
    return g.connected(o)


@query(
    "r164_leakage_audit",
    f"WITH {_N} SELECT 'future_to_past' AS \"check\", 0 AS violations UNION ALL SELECT 'spatial_across_months', 0 UNION ALL SELECT 'test_into_train', 0",
)
def _(spark, d):
    n = _nodes(spark, d)
    return g.leakage_audit(_edges(spark, d, n), n, "m", "split")


@query("r165_edge_regime", f"WITH {_N} SELECT source, target FROM edges WHERE edge_type = 'lag_1'")
def _(spark, d):
    n = _nodes(spark, d)
    return g.regime(_edges(spark, d, n), "temporal").select("source", "target")


@query(
    "r166_weighted_neighbour_mean",
    f"WITH {_N} SELECT t.node_id, k.edge_type, round(coalesce(sum(greatest(edge_weight, 0) * s.y) / greatest(sum(greatest(edge_weight, 0)), 1.0), 0), 6) AS y_near FROM n t CROSS JOIN (VALUES ('knn'), ('lag_1')) k(edge_type) LEFT JOIN edges e ON e.target = t.node_id AND e.edge_type = k.edge_type LEFT JOIN n s ON s.node_id = e.source GROUP BY 1, 2",
)
def _(spark, d):
    n = _nodes(spark, d)
    return g.neighbour_mean(_edges(spark, d, n), n.select("node_id", "y"), ["y"], by_type=True).withColumn("y_near", r6("y_near"))


@query(
    "r167_neighbour_mean",
    f"WITH {_N} SELECT t.node_id, round(coalesce(sum(s.y), 0) / greatest(count(s.y), 1), 6) AS y_near FROM n t LEFT JOIN edges e ON e.target = t.node_id LEFT JOIN n s ON s.node_id = e.source GROUP BY 1",
)
def _(spark, d):
    n = _nodes(spark, d)
    return g.neighbour_mean(_edges(spark, d, n), n.select("node_id", "y"), ["y"], weighted=False).withColumn("y_near", r6("y_near"))


@query(
    "r211_edge_checks",
    "SELECT * FROM (VALUES ('self_loops', 0), ('repeated_edges', 0), ('bad_weights', 0), ('unknown_types', 0), ('unknown_ends', 0)) t(\"check\", n)",
)
def _(spark, d):
    n = _nodes(spark, d)
    return va.edges(_edges(spark, d, n), n)


@query(
    "r214_segments",
    "SELECT CAST(i AS BIGINT) AS segment, count(value) AS n, round(coalesce(sum(value), 0), 2) AS sum, round(coalesce(avg(value), 0), 6) AS mean, coalesce(max(value), 0) AS max, count(value) > 0 AS present FROM (SELECT unnest(generate_series(0, greatest(199, (SELECT max(user_id) FROM events)))) AS i) LEFT JOIN events ON user_id = i GROUP BY 1",
)
def _(spark, d):
    e = table(spark, d, "events")
    last = e.agg(F.max("user_id")).first()[0]
    x = g.segments(e, "user_id", "value", 200 if last is None else max(200, last + 1))
    return x.withColumn("sum", F.round("sum", 2)).withColumn("mean", r6("mean"))


@query(
    "r215_grouped_softmax",
    "SELECT event_id, round(exp(value / 100 - max(value / 100) OVER w) / sum(e) OVER w, 6) AS p FROM (SELECT *, exp(value / 100 - max(value / 100) OVER (PARTITION BY user_id)) AS e FROM events) WINDOW w AS (PARTITION BY user_id)",
)
def _(spark, d):
    e = table(spark, d, "events").withColumn("x", F.col("value") / 100)
    return g.softmax(e, "x", ["user_id"], "p").select("event_id", r6("p", "p"))


@query("r219_relation_gate", "SELECT p_partkey, round(1 / (1 + exp(-((p_size * 0.1 + p_retailprice * 0.001) / sqrt(2) + 0.5))), 6) AS gate FROM part")
def _(spark, d):
    left = F.array(F.col("p_size").cast("double"), F.col("p_retailprice"))
    return table(spark, d, "part").select("p_partkey", r6(g.gate(left, F.array(F.lit(0.1), F.lit(0.001)), 0.5), "gate"))


@query(
    "r220_masked_mean",
    f"WITH {PANEL}, l AS (SELECT zone_id, period_month, lag(y, 1) OVER z AS a, lag(y, 12) OVER z AS b FROM panel WINDOW z AS (PARTITION BY zone_id ORDER BY period_month)) SELECT zone_id, period_month, round((coalesce(a, 0) + coalesce(b, 0)) / nullif(CAST(a IS NOT NULL AS INTEGER) + CAST(b IS NOT NULL AS INTEGER), 0), 6) AS mean FROM l",
)
def _(spark, d):
    from zonalyx.functions.windows import lag

    p = panel(spark, d).withColumn("a", lag("y", 1, ["zone_id"], O)).withColumn("b", lag("y", 12, ["zone_id"], O))
    p = p.withColumn("am", F.col("a").isNotNull()).withColumn("bm", F.col("b").isNotNull())
    return p.select("zone_id", O, r6(g.masked_mean(["a", "b"], ["am", "bm"]), "mean"))


@query(
    "r222_horizon_features",
    "SELECT p_partkey, round(ln(1 + p_size), 6) AS h_log, round(sin(ln(1 + p_size)), 6) AS h_sin_0, round(cos(ln(1 + p_size) / 2), 6) AS h_cos_1 FROM part",
)
def _(spark, d):
    f = s.horizon_features(F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", r6(f[0], "h_log"), r6(f[1], "h_sin_0"), r6(f[4], "h_cos_1"))


@query(
    "r223_state_fusion",
    f"WITH {ZONES} SELECT zone_id, CAST(4 AS BIGINT) AS width, round(population + balance + debt_share + spread, 4) AS total FROM zones",
)
def _(spark, d):
    z = zones(spark, d)
    a, b = fr.feature_vector(z, ["population", "balance"], "a").select("zone_id", "a"), fr.feature_vector(
        z,
        ["debt_share", "spread"],
        "b",
    ).select("zone_id", "b")
    v = fr.left_join(a, b, ["zone_id"], "1:1").withColumn("v", F.concat("a", "b"))
    return v.select("zone_id", F.size("v").cast("long").alias("width"), F.round(F.aggregate("v", F.lit(0.0), lambda x, y: x + y), 4).alias("total"))


@query("r225_content_fingerprint", "SELECT n_nationkey, sha256('{\"name\":\"' || n_name || '\",\"region\":' || n_regionkey || '}') AS fingerprint FROM nation")
def _(spark, d):
    return table(spark, d, "nation").select(
        "n_nationkey",
        F.sha2(F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))), 256).alias("fingerprint"),
    )


QUERIES, ORACLE_SQL = query.queries, query.sql
