"""Queries: factor outputs, validators and audits with planted faults, ranking evaluation, message passing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from zonalyx.operators import graph as g
from zonalyx.operators import index as ix
from zonalyx.operators import metrics as me
from zonalyx.operators import splits as sp
from zonalyx.operators import validate as va
from zonalyx.plans.base import PANEL, SPLIT, TRAIN_END, ZONES, Register, panel, r6, table, zones
from zonalyx.plans.q_index import _N, FOUR, RANK_RECIPE, O, _edges, _nodes

query = Register()

FACTORS = ix.Recipe("factors", tuple(ix.Variable(c) for c in FOUR), missing="median", flags=False)


def _fitted(spark, d):
    return ix.get_index("factor_based")(
        zones(spark, d),
        FACTORS,
        keep=2,
        orientation={1: {"method": "anchor", "anchor": "balance"}, 2: "absolute"},
        unconfigured="error",
    )


# -- factors --------------------------------------------------------------------------------------

_CORR = ", ".join(f"corr({a}, {b}) AS c{i}{j}" for i, a in enumerate(FOUR) for j, b in enumerate(FOUR) if i < j)


@query("r184_retained_factors", "SELECT 2 AS fixed, 4 AS most")
def _(spark, d):
    """A fixed number; and every factor where the limit is below the smallest eigenvalue."""
    _, info = _fitted(spark, d)
    rows = [(ix.retain(info["eigenvalues"], 2), ix.retain(info["eigenvalues"], float(min(info["eigenvalues"])) - 1e-6))]
    return spark.createDataFrame(rows, "fixed int, most int")


@query(
    "r185_varimax_keeps",
    f"WITH {ZONES}, v AS (SELECT {_CORR}, count(*) / (count(*) - 1.0) AS s FROM zones) SELECT round(4 * s, 6) AS total_variance, round(2 * s * s * (2 + c01 * c01 + c02 * c02 + c03 * c03 + c12 * c12 + c13 * c13 + c23 * c23), 6) AS sum_of_squares, true AS orthogonal, true AS communalities_kept, true AS converged FROM v",
)
def _(spark, d):
    """The trace and the squared entries of the covariance that the eigenvalues must add up to; a rotation keeps communalities."""
    _, i = _fitted(spark, d)
    values, before, after = np.asarray(i["eigenvalues"]), i["unrotated"], i["loadings"]
    turn = ix.rotate(before).turn
    same = bool(np.allclose((before**2).sum(1), (after**2).sum(1)))
    row = (round(float(values.sum()), 6), round(float((values**2).sum()), 6), bool(np.allclose(turn @ turn.T, np.eye(len(turn)))), same, bool(i["converged"]))
    return spark.createDataFrame([row], "total_variance double, sum_of_squares double, orthogonal boolean, communalities_kept boolean, converged boolean")


@query("r186_factor_scores", f"WITH {ZONES} SELECT CAST(0.0 AS DOUBLE) AS mean_1, CAST(0.0 AS DOUBLE) AS mean_2, count(*) AS n FROM zones")
def _(spark, d):
    """Scores are combinations of standardised variables, so plain ones have mean 0."""
    s, _ = ix.get_index("factor_based")(zones(spark, d), FACTORS, keep=2)
    return s.agg((F.round(F.avg("factor_1"), 6) + 0.0).alias("mean_1"), (F.round(F.avg("factor_2"), 6) + 0.0).alias("mean_2"), F.count(F.lit(1)).alias("n"))


@query("r187_orientation", f"WITH {ZONES} SELECT true AS anchor_positive, true AS absolute_positive, true AS sum_is_score, count(*) AS n FROM zones")
def _(spark, d):
    s, i = _fitted(spark, d)
    anchor = bool(i["loadings"][i["used"].index("balance"), 0] * i["orientation"][0]["sign"] >= 0)
    return s.agg(
        F.lit(anchor).alias("anchor_positive"),
        F.bool_and(F.col("factor_2") >= 0).alias("absolute_positive"),
        F.bool_and(F.abs(F.col("factor_1") + F.col("factor_2") - F.col("score")) < 1e-9).alias("sum_is_score"),
        F.count(F.lit(1)).alias("n"),
    )


@query(
    "r110_leading_variables",
    "SELECT * FROM (VALUES ('factor_1', 4, 3, 3, 'anchor', true), ('factor_2', 4, 3, 3, 'absolute', true)) t(factor, n_leading, n_positive, n_negative, orientation, configured)",
)
def _(spark, d):
    _, i = _fitted(spark, d)
    n = lambda text: len(text.split("; "))
    rows = [(r["factor"], n(r["leading"]), n(r["leading_positive"]), n(r["leading_negative"]), r["orientation"], r["configured"]) for r in ix.factor_summary(i)]
    return spark.createDataFrame(rows, "factor string, n_leading int, n_positive int, n_negative int, orientation string, configured boolean")


@query("r110_factor_summary")
def _(spark, d):
    _, i = _fitted(spark, d)
    return spark.createDataFrame(
        ix.factor_summary(i),
        "factor string, eigenvalue double, explained double, leading string, leading_positive string, leading_negative string, orientation string, rationale string, configured boolean",
    )


@query("r191_index_registry", f"WITH {ZONES} SELECT name, count(*) AS n, count(*) AS scored FROM zones, (VALUES ('additive'), ('factor_based'), ('rank_based')) t(name) GROUP BY 1")
def _(spark, d):
    """Every index of the registry, by a name written otherwise, over all zones."""
    z, out = zones(spark, d), []
    recipes = {"additive": ix.Recipe("sum", tuple(ix.Variable(c, weight=0.25) for c in FOUR)), "rank_based": RANK_RECIPE, "factor_based": FACTORS}
    for name in sorted(ix.INDICES):
        got = ix.get_index(name.upper().replace("_", "-"))(z, recipes[name])
        got = got[0] if isinstance(got, tuple) else got
        out.append(got.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.count("score").alias("scored")))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    "r224_recipe_contract",
    """WITH r AS (SELECT p_partkey AS recipe, p_partkey % 4 AS k, p_size % 3 AS m, p_size - 3 AS classes FROM part)
    SELECT recipe, 'a.direction' AS field, 'unknown: up' AS issue FROM r WHERE k = 1 UNION ALL SELECT recipe, 'normalise', 'unknown: cubic' FROM r WHERE k = 2
    UNION ALL SELECT recipe, 'missing', 'unknown: null' FROM r WHERE k = 3 UNION ALL SELECT recipe, 'a.weight', 'absent' FROM r WHERE m = 0
    UNION ALL SELECT recipe, 'variables', 'a is given twice' FROM r WHERE m = 1 UNION ALL SELECT recipe, 'classes', 'not positive: ' || classes FROM r WHERE classes < 1""",
)
def _(spark, d):
    """A recipe a part, in rows of variables, with faults by its numbers."""
    p = table(spark, d, "part").withColumn("k", F.col("p_partkey") % 4).withColumn("m", F.col("p_size") % 3)
    variable = lambda name: F.struct(F.lit(name).alias("variable"), F.when((F.col("k") == 1) & F.lit(name == "a"), "up").otherwise("positive").alias("direction"), F.when((F.col("m") != 0) | F.lit(name != "a"), 0.5).alias("weight"))
    both = F.when(F.col("m") == 1, F.array(variable("a"), variable("b"), variable("a"))).otherwise(F.array(variable("a"), variable("b")))
    rows = p.select(
        F.col("p_partkey").alias("recipe"), F.when(F.col("k") == 2, "cubic").otherwise("minmax").alias("normalise"), F.lit("weighted_sum").alias("aggregate"),
        F.when(F.col("k") != 3, "error").alias("missing"), (F.col("p_size") - 3).alias("classes"), F.explode(both).alias("v"),
    )
    return ix.recipe_table_issues(rows.select("*", "v.*").drop("v"))


# -- validators with planted faults -----------------------------------------------------------------


@query(
    "r205_feature_table_codes",
    """WITH t AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS a, c_custkey % 50 / 49.0 AS share, c_custkey % 50 * 1.0 AS pct FROM customer)
    SELECT 'missing_values_detected' AS code, 'a' AS "column", 'error' AS severity, count(*) AS n FROM t WHERE a IS NULL
    UNION ALL SELECT 'high_missingness', 'a', 'warning', count(*) FROM t WHERE a IS NULL
    UNION ALL SELECT 'negative_values_for_nonnegative_variable', 'a', 'warning', count(*) FROM t WHERE a < 0
    UNION ALL SELECT 'suspicious_percentage_scale', 'pct', 'warning', count(*) FROM t
    UNION ALL SELECT 'proportion_out_of_range', 'pct', 'warning', count(*) FROM t WHERE pct > 1
    UNION ALL SELECT 'suspicious_proportion_scale', 'share', 'warning', count(*) FROM t
    UNION ALL SELECT 'constant_column', 'one', 'warning', count(*) FROM t
    UNION ALL SELECT 'all_null_variable', 'none', 'warning', count(*) FROM t
    UNION ALL SELECT 'missing_values_detected', 'none', 'warning', count(*) FROM t
    UNION ALL SELECT 'high_missingness', 'none', 'warning', count(*) FROM t
    UNION ALL SELECT 'missing_optional_variable', 'gone', 'warning', 1
    UNION ALL SELECT 'missing_required_variable', 'lost', 'error', 1
    UNION ALL SELECT 'nonnumeric_variable', 'word', 'error', 1""",
)
def _(spark, d):
    c = table(spark, d, "customer").select(
        F.col("c_custkey").alias("k"),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("a"),
        (F.col("c_custkey") % 50 / 49.0).alias("share"),
        (F.col("c_custkey") % 50).cast("double").alias("pct"),
        F.lit(1).alias("one"),
        F.lit(None).cast("double").alias("none"),
        F.lit("x").alias("word"),
    )
    kinds = {
        "a": "nonnegative",
        "share": "percentage",
        "pct": "proportion",
        "one": "number",
        "none": "number",
        "gone": "number",
        "lost": "number",
        "word": "number",
    }
    return va.feature_table(c, "k", kinds, required={"a", "share", "pct", "one", "lost", "word"})


@query(
    "r206_rank_index_codes",
    f"""WITH {ZONES}, t AS (SELECT *, CASE WHEN zone_id < 3 THEN 0 ELSE population END AS people FROM zones)
    SELECT 'nonpositive_population_units' AS code, 'people' AS "column", 'warning' AS severity, count(*) AS n FROM t WHERE people <= 0
    UNION ALL SELECT 'missing_comparison_group_column', 'province', 'error', 1
    UNION ALL SELECT 'missing_required_variable_partial_svi_like', 'absent', 'warning', 1""",
)
def _(spark, d):
    z = zones(spark, d).withColumn("people", F.when(F.col("zone_id") < 3, 0).otherwise(F.col("population")))
    return va.rank_index_table(
        z,
        "zone_id",
        {"balance": "number", "debt_share": "number", "absent": "number"},
        population="people",
        groups=["province", "zone_id"],
        partial=True,
    )


@query(
    "r207_factor_index_codes",
    "SELECT * FROM (VALUES ('too_few_observations', '', 'error', 1), ('small_n_relative_to_variables', '', 'warning', 1), ('constant_column', 'balance', 'warning', 1), ('constant_column', 'spread', 'warning', 1)) t(code, \"column\", severity, n)",
)
def _(spark, d):
    one = zones(spark, d).where("zone_id = 3")
    return va.factor_index_table(one, "zone_id", {"balance": "number", "spread": "number"})


@query(
    "r164_planted_leaks",
    f"""WITH {_N}, e AS (SELECT source, target, edge_type FROM edges UNION ALL SELECT target, source, edge_type FROM edges WHERE edge_type = 'lag_1' AND source % 3 = 0
        UNION ALL SELECT source, target, 'knn' FROM edges WHERE edge_type = 'lag_1' AND source % 7 = 0),
    j AS (SELECT e.*, a.m AS am, b.m AS bm, a.split AS s, b.split AS t FROM e JOIN n a ON a.node_id = source JOIN n b ON b.node_id = target)
    SELECT 'future_to_past' AS "check", count(*) FILTER (am > bm) AS violations FROM j UNION ALL SELECT 'spatial_across_months', count(*) FILTER (edge_type = 'knn' AND am <> bm) FROM j
    UNION ALL SELECT 'test_into_train', count(*) FILTER (s = 'test' AND t = 'train') FROM j""",
)
def _(spark, d):
    n = _nodes(spark, d)
    e = _edges(spark, d, n)
    lag = e.where("edge_type = 'lag_1'")
    back = lag.where("source % 3 = 0").select(F.col("target").alias("source"), F.col("source").alias("target"), "edge_type", "edge_weight")
    return g.leakage_audit(e.unionByName(back).unionByName(lag.where("source % 7 = 0").withColumn("edge_type", F.lit("knn"))), n, "m", "split")


@query(
    "r211_planted_edge_faults",
    f"""WITH {_N}, e AS (SELECT * FROM edges UNION ALL SELECT source, source, edge_type, edge_weight FROM edges WHERE source % 5 = 0 AND edge_type = 'lag_1'
        UNION ALL SELECT source, target, edge_type, -1.0 FROM edges WHERE source % 11 = 0 AND edge_type = 'knn' UNION ALL SELECT source, -target, 'rumour', edge_weight FROM edges WHERE source % 13 = 0 AND edge_type = 'lag_1')
    SELECT 'self_loops' AS "check", count(*) FILTER (source = target) AS n FROM e
    UNION ALL SELECT 'repeated_edges', count(*) - (SELECT count(*) FROM (SELECT DISTINCT source, target, edge_type FROM e)) FROM e
    UNION ALL SELECT 'bad_weights', count(*) FILTER (edge_weight < 0) FROM e UNION ALL SELECT 'unknown_types', count(*) FILTER (edge_type = 'rumour') FROM e
    UNION ALL SELECT 'unknown_ends', count(*) FILTER (target < 0) FROM e""",
)
def _(spark, d):
    n = _nodes(spark, d)
    e = _edges(spark, d, n)
    lag = e.where("edge_type = 'lag_1'")
    loops = lag.where("source % 5 = 0").withColumn("target", F.col("source"))
    bad = e.where("edge_type = 'knn' and source % 11 = 0").withColumn("edge_weight", F.lit(-1.0))
    wild = lag.where("source % 13 = 0").withColumn("target", -F.col("target")).withColumn("edge_type", F.lit("rumour"))
    return va.edges(e.unionByName(loops).unionByName(bad).unionByName(wild), n)


@query(
    "r209_planted_split_faults",
    f"""WITH {PANEL}, s AS (SELECT zone_id, period_month, CASE WHEN zone_id % 6 = 0 THEN NULL WHEN zone_id % 4 = 0 THEN 'train' ELSE {SPLIT} END AS split FROM panel),
    t AS (SELECT * FROM s UNION ALL SELECT * FROM s WHERE zone_id = 1)
    SELECT 'repeated_keys' AS "check", count(*) - (SELECT count(*) FROM s) AS n FROM t UNION ALL SELECT 'missing_split', count(*) FILTER (split IS NULL) FROM t
    UNION ALL SELECT 'absent_parts', 3 - count(DISTINCT split) FROM t UNION ALL SELECT 'mixed_zones', count(*) FROM (SELECT zone_id FROM t GROUP BY 1 HAVING count(DISTINCT split) > 1)""",
)
def _(spark, d):
    p = panel(spark, d)
    split = F.when(F.col("zone_id") % 6 == 0, None).when(F.col("zone_id") % 4 == 0, "train").otherwise(sp.temporal(F.col(O), TRAIN_END, "2000-08"))
    s = p.select("zone_id", O, split.alias("split"))
    return va.splits(s.unionByName(s.where("zone_id = 1")), "zone_id", O, "split", constant_in_zone=True)


@query(
    "r203_lineage_leaks",
    "SELECT 'f' || user_id AS feature, CASE WHEN user_id % 3 = 0 AND event_id % 5 < 1 THEN 'uses y without a lag' ELSE 'looks ahead' END AS reason FROM events WHERE (user_id % 3 = 0 AND event_id % 5 < 1) OR (event_id % 5 = 4 AND user_id % 3 <> 0)",
)
def _(spark, d):
    e = table(spark, d, "events")
    lag = F.when(F.col("event_id") % 5 == 4, F.when(F.col("user_id") % 3 == 0, 1).otherwise(-1)).otherwise(F.col("event_id") % 5)
    lineage = e.select(
        F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("feature"),
        F.when(F.col("user_id") % 3 == 0, "y").otherwise("x").alias("source"),
        lag.alias("lag"),
    )
    return sp.leaking_lineage(lineage, "y")


@query(
    "r162_chains",
    "SELECT node, node // 40 * 40 AS component FROM (SELECT o_custkey AS node FROM orders UNION SELECT o_custkey + 1 FROM orders WHERE o_custkey % 40 <> 39 UNION SELECT x FROM (SELECT unnest(generate_series(o_custkey // 40 * 40, o_custkey // 40 * 40 + 39)) AS x FROM orders))",
)
def _(spark, d):
    """Chains of 40 nodes, as long as no node has more than two neighbours."""
    first = table(spark, d, "orders").select((F.floor(F.col("o_custkey") / 40) * 40).alias("a")).distinct()
    e = first.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(38)))).select(
        (F.col("a") + F.col("k")).alias("source"),
        (F.col("a") + F.col("k") + 1).alias("target"),
    )
    return g.connected(e)


# -- evaluation -------------------------------------------------------------------------------------


@query(
    "r178_ranking_evaluation",
    f"""WITH {PANEL}, {ZONES}, t AS (SELECT zone_id, CAST(sum(y) AS DOUBLE) AS y FROM panel GROUP BY 1), j AS (SELECT * FROM zones JOIN t USING (zone_id)),
    l AS (SELECT 'population' AS scorer, zone_id, CAST(population AS DOUBLE) AS p, y FROM j UNION ALL SELECT 'balance', zone_id, balance, y FROM j UNION ALL SELECT 'constant', zone_id, 1.0, y FROM j),
    r AS (SELECT *, rank() OVER (PARTITION BY scorer ORDER BY p) + (count(*) OVER (PARTITION BY scorer, p) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY scorer ORDER BY y) + (count(*) OVER (PARTITION BY scorer, y) - 1) / 2.0 AS ry FROM l),
    k AS (SELECT a.scorer, sum(sign(a.p - b.p) * sign(a.y - b.y)) AS c, sum(abs(sign(a.p - b.p))) AS np, sum(abs(sign(a.y - b.y))) AS ny FROM l a JOIN l b ON a.scorer = b.scorer AND a.zone_id < b.zone_id GROUP BY 1)
    SELECT r.scorer, 'y' AS target, count(*) AS n, CASE WHEN r.scorer <> 'constant' THEN round(corr(rp, ry), 6) END AS spearman,
           CASE WHEN r.scorer <> 'constant' THEN round(max(c) / sqrt(max(np) * max(ny)), 6) END AS kendall FROM r JOIN k USING (scorer) GROUP BY 1""",
)
def _(spark, d):
    t = panel(spark, d).groupBy("zone_id").agg(F.sum("y").cast("double").alias("y")).join(zones(spark, d), "zone_id").withColumn("one", F.lit(1.0))
    s = me.ranking_scores(t, "zone_id", {"population": "population", "balance": "balance", "constant": "one"}).where("scorer <> 'random'")
    return me.ranking_evaluation(s, "zone_id", ["y"], 5).select("scorer", "target", "n", r6("spearman", "spearman"), r6("kendall", "kendall"))


@query("r181_metric_audit", "SELECT * FROM (VALUES ('mae', true), ('rmse', true), ('bias', true), ('pearson', false)) t(metric_name, agrees)")
def _(spark, d):
    """Four figures of one plan, the last with a planted error."""
    from zonalyx.plans.q_metrics import predictions

    p = predictions(spark, d)
    one = me.long_metrics(p.agg(*me.regression()), [], ["mae", "rmse", "bias", "pearson"])
    planted = one.withColumn("metric_value", F.when(F.col("metric_name") == "pearson", F.col("metric_value") + 0.01).otherwise(F.col("metric_value")))
    return me.audit(p, planted).select("metric_name", "agrees")


def _boosted(spark, d):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    j = panel(spark, d).join(zones(spark, d), "zone_id").withColumn("month", F.substring(O, 6, 2).cast("int")).withColumn("key", F.concat_ws("_", "zone_id", O))
    steps = [VectorAssembler(inputCols=["population", "month"], outputCol="features"), GBTRegressor(labelCol="y", maxIter=5, maxDepth=3, seed=42)]
    return j, Pipeline(stages=steps).fit(j.where(F.col(O) <= TRAIN_END))


@query("r196_boosted_trees")
def _(spark, d):
    j, model = _boosted(spark, d)
    return model.transform(j).select("zone_id", O, r6("prediction", "predicted"))


@query("r199_importance")
def _(spark, d):
    j, model = _boosted(spark, d)
    return me.permutation_importance(j, model, ["population", "month"], "y", "key")


@query("r199_partial_dependence")
def _(spark, d):
    j, model = _boosted(spark, d)
    return me.partial_dependence(j, model, "month", [1, 4, 7, 10])


# -- message passing --------------------------------------------------------------------------------


@query("r212_relation_table", "SELECT p_partkey, CAST(p_partkey % 23 AS INTEGER) AS relation_index, p_partkey % 23 IN (0, 1, 2) AS is_control FROM part")
def _(spark, d):
    names = F.array(*map(F.lit, g.RELATIONS))
    p = table(spark, d, "part").select("p_partkey", F.element_at(names, (F.col("p_partkey") % 23 + 1).cast("int")).alias("relation"))
    return g.encode_relations(p).join(F.broadcast(g.relation_table(spark).select("relation", "is_control")), "relation").select(
        "p_partkey",
        "relation_index",
        "is_control",
    )


@query(
    "r213_prior_matrix",
    """WITH f AS (SELECT CAST(s_suppkey % 23 AS INTEGER) AS i, avg(s_acctbal) / 10000 AS p FROM supplier WHERE s_suppkey % 23 < 10 GROUP BY 1), h AS (SELECT CAST(c_custkey % 23 AS INTEGER) AS i, avg(c_acctbal) / 10000 AS p FROM customer WHERE c_custkey % 23 BETWEEN 5 AND 20 GROUP BY 1)
    SELECT CAST(t.i AS INTEGER) AS relation_index, round(coalesce(f.p, 0), 6) AS flood, round(coalesce(h.p, 0), 6) AS heat FROM generate_series(0, 22) t(i) LEFT JOIN f ON f.i = t.i LEFT JOIN h ON h.i = t.i""",
)
def _(spark, d):
    """Priors that are means of suppliers' and of customers' balances, by relation."""
    r = g.relation_table(spark).select("relation_index", "relation")

    def priors(name, key, value, hazard, low, high):
        t = table(spark, d, name).select((F.col(key) % 23).cast("int").alias("relation_index"), F.col(value).alias("v")).where(F.col("relation_index").between(low, high))
        return t.groupBy("relation_index").agg((F.avg("v") / 10000).alias("prior")).join(F.broadcast(r), "relation_index").select("relation", F.lit(hazard).alias("hazard"), "prior")

    both = priors("supplier", "s_suppkey", "s_acctbal", "flood", 0, 9).unionByName(priors("customer", "c_custkey", "c_acctbal", "heat", 5, 20))
    return g.prior_matrix(both, ["flood", "heat"]).select("relation_index", r6("flood", "flood"), r6("heat", "heat"))


@query(
    "r216_target_aggregate",
    f"WITH {_N} SELECT node_id, count(e.source) AS n_in, CAST(coalesce(sum(CASE WHEN e.source IS NOT NULL THEN s.y END), 0) AS DOUBLE) AS y_sum, round(coalesce(avg(CASE WHEN e.source IS NOT NULL THEN s.y END), 0), 6) AS y_mean FROM n t LEFT JOIN (SELECT * FROM edges WHERE edge_type = 'lag_1') e ON e.target = t.node_id LEFT JOIN (SELECT node_id AS k, y FROM n) s ON s.k = e.source GROUP BY 1",
)
def _(spark, d):
    n = _nodes(spark, d)
    e = _edges(spark, d, n).where("edge_type = 'lag_1'").join(n.select(F.col("node_id").alias("source"), "y"), "source")
    return g.target_aggregate(e, n, ["y"]).select("node_id", "n_in", "y_sum", r6("y_mean", "y_mean"))


@query(
    "r217_edge_normalisation",
    f"WITH {_N} SELECT source, target, edge_type, count(*) OVER (PARTITION BY source, edge_type) AS source_degree, count(*) OVER (PARTITION BY target, edge_type) AS target_degree, round(1 / sqrt(count(*) OVER (PARTITION BY source, edge_type) * count(*) OVER (PARTITION BY target, edge_type)), 6) AS coefficient FROM edges",
)
def _(spark, d):
    n = _nodes(spark, d)
    e = g.normalise_edges(_edges(spark, d, n), "symmetric_degree", ["edge_type"])
    return e.select("source", "target", "edge_type", "source_degree", "target_degree", r6("coefficient", "coefficient"))


@query(
    "r218_attention",
    f"WITH {_N}, h AS (SELECT source, target, edge_type, head, CASE head WHEN 0 THEN edge_weight ELSE source % 7 / 7.0 END AS x FROM edges, (VALUES (0), (1)) t(head)) SELECT source, target, edge_type, head, round(exp(x) / sum(exp(x)) OVER (PARTITION BY target, edge_type, head), 6) AS weight FROM h",
)
def _(spark, d):
    n = _nodes(spark, d)
    e = _edges(spark, d, n).withColumn("logits", F.array(F.col("edge_weight"), F.col("source") % 7 / 7.0))
    return g.attention(e, "logits", "weight").select("source", "target", "edge_type", "head", r6("weight", "weight"))


@query(
    "r221_temporal_pooling",
    f"""WITH {PANEL}, l AS (SELECT zone_id, period_month, lag(y, 3) OVER z AS a, lag(y, 2) OVER z AS b, lag(y, 1) OVER z AS c FROM panel WINDOW z AS (PARTITION BY zone_id ORDER BY period_month)),
    m AS (SELECT zone_id, period_month, a, CASE WHEN b % 2 = 0 THEN b END AS b, c FROM l)
    SELECT zone_id, period_month, CAST(coalesce(c, b, a) AS DOUBLE) AS last, CAST(coalesce(greatest(a, b, c), 0) AS DOUBLE) AS most,
           round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif(CAST(a IS NOT NULL AS INTEGER) + CAST(b IS NOT NULL AS INTEGER) + CAST(c IS NOT NULL AS INTEGER), 0), 6) AS mean FROM m""",
)
def _(spark, d):
    from zonalyx.functions.windows import lag

    p = panel(spark, d)
    for name, k in (("a", 3), ("b", 2), ("c", 1)):
        p = p.withColumn(name, lag("y", k, ["zone_id"], O))
    p = p.withColumn("am", F.lit(True)).withColumn("bm", F.col("b") % 2 == 0).withColumn("cm", F.lit(True))
    v, m = ["a", "b", "c"], ["am", "bm", "cm"]
    return p.select(
        "zone_id",
        O,
        g.pool_history(v, m, "last_valid").alias("last"),
        g.pool_history(v, m, "masked_max", 0.0).alias("most"),
        r6(g.pool_history(v, m, "masked_mean"), "mean"),
    )


@query(
    "r221_attention_pooling",
    f"""WITH {PANEL}, l AS (SELECT zone_id, period_month, lag(y, 3) OVER z AS a, lag(y, 2) OVER z AS b, lag(y, 1) OVER z AS c FROM panel WINDOW z AS (PARTITION BY zone_id ORDER BY period_month)),
    m AS (SELECT zone_id, period_month, a, CASE WHEN b % 2 = 0 THEN b END AS b, c FROM l),
    s AS (SELECT zone_id, period_month, t.v, exp(t.z) AS e, exp(t.v / 10.0) AS f FROM m, LATERAL (VALUES (a, 0.0), (b, 0.5), (c, 1.0)) t(v, z) WHERE t.v IS NOT NULL),
    h AS (SELECT zone_id, period_month, sum(v * e) / sum(e) AS x, sum(v * f) / sum(f) AS y FROM s GROUP BY 1, 2)
    SELECT m.zone_id, m.period_month, round(x, 6) AS single, round((x + y) / 2, 6) AS mean_of_two, round(coalesce(0.75 * x + 0.25 * y, -1), 6) AS weighted FROM m LEFT JOIN h USING (zone_id, period_month)""",
)
def _(spark, d):
    """Three months back: one head by recency, another by the counts themselves."""
    from zonalyx.functions.windows import lag

    p = panel(spark, d)
    for name, k in (("a", 3), ("b", 2), ("c", 1)):
        p = p.withColumn(name, lag("y", k, ["zone_id"], O))
    p = p.withColumn("am", F.lit(True)).withColumn("bm", F.col("b") % 2 == 0).withColumn("cm", F.lit(True))
    v, m = ["a", "b", "c"], ["am", "bm", "cm"]
    recent, size = [F.lit(0.0), F.lit(0.5), F.lit(1.0)], [F.col(c) / 10.0 for c in v]
    return p.select(
        "zone_id",
        O,
        r6(g.pool_attention(v, m, [recent], "single_head"), "single"),
        r6(g.pool_attention(v, m, [recent, size]), "mean_of_two"),
        r6(g.pool_attention(v, m, [recent, size], "weighted_mean", [3.0, 1.0], -1.0), "weighted"),
    )


QUERIES, ORACLE_SQL = query.queries, query.sql
