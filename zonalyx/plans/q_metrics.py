"""Queries: forecast evaluation and the event streams' batch form."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from zonalyx.operators import metrics as me
from zonalyx.operators import resample as rs
from zonalyx.operators import splits as sp
from zonalyx.plans.base import PANEL, SPLIT, TRAIN_END, VALIDATION_END, ZONES, Register, panel, r6, table, zones
from zonalyx.streaming import events as st

query = Register()
O = "period_month"


def predictions(spark, d):
    """zone_id, period_month, split, observed, predicted: last month's value, else 0."""
    p = panel(spark, d).withColumn("split", sp.temporal(F.col(O), TRAIN_END, VALIDATION_END))
    last = F.coalesce(F.lag("y").over(Window.partitionBy("zone_id").orderBy(O)), F.lit(0))
    return p.select("zone_id", O, "split", F.col("y").alias("observed"), last.alias("predicted"))


PRED = f"""{PANEL}, pred AS (SELECT zone_id, period_month, {SPLIT} AS split, y AS observed, coalesce(lag(y) OVER (PARTITION BY zone_id ORDER BY period_month), 0) AS predicted FROM panel)"""


@query("r168_regression_metrics", f"""WITH {PRED} SELECT split, round(avg(abs(predicted - observed)), 6) AS mae, round(sqrt(avg(pow(predicted - observed, 2))), 6) AS rmse, round(avg(predicted - observed), 6) + 0 AS bias,
    round(avg(abs(predicted - observed) / observed) FILTER (observed > 0), 6) AS mape, round(corr(observed, predicted), 6) AS pearson, count(*) AS n FROM pred GROUP BY 1""")
def _(spark, d):
    g = predictions(spark, d).groupBy("split").agg(*me.regression())
    return g.select("split", *[r6(c, c) for c in ("mae", "rmse", "bias", "mape", "pearson")], "n")


@query(
    "r169_poisson_deviance",
    f"WITH {PRED}, m AS (SELECT *, greatest(CAST(predicted AS DOUBLE), 1e-9) AS mu FROM pred) SELECT split, round(avg(2 * (mu - observed + CASE WHEN observed > 0 THEN observed * ln(observed / mu) ELSE 0 END)), 5) AS poisson_deviance FROM m GROUP BY 1",
)
def _(spark, d):
    return predictions(spark, d).groupBy("split").agg(*me.regression()).select("split", F.round("poisson_deviance", 5).alias("poisson_deviance"))


@query(
    "r170_negative_binomial",
    f"WITH {PRED}, m AS (SELECT split, observed AS k, predicted + 1.0 AS mu FROM pred) SELECT split, round(avg(-2 * ln(1 + 0.5 * mu) + k * (ln(0.5 * mu) - ln(1 + 0.5 * mu)) + lgamma(k + 2.0) - lgamma(2.0) - lgamma(k + 1.0)), 6) AS log_likelihood, count(*) AS n FROM m GROUP BY 1",
)
def _(spark, d):
    p = predictions(spark, d).withColumn("mu", F.col("predicted") + 1.0)
    return p.groupBy("split").agg(r6(F.avg(me.negative_binomial("observed", "mu", 0.5)), "log_likelihood"), F.count(F.lit(1)).alias("n"))


_LL = lambda a: f"(SELECT sum(lgamma(k + {a}) - lgamma({a}) + {a} * ln({a} / ({a} + mu)) + k * ln(mu / ({a} + mu))) FROM m)"


@query(
    "r170_dispersion",
    f"""WITH RECURSIVE {PRED}, m AS (SELECT observed AS k, predicted + 1.0 AS mu FROM pred),
    g(step, low, high) AS (
        SELECT 0, CAST(-12 AS DOUBLE), CAST(12 AS DOUBLE)
        UNION ALL SELECT step + 1, CASE WHEN a < b THEN low + (high - low) / 3 ELSE low END, CASE WHEN a < b THEN high ELSE high - (high - low) / 3 END
        FROM (SELECT *, {_LL("exp(low + (high - low) / 3)")} AS a, {_LL("exp(high - (high - low) / 3)")} AS b FROM g WHERE step < 60))
    SELECT round(exp(-(low + high) / 2), 4) AS alpha FROM g WHERE step = 60""",
)
def _(spark, d):
    """Newton's dispersion, against a search by thirds."""
    p = predictions(spark, d).withColumn("mu", F.col("predicted") + 1.0)
    return spark.createDataFrame([(me.fitted_dispersion(p, "observed", "mu"),)], "alpha double").select(F.round("alpha", 4).alias("alpha"))


_R = lambda c: f"rank() OVER (PARTITION BY split ORDER BY {c}) + (count(*) OVER (PARTITION BY split, {c}) - 1) / 2.0"


@query(
    "r171_spearman",
    f"WITH {PRED}, r AS (SELECT split, {_R('observed')} AS a, {_R('predicted')} AS b FROM pred) SELECT split, round(corr(a, b), 6) AS spearman, count(*) AS n FROM r GROUP BY 1",
)
def _(spark, d):
    return me.spearman(predictions(spark, d), ["split"]).select("split", r6("spearman", "spearman"), "n")


@query("r171_kendall", f"""WITH {PRED}, s AS (SELECT a.period_month, sign(a.observed - b.observed) AS x, sign(a.predicted - b.predicted) AS y FROM pred a JOIN pred b ON a.period_month = b.period_month AND a.zone_id < b.zone_id)
    SELECT period_month, round(sum(x * y) / nullif(sqrt(sum(abs(x)) * sum(abs(y))), 0), 6) AS kendall FROM s GROUP BY 1""")
def _(spark, d):
    return me.kendall(predictions(spark, d), [O], "zone_id").select(O, r6("kendall", "kendall"))


@query("r172_top_k", f"""WITH {PRED}, r AS (SELECT *, row_number() OVER (PARTITION BY period_month ORDER BY observed DESC, zone_id) AS ry, row_number() OVER (PARTITION BY period_month ORDER BY predicted DESC, zone_id) AS rp, least(5, count(*) OVER (PARTITION BY period_month)) AS k FROM pred)
    SELECT period_month, CAST(max(k) AS BIGINT) AS k, count(*) FILTER (ry <= k AND rp <= k) AS hits, round(count(*) FILTER (ry <= k AND rp <= k) / max(k), 6) AS overlap, round(count(*) FILTER (rp <= k AND observed > 0) / nullif(count(*) FILTER (observed > 0), 0), 6) AS recall FROM r GROUP BY 1""")
def _(spark, d):
    return me.top_k(predictions(spark, d), [O], "zone_id", k=5).select(O, "k", "hits", r6("overlap", "overlap"), r6("recall", "recall"))


@query("r115_top_k_jaccard", f"""WITH {PRED}, r AS (SELECT *, row_number() OVER (PARTITION BY period_month ORDER BY observed DESC, zone_id) AS ry, row_number() OVER (PARTITION BY period_month ORDER BY predicted DESC, zone_id) AS rp FROM pred)
    SELECT period_month, round(count(*) FILTER (ry <= 5 AND rp <= 5) / (2.0 * least(5, count(*)) - count(*) FILTER (ry <= 5 AND rp <= 5)), 6) AS jaccard FROM r GROUP BY 1""")
def _(spark, d):
    return me.top_k(predictions(spark, d), [O], "zone_id", k=5).select(O, r6("jaccard", "jaccard"))


@query("r173_ndcg", f"""WITH {PRED}, r AS (SELECT *, row_number() OVER (PARTITION BY period_month ORDER BY observed DESC, zone_id) AS ry, row_number() OVER (PARTITION BY period_month ORDER BY predicted DESC, zone_id) AS rp FROM pred)
    SELECT period_month, round(sum(observed / log2(rp + 1)) FILTER (rp <= 10) / nullif(sum(observed / log2(ry + 1)) FILTER (ry <= 10), 0), 6) AS ndcg FROM r GROUP BY 1""")
def _(spark, d):
    return me.ndcg(predictions(spark, d), [O], "zone_id", 10).select(O, r6("ndcg", "ndcg"))


@query("r173_ndcg_shifted", f"""WITH {PRED}, v AS (SELECT zone_id, period_month, observed - 8 AS observed, predicted, least(min(observed - 8) OVER (PARTITION BY period_month), 0) AS low FROM pred),
    r AS (SELECT *, row_number() OVER (PARTITION BY period_month ORDER BY observed DESC, zone_id) AS ry, row_number() OVER (PARTITION BY period_month ORDER BY predicted DESC, zone_id) AS rp FROM v)
    SELECT period_month, round(sum((observed - low) / log2(rp + 1)) FILTER (rp <= 10) / nullif(sum((observed - low) / log2(ry + 1)) FILTER (ry <= 10), 0), 6) AS ndcg FROM r GROUP BY 1""")
def _(spark, d):
    """Gains that may be negative, raised by the least of the month."""
    p = predictions(spark, d).withColumn("observed", F.col("observed") - 8)
    return me.ndcg(p, [O], "zone_id", 10, shift=True).select(O, r6("ndcg", "ndcg"))


_LAB = f"{PRED}, lab AS (SELECT *, CAST(observed > 7 AS INTEGER) AS label, predicted / 20.0 AS score FROM pred)"


def labelled(spark, d):
    return predictions(spark, d).withColumn("label", (F.col("observed") > 7).cast("int")).withColumn("score", F.col("predicted") / 20.0)


@query(
    "r174_auroc",
    f"WITH {_LAB}, r AS (SELECT split, label, {_R('score')} AS r FROM lab) SELECT split, round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) AS auroc FROM r GROUP BY 1",
)
def _(spark, d):
    return me.auroc(labelled(spark, d), ["split"], "label", "score").select("split", r6("auroc", "auroc"))


@query("r175_average_precision", f"""WITH {_LAB}, k AS (SELECT *, zone_id || period_month AS key FROM lab), r AS (SELECT split, label, row_number() OVER w AS n, sum(label) OVER (PARTITION BY split ORDER BY score DESC, key ROWS UNBOUNDED PRECEDING) AS tp FROM k WINDOW w AS (PARTITION BY split ORDER BY score DESC, key))
    SELECT split, round(avg(tp / n) FILTER (label = 1), 6) AS average_precision FROM r GROUP BY 1""")
def _(spark, d):
    k = labelled(spark, d).withColumn("key", F.concat("zone_id", O))
    return me.average_precision(k, ["split"], "key", "label", "score").select("split", r6("average_precision", "average_precision"))


@query("r176_classification", f"""WITH {_LAB}, c AS (SELECT split, count(*) FILTER (label = 1 AND score >= 0.5) AS tp, count(*) FILTER (label = 0 AND score >= 0.5) AS fp, count(*) FILTER (label = 1 AND score < 0.5) AS fn, count(*) FILTER (label = 0 AND score < 0.5) AS tn, avg(pow(score - label, 2)) AS b FROM lab GROUP BY 1)
    SELECT split, tp, fp, fn, tn, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy, round(b, 6) AS brier FROM c""")
def _(spark, d):
    g = labelled(spark, d).groupBy("split").agg(*me.classification("label", "score"))
    return g.select("split", "tp", "fp", "fn", "tn", r6("f1", "f1"), r6("balanced_accuracy", "balanced_accuracy"), r6("brier", "brier"))


@query(
    "r177_long_metrics",
    f"WITH {PRED}, m AS (SELECT split, avg(abs(predicted - observed)) AS mae, corr(observed, predicted) AS pearson FROM pred GROUP BY 1) SELECT split, 'mae' AS metric_name, round(mae, 6) AS metric_value, false AS higher_is_better FROM m UNION ALL SELECT split, 'pearson', round(pearson, 6), true FROM m",
)
def _(spark, d):
    g = predictions(spark, d).groupBy("split").agg(*me.regression())
    return me.long_metrics(g, ["split"], ["mae", "pearson"]).withColumn("metric_value", r6("metric_value"))


#: The 31-bit number of a text, as resample.md5_number makes it.
_MD5 = lambda text: f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) % {rs.P}"

_WALK = f"""{PANEL}, {ZONES}, t AS (SELECT zone_id, population AS x, y, total FROM zones JOIN (SELECT zone_id, sum(y) AS y, sum(total) AS total FROM panel GROUP BY 1) USING (zone_id)),
    n AS (SELECT row_number() OVER (ORDER BY zone_id) - 1 AS i, x, y, total FROM t), size AS (SELECT count(*) AS n, CAST(floor(sqrt(count(*) - 1)) AS BIGINT) + 1 AS side FROM n),
    draw AS (SELECT r, k, 1 + {_MD5("'42:' || r || ':' || k || ':a'")} % {rs.P - 1} AS a, {_MD5("'42:' || r || ':' || k || ':b'")} AS b FROM generate_series(0, 99) r(r), generate_series(0, {rs.ROUNDS - 1}) k(k)),
    walk(r, i, k, left_, right_) AS (
        SELECT r, i, 0, i // side, i % side FROM n, size, generate_series(0, 99) r(r)
        UNION ALL
        SELECT w.r, w.i, CASE WHEN w.k < {rs.ROUNDS} THEN w.k + 1 ELSE 0 END, CASE WHEN w.k < {rs.ROUNDS} THEN right_ ELSE left_ END,
               CASE WHEN w.k < {rs.ROUNDS} THEN (left_ + (a * right_ + b) % {rs.P} % side) % side ELSE right_ END
        FROM walk w LEFT JOIN draw ON draw.r = w.r AND draw.k = w.k, size WHERE w.k < {rs.ROUNDS} OR left_ * side + right_ >= size.n),
    met AS (SELECT w.r, n.x, m.y, m.total FROM walk w JOIN n USING (i), size JOIN n m ON m.i = left_ * side + right_ WHERE w.k = {rs.ROUNDS} AND left_ * side + right_ < size.n)"""


def _null_sql(target: str) -> str:
    return f"""SELECT '{target}' AS target, round(any_value(observed), 6) AS observed, round((1 + count(*) FILTER (abs(c) >= abs(observed) - 1e-12)) / 101.0, 6) AS p_value,
        round((1 + count(*) FILTER (c >= observed - 1e-12)) / 101.0, 6) AS p_greater, count(*) FILTER (abs(c) >= abs(observed) - 1e-12) AS exceed, count(*) AS permutations,
        round(avg(c), 6) AS null_mean, round(stddev_samp(c), 6) AS null_deviation, round(quantile_cont(c, 0.025), 6) AS low, round(quantile_cont(c, 0.975), 6) AS high
    FROM (SELECT r, corr(x, {target}) AS c FROM met GROUP BY r), (SELECT corr(x, {target}) AS observed FROM n)"""


def _zone_totals(spark, d):
    t = panel(spark, d).groupBy("zone_id").agg(F.sum("y").alias("y"), F.sum("total").alias("total"))
    return t.join(zones(spark, d), "zone_id")


@query("r179_permutation_null", f"WITH RECURSIVE {_WALK} {_null_sql('y')} UNION ALL {_null_sql('total')}")
def _(spark, d):
    g = rs.permutation_null(_zone_totals(spark, d), "zone_id", "population", ["y", "total"], 100)
    rounded = [r6(c, c) for c in ("observed", "p_value", "p_greater", "null_mean", "null_deviation", "low", "high")]
    return g.select("target", *rounded, "exceed", "permutations")


_COUNTS = f"""draw AS (SELECT r, 1 + {_MD5("'42:' || r || ':a'")} % {rs.P - 1} AS a, {_MD5("'42:' || r || ':b'")} AS b FROM generate_series(0, 99) r(r)),
    w AS (SELECT r, value, event_type, len(list_filter({rs.poisson_steps()}, lambda s: (({_MD5("CAST(event_id AS VARCHAR)")}) * a + b) % {rs.P} >> 15 >= s)) AS w FROM events, draw),
    m AS (SELECT r, sum(w * value) / sum(w) AS mean, sum(w * value) FILTER (event_type = 'click') / sum(w) FILTER (event_type = 'click') AS clicks FROM w GROUP BY r)"""
_INTERVAL = lambda c, name: f"SELECT '{name}' AS \"column\", count({c}) AS replicates, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS deviation, round(quantile_cont({c}, 0.025), 6) AS low, round(quantile_cont({c}, 0.5), 6) AS middle, round(quantile_cont({c}, 0.975), 6) AS high FROM m"


@query("r180_bootstrap_interval", f"WITH {_COUNTS} {_INTERVAL('mean', 'value')} UNION ALL {_INTERVAL('clicks', 'click_value')}")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "value", F.when(F.col("event_type") == "click", F.col("value")).alias("click_value"))
    g = rs.bootstrap_means(e, "event_id", ["value", "click_value"], 100)
    return g.select("column", "replicates", *[r6(c, c) for c in ("mean", "deviation", "low", "middle", "high")])


@query("r182_prediction_contract", "SELECT CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS missing, CAST(3 AS BIGINT) AS parts")
def _(spark, d):
    p = predictions(spark, d)
    return p.agg(
        (F.count(F.lit(1)) - F.count_distinct("zone_id", O)).alias("repeated"),
        F.count_if(F.col("observed").isNull() | F.col("predicted").isNull()).alias("missing"),
        F.count_distinct("split").alias("parts"),
    )


@query(
    "r204_model_selection",
    f"""WITH {PRED}, m AS (SELECT 'last' AS model, avg(abs(predicted - observed)) AS mae FROM pred WHERE split = 'validation' UNION ALL SELECT 'zero', avg(abs(observed)) FROM pred WHERE split = 'validation') SELECT model AS best, round(mae, 6) AS mae FROM m ORDER BY mae LIMIT 1""",
)
def _(spark, d):
    p = predictions(spark, d).where("split = 'validation'")
    both = p.withColumn("model", F.lit("last")).unionByName(p.withColumn("model", F.lit("zero")).withColumn("predicted", F.lit(0).cast("long")))
    m = both.groupBy("model").agg(F.avg(F.abs(F.col("predicted") - F.col("observed"))).alias("mae"))
    return m.agg(F.min_by("model", F.struct("mae", "model")).alias("best"), r6(F.min("mae"), "mae"))


@query("s001_daily_events", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    return st.daily_counts(table(spark, d, "events"), "ts", "event_type", "value").withColumn("total", F.round("total", 2))


@query("s002_monthly_events", "SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    return st.monthly_counts(table(spark, d, "events"), "ts", "event_type")


@query(
    "s003_sliding_events",
    "SELECT strftime(d, '%Y-%m-%d') AS start, count(*) AS n FROM events, LATERAL (SELECT date_trunc('day', ts) - to_days(CAST(k AS INTEGER)) AS d FROM generate_series(0, 2) t(k)) GROUP BY 1",
)
def _(spark, d):
    return st.sliding_counts(table(spark, d, "events"), "ts")


@query(
    "s004_sessions",
    "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k",
)
def _(spark, d):
    return st.sessions(table(spark, d, "events"), "ts", "user_id").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


QUERIES, ORACLE_SQL = query.queries, query.sql
