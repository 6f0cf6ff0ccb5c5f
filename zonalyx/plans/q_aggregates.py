"""Queries: grouped aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonalyx.operators import aggregates as ag
from zonalyx.operators import frames as fr
from zonalyx.operators.store import by_rows
from zonalyx.plans.base import PANEL, SPLIT, TRAIN_END, VALIDATION_END, ZONES, Register, panel, r6, table, zones
from zonalyx.operators import splits as sp

query = Register()
O = "period_month"
KINDS = ["view", "click", "error", "signup", "purchase"]


@query("r055_grouped_aggregate", """SELECT user_id AS unit_id, strftime(ts, '%Y-%m') AS period_month, count(*) AS n, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors,
    round(avg(value), 9) AS mean_value, round(median(value), 6) AS median_value, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1, 2""")
def _(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("unit_id"), F.date_format("ts", "yyyy-MM").alias(O))
    return e.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
        F.round(F.avg("value"), 9).alias("mean_value"),
        r6(F.median("value"), "median_value"),
        F.count_distinct("event_type").alias("kinds"),
    )


@query("r056_two_phase_aggregate", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("value"), 2).alias("total"),
        r6(F.avg("value"), "mean"),
    )


@query("r057_pivot_counts", "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS \"{k}\"" for k in KINDS) + " FROM events GROUP BY 1")
def _(spark, d):
    return ag.pivot_counts(table(spark, d, "events"), ["user_id"], "event_type", KINDS)


@query(
    "r058_unstack",
    "SELECT l_orderkey, max(l_quantity) FILTER (l_linenumber = 1) AS \"1\", max(l_quantity) FILTER (l_linenumber = 2) AS \"2\" FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2) GROUP BY 1",
)
def _(spark, d):
    lines = by_rows(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey")
    flat = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"))
    return ag.unstack(flat, ["l_orderkey"], "l_linenumber", "l_quantity", [1, 2])


@query(
    "r059_long_to_wide",
    f"WITH {PANEL}, m AS (SELECT zone_id, right(period_month, 2) AS m, sum(y) AS y FROM panel GROUP BY 1, 2) SELECT zone_id, " + ", ".join(
        f"CAST(max(y) FILTER (m = '{k:02d}') AS BIGINT) AS \"{k:02d}\"" for k in range(1, 13)
    ) + " FROM m GROUP BY 1",
)
def _(spark, d):
    m = panel(spark, d).groupBy("zone_id", F.right(O, F.lit(2)).alias("m")).agg(F.sum("y").alias("y"))
    return ag.unstack(m, ["zone_id"], "m", "y", [f"{k:02d}" for k in range(1, 13)])


@query(
    "r060_sum_min_count",
    "SELECT o_custkey, round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 2) AS pending, round(coalesce(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 0), 2) AS pending_or_zero FROM orders GROUP BY 1",
)
def _(spark, d):
    x = F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(
        F.round(ag.sum_or_null(x), 2).alias("pending"),
        F.round(ag.sum_or_zero(x), 2).alias("pending_or_zero"),
    )


@query("r061_distinct_count", "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"))


@query(
    "r062_weighted_mean",
    "SELECT l_suppkey, round(CASE WHEN sum(l_quantity) > 0 THEN sum(l_extendedprice * l_quantity) / sum(l_quantity) ELSE avg(l_extendedprice) END, 4) AS mean FROM lineitem GROUP BY 1",
)
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(ag.weighted_mean(F.col("l_extendedprice"), F.col("l_quantity")), 4).alias("mean"))


@query(
    "r063_area_weighted_mean",
    "SELECT c_nationkey, round(sum(c_acctbal * c_acctbal) FILTER (c_acctbal > 9000) / sum(c_acctbal) FILTER (c_acctbal > 9000), 4) AS mean FROM customer GROUP BY 1",
)
def _(spark, d):
    w = F.when(F.col("c_acctbal") > 9000, F.col("c_acctbal"))
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.round(ag.area_weighted_mean(F.col("c_acctbal"), w), 4).alias("mean"))


@query("r064_areal_allocation", "SELECT l_suppkey, round(sum(l_quantity * l_discount / nullif(l_tax, 0)), 4) AS allocated FROM lineitem GROUP BY 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.round(ag.allocated(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")), 4).alias("allocated")
    )


@query(
    "r065_dominant",
    "SELECT c_nationkey, c_custkey AS dominant FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r = 1",
)
def _(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(ag.dominant(F.col("c_custkey"), F.col("c_acctbal")).alias("dominant"))


@query(
    "r066_recomputed_shares",
    "SELECT user_id, round(coalesce(count(*) FILTER (event_type = 'error') / nullif(count(*) FILTER (event_type IN ('view', 'error')), 0), 0), 6) AS share FROM events GROUP BY 1",
)
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(
        r6(ag.share(F.count_if(F.col("event_type") == "error"), F.count_if(F.col("event_type").isin("view", "error"))), "share")
    )


@query("r067_burden", f"""WITH {PANEL}, {ZONES}, j AS (SELECT p.zone_id, period_month, y, balance, population FROM panel p JOIN zones z ON p.zone_id = z.zone_id),
    g AS (SELECT zone_id, CAST(sum(y) AS BIGINT) AS total, avg(y) AS mean, count(*) FILTER (y > 0) AS positive, count(DISTINCT period_month) AS months, max(population) AS population FROM j GROUP BY 1)
    SELECT zone_id, total, round(mean, 6) AS mean, positive, months, round(total / population * 1000, 6) AS rate, CAST(rank() OVER (ORDER BY total DESC) AS BIGINT) AS total_rank, CAST(rank() OVER (ORDER BY total / population DESC) AS BIGINT) AS rate_rank FROM g""")
def _(spark, d):
    j = panel(spark, d).join(zones(spark, d).select("zone_id", "balance", "population"), "zone_id")
    b = ag.burden(j, "zone_id", O, "y", "balance", "population")
    return b.select("zone_id", "total", r6("mean", "mean"), "positive", "months", r6("rate", "rate"), "total_rank", "rate_rank")


@query("r068_sensitivity_target", f"""WITH {PANEL}, {ZONES}, g AS (SELECT p.zone_id, CAST(sum(y) AS DOUBLE) AS y, max(population) AS pop FROM panel p JOIN zones z USING (zone_id) GROUP BY 1), r AS (SELECT zone_id, CASE WHEN pop >= 55 THEN y / pop END AS v FROM g),
    q AS (SELECT quantile_cont(v, 0.9) AS cap FROM r) SELECT zone_id, round(least(v, CASE WHEN v IS NOT NULL THEN cap END), 6) AS v FROM r, q""")
def _(spark, d):
    g = panel(spark, d).join(zones(spark, d).select("zone_id", "population"), "zone_id").groupBy("zone_id").agg(
        F.sum("y").cast("double").alias("y"),
        F.max("population").alias("pop"),
    )
    return ag.winsorise(g.select("zone_id", F.when(F.col("pop") >= 55, F.col("y") / F.col("pop")).alias("v")), "v", 0.9).select("zone_id", r6("v", "v"))


@query(
    "r069_surge_months",
    f"WITH {PANEL}, t AS (SELECT period_month, CAST(sum(y) AS BIGINT) AS total FROM panel WHERE period_month <= '{TRAIN_END}' GROUP BY 1) SELECT period_month, total FROM t WHERE total >= (SELECT quantile_cont(total, 0.9) FROM t)",
)
def _(spark, d):
    return ag.surge_months(panel(spark, d).where(F.col(O) <= TRAIN_END), O, "y", 0.9)


@query("r070_train_share", f"WITH {PANEL} SELECT round(sum(y) FILTER (zone_id < 10) / sum(y), 6) AS share FROM panel WHERE period_month <= '{TRAIN_END}'")
def _(spark, d):
    return panel(spark, d).where(F.col(O) <= TRAIN_END).agg(r6(ag.share(F.sum(F.when(F.col("zone_id") < 10, F.col("y"))), F.sum("y")), "share"))


@query("r071_winsorise", "SELECT o_orderkey, round(least(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.95) FROM orders)), 4) AS price FROM orders")
def _(spark, d):
    return ag.winsorise(table(spark, d, "orders"), "o_totalprice", 0.95).select("o_orderkey", F.round("o_totalprice", 4).alias("price"))


@query(
    "r072_train_summaries",
    f"WITH {PANEL} SELECT zone_id, round(avg(y), 6) AS mean, round(median(y), 6) AS median, round(quantile_cont(y, 0.9), 6) AS p90, round(avg(CASE WHEN y > 5 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM panel WHERE period_month <= '{TRAIN_END}' GROUP BY 1",
)
def _(spark, d):
    g = panel(spark, d).where(F.col(O) <= TRAIN_END).groupBy("zone_id")
    return g.agg(
        r6(F.avg("y"), "mean"),
        r6(F.median("y"), "median"),
        r6(F.percentile("y", F.lit(0.9)), "p90"),
        r6(F.avg((F.col("y") > 5).cast("double")), "rate"),
    )


@query(
    "r073_value_counts",
    f"WITH {PANEL}, s AS (SELECT {SPLIT} AS split FROM panel) SELECT split, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM s GROUP BY 1",
)
def _(spark, d):
    p = panel(spark, d).withColumn("split", sp.temporal(F.col(O), TRAIN_END, VALIDATION_END))
    return ag.value_counts(p, "split").select("split", "n", r6("share", "share"))


@query(
    "r074_hierarchical_means",
    f"WITH {PANEL}, t AS (SELECT zone_id, right(period_month, 2) AS m, y FROM panel WHERE period_month <= '{TRAIN_END}') SELECT zone_id, m, CAST(grouping(zone_id, m) AS BIGINT) AS level, round(avg(y), 6) AS mean, count(y) AS n FROM t GROUP BY GROUPING SETS ((zone_id, m), (zone_id), (m), ())",
)
def _(spark, d):
    t = panel(spark, d).where(F.col(O) <= TRAIN_END).withColumn("m", F.right(O, F.lit(2)))
    return ag.hierarchical_means(t, ["zone_id", "m"], "y").select("zone_id", "m", F.col("level").cast("long").alias("level"), r6("mean", "mean"), "n")


@query(
    "r075_exposure_rate",
    f"WITH {PANEL}, {ZONES}, j AS (SELECT p.zone_id, period_month, y, population FROM panel p JOIN zones USING (zone_id)) SELECT zone_id, period_month, round(greatest(population * (SELECT sum(y) / sum(population) FROM j WHERE period_month <= '{TRAIN_END}'), 0), 6) AS predicted FROM j",
)
def _(spark, d):
    j = panel(spark, d).join(zones(spark, d).select("zone_id", "population"), "zone_id")
    rate = F.broadcast(j.where(F.col(O) <= TRAIN_END).agg(ag.share(F.sum("y"), F.sum("population")).alias("rate")))
    return j.crossJoin(rate).select("zone_id", O, r6(F.greatest(F.col("population") * F.col("rate"), F.lit(0.0)), "predicted"))


@query("r076_reconcile_aliases", "SELECT o_orderkey, o_totalprice AS price FROM orders")
def _(spark, d):
    o = table(spark, d, "orders")
    a = o.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("b"),
        F.col("o_totalprice").alias("c"),
    )
    return ag.reconcile(a, ["price", "b", "c"], "price")


@query(
    "r077_prediction_summary",
    f"WITH {PANEL} SELECT {SPLIT} AS split, CAST(NULL AS VARCHAR) AS model, count(*) AS n, round(avg(y), 6) AS mean, CAST(sum(y) AS BIGINT) AS total FROM panel GROUP BY 1",
)
def _(spark, d):
    p = panel(spark, d).withColumn("split", sp.temporal(F.col(O), TRAIN_END, VALIDATION_END)).withColumn("model", F.lit(None).cast("string"))
    return p.groupBy("split", "model").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("y"), "mean"), F.sum("y").alias("total"))


@query("r078_winners", f"""WITH {PANEL}, m AS (SELECT period_month, zone_id, y FROM panel), r AS (SELECT *, row_number() OVER w AS r, lead(zone_id) OVER w AS second, lead(y) OVER w AS sv, count(*) OVER (PARTITION BY period_month) AS compared FROM m WINDOW w AS (PARTITION BY period_month ORDER BY y DESC, zone_id))
    SELECT period_month, zone_id AS best, y AS best_value, second, sv AS second_value, abs(y - sv) AS margin, round(abs(y - sv) / nullif(abs(sv), 0), 6) AS relative_margin, compared FROM r WHERE r = 1""")
def _(spark, d):
    p = panel(spark, d).withColumn("up", F.lit(True))
    return ag.winners(p, [O], "zone_id", "y", "up").withColumn("relative_margin", r6("relative_margin"))


@query(
    "r079_family_margin",
    f"WITH {PANEL} SELECT period_month, max(y) FILTER (zone_id % 2 = 0) - max(y) FILTER (zone_id % 2 = 1) AS margin FROM panel GROUP BY 1",
)
def _(spark, d):
    even = F.col("zone_id") % 2 == 0
    return panel(spark, d).groupBy(O).agg((F.max(F.when(even, F.col("y"))) - F.max(F.when(~even, F.col("y")))).alias("margin"))


@query("r080_residual_deciles", f"""WITH {PANEL}, r AS (SELECT y, y - 7.0 AS e, least(floor((row_number() OVER (ORDER BY y, zone_id, period_month) - 1) * 10.0 / count(*) OVER ()), 9) AS decile FROM panel)
    SELECT CAST(decile AS BIGINT) AS decile, count(*) AS n, round(avg(e), 6) AS mean, round(quantile_cont(e, 0.1), 6) AS q10, round(quantile_cont(e, 0.9), 6) AS q90 FROM r GROUP BY 1""")
def _(spark, d):
    p = panel(spark, d).withColumn("e", F.col("y") - 7.0)
    n = p.count()
    r = fr.dense_id(p, "i", "y", "zone_id", O).withColumn("decile", F.least(F.floor(F.col("i") * 10.0 / F.lit(n)), F.lit(9)).cast("long"))
    return r.groupBy("decile").agg(
        F.count(F.lit(1)).alias("n"),
        r6(F.avg("e"), "mean"),
        r6(F.percentile("e", F.lit(0.1)), "q10"),
        r6(F.percentile("e", F.lit(0.9)), "q90"),
    )


@query("r081_monthly_series", f"WITH {PANEL} SELECT period_month, {SPLIT} AS split, CAST(sum(y) AS BIGINT) AS observed FROM panel GROUP BY 1, 2")
def _(spark, d):
    p = panel(spark, d).withColumn("split", sp.temporal(F.col(O), TRAIN_END, VALIDATION_END))
    return p.groupBy(O, "split").agg(F.sum("y").alias("observed"))


@query(
    "r082_missingness",
    "SELECT 'props' AS \"column\", count(props) AS non_missing, count(*) - count(props) AS missing, round((count(*) - count(props)) / count(*), 6) AS missing_share FROM events UNION ALL SELECT 'big', count(*) FILTER (value > 10), count(*) - count(*) FILTER (value > 10), round((count(*) - count(*) FILTER (value > 10)) / count(*), 6) FROM events",
)
def _(spark, d):
    e = table(spark, d, "events").withColumn("big", F.when(F.col("value") > 10, F.col("value")))
    return ag.missingness(e, ["props", "big"]).withColumn("missing_share", r6("missing_share"))


@query(
    "r083_numeric_profile",
    "SELECT 'value' AS \"column\", count(value) AS non_missing, count(*) - count(value) AS missing, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM events",
)
def _(spark, d):
    p = ag.numeric_profile(table(spark, d, "events"), ["value"])
    return p.withColumn("mean", r6("mean")).withColumn("median", r6("median"))


@query("r085_distinct", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct()


QUERIES, ORACLE_SQL = query.queries, query.sql
