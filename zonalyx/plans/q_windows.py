"""Queries: ranks, classes and time windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonalyx.functions import scalar as s
from zonalyx.functions import windows as w
from zonalyx.operators import frames as fr
from zonalyx.plans.base import PANEL, TRAIN_END, ZONES, Register, panel, r6, table, zones

query = Register()
Z, O = ["zone_id"], "period_month"


@query("r086_percentile_rank", "SELECT p_partkey, round((rank() OVER (ORDER BY p_size) - 1) / (count(p_size) OVER () - 1.0), 6) AS pr FROM part")
def _(spark, d):
    return w.percentile_rank(table(spark, d, "part"), "p_size", "pr").select("p_partkey", r6("pr", "pr"))


@query(
    "r086_percentile_rank_desc_average",
    "SELECT p_partkey, round((rank() OVER (ORDER BY p_size DESC) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 - 1) / (count(p_size) OVER () - 1.0), 6) AS pr FROM part",
)
def _(spark, d):
    return w.percentile_rank(table(spark, d, "part"), "p_size", "pr", ascending=False, method="average").select("p_partkey", r6("pr", "pr"))


@query(
    "r087_competition_rank",
    "SELECT c_custkey, c_mktsegment, CAST(rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) AS BIGINT) AS place FROM customer",
)
def _(spark, d):
    return w.competition_rank(table(spark, d, "customer"), "c_acctbal", "place", by=["c_mktsegment"]).select("c_custkey", "c_mktsegment", "place")


@query(
    "r088_average_rank",
    "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS mid FROM part",
)
def _(spark, d):
    return w.rank_over(table(spark, d, "part"), "p_size", "mid", by=["p_brand"], method="average").select("p_partkey", "mid")


@query("r089_other_ranks", """SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) + count(*) OVER (PARTITION BY p_brand, p_size) - 1 AS BIGINT) AS most,
    CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS dense, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS BIGINT) AS first FROM part""")
def _(spark, d):
    p = table(spark, d, "part")
    p = w.rank_over(w.rank_over(p, "p_size", "most", by=["p_brand"], method="max"), "p_size", "dense", by=["p_brand"], method="dense")
    from pyspark.sql import Window

    return p.select("p_partkey", "most", "dense", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_size", "p_partkey")).cast("long").alias("first"))


@query(
    "r090_ordinal_position",
    "SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, CAST(c_custkey AS VARCHAR)) AS BIGINT) AS pos FROM customer",
)
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", w.position("c_acctbal", "c_custkey", ["c_nationkey"]).alias("pos"))


@query(
    "r091_lag_features",
    f"WITH {PANEL} SELECT zone_id, period_month, lag(y, 1) OVER z AS y_lag_1, lag(y, 12) OVER z AS y_lag_12 FROM panel WINDOW z AS (PARTITION BY zone_id ORDER BY period_month)",
)
def _(spark, d):
    return panel(spark, d).select("zone_id", O, w.lag("y", 1, Z, O).alias("y_lag_1"), w.lag("y", 12, Z, O).alias("y_lag_12"))


@query("r092_rolling_before", f"""WITH {PANEL} SELECT zone_id, period_month, round(avg(y) OVER (PARTITION BY zone_id ORDER BY period_month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS mean_3,
    CAST(sum(y) OVER (PARTITION BY zone_id ORDER BY period_month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS BIGINT) AS sum_12 FROM panel""")
def _(spark, d):
    return panel(spark, d).select("zone_id", O, r6(w.rolling_before("y", 3, Z, O), "mean_3"), w.rolling_before("y", 12, Z, O, "sum").alias("sum_12"))


@query(
    "r093_expanding_before",
    f"WITH {PANEL} SELECT zone_id, period_month, round(avg(y) OVER (PARTITION BY zone_id ORDER BY period_month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS mean_before FROM panel",
)
def _(spark, d):
    return panel(spark, d).select("zone_id", O, r6(w.expanding_before("y", Z, O), "mean_before"))


@query("r094_rolling_with_current", f"""WITH {PANEL} SELECT zone_id, period_month, CAST(sum(y) OVER (PARTITION BY zone_id ORDER BY period_month ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS BIGINT) AS rolling_6,
    coalesce(lag(y) OVER (PARTITION BY zone_id ORDER BY period_month), 0) AS lag_1 FROM panel""")
def _(spark, d):
    return panel(spark, d).select("zone_id", O, w.rolling_with("y", 6, Z, O).alias("rolling_6"), F.coalesce(w.lag("y", 1, Z, O), F.lit(0)).alias("lag_1"))


@query("r095_future_targets", f"""WITH {PANEL}, f AS (SELECT zone_id, period_month, sum(y) OVER w AS s, count(*) OVER w AS n FROM panel WINDOW w AS (PARTITION BY zone_id ORDER BY period_month ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))
    SELECT zone_id, period_month, CAST(CASE WHEN n = 3 THEN s END AS BIGINT) AS target_next_3, n = 3 AS target_next_3_complete FROM f""")
def _(spark, d):
    return panel(spark, d).withColumn("target_next_3", w.future_sum("y", 3, Z, O)).select(
        "zone_id",
        O,
        "target_next_3",
        F.col("target_next_3").isNotNull().alias("target_next_3_complete"),
    )


@query("r096_seasonal_prior_mean", f"""WITH {PANEL} SELECT zone_id, period_month, round(coalesce(avg(y) OVER (PARTITION BY zone_id, right(period_month, 2) ORDER BY period_month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    (SELECT avg(y) FROM panel WHERE period_month <= '{TRAIN_END}')), 6) AS prior FROM panel""")
def _(spark, d):
    p = panel(spark, d).withColumn("m", F.right(O, F.lit(2)))
    whole = F.broadcast(p.where(F.col(O) <= TRAIN_END).agg(F.avg("y").alias("whole")))
    return p.crossJoin(whole).select("zone_id", O, r6(F.coalesce(w.expanding_before("y", ["zone_id", "m"], O), "whole"), "prior"))


@query(
    "r097_target_window",
    f"WITH {PANEL} SELECT DISTINCT period_month, strftime(CAST(period_month || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m') AS window_start, strftime(CAST(period_month || '-01' AS DATE) + INTERVAL 6 MONTH, '%Y-%m') AS window_end FROM panel",
)
def _(spark, d):
    o = s.month_ordinal(F.col(O))
    return panel(spark, d).select(O).distinct().select(O, s.month_of(o + 1).alias("window_start"), s.month_of(o + 6).alias("window_end"))


@query("r098_share_of_total", f"WITH {PANEL} SELECT zone_id, period_month, round(y / sum(y) OVER (PARTITION BY period_month), 6) AS share FROM panel")
def _(spark, d):
    return panel(spark, d).select("zone_id", O, r6(w.share_of_total("y", [O]), "share"))


@query(
    "r099_running_sum",
    f"WITH {PANEL} SELECT zone_id, period_month, CAST(sum(y) OVER (PARTITION BY zone_id ORDER BY period_month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS so_far FROM panel",
)
def _(spark, d):
    return panel(spark, d).select("zone_id", O, w.running_sum("y", Z, F.col(O)).alias("so_far"))


@query("r100_quantile_class", f"""WITH {ZONES}, r AS (SELECT zone_id, row_number() OVER (ORDER BY balance, zone_id) AS r, count(*) OVER () AS n FROM zones)
    SELECT zone_id, CAST(greatest(least(ceil((r - 1) * least(5, n) / (n - 1.0)), least(5, n)), 1) AS INTEGER) AS class FROM r""")
def _(spark, d):
    return w.quantile_class(zones(spark, d), "balance", "zone_id", "class").select("zone_id", "class")


@query("r101_equal_interval_class", f"""WITH {ZONES}, m AS (SELECT min(population) AS lo, max(population) AS hi FROM zones)
    SELECT zone_id, CAST(greatest(least(ceil((population - lo) * 5 / (hi - lo)), 5), 1) AS INTEGER) AS class FROM zones, m""")
def _(spark, d):
    return w.equal_interval_class(zones(spark, d), "population", "class").select("zone_id", "class")


@query("r102_deviation_band", f"""WITH {ZONES}, m AS (SELECT avg(balance) AS a, stddev_pop(balance) AS s FROM zones), z AS (SELECT zone_id, (balance - a) / s AS z FROM zones, m)
    SELECT zone_id, CASE WHEN z < -1 THEN 'least' WHEN z < -0.5 THEN 'low' WHEN z <= 0.5 THEN 'moderate' WHEN z <= 1 THEN 'high' ELSE 'most' END AS band FROM z""")
def _(spark, d):
    z = zones(spark, d)
    m = F.broadcast(z.agg(F.avg("balance").alias("a"), F.stddev_pop("balance").alias("s")))
    return z.crossJoin(m).select("zone_id", w.deviation_band((F.col("balance") - F.col("a")) / F.col("s")).alias("band"))


@query("r103_magnitude_class", f"""WITH {PANEL}, q AS (SELECT quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.5) AS b, quantile_cont(y, 0.75) AS c FROM panel WHERE y > 0 AND period_month <= '{TRAIN_END}')
    SELECT zone_id, period_month, CASE WHEN y <= 0 THEN 0 WHEN y <= a THEN 1 WHEN y <= b THEN 2 WHEN y <= c THEN 3 ELSE 4 END AS magnitude FROM panel, q""")
def _(spark, d):
    p = panel(spark, d)
    cuts = p.where((F.col("y") > 0) & (F.col(O) <= TRAIN_END)).agg(F.percentile("y", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).first()[0]
    return p.select("zone_id", O, w.magnitude_class(F.col("y"), cuts or [0.0, 0.0, 0.0]).alias("magnitude"))


@query("r105_dense_id", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS id FROM orders")
def _(spark, d):
    return fr.dense_id(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "id", "o_orderdate", "o_orderkey").select("o_orderkey", "id")


@query(
    "r106_multi_key_sort",
    f"WITH {ZONES} SELECT zone_id, CAST(row_number() OVER (ORDER BY population DESC, balance ASC, zone_id) AS BIGINT) AS place FROM zones",
)
def _(spark, d):
    placed = fr.dense_id(zones(spark, d), "i", F.desc("population"), F.asc("balance"), "zone_id")
    return placed.select("zone_id", (F.col("i") + 1).alias("place"))


@query(
    "r107_top_share",
    "SELECT c_custkey, c_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r, greatest(1, ceil(count(*) OVER (PARTITION BY c_nationkey) * 0.1)) AS k FROM customer) WHERE r <= k",
)
def _(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "customer")
    k = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(Window.partitionBy("c_nationkey")) * 0.1))
    return c.withColumn("k", k).withColumn("r", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))).where("r <= k").select(
        "c_custkey",
        "c_nationkey",
    )


@query(
    "r108_top_ids_joined",
    f"WITH {PANEL}, r AS (SELECT *, row_number() OVER (PARTITION BY period_month ORDER BY y DESC, zone_id) AS r FROM panel) SELECT period_month, string_agg(CAST(zone_id AS VARCHAR), ';' ORDER BY r) AS top_zones FROM r WHERE r <= 3 GROUP BY 1",
)
def _(spark, d):
    from pyspark.sql import Window

    r = panel(spark, d).withColumn("r", F.row_number().over(Window.partitionBy(O).orderBy(F.desc("y"), "zone_id"))).where("r <= 3")
    ids = F.transform(F.sort_array(F.collect_list(F.struct("r", "zone_id"))), lambda x: x["zone_id"].cast("string"))
    return r.groupBy(O).agg(F.array_join(ids, ";").alias("top_zones"))


@query(
    "r109_best_row_per_group",
    "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1",
)
def _(spark, d):
    return fr.first_per_key(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], F.desc("o_totalprice"), F.col("o_orderkey")).select(
        "o_custkey",
        "o_orderkey",
    )


@query("r111_limit_head", "SELECT p_partkey, p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def _(spark, d):
    return table(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").select("p_partkey", "p_name").limit(10)


@query("r112_ranking_comparison", f"""WITH {PANEL}, {ZONES}, t AS (SELECT zone_id, CAST(sum(y) AS BIGINT) AS y FROM panel GROUP BY 1), b AS (SELECT zone_id, balance, y FROM zones JOIN t USING (zone_id))
    SELECT zone_id, CAST(rank() OVER (ORDER BY balance DESC) AS BIGINT) AS score_rank, CAST(rank() OVER (ORDER BY y DESC) AS BIGINT) AS target_rank, row_number() OVER (ORDER BY balance DESC, CAST(zone_id AS VARCHAR)) <= 10 AS top_10 FROM b""")
def _(spark, d):
    t = panel(spark, d).groupBy("zone_id").agg(F.sum("y").alias("y"))
    b = zones(spark, d).select("zone_id", "balance").join(t, "zone_id")
    b = w.competition_rank(w.competition_rank(b, "balance", "score_rank"), "y", "target_rank")
    return w.overall_position(b, "balance", "zone_id", "place").select("zone_id", "score_rank", "target_rank", (F.col("place") <= 10).alias("top_10"))


QUERIES, ORACLE_SQL = query.queries, query.sql
