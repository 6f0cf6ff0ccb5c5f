"""Queries: projections, filters, joins and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonalyx.functions import scalar as s
from zonalyx.operators import frames as fr
from zonalyx.plans.base import PANEL, TRAIN_END, ZONES, Register, panel, r6, table, zones
from zonalyx.sources import tables as src

query = Register()
O = "period_month"


@query("r005_parquet_scan", "SELECT n_nationkey, n_name FROM nation")
def _(spark, d):
    return src.read_table(spark, f"{d}/nation.parquet").select("n_nationkey", "n_name")


@query("r010_infer_kinds", "SELECT * FROM (VALUES ('event_type', 'text'), ('event_id', 'number'), ('ts', 'date')) t(column_name, kind)")
def _(spark, d):
    e = table(spark, d, "events")
    return spark.createDataFrame([(c, src.infer_kind(e, c)) for c in ("event_type", "event_id", "ts")], "column_name string, kind string")


@query("r011_choose_column", "SELECT n_nationkey AS key, n_name AS name FROM nation")
def _(spark, d):
    n = table(spark, d, "nation")
    return n.select(
        F.col(fr.choose_column(n.columns, ["id", " N_NationKey "], "key")).alias("key"),
        F.col(fr.choose_column(n.columns, ["n_name"], "name")).alias("name"),
    )


@query(
    "r017_config_fingerprint",
    """SELECT c_custkey, sha256('{"index":"' || lower(c_mktsegment) || '","variables":["balance","nation"],"weights":{"a":' || c_nationkey || ',"b":null}}') AS fingerprint FROM customer""",
)
def _(spark, d):
    """A configuration a customer, with keys in no order; its fingerprint is that of the canonical text."""
    c = table(spark, d, "customer")
    weights = F.struct(F.lit(None).cast("int").alias("b"), F.col("c_nationkey").alias("a"))
    config = F.struct(F.array(F.lit("balance"), F.lit("nation")).alias("variables"), weights.alias("weights"), F.lower("c_mktsegment").alias("index"))
    return c.select("c_custkey", src.fingerprint_of(config, c.select(config.alias("c")).schema["c"].dataType).alias("fingerprint"))


@query("r020_rename_reorder", "SELECT c_nationkey AS zone_id, c_custkey AS unit_id FROM customer")
def _(spark, d):
    return fr.canonical(table(spark, d, "customer"), {"c_nationkey": "zone_id", "c_custkey": "unit_id"})


@query("r021_normalise_names", "SELECT r_regionkey AS region_key_no, r_name AS nom_de_region FROM region")
def _(spark, d):
    return fr.normalise_names(table(spark, d, "region").toDF(" Region-Key (No.)", "Nom de région"))


@query("r022_level_filter", "SELECT p_partkey, p_size FROM part WHERE trim(p_type) = 'ECONOMY' AND p_size IN (1, 2, 3)")
def _(spark, d):
    return fr.level_filter(table(spark, d, "part"), "p_type", "ECONOMY", "p_size", [1, 2, 3]).select("p_partkey", "p_size")


@query("r023_prefix_filter", "SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#1%'")
def _(spark, d):
    return table(spark, d, "part").where(fr.has_prefix(F.col("p_brand"), "Brand#1")).select("p_partkey")


@query("r024_range_predicate", f"WITH {PANEL} SELECT zone_id, period_month, y FROM panel WHERE period_month BETWEEN '1996-03' AND '1997-02'")
def _(spark, d):
    return panel(spark, d).where(F.col(O).between("1996-03", "1997-02")).select("zone_id", O, "y")


@query(
    "r025_drop_incomplete",
    "SELECT event_id FROM events WHERE TRY_CAST(regexp_extract(props, '\"k\": (\\d+)', 1) AS DOUBLE) IS NOT NULL AND value IS NOT NULL AND ts IS NOT NULL",
)
def _(spark, d):
    e = table(spark, d, "events").withColumn("k", s.safe_number(F.get_json_object("props", "$.k")))
    return e.dropna(subset=["k", "value", "ts"]).select("event_id")


@query("r026_zero_population", f"WITH {ZONES} SELECT zone_id, population <= 55 AS bad_population FROM zones")
def _(spark, d):
    return fr.zero_population(zones(spark, d), "population", "flag", 55).select("zone_id", "bad_population")


@query("r027_anti_membership", "SELECT event_id FROM events WHERE event_type NOT IN ('error', 'signup')")
def _(spark, d):
    return table(spark, d, "events").where(~F.col("event_type").isin("error", "signup")).select("event_id")


@query("r028_static_columns", "SELECT 'c_nationkey' AS static_column")
def _(spark, d):
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")), "c_nationkey")
    found = fr.static_columns(c, "n_name", ["c_nationkey", "c_acctbal", "c_mktsegment"])
    return spark.createDataFrame([(x,) for x in found], "static_column string")


@query(
    "r029_feature_vector",
    f"WITH {ZONES} SELECT zone_id, round(list_sum([CAST(population AS DOUBLE), balance]), 4) AS total, len([CAST(population AS DOUBLE), balance]) AS width FROM zones",
)
def _(spark, d):
    v = fr.feature_vector(zones(spark, d), ["population", "balance"])
    return v.select(
        "zone_id",
        F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 4).alias("total"),
        F.size("features").cast("long").alias("width"),
    )


@query(
    "r030_column_families",
    "SELECT * FROM (VALUES ('c_acctbal', 'money'), ('c_custkey', 'key'), ('c_mktsegment', 'other'), ('c_name', 'other'), ('c_nationkey', 'key')) t(name, family)",
)
def _(spark, d):
    rules = [("money", ["bal", "price"]), ("key", ["key"])]
    return spark.createDataFrame([(c, fr.column_family(c, rules)) for c in table(spark, d, "customer").columns], "name string, family string")


@query(
    "r031_first_per_key",
    "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1",
)
def _(spark, d):
    return fr.first_per_key(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], F.col("ts"), F.col("event_id")).select(
        "user_id",
        "event_id",
    )


@query("r032_hash_sample")
def _(spark, d):
    return fr.hash_sample(table(spark, d, "customer"), "c_custkey", 100).select("c_custkey")


@query(
    "r033_left_join_many_to_one",
    "SELECT c_custkey, n_name, n_name IS NOT NULL AS matched FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey",
)
def _(spark, d):
    n = table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return fr.left_join(table(spark, d, "customer"), n, ["c_nationkey"], marker="matched").select("c_custkey", "n_name", "matched")


@query(
    "r034_left_join_one_to_one",
    f"WITH {PANEL}, {ZONES}, t AS (SELECT zone_id, CAST(sum(y) AS BIGINT) AS y FROM panel GROUP BY 1) SELECT zone_id, population, y FROM zones LEFT JOIN t USING (zone_id)",
)
def _(spark, d):
    t = panel(spark, d).groupBy("zone_id").agg(F.sum("y").alias("y"))
    return fr.left_join(zones(spark, d), t, ["zone_id"], "1:1").select("zone_id", "population", "y")


@query("r035_complete_grid", """WITH s AS (SELECT user_id AS zone_id, strftime(ts, '%Y-%m') AS period_month, count(*) AS y FROM events WHERE event_type = 'signup' GROUP BY 1, 2),
    m AS (SELECT * FROM (VALUES ('2023-12'), ('2024-01'), ('2024-02')) t(period_month)), z AS (SELECT DISTINCT zone_id FROM s)
    SELECT zone_id, period_month, coalesce(y, 0) AS y FROM z CROSS JOIN m LEFT JOIN s USING (zone_id, period_month)""")
def _(spark, d):
    e = table(spark, d, "events").where("event_type = 'signup'").groupBy(F.col("user_id").alias("zone_id"), F.date_format("ts", "yyyy-MM").alias(O)).agg(
        F.count(F.lit(1)).alias("y")
    )
    return fr.complete_grid(e, "zone_id", O, start="2023-12", end="2024-02", zeros=["y"])


@query(
    "r036_lag_join",
    f"WITH {PANEL} SELECT a.zone_id, a.period_month, b.y AS y_last_year FROM panel a LEFT JOIN panel b ON a.zone_id = b.zone_id AND b.period_month = strftime(CAST(a.period_month || '-01' AS DATE) - INTERVAL 12 MONTH, '%Y-%m')",
)
def _(spark, d):
    return fr.lag_join(panel(spark, d), "zone_id", O, "y", 12, "y_last_year").select("zone_id", O, "y_last_year")


@query("r037_fallback_lookup", f"""WITH {PANEL}, t AS (SELECT * FROM panel WHERE period_month <= '{TRAIN_END}'), zm AS (SELECT zone_id, right(period_month, 2) AS m, avg(y) AS v FROM t WHERE y > 8 GROUP BY 1, 2), z AS (SELECT zone_id, avg(y) AS v FROM t GROUP BY 1)
    SELECT p.zone_id, period_month, round(coalesce(zm.v, z.v, 0), 6) AS predicted FROM panel p LEFT JOIN zm ON p.zone_id = zm.zone_id AND right(period_month, 2) = zm.m LEFT JOIN z ON p.zone_id = z.zone_id""")
def _(spark, d):
    p = panel(spark, d).withColumn("m", F.right(O, F.lit(2)))
    t = p.where(F.col(O) <= TRAIN_END)
    zm = t.where("y > 8").groupBy("zone_id", "m").agg(F.avg("y").alias("v"))
    z = t.groupBy("zone_id").agg(F.avg("y").alias("v"))
    return fr.fallback_lookup(p, [(zm, ["zone_id", "m"], "v"), (z, ["zone_id"], "v")], 0.0, "predicted").select("zone_id", O, r6("predicted", "predicted"))


@query("r038_dictionary_lookup", "SELECT event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 0 END AS code FROM events")
def _(spark, d):
    codes = spark.createDataFrame([("view", 1), ("click", 2)], "event_type string, code int")
    return fr.fallback_lookup(table(spark, d, "events"), [(codes, ["event_type"], "code")], 0, "__c").select("event_id", F.col("__c").alias("code"))


@query(
    "r039_static_dimension_join",
    "SELECT o_orderkey, printf('%.2f', CAST(c_nationkey AS DOUBLE)) AS zone FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
)
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), s.decimal_id(F.col("c_nationkey")).alias("zone"))
    return fr.left_join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"]).select("o_orderkey", "zone")


@query("r045_nearest_neighbours", """WITH p AS (SELECT s_suppkey AS id, s_acctbal AS x, CAST(s_suppkey * 37 % 101 AS DOUBLE) * 100 AS y FROM supplier),
    r AS (SELECT a.id AS source, b.id AS target, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM p a JOIN p b ON a.id <> b.id),
    n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY d, target) AS k FROM r) SELECT source, target, round(d, 6) AS distance, CAST(k AS BIGINT) AS knn_rank FROM n WHERE k <= 4""")
def _(spark, d):
    p = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_acctbal").alias("x"),
        ((F.col("s_suppkey") * 37 % 101).cast("double") * 100).alias("y"),
    )
    return fr.nearest(p, "id", "x", "y", 4).select("source", "target", r6("distance", "distance"), F.col("knn_rank").cast("long").alias("knn_rank"))


@query("r049_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 490000)")
def _(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 490000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("r049_anti_join", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def _(spark, d):
    used = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(used, "p_partkey", "left_anti").select("p_partkey")


@query(
    "r050_outer_audit",
    "SELECT coalesce(c_custkey, u) AS id, CASE WHEN c_custkey IS NULL THEN 'right_only' WHEN u IS NULL THEN 'left_only' ELSE 'both' END AS side FROM customer FULL JOIN (SELECT DISTINCT user_id AS u FROM events) ON c_custkey = u",
)
def _(spark, d):
    return fr.outer_audit(
        table(spark, d, "customer").select(F.col("c_custkey").alias("id")),
        table(spark, d, "events").select(F.col("user_id").alias("id")),
        ["id"],
    )


@query("r051_name_repair", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'Zone ' || n_nationkey ELSE n_name END AS name FROM nation")
def _(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, " NaN ").otherwise(F.col("n_name")).alias("name"))
    lookup = n.select("n_nationkey", F.concat(F.lit("Zone "), F.col("n_nationkey")).alias("name"))
    return fr.repair_names(n, lookup, "n_nationkey", "name")


@query(
    "r052_crosswalk",
    "SELECT n_regionkey AS region, CAST(count(*) AS BIGINT) AS units, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
)
def _(spark, d):
    walk = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("region"))
    return fr.left_join(table(spark, d, "customer"), walk, ["c_nationkey"]).groupBy("region").agg(
        F.count(F.lit(1)).alias("units"),
        F.round(F.sum("c_acctbal"), 2).alias("balance"),
    )


@query("r053_hand_repairs", "SELECT s_suppkey, CASE s_suppkey WHEN 1 THEN 7 WHEN 5 THEN 8 ELSE s_nationkey END AS s_nationkey FROM supplier")
def _(spark, d):
    repairs = spark.createDataFrame([(1, 7), (5, 8)], "s_suppkey long, s_nationkey int")
    return fr.overlay(table(spark, d, "supplier"), repairs, "s_suppkey", ["s_nationkey"]).select("s_suppkey", "s_nationkey")


@query("r054_asof_join", """SELECT e.event_id, p.value AS last_purchase FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p
    ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'error'""")
def _(spark, d):
    e = table(spark, d, "events")
    p = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return fr.asof_join(e.where("event_type = 'error'").select("event_id", "user_id", "ts"), p, ["user_id"], "ts", "value", "last_purchase").select(
        "event_id",
        "last_purchase",
    )


@query("r054_interval_join", """WITH b AS (SELECT user_id, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to, event_id AS period_id FROM events WHERE event_type = 'signup')
    SELECT e.event_id, b.period_id FROM events e LEFT JOIN b ON e.user_id = b.user_id AND b.valid_from <= e.ts AND (b.valid_to IS NULL OR e.ts < b.valid_to) WHERE e.event_type = 'purchase'""")
def _(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "events")
    nxt = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    b = e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("valid_from"), nxt.alias("valid_to"), F.col("event_id").alias("period_id"))
    return fr.interval_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), b, ["user_id"], "ts", "valid_from", "valid_to").select(
        "event_id",
        "period_id",
    )


@query("r054_interval_join_bucketed", """WITH b AS (SELECT user_id, event_id AS period_id, ts AS valid_from, CASE WHEN event_id % 3 <> 0 THEN ts + INTERVAL 40 DAY END AS valid_to FROM events WHERE event_type = 'signup')
    SELECT e.event_id, b.period_id FROM events e LEFT JOIN b ON e.user_id = b.user_id AND b.valid_from <= e.ts AND (b.valid_to IS NULL OR e.ts < b.valid_to) WHERE e.event_type = 'purchase'""")
def _(spark, d):
    """Intervals that overlap and leave gaps, met in buckets of 30 days."""
    e = table(spark, d, "events")
    until = F.when(F.col("event_id") % 3 != 0, F.col("ts") + F.expr("INTERVAL 40 DAY"))
    b = e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("valid_from"), until.alias("valid_to"), F.col("event_id").alias("period_id"))
    return fr.interval_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), b, ["user_id"], "ts", "valid_from", "valid_to", bucket=30 * 86400.0).select(
        "event_id",
        "period_id",
    )


@query(
    "r113_union_by_name",
    "SELECT n_nationkey AS id, n_name AS name, NULL AS segment FROM nation UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer",
)
def _(spark, d):
    a = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return fr.union_all(a, b)


@query("r116_except", "SELECT c_custkey AS id FROM customer EXCEPT SELECT user_id FROM events")
def _(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id")).subtract(table(spark, d, "events").select(F.col("user_id").alias("id")))


@query(
    "r117_id_overlap",
    "SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT user_id FROM events)) AS common, (SELECT count(*) FROM customer) AS left_ids, (SELECT count(DISTINCT user_id) FROM events) AS right_ids",
)
def _(spark, d):
    a = fr.outer_audit(
        table(spark, d, "customer").select(F.col("c_custkey").alias("id")),
        table(spark, d, "events").select(F.col("user_id").alias("id")),
        ["id"],
    )
    return a.agg(
        F.count_if(F.col("side") == "both").alias("common"),
        F.count_if(F.col("side") != "right_only").alias("left_ids"),
        F.count_if(F.col("side") != "left_only").alias("right_ids"),
    )


@query("r118_combine_first", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, o_orderpriority) AS first FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.coalesce(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")), "o_orderpriority").alias("first"),
    )


@query("r210_repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


QUERIES, ORACLE_SQL = query.queries, query.sql
