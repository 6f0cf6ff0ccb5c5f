"""Queries: polygons, their joins and projections, and random graphs.

Zones are right triangles: each square of 1000 that holds a customer's (balance,
key) is cut along its falling diagonal into a lower and an upper one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from zonalyx.functions import projections as pj
from zonalyx.functions import scalar as s
from zonalyx.operators import graph as g
from zonalyx.operators import spatial as sp
from zonalyx.plans.base import Register, r6, table, zones
from zonalyx.plans.q_index import _N, _edges, _nodes, _pairs

query = Register()
SIDE = 1000


def _point(x, y):
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _squares(spark, d):
    c = table(spark, d, "customer")
    low = lambda x: (F.floor(x / SIDE) * SIDE).cast("long")
    return c.select(low(F.col("c_acctbal")).alias("x0"), low(F.col("c_custkey")).alias("y0")).distinct()


def _triangles(spark, d):
    """zone, rings."""
    x, y = F.col("x0"), F.col("y0")
    a, b, c, e = _point(x, y), _point(x + SIDE, y), _point(x, y + SIDE), _point(x + SIDE, y + SIDE)
    name = lambda k: F.concat(x.cast("string"), F.lit("_"), y.cast("string"), F.lit(k))
    both = F.array(
        F.struct(name("L").alias("zone"), F.array(F.array(a, b, c, a)).alias("rings")),
        F.struct(name("U").alias("zone"), F.array(F.array(b, e, c, b)).alias("rings")),
    )
    return _squares(spark, d).select(F.explode(both).alias("t")).select("t.*")


def _points(spark, d):
    c = table(spark, d, "customer")
    return c.select(
        "c_custkey",
        F.when(F.col("c_custkey") % 50 != 7, F.round("c_acctbal", -1)).alias("x"),
        (F.col("c_custkey") * 10 % 1500).cast("double").alias("y"),
    )


_SQ = f"""sq AS (SELECT DISTINCT CAST(floor(c_acctbal / {SIDE}) * {SIDE} AS BIGINT) AS x0, CAST(floor(c_custkey / {SIDE}.0) * {SIDE} AS BIGINT) AS y0 FROM customer),
    tri AS (SELECT x0, y0, h, x0 || '_' || y0 || h AS zone FROM sq, (VALUES ('L'), ('U')) t(h))"""
_HIT = f"""pts AS (SELECT c_custkey, CASE WHEN c_custkey % 50 <> 7 THEN round(c_acctbal, -1) END AS x, CAST(c_custkey * 10 % 1500 AS DOUBLE) AS y FROM customer),
    hits AS (
        SELECT c_custkey, zone, (x > x0 AND x < x0 + {SIDE} AND y > y0 AND y < y0 + {SIDE} AND x - x0 + y - y0 <> {SIDE}) AS inner_ FROM pts JOIN tri
        ON x BETWEEN x0 AND x0 + {SIDE} AND y BETWEEN y0 AND y0 + {SIDE}
        AND (CASE h WHEN 'L' THEN x - x0 + y - y0 <= {SIDE} ELSE x - x0 + y - y0 >= {SIDE} END)),
    found AS (SELECT c_custkey, min(zone) FILTER (inner_) AS a, count(*) FILTER (inner_) AS n, min(zone) FILTER (NOT inner_) AS b, count(*) FILTER (NOT inner_) AS m FROM hits GROUP BY 1),
    assigned AS (
        SELECT c_custkey, coalesce(a, b) AS zone,
               CASE WHEN n > 0 THEN '{sp.WITHIN}' WHEN m > 0 THEN '{sp.FALLBACK}' ELSE '{sp.UNMATCHED}' END AS method,
               CAST(CASE WHEN n > 0 THEN n ELSE coalesce(m, 0) END AS BIGINT) AS n_zones
        FROM pts LEFT JOIN found USING (c_custkey))"""


@query("r041_boundary_fallback", f"WITH {_SQ}, {_HIT} SELECT * FROM assigned")
def _(spark, d):
    return sp.point_in_polygon(_points(spark, d), _triangles(spark, d), "c_custkey", "zone").select("c_custkey", "zone", "method", "n_zones")


@query(
    "r158_assignment_summary",
    f"""WITH {_SQ}, {_HIT} SELECT count(*) AS n, count(zone) AS matched, count(*) - count(zone) AS unmatched, count(*) FILTER (method = '{sp.WITHIN}') AS within,
    count(*) FILTER (method = '{sp.FALLBACK}') AS boundary, count(*) FILTER (n_zones > 1) AS multi_zone, round(count(zone) * 1.0 / count(*), 6) AS share_matched,
    round(sum(CASE WHEN zone IS NOT NULL THEN c_custkey END) * 1.0 / sum(c_custkey), 6) AS share_units FROM assigned""",
)
def _(spark, d):
    a = sp.point_in_polygon(_points(spark, d).withColumn("units", F.col("c_custkey")), _triangles(spark, d), "c_custkey", "zone")
    return sp.assignment_summary(a, "zone", "units").withColumn("share_matched", r6("share_matched")).withColumn("share_units", r6("share_units"))


@query(
    "r042_overlay",
    """WITH s AS (SELECT n_nationkey AS source, n_nationkey % 5 * 10.0 AS x0, n_nationkey // 5 * 10.0 AS y0, 10.0 AS w, 10.0 AS h FROM nation),
    t AS (SELECT n_nationkey AS target, n_nationkey % 5 * 7.0 + 3 AS x0, n_nationkey // 5 * 13.0 - 2 AS y0, 7.0 AS w, 13.0 AS h FROM nation),
    o AS (SELECT source, target, greatest(least(s.x0 + s.w, t.x0 + t.w) - greatest(s.x0, t.x0), 0) * greatest(least(s.y0 + s.h, t.y0 + t.h) - greatest(s.y0, t.y0), 0) AS overlap, greatest(s.x0, t.x0) AS x0, least(s.y0 + s.h, t.y0 + t.h) AS y1 FROM s, t)
    SELECT source, target, CAST(round(overlap, 6) AS DOUBLE) AS overlap, CAST(round(overlap / sum(overlap) OVER (PARTITION BY target), 6) AS DOUBLE) AS share_of_target,
    CAST(round(overlap / 100, 6) AS DOUBLE) AS share_of_source, CAST(round(overlap, 6) AS DOUBLE) AS ring_area, CAST(x0 AS DOUBLE) AS x0, CAST(y1 AS DOUBLE) AS y1, 1 AS n_rings, 4 AS corners FROM o WHERE overlap > 0""",
)
def _(spark, d):
    def grid(name, w, h, dx, dy):
        n = table(spark, d, "nation")
        x, y = (F.col("n_nationkey") % 5) * w + dx, F.floor(F.col("n_nationkey") / 5) * h + dy
        # corners and the middles of two sides, and the ring the other way round for every other rectangle
        ring = F.array(_point(x, y), _point(x + w / 2, y), _point(x + w, y), _point(x + w, y + h), _point(x, y + h), _point(x, y))
        turned = F.when(F.col("n_nationkey") % 2 == 0, ring).otherwise(F.reverse(ring))
        return n.select(F.col("n_nationkey").alias(name), F.array(turned).alias("rings"))

    o = sp.overlay(grid("source", 10.0, 10.0, 0.0, 0.0), grid("target", 7.0, 13.0, 3.0, -2.0), "source", "target")
    ring = F.col("rings")[0]
    box = s.ring_bounds(ring)
    ends = [r6(box[0], "x0"), r6(box[3], "y1"), F.size("rings").alias("n_rings"), (F.size(ring) - 1).alias("corners")]
    return o.select("source", "target", *[r6(c, c) for c in ("overlap", "share_of_target", "share_of_source")], r6(s.ring_signed_area(ring), "ring_area"), *ends)


@query(
    "r043_adjacency",
    f"""WITH {_SQ} SELECT a.zone AS source, b.zone AS target FROM tri a JOIN tri b ON a.zone <> b.zone AND abs(a.x0 - b.x0) <= {SIDE} AND abs(a.y0 - b.y0) <= {SIDE}
    WHERE CASE WHEN a.h = 'L' AND b.h = 'L' THEN b.x0 - a.x0 + b.y0 - a.y0 BETWEEN -{SIDE} AND {SIDE}
               WHEN a.h = 'U' AND b.h = 'U' THEN b.x0 - a.x0 + b.y0 - a.y0 BETWEEN -{SIDE} AND {SIDE}
               WHEN a.h = 'L' THEN b.x0 - a.x0 <= 0 AND b.y0 - a.y0 <= 0 OR (b.x0 - a.x0 = {SIDE} AND b.y0 - a.y0 = -{SIDE}) OR (b.y0 - a.y0 = {SIDE} AND b.x0 - a.x0 = -{SIDE})
               ELSE a.x0 - b.x0 <= 0 AND a.y0 - b.y0 <= 0 OR (a.x0 - b.x0 = {SIDE} AND a.y0 - b.y0 = -{SIDE}) OR (a.y0 - b.y0 = {SIDE} AND a.x0 - b.x0 = -{SIDE}) END""",
)
def _(spark, d):
    return sp.adjacent(_triangles(spark, d), "zone")


@query(
    "r044_shared_boundary",
    f"""WITH {_SQ}, p AS (
        SELECT u.zone AS a, l.zone AS b, CASE WHEN u.x0 = l.x0 AND u.y0 = l.y0 THEN {SIDE} * sqrt(2) ELSE {SIDE} END AS len FROM tri u JOIN tri l ON u.h = 'U' AND l.h = 'L'
        AND ((u.x0 = l.x0 AND u.y0 = l.y0) OR (l.x0 = u.x0 + {SIDE} AND l.y0 = u.y0) OR (l.y0 = u.y0 + {SIDE} AND l.x0 = u.x0)))
    SELECT least(a, b) AS source, greatest(a, b) AS target, CAST(round(len, 6) AS DOUBLE) AS shared_length FROM p""",
)
def _(spark, d):
    return sp.adjacent_by_length(_triangles(spark, d), "zone", least=1.0).withColumn("shared_length", r6("shared_length"))


_LCC = """k AS (SELECT 6378137.0 AS a, 1 / 298.257222101 AS f), q AS (SELECT *, sqrt(f * (2 - f)) AS e FROM k),
    m AS (SELECT *, cos(radians(49)) / sqrt(1 - pow(e * sin(radians(49)), 2)) AS m1, cos(radians(77)) / sqrt(1 - pow(e * sin(radians(77)), 2)) AS m2,
        tan(pi() / 4 - radians(49) / 2) / pow((1 - e * sin(radians(49))) / (1 + e * sin(radians(49))), e / 2) AS t1,
        tan(pi() / 4 - radians(77) / 2) / pow((1 - e * sin(radians(77))) / (1 + e * sin(radians(77))), e / 2) AS t2,
        tan(pi() / 4 - radians(63.390675) / 2) / pow((1 - e * sin(radians(63.390675))) / (1 + e * sin(radians(63.390675))), e / 2) AS t0 FROM q),
    c AS (SELECT *, ln(m1 / m2) / ln(t1 / t2) AS n FROM m), r AS (SELECT *, a * m1 / (n * pow(t1, n)) AS s FROM c)"""


@query(
    "r154_lambert",
    f"""WITH {_LCC}, p AS (SELECT c_custkey, -80 + c_acctbal / 1000 AS lon, 45.0 + c_nationkey AS lat FROM customer)
    SELECT c_custkey, round(s * pow(t, n) * sin(n * radians(lon + 91.866666666666667)) + 6200000, 3) AS x, round(s * pow(t0, n) - s * pow(t, n) * cos(n * radians(lon + 91.866666666666667)) + 3000000, 3) AS y
    FROM (SELECT *, tan(pi() / 4 - radians(lat) / 2) / pow((1 - e * sin(radians(lat))) / (1 + e * sin(radians(lat))), e / 2) AS t FROM p, r)""",
)
def _(spark, d):
    x, y = pj.lambert_conic(F.col("c_acctbal") / 1000 - 80, F.col("c_nationkey") + 45.0)
    return table(spark, d, "customer").select("c_custkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


_TM = """WITH k AS (SELECT 6378137.0 AS a, 1 / 298.257222101 AS f), q AS (SELECT *, sqrt(f * (2 - f)) AS e, f / (2 - f) AS n FROM k),
    c AS (SELECT *, [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280] AS al,
        0.9999 * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64) AS ka FROM q),
    p AS (SELECT c_custkey, -75.5 + c_custkey % 5 AS lon, 44.0 + c_nationkey * 0.7 + c_acctbal / 20000 AS lat FROM customer),
    t AS (SELECT *, sinh(atanh(sin(radians(lat))) - e * atanh(e * sin(radians(lat)))) AS t, radians(lon + 73.5) AS w FROM p, c),
    u AS (SELECT *, atan2(t, cos(w)) AS xi, atanh(sin(w) / sqrt(1 + t * t)) AS eta FROM t),
    m AS (SELECT *, ka * (eta + list_sum(list_transform([1, 2, 3, 4], lambda k: al[k] * cos(2 * k * xi) * sinh(2 * k * eta)))) + 304800 AS x,
        ka * (xi + list_sum(list_transform([1, 2, 3, 4], lambda k: al[k] * sin(2 * k * xi) * cosh(2 * k * eta)))) AS y FROM u)"""


def _around_axis(spark, d):
    """Customers at five longitudes from two degrees west of the axis to two east."""
    c = table(spark, d, "customer")
    return c.select("c_custkey", (F.col("c_custkey") % 5 - 75.5).alias("lon"), (F.col("c_nationkey") * 0.7 + F.col("c_acctbal") / 20000 + 44.0).alias("lat"))


@query("r154_mtm", f"{_TM} SELECT c_custkey, round(x, 3) AS x, round(y, 3) AS y FROM m")
def _(spark, d):
    x, y = pj.transverse_mercator(F.col("lon"), F.col("lat"))
    return _around_axis(spark, d).select("c_custkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(
    "r154_inverse",
    f"{_TM} SELECT c_custkey, round(lon, 8) + 0 AS lon, round(lat, 8) AS lat, round(lon, 8) + 0 AS conic_lon, round(lat, 8) AS conic_lat FROM m",
)
def _(spark, d):
    """Back from both projections to the degrees that they came from."""
    p = _around_axis(spark, d).withColumn("m", F.struct(*[c.alias(n) for c, n in zip(pj.transverse_mercator(F.col("lon"), F.col("lat")), "xy", strict=True)]))
    p = p.withColumn("l", F.struct(*[c.alias(n) for c, n in zip(pj.lambert_conic(F.col("lon"), F.col("lat")), "xy", strict=True)]))
    (a, b), (c, e) = pj.transverse_inverse(F.col("m.x"), F.col("m.y")), pj.lambert_inverse(F.col("l.x"), F.col("l.y"))
    return p.select("c_custkey", *[F.round(v, 8).alias(n) for v, n in ((a, "lon"), (b, "lat"), (c, "conic_lon"), (e, "conic_lat"))])


@query("r155_centroid_lonlat", f"{_TM} SELECT c_custkey, round(lon, 8) + 0 AS lon, round(lat, 8) AS lat, CAST(1000.0 * (c_custkey % 4 + 1) AS DOUBLE) AS area FROM m")
def _(spark, d):
    """Centroids, in degrees, of rectangles given in metres of the conic."""
    p = _around_axis(spark, d).withColumn("c", F.struct(*[c.alias(n) for c, n in zip(pj.lambert_conic(F.col("lon"), F.col("lat")), "xy", strict=True)]))
    w, h = 25.0 * (F.col("c_custkey") % 4 + 1), F.lit(10.0)
    ring = F.array(*[_point(F.col("c.x") + w * a, F.col("c.y") + h * b) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])
    r = F.col("ring")
    p = p.select("c_custkey", ring.alias("ring"))
    lon, lat = pj.lambert_inverse(*s.ring_centroid(r))
    return p.select("c_custkey", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"), F.round(s.ring_area(r), 3).alias("area"))


_SHIFT = (-10.0, 158.0, 187.0, 0.1, -0.2, 0.3, 1.5)


@query(
    "r154_datum_shift",
    """WITH p AS (SELECT c_custkey, radians(-75.5 + c_custkey % 5) AS lon, radians(44.0 + c_nationkey * 0.7 + c_acctbal / 20000) AS lat, 6378206.4 AS a, 1 / 294.978698214 AS f FROM customer),
    n AS (SELECT *, a / sqrt(1 - sin(lat) * sin(lat) * f * (2 - f)) AS n FROM p),
    g AS (SELECT c_custkey, n * cos(lat) * cos(lon) AS x, n * cos(lat) * sin(lon) AS y, n * (1 - f) * (1 - f) * sin(lat) AS z,
        radians(0.1 / 3600) AS rx, radians(-0.2 / 3600) AS ry, radians(0.3 / 3600) AS rz, 1.0000015 AS m FROM n)
    SELECT c_custkey, round((x - y * rz + z * ry) * m - 10, 3) AS x, round((x * rz + y - z * rx) * m + 158, 3) AS y, round((y * rx - x * ry + z) * m + 187, 3) AS z FROM g""",
)
def _(spark, d):
    """Clarke 1866 to GRS 80 by seven parameters; compared as metres from the earth's centre."""
    p = _around_axis(spark, d)
    p = p.withColumn("g", F.struct(*[c.alias(n) for c, n in zip(pj.datum_shift(F.col("lon"), F.col("lat"), _SHIFT), ("lon", "lat", "h"), strict=True)]))
    x, y, z = pj.geocentric(F.col("g.lon"), F.col("g.lat"), F.col("g.h"), pj.GRS80)
    return p.select("c_custkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(z, 3).alias("z"))


@query(
    "r156_cut_crossings",
    """WITH b AS (SELECT c_custkey, c_nationkey + 1.0 AS w, c_custkey % 7 + 1.0 AS h, c_custkey % 3 AS k FROM customer)
    SELECT c_custkey, CASE k WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 2 END AS n_rings, round(CASE k WHEN 0 THEN w * h / 2 WHEN 1 THEN w * h ELSE w * h * 8 END, 6) AS area,
        CASE k WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 4 END AS corners, true AS valid FROM b""",
)
def _(spark, d):
    """0: a bow tie, two triangles; 1: a rectangle with a spike and a repeated point; 2: a rectangle whose ring runs on around a hole."""
    w, h = F.col("c_nationkey") + 1.0, F.col("c_custkey") % 7 + 1.0
    at = lambda *points: F.array(*[_point(w * x, h * y) for x, y in points])
    k = F.col("c_custkey") % 3
    ring = F.when(k == 0, at((0, 0), (1, 1), (1, 0), (0, 1), (0, 0))).when(k == 1, at((0, 0), (1, 0), (3, 0), (1, 0), (1, 1), (1, 1), (0, 1))).otherwise(
        at((0, 0), (3, 0), (3, 3), (0, 3), (0, 0), (1, 1), (1, 2), (2, 2), (2, 1), (1, 1), (0, 0))
    )
    cut = sp.cut_crossings(table(spark, d, "customer").select("c_custkey", F.array(ring).alias("rings")))
    area = F.abs(F.aggregate("rings", F.lit(0.0), lambda n, r: n + s.ring_signed_area(r)))
    return cut.select("c_custkey", F.size("rings").alias("n_rings"), F.round(area, 6).alias("area"), (F.array_max(F.transform("rings", F.size)) - 1).alias("corners"), sp.valid_polygon(F.col("rings")).alias("valid"))


@query(
    "r156_repair",
    "SELECT n_nationkey, n_nationkey % 4 <> 3 AS valid_before, n_nationkey % 4 <> 1 AS valid_after, CASE WHEN n_nationkey % 4 = 2 THEN CAST(NULL AS DOUBLE) WHEN n_nationkey % 4 = 1 THEN 0.0 ELSE 16.0 END AS area FROM (SELECT n_nationkey, n_nationkey % 4 AS k FROM nation) WHERE k <> 2 AND k <> 1 UNION ALL SELECT n_nationkey, false, false, NULL FROM nation WHERE n_nationkey % 4 IN (1, 2)",
)
def _(spark, d):
    # 0: a square; 1: a ring that crosses itself; 2: a line there and back; 3: a square not closed, with a repeated point
    at = lambda *xy: F.array(*[_point(F.lit(x), F.lit(y)) for x, y in xy])
    k = F.col("n_nationkey") % 4
    ring = F.when(k == 0, at((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))).when(k == 1, at((0, 0), (4, 4), (4, 0), (0, 3), (0, 0))).when(k == 2, at((0, 0), (4, 0), (0, 0))).otherwise(
        at((0, 0), (4, 0), (4, 0), (4, 4), (0, 4))
    )
    n = table(spark, d, "nation").select("n_nationkey", F.array(ring).alias("rings"))
    n = n.withColumn("after", sp.repair(F.col("rings")))
    ok = sp.valid_polygon(F.col("after"))
    return n.select(
        "n_nationkey",
        sp.valid_polygon(F.col("rings")).alias("valid_before"),
        F.coalesce(ok, F.lit(False)).alias("valid_after"),
        F.when(ok, s.ring_area(F.col("after")[0])).alias("area"),
    )


@query(
    "r159_pairwise_distances",
    "WITH z AS (SELECT c_nationkey AS zone_id, CAST(count(*) AS DOUBLE) AS x, avg(c_acctbal) AS y FROM customer GROUP BY 1) SELECT a.zone_id AS source, b.zone_id AS target, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS distance FROM z a, z b",
)
def _(spark, d):
    z = zones(spark, d).select("zone_id", F.col("population").cast("double").alias("x"), F.col("balance").alias("y"))
    return sp.pairwise_distances(z, "zone_id").withColumn("distance", r6("distance"))


_PAIRS = "p AS (SELECT DISTINCT least(o_custkey, o_orderkey % 997) AS u, greatest(o_custkey, o_orderkey % 997) AS v FROM orders WHERE o_custkey <> o_orderkey % 997)"


def _random_pairs(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("source"), (F.col("o_orderkey") % 997).alias("target"))


@query(
    "r160_rewire_degrees",
    f"WITH {_PAIRS} SELECT node, count(*) AS degree, CAST(0 AS BIGINT) AS loops, CAST(0 AS BIGINT) AS repeats FROM (SELECT u AS node FROM p UNION ALL SELECT v FROM p) GROUP BY 1",
)
def _(spark, d):
    """What a rewired graph must keep: each node's degree; and it has no loops and no repeated edges."""
    return g.undirected_degrees(g.rewire(_random_pairs(spark, d)))


@query("r160_rewire")
def _(spark, d):
    return g.rewire(_random_pairs(spark, d))


@query(
    "r161_placebo_degrees",
    f"WITH {_N} SELECT source, count(*) AS out_degree, CAST(0 AS BIGINT) AS loops, CAST(0 AS BIGINT) AS other_months FROM edges WHERE edge_type = 'knn' GROUP BY 1",
)
def _(spark, d):
    """What placebo edges must keep: each source's out-degree; no loops, and targets of the source's month."""
    n = _nodes(spark, d)
    e = g.placebo_edges(g.month_edges(_pairs(spark, d), n, "zone_id", "m", "knn"), n, "m")
    of = lambda end: n.select(F.col("node_id").alias(end), F.col("m").alias(f"{end}_m"))
    e = e.join(of("source"), "source").join(of("target"), "target")
    return e.groupBy("source").agg(
        F.count(F.lit(1)).alias("out_degree"),
        F.count_if(F.col("source") == F.col("target")).alias("loops"),
        F.count_if(F.col("source_m") != F.col("target_m")).alias("other_months"),
    )


@query(
    "r163_edge_masks",
    f"WITH {_N} SELECT e.source, e.target, edge_type, true AS t_all, a.split = 'train' AND b.split = 'train' AS t_train_train, a.split <> 'test' AND b.split <> 'test' AS t_no_test FROM edges e JOIN n a ON a.node_id = e.source JOIN n b ON b.node_id = e.target",
)
def _(spark, d):
    n = _nodes(spark, d)
    return g.edge_masks(g.annotate(_edges(spark, d, n), n, "split"), "t").select("source", "target", "edge_type", "t_all", "t_train_train", "t_no_test")


QUERIES, ORACLE_SQL = query.queries, query.sql
