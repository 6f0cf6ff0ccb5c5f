"""Cutting the plane by polygons, overlay with rings, and projections there and back."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from zonalyx.functions import projections as pj
from zonalyx.operators import spatial as sl
from zonalyx.operators.planar import region, regions


def ring(*xy):
    return [{"x": float(x), "y": float(y)} for x, y in xy]


def star(n, cx, cy, seed, size=1.0):
    r = random.Random(seed)
    p = [(cx + q * math.cos(2 * math.pi * k / n), cy + q * math.sin(2 * math.pi * k / n)) for k in range(n) for q in [size * (0.5 + r.random() / 2)]]
    return ring(*p, p[0])


def shoelace(points):
    return sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(points, points[1:], strict=False)) / 2


def convex_clip(subject, clip):
    """The part of a polygon inside a convex one that turns left, point by point."""
    for (ax, ay), (bx, by) in zip(clip, clip[1:], strict=False):
        out = []
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in subject]
        for k, (q, t) in enumerate(zip(subject, side, strict=True)):
            p, s = subject[k - 1], side[k - 1]
            if (s >= 0) != (t >= 0):
                out.append((p[0] + s / (s - t) * (q[0] - p[0]), p[1] + s / (s - t) * (q[1] - p[1])))
            if t >= 0:
                out.append(q)
        subject = out
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(subject, subject[1:] + subject[:1], strict=True))) / 2


def test_regions_against_clipping_and_themselves():
    for seed in range(40):
        r = random.Random(seed)
        a = star(17, 0, 0, seed)
        box = [(x, y) for x, y in ((-0.6, -0.5), (0.7, -0.4), (0.5, 0.8), (-0.4, 0.6), (-0.6, -0.5))]
        rings, area = region([a], [ring(*box)])
        want = convex_clip([(p["x"], p["y"]) for p in a[:-1]], box)
        assert area == pytest.approx(want, abs=1e-9)
        assert sum(shoelace(ring(*x)) for x in rings) == pytest.approx(area, abs=1e-9)
        b = [star(23, 0.3, 0.2, seed + 99), star(9, 0.3, 0.2, seed, 0.3)]
        both, one, other = region([a], b)[1], region([a])[1], region(b)[1]
        again = region([ring(*x) for x in region([a], b)[0]])
        assert again[1] == pytest.approx(both, abs=1e-9) and both <= min(one, other) + 1e-9
        # of a sheet's two halves each takes its part
        cut = r.uniform(-0.4, 0.4)
        left, right = ring((-2, -2), (cut, -2), (cut, 2), (-2, 2), (-2, -2)), ring((cut, -2), (2, -2), (2, 2), (cut, 2), (cut, -2))
        assert region([a], [left])[1] + region([a], [right])[1] == pytest.approx(one, abs=1e-9)


def test_special_positions():
    square = ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))
    assert region([square], [square])[1] == pytest.approx(16) and len(region([square], [square])[0][0]) == 5
    assert region([square], [ring((4, 0), (8, 0), (8, 4), (4, 4), (4, 0))]) == ([], 0.0)
    assert region([square], [ring((4, 4), (5, 4), (5, 5), (4, 4))]) == ([], 0.0)
    assert region([square], [ring((1, 0), (2, 0), (2, 4), (1, 4), (1, 0))])[1] == pytest.approx(4)
    assert region([square, ring((1, 1), (1, 2), (2, 2), (2, 1), (1, 1))])[1] == pytest.approx(15)
    assert region([]) == ([], 0.0) and region([square], []) == ([], 0.0) and region([ring((0, 0), (1, 1), (0, 0))]) == ([], 0.0)
    bow, area = region([ring((0, 0), (2, 2), (2, 0), (0, 2), (0, 0))])
    assert len(bow) == 2 and area == pytest.approx(2) and all(len(b) == 4 for b in bow)
    twice = region([square, square])
    assert twice == ([], 0.0)
    far = [[{"x": p["x"] + 7e6, "y": p["y"] + 1e6} for p in square]]
    assert region(far, far)[1] == pytest.approx(16, rel=1e-6)


def test_polygons_of_five_thousand_points_take_less_than_seconds():
    def coast(cx, cy):
        turn = [2 * math.pi * k / 5000 for k in range(5000)]
        p = [(cx + d * math.cos(a), cy + d * math.sin(a)) for a in turn for d in [1 + 0.2 * math.sin(9 * a) + 0.01 * math.sin(200 * a)]]
        return [ring(*p, p[0])]

    began = time.perf_counter()
    rings, area = region(coast(0, 0), coast(0.3, 0.1))
    assert len(rings) == 1 and 2 < area < 3 and time.perf_counter() - began < 5


def test_overlay_gives_rings_and_cut_keeps_rows(spark):
    kind = "zone string, rings array<array<struct<x: double, y: double>>>, note string"
    hole = ring((1, 1), (1, 2), (2, 2), (2, 1), (1, 1))
    a = spark.createDataFrame([("a", [ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0)), hole], "x"), ("n", None, "y"), ("e", [], "z")], kind)
    b = spark.createDataFrame([("b", [ring((0, 0), (3, 0), (3, 3), (0, 3))], ""), ("c", [ring((9, 9), (10, 9), (10, 10), (9, 9))], "")], kind)
    o = sl.overlay(a, b.withColumnRenamed("zone", "t"), "zone", "t").collect()
    assert [(x.zone, x.t, round(x.overlap, 9), round(x.share_of_source, 9)) for x in o] == [("a", "b", 8.0, round(8 / 15, 9))]
    assert sorted(round(shoelace([p.asDict() for p in q]), 9) for q in o[0].rings) == [-1.0, 9.0]
    cut = {x.zone: x for x in sl.cut_crossings(a).collect()}
    assert len(cut["a"].rings) == 2 and cut["n"].rings is None and cut["e"].rings is None and cut["n"].note == "y"


def test_projections_there_and_back(spark):
    d = spark.createDataFrame([(-79.5 + k * 2.3, 43.0 + m * 3.1) for k in range(10) for m in range(7)] + [(-73.5, 62.0), (-73.5, 45.0)], "lon double, lat double")
    lon, lat = F.col("lon"), F.col("lat")
    metre = 9e-12  # of a degree, a millionth of a metre

    def worst(there, back, rows):
        p = rows.withColumn("m", F.struct(*[c.alias(n) for c, n in zip(there(lon, lat), "xy", strict=True)]))
        a, b = back(F.col("m.x"), F.col("m.y"))
        return max(p.select(F.greatest(F.max(F.abs(a - lon)), F.max(F.abs(b - lat)))).first())

    assert worst(pj.lambert_conic, pj.lambert_inverse, d) < 5 * metre
    assert worst(pj.transverse_mercator, pj.transverse_inverse, d.where("abs(lon + 73.5) < 3")) < 5 * metre
    from zonalyx.functions.scalar import web_mercator

    assert worst(web_mercator, pj.web_mercator_inverse, d) < 5 * metre
    shift = (-10.0, 158.0, 187.0, 0.1, -0.2, 0.3, 1.5)
    g = d.select(lon, lat, F.struct(*[c.alias(n) for c, n in zip(pj.datum_shift(lon, lat, shift), "xyz", strict=True)]).alias("g"))
    far = g.select(F.hypot((F.col("g.x") - lon) * 111320 * F.cos(F.radians(lat)), (F.col("g.y") - lat) * 111320).alias("m"), F.abs("g.z").alias("h"))
    assert far.where("m between 1 and 300 and h < 300").count() == d.count()
    same = d.select(F.struct(*[c.alias(n) for c, n in zip(pj.datum_shift(lon, lat, (0.0,) * 7, pj.GRS80, pj.GRS80), "xyz", strict=True)]).alias("g"), lon, lat)
    assert same.where((F.abs(F.col("g.x") - lon) > metre) | (F.abs(F.col("g.y") - lat) > 5 * metre) | (F.abs("g.z") > 1e-6)).count() == 0


def test_planes_cut_together_are_cut_as_alone():
    draw = random.Random(5)
    some = lambda n: ring(*[(draw.randint(0, 6), draw.randint(0, 6)) for _ in range(n)])
    planes = [([some(draw.randint(0, 12)) for _ in range(draw.randint(0, 3))],) for _ in range(200)] + [(None,), ([None],), ([some(40)],)]
    for got, polygons in zip(regions(planes), planes, strict=True):
        rings, area = region(*polygons)
        assert got[1] == area and len(got[0]) == len(rings) and all((a == b).all() for a, b in zip(got[0], rings, strict=True))
    pairs = [([some(7)], [some(9)]) for _ in range(50)]
    assert [g[1] for g in regions(pairs)] == [region(*p)[1] for p in pairs]


def test_small_polygons_of_one_file_are_cut_by_many_tasks_together(spark):
    bow = lambda k: [ring((0, 0), (k, k), (k, 0), (0, k), (0, 0))]
    many = spark.createDataFrame([(k, bow(k % 9 + 1.0) if k % 10 else None) for k in range(3000)], "zone long, rings array<array<struct<x: double, y: double>>>").coalesce(1)
    cut = sl.cut_crossings(many)
    assert cut.rdd.getNumPartitions() >= 4
    got = {r.zone: r.rings for r in cut.collect()}
    assert len(got) == 3000 and all((got[k] is None) if k % 10 == 0 else sorted(round(shoelace([p.asDict() for p in q]), 9) for q in got[k]) == [(k % 9 + 1) ** 2 / 4] * 2 for k in got)
    planes = [(bow(k % 9 + 1.0),) for k in range(2000)]
    began = time.perf_counter()
    regions(planes)
    together = time.perf_counter() - began
    began = time.perf_counter()
    for p in planes[:200]:
        region(*p)
    assert together < 5 * (time.perf_counter() - began)
