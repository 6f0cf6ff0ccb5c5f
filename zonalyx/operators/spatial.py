"""Points, polygons and their relations, as joins on grid cells with exact tests.

A polygon is `rings`: arrays of closed rings of (x, y) points in any order, holes
and further parts included; what an odd number of rings holds is inside. Candidates
meet in the cells of a grid that their bounds reach, so no join looks at all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonalyx.functions.scalar import in_ring, ring_area
from zonalyx.operators.frames import ContractError
from zonalyx.operators.planar import cut_planes, regions, ring_edges
from zonalyx.operators.ship import ship

WITHIN = "centroid_within_polygon"
FALLBACK = "centroid_intersects_polygon_boundary_fallback"
UNMATCHED = "unmatched"
#: Cells of one polygon; larger polygons are a sign of a grid that is too fine.
MAX_CELLS = 1_000_000
TOLERANCE = 1e-9


# -- exact tests ----------------------------------------------------------------------------------


def edges_of(rings: Column) -> Column:
    """The edges of all rings, as structs x0, y0, x1, y1."""
    edge = lambda p, q: F.struct(p["x"].alias("x0"), p["y"].alias("y0"), q["x"].alias("x1"), q["y"].alias("y1"))
    return F.flatten(F.transform(rings, lambda r: F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), edge)))


def inside(x: Column, y: Column, rings: Column) -> Column:
    """Whether an odd number of rings holds the point; points on a boundary may go either way."""
    return F.aggregate(rings, F.lit(0), lambda n, r: n + in_ring(x, y, r).cast("int")) % 2 == 1


def on_boundary(x: Column, y: Column, rings: Column, tolerance: float = TOLERANCE) -> Column:
    """Whether the point lies on an edge, up to tolerance times the edge's length."""

    def on(e: Column) -> Column:
        dx, dy = e["x1"] - e["x0"], e["y1"] - e["y0"]
        off = F.abs(dx * (y - e["y0"]) - dy * (x - e["x0"]))
        square = dx * dx + dy * dy
        along = dx * (x - e["x0"]) + dy * (y - e["y0"])
        return (off <= tolerance * F.greatest(square, F.lit(1.0))) & (along >= -tolerance * square) & (along <= (1 + tolerance) * square)

    return F.exists(edges_of(rings), on)


def _side(e: Column, x: Column, y: Column) -> Column:
    return F.signum((e["x1"] - e["x0"]) * (y - e["y0"]) - (e["y1"] - e["y0"]) * (x - e["x0"]))


def _in_box(e: Column, x: Column, y: Column) -> Column:
    return x.between(F.least(e["x0"], e["x1"]), F.greatest(e["x0"], e["x1"])) & y.between(F.least(e["y0"], e["y1"]), F.greatest(e["y0"], e["y1"]))


def edges_meet(a: Column, b: Column) -> Column:
    """Whether two edges have a point in common, ends included."""
    a0, a1, b0, b1 = _side(b, a["x0"], a["y0"]), _side(b, a["x1"], a["y1"]), _side(a, b["x0"], b["y0"]), _side(a, b["x1"], b["y1"])
    cross = (a0 * a1 < 0) & (b0 * b1 < 0)
    touch = ((a0 == 0) & _in_box(b, a["x0"], a["y0"])) | ((a1 == 0) & _in_box(b, a["x1"], a["y1"])) | ((b0 == 0) & _in_box(a, b["x0"], b["y0"])) | (
        (b1 == 0) & _in_box(a, b["x1"], b["y1"])
    )
    return cross | touch


def polygons_meet(p: Column, q: Column, p_edges: Column | None = None, q_edges: Column | None = None) -> Column:
    """Whether two polygons touch or overlap; edges: those that come into question."""
    first = lambda rings: rings[0][0]
    others = edges_of(q) if q_edges is None else q_edges
    meet = F.exists(edges_of(p) if p_edges is None else p_edges, lambda a: F.exists(others, lambda b: edges_meet(a, b)))
    return meet | inside(first(p)["x"], first(p)["y"], q) | inside(first(q)["x"], first(q)["y"], p)


def shared_length(p: Column, q: Column, tolerance: float = TOLERANCE) -> Column:
    """Length that two arrays of edges share; a common point alone is 0."""

    def common(a: Column, b: Column) -> Column:
        dx, dy = a["x1"] - a["x0"], a["y1"] - a["y0"]
        square = dx * dx + dy * dy
        off = lambda x, y: F.abs(dx * (y - a["y0"]) - dy * (x - a["x0"])) <= tolerance * F.greatest(square, F.lit(1.0))
        at = lambda x, y: (dx * (x - a["x0"]) + dy * (y - a["y0"])) / F.nullif(square, F.lit(0.0))
        s, t = at(b["x0"], b["y0"]), at(b["x1"], b["y1"])
        part = F.least(F.greatest(s, t), F.lit(1.0)) - F.greatest(F.least(s, t), F.lit(0.0))
        same = off(b["x0"], b["y0"]) & off(b["x1"], b["y1"])
        return F.coalesce(F.when(same & (part > 0), part * F.sqrt(square)), F.lit(0.0))

    inner = lambda a: F.aggregate(q, F.lit(0.0), lambda n, b: n + common(a, b))
    return F.aggregate(p, F.lit(0.0), lambda n, a: n + inner(a))


def valid_polygon(rings: Column) -> Column:
    """Rings are closed, have an area, and no two of a ring's edges meet but neighbours at their common end."""

    def simple(r: Column) -> Column:
        e = edges_of(F.array(r))
        n = F.size(e)
        numbered = F.transform(e, lambda x, i: F.struct(x.alias("e"), i.alias("i")))
        apart = lambda i, j: (j > i + 1) & ~((i == 0) & (j == n - 1))
        return ~F.exists(numbered, lambda a: F.exists(numbered, lambda b: apart(a["i"], b["i"]) & edges_meet(a["e"], b["e"])))

    ok = lambda r: (F.size(r) >= 4) & (F.element_at(r, 1) == F.element_at(r, -1)) & (ring_area(r) > 0) & simple(r)
    return F.coalesce((F.size(rings) > 0) & F.forall(rings, ok), F.lit(False))


def repair(rings: Column) -> Column:
    """Rings closed, without points that repeat the one before, and without rings of no area; NULL if none is left.

    A ring that crosses itself is not cut here (valid_polygon tells) but by cut_crossings.
    """

    def mended(r: Column) -> Column:
        one = F.filter(r, lambda p, i: (i == 0) | (p != F.get(r, i - 1)))
        return F.when(F.element_at(one, 1) == F.element_at(one, -1), one).otherwise(F.concat(one, F.slice(one, 1, 1)))

    out = F.filter(F.transform(F.filter(rings, lambda r: F.size(r) > 0), mended), lambda r: (F.size(r) >= 4) & (ring_area(r) > 0))
    return F.when(F.size(out) > 0, out)


# -- candidates -----------------------------------------------------------------------------------


def bounds(rings: Column) -> list[Column]:
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return [F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y")]


def cell_size(polygons: DataFrame, rings: str = "rings") -> float:
    """Twice the median side of a polygon's bounds: most polygons then reach a few cells."""
    b = polygons.where(F.col(rings).isNotNull()).select(*bounds(F.col(rings)))
    side = b.agg(F.percentile_approx(F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")), 0.5)).first()[0]
    return max(2.0 * (side or 0.0), 1e-6)


def with_cells(polygons: DataFrame, size: float, rings: str = "rings") -> DataFrame:
    """A row per cell (gx, gy) that the polygon's bounds reach; NULL geometry reaches none."""
    b = polygons.select("*", *bounds(F.col(rings)))
    low, high = (lambda c: F.floor(F.col(c) / size)), (lambda c: F.floor(F.col(c) / size))
    many = (high("max_x") - low("min_x") + 1) * (high("max_y") - low("min_y") + 1) > MAX_CELLS
    guard = F.when(many, F.raise_error(F.lit("a polygon reaches too many cells; choose a larger size")).cast("bigint")).otherwise(high("max_x"))
    out = b.withColumn("gx", F.explode(F.sequence(low("min_x"), guard))).withColumn("gy", F.explode(F.sequence(low("min_y"), high("max_y"))))
    return out.drop("min_x", "min_y", "max_x", "max_y")


# -- joins ----------------------------------------------------------------------------------------


def point_in_polygon(
    points: DataFrame, polygons: DataFrame, key: str, zone: str, x: str = "x", y: str = "y", size: float | None = None, half_open: bool = False
) -> DataFrame:
    """points with zone, method and n_zones.

    A point strictly inside polygons gets the smallest zone of them (WITHIN);
    n_zones tells how many there are. One inside none, but on the boundary of some,
    gets the smallest of those (FALLBACK). All others, and points without
    coordinates, have a NULL zone (UNMATCHED). key must tell points apart.
    With half_open a polygon holds its lower and left edges, not its upper and right
    ones: where polygons tile the plane, a point on a common edge is in one of them.
    """
    size = size or cell_size(polygons)
    p = points.select(key, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    p = p.withColumn("gx", F.floor(F.col("__x") / size)).withColumn("gy", F.floor(F.col("__y") / size)).where("gx is not null and gy is not null")
    z = with_cells(polygons.select(F.col(zone).alias("__zone"), "rings"), size)
    edge = F.lit(False) if half_open else on_boundary(F.col("__x"), F.col("__y"), F.col("rings"))
    met = p.join(z, ["gx", "gy"]).select(key, "__zone", edge.alias("__edge"), inside(F.col("__x"), F.col("__y"), F.col("rings")).alias("__in"))
    met = met.where("__edge or __in")
    g = met.groupBy(key).agg(
        F.min(F.when(~F.col("__edge"), F.col("__zone"))).alias("__a"),
        F.count_if(~F.col("__edge")).alias("__n"),
        F.min(F.when(F.col("__edge"), F.col("__zone"))).alias("__b"),
        F.count_if("__edge").alias("__m"),
    )
    out = points.join(g, key, "left")
    method = F.when(F.col("__n") > 0, WITHIN).when(F.col("__m") > 0, FALLBACK).otherwise(UNMATCHED)
    n = F.coalesce(F.when(F.col("__n") > 0, F.col("__n")).otherwise(F.col("__m")), F.lit(0))
    return out.select(*points.columns, F.coalesce("__a", "__b").alias(zone), method.alias("method"), n.cast("long").alias("n_zones"))


def assignment_summary(assigned: DataFrame, zone: str, units: str | None = None) -> DataFrame:
    """n, matched, unmatched, within, boundary, multi_zone, share_matched, share_units: of points, and of units where a column counts them."""
    hit = F.col(zone).isNotNull()
    w = F.col(units) if units else F.lit(1)
    share = lambda a, b: F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))
    return assigned.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(hit).alias("matched"),
        F.count_if(~hit).alias("unmatched"),
        F.count_if(F.col("method") == WITHIN).alias("within"),
        F.count_if(F.col("method") == FALLBACK).alias("boundary"),
        F.count_if(F.col("n_zones") > 1).alias("multi_zone"),
        share(F.count_if(hit), F.count(F.lit(1))).alias("share_matched"),
        share(F.sum(F.when(hit, w)), F.sum(w)).alias("share_units"),
    )


def _candidates(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """(a_id, a_rings, b_id, b_rings) whose bounds meet, each pair once: in the first cell that both reach."""
    box = lambda df, p: df.select(
        *[F.col(c).alias(f"{p}_{c}") for c in ("id", "rings")],
        *[c.alias(f"{p}_{n}") for c, n in zip(bounds(F.col("rings")), ("x0", "y0", "x1", "y1"), strict=True)],
    )

    def cells(df: DataFrame, p: str) -> DataFrame:
        spread = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))
        return box(df, p).withColumn("gx", spread(f"{p}_x0", f"{p}_x1")).withColumn("gy", spread(f"{p}_y0", f"{p}_y1"))

    def near(p: str, q: str) -> Column:
        """Edges of one polygon that reach the other's bounds: no other edge can meet it."""
        x0, y0, x1, y1 = (F.col(f"{q}_{c}") for c in ("x0", "y0", "x1", "y1"))
        reach = lambda e: (F.greatest(e["x0"], e["x1"]) >= x0) & (F.least(e["x0"], e["x1"]) <= x1) & (F.greatest(e["y0"], e["y1"]) >= y0) & (F.least(e["y0"], e["y1"]) <= y1)
        return F.filter(edges_of(F.col(f"{p}_rings")), reach)

    low = lambda c: F.floor(F.greatest(f"a_{c}", f"b_{c}") / size)
    meet = (F.col("a_x0") <= F.col("b_x1")) & (F.col("b_x0") <= F.col("a_x1")) & (F.col("a_y0") <= F.col("b_y1")) & (F.col("b_y0") <= F.col("a_y1"))
    met = cells(a, "a").join(cells(b, "b"), ["gx", "gy"]).where(meet & (F.col("gx") == low("x0")) & (F.col("gy") == low("y0")))
    return met.select("a_id", "a_rings", "b_id", "b_rings", near("a", "b").alias("a_near"), near("b", "a").alias("b_near"))


def _named(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col("rings").isNotNull()).select(F.col(key).alias("id"), "rings")


def adjacent(polygons: DataFrame, key: str, size: float | None = None) -> DataFrame:
    """(source, target), both directions, of polygons that touch in a point at least or overlap."""
    p = _named(polygons, key)
    met = _candidates(p, p, size or cell_size(polygons)).where((F.col("a_id") != F.col("b_id")) & polygons_meet(*map(F.col, ("a_rings", "b_rings", "a_near", "b_near"))))
    return met.select(F.col("a_id").alias("source"), F.col("b_id").alias("target"))


def adjacent_by_length(polygons: DataFrame, key: str, least: float = 0.0, size: float | None = None) -> DataFrame:
    """(source, target, shared_length) with source < target and a common boundary of more than 0 and at least `least`."""
    p = _named(polygons, key)
    met = _candidates(p, p, size or cell_size(polygons)).where("a_id < b_id")
    met = met.select(F.col("a_id").alias("source"), F.col("b_id").alias("target"), shared_length(F.col("a_near"), F.col("b_near")).alias("shared_length"))
    return met.where((F.col("shared_length") > 0) & (F.col("shared_length") >= least))


# -- overlay --------------------------------------------------------------------------------------


RINGS = "array<array<struct<x: double, y: double>>>"


def _points(rings: list) -> list:
    return [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]


def overlay(sources: DataFrame, targets: DataFrame, source: str, target: str, size: float | None = None) -> DataFrame:
    """(source, target, overlap, share_of_target, share_of_source, rings) of polygons with a common area.

    rings are those of the common area, outer ones turning left and holes right;
    share_of_target is the overlap over all overlaps of the target, share_of_source
    that over the source's own area. Each pair is one cut of the plane (planar).
    """
    ship(sources.sparkSession)
    a, b = _named(sources, source), _named(targets, target)
    met = _candidates(a, b, size or max(cell_size(sources), cell_size(targets))).select("a_id", "a_rings", "b_id", "b_rings")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            first = part.drop_duplicates("a_id")  # of the batch's sources
            own = dict(zip(first.a_id, (g[1] for g in regions([(p,) for p in first.a_rings])), strict=True))
            got = regions(list(zip(part.a_rings, part.b_rings, strict=True)))
            yield pd.DataFrame({"s": part.a_id, "t": part.b_id, "overlap": [g[1] for g in got], "area": part.a_id.map(own), "rings": [_points(g[0]) for g in got]})

    kinds = dict(a.dtypes)["id"], dict(b.dtypes)["id"]
    got = met.mapInPandas(cut, f"s {kinds[0]}, t {kinds[1]}, overlap double, area double, rings {RINGS}").where(F.col("overlap") > TOLERANCE * F.col("area"))
    of_target = F.sum("overlap").over(Window.partitionBy("t"))
    return got.select(
        F.col("s").alias(source),
        F.col("t").alias(target),
        "overlap",
        (F.col("overlap") / of_target).alias("share_of_target"),
        (F.col("overlap") / F.col("area")).alias("share_of_source"),
        "rings",
    )


def cut_crossings(polygons: DataFrame, rings: str = "rings") -> DataFrame:
    """polygons with every geometry as rings that cross neither themselves nor another, what is inside by odd-even unchanged; NULL without an area.

    A ring that crosses itself becomes several; points that repeat, spikes and lines
    there and back go. Outer rings turn left, holes right. Rows are dealt over tasks
    first, as they are much work and few bytes.
    """
    ship(polygons.sparkSession)
    at = polygons.columns.index(rings)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = cut_column(batch.column(at))
            yield pa.RecordBatch.from_arrays([column if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    schema = T.StructType([T.StructField(f.name, T._parse_datatype_string(RINGS)) if f.name == rings else f for f in polygons.schema.fields])
    return dealt(polygons).mapInArrow(cut, schema)


def cut_column(polygons: pa.ListArray) -> pa.ListArray:
    """cut_crossings of a column of polygons."""
    r = polygons.flatten()
    points = r.flatten()
    x, y = (c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in points.flatten())
    of_ring, of_point = (pc.list_parent_indices(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (polygons, r))
    e, ring = ring_edges(x, y, of_point)
    got, length, plane, _area = cut_planes(e, of_ring[ring], np.zeros(len(e), np.int64), len(polygons), 1)
    struct = pa.StructArray.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["x", "y"])
    made = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), struct)
    n = np.bincount(plane, minlength=len(polygons))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), made, mask=pa.array(n == 0))


def dealt(df: DataFrame) -> DataFrame:
    """df over as many tasks as a shuffle has, whatever its files."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def pairwise_distances(points: DataFrame, key: str, x: str = "x", y: str = "y", most: int = 5_000) -> DataFrame:
    """(source, target, distance) of all ordered pairs, which is what is asked for; more than `most` points raise an error."""
    small = points.select(key, x, y).limit(most + 1)
    if small.count() > most:
        raise ContractError(f"distances of all pairs of more than {most} points; use nearest")
    a, b = points.select(F.col(key).alias("source"), F.col(x).alias("ax"), F.col(y).alias("ay")), points.select(
        F.col(key).alias("target"),
        F.col(x).alias("bx"),
        F.col(y).alias("by"),
    )
    return a.crossJoin(F.broadcast(b)).select("source", "target", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")).alias("distance"))
