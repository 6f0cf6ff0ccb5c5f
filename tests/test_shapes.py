"""Shapefiles and GeoPackages there and back, in many parts, and bytes against the format's tables."""

import datetime
import sqlite3
import struct

import pytest

from zonalyx.sources import shapes

KIND = "name string, n long, x double, ok boolean, day date, rings array<array<struct<x: double, y: double>>>"


def ring(*xy):
    return [(float(x), float(y)) for x, y in xy]


def rows(n=40):
    square = lambda x, y, s: ring((x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y))
    out = [(f"é{k}" if k % 3 else None, k * 10**15 if k % 7 else None, k / 3, k % 2 == 0 if k % 5 else None, datetime.date(2020, 1, 1 + k % 28), [square(k, 0, 10), square(k + 2, 2, 3)]) for k in range(n)]
    return [*out, ("two", -5, 1e-300, None, None, [square(0, 0, 1), square(5, 5, 2)]), ("none", 0, float("nan"), True, None, None), ("empty", 1, 1e300, True, None, [])]


def canon(r):
    """Rings as sets of points with the area that they hold, however they turn."""
    area = lambda q: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(q, q[1:], strict=False)) / 2
    x = None if r[2] is None or r[2] != r[2] else r[2]
    return (r[0], r[1], x, r[3], r[4], sorted((round(abs(area(q)), 9), tuple(sorted({tuple(p) for p in q}))) for q in r[5] or []))


@pytest.mark.parametrize("form", ["shapefile", "geopackage"])
def test_there_and_back_in_parts(spark, tmp_path, form):
    data = rows()
    d = spark.createDataFrame(data, KIND).repartition(3)
    path = str(tmp_path / form)
    (shapes.write_shapefile if form == "shapefile" else shapes.write_geopackage)(d if form == "shapefile" else d.withColumn("day", d.day.cast("string")), path)
    read = shapes.read_shapefile if form == "shapefile" else shapes.read_geopackage
    got = read(spark, path, partRows="7")
    assert got.rdd.getNumPartitions() >= 6
    back = [(r.name, int(r.n) if r.n is not None else None, r.x, r.ok, r.day if form == "shapefile" else r.day and datetime.date.fromisoformat(r.day), r.rings) for r in got.collect()]
    assert sorted(map(canon, back), key=str) == sorted(map(canon, data), key=str)
    area = lambda q: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(q, q[1:], strict=False)) / 2
    one = next(r for r in got.collect() if r.name == "é1")
    assert sum(area(q) for q in one.rings) == pytest.approx(-91 if form == "shapefile" else 91)


def test_points_and_names(spark, tmp_path):
    d = spark.createDataFrame([("a", (1.5, -2.5)), ("b", None)], "k string, point struct<x: double, y: double>")
    for write, read, name in ((shapes.write_shapefile, shapes.read_shapefile, "s"), (shapes.write_geopackage, shapes.read_geopackage, "g")):
        write(d.coalesce(1), str(tmp_path / name))
        got = {r.k: r.point and tuple(r.point) for r in read(spark, str(tmp_path / name)).collect()}
        assert got == {"a": (1.5, -2.5), "b": None}
    with pytest.raises(Exception, match="ten bytes"):
        shapes.write_shapefile(d.withColumnRenamed("k", "elevenbytes"), str(tmp_path / "long"))
    with pytest.raises(Exception, match="does not fit"):
        shapes.write_shapefile(spark.createDataFrame([("x" * 300, (0.0, 0.0))], d.schema), str(tmp_path / "wide"))


def test_bytes_of_the_formats(spark, tmp_path):
    d = spark.createDataFrame(rows(3)[:3], KIND).coalesce(1)
    shapes.write_shapefile(d, str(tmp_path / "s"), crs="PROJCS[...]")
    shp, shx, dbf = (next((tmp_path / "s").glob(f"*.{e}")).read_bytes() for e in ("shp", "shx", "dbf"))
    assert struct.unpack(">i", shp[:4]) == (9994,) and struct.unpack("<2i", shp[28:36]) == (1000, 5) and struct.unpack(">i", shp[24:28])[0] * 2 == len(shp)
    assert struct.unpack(">i", shx[24:28])[0] * 2 == len(shx) == 124 and struct.unpack(">2i", shx[100:108]) == (50, struct.unpack(">i", shp[104:108])[0])
    assert struct.unpack("<4d", shp[36:68]) == (0.0, 0.0, 12.0, 10.0) and struct.unpack("<I", dbf[4:8]) == (3,)
    assert next((tmp_path / "s").glob("*.prj")).read_text() == "PROJCS[...]"
    shapes.write_geopackage(d.drop("day"), str(tmp_path / "g"), layer="zones", srs="3347")
    db = sqlite3.connect(next((tmp_path / "g").glob("*.gpkg")))
    assert db.execute("PRAGMA application_id").fetchone() == (0x47504B47,) and db.execute("SELECT table_name, srs_id FROM gpkg_geometry_columns").fetchall() == [("zones", 3347)]
    blob = db.execute("SELECT geom FROM zones").fetchone()[0]
    assert blob[:2] == b"GP" and struct.unpack("<i", blob[4:8]) == (3347,) and struct.unpack("<BII", blob[8:17]) == (1, 6, 1)
