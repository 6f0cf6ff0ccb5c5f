"""Shapefiles and GeoPackages as Spark data sources.

Both read a folder of files or one file. A Shapefile is cut by its index (.shx): a
task seeks to the records of its range in .shp and .dbf. A GeoPackage is cut by ranges
of row numbers. Both write a file, with its companions, per task. Files are opened by
pyarrow's file systems, so that a path may be in any store that those know; SQLite
itself needs a local file, so a GeoPackage elsewhere is copied for the length of a task.

Geometry is `rings` (polygons, also of several parts, and lines) and `point`; other
columns are attributes. Every row stays: one without geometry is a null shape.
"""

from __future__ import annotations

import contextlib
import datetime
import math
import os
import sqlite3
import struct
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from zonalyx.operators.ship import ship

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RINGS = T.ArrayType(T.ArrayType(POINT))
GEOMETRY = (T.StructField("rings", RINGS), T.StructField("point", POINT))
#: Records that one task reads.
PART_ROWS = 50_000
#: Fixed values of the formats: shape kinds, their z and m variants, and the header's code.
NULL_SHAPE, POINTS, LINES, POLYGONS = 0, (1, 11, 21), (3, 13, 23), (5, 15, 25)
SHAPE_CODE, SHAPE_VERSION = 9994, 1000
GPKG_ID, GPKG_VERSION = 0x47504B47, 10300
ENVELOPES = (0, 32, 48, 48, 64)


def _open(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def _files(path: str, suffix: str) -> list[str]:
    """Full names of the files with the suffix, of the folder or of the file itself."""
    from pyarrow import fs

    system, where = _open(path)
    head = path[: len(path) - len(where)] if path.endswith(where) else ""
    info = system.get_file_info(where)
    if info.type == fs.FileType.Directory:
        found = [f.path for f in system.get_file_info(fs.FileSelector(where)) if f.path.lower().endswith(suffix)]
        return [head + f for f in sorted(found)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return [path]


def _read(path: str, start: int = 0, size: int | None = None) -> bytes:
    system, where = _open(path)
    with system.open_input_file(where) as f:
        f.seek(start)
        return f.read() if size is None else f.read(size)


def _size(path: str) -> int:
    system, where = _open(path)
    return system.get_file_info(where).size


def _write(path: str, data: bytes) -> None:
    system, where = _open(path)
    system.create_dir(os.path.dirname(where), recursive=True)
    with system.open_output_stream(where) as f:
        f.write(data)


def _exists(path: str) -> bool:
    from pyarrow import fs

    system, where = _open(path)
    return system.get_file_info(where).type == fs.FileType.File


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


# -- Shapefile ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    size: int
    decimals: int

    @property
    def type(self) -> T.DataType:
        if self.kind == "N" and not self.decimals and self.size <= 18:
            return T.LongType()
        return {"N": T.DoubleType(), "F": T.DoubleType(), "L": T.BooleanType(), "D": T.DateType()}.get(self.kind, T.StringType())


def _dbf_head(path: str) -> tuple[int, int, int, list[Field]]:
    """Rows, length of the head, length of a row, fields."""
    rows, head, width = struct.unpack("<IHH", _read(path, 4, 8))
    raw, fields = _read(path, 32, head - 32), []
    for at in range(0, len(raw) - 31, 32):
        if raw[at] == 0x0D:
            break
        name = raw[at : at + 11].split(b"\0")[0].decode("latin-1")
        fields.append(Field(name, chr(raw[at + 11]), raw[at + 16], raw[at + 17]))
    return rows, head, width, fields


def _encoding(dbf: str) -> str:
    page = dbf[:-4] + ".cpg"
    named = _read(page).decode("ascii", "ignore").strip().lower() if _exists(page) else ""
    return {"utf-8": "utf-8", "utf8": "utf-8", "65001": "utf-8", "1252": "cp1252"}.get(named, named or "latin-1")


def _value(field: Field, raw: bytes, encoding: str):
    text = raw.decode(encoding).strip(" \0") if field.kind == "C" else raw.decode("latin-1").strip(" \0")
    if not text or (field.kind in "NF" and text[0] == "*"):
        return None
    if isinstance(field.type, T.LongType):
        return int(float(text)) if "." in text else int(text)
    if isinstance(field.type, T.DoubleType):
        return float(text)
    if field.kind == "L":
        return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
    if field.kind == "D":
        return datetime.date(int(text[:4]), int(text[4:6]), int(text[6:8]))
    return text


def _points(xy: np.ndarray) -> list[tuple[float, float]]:
    return list(map(tuple, xy.tolist()))


def parse_shape(record: bytes) -> tuple[list | None, tuple | None]:
    """(rings, point) of a record's content; (None, None) of a null shape and of kinds other than points, lines and polygons."""
    kind = struct.unpack_from("<i", record)[0]
    if kind in POINTS:
        return None, struct.unpack_from("<2d", record, 4)
    if kind not in LINES + POLYGONS:
        return None, None
    n_parts, n_points = struct.unpack_from("<2i", record, 36)
    starts = list(struct.unpack_from(f"<{n_parts}i", record, 44)) + [n_points]
    xy = np.frombuffer(record, "<f8", 2 * n_points, 44 + 4 * n_parts).reshape(-1, 2)
    return [_points(xy[a:b]) for a, b in zip(starts, starts[1:], strict=False)], None


def shape_record(rings: list | None, point: tuple | None) -> bytes:
    """The content of a record: a polygon, a point or a null shape."""
    if point is not None:
        return struct.pack("<i2d", 1, *point)
    if not rings:
        return struct.pack("<i", NULL_SHAPE)
    turned = _turned(rings)
    xy = np.array([p for r in turned for p in r], "<f8").reshape(-1, 2)
    starts = np.cumsum([0, *map(len, turned)])[:-1]
    head = struct.pack("<i4d2i", 5, *xy.min(0), *xy.max(0), len(turned), len(xy))
    return head + np.asarray(starts, "<i4").tobytes() + xy.tobytes()


def _turned(rings: list) -> list[list[tuple[float, float]]]:
    """Rings that hold their inside on the right: outer ones clockwise, holes the other way, by how many others hold their first point."""
    plain = [np.array([tuple(p) for p in r], float) for r in rings]
    out = []
    for k, r in enumerate(plain):
        x, y = r[0]
        depth = 0
        for j, other in enumerate(plain):
            if j != k:
                (x0, y0), (x1, y1) = other[:-1].T, other[1:].T
                over = (y0 > y) != (y1 > y)
                depth += int((x < (x1 - x0)[over] * (y - y0[over]) / (y1 - y0)[over] + x0[over]).sum()) % 2
        area = float((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum())
        out.append(_points(r if (area < 0) == (depth % 2 == 0) else r[::-1]))
    return out


class ShapeReader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.path, self.rows, self.names = options["path"], int(options.get("partRows", PART_ROWS)), schema.fieldNames()

    def partitions(self):
        out = []
        for file in _files(self.path, ".shp"):
            n = (_size(file[:-4] + ".shx") - 100) // 8
            out += [Range(file, k, min(k + self.rows, n)) for k in range(0, n, self.rows)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        if part.end <= part.start:
            return
        dbf = part.file[:-4] + ".dbf"
        _, head, width, fields = _dbf_head(dbf)
        encoding, n = _encoding(dbf), part.end - part.start
        index = np.frombuffer(_read(part.file[:-4] + ".shx", 100 + 8 * part.start, 8 * n), ">i4").reshape(-1, 2).astype(np.int64) * 2
        rows = _read(dbf, head + width * part.start, width * n)
        system, where = _open(part.file)
        with system.open_input_file(where) as f:
            for k, (offset, size) in enumerate(index.tolist()):
                f.seek(offset + 8)
                rings, point = parse_shape(f.read(size))
                row, at, got = rows[k * width : (k + 1) * width], 1, {"rings": rings, "point": point}
                for field in fields:
                    got[field.name] = _value(field, row[at : at + field.size], encoding)
                    at += field.size
                if row[:1] != b"*":  # deleted
                    yield tuple(got[c] for c in self.names)


@dataclass
class Written(WriterCommitMessage):
    rows: int


def _dbf_field(field: T.StructField) -> Field:
    if len(field.name.encode()) > 10:
        raise ValueError(f"{field.name!r} is longer than the ten bytes that a column name may have")
    if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return Field(field.name, "N", 18 if not isinstance(field.dataType, T.LongType) else 20, 0)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return Field(field.name, "F", 25, 15)
    kind = {T.BooleanType: ("L", 1), T.DateType: ("D", 8), T.StringType: ("C", 254)}.get(type(field.dataType))
    if kind is None:
        raise ValueError(f"no column type for {field.dataType.simpleString()}")
    return Field(field.name, *kind, 0)


def _dbf_value(field: Field, v) -> bytes:
    if v is None or (isinstance(v, float) and not math.isfinite(v)):
        return b"?" if field.kind == "L" else b" " * field.size
    if field.kind == "L":
        return b"T" if v else b"F"
    text = f"{v:%Y%m%d}" if field.kind == "D" else repr(float(v)) if field.kind == "F" else str(v)
    raw = text.encode()
    if len(raw) > field.size:
        raise ValueError(f"{text[:40]!r} does not fit the {field.size} bytes of {field.name}")
    return raw.rjust(field.size) if field.kind in "NF" else raw.ljust(field.size)


class ShapeWriter(DataSourceWriter):
    def __init__(self, options, schema: T.StructType):
        self.path, self.crs, self.schema = options["path"], options.get("crs"), schema

    def write(self, rows: Iterator) -> Written:
        fields = [_dbf_field(f) for f in self.schema.fields if f.name not in ("rings", "point")]
        names = self.schema.fieldNames()
        shapes, index, table, at, n, box = [], [], [], 100, 0, np.array([np.inf, np.inf, -np.inf, -np.inf])
        kind = 1 if "point" in names and "rings" not in names else 5
        for row in rows:
            r = row.asDict() if hasattr(row, "asDict") else dict(zip(names, row, strict=True))
            rings, point = r.get("rings"), r.get("point")
            content = shape_record(rings, point if kind == 1 else None)
            for p in [point] if kind == 1 and point is not None else [p for ring in rings or () for p in ring]:
                box = np.array([*np.minimum(box[:2], p), *np.maximum(box[2:], p)])
            n += 1
            shapes.append(struct.pack(">2i", n, len(content) // 2) + content)
            index.append(struct.pack(">2i", at // 2, len(content) // 2))
            at += len(shapes[-1])
            table.append(b" " + b"".join(_dbf_value(f, r[f.name]) for f in fields))
        if not n:
            return Written(0)
        if at > (1 << 31) - 2:
            raise ValueError("a Shapefile holds 2 GB at most; write more partitions")
        name = f"{self.path}/part-{uuid.uuid4().hex}"
        low_high = struct.pack("<8d", *(box if np.isfinite(box).all() else np.zeros(4)), 0, 0, 0, 0)
        head = lambda size: struct.pack(">7i", SHAPE_CODE, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i", SHAPE_VERSION, kind) + low_high
        _write(f"{name}.shx", head(100 + 8 * n) + b"".join(index))
        columns = b"".join(struct.pack("<11sc4xBB14x", f.name.encode(), f.kind.encode(), f.size, f.decimals) for f in fields)
        start = struct.pack("<4BIHH20x", 3, 100, 1, 1, n, 33 + len(columns), 1 + sum(f.size for f in fields))
        _write(f"{name}.dbf", start + columns + b"\r" + b"".join(table) + b"\x1a")
        _write(f"{name}.cpg", b"UTF-8")
        if self.crs:
            _write(f"{name}.prj", self.crs.encode())
        _write(f"{name}.shp", head(at) + b"".join(shapes))
        return Written(n)


class Shapefile(DataSource):
    """spark.read / df.write.format("shapefile"): a folder of Shapefiles. Options: partRows, records a task reads; crs, the text of .prj."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> T.StructType:
        files = _files(self.options["path"], ".dbf" if not self.options["path"].endswith(".shp") else ".shp")
        if not files:
            raise FileNotFoundError(f"no Shapefile in {self.options['path']}")
        fields = _dbf_head(files[0][:-4] + ".dbf")[3]
        return T.StructType([*[T.StructField(f.name, f.type) for f in fields], *GEOMETRY])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ShapeReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return ShapeWriter(self.options, schema)


# -- GeoPackage -----------------------------------------------------------------------------------


@contextlib.contextmanager
def _database(path: str):
    """The database at path, read only; of another store than the local disk a copy that is gone afterwards."""
    from pyarrow import fs

    system, where = _open(path)
    local = isinstance(system, fs.LocalFileSystem)
    handle, copy = (None, where) if local else tempfile.mkstemp(suffix=".gpkg")
    try:
        if not local:
            with os.fdopen(handle, "wb") as out, system.open_input_stream(where) as f:
                while block := f.read(1 << 20):
                    out.write(block)
        db = sqlite3.connect(f"file:{copy}?mode=ro&immutable=1", uri=True)
        try:
            yield db
        finally:
            db.close()
    finally:
        if not local:
            os.remove(copy)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _layer(db: sqlite3.Connection, named: str | None) -> tuple[str, str]:
    """Name and geometry column of the layer named, or of the first one."""
    for table, column in db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY table_name"):
        if named in (None, table):
            return table, column
    raise ValueError(f"no layer {named or ''} in the GeoPackage")


def _sql_type(declared: str) -> T.DataType:
    kind = declared.upper().split("(")[0]
    if kind in ("INTEGER", "INT", "MEDIUMINT", "SMALLINT", "TINYINT"):
        return T.LongType()
    return {"DOUBLE": T.DoubleType(), "REAL": T.DoubleType(), "FLOAT": T.DoubleType(), "BOOLEAN": T.BooleanType(), "BLOB": T.BinaryType()}.get(kind, T.StringType())


def parse_blob(blob: bytes | None) -> tuple[list | None, tuple | None]:
    """(rings, point) of a GeoPackage's geometry: its head, then well-known binary."""
    from zonalyx.sources.tables import parse_wkb

    if not blob or blob[:2] != b"GP" or blob[3] & 0x10:  # empty geometry
        return None, None
    rings, point = parse_wkb(bytes(blob[8 + ENVELOPES[blob[3] >> 1 & 7] :]))
    return rings and [[(p["x"], p["y"]) for p in r] for r in rings], point and (point["x"], point["y"])


def blob_of(rings: list | None, point: tuple | None, srs: int) -> bytes | None:
    """A point, or a multipolygon with each outer ring and its holes; None of nothing."""
    head = struct.pack("<2sBBi", b"GP", 0, 1, srs)
    if point is not None:
        return head + struct.pack("<BI2d", 1, 1, *point)
    if not rings:
        return None
    groups: list[list] = []
    turned = [np.array(r)[::-1] for r in _turned(rings)]
    area = [float((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum()) for r in turned]
    outer = [r for r, a in zip(turned, area, strict=True) if a > 0] or turned[:1]
    groups = [[r] for r in outer]
    for r, a in zip(turned, area, strict=True):
        if a <= 0 and len(groups[0][0]):
            x, y = r[0]
            home = [g for g in groups if _holds(g[0], x, y)]
            min(home or groups[:1], key=lambda g: abs(float((g[0][:-1, 0] * g[0][1:, 1] - g[0][1:, 0] * g[0][:-1, 1]).sum()))).append(r)
    polygon = lambda g: struct.pack("<BII", 1, 3, len(g)) + b"".join(struct.pack("<I", len(r)) + np.ascontiguousarray(r, "<f8").tobytes() for r in g)
    return head + struct.pack("<BII", 1, 6, len(groups)) + b"".join(map(polygon, groups))


def _holds(r: np.ndarray, x: float, y: float) -> bool:
    (x0, y0), (x1, y1) = r[:-1].T, r[1:].T
    over = (y0 > y) != (y1 > y)
    return bool(int((x < (x1 - x0)[over] * (y - y0[over]) / (y1 - y0)[over] + x0[over]).sum()) % 2)


class PackageReader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.path, self.layer, self.rows, self.fields = options["path"], options.get("layer"), int(options.get("partRows", PART_ROWS)), schema.fields

    def partitions(self):
        out = []
        for file in _files(self.path, ".gpkg"):
            with _database(file) as db:
                table, _ = _layer(db, self.layer)
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(table)}").fetchone()
            if low is not None:
                out += [Range(file, k, min(k + self.rows, high + 1)) for k in range(low, high + 1, self.rows)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        if part.end <= part.start:
            return
        with _database(part.file) as db:
            table, geometry = _layer(db, self.layer)
            named = [f for f in self.fields if f.name not in ("rings", "point")]
            columns = ", ".join(_quoted(c) for c in [geometry, *[f.name for f in named]])
            for blob, *values in db.execute(f"SELECT {columns} FROM {_quoted(table)} WHERE rowid >= ? AND rowid < ?", (part.start, part.end)):
                rings, point = parse_blob(blob)
                got = {"rings": rings, "point": point}
                for f, v in zip(named, values, strict=True):
                    got[f.name] = bool(v) if v is not None and isinstance(f.dataType, T.BooleanType) else float(v) if v is not None and isinstance(f.dataType, T.DoubleType) else v
                yield tuple(got[f.name] for f in self.fields)


class PackageWriter(DataSourceWriter):
    def __init__(self, options, schema: T.StructType):
        self.path, self.schema, self.layer, self.srs = options["path"], schema, options.get("layer", "layer"), int(options.get("srs", 4326))

    def write(self, rows: Iterator) -> Written:
        names = self.schema.fieldNames()
        plain = [f for f in self.schema.fields if f.name not in ("rings", "point")]
        kind = lambda t: "INTEGER" if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else "DOUBLE" if isinstance(t, (T.DoubleType, T.FloatType)) else "BOOLEAN" if isinstance(t, T.BooleanType) else "BLOB" if isinstance(t, T.BinaryType) else "TEXT"
        handle, made = tempfile.mkstemp(suffix=".gpkg")
        os.close(handle)
        db = sqlite3.connect(made)
        try:
            db.execute(f"PRAGMA application_id = {GPKG_ID}")
            db.execute(f"PRAGMA user_version = {GPKG_VERSION}")
            db.executescript(
                """CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER NOT NULL PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
                CREATE TABLE gpkg_contents (table_name TEXT NOT NULL PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
                CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, CONSTRAINT pk_geom_cols PRIMARY KEY (table_name, column_name));"""
            )
            for code, name in {-1: "undefined cartesian", 0: "undefined geographic", 4326: "WGS 84", self.srs: f"EPSG {self.srs}"}.items():
                db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, 'undefined', NULL)", (name, code, "NONE" if code < 1 else "EPSG", code))
            db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, ?)", (self.layer, self.layer, self.srs))
            db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'GEOMETRY', ?, 0, 0)", (self.layer, self.srs))
            columns = "".join(f", {_quoted(f.name)} {kind(f.dataType)}" for f in plain)
            db.execute(f"CREATE TABLE {_quoted(self.layer)} (__fid INTEGER PRIMARY KEY, geom GEOMETRY{columns})")
            n = 0

            def values() -> Iterator[tuple]:
                nonlocal n
                for row in rows:
                    r = row.asDict() if hasattr(row, "asDict") else dict(zip(names, row, strict=True))
                    n += 1
                    yield (n, blob_of(r.get("rings"), r.get("point"), self.srs), *[str(r[f.name]) if kind(f.dataType) == "TEXT" and r[f.name] is not None else r[f.name] for f in plain])

            db.executemany(f"INSERT INTO {_quoted(self.layer)} VALUES ({', '.join('?' * (len(plain) + 2))})", values())
            db.commit()
            db.close()
            if n:
                with open(made, "rb") as f:
                    _write(f"{self.path}/part-{uuid.uuid4().hex}.gpkg", f.read())
        finally:
            db.close()
            os.remove(made)
        return Written(n)


class GeoPackage(DataSource):
    """spark.read / df.write.format("geopackage"): a folder of GeoPackages. Options: layer, srs, partRows."""

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def schema(self) -> T.StructType:
        files = _files(self.options["path"], ".gpkg")
        if not files:
            raise FileNotFoundError(f"no GeoPackage in {self.options['path']}")
        with _database(files[0]) as db:
            table, geometry = _layer(db, self.options.get("layer"))
            columns = [(name, kind, key) for _, name, kind, _, _, key in db.execute(f"PRAGMA table_info({_quoted(table)})")]
        plain = [T.StructField(name, _sql_type(kind)) for name, kind, key in columns if name != geometry and not key]
        return T.StructType([*plain, *GEOMETRY])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PackageReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return PackageWriter(self.options, schema)


def register(spark: SparkSession) -> SparkSession:
    """Make both formats known to the session."""
    ship(spark)
    for source in (Shapefile, GeoPackage):
        spark.dataSource.register(source)
    return spark


def read_shapefile(spark: SparkSession, path: str, **options) -> DataFrame:
    return register(spark).read.format("shapefile").options(**options).load(path)


def write_shapefile(df: DataFrame, path: str, **options) -> None:
    """A Shapefile per partition under path, which must be new; column names have ten bytes, texts 254 at most, else it is an error."""
    register(df.sparkSession)
    df.write.format("shapefile").options(**options).mode("append").save(path)


def read_geopackage(spark: SparkSession, path: str, **options) -> DataFrame:
    return register(spark).read.format("geopackage").options(**options).load(path)


def write_geopackage(df: DataFrame, path: str, **options) -> None:
    """A GeoPackage per partition under path, which must be new."""
    register(df.sparkSession)
    df.write.format("geopackage").options(**options).mode("append").save(path)
