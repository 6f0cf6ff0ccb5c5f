"""Queries: tables written to the shared folder in a format, read back, and compared with what they were."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from zonalyx.operators.store import new_path
from zonalyx.plans.base import ZONES, Register, r6, table, zones
from zonalyx.sources import tables as src

query = Register()


def _named(spark, d):
    """Parts with names that a CSV finds hard: accents, separators, quotes and line feeds."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    mark = F.when(k % 5 == 0, "é").when(k % 5 == 1, ', "x"').when(k % 5 == 2, "\nline").when(k % 5 == 3, ";\t|").otherwise("")
    return p.select(k.cast("string").alias("key"), F.concat("p_name", mark).alias("name"), F.col("p_size").cast("string").alias("size"))


_NAMED = """SELECT CAST(p_partkey AS VARCHAR) AS key,
    p_name || CASE p_partkey % 5 WHEN 0 THEN 'é' WHEN 1 THEN ', "x"' WHEN 2 THEN chr(10) || 'line' WHEN 3 THEN ';' || chr(9) || '|' ELSE '' END AS name, CAST(p_size AS VARCHAR) AS size FROM part"""


def _write_csv(df, path, encoding="UTF-8", sep=","):
    df.write.option("header", True).option("encoding", encoding).option("sep", sep).option("quote", '"').option("escape", '"').csv(path)


@query("r001_csv_columns", f"SELECT key, name FROM ({_NAMED})")
def _(spark, d):
    path = new_path(spark, "csv")
    _write_csv(_named(spark, d), path, "ISO-8859-1")
    return src.read_csv(spark, path, ["key", "name"], "ISO-8859-1")


@query("r002_csv_encoding", f"SELECT * FROM ({_NAMED})")
def _(spark, d):
    """Latin-1 bytes may come late in a file, so all of it decides."""
    path = new_path(spark, "csv")
    _write_csv(_named(spark, d), path, "ISO-8859-1")
    return src.read_csv_probed(spark, path)


@query(
    "r003_csv_filtered_aggregate",
    "SELECT l_returnflag AS flag, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1",
)
def _(spark, d):
    path = new_path(spark, "csv")
    _write_csv(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"), path)
    rows = src.read_csv(spark, path, all_columns=["l_returnflag", "l_linestatus", "l_linenumber"], multi_line=False)
    return rows.where("l_linestatus = 'F'").groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.expr("try_cast(l_linenumber as bigint)")).alias("lines"),
    )


@query(
    "r004_csv_separator",
    f"SELECT key, name, size, CAST(NULL AS VARCHAR) AS bad FROM ({_NAMED}) UNION ALL SELECT 'short', NULL, NULL, 'short' UNION ALL SELECT 'long', 'x', '1', 'long;x;1;more'",
)
def _(spark, d):
    """Separated by semicolons; rows with too few or too many fields stay, and are told."""
    path = new_path(spark, "csv")
    n = _named(spark, d)
    text = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    lines = n.select(F.concat_ws(";", "key", text(F.col("name")), "size").alias("value"))
    odd = spark.createDataFrame([("short",), ("long;x;1;more",)], "value string")
    head = spark.createDataFrame([("key;name;size",)], "value string")
    one = head.unionByName(lines.unionByName(odd)).withColumn("__k", F.monotonically_increasing_id())
    one.coalesce(1).sortWithinPartitions("__k").select("value").write.text(path)
    return src.read_csv_probed(spark, path, corrupt="bad")


@query(
    "r006_excel",
    "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, CASE WHEN n_nationkey % 3 <> 0 THEN CAST(n_regionkey AS VARCHAR) END AS region FROM nation",
)
def _(spark, d):
    """A workbook with a title above its header, shared and inline strings, and empty cells."""
    rows = [(r.n_nationkey, r.n_name, r.n_regionkey if r.n_nationkey % 3 else None) for r in table(spark, d, "nation").collect()]
    path = new_path(spark, "xlsx")
    src.write_bytes(spark, f"{path}/nation.xlsx", src.xlsx_bytes("nation", [["Nations of the world"], [], ["key", "name", "region"], *map(list, rows)]))
    return src.read_excel_sheet(spark, f"{path}/nation.xlsx", "nation", ["key", "name"])




@query(
    "r007_geojson",
    "SELECT CAST(n_nationkey AS VARCHAR) AS zone, CASE WHEN n_nationkey % 2 = 0 THEN 'Polygon' ELSE 'MultiPolygon' END AS kind, 'EPSG:3347' AS crs, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 2 END AS BIGINT) AS rings, CASE WHEN n_nationkey % 2 = 0 THEN 84.0 ELSE 200.0 END AS area FROM nation",
)
def _(spark, d):
    """Even nations are squares with a hole, odd ones two squares."""
    from zonalyx.functions.scalar import ring_area

    square = lambda x, y, s: [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]

    def shape(k: int) -> dict:
        x = k * 50
        if k % 2 == 0:
            return {"type": "Polygon", "coordinates": [square(x, 0, 10), square(x + 3, 3, 4)]}
        return {"type": "MultiPolygon", "coordinates": [[square(x, 0, 10)], [square(x + 20, 0, 10)]]}

    keys = [r.n_nationkey for r in table(spark, d, "nation").select("n_nationkey").collect()]
    made = {
        "type": "FeatureCollection",
        "crs": {"type": "name", "properties": {"name": "EPSG:3347"}},
        "features": [{"type": "Feature", "properties": {"zone": str(k)}, "geometry": shape(k)} for k in keys],
    }
    path = new_path(spark, "geojson")
    src.write_bytes(spark, f"{path}/zones.geojson", json.dumps(made).encode())
    g = src.read_geojson(spark, f"{path}/zones.geojson")
    areas = F.transform("rings", ring_area)
    total = F.when(F.col("geometry_type") == "Polygon", areas[0] - areas[1]).otherwise(F.aggregate(areas, F.lit(0.0), lambda a, x: a + x))
    return g.select(
        F.col("properties")["zone"].alias("zone"),
        F.col("geometry_type").alias("kind"),
        "crs",
        F.size("rings").cast("long").alias("rings"),
        total.alias("area"),
    )


@query(
    "r007_geoparquet",
    "SELECT n_nationkey, CAST(1 AS BIGINT) AS rings, CAST(n_nationkey + 3 AS DOUBLE) AS max_x, CAST(n_nationkey AS DOUBLE) AS px FROM nation",
)
def _(spark, d):
    """Well-known binary of a triangle and of a point, little-endian, made and read back through Parquet."""
    n = table(spark, d, "nation").select("n_nationkey")
    path = new_path(spark, "geoparquet")

    def made(parts):
        import struct

        for p in parts:
            ring = [[(k, 0.0), (k + 3.0, 0.0), (k, 4.0), (k, 0.0)] for k in p.n_nationkey]
            p["geometry"] = [struct.pack("<BIII", 1, 3, 1, 4) + b"".join(struct.pack("<dd", *xy) for xy in r) for r in ring]
            p["centre"] = [struct.pack("<BIdd", 1, 1, k, 1.0) for k in p.n_nationkey]
            yield p

    n.mapInPandas(made, "n_nationkey int, geometry binary, centre binary").write.parquet(path)
    g = src.read_wkb(spark.read.parquet(path), "geometry").withColumnRenamed("point", "none")
    g = src.read_wkb(g.drop("none").withColumnRenamed("rings", "outline"), "centre")
    return g.select(
        "n_nationkey",
        F.size("outline").cast("long").alias("rings"),
        F.array_max(F.transform(F.col("outline")[0], lambda q: q["x"])).alias("max_x"),
        F.col("point.x").alias("px"),
    )


_TRIANGLES = """WITH sq AS (SELECT DISTINCT CAST(floor(c_acctbal / 1000) * 1000 AS BIGINT) AS x0, CAST(floor(c_custkey / 1000.0) * 1000 AS BIGINT) AS y0 FROM customer),
    tri AS (SELECT x0, y0, h, x0 || '_' || y0 || h AS zone FROM sq, (VALUES ('L'), ('U')) t(h))"""


def _shapes(spark, d):
    """Triangles of the squares that hold customers, every fifth without geometry; names, numbers, a truth value and a date."""
    from zonalyx.plans.q_spatial import _triangles

    t = _triangles(spark, d)
    x0 = F.split("zone", "_")[0].cast("long")
    return t.select(
        "zone", x0.alias("x0"), (x0 / 3.0).alias("third"), (x0 > 0).alias("east"), F.date_add(F.lit("2020-01-01").cast("date"), (x0 / 1000).cast("int")).alias("day"),
        F.when(x0 % 5000 != 0, F.col("rings")).alias("rings"),
    )


@query(
    "r007_shapefile",
    f"""{_TRIANGLES} SELECT zone, x0, round(x0 / 3.0, 6) AS third, x0 > 0 AS east, strftime(DATE '2020-01-01' + CAST(x0 // 1000 AS INTEGER), '%Y-%m-%d') AS day,
    CASE WHEN x0 % 5000 <> 0 THEN 4 END AS points, CASE WHEN x0 % 5000 <> 0 THEN -500000.0 END AS area, CASE WHEN x0 % 5000 <> 0 THEN x0 + 1000.0 END AS max_x FROM tri""",
)
def _(spark, d):
    """Written as Shapefiles, one a task, and read back by ranges of records; outer rings turn right there."""
    from zonalyx.functions.scalar import ring_signed_area
    from zonalyx.sources import shapes

    path = new_path(spark, "shapefile")
    shapes.write_shapefile(_shapes(spark, d), path)
    r = F.col("rings")[0]
    return shapes.read_shapefile(spark, path).select(
        "zone", "x0", r6("third", "third"), "east", F.date_format("day", "yyyy-MM-dd").alias("day"), F.size(r).alias("points"), ring_signed_area(r).alias("area"), F.array_max(F.transform(r, lambda q: q["x"])).alias("max_x")
    )


@query(
    "r007_geopackage",
    f"""{_TRIANGLES} SELECT zone, x0, round(x0 / 3.0, 6) AS third, x0 > 0 AS east, CASE WHEN x0 % 5000 <> 0 THEN 4 END AS points,
    CASE WHEN x0 % 5000 <> 0 THEN 500000.0 END AS area, CASE WHEN x0 % 5000 <> 0 THEN CAST(y0 AS DOUBLE) END AS min_y FROM tri""",
)
def _(spark, d):
    """Written as GeoPackages, one a task, and read back by ranges of rows."""
    from zonalyx.functions.scalar import ring_signed_area
    from zonalyx.sources import shapes

    path = new_path(spark, "geopackage")
    shapes.write_geopackage(_shapes(spark, d).drop("day"), path, layer="zones", srs="3347")
    r = F.col("rings")[0]
    got = shapes.read_geopackage(spark, path, layer="zones")
    return got.select("zone", "x0", r6("third", "third"), "east", F.size(r).alias("points"), ring_signed_area(r).alias("area"), F.array_min(F.transform(r, lambda q: q["y"])).alias("min_y"))


@query("r015_geopackage_points", "SELECT c_custkey, c_name AS name, c_acctbal AS x, CAST(c_custkey AS DOUBLE) AS y FROM customer")
def _(spark, d):
    from zonalyx.sources import shapes

    path = new_path(spark, "geopackage")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.struct(F.col("c_acctbal").alias("x"), F.col("c_custkey").cast("double").alias("y")).alias("point"))
    shapes.write_geopackage(c, path)
    return shapes.read_geopackage(spark, path).select("c_custkey", "name", "point.x", "point.y")


@query("r008_json_lines", "SELECT event_id, event_type, value FROM events")
def _(spark, d):
    path = new_path(spark, "json")
    table(spark, d, "events").select("event_id", "event_type", "value").write.json(f"{path}/events.jsonl")
    return src.read_table(spark, f"{path}/events.jsonl").select("event_id", "event_type", "value")


@query(
    "r009_arrays_by_key",
    "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS width, round(CAST(embedding[1] AS DOUBLE), 5) AS first, label = 1 AS mask FROM embeddings",
)
def _(spark, d):
    """Dense arrays and masks live in a table by key instead of in an archive by row order."""
    path = new_path(spark, "arrays")
    table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") == 1).alias("mask")).write.parquet(path)
    a = spark.read.parquet(path)
    return a.select("vec_id", F.size("embedding").cast("long").alias("width"), F.round(F.col("embedding")[0].cast("double"), 5).alias("first"), "mask")


@query("r012_latest_path", "SELECT 'b' AS chosen, c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1, 2")
def _(spark, d):
    """The first of several places that exists; of a pattern, the newest, which here holds fewer segments than the older one."""
    path = new_path(spark, "latest")
    c = table(spark, d, "customer").select("c_nationkey", "c_acctbal", "c_mktsegment")
    c.write.parquet(f"{path}/run-a")
    c.where("c_mktsegment <> 'BUILDING'").write.parquet(f"{path}/run-b")
    found = src.first_existing([f"{path}/none", f"{path}/run-*"], spark)
    return spark.read.parquet(found).groupBy(F.lit(found.rstrip("/")[-1]).alias("chosen"), "c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("r013_both_formats", "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, true AS same FROM nation")
def _(spark, d):
    path = new_path(spark, "both")
    src.write_both(table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")), path)
    a, b = spark.read.parquet(f"{path}.parquet"), src.read_csv(spark, f"{path}.csv")
    return b.join(a.select(F.col("key").cast("string").alias("key"), F.col("name").alias("other")), "key").select(
        "key",
        "name",
        (F.col("name") == F.col("other")).alias("same"),
    )


@query("r014_partitions", "SELECT o_orderstatus AS split, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    path = new_path(spark, "split")
    src.write_partitions(table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("split")), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "r015_geojson_sink",
    "SELECT CAST(zone_id AS VARCHAR) AS zone, CAST(5 AS BIGINT) AS points, CASE WHEN zone_id % 4 = 0 THEN NULL ELSE CAST(zone_id AS VARCHAR) END AS size FROM (SELECT DISTINCT c_nationkey AS zone_id FROM customer)",
)
def _(spark, d):
    """Features with NaN for every fourth value, read back from their lines."""
    from zonalyx.functions.scalar import grid_ring

    z = zones(spark, d).select(
        F.col("zone_id").cast("string").alias("zone"),
        F.when(F.col("zone_id") % 4 == 0, float("nan")).otherwise(F.col("zone_id").cast("double")).alias("size"),
        F.array(grid_ring(F.concat(F.lit("grid25m_"), F.col("zone_id") * 25, F.lit("_0")))).alias("rings"),
    )
    path = new_path(spark, "geojson")
    legend = spark.createDataFrame([("low", "#ffffb2"), ("high", "#bd0026")], "label string, colour string")
    src.write_geojson(z, path, "rings", ["zone", "size"], legend)
    g = src.read_geojson(spark, f"{path}/features", multi_line=False)
    return g.select(
        F.col("properties")["zone"].alias("zone"),
        F.size(F.col("rings")[0]).cast("long").alias("points"),
        F.regexp_replace(F.col("properties")["size"], r"\.0$", "").alias("size"),
    )


@query("r016_text_sink", "SELECT 'zones: 25' AS text")
def _(spark, d):
    path = new_path(spark, "text")
    src.write_bytes(spark, f"{path}/said.txt", f"zones: {zones(spark, d).count()}".encode())
    return spark.read.text(f"{path}/said.txt").select(F.col("value").alias("text"))


@query(
    "r018_index_outputs",
    f"""WITH {ZONES}, n AS (SELECT CAST(count(*) AS VARCHAR) AS n FROM zones)
    SELECT label, CASE label WHEN 'standard_output' THEN n WHEN 'intermediate_output' THEN n WHEN 'metadata_json' THEN 'factors,' || n WHEN 'validation_report_json' THEN 'true' WHEN 'missing_data_report_json' THEN '4' WHEN 'run_report' THEN '12' END AS said
    FROM n, (VALUES ('intermediate_output'), ('metadata_json'), ('missing_data_report_json'), ('run_report'), ('standard_output'), ('validation_report_json')) t(label)""",
)
def _(spark, d):
    from zonalyx.operators import aggregates as ag
    from zonalyx.operators import index as ix
    from zonalyx.operators import validate as va
    from zonalyx.plans.q_index import FOUR
    from zonalyx.plans.q_more import FACTORS

    z = zones(spark, d)
    scored, info = ix.get_index("factor_based")(z, FACTORS, keep=2)
    summary = spark.createDataFrame(
        ix.factor_summary(info),
        "factor string, eigenvalue double, explained double, leading string, leading_positive string, leading_negative string, orientation string, rationale string, configured boolean",
    )
    files = src.write_index(
        ix.standard_output(scored, "zone_id", "score", "factors"),
        new_path(spark, "index"),
        {"name": "factors", "rows": info["rows"]},
        ["rank", "zone_id"],
        intermediate=scored,
        issues=va.factor_index_table(z, "zone_id", dict.fromkeys(FOUR, "number")),
        missing=ag.missingness(z, FOUR),
        extra={"factor_summary": summary},
    )
    text = lambda k: spark.read.text(files[k], wholetext=True)
    rows = lambda k: spark.read.option("header", True).csv(files[k]).agg(F.count(F.lit(1)).cast("string").alias("said"))
    said = {
        "standard_output": rows("standard_output"),
        "intermediate_output": rows("intermediate_output"),
        "metadata_json": text("metadata_json").select(F.concat_ws(",", F.get_json_object("value", "$.name"), F.get_json_object("value", "$.rows")).alias("said")),
        "validation_report_json": text("validation_report_json").select(F.get_json_object("value", "$.is_valid").alias("said")),
        "missing_data_report_json": text("missing_data_report_json").select(F.json_array_length("value").cast("string").alias("said")),
        "run_report": spark.read.text(files["run_report"]).where("value LIKE '|%'").agg(F.count(F.lit(1)).cast("string").alias("said")),
    }
    parts = [df.select(F.lit(k).alias("label"), "said") for k, df in said.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("r019_report", "SELECT CAST(27 AS BIGINT) AS table_rows")
def _(spark, d):
    """A Markdown table of all zones with its two head lines."""
    text = src.report("zones", zones(spark, d), ["zone_id"], 100)
    return spark.createDataFrame([(sum(line.startswith("|") for line in text.splitlines()),)], "table_rows long")


@query("r005_bounded_sample", "SELECT count(*) AS n FROM (SELECT * FROM orders LIMIT 100)")
def _(spark, d):
    """A preview of so many rows, which is all that it is asked for."""
    return table(spark, d, "orders").limit(100).agg(F.count(F.lit(1)).alias("n"))


@query(
    "r017_content_hash",
    "SELECT sha256(string_agg(CAST(n_nationkey AS VARCHAR) || ',' || n_name || chr(10), '' ORDER BY n_nationkey)) AS sha256 FROM nation",
)
def _(spark, d):
    path = new_path(spark, "manifest")
    n = table(spark, d, "nation").orderBy("n_nationkey").coalesce(1).sortWithinPartitions("n_nationkey")
    n.select(F.concat_ws(",", "n_nationkey", "n_name").alias("value")).write.text(path)
    return src.manifest(spark, path).where("path like '%.txt'").select("sha256")


QUERIES, ORACLE_SQL = query.queries, query.sql
