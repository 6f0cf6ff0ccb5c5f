"""Sources and sinks."""

from __future__ import annotations

import codecs
import glob
import hashlib
import json
import os
import re
import struct
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonalyx.sources import split_csv

#: Names that Spark has for encodings.
ENCODINGS = {"utf-8": "UTF-8", "latin-1": "ISO-8859-1", "cp1252": "windows-1252", "utf-16": "UTF-16"}


def read_csv(
    spark: SparkSession,
    path: str,
    columns: list[str] | None = None,
    encoding: str = "UTF-8",
    sep: str = ",",
    all_columns: list[str] | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """A CSV with header as text columns; the columns named, all if none are.

    Quoted fields may hold line feeds, for which a file is read by one task; with
    multi_line False a file without any is split over tasks.
    """
    reader = spark.read.option("header", True).option("encoding", encoding).option("sep", sep).option("multiLine", multi_line).option("escape", '"')
    if all_columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in all_columns]))
    df = reader.csv(path)
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df


def _stream(spark: SparkSession, path: str, size: int = 1 << 20) -> Iterator[bytes]:
    """A file's bytes, part by part, wherever Spark reads it from; the driver holds one part."""
    system, where = _hadoop(spark, path)
    files = [f.getPath() for f in system.listStatus(where) if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
    for file in sorted(files, key=lambda f: f.getName()):
        got = system.open(file)
        try:
            while part := bytes(got.readNBytes(size)):
                yield part
        finally:
            got.close()


def probe_encoding(parts: Iterable[bytes], candidates: tuple[str, ...] = ("utf-8", "latin-1")) -> str:
    """The first encoding that reads all of the bytes."""
    readers = {e: codecs.getincrementaldecoder(e)() for e in candidates}
    for part in parts:
        for e in list(readers):
            try:
                readers[e].decode(part)
            except UnicodeDecodeError:
                del readers[e]
        if list(readers) == [candidates[-1]] and candidates[-1] == "latin-1":
            return "latin-1"  # which reads any byte
    for e, reader in readers.items():
        try:
            reader.decode(b"", True)
            return e
        except UnicodeDecodeError:
            continue
    raise ValueError(f"none of {candidates} reads the file")


def probe_separator(lines: list[str], candidates: str = ",;\t|") -> str:
    """The separator that cuts most lines into the same number of fields, of equal ones that with more fields; quoted parts do not count."""
    plain = [re.sub(r'"(?:[^"]|"")*"', "", line) for line in lines if line.strip()]

    def fit(sep: str) -> tuple[int, int]:
        n = Counter(line.count(sep) for line in plain)
        n.pop(0, None)
        if not n:
            return 0, 0
        fields, times = max(n.items(), key=lambda kv: (kv[1], kv[0]))
        return times, fields

    return max(candidates, key=lambda s: (fit(s), -candidates.index(s)))


def read_csv_probed(spark: SparkSession, path: str, corrupt: str | None = None, encodings: tuple[str, ...] = ("utf-8", "latin-1")) -> DataFrame:
    """A CSV whose encoding and separator are decided on all of its lines, by the tasks that read them.

    Quoted fields may hold line feeds and files are cut over tasks all the same
    (split_csv); UTF-16, whose lines cannot be cut at bytes, is read by one task a file.
    No row is dropped: one with too few fields has NULLs. With `corrupt`, a column
    of that name holds the text of rows with too many or too few fields, NULL for
    others, so that callers may leave them out.
    """
    lines = split_csv.raw_lines(spark, path)
    wide = [e for e in encodings if e.startswith("utf-16")]
    if wide:
        encoding = probe_encoding(_stream(spark, path), encodings)
        if encoding in wide:
            return _read_whole_csv(spark, path, encoding, corrupt)
    else:
        encoding = split_csv.encoding_of(lines, encodings)
    rows = split_csv.records(lines, encoding)
    return split_csv.parse(rows, split_csv.separator_of(rows), corrupt)


def _read_whole_csv(spark: SparkSession, path: str, encoding: str, corrupt: str | None) -> DataFrame:
    """A file a task; the separator is that of its first lines."""
    sep = probe_separator(next(_stream(spark, path), b"").decode(encoding, "ignore").splitlines()[:50])
    options = {"header": True, "encoding": ENCODINGS[encoding], "sep": sep, "multiLine": True, "escape": '"'}
    plain = spark.read.options(**options).csv(path)
    if corrupt is None:
        return plain
    schema = T.StructType([*plain.schema.fields, T.StructField(corrupt, T.StringType())])
    return spark.read.options(**options, columnNameOfCorruptRecord=corrupt).schema(schema).csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: parquet, csv, json (lines), orc or avro-free text."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind == "csv":
        return read_csv_probed(spark, path)
    if kind in ("json", "jsonl", "ndjson"):
        return spark.read.json(path)
    if kind in ("parquet", "orc", "text"):
        return spark.read.format(kind).load(path)
    if kind == "geojson":
        return read_geojson(spark, path)
    raise ValueError(f"no reader for {path}")


_POINT = "struct<x: double, y: double>"


def _rings(parts: Column) -> Column:
    return F.transform(parts, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))


def read_geojson(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """properties (map), geometry_type, crs, rings (all rings of a polygon or multipolygon, holes included), point.

    A FeatureCollection, or with multi_line False a feature a line. crs is the
    collection's name of it, NULL where it has none.
    """
    feature = "struct<properties: map<string,string>, geometry: string>"
    schema = f"features array<{feature}>, crs struct<properties: struct<name: string>>, properties map<string,string>, geometry string"
    got = spark.read.option("multiLine", multi_line).schema(schema).json(path)
    flat = got.select(F.col("crs.properties.name").alias("crs"), F.explode(F.coalesce("features", F.array(F.struct("properties", "geometry")))).alias("f"))
    kind, where = F.get_json_object("f.geometry", "$.type"), F.get_json_object("f.geometry", "$.coordinates")
    polygon = _rings(F.from_json(where, "array<array<array<double>>>"))
    multi = F.flatten(F.transform(F.from_json(where, "array<array<array<array<double>>>>"), _rings))
    at = F.from_json(where, "array<double>")
    rings = F.when(kind == "Polygon", polygon).when(kind == "MultiPolygon", multi)
    point = F.when(kind == "Point", F.struct(at[0].alias("x"), at[1].alias("y")))
    return flat.select(F.col("f.properties").alias("properties"), kind.alias("geometry_type"), "crs", rings.alias("rings"), point.alias("point"))


def read_wkb(df: DataFrame, wkb: str = "geometry") -> DataFrame:
    """df with rings (polygons and multipolygons) and point, from a column of well-known binary, as GeoParquet has it."""
    schema = T.StructType(
        [
            *df.schema.fields,
            T.StructField("rings", T._parse_datatype_string(f"array<array<{_POINT}>>")),
            T.StructField("point", T._parse_datatype_string(_POINT)),
        ]
    )
    names = df.columns

    def run(batches):
        for part in batches:
            got = [parse_wkb(None if g is None else bytes(g)) for g in part[wkb]]
            yield part.assign(rings=[g[0] for g in got], point=[g[1] for g in got])[[*names, "rings", "point"]]

    return df.mapInPandas(run, schema)


def parse_wkb(data: bytes | None) -> tuple[list | None, dict | None]:
    """(rings, point) of a polygon, multipolygon or point; (None, None) of nothing and of other kinds."""
    if not data:
        return None, None
    at = 0

    def take(order: str, form: str) -> tuple:
        nonlocal at
        got = struct.unpack_from(order + form, data, at)
        at += struct.calcsize(order + form)
        return got

    def geometry() -> tuple[list | None, dict | None]:
        nonlocal at
        order = "<" if take("<", "B")[0] else ">"
        kind = take(order, "I")[0]
        if kind & 0x20000000:
            take(order, "I")
        extra = (1 if kind & 0x80000000 else 0) + (1 if kind & 0x40000000 else 0)
        base = kind & 0x0FFFFFFF
        extra += (1 if base // 1000 in (1, 3) else 0) + (1 if base // 1000 in (2, 3) else 0) + (base // 1000 == 3) * 0
        read = lambda: dict(zip("xy", take(order, "d" * (2 + extra))[:2], strict=True))
        base %= 1000
        if base == 1:
            return None, read()
        if base == 3:
            return [[read() for _ in range(take(order, "I")[0])] for _ in range(take(order, "I")[0])], None
        if base == 6:
            return [r for _ in range(take(order, "I")[0]) for r in geometry()[0] or []], None
        return None, None

    return geometry()


def read_excel_sheet(spark: SparkSession, path: str, sheet: str | int = 0, header: list[str] | None = None) -> DataFrame:
    """A sheet of a workbook (.xlsx) as text columns; the header is the first row that has all of `header`, else the first with text.

    A workbook is small by its format (a million rows a sheet); Spark ships its
    bytes to one task, which reads the rows.
    """
    raw = spark.read.format("binaryFile").load(path).select("content")
    names = [r.name for r in raw.mapInPandas(lambda it: _sheet_rows(it, sheet, header, True), "name string").collect()]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return raw.mapInPandas(lambda it: _sheet_rows(it, sheet, header, False), schema)


def _sheet_rows(parts, sheet: str | int, header: list[str] | None, head_only: bool):
    import io

    import pandas as pd

    for part in parts:
        for content in part.content:
            rows = xlsx_rows(io.BytesIO(bytes(content)), sheet)
            wanted = {h.strip().lower() for h in header or []}
            fits = lambda r: wanted <= {(c or "").strip().lower() for c in r} if wanted else any(r)  # noqa: B023, E731
            start = next((k for k, r in enumerate(rows) if fits(r)), None)
            if start is None:
                raise ValueError("no header row in the sheet")
            names = [c.strip() if c and c.strip() else f"column_{k + 1}" for k, c in enumerate(rows[start])]
            if head_only:
                yield pd.DataFrame({"name": names})
            else:
                body = [[*r, *[None] * len(names)][: len(names)] for r in rows[start + 1 :] if any(r)]
                yield pd.DataFrame(body, columns=names, dtype=object)


def xlsx_rows(file, sheet: str | int = 0) -> list[list[str | None]]:
    """The cells of a sheet as text, row by row, by the Office Open XML tables of the archive."""
    import zipfile
    from xml.etree import ElementTree as X

    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
    with zipfile.ZipFile(file) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in X.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        sheets = X.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", ns)
        one = sheets[sheet] if isinstance(sheet, int) else next(s for s in sheets if s.get("name") == sheet)
        targets = {r.get("Id"): r.get("Target") for r in X.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        name = targets[one.get(f"{{{ns['r']}}}id")].lstrip("/")
        out: list[list[str | None]] = []
        for row in X.fromstring(z.read(name if name.startswith("xl/") else f"xl/{name}")).findall("m:sheetData/m:row", ns):
            cells: dict[int, str | None] = {}
            for k, c in enumerate(row.findall("m:c", ns)):
                letters = re.match(r"[A-Z]*", c.get("r") or "").group()
                at = k
                if letters:
                    at = 0
                    for letter in letters:
                        at = at * 26 + ord(letter) - 64
                    at -= 1
                v, kind = c.find("m:v", ns), c.get("t")
                text = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if kind == "inlineStr" else None if v is None else v.text
                cells[at] = shared[int(text)] if kind == "s" and text is not None else text
            out.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
        return out


def xlsx_bytes(sheet: str, rows: list[list]) -> bytes:
    """A small workbook of one sheet: numbers as such, texts inline, None as no cell."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    def cell(r: int, c: int, v) -> str:
        at, k = "", c + 1
        while k:
            k, rest = divmod(k - 1, 26)
            at = chr(65 + rest) + at
        if isinstance(v, (int, float)):
            return f'<c r="{at}{r}"><v>{v}</v></c>'
        return f'<c r="{at}{r}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'

    body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows, 1))
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    files = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="xml" ContentType="application/xml"/><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/></Types>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def read_config(path: str) -> dict:
    """A JSON or YAML mapping; anything else is an error."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        import yaml

        got = yaml.safe_load(text)
    else:
        got = json.loads(text)
    if not isinstance(got, dict):
        raise ValueError(f"{path} holds no mapping")
    return got


def infer_kind(df: DataFrame, column: str) -> str:
    """month, date, number, code or text: what at least 80 percent of all values look like."""
    patterns = {"month": r"^\d{4}-\d{2}$", "date": r"^\d{4}-\d{2}-\d{2}", "number": r"^-?\d+(\.\d+)?$", "code": r"^[A-Za-z]*\d{4,}$"}
    c = F.trim(F.col(column).cast("string"))
    r = df.agg(F.count(column).alias("n"), *[F.count_if(c.rlike(p)).alias(k) for k, p in patterns.items()]).first()
    return next((k for k in patterns if r.n and r[k] >= 0.8 * r.n), "text")


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def first_existing(paths: list[str], spark: SparkSession | None = None) -> str | None:
    """The first path that exists; of a pattern, the newest match, of equally new ones the last by name.

    With a session, paths are those of any store that Spark reads.
    """
    for p in paths:
        if spark is None:
            found = [(os.path.getmtime(f), f) for f in glob.glob(p, recursive=True)]
        else:
            system, where = _hadoop(spark, p)
            found = [(f.getModificationTime(), f.getPath().toString()) for f in system.globStatus(where) or []]
        if found:
            return max(found)[1]
    return None


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file in any store that Spark writes to, through a file beside it."""
    system, where = _hadoop(spark, path)
    beside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    out = system.create(beside, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    system.delete(where, False)
    system.rename(beside, where)


def write_both(df: DataFrame, path: str) -> None:
    """Parquet, and a CSV twin of it."""
    df.write.mode("overwrite").parquet(f"{path}.parquet")
    df.sparkSession.read.parquet(f"{path}.parquet").write.mode("overwrite").option("header", True).csv(f"{path}.csv")


def write_partitions(df: DataFrame, path: str, by: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def features(df: DataFrame, rings: str, properties: list[str]) -> DataFrame:
    """value: each row as a GeoJSON feature, a polygon of all rings; NaN and infinity become null."""
    kinds = dict(df.dtypes)
    finite = lambda c: ~F.isnan(F.col(c)) & (F.abs(F.col(c)) < float("inf"))
    clean = [F.when(finite(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in properties]
    pairs = F.transform(F.col(rings), lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    geometry = F.when(F.col(rings).isNotNull(), F.struct(F.lit("Polygon").alias("type"), pairs.alias("coordinates")))
    return df.select(
        F.to_json(
            F.struct(F.lit("Feature").alias("type"), F.struct(*clean).alias("properties"), geometry.alias("geometry")),
            {"ignoreNullFields": "false"},
        ).alias("value")
    )


def write_geojson(df: DataFrame, path: str, rings: str, properties: list[str], legend: DataFrame | None = None) -> None:
    """One feature a line under path/features, and the legend table, if any, as CSV under path/legend."""
    features(df, rings, properties).write.mode("overwrite").text(f"{path}/features")
    if legend is not None:
        legend.write.mode("overwrite").option("header", True).csv(f"{path}/legend")


def feature_collection(df: DataFrame, path: str, rings: str, properties: list[str], crs: str | None = None) -> None:
    """One GeoJSON file that is a FeatureCollection, for maps: rows stream through the driver one by one."""
    head = f'"crs":{{"type":"name","properties":{{"name":{json.dumps(crs)}}}}},' if crs else ""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, beside = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write('{"type":"FeatureCollection",' + head + '"features":[')
        for k, r in enumerate(features(df, rings, properties).toLocalIterator()):
            f.write(("," if k else "") + "\n" + r.value)
        f.write("\n]}\n")
    os.replace(beside, path)


def write_text(path: str, text: str) -> None:
    """Through a file beside it, so that readers see all of it or nothing."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, beside = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(beside, path)


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


def fingerprint(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def _sorted(value: Column, kind: T.DataType) -> Column:
    """value with the fields of its structs in the order of their names."""
    if isinstance(kind, T.StructType):
        fields = [_sorted(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _sorted(x, kind.elementType))
    return value


def fingerprint_of(value: Column, kind: T.StructType) -> Column:
    """The fingerprint of each row's struct: SHA-256 of its JSON, keys sorted, nulls kept."""
    return F.sha2(F.to_json(_sorted(value, kind), {"ignoreNullFields": "false"}), 256)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def report(title: str, df: DataFrame, order: list[str], n: int = 10) -> str:
    """A Markdown table of the first n rows."""
    rows = df.orderBy(*order).limit(n).collect()
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows]
    return "\n".join([*lines, ""])


def write_index(
    df: DataFrame,
    path: str,
    metadata: dict,
    order: list[str],
    intermediate: DataFrame | None = None,
    issues: DataFrame | None = None,
    missing: DataFrame | None = None,
    extra: dict[str, DataFrame] | None = None,
) -> dict[str, str]:
    """All outputs of an index run; label to path.

    standard_output and intermediate_output (each Parquet and CSV), metadata and
    validation_report (each JSON and YAML), missing_data_report, run_report, and a
    CSV for each extra table. Reports hold a row per variable or issue, not per zone.
    All of them go to the store that Spark writes the tables to.
    """
    put = lambda where, text: write_bytes(df.sparkSession, where, text.encode())
    files = {"standard_output": f"{path}/standard_output.csv"}
    write_both(df, f"{path}/standard_output")
    if intermediate is not None:
        write_both(intermediate, f"{path}/intermediate_output")
        files["intermediate_output"] = f"{path}/intermediate_output.csv"
    for label, table in (extra or {}).items():
        table.write.mode("overwrite").option("header", True).csv(f"{path}/{label}.csv")
        files[label] = f"{path}/{label}.csv"
    found = [r.asDict() for r in issues.collect()] if issues is not None else []
    reports = {
        "metadata": {**metadata, "fingerprint": fingerprint(metadata)},
        "validation_report": {"is_valid": not any(i["severity"] == "error" for i in found), "issues": found},
    }
    for label, value in reports.items():
        files[f"{label}_json"], files[f"{label}_yaml"] = f"{path}/{label}.json", f"{path}/{label}.yaml"
        put(files[f"{label}_json"], canonical_json(value))
        put(files[f"{label}_yaml"], yaml_text(value))
    files["missing_data_report_json"] = f"{path}/missing_data_report.json"
    put(files["missing_data_report_json"], canonical_json([r.asDict() for r in missing.collect()] if missing is not None else []))
    files["run_report"] = f"{path}/run_report.md"
    listed = "\n".join(["", "## Files", "", *[f"- {k}: {v}" for k, v in sorted(files.items())], ""])
    put(files["run_report"], report(str(metadata.get("name", "index")), df, order) + listed)
    return files


def yaml_text(value) -> str:
    """YAML; JSON, which YAML readers take too, where no YAML library is installed."""
    try:
        import yaml
    except ModuleNotFoundError:
        return json.dumps(json.loads(canonical_json(value)), indent=2, sort_keys=True) + "\n"
    return yaml.safe_dump(json.loads(canonical_json(value)), sort_keys=True, allow_unicode=True)
