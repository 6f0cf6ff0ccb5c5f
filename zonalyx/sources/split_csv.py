"""CSV files with line feeds in quotes, cut over tasks wherever Spark cuts files.

Spark's text reader gives each task the lines of its part of a file. A line's quote
marks say whether it turns quoted text on or off (a doubled mark does neither), so the
parity of the marks before a part, a sum over the parts, says whether the part begins
inside quotes. Each task then joins its lines to records; what crosses a border of
parts, two pieces a part at most, is put together after. Encoding and separator are
decided by tasks as well, on all lines.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonalyx.operators.ship import ship

WHOLE, HEAD, TAIL, MIDDLE = 0, 1, 2, 3
_OUT = pa.schema([("file", pa.string()), ("start", pa.int64()), ("n", pa.int64()), ("piece", pa.int32()), ("record", pa.string())])


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the part), value: lines as they lie in the files, without their line feed."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def encoding_of(lines: DataFrame, candidates: tuple[str, ...]) -> str:
    """The first candidate that reads all lines; every task tries its own."""
    left = [c for c in candidates if c != "utf-8"]
    if "utf-8" in candidates and lines.agg(F.coalesce(F.bool_and(F.is_valid_utf8("value")), F.lit(True))).first()[0]:
        fits = {"utf-8"}
    else:
        fits = set()
    if candidates[0] in fits:
        return candidates[0]

    def refused(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = list(left)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                for c in list(open_):
                    try:
                        value.decode(c)
                    except UnicodeDecodeError:
                        open_.remove(c)
        yield pa.RecordBatch.from_arrays([pa.array([c for c in left if c not in open_], pa.string())], ["encoding"])

    if left and left[0] != "latin-1":
        bad = {r[0] for r in lines.select(F.col("value").cast("binary")).mapInArrow(refused, "encoding string").distinct().collect()}
    else:
        bad = set()  # latin-1 reads any byte
    for c in candidates:
        if c in fits or (c in left and c not in bad):
            return c
    raise ValueError(f"none of {candidates} reads the file")


def records(lines: DataFrame, encoding: str) -> DataFrame:
    """file, start, n, record: the CSV records of raw_lines, decoded; n is the place in the part, start and n are 0 for a file's first record.

    A file that ends inside quotes gives the rest as its last record.
    """
    ship(lines.sparkSession)
    odd = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    parts = lines.groupBy("file", "start").agg((F.sum(odd) % 2).alias("marks"))
    before = F.sum("marks").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    # a row per part of a file, as many as there are tasks
    parts = parts.select("file", "start", (F.coalesce(before, F.lit(0)) % 2).cast("int").alias("inside"))
    rows = lines.join(F.broadcast(parts), ["file", "start"]).select("file", "start", "inside", F.col("value").cast("binary").alias("value"))

    def glue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, held, inside, torn = None, 0, [], False, False
        out: list[tuple] = []

        def close(piece: int) -> None:
            nonlocal n, held
            text = b"\n".join(held)
            out.append((*at, n, piece, (text[:-1] if text.endswith(b"\r") and piece in (WHOLE, HEAD) else text).decode(encoding)))
            n, held = n + 1, []

        def end() -> None:
            if held:
                close(MIDDLE if torn else TAIL)

        for batch in batches:
            for file, start, first, value in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (file, start) != at:
                    if at is not None:
                        end()
                    at, n, held, inside, torn = (file, start), 0, [], first == 1, first == 1
                held.append(value)
                if value.count(b'"') % 2:
                    inside = not inside
                if not inside:
                    close(HEAD if torn else WHOLE)
                    torn = False
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _OUT.types, strict=True)], schema=_OUT)
                out.clear()
        if at is not None:
            end()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _OUT.types, strict=True)], schema=_OUT)

    made = rows.mapInArrow(glue, "file string, start long, n long, piece int, record string")
    torn = made.where(F.col("piece") != WHOLE)
    # pieces of one record follow one another, and a tail begins it
    turn = F.sum((F.col("piece") == TAIL).cast("long")).over(Window.partitionBy("file").orderBy("start", "n"))
    whole = torn.withColumn("turn", turn).groupBy("file", "turn").agg(F.array_sort(F.collect_list(F.struct("start", "n", "record"))).alias("pieces"))
    whole = whole.select("file", F.col("pieces")[0]["start"].alias("start"), F.col("pieces")[0]["n"].alias("n"), F.array_join(F.transform("pieces", lambda p: p["record"]), "\n").alias("record"))
    return made.where(F.col("piece") == WHOLE).drop("piece").unionByName(whole)


def separator_of(rows: DataFrame, candidates: str = ",;\t|") -> str:
    """The separator that cuts most records into the same number of fields, of equal ones that with more fields; quoted parts do not count."""
    plain = F.regexp_replace("record", '"[^"]*"', "")
    cuts = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.length(plain) - F.length(F.replace(plain, F.lit(c), F.lit("")))).alias("fields")) for k, c in enumerate(candidates)]))
    n = rows.where(F.trim("record") != "").select(cuts.alias("c")).select("c.*").where("fields > 0").groupBy("k", "fields").agg(F.count(F.lit(1)).alias("times"))
    best = n.agg(F.max(F.struct("times", "fields", (-F.col("k")).alias("k"))).alias("b")).select("b.*").first()
    return candidates[-best.k] if best and best.k is not None else candidates[0]


def parse(rows: DataFrame, sep: str, corrupt: str | None = None) -> DataFrame:
    """Text columns named by the first record of the first file; each file's first record is a header. Empty records are left out."""
    head = rows.where("start = 0 AND n = 0").orderBy("file").select("record").first()
    if head is None:
        raise ValueError("the file is empty")
    cells = next(csv.reader(io.StringIO(head.record), delimiter=sep))
    names = [c if c else f"_c{k}" for k, c in enumerate(cells)]
    names = [f"{c}{k}" if names.count(c) > 1 else c for k, c in enumerate(names)]
    fields = [T.StructField(n, T.StringType()) for n in names]
    schema = T.StructType([*fields, T.StructField(corrupt, T.StringType())] if corrupt else fields)
    options = {"sep": sep, "escape": '"', "mode": "PERMISSIVE"}
    if corrupt:
        options["columnNameOfCorruptRecord"] = corrupt
    body = rows.where(~((F.col("start") == 0) & (F.col("n") == 0)) & (F.col("record") != ""))
    record: Column = F.from_csv("record", _ddl(schema), options)
    return body.select(record.alias("c")).select(*[F.col("c").getField(f.name).alias(f.name) for f in schema.fields])


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema.fields)
