"""Tables kept between stages in the folder that the whole cluster shares.

A written table cuts the lineage: when an executor is lost, what was written is
read again instead of computed again, and no state lives on one machine only.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used where the session names no folder, as in local tests.
DEFAULT_DIR = "/tmp/checkpoints"

_recording: list[list[str]] = []
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset DEFAULT_DIR, on one machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return (named or DEFAULT_DIR).rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/zonalyx/{tag}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    for paths in _recording:
        paths.append(path)
    return path


@contextlib.contextmanager
def recorded(paths: list[str]) -> Iterator[None]:
    """Within, every new path is added to paths, for drop() once what was made of them is written elsewhere."""
    _recording.append(paths)
    try:
        yield
    finally:
        _recording.remove(paths)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete what lies at recorded paths."""
    while paths:
        _delete(spark, paths.pop())


def keep(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that keep() returned and that nothing will read again."""
    for table in tables:
        path = _paths.pop(table, None)
        if path is not None:
            _delete(table.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what has been written; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session has ended already
        return


#: Rows that a task sorts or hashes at once where by_rows() deals them.
ROWS_A_TASK = 500_000


def by_rows(df: DataFrame, *keys: str, rows: int | None = None, most: int = ROWS_A_TASK) -> DataFrame:
    """df hashed by keys over so many tasks that each has some `most` rows, of all rows (counted where not given).

    Spark merges shuffled partitions by their compressed bytes, of which few make many
    rows of long integers; a number of partitions that is asked for stays.
    """
    return df.repartition(tasks_for(df.sparkSession, df.count() if rows is None else rows, most), *keys)


def tasks_for(spark: SparkSession, rows: int, most: int = ROWS_A_TASK) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-rows // most))


def dense_id(df: DataFrame, out: str, *keys: str | Column) -> DataFrame:
    """0-based number of each row in the order of keys.

    Rows are range-partitioned by keys and written to the shared folder; a row's
    number is its place in its range after the rows of the ranges before, so the
    sort is spread over all tasks and nothing is held in executors. Like what keep()
    returns, the table can be discarded.
    """
    ranges = df.repartitionByRange(*[F.col(k) if isinstance(k, str) else k for k in keys]).sortWithinPartitions(*keys)
    # a range's number and, in the lower 33 bits, the row's place in it
    ranged = keep(ranges.withColumn("__at", F.monotonically_increasing_id()), "dense-id")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r[0], r[1]) for r in ranged.groupBy(part.alias("p")).count().collect())
    offsets, total = [], 0
    for p, n in sizes:
        offsets += [F.lit(p), F.lit(total)]
        total += n
    if not offsets:
        return df.withColumn(out, F.lit(0).cast("long"))
    number = F.element_at(F.create_map(*offsets), part) + place
    numbered = ranged.withColumn(out, number.cast("long")).drop("__at")
    _paths[numbered] = _paths[ranged]
    return numbered
