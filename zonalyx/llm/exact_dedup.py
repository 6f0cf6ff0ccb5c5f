"""Exact deduplication by content sort.

Rows are range-partitioned by their normalised bytes with sampled splitters and
sorted (externally, Spark spills) inside each range, so that equal texts are
neighbours; WindowExec compares whole neighbouring texts to close a group.

The splitters compare the first SPLIT_CHARS characters and a 64-bit hash of the
whole text, not the text itself, so that the sample which the driver gathers has
a bounded size whatever the texts are; equal texts still share a range, and the
sort inside the range and the group boundary compare whole texts.

A text that more than 1/HOT_SHARE of all rows share is dealt over several ranges
by a salt. Those groups (HOT_SHARE at most) are closed per salt first and then
merged by one small aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonalyx.llm.store import keep

SPLIT_CHARS = 48
HOT_SHARE = 4096
MIN_HOT_ROWS = 256

_P = "__xd_"


def identity(text: Column) -> Column:
    return text


def collapse(text: Column) -> Column:
    """Lower case, white space runs to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _groups(df: DataFrame, text_col: str, id_col: str, normalise, keep_largest: bool, carry: list[str]) -> DataFrame:
    """carry plus the helper columns __xd_id, __xd_sha, __xd_keep, __xd_size, __xd_rank (1: the row that stays)."""
    base = df.select(
        *[F.col(f"`{c}`") for c in carry],
        F.col(f"`{id_col}`").alias(_P + "id"),
        F.coalesce(normalise(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), F.lit("")).alias(_P + "text"),
    )
    base = base.withColumn(_P + "hash", F.xxhash64(_P + "text"))
    limit = max(MIN_HOT_ROWS, df.count() // HOT_SHARE)
    hot = base.groupBy(_P + "hash").agg(F.count(F.lit(1)).alias(_P + "n")).where(F.col(_P + "n") > limit)
    hot = keep(hot.select(_P + "hash", F.ceil(F.col(_P + "n") / limit).cast("int").alias(_P + "salts")), "exact-hot")
    # hot holds fewer than HOT_SHARE rows of 12 bytes: each stands for more than 1/HOT_SHARE of the input
    rows = base.join(F.broadcast(hot), _P + "hash", "left")
    salt = F.when(F.col(_P + "salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(_P + "id", F.spark_partition_id()), F.col(_P + "salts")).cast("int") + 1)
    rows = rows.withColumn(_P + "salt", salt).withColumn(_P + "head", F.substring(_P + "text", 1, SPLIT_CHARS))
    key = [_P + "head", _P + "hash", _P + "salt"]
    ranged = rows.repartitionByRange(*key)
    order = F.col(_P + "id").desc_nulls_last() if keep_largest else F.col(_P + "id").asc_nulls_last()
    same = Window.partitionBy(*key, _P + "text")
    best = F.max(_P + "id") if keep_largest else F.min(_P + "id")
    closed = ranged.select(
        *carry, _P + "id", *key,
        F.sha2(_P + "text", 256).alias(_P + "sha"),
        best.over(same).alias(_P + "best"),
        F.count(F.lit(1)).over(same).alias(_P + "n"),
        F.row_number().over(same.orderBy(order)).alias(_P + "rank"),
    )
    closed = keep(closed.drop(_P + "head"), "exact-groups")
    # one row per salt of a hot text; merged by text digest, at most HOT_SHARE rows remain
    parts = closed.where((F.col(_P + "salt") > 0) & (F.col(_P + "rank") == 1))
    best = F.max(_P + "best") if keep_largest else F.min(_P + "best")
    if keep_largest:
        lead = F.max(F.struct(F.col(_P + "best").isNotNull(), F.col(_P + "best"), F.col(_P + "salt").alias("lead")))
    else:
        lead = F.min(F.struct(F.col(_P + "best").isNull(), F.col(_P + "best"), F.col(_P + "salt").alias("lead")))
    merged = parts.groupBy(_P + "sha").agg(best.alias(_P + "all_best"), F.sum(_P + "n").alias(_P + "all_n"), lead["lead"].alias(_P + "lead"))
    out = closed.join(F.broadcast(merged), _P + "sha", "left")
    is_hot = F.col(_P + "salt") > 0
    return out.select(
        *carry, _P + "id", _P + "sha",
        F.when(is_hot, F.col(_P + "all_best")).otherwise(F.col(_P + "best")).alias(_P + "keep"),
        F.when(is_hot, F.col(_P + "all_n")).otherwise(F.col(_P + "n")).alias(_P + "size"),
        F.when(is_hot & (F.col(_P + "salt") != F.col(_P + "lead")), F.col(_P + "rank") + 1).otherwise(F.col(_P + "rank")).alias(_P + "rank"),
    )


def exact_groups(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", *, normalise=identity, keep_largest: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; a null id is never kept while another id is there.
    Rows that repeat both text and id: exactly one of them is kept. Empty input
    gives no rows. Other columns of df, whatever their names, are not touched.
    """
    out = _groups(df, text_col, id_col, normalise, keep_largest, [])
    return out.select(
        F.col(_P + "id").alias(id_col),
        F.col(_P + "keep").alias("keep_id"),
        F.col(_P + "size").alias("group_size"),
        (F.col(_P + "rank") == 1).alias("kept"),
        F.col(_P + "sha").alias("text_sha256"),
    )


def drop_exact_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", *, normalise=identity, keep_largest: bool = False) -> DataFrame:
    """df without the rows whose text another, preferred row has; all columns stay."""
    renamed = [f"__c{i}" for i in range(len(df.columns))]
    flat = df.toDF(*renamed)
    out = _groups(flat, renamed[df.columns.index(text_col)], renamed[df.columns.index(id_col)], normalise, keep_largest, renamed)
    return out.where(F.col(_P + "rank") == 1).select(*renamed).toDF(*df.columns)
