"""Sharding over fixed virtual slots.

A record hashes into one of N_SLOTS slots, which never change. Bytes are summed
per slot and a table (version, slot, part, shard) says which shard holds a slot.
Rebalancing edits that table and nothing else: `assign` makes version 0, `grow`
moves as few slots as bring one more shard to its share, into that shard only.

A slot with more than 1/SPLIT_SHARE of all rows or bytes (a key that repeats) is
cut into parts, which are assigned one by one.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonalyx.llm.store import keep, new_path

N_SLOTS = 8192
SPLIT_SHARE = 2048
MIN_SPLIT_ROWS = 256

MAP_SCHEMA = "version int, slot int, part int, n_rows long, bytes long, shard int"


def slot_rows(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", n_slots: int = N_SLOTS) -> DataFrame:
    """One row per record: id, size, text_crc32, slot, part (written to the shared folder).

    size is the UTF-8 length plus 1, so a null or empty text weighs 1. A null id
    hashes like any other value; rows that repeat an id share its slot.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = keep(
        df.select(
            F.col(f"`{id_col}`").alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(n_slots)).cast("int").alias("slot"),
            F.monotonically_increasing_id().alias("uid"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    row_limit, byte_limit = max(MIN_SPLIT_ROWS, total.n // SPLIT_SHARE), max(1, total.b // SPLIT_SHARE)
    sums = rows.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    parts = F.greatest(F.ceil(F.col("n") / row_limit), F.when(F.col("n") > MIN_SPLIT_ROWS, F.ceil(F.col("b") / byte_limit)).otherwise(1)).cast("int")
    split = sums.where(F.col("n") > MIN_SPLIT_ROWS).select("slot", parts.alias("parts")).where("parts > 1")
    # one row per slot at most, n_slots is fixed
    cut = rows.join(F.broadcast(split), "slot", "left")
    return cut.select(
        "id",
        "size",
        "text_crc32",
        "slot",
        "uid",
        F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("uid"), F.col("parts"))).cast("int").alias("part"),
    )


def slot_sums(rows: DataFrame) -> list[tuple[int, int, int, int]]:
    """(slot, part, rows, bytes); as many as there are slots, and parts of split slots."""
    got = rows.groupBy("slot", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).collect()
    return sorted((r.slot, r.part, r.n, r.b) for r in got)


def assign(sums: list[tuple[int, int, int, int]], n_shards: int, version: int = 0) -> list[tuple]:
    """Slots in falling order of bytes, each to the shard with fewest bytes so far."""
    heap = [(0, shard) for shard in range(n_shards)]
    out = []
    for slot, part, n, size in sorted(sums, key=lambda r: (-r[3], r[0], r[1])):
        held, shard = heapq.heappop(heap)
        out.append((version, slot, part, n, size, shard))
        heapq.heappush(heap, (held + size, shard))
    return sorted(out, key=lambda r: (r[1], r[2]))


def grow(slot_map: list[tuple], n_shards: int) -> list[tuple]:
    """The next version with shard n_shards - 1 added: it takes slots from the fullest shards until it has its share."""
    held: dict[int, int] = dict.fromkeys(range(n_shards), 0)
    by_shard: dict[int, list[tuple]] = {s: [] for s in range(n_shards)}
    for row in slot_map:
        held[row[5]] += row[4]
        by_shard[row[5]].append(row)
    for rows in by_shard.values():
        rows.sort(key=lambda r: (r[4], r[1], r[2]))
    share, new = sum(held.values()) / n_shards, n_shards - 1
    moved: set[tuple[int, int]] = set()
    while held[new] < share:
        donor = max((s for s in by_shard if s != new and by_shard[s]), key=lambda s: (held[s], -s), default=None)
        if donor is None or held[donor] <= share:
            break
        room = min(share - held[new], held[donor] - share)
        fits = [r for r in by_shard[donor] if 0 < r[4] <= max(room, by_shard[donor][0][4])]
        row = fits[-1] if fits else by_shard[donor][0]
        if held[new] + row[4] > share * 1.02 + 1 and held[new] > 0:
            break
        by_shard[donor].remove(row)
        held[donor] -= row[4]
        held[new] += row[4]
        moved.add((row[1], row[2]))
    return [(r[0] + 1, r[1], r[2], r[3], r[4], new if (r[1], r[2]) in moved else r[5]) for r in slot_map]


def map_table(spark: SparkSession, slot_map: list[tuple]) -> DataFrame:
    return spark.createDataFrame(slot_map, MAP_SCHEMA)


def store_map(spark: SparkSession, slot_map: list[tuple], path: str | None = None) -> str:
    """Append one version of the map to the table at path (a new one if none is given)."""
    path = path or new_path(spark, "slot-map")
    map_table(spark, slot_map).coalesce(1).write.mode("append").partitionBy("version").parquet(path)
    return path


def load_map(spark: SparkSession, path: str, version: int | None = None) -> list[tuple]:
    """The rows of one version, the newest if none is named."""
    table = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    got = table.where(F.col("version") == F.lit(version)).collect()
    return sorted(((r.version, r.slot, r.part, r.n_rows, r.bytes, r.shard) for r in got), key=lambda r: (r[1], r[2]))


def place(rows: DataFrame, slot_map: list[tuple]) -> DataFrame:
    """rows with shard, and position: the record's gapless number inside its shard.

    A slot's rows follow those of the slots before it in the same shard, so a
    record's position is its slot's offset plus its rank inside the slot; no
    window spans a shard.
    """
    after: dict[int, int] = {}
    table = []
    for _, slot, part, n, _, shard in slot_map:
        table.append((slot, part, shard, after.get(shard, 0)))
        after[shard] = after.get(shard, 0) + n
    spark = rows.sparkSession
    offsets = spark.createDataFrame(table, "slot int, part int, shard int, offset long")
    rank = F.row_number().over(Window.partitionBy("slot", "part").orderBy("id", "uid"))
    ranked = rows.withColumn("rank", rank)
    return ranked.join(F.broadcast(offsets), ["slot", "part"]).withColumn("position", F.col("offset") + F.col("rank") - 1)


def shard_by_bytes(df: DataFrame, n_shards: int = 16, text_col: str = "text", id_col: str = "doc_id", n_slots: int = N_SLOTS) -> DataFrame:
    """id, size, text_crc32, virtual_slot, part, map_version, shard, position: near equal bytes in each shard.

    The map is stored as a versioned table and read back before it is used.
    Empty input gives no rows; extra columns of df are ignored.
    """
    rows = slot_rows(df, text_col, id_col, n_slots)
    spark = df.sparkSession
    sums = slot_sums(rows)
    if sums:
        path = store_map(spark, assign(sums, n_shards))
        slot_map = load_map(spark, path)
    else:
        slot_map = []
    placed = place(rows, slot_map)
    return placed.select("id", "size", "text_crc32", F.col("slot").alias("virtual_slot"), "part", F.lit(0).alias("map_version"), "shard", "position")


def spread(slot_map: list[tuple]) -> float:
    """Largest over mean bytes of a shard."""
    held: dict[int, int] = {}
    for r in slot_map:
        held[r[5]] = held.get(r[5], 0) + r[4]
    return max(held.values()) * len(held) / max(1, math.fsum(held.values())) if held else 1.0
