"""Mixing sources to target weights by balanced sampling with the cube method.

Every source has a share of all tokens as its target; target over size says how many
copies of a document are expected. The whole copies are taken, the fraction that is
left is an inclusion probability. Flight: of three undecided documents of a source the
probabilities move along the direction that changes neither the expected tokens nor
the expected number of documents (the null space of the two constraints), up or down
by a coin that keeps each expectation, until one of them is 0 or 1 and so decided.
The next document takes its place. At most two stay undecided.

A source's documents fly in blocks of about BLOCK_ROWS, so a source of any size is
many tasks, each with few documents in hand. A block leaves its last RESERVE documents
and two more; those of all blocks fly on by source. Landing: what is left of a source,
RESERVE + 2 documents at most, takes the one of its subsets whose tokens, and then
whose number of documents, are nearest to what is expected of it. Blocks, order and
coins follow from hashes of the documents, not from files or tasks, so reruns agree.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalyx.llm.arrow import ship
from zonalyx.llm.spread import hot_limit, spread_join
from zonalyx.llm.store import keep
from zonalyx.operators.store import dense_id

WORDS = r"[^\x20\x09-\x0D]+"
#: Documents of a source that one flight decides, about.
BLOCK_ROWS = 8192
WEIGHTS = (5.0, 2.0, 1.0)
#: Documents of a source that do not fly but land.
RESERVE = 10
#: Rows of a batch that a task gives back.
OUT_ROWS = 4096
#: Probabilities this close to 0 or 1 are decided.
NEAR = 1e-9


def n_words(text: Column) -> Column:
    """Runs of characters other than blanks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, share: float = 1.0) -> DataFrame:
    """sizes (source, n_docs, source_size) with source_no, its place, and target.

    Sources in the order of their bytes, null last, weigh weights[0], weights[1], ...
    and again from the first. They share `share` of all sizes; no target is above
    `most` times its source's size, what is left over goes to the others by weight
    until none is above. Each turn of that loop is one aggregate over the sources,
    which are not collected.
    """
    placed = dense_id(sizes, "source_no", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    placed = keep(placed.withColumn("weight", weight), "mix-sources")
    cap = F.col("source_size") * most
    total = (placed.agg(F.sum("source_size")).first()[0] or 0) * share
    rate, full = None, -1
    while True:
        over = F.lit(False) if rate is None else F.col("weight") * rate > cap
        got = placed.agg(F.sum(F.when(over, cap).otherwise(0.0)).alias("capped"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("weight"), F.count_if(over).alias("full")).first()
        if got.full == full or not got.weight:
            break
        full, rate = got.full, (total - got.capped) / got.weight
    return placed.withColumn("target", F.least(F.col("weight") * F.lit(rate if rate is not None else 0.0), cap) if got.weight else cap).drop("weight")


def _step(pool: list[list], coin: float) -> None:
    """Move the three probabilities in pool ([probability, size, row] each) until one is 0 or 1; expectations stay."""
    (_, a, _), (_, b, _), (_, c, _) = pool
    way = (b - c, c - a, a - b)
    if not any(way):
        way = (1, -1, 0)
    big = max(map(abs, way))
    way = [w / big for w in way]
    up = min((1 - p[0]) / w if w > 0 else p[0] / -w for p, w in zip(pool, way, strict=True) if w)
    down = min(p[0] / w if w > 0 else (1 - p[0]) / -w for p, w in zip(pool, way, strict=True) if w)
    by = up if coin * (up + down) < down else -down
    for p, w in zip(pool, way, strict=True):
        p[0] += by * w
        if p[0] < NEAR:
            p[0] = 0.0
        elif p[0] > 1 - NEAR:
            p[0] = 1.0


def _land(left: list[list]) -> None:
    """Decide all of left by the subset nearest to the expected tokens, then documents; the first of equals."""
    subsets = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    chance, size = np.array([p[0] for p in left]), np.array([p[1] for p in left], dtype=np.float64)
    tokens = np.abs(subsets @ size - chance @ size)
    docs = np.abs(subsets.sum(1) - chance.sum())
    best = np.lexsort((docs, np.round(tokens, 6)))[0]
    for p, x in zip(left, subsets[best], strict=True):
        p[0] = float(x)


def flight(units: Iterator[tuple[tuple, float, int, float, tuple]], land: bool) -> Iterator[tuple[tuple, float]]:
    """(row, probability) of every unit (group, probability, size, coin, row); units of a group follow one another.

    A probability of 0 or 1 is decided. Without land, RESERVE + 2 units of a group at
    most are left between, with it none is. So many units are in hand at most.
    """
    pool: list[list] = []
    waiting: deque[tuple[list, float]] = deque()
    group = None

    def rest() -> Iterator[tuple[tuple, float]]:
        left = pool + [unit for unit, _ in waiting]
        if land and left:
            _land(left)
        yield from ((p[2], p[0]) for p in left)
        pool.clear()
        waiting.clear()

    for key, probability, size, coin, row in units:
        if key != group:
            yield from rest()
            group = key
        if not 0.0 < probability < 1.0:
            yield row, probability
            continue
        waiting.append(([probability, size, row], coin))
        if len(waiting) > RESERVE:
            unit, coin = waiting.popleft()
            pool.append(unit)
            if len(pool) == 3:
                _step(pool, coin)
                yield from ((p[2], p[0]) for p in pool if not 0.0 < p[0] < 1.0)
                pool[:] = [p for p in pool if 0.0 < p[0] < 1.0]
    yield from rest()


def _fly(rows: DataFrame, keys: list[str], salt: int, land: bool) -> DataFrame:
    """rows with probability moved by a flight in each group of keys, in the order of a hash."""
    names = rows.columns
    hashed = lambda k: F.pmod(F.xxhash64("id", "size", F.lit(salt), F.lit(k)), F.lit(1 << 53))
    at = [names.index(k) for k in keys]
    where, size = names.index("probability"), names.index("size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def units() -> Iterator[tuple[tuple, float, int, float, tuple]]:
            nonlocal schema
            for batch in batches:
                schema = schema or pa.schema(list(batch.schema)[:-1])
                for *row, toss in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    yield tuple(row[k] for k in at), row[where], row[size], toss, row

        out: list[list] = []
        for row, probability in flight(units(), land):
            row[where] = probability
            out.append(row)
            if len(out) == OUT_ROWS:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    order = [*keys, hashed(0), "id", "size"]
    return rows.repartition(*keys).sortWithinPartitions(*order).withColumn("coin", hashed(1) / float(1 << 53)).mapInArrow(run, rows.schema)


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    most: float = 3.0,
    share: float = 1.0,
    seed: int = 1,
    text_col: str = "text",
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken.

    size counts the words of the text (null and empty: 0), copies says how often the
    mix repeats the document (0 to `most`, rounded up), taken is copies times size.
    Null is a source of its own, the last. A source without words has the target 0 and
    gives nothing. Rows that repeat id and size are documents of their own; they share
    a block. Other columns are ignored.
    No documents give no rows.
    """
    ship(docs.sparkSession)
    source = F.col(f"`{source_col}`").cast("string")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), source.isNotNull().alias("named"), F.coalesce(source, F.lit("")).alias("name"), n_words(F.col(f"`{text_col}`")).alias("size")
    )
    rows = keep(rows, "mix-sizes")
    sizes = keep(rows.groupBy("named", "name").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size")), "mix-totals")
    total = sizes.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    held = targets(sizes.withColumn("source", F.when(F.col("named"), F.col("name"))), weights, most, share)
    copies = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    held = held.withColumn("copies", copies).withColumn("whole", F.floor(F.col("copies") + NEAR))
    fraction = F.col("copies") - F.col("whole")
    held = held.withColumn("probability", F.when(fraction > NEAR, fraction).otherwise(0.0)).drop("copies")
    expected = spread_join(rows, held, ["named", "name"], "n_docs", hot_limit(total))
    block = F.pmod(F.xxhash64("id", "size", F.lit(seed)), F.ceil(F.col("n_docs") / BLOCK_ROWS))
    expected = expected.select("id", "source", "source_no", block.alias("block"), "size", "source_size", "target", "whole", "probability")
    fixed = expected.where("probability = 0")
    flown = keep(_fly(expected.where("probability > 0"), ["source_no", "block"], 2 * seed, land=False), "mix-flown")
    undecided = F.col("probability").between(NEAR, 1 - NEAR)
    landed = _fly(flown.where(undecided), ["source_no"], 2 * seed + 1, land=True)
    out = fixed.unionByName(flown.where(~undecided)).unionByName(landed)
    copies = (F.col("whole") + F.round("probability")).cast("int")
    return out.select("id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
