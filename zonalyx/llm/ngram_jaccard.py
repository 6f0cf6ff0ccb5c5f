"""N-gram Jaccard join by rare-first prefix filtering.

A document's set are its distinct word SHINGLE-grams, as 64-bit hashes. Documents
with one and the same set are one class; classes are joined:

1. Frequencies. Every shingle of every class is dealt to the block of its hash,
   packed many to a row, and counted there exactly. Shingles of one class only are
   dropped at once: they come first in every set, so their number is all that is
   needed. A count sketch of fixed size finds shingles that a good part of all
   documents may have; those are dealt by class instead, have their cell's count,
   and so come last. Rarest first, then by hash, is one order for everybody.
2. Prefixes. With T percent, two linked sets x, y share at least
   T (|x| + |y|) / (100 + T) shingles, so they share one within their rarest
   |x| - ceil(T |x| / 100) + 1; the shorter set needs even fewer. Those prefix
   n-grams are what the join is on.
3. Filters, in the join's condition: length, the position of the common prefix
   shingle, and the suffix filter: the hash range is cut at fixed pivots, and the
   sizes of both sets' parts bound how much they can have in common.
4. Verification, once per pair, on the whole sets.

Large groups: before all pairs are looked at, each class is compared with one
partner: of the classes that it shares a prefix shingle with, one whose own prefix
shingles have the most classes in all, which is the one least changed of a group of
copies. That is repeated while it joins something, STAR_ROUNDS times at most. Then
only pairs that no chain of links joins yet are candidates, each with at least one
side outside the largest component of its shingle; a group of near copies costs
about as many pairs as it has members, and no link between different components is
left out.

Shuffled tokens have 32 bits more than there are blocks of ENTRIES shingles. Two
shingles of one token only make a candidate more: a prefix is never shortened by it.
"""
from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonalyx.llm.arrow import ship, small_batches, utf8
from zonalyx.llm.components import components
from zonalyx.llm.store import discard, keep, release

SHINGLE = 5
PERCENT = 80
STAR_ROUNDS = 4
SKETCH_BITS = 21
#: Shingles of one block, about; a block is counted in memory.
ENTRIES = 1 << 21
#: Shuffle partitions that blocks are dealt over, at most; a task takes its blocks one by one.
MAX_PARTITIONS = 20_000
#: Parts of the hash range for the suffix filter.
PIVOTS = 16
#: Document rows that may be broadcast to find the texts of candidates; beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000
#: A shingle that more than 1/HOT_SHARE of the documents have is dealt over parts, HOT_PARTS at most.
HOT_SHARE, MIN_HOT, HOT_PARTS = 2000, 1000, 64

_BLOCK = 4096
#: Bytes of words with their hashes, and classes, that a worker remembers.
_CACHE_BYTES, _WORD_COST, _SEEN = 16 << 20, 120, 100_000
#: Shingles and sets that a task packs at once; a set's number in a pack is a short.
_PACK, _PACK_SETS = 3 << 19, 32_000
_BATCH = 100_000
_FACTORS = np.array(
    [
        0x9E3779B97F4A7C15,
        0xC2B2AE3D27D4EB4F,
        0x165667B19E3779F9,
        0xD6E8FEB86659FD93,
        0xA0761D6478BD642F,
        0xE7037ED1A0B428DB,
        0x8EBC6AF09C88C6E3,
        0x589965CC75374CC3,
    ],
    np.uint64,
)


class _WordHashes(dict):
    """Hashes of words, remembered up to _CACHE_BYTES."""

    held = 0

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        self.held += len(word) + _WORD_COST
        if self.held > _CACHE_BYTES:
            self.clear()
            self.held = 0
        elif len(word) < 64:
            self[word] = h
        return h


class _Seen(set):
    """Classes that a task has met, the last ones."""

    def new(self, cls: int) -> bool:
        if cls in self:
            return False
        if len(self) >= _SEEN:
            self.clear()
        self.add(cls)
        return True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, hashes: _WordHashes, size: int = SHINGLE) -> np.ndarray:
    """The set, as sorted 64-bit hashes; a text of fewer words is one shingle, one without words has none."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    width = min(n, size)
    total = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        total = (total ^ (total >> np.uint64(29))) * _FACTORS[7] + h[k : n - width + 1 + k] * _FACTORS[k % 7]
    return np.unique(_mix(total))


def class_of(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def prefix_lengths(n: int | np.ndarray, percent: int) -> tuple:
    """(against shorter or longer sets, against longer ones only)."""
    return n - (percent * n + 99) // 100 + 1, n - (2 * percent * n + 99 + percent) // (100 + percent) + 1


def needed(x: Column, y: Column, percent: int) -> Column:
    return F.ceil((x + y) * percent / F.lit(float(100 + percent)) - 1e-9)


# -- sketch ------------------------------------------------------------------------------------


def _first_pass(size: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, sketch = _WordHashes(), _Seen(), np.zeros(1 << SKETCH_BITS, np.uint32)
        names = ["doc_id", "th", "n", "cls", "parts", "block", "blob"]
        types = [kind, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.binary()]
        todo, held = [], 0
        for batch in small_batches(batches, 1):
            n, cls, parts = [], [], []
            for text in utf8(batch.column(1)):
                found = shingles(text, hashes, size)
                n.append(len(found))
                cls.append(class_of(found) if len(found) else None)
                parts.append(np.bincount((found >> np.uint64(60)).astype(np.int64), minlength=PIVOTS).astype(np.int32))
                if len(found) and seen.new(cls[-1]):
                    todo.append(found)
                    held += len(found)
                if held > 1 << 20:
                    sketch += _sketched(todo)
                    todo, held = [], 0
            empty = [pa.nulls(len(n), t) for t in types[5:]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(kind), batch.column(2), pa.array(n, types[2]), pa.array(cls, types[3]), pa.array(parts, types[4]), *empty],
                names=names,
            )
        sketch += _sketched(todo)
        used = [b for b in range(len(sketch) // _BLOCK) if sketch[b * _BLOCK : (b + 1) * _BLOCK].any()]
        blobs = [zlib.compress(sketch[b * _BLOCK : (b + 1) * _BLOCK].tobytes(), 1) for b in used]
        empty = [pa.nulls(len(used), t) for t in types[:5]]
        yield pa.RecordBatch.from_arrays([*empty, pa.array(used, types[5]), pa.array(blobs, types[6])], names=names)

    return run


def _sketched(found: list[np.ndarray]) -> np.ndarray:
    at = (np.concatenate(found) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64) if found else np.zeros(0, np.int64)
    return np.bincount(at, minlength=1 << SKETCH_BITS).astype(np.uint32)


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(blob), np.uint32).astype(np.uint64)
            sums[block] = np.minimum(sums[block] + part, 0xFFFFFFFF) if block in sums else part
    blobs = [zlib.compress(s.astype(np.uint32).tobytes(), 1) for s in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(blobs, pa.binary())], names=["block", "blob"])


def _sketch(first: DataFrame) -> np.ndarray:
    """The summed sketch: 2 ** SKETCH_BITS counts, whatever the input."""
    blocks = first.where("block is not null").select("block", "blob")
    salted = blocks.repartition("block", F.pmod(F.xxhash64("blob"), F.lit(16)))
    summed = salted.mapInArrow(_sum_blocks, "block int, blob binary").repartition("block").mapInArrow(_sum_blocks, "block int, blob binary")
    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    for r in summed.collect():
        out[r.block * _BLOCK : (r.block + 1) * _BLOCK] = np.frombuffer(zlib.decompress(r.blob), np.uint32)
    return out


# -- frequencies and prefixes --------------------------------------------------------------------


def _packs(shared, size: int, bits: int, hot_parts: int):
    """Rows of many shingles each: to (block, or 2 ** bits + part of a hot one), their tokens, and whose they are."""

    def packed(sets: list[np.ndarray], names: list[int], level: np.ndarray) -> pa.RecordBatch:
        cls, n = np.array(names, np.int64), np.array([len(x) for x in sets])
        h, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        token = h >> np.uint64(32 - bits)
        again = np.concatenate(([False], (token[1:] == token[:-1]) & (who[1:] == who[:-1])))
        token, who, h = token[~again], who[~again], h[~again]
        n_tokens = np.bincount(who, minlength=len(sets))
        hot = level[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] > 0
        to = np.where(hot, (1 << bits) + cls[who] % hot_parts, (token >> np.uint64(32)).astype(np.int64))
        order = np.argsort(to.astype(np.uint16) if (1 << bits) + hot_parts < 1 << 16 else to, kind="stable")
        to, who, token, hot = to[order], who[order], token[order], hot[order]
        first = np.concatenate(([True], to[1:] != to[:-1]))
        start = np.append(np.flatnonzero(first), len(to))
        # within a row sets come in order, so a set's first token there gives its place in the row's list of sets
        new = first | np.concatenate(([True], who[1:] != who[:-1]))
        place = np.cumsum(new) - 1
        listed = who[new]
        cold = int(np.searchsorted(hot, True))
        per_row = lambda values, at, kind: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, kind))
        sets_at = np.append(place[start[:-1]], len(listed))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(to[start[:-1]].astype(np.int32)),
                per_row((token[:cold] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), np.minimum(start, cold), pa.int32()),
                per_row(token[cold:].astype(np.int64), np.maximum(start, cold) - cold, pa.int64()),
                per_row((place - np.repeat(place[start[:-1]], np.diff(start))).astype(np.int16), start, pa.int16()),
                per_row(cls[listed], sets_at, pa.int64()),
                per_row(n[listed].astype(np.int32), sets_at, pa.int32()),
                per_row(n_tokens[listed].astype(np.int32), sets_at, pa.int32()),
            ],
            names=["to", "low", "wide", "who", "cls", "n", "n_tokens"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _WordHashes(), _Seen()
        sets, names, held = [], [], 0
        for batch in small_batches(batches, 0):
            for text in utf8(batch.column(0)):
                found = shingles(text, hashes, size)
                if not len(found) or not seen.new(cls := class_of(found)):
                    continue
                sets.append(found)
                names.append(cls)
                held += len(found)
                if held >= _PACK or len(sets) >= _PACK_SETS:
                    yield packed(sets, names, shared.value)
                    sets, names, held = [], [], 0
        if sets:
            yield packed(sets, names, shared.value)

    return run


def _counted(shared, bits: int):
    """(sh, cls, n, n_tokens, key) of shingles that several classes have, key their number; of hot ones all, key their cell's count."""

    def taken(to: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        hot = to >= 1 << bits
        token = np.concatenate([r[1] if hot else r[0].view(np.uint32) for r in rows]).astype(np.int64)
        sizes = np.cumsum([0, *(len(r[3]) for r in rows)])
        at = np.concatenate([r[2].astype(np.int32) + s for r, s in zip(rows, sizes, strict=False)])
        cls, n, n_tokens = (np.concatenate([r[k] for r in rows]) for k in (3, 4, 5))
        if not hot:
            order = np.argsort(token, kind="stable")
            ordered = token[order]
            same = ordered[1:] == ordered[:-1]
            order = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
            token, at = token[order], at[order]
        order = np.lexsort((cls[at], token))
        token, at = token[order], at[order]
        other = np.concatenate(([True], (token[1:] != token[:-1]) | (cls[at][1:] != cls[at][:-1])))[: len(token)]
        token, at = token[other], at[other]
        if hot:
            key = shared.value[token >> (32 + bits - SKETCH_BITS)].astype(np.int64)
        else:
            start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))[: len(token)])
            runs = np.diff(np.append(start, len(token)))
            key = np.repeat(runs, runs)
            token, at, key = token[key > 1] + (to << 32), at[key > 1], key[key > 1]
        for k in range(0, len(token), _BATCH):
            p = slice(k, k + _BATCH)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (token[p], cls[at[p]], n[at[p]], n_tokens[at[p]], key[p])],
                names=["sh", "cls", "n", "n_tokens", "key"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                to = row[0].as_py()
                if rows and to != last:
                    yield from taken(last, rows)
                    rows = []
                last = to
                rows.append(tuple(np.array(x.values) for x in row[1:]))
        if rows:
            yield from taken(last, rows)

    return run


def _prefixes(docs: DataFrame, counts: np.ndarray, total: int, documents: int, size: int, percent: int) -> DataFrame:
    """(sh, cls, n, pos, of, part): the prefix of each class without shingles that no other class has; a hot shingle is dealt over parts 1 to `of`."""
    bits = max(0, math.ceil(math.log2(max(1, total / ENTRIES))))
    limit = max(MIN_HOT, documents // HOT_SHARE, 4 * total >> SKETCH_BITS)
    level = np.where(counts >= limit, counts, np.uint32(0))
    hot_parts = int(level.sum(dtype=np.int64)) // ENTRIES + 1
    shared = docs.sparkSession.sparkContext.broadcast(level)
    packs = docs.select("text").mapInArrow(
        _packs(shared, size, bits, hot_parts),
        "to int, low array<int>, wide array<long>, who array<short>, cls array<long>, n array<int>, n_tokens array<int>",
    )
    partitions = min(MAX_PARTITIONS, (1 << bits) + hot_parts)
    dealt = packs.repartitionById(partitions, F.col("to") % partitions).sortWithinPartitions("to")
    found = dealt.mapInArrow(_counted(shared, bits), "sh long, cls long, n int, n_tokens int, key long")
    back = F.row_number().over(Window.partitionBy("cls").orderBy(F.col("key").desc(), F.col("sh").desc()))
    prefix = found.withColumn("pos", F.col("n_tokens") - back).where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * percent / F.lit(100.0) - 1e-9))
    # as many parts as keep a part of a hot shingle about as large as the largest shingle that is not hot
    hot = F.when(F.col("key") >= limit, F.least(F.lit(HOT_PARTS), F.floor(F.col("key") / limit) + 1).cast("int")).otherwise(0)
    part = F.when(F.col("of") > 0, F.pmod(F.col("cls"), F.col("of")).cast("int") + 1).otherwise(0)
    return prefix.withColumn("of", hot).select("sh", "cls", "n", "pos", "of", part.alias("part"))


def _live(entries: DataFrame) -> DataFrame:
    """Entries whose shingle more than one class has in its prefix; of a hot shingle all."""
    group = Window.partitionBy("sh", "part")
    marked = entries.withColumn("__k", F.count(F.lit(1)).over(group))
    return marked.where("part > 0 or __k > 1").drop("__k")


def _by_part(rows: DataFrame, of_shingle: DataFrame) -> DataFrame:
    """A row per shingle as a row per shingle and part, so that hot shingles stay dealt over their parts."""
    return rows.select("sh", "part").distinct().join(of_shingle, "sh")


def _with_degree(live: DataFrame) -> DataFrame:
    """live with deg: how many classes the class's prefix shingles have in all."""
    sizes = live.groupBy("sh").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = live.join(_by_part(live, sizes), ["sh", "part"])
    degree = shared.groupBy("cls").agg(F.sum("m").alias("deg"))
    return shared.drop("m").join(degree, "cls")


# -- candidates and verification ---------------------------------------------------------------


def _labelled(live: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return live.withColumn("comp", F.col("cls"))
    return live.join(labels.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")


def _lengths_fit(x: str, y: str, percent: int) -> Column:
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _untried(pairs: DataFrame, tried: DataFrame | None) -> DataFrame:
    if tried is None:
        return pairs
    return pairs.join(tried, (F.least("a", "b") == tried.x) & (F.greatest("a", "b") == tried.y), "left_anti")


def _star_pairs(rows: DataFrame, tried: DataFrame | None, percent: int) -> DataFrame:
    """(a, b): each class with the partner from another component that it shares most prefix shingles with as their centre."""
    centre = rows.groupBy("sh").agg(
        F.max(F.struct("deg", "comp", "cls", "n")).alias("c"),
        F.min("comp").alias("lo"),
        F.max("comp").alias("hi"),
    ).where("lo != hi")
    pairs = rows.join(_by_part(rows, centre), ["sh", "part"]).where((F.col("comp") != F.col("c.comp")) & _lengths_fit("n", "c.n", percent))
    pairs = pairs.groupBy(F.col("cls").alias("b"), F.col("c.cls").alias("a")).agg(F.count(F.lit(1)).alias("k"))
    best = _untried(pairs, tried).groupBy("b").agg(F.max(F.struct("k", "a")).alias("m"))
    return best.select(F.least(F.col("m.a"), "b").alias("a"), F.greatest(F.col("m.a"), "b").alias("b")).distinct()


def _open_pairs(rows: DataFrame, tried: DataFrame | None, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b) from different components that meet in a prefix shingle and pass the filters.

    One of the two is outside the shingle's largest component; only those rows are
    sent to all parts of a hot shingle.
    """
    sizes = rows.groupBy("sh", "comp").agg(F.count(F.lit(1)).alias("m"))
    mixed = sizes.groupBy("sh").agg(F.max(F.struct("m", "comp"))["comp"].alias("top"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    index = F.col("n") - F.ceil(F.col("n") * 2 * percent / F.lit(float(100 + percent)) - 1e-9) + 1
    marked = rows.join(_by_part(rows, mixed), ["sh", "part"]).select(
        "sh",
        "part",
        "of",
        "cls",
        "n",
        "pos",
        "comp",
        (F.col("comp") != F.col("top")).alias("minor"),
        (F.col("pos") < index).alias("short"),
    )
    marked = keep(marked.join(classes.select("cls", "parts"), "cls"), "jaccard-open")
    x = marked.where("minor").withColumn("part", F.explode(F.sequence(F.least(F.col("of"), F.lit(1)), F.col("of"))))
    x = x.select("sh", "part", *(F.col(c).alias(f"a_{c}") for c in ("cls", "n", "pos", "comp", "short", "parts")))
    y = marked.select("sh", "part", *(F.col(c).alias(f"b_{c}") for c in ("cls", "n", "pos", "comp", "short", "parts", "minor")))
    an, bn, ai, bi = F.col("a_n"), F.col("b_n"), F.col("a_pos"), F.col("b_pos")
    enough = needed(an, bn, percent)
    fits = (F.col("a_comp") != F.col("b_comp")) & (~F.col("b_minor") | (F.col("a_cls") < F.col("b_cls"))) & _lengths_fit("a_n", "b_n", percent)
    fits &= F.when((an < bn) | ((an == bn) & (F.col("a_cls") < F.col("b_cls"))), F.col("a_short")).otherwise(F.col("b_short"))
    # at a pair's first common shingle nothing before it is common, so what they share is no more than what is left of either
    fits &= F.least(an - ai, bn - bi) >= enough
    fits &= _suffix_bound("a_parts", "b_parts") >= enough
    met = x.join(y, (x.sh == y.sh) & (x.part == y.part) & fits)
    got = met.select(F.least("a_cls", "b_cls").alias("a"), F.greatest("a_cls", "b_cls").alias("b")).distinct()
    return _untried(got, tried)


def _suffix_bound(p: str, q: str) -> Column:
    """The most that two sets can have in common, by the sizes of their parts between the pivots."""
    return sum((F.least(F.col(p)[k], F.col(q)[k]) for k in range(1, PIVOTS)), F.least(F.col(p)[0], F.col(q)[0]))


def _with_bound(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """pairs with ok: whether lengths and the parts between the pivots let them have enough in common."""
    side = lambda k: classes.select(F.col("cls").alias(k), F.col("n").alias(f"{k}n"), F.col("parts").alias(f"{k}p"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", (_lengths_fit("an", "bn", percent) & (_suffix_bound("ap", "bp") >= needed(F.col("an"), F.col("bn"), percent))).alias("ok"))


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _WordHashes(), _Seen()
        for batch in small_batches(batches, 0):
            cls, blobs = [], []
            for text, wanted in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                if seen.new(wanted):
                    cls.append(wanted)
                    blobs.append(shingles(text, hashes, size).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(blobs, pa.binary())], names=["cls", "blob"])

    return run


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep_rows = []
            for p, q in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (p, q))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep_rows.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep_rows, pa.bool_()))

    return run


def _verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs that link, by their whole sets; written to the shared folder."""
    wanted = pairs.select("a").union(pairs.select("b")).distinct().toDF("cls").join(classes.select("cls", "rep"), "cls")
    wanted = keep(wanted.select("cls", F.col("rep.doc_id").alias("rep_id"), F.col("rep.th").alias("rep_th")), "jaccard-wanted")
    small = wanted.count() <= BROADCAST_ROWS
    texts = docs.join(F.broadcast(wanted) if small else wanted, (docs.th == wanted.rep_th) & docs.doc_id.eqNullSafe(wanted.rep_id))
    sets = texts.select("text", "cls").mapInArrow(_sets(size), "cls long, blob binary")
    sets = keep(sets.groupBy("cls").agg(F.any_value("blob").alias("blob")), "jaccard-sets")
    both = pairs.join(sets.toDF("a", "p"), "a").join(sets.toDF("b", "q"), "b").select("a", "b", "p", "q")
    links = keep(both.mapInArrow(_compare(percent), "a long, b long"), "jaccard-links")
    discard(wanted, sets)
    return links


# -- the operator --------------------------------------------------------------------------------


def _components_of(docs: DataFrame, first: DataFrame, size: int, percent: int, star_rounds: int) -> tuple[DataFrame, DataFrame | None]:
    """(cls, rep, copies, n, parts) of every class, and (cls, component) of those that have links, None where none has."""
    spark = docs.sparkSession
    rows = first.where("cls is not null")
    grouped = rows.groupBy("cls").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("rep"),
        F.count(F.lit(1)).alias("copies"),
        F.any_value("n").alias("n"),
        F.any_value("parts").alias("parts"),
    )
    classes = keep(grouped, "jaccard-classes")
    sums = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("copies"), F.lit(0)).alias("documents")).first()
    entries = keep(_prefixes(docs, _sketch(first), sums.n, sums.documents, size, percent), "jaccard-prefixes")
    release(spark)
    live = keep(_with_degree(keep(_live(entries), "jaccard-prefixes")), "jaccard-prefixes")
    links, labels, tried, step = None, None, None, 0
    while True:
        last, now = step >= star_rounds, _labelled(live, labels)
        pairs = _open_pairs(now, tried, classes, percent).withColumn("ok", F.lit(True)) if last else _with_bound(
            _star_pairs(now, tried, percent),
            classes,
            percent,
        )
        pairs = keep(pairs, "jaccard-pairs")
        n_pairs, n_links = pairs.count(), 0
        if n_pairs:
            found = _verify(pairs.where("ok").select("a", "b"), docs, classes, size, percent)
            n_links = found.count()
            met = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"))
            tried = met if tried is None else tried.union(met)
        if n_links:
            links = found if links is None else links.union(found)
            labels = components(links)
        if last:
            return classes, labels.select(F.col("node").alias("cls"), "component") if labels is not None else None
        step = step + 1 if 10 * n_links > n_pairs else star_rounds


def _found(df: DataFrame, text_col: str, id_col: str, size: int, percent: int, star_rounds: int) -> DataFrame:
    """(doc_id, th, n, cls, least): of every row, least being the first (id, hash of text) of its component."""
    from pyspark.sql.pandas.types import to_arrow_type

    release(ship(df.sparkSession))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    kind = docs.schema["doc_id"].dataType
    made = docs.select("doc_id", "text", "th").mapInArrow(
        _first_pass(size, to_arrow_type(kind)),
        f"doc_id {kind.simpleString()}, th long, n long, cls long, parts array<int>, block int, blob binary",
    )
    first = keep(made, "jaccard-docs")
    rows = first.where("block is null").select("doc_id", "th", "n", "cls")
    classes, labels = _components_of(docs, first, size, percent, star_rounds)
    if labels is None:
        named = classes.withColumn("component", F.col("cls"))
    else:
        named = classes.join(labels, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    of_class = keep(named.join(least, "component").select("cls", "copies", "least"), "jaccard-classes")
    # at most HOT_SHARE classes have so many rows; those without words have none to be joined with
    most = of_class.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0] // HOT_SHARE + 1
    hot = F.broadcast(of_class.where(F.col("copies") >= most).drop("copies"))
    said = rows.where("cls is not null")
    rest = said.join(hot.select("cls"), "cls", "left_anti").join(of_class.where(F.col("copies") < most).drop("copies"), "cls")
    none = rows.where("cls is null").withColumn("least", F.lit(None).cast(of_class.schema["least"].dataType))
    return said.join(hot, "cls").unionByName(rest).unionByName(none)


def near_duplicates(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    *,
    size: int = SHINGLE,
    percent: int = PERCENT,
    star_rounds: int = STAR_ROUNDS,
) -> DataFrame:
    """One row per input row: id, n_shingles, class_id (null without words), component_id.

    component_id is the smallest id reachable by links, the row's own included.
    Null, empty and blank texts have no shingles and are linked with nothing, not
    with one another either. Rows that repeat an id are rows of their own; if their
    texts differ, each has its own component. A null id is never the smallest.
    Columns other than the two named are not read, whatever their names.
    """
    got = _found(df, text_col, id_col, size, percent, star_rounds)
    least = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id"))
    return got.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("cls").alias("class_id"), least.alias("component_id"))


def drop_near_duplicates(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    *,
    size: int = SHINGLE,
    percent: int = PERCENT,
    star_rounds: int = STAR_ROUNDS,
) -> DataFrame:
    """df with one row of each component: the smallest id, of equal ids the smallest hash of the text.

    Rows are told apart by id and text, so rows with null or repeated ids are
    decided one by one; of rows that share both, any one stays. Rows without words
    all stay. Columns and their names are those of df.
    """
    got = _found(df, text_col, id_col, size, percent, star_rounds)
    first = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("th") == F.col("least.th"))
    key = [F.col("doc_id").alias("__id"), F.col("th").alias("__th")]
    said = keep(got.where("cls is not null").select(*key, first.alias("stays")).groupBy("__id", "__th", "stays").agg(F.count(F.lit(1)).alias("k")), "near-rows")
    gone, again = said.where(~F.col("stays")).select("__id", "__th"), said.where("stays and k > 1").select("__id", "__th")
    counts = said.agg(F.count_if(~F.col("stays")), F.count_if(F.expr("stays and k > 1"))).first()
    gone, again = (F.broadcast(x) if k <= BROADCAST_ROWS else x for x, k in zip((gone, again), counts, strict=True))
    names = [f"__c{k}" for k in range(len(df.columns))]
    docs = df.toDF(*names)
    name = dict(zip(df.columns, names, strict=True))
    docs = docs.withColumn("__rid", F.col(name[id_col])).withColumn("__rth", F.xxhash64(F.coalesce(F.col(name[text_col]), F.lit(""))))
    same = lambda x: (F.col("__rth") == x["__th"]) & F.col("__rid").eqNullSafe(x["__id"])
    out = docs.join(gone, same(gone), "left_anti")
    if counts[1]:
        one = out.join(again, same(again), "left_semi").dropDuplicates(["__rid", "__rth"])
        out = out.join(again, same(again), "left_anti").unionByName(one)
    return out.select(*names).toDF(*df.columns)
