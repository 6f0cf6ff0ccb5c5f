"""Benchmark decontamination.

Words are runs of digits, letters A to Z in lower case, and anything outside
ASCII. Every run of WINDOW words of a benchmark item is a window; an item of
fewer words is one window. The windows' hashes are broadcast, each document's
word windows are looked up, and a hit counts only once its words are verified to
be those of the window. Hit words form spans, which are removed, or the whole
document is.

The benchmark is taken in blocks whose index has INDEX_BYTES at most, so what is
broadcast is bounded however large it grows. With one block, documents pass once and
nothing is written. With more, they are written once with a number for each row, and
each block's pass keeps the rows that it hits, without their texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalyx.llm.arrow import ship, small_batches, utf8, with_text
from zonalyx.llm.store import keep

WINDOW = 10
#: Memory of one broadcast index, about.
INDEX_BYTES = 48 << 20
#: What a word of an item, and a new word of the vocabulary besides its letters, take there.
_PLACE_COST, _WORD_COST = 24, 110
#: Hit rows of several blocks that may be broadcast to their documents.
BROADCAST_ROWS = 500_000

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_FILTER_BITS = 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class _Vocabulary(dict):
    """Words of the benchmark by number from 1; other words are 0 and are not kept."""

    def __missing__(self, word: bytes) -> int:
        return 0


def _hash_windows(ids: np.ndarray, width: int) -> np.ndarray:
    n = len(ids) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n <= 0:
        return out
    for k in range(width):
        out = (out + ids[k : k + n].astype(np.uint64)) * _MULTIPLIER
        out ^= out >> np.uint64(29)
    return out


@dataclass
class _Windows:
    """The distinct windows of one width in the order of their hashes: where the words of each are, and its items."""

    width: int
    hashes: np.ndarray
    starts: np.ndarray
    item_at: np.ndarray
    items: np.ndarray
    seen: np.ndarray

    @staticmethod
    def of(words: np.ndarray, starts: np.ndarray, items: np.ndarray, width: int) -> _Windows:
        """From the first places of all windows in words, and the item of each."""
        hashes = _hash_windows(words, width)[starts]
        order = np.lexsort((items, hashes))
        hashes, starts, items = hashes[order], starts[order], items[order]
        same = hashes[1:] == hashes[:-1]
        for k in range(width):
            same &= words[starts[1:] + k] == words[starts[:-1] + k]
        new = np.concatenate(([True], ~same))
        listed = new | np.concatenate(([True], items[1:] != items[:-1]))
        item_at = np.append(np.cumsum(listed)[new] - 1, listed.sum())
        seen = np.zeros(1 << _FILTER_BITS, bool)
        seen[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        return _Windows(width, hashes[new], starts[new].astype(np.int32), item_at.astype(np.int32), items[listed].astype(np.int32), seen)


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, number) of every number in the ranges low .. high - 1."""
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


class Index:
    """What is broadcast: the vocabulary, the words and the windows of a block of items."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.vocabulary = _Vocabulary()
        self.names: list[str] = []
        self.words = np.zeros(0, np.int32)
        self.windows: list[_Windows] = []
        self.bytes = 0
        self._found: list[tuple[int, np.ndarray]] = []
        self._numbers: dict[str, int] = {}

    def add(self, item_id: str, text: bytes) -> None:
        words, known = words_of(text), len(self.vocabulary)
        if not words:
            return
        number = self.vocabulary.setdefault
        ids = np.fromiter((number(w, len(self.vocabulary) + 1) for w in words), np.int32, len(words))
        self._found.append((self._numbers.setdefault(item_id, len(self._numbers)), ids))
        self.bytes += _PLACE_COST * len(ids) + len(item_id) + _WORD_COST * (len(self.vocabulary) - known)

    def finish(self) -> Index:
        self.names = list(self._numbers)
        if self._found:
            self.words = np.concatenate([ids for _, ids in self._found])
            sizes = np.array([len(ids) for _, ids in self._found])
            items = np.repeat(np.array([k for k, _ in self._found]), sizes)
            widths = np.repeat(np.minimum(sizes, self.window), sizes)
            last = np.repeat(np.cumsum(sizes), sizes) - widths
            first = np.flatnonzero(np.arange(len(self.words)) <= last)
            for width in np.unique(widths).tolist():
                starts = first[widths[first] == width]
                self.windows.append(_Windows.of(self.words, starts, items[starts], width))
        self._found, self._numbers = [], {}
        return self

    def scan(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of concatenated documents (ends: where each ends): the hit words, and each (document, item) found."""
        hit = np.zeros(len(ids) + 1, np.int64)
        found = [np.zeros((0, 2), np.int64)]
        for w in self.windows:
            hashes = _hash_windows(ids, w.width)
            at = np.flatnonzero(w.seen[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            low = np.searchsorted(w.hashes, hashes[at], "left")
            high = np.searchsorted(w.hashes, hashes[at], "right")
            doc = np.searchsorted(ends, at, "right")
            inside = np.flatnonzero(at + w.width <= np.append(ends, 0)[doc])
            which, entry = _expand(low[inside], high[inside])
            at, doc = at[inside][which], doc[inside][which]
            same = np.ones(len(at), bool)
            for k in range(w.width):
                same &= ids[at + k] == self.words[w.starts[entry] + k]
            at, doc, entry = at[same], doc[same], entry[same]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + w.width, -1)
            met = np.unique(np.stack([doc, entry], 1), axis=0)
            which, place = _expand(w.item_at[met[:, 1]], w.item_at[met[:, 1] + 1])
            found.append(np.stack([met[which, 0], w.items[place]], 1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return np.cumsum(hit[:-1]) > 0, pairs[:, 0], pairs[:, 1]


def _spans(hit: np.ndarray) -> list[int]:
    """Flat list: start and end (excluded) of each run of hit words."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return edge.tolist()


def _scanner(shared, names: list[str], carry: int, at_text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        get = index.vocabulary.__getitem__
        for batch in small_batches(batches, at_text):
            todo = []
            for text in utf8(batch.column(at_text)):
                words = words_of(text)
                todo.append(np.fromiter(map(get, words), np.int32, len(words)))
            ends = np.cumsum([len(x) for x in todo])
            hit, docs, found = index.scan(np.concatenate(todo), ends)
            items: list[list[str]] = [[] for _ in todo]
            for d, i in zip(docs.tolist(), found.tolist(), strict=True):
                items[d].append(index.names[i])
            spans = [_spans(hit[end - len(x) : end]) if i else [] for x, end, i in zip(todo, ends.tolist(), items, strict=True)]
            made = [
                pa.array([len(x) for x in todo], pa.int64()),
                pa.array(spans, pa.list_(pa.int32())),
                pa.array([sorted(i) for i in items], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:carry], *made], names=[*names, "m0", "m1", "m2"])

    return run


def _merge(a: list[int], b: list[int]) -> list[int]:
    out: list[int] = []
    for start, end in sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = []
        for several in batch.column(1).to_pylist():
            one: list[int] = []
            for more in several:
                one = _merge(one, more)
            spans.append(one)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.int32())), batch.column(2)], names=["u", "s", "i"])


def _blocks(benchmark: DataFrame, text_col: str, id_col: str, window: int, index_bytes: int) -> Iterator[Index]:
    """The items, read partition by partition, as indices of bounded size; an empty one if there are none."""
    rows = benchmark.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    index, some = Index(window), False
    for r in rows.toLocalIterator():
        index.add(r.i, r.t.encode())
        if index.bytes >= index_bytes:
            yield index.finish()
            index, some = Index(window), True
    if index.bytes or not some:
        yield index.finish()


#: What scan adds.
MADE = ("__n_words", "__spans", "__items")


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    *,
    item_text: str = "text",
    item_id: str = "item_id",
    window: int = WINDOW,
    index_bytes: int = INDEX_BYTES,
    carry: list[str] | None = None,
) -> DataFrame:
    """The columns carry of docs (all, where not given) with __n_words, __spans (word numbers: start, end, ...) and __items (sorted ids).

    Null and empty texts have no words, hence no spans. An item without words has
    no window. Items that share an id count as one. An empty benchmark hits nothing.
    Repeated rows stay. A column of docs with one of the three names is replaced.
    """
    ship(docs.sparkSession)
    blocks = _blocks(benchmark, item_text, item_id, window, index_bytes)
    index, second = next(blocks), next(blocks, None)
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in MADE]
    if second is None:
        return _pass(docs, index, text_col, carry)
    names = [f"__c{k}" for k in range(len(docs.columns))]
    name = dict(zip(docs.columns, names, strict=True))
    text = name[text_col]
    base = keep(docs.toDF(*names).withColumn("__uid", F.monotonically_increasing_id()), "decontaminate")
    hits = None
    while index is not None:
        got = _pass(base.select("__uid", text), index, text, ["__uid"])
        hit = keep(got.where(F.size("__spans") > 0).select("__uid", "__spans", "__items"), "decontaminate-hits")
        hits = hit if hits is None else hits.unionByName(hit)
        index, second = second, next(blocks, None)
    several = hits.groupBy("__uid").agg(F.collect_list("__spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))))
    merged = keep(several.mapInArrow(_merged, "u long, s array<int>, i array<string>"), "decontaminate-hits")
    small = merged.count() <= BROADCAST_ROWS
    counted = _pass(base, Index(window), text, ["__uid", *(name[c] for c in carry)]).drop("__spans", "__items")
    out = counted.join(F.broadcast(merged) if small else merged, F.col("__uid") == F.col("u"), "left")
    made = [F.col("__n_words"), *(F.coalesce(x, F.array().cast(t)) for x, t in (("s", "array<int>"), ("i", "array<string>")))]
    return out.select(*[F.col(name[c]) for c in carry], *made).toDF(*carry, *MADE)


def _pass(docs: DataFrame, index: Index, text_col: str, carry: list[str]) -> DataFrame:
    from pyspark.sql import types as T

    given, names, at_text = with_text(docs, carry, text_col)
    kinds = (T.LongType(), T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType()))
    schema = T.StructType([*given.schema.fields[: len(carry)], *(T.StructField(f"m{k}", t) for k, t in enumerate(kinds))])
    shared = docs.sparkSession.sparkContext.broadcast(index)
    return given.mapInArrow(_scanner(shared, names, len(carry), at_text), schema).toDF(*carry, *MADE)


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, hit_spans; cases as in scan.

    Columns other than the two named are not read, whatever their names.
    """
    got = scan(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), benchmark, "text", carry=["id"], **options)
    signed = F.transform("__spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("long"))
    hit = F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)
    return got.select(
        F.col("id").alias(id_col),
        F.col("__n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("__items"), ","), 256).alias("items_sha256"),
        (F.size("__spans") > 0).alias("contaminated"),
        F.col("__spans").alias("hit_spans"),
    )


def _cut(text: str, spans: list[int]) -> str:
    """text without the words of the spans; what stood between hit words goes with them."""
    at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    out, last = [], 0
    for start, end in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[last : at[start][0]])
        last = at[end - 1][1]
    return "".join([*out, text[last:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", *, mode: str = "documents", **options) -> DataFrame:
    """docs without contaminated documents, or (mode "spans") without their hit spans; columns as in docs."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]
    got = scan(docs.toDF(*names), benchmark, text, **options)
    if mode == "documents":
        return got.where(F.size("__spans") == 0).select(*names).toDF(*docs.columns)
    if mode != "spans":
        raise ValueError(f"unknown mode {mode!r}")

    def cut(batches):
        for batch in batches:
            k = batch.schema.names.index(text)
            texts = [t if not s else _cut(t, s) for t, s in zip(batch.column(k).to_pylist(), batch.column(batch.schema.names.index("__spans")).to_pylist(), strict=True)]
            columns = [pa.array(texts, batch.column(k).type) if i == k else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return got.mapInArrow(cut, got.select(*names).schema).toDF(*docs.columns)
