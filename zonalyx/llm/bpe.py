"""Byte-level BPE encoding and decoding by two-tier lookup.

Text is cut by a pattern into pre-tokens. A minimal perfect hash over the
vocabulary resolves a pre-token that is itself a token with one probe; any other
one is merged by a heap of (rank, place) over bytes in a doubly linked list, in
O(n log n) for a pre-token of n bytes. Results are remembered per worker in two
generations of CACHE_BYTES each, which change no result: when the younger is full,
it replaces the older, and what is used again moves up.
"""

from __future__ import annotations

import base64
import heapq
import re
import struct
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalyx.llm.arrow import ship, small_batches, utf8, with_text

#: Memory of one generation of remembered pre-tokens, about: an entry's strings and _ENTRY_COST.
CACHE_BYTES, _ENTRY_COST = 24 << 20, 200
#: Longer pre-tokens are not remembered.
CACHE_KEY_CHARS = 64
_KEYS_PER_BUCKET = 4
_STEP = 0x9E3779B1
_LITTLE = [struct.Struct(f"<{n}I").pack for n in range(16)]
_NATIVE_LITTLE = sys.byteorder == "little"

#: Code points that newer Unicode versions made letters and numbers,
#: and that the encoders to be matched still treat as unassigned.
LATER_LETTERS = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 "
    "A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 "
    "187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 "
    "1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
LATER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"


class PerfectHash:
    """Minimal perfect hash by displacement: n keys onto 0 .. n - 1.

    Keys are dealt into buckets; the largest buckets first, each takes the first
    displacement that puts its keys into free places. A bucket of one key names a
    free place itself, as a negative number.
    """

    def __init__(self, keys: list[bytes]) -> None:
        self.n = max(1, len(keys))
        self.buckets = self.n // _KEYS_PER_BUCKET + 1
        self.shift = [0] * self.buckets
        groups: list[list[tuple[int, int]]] = [[] for _ in range(self.buckets)]
        for key in keys:
            a, b, c = self._parts(key)
            groups[a].append((b, c))
        taken = bytearray(self.n)
        for bucket in sorted(range(self.buckets), key=lambda k: -len(groups[k])):
            group, d = groups[bucket], 0
            if len(group) < 2:
                break
            while True:
                places = [((b ^ d * _STEP) * c >> 7) % self.n for b, c in group]
                if len(set(places)) == len(places) and not any(taken[p] for p in places):
                    break
                d += 1
            self.shift[bucket] = d
            for p in places:
                taken[p] = 1
        free = (p for p in range(self.n) if not taken[p])
        for bucket, group in enumerate(groups):
            if len(group) == 1:
                self.shift[bucket] = -1 - next(free)

    def _parts(self, key: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh3_64_intdigest(key)
        return h % self.buckets, h >> 16, (h & 0xFFFFFF) | 1

    def place(self, key: bytes) -> int:
        a, b, c = self._parts(key)
        d = self.shift[a]
        if d < 0:
            return -1 - d
        return ((b ^ d * _STEP) * c >> 7) % self.n


class Vocabulary:
    """Tokens by rank, the perfect hash over them and the ranks in the hash's order."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.hash = PerfectHash(list(ranks))
        self.keys: list[bytes] = [b""] * self.hash.n
        self.ranks = [-1] * self.hash.n
        for key, rank in ranks.items():
            p = self.hash.place(key)
            self.keys[p], self.ranks[p] = key, rank
        self.pairs = {key: rank for key, rank in ranks.items() if len(key) > 1}
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for key, rank in ranks.items():
            self.tokens[rank] = key
        self.bytes = [ranks.get(bytes([b]), -1) for b in range(256)]

    def rank(self, key: bytes) -> int:
        """The key's rank, -1 if it is no token."""
        p = self.hash.place(key)
        return self.ranks[p] if self.keys[p] == key else -1

    def merge(self, word: bytes) -> list[int]:
        """Ranks of a word that is no token: the lowest rank merges first, of equal ones the leftmost.

        A part is known by its first byte's place; ends, ranks and links are kept
        there. A heap entry is out of date if its part is gone or its end is not
        the end of the part after it.
        """
        n, pairs = len(word), self.pairs
        get = pairs.get
        ends = list(range(1, n + 1))
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        ranks = [self.bytes[b] for b in word]
        heap = []
        for i in range(n - 1):
            r = get(word[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            r, i, stop = pop(heap)
            j = right[i]
            if ends[i] < 0 or j >= n or ends[j] != stop:
                continue
            k = right[j]
            ends[i], ends[j], right[i], ranks[i] = stop, -1, k, r
            if k < n:
                left[k] = i
                r = get(word[i : ends[k]])
                if r is not None:
                    push(heap, (r, i, ends[k]))
            h = left[i]
            if h >= 0:
                r = get(word[h:stop])
                if r is not None:
                    push(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            if ranks[i] < 0:
                raise ValueError(f"the vocabulary lacks the byte {word[i : ends[i]]!r}")
            out.append(ranks[i])
            i = right[i]
        return out


def _set(ranges: str) -> str:
    """Hexadecimal ranges as the inside of a character class."""
    return "".join("-".join(f"\\U{int(x, 16):08X}" for x in part.split("-")) for part in ranges.split())


class Encoder(dict):
    """Pre-token to its ids as little-endian 32-bit integers, remembered."""

    def __init__(self, vocabulary: Vocabulary, pattern: str) -> None:
        import regex

        super().__init__()
        self.vocabulary = vocabulary
        self.older: dict[str, bytes] = {}
        self.held = 0
        letters, numbers = _set(LATER_LETTERS), _set(LATER_NUMBERS)
        self.later = re.compile(f"[{letters}{numbers}]").search
        self.plain = regex.compile(pattern).findall
        older = pattern.replace(r"\p{L}", rf"[\p{{L}}--[{letters}]]").replace(r"\p{N}", rf"[\p{{N}}--[{numbers}]]")
        self.strict = regex.compile(older, regex.V1).findall

    def find(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")  # fast, and none of the later code points is there
        except UnicodeEncodeError:
            if self.later(text):
                return self.strict(text)
        return self.plain(text)

    def __missing__(self, piece: str) -> bytes:
        out = self.older.pop(piece, None)
        if out is None:
            word = piece.encode()
            rank = self.vocabulary.rank(word)
            ids = (rank,) if rank >= 0 else self.vocabulary.merge(word)
            out = _LITTLE[len(ids)](*ids) if len(ids) < len(_LITTLE) else struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHE_KEY_CHARS:
            if self.held >= CACHE_BYTES:
                self.older = dict(self)
                self.clear()
                self.held = 0
            self[piece] = out
            self.held += len(piece) + len(out) + _ENTRY_COST
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, memoryview(ids).cast("I") if _NATIVE_LITTLE else np.frombuffer(ids, "<u4").tolist()))


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token and its rank in each line. Read where the driver runs, else through Spark."""
    try:
        with open(path, "rb") as f:
            lines = f.read().split(b"\n")
    except OSError:
        lines = [r.value.encode() for r in spark.read.text(path).collect()]
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


#: What tokenise adds.
MADE = ("__ids", "__decoded_sha256", "__ids_sha256")


def tokenise(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns carry of docs (all, where not given) with __ids (binary: little-endian unsigned 32-bit), __decoded_sha256 and __ids_sha256.

    Each match of the pattern is encoded on its own, without special tokens, and
    what is decoded from the ids is digested. Null and empty texts have no ids. Text
    of any length stays whole, repeated rows stay. A column of docs with one of the
    three names is replaced.
    """
    import hashlib

    from pyspark.sql import types as T

    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(Vocabulary(read_ranks(spark, ranks_path)))
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in MADE]
    given, names, at_text = with_text(docs, carry, text_col)
    fields = [*given.schema.fields[: len(carry)], *(T.StructField(f"m{k}", t) for k, t in enumerate((T.BinaryType(), T.StringType(), T.StringType())))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        for batch in small_batches(batches, at_text):
            ids = [encoder.encode(t.decode()) for t in utf8(batch.column(at_text))]
            back = [hashlib.sha256(encoder.decode(x)).hexdigest() for x in ids]
            made = [pa.array(ids, pa.binary()), pa.array(back, pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *made], names=[*names, "m0", "m1", "m2"])

    return given.mapInArrow(run, T.StructType(fields)).toDF(*carry, *MADE)


def token_digests(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256; cases as in tokenise, other columns are not read."""
    got = tokenise(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), ranks_path, pattern, "text", carry=["id"])
    return got.select(F.col("id").alias(id_col), n_tokens(), F.col("__ids_sha256").alias("ids_sha256"), F.col("__decoded_sha256").alias("decoded_sha256"))


def n_tokens() -> Column:
    return (F.octet_length("__ids") / 4).cast("long").alias("n_tokens")
