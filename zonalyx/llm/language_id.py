"""Language identification.

Features are character n-grams (N_GRAMS) of the lower-cased text, hashed into
N_BUCKETS and weighted by TF-IDF: the share of an n-gram in the text times
log((1 + documents) / (1 + documents with it)) + 1, counted over all labelled
documents. A multinomial logistic regression on them is trained by
follow-the-regularised-leader with an elastic-net penalty on a bounded sample of
MAX_TRAIN labelled documents, and a temperature fitted on a part of the sample
that training did not see calibrates its probabilities.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalyx.llm.arrow import ship, small_batches, utf8, with_text
from zonalyx.llm.store import keep

N_BUCKETS = 1 << 15
N_GRAMS = (1, 2, 3)
#: Documents that the classifier is fitted on, about; dealt equally to the languages.
MAX_TRAIN = 6000
UNKNOWN = "und"

_MIX = np.uint32(0x9E3779B1)
_SHIFT = np.uint32(32 - int(math.log2(N_BUCKETS)))
#: Characters whose n-grams are computed at once; windows at a cut are kept whole.
_CHUNK = 1 << 16


def _codes(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode().lower().encode("utf-32-le", "replace"), np.uint32)


def buckets(text: bytes) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text, one array after another."""
    codes = np.concatenate(([32], _codes(text), [32])).astype(np.uint32)
    for start in range(0, len(codes), _CHUNK):
        part = codes[start : start + _CHUNK + max(N_GRAMS) - 1]
        stop = min(_CHUNK, len(codes) - start)
        rolled = np.zeros(len(part), np.uint32)
        for n in range(1, max(N_GRAMS) + 1):
            size = min(len(part) - n + 1, stop)
            if size <= 0:
                break
            rolled = (rolled[:size] ^ part[n - 1 : n - 1 + size]) * _MIX
            rolled ^= rolled >> np.uint32(15)
            if n in N_GRAMS:
                yield ((rolled * _MIX + np.uint32(n)) * _MIX) >> _SHIFT


def counts(text: bytes) -> np.ndarray:
    out = np.zeros(N_BUCKETS, np.int64)
    for found in buckets(text):
        out += np.bincount(found, minlength=N_BUCKETS)
    return out


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode())


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # N_BUCKETS x languages, by TF-IDF
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, text: bytes) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for found in buckets(text):
            total += self._scaled()[found].sum(0, dtype=np.float64)
            n += len(found)
        return total / max(n, 1) + self.bias

    def _scaled(self) -> np.ndarray:
        if not hasattr(self, "_table"):
            self._table = (self.weights * self.idf[:, None]).astype(np.float32)
        return self._table

    def predict(self, text: bytes) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, documents with it) of a task; bucket -1 counts the documents."""
    seen, n = np.zeros(N_BUCKETS, np.int64), 0
    for batch in batches:
        for text in utf8(batch.column(0)):
            flags = np.zeros(N_BUCKETS, bool)
            for found in buckets(text):
                flags[found] = True
            seen += flags
            n += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1], at))), pa.array(np.concatenate(([n], seen[at])))], names=["bucket", "n"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, n = [], []
        for text in utf8(batch.column(0)):
            c = counts(text)
            found = np.flatnonzero(c)
            at.append(found)
            n.append(c[found])
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), batch.column(2), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))],
            names=["lang", "order", "at", "n"],
        )


def fit_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], n_classes: int, *, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4, epochs: int = 4) -> tuple[
    np.ndarray,
    np.ndarray,
]:
    """FTRL-proximal over (class, buckets, TF-IDF values); elastic net by l1 and l2. Weights (buckets x classes) and bias."""
    z, n = np.zeros((N_BUCKETS + 1, n_classes)), np.zeros((N_BUCKETS + 1, n_classes))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            y, at, x = rows[k]
            at, x = np.append(at, N_BUCKETS), np.append(x, 1.0)
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at] = zi + g - sigma * w
            n[at] = ni + g * g
    w = weights(z, n)
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """Golden-section search for the temperature of least log loss, between 1/4 and 20."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        s = logits / math.exp(log_t)
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(labels)), labels]))

    low, high, ratio = -math.log(4), math.log(20), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return math.exp((low + high) / 2)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN) -> Model:
    """Fit on rows with a text and a label; the others are left out.

    IDF covers all of them. The classifier sees about max_train distinct texts: each
    language's share is the same, and its texts are those with the smallest hash
    (all of them, if they are fewer); copies count once. A table has few languages:
    a number for each comes to the driver. No labelled rows: a model that answers
    "und".
    """
    ship(labelled.sparkSession)
    rows = labelled.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("text is not null and lang is not null")
    # a row per bucket and task, summed by bucket: at most N_BUCKETS + 1 rows come back
    seen = {
        r.bucket: r.n for r in rows.select("text").mapInArrow(_document_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    }
    n_docs = seen.pop(-1, 0)
    df = np.zeros(N_BUCKETS)
    df[list(seen)] = list(seen.values())
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    sizes = {r.lang: max(1, r.n) for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], idf, np.zeros((N_BUCKETS, 0)), np.zeros(0))
    share = max(1, max_train // len(languages))
    order = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    bound = F.element_at(
        F.create_map(*[F.lit(v) for lang in languages for v in (lang, min(1 << 30, math.ceil((1 << 30) * share / sizes[lang])))]),
        F.col("lang"),
    )
    sample = rows.withColumn("order", order).where(F.col("order") < bound)
    sample = sample.groupBy("lang", "order", F.xxhash64("text").alias("h")).agg(F.any_value("text").alias("text"))
    got = sample.select("text", "lang", "order").mapInArrow(_features, "lang string, order long, at array<int>, n array<int>")
    table = keep(got, "language-sample").toArrow().sort_by([("order", "ascending")])
    number = {lang: k for k, lang in enumerate(languages)}
    y = np.array([number[lang] for lang in table.column("lang").to_pylist()], np.int64)
    # flat arrays and views of them: a few large blocks of the driver's memory, which are given back
    sizes = np.asarray(pc.list_value_length(table.column("at")).combine_chunks())
    ends = np.cumsum(sizes)
    at = np.asarray(pc.list_flatten(table.column("at")).combine_chunks())
    x = np.asarray(pc.list_flatten(table.column("n")).combine_chunks()).astype(np.float64)
    del table
    row = np.repeat(np.arange(len(y)), sizes)
    x *= idf[at]
    x /= np.maximum(1, np.bincount(row, x / idf[at], len(y)))[row]
    # shares are small numbers: the learning rate is set for inputs scaled to length 1
    length = np.maximum(1e-12, np.sqrt(np.bincount(row, x * x, len(y))))
    x /= length[row]
    del row
    docs = [(int(k), at[end - n : end], x[end - n : end]) for k, n, end in zip(y, sizes, ends, strict=True)]
    out = np.arange(0, len(docs), 5) if len(docs) >= 20 else np.zeros(0, int)
    fitted = np.setdiff1d(np.arange(len(docs)), out)
    scale = float(np.mean(1 / length[fitted]))
    w, bias = fit_ftrl([docs[k] for k in fitted], len(languages))
    w = w * scale
    logits = np.array([length[k] * (docs[k][2] @ w[docs[k][1]]) + bias for k in out]).reshape(len(out), len(languages))
    temperature = fit_temperature(logits, y[out])
    del docs, at, x
    pa.default_memory_pool().release_unused()
    return Model(languages, idf, w, bias, temperature)


#: What predict adds.
MADE = ("__lang", "__score")


def predict(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns carry of docs (all, where not given) with __lang and __score: "und" and 0 for null, empty and letterless texts.

    Every row is answered, repeated ones too; whole texts count, however long. A
    column of docs with one of the two names is replaced.
    """
    from pyspark.sql import types as T

    shared = ship(docs.sparkSession).sparkContext.broadcast(model)
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in MADE]
    given, names, at_text = with_text(docs, carry, text_col)
    schema = T.StructType([*given.schema.fields[: len(carry)], T.StructField("m0", T.StringType()), T.StructField("m1", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, at_text):
            said = [shared.value.predict(t) for t in utf8(batch.column(at_text))]
            made = [pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *made], names=[*names, "m0", "m1"])

    return given.mapInArrow(run, schema).toDF(*carry, *MADE)


def keep_languages(docs: DataFrame, model: Model, min_score: float, text_col: str = "text") -> DataFrame:
    """docs without those of an unknown language or one less probable than min_score; columns as in docs, whatever their names."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    said = predict(docs.toDF(*names), model, names[docs.columns.index(text_col)])
    return said.where((F.col("__lang") != UNKNOWN) & (F.col("__score") >= min_score)).select(*names).toDF(*docs.columns)


def training_rows(docs: DataFrame, id_col: str = "doc_id", folds: int = 5) -> DataFrame:
    """The rows that may be learned from: those whose crc32 of the id as text is no multiple of folds."""
    return docs.where(~held_out(id_col, folds))


def remainder(id_col: str, folds: int):
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def held_out(id_col: str = "doc_id", folds: int = 5):
    return remainder(id_col, folds) == 0
