"""Language-model scores by subword lattice likelihood.

The model is a unigram over the pieces of an existing vocabulary and an end. A
text, its words (white space between them, ASCII letters in lower case) each with
a blank before it, has the probability of all its segmentations into pieces,
times that of the end:

    P(text) = P(end) * product over words w of sum over segmentations s of " w"
              of product over pieces x in s of p(x)

No piece crosses a blank, so a text's lattice falls apart into those of its words:
the forward recursion over the whole text is the sum of those over its words, and
each distinct word's is computed once.

The vocabulary's own scores give the prior weights of the pieces; ROUNDS of
expectation-maximisation over all training words add what the corpus says.

__mixture is another model beside it: each training word is one more edge across
its own lattice, with its share of the training tokens; those edges together have
the weight N / (N + V) of Witten and Bell.

Words that occur often (at most HOT_WORDS of them) are broadcast with their
scores; the occurrences of all others are joined to their scores by word.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalyx.llm.arrow import ship, small_batches, utf8, with_text
from zonalyx.llm.lattice import Pieces, expected_counts, log_probabilities
from zonalyx.llm.store import keep

ROUNDS = 3
#: Words broadcast with their scores; 500,000 take about 15 MB.
HOT_WORDS = 500_000
#: Weight of the vocabulary's own scores, in pieces seen.
PRIOR_PIECES = 5_000.0
#: Added to a piece's place in the vocabulary's order before it becomes a weight 1 / place.
_PLACE = 50.0
_FLUSH_WORDS = 400_000
_BATCH_WORDS = 40_000
#: Stands for the end of a text among words.
END = b""


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def read_vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces (a blank for the mark of a word's start) and their prior probabilities, from a sentencepiece file.

    Scores of such a file are minus a piece's place; its weight is 1 / (place +
    _PLACE). Single bytes, which are its fallback, weigh as the last piece. Pieces
    with a blank anywhere but at their start can't occur and are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weights: dict[bytes, float] = {}
    n = model.get_piece_size()
    for k in range(n):
        if model.is_control(k) or model.is_unknown(k) or model.is_byte(k):
            continue
        piece = model.id_to_piece(k).replace("▁", " ").encode()
        if piece and b" " not in piece[1:] and piece.lower() == piece:
            weights[piece] = weights.get(piece, 0.0) + 1 / (_PLACE - model.get_score(k))
    for b in range(256):
        weights[bytes([b])] = weights.get(bytes([b]), 0.0) + 1 / (_PLACE + n)
    pieces = sorted(weights)
    p = np.array([weights[x] for x in pieces])
    return pieces, p / p.sum()


def count_words(docs: DataFrame) -> DataFrame:
    """word, c (in training texts), n (in all texts), from text and is_train; END counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, rest = Counter(), Counter()

        def out() -> pa.RecordBatch:
            words = list({**train, **rest})
            c = [train.get(w, 0) for w in words]
            n = [x + rest.get(w, 0) for x, w in zip(c, words, strict=True)]
            train.clear()
            rest.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c, pa.int64()), pa.array(n, pa.int64())], names=["word", "c", "n"])

        for batch in batches:
            for text, is_train in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                to = train if is_train else rest
                to.update(words_of(text))
                to[END] += 1
                if len(train) + len(rest) > _FLUSH_WORDS:
                    yield out()
        yield out()

    got = docs.select("text", "is_train").mapInArrow(run, "word binary, c long, n long")
    return keep(got.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "lm-words")


def _expect(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(*shared.value)
        counts = np.zeros(len(pieces.pieces))
        words: list[bytes] = []
        weights: list[int] = []
        for batch in batches:
            words += [b" " + w for w in batch.column(0).to_pylist()]
            weights += batch.column(1).to_pylist()
            if len(words) >= _BATCH_WORDS:
                counts += expected_counts(words, weights, pieces)
                words, weights = [], []
        counts += expected_counts(words, weights, pieces)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["piece", "n"])

    return run


@dataclass
class Model:
    words: DataFrame  # word, c, n
    pieces: list[bytes]
    log_p: np.ndarray
    end: float  # the end's probability, where a word or the end comes
    n_tokens: int  # N
    n_types: int  # V

    @property
    def whole(self) -> float:
        """The weight of the edges that are whole training words."""
        return self.n_tokens / (self.n_tokens + self.n_types) if self.n_tokens else 0.0

    @property
    def base_total(self) -> int:
        return self.n_tokens + self.n_types + 1


def train(docs: DataFrame, is_train: Column, vocabulary: tuple[list[bytes], np.ndarray], text_col: str = "text", rounds: int = ROUNDS) -> Model:
    """Count the words of all texts and fit the pieces' probabilities on those of training texts.

    Null texts count as empty. Without training texts the prior stays as it is.
    """
    spark = ship(docs.sparkSession)
    words = count_words(docs.select(F.col(f"`{text_col}`").alias("text"), F.coalesce(is_train, F.lit(False)).alias("is_train")))
    stats = words.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"),
        F.count_if(F.col("c") > 0).alias("v"),
        F.coalesce(F.sum(F.when(F.col("word") == F.lit(END), F.col("c"))), F.lit(0)).alias("texts"),
    ).first()
    pieces, prior = vocabulary
    p, end = prior, 0.5
    seen = words.where((F.col("c") > 0) & (F.col("word") != F.lit(END))).select("word", "c")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, np.log(p)))
        got = seen.mapInArrow(_expect(shared), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros(len(pieces))
        for r in got:
            counts[r.piece] = r.n
        end = (stats.texts + 1) / (counts.sum() + stats.texts + 2)
        counts += PRIOR_PIECES * prior
        p = counts / counts.sum()
    starts = float(p[[k for k, x in enumerate(pieces) if x[:1] == b" "]].sum()) * (1 - end)
    return Model(words, pieces, np.log(p) + math.log1p(-end), end / (end + starts), stats.n, stats.v)


def word_scores(model: Model) -> DataFrame:
    """word, c, n, log_p, log_mix of every word and of END: natural-log probabilities by the lattice and with whole words."""
    shared = model.words.sparkSession.sparkContext.broadcast((model.pieces, model.log_p))
    log_end, whole, n_tokens = math.log(model.end), model.whole, max(1, model.n_tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(*shared.value)
        for batch in batches:
            words = batch.column(0).to_pylist()
            log_p = log_probabilities([b" " + w if w else b"" for w in words], pieces)
            log_p[[k for k, w in enumerate(words) if not w]] = log_end
            with np.errstate(divide="ignore"):
                edge = np.log(whole * batch.column(1).to_numpy(zero_copy_only=False) / n_tokens)
            mix = np.logaddexp(edge, log_p + math.log1p(-whole))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(log_p), pa.array(mix)], names=["word", "c", "n", "log_p", "log_mix"])

    return keep(model.words.mapInArrow(run, "word binary, c long, n long, log_p double, log_mix double"), "lm-scores")


def hot_limit(scored: DataFrame, hot_words: int) -> int:
    """The smallest count such that at most hot_words words occur that often."""
    rows = scored.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.col("n").desc())
    total, limit = 0, None
    # each row stands for a word at least, so no more than hot_words + 1 rows are read
    for r in rows.toLocalIterator():
        total += r.k
        if limit is None:
            limit = r.n + 1
        if total > hot_words:
            break
        limit = r.n
    return limit or 1


class _Index(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


#: What score adds.
MADE = ("__n_tokens", "__n_known", "__base", "__score", "__mixture")


def score(docs: DataFrame, model: Model, text_col: str = "text", hot_words: int = HOT_WORDS, carry: list[str] | None = None) -> DataFrame:
    """The columns carry of docs (all, where not given) with __n_tokens, __n_known, __base, __score and __mixture.

    __score is the log10 probability of the text by the lattice of pieces, __mixture
    that with whole training words, __base that of add-one counts. Null and empty
    texts are the end alone. Every row is scored, repeated ones too. Words that
    train() was not given are scored as words of no training text. A column of docs
    with one of the five names is replaced; other names may be any.
    """
    from pyspark.sql import types as T

    spark: SparkSession = docs.sparkSession
    scored = word_scores(model)
    limit = hot_limit(scored, hot_words)
    hot = scored.where(F.col("n") >= limit).toArrow()
    words = hot.column("word").to_pylist()
    total, ten = model.base_total, math.log(10)
    c = hot.column("c").to_numpy()
    logs = np.stack([np.log10((c + 1) / total), hot.column("log_p").to_numpy() / ten, hot.column("log_mix").to_numpy() / ten])
    shared = spark.sparkContext.broadcast((words, c > 0, logs))
    carry = [x for x in (docs.columns if carry is None else carry) if x.lower() not in MADE]
    given, names, at_text = with_text(docs, carry, text_col)
    kinds = {
        "m_tokens": T.LongType(),
        "m_known": T.LongType(),
        "m_base": T.DoubleType(),
        "m_score": T.DoubleType(),
        "m_mix": T.DoubleType(),
        "m_rare": T.ArrayType(T.BinaryType()),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known, logs = shared.value
        get = _Index(zip(words, range(len(words)), strict=True)).__getitem__
        for batch in small_batches(batches, at_text):
            out: list[list] = [[] for _ in kinds]
            for text in utf8(batch.column(at_text)):
                found = [*words_of(text), END]
                at = np.fromiter(map(get, found), np.int64, len(found))
                ok = at[at >= 0]
                rare = [found[k] for k in np.flatnonzero(at < 0)]
                for to, value in zip(out, (len(found), int(known[ok].sum()), *logs[:, ok].sum(1).tolist(), rare), strict=True):
                    to.append(value)
            made = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), *[pa.float64()] * 3, pa.list_(pa.binary())), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *made], names=[*names, *kinds])

    schema = T.StructType([*given.schema.fields[: len(carry)], *(T.StructField(k, t) for k, t in kinds.items())])
    part = keep(given.mapInArrow(run, schema).withColumn("uid", F.monotonically_increasing_id()), "lm-docs")
    rest = scored.where(F.col("n") < limit).select("word", "c", "log_p", "log_mix")
    rare = part.select("uid", F.explode("m_rare").alias("word"))
    new = rare.select("word").distinct().join(rest.select("word"), "word", "left_anti")
    new = word_scores(replace(model, words=new.select("word", F.lit(0).cast("long").alias("c"), F.lit(1).cast("long").alias("n"))))
    rare = rare.join(rest.unionByName(new.select("word", "c", "log_p", "log_mix")), "word")
    sums = rare.groupBy("uid").agg(
        F.count_if(F.col("c") > 0).alias("k"),
        F.sum(F.log10((F.col("c") + 1) / F.lit(float(total)))).alias("b"),
        F.sum(F.col("log_p") / ten).alias("s"),
        F.sum(F.col("log_mix") / ten).alias("x"),
    )
    got = part.drop("m_rare").join(sums, "uid", "left")
    add = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return got.select(*names, "m_tokens", add("m_known", "k"), add("m_base", "b"), add("m_score", "s"), add("m_mix", "x")).toDF(*carry, *MADE)
