"""Small fixtures and brute-force versions."""

from __future__ import annotations

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("__spans", T.StringType()), T.StructField("id", T.StringType())])


def table(spark, texts, start=0):
    """Documents with two columns whose names clash with those that operators use."""
    rows = [(start + k, t, "en" if k % 2 else "fr", "clash", "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \n\t ", "one", "a b c d", "x" * 5000, "é" * 300 + " ünï", "same text here for all", "same text here for all", "\x1c odd blank"]


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def near_copies(base, changes, seed):
    r, out = random.Random(seed), list(base)
    for _ in range(changes):
        out[r.randrange(len(out))] = f"new{r.randrange(10**6)}"
    return out


def shingle_set(text, size=5):
    w = (text or "").encode().lower().split()
    k = min(size, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def components(texts, percent=80):
    sets = [shingle_set(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label
