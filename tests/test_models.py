"""Penalty paths, boosted trees and gamma functions against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonalyx.functions import special
from zonalyx.operators import metrics as me
from zonalyx.operators import models as mo


def counts(n=900, seed=0):
    r = np.random.default_rng(seed)
    x = np.column_stack([r.normal(50, 10, n), r.uniform(-1, 1, n), r.integers(0, 5, n)])
    y = r.poisson(np.exp(0.02 * x[:, 0] + 0.8 * x[:, 1] + 0.3 * (x[:, 2] > 2)))
    return x, y, np.where(np.arange(n) % 3 == 0, "validation", "train")


def frame(spark, x, y, part):
    rows = [(*map(float, a), float(b), str(c)) for a, b, c in zip(x, y, part, strict=True)]
    rows += [(None, 1.0, 1.0, 1.0, "train"), (float("nan"), 1.0, 1.0, 1.0, "train"), (1.0, 1.0, 1.0, None, "train"), (1.0, 1.0, 1.0, 99.0, "test")]
    return spark.createDataFrame(rows, "a double, b double, c double, y double, split string").repartition(4)


def test_ridge_path(spark):
    x, y, part = counts()
    m = mo.ridge_path(frame(spark, x, y, part), ["a", "b", "c"], "y", [0.0, 5.0, 500.0])
    t, v = part == "train", part == "validation"
    z = (x[t] - x[t].mean(0)) / x[t].std(0)
    for k, alpha in enumerate(m.alphas):
        w = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ (y[t] - y[t].mean())) / x[t].std(0)
        b = y[t].mean() - w @ x[t].mean(0)
        assert m.weights[k] == pytest.approx(list(w), rel=1e-8) and m.intercepts[k] == pytest.approx(b, rel=1e-8)
        assert m.losses[k] == pytest.approx(((y[v] - b - x[v] @ w) ** 2).mean(), rel=1e-8)
    flat = mo.ridge_path(frame(spark, np.column_stack([x[:, 0], x[:, 0] * 2, np.ones(len(x))]), y, part), ["a", "b", "c"], "y", [0.0])
    assert flat.weights[0][2] == 0 and math.isfinite(flat.losses[0])


def test_poisson_path(spark):
    x, y, part = counts()
    d = frame(spark, x, y, part)
    m = mo.poisson_path(d, ["a", "b", "c"], "y", [0.0, 0.05, 5.0])
    t, v = part == "train", part == "validation"
    z = np.column_stack([np.ones(t.sum()), (x[t] - x[t].mean(0)) / x[t].std(0)])
    for k, alpha in enumerate(m.alphas):
        b = np.append(math.log(y[t].mean()), np.zeros(3))
        for _ in range(60):
            mu = np.exp(z @ b)
            full = np.diag([0, alpha, alpha, alpha])
            b = b - np.linalg.solve(z.T @ (z * mu[:, None]) / t.sum() + full, z.T @ (mu - y[t]) / t.sum() + full @ b)
        assert m.weights[k] == pytest.approx(list(b[1:] / x[t].std(0)), abs=1e-8)
        eta = m.intercepts[k] + x[v] @ np.array(m.weights[k])
        deviance = 2 * (np.exp(eta) - y[v] + np.where(y[v] > 0, y[v] * (np.log(np.maximum(y[v], 1)) - eta), 0))
        assert m.losses[k] == pytest.approx(deviance.mean(), rel=1e-6)
    assert m.best == int(np.argmin(m.losses))
    got = d.where("split = 'validation'").withColumn("p", m.predict()).agg(F.sum("p")).first()[0]
    assert got == pytest.approx(np.exp(m.intercepts[m.best] + x[v] @ np.array(m.weights[m.best])).sum())
    with pytest.raises(ValueError, match="negative"):
        mo.poisson_path(frame(spark, x, y - 5, part), ["a"], "y", [0.0])


def plain_boost(x, y, cuts, trees, depth, rate, rows):
    """Newton trees on binned features for training rows, level by level."""
    b = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], 1)
    f = np.full(len(y), math.log(y.mean()))
    for _ in range(trees):
        mu = np.exp(f)
        at, add = {0: np.arange(len(y))}, np.zeros(len(y))
        for _ in range(depth):
            nxt = {}
            for own in at.values():
                g, h = (mu - y)[own], mu[own]
                best = None
                for k, c in enumerate(cuts):
                    for j in range(len(c)):
                        low = b[own, k] <= j
                        if low.sum() >= rows and (~low).sum() >= rows:
                            gain = (g[low].sum() ** 2 / h[low].sum() + g[~low].sum() ** 2 / h[~low].sum() - g.sum() ** 2 / h.sum()) / 2
                            if gain > 1e-9 and (best is None or round(gain, 9) > round(best[0], 9)):
                                best = (gain, low)
                if best:
                    for side in (best[1], ~best[1]):
                        add[own[side]] = -rate * g[side].sum() / h[side].sum()
                        nxt[len(nxt)] = own[side]
            at = nxt
        f = f + add
    return np.exp(f)


def test_boosted_trees(spark):
    x, y, part = counts(600, 2)
    d = frame(spark, x, y, part)
    t = part == "train"
    m = mo.boost(d.where("split = 'train'"), ["a", "b", "c"], "y", trees=5, depth=2, bins=16, rate=0.3, min_rows=15, every=2)
    assert len(m.trees) == 5 and math.isnan(m.losses[0])
    # the sketch's cuts, as the trees name them, are values of the training rows (one of which lacks a value)
    cuts = [sorted(d.where("split = 'train' and y is not null").agg(F.percentile_approx(F.when(~F.isnan(c), F.col(c)), F.array(*[F.lit(k / 16) for k in range(1, 16)]), F.lit(10_000))).first()[0]) for c in "abc"]
    cuts = [sorted(set(c)) for c in cuts]
    full = np.vstack([x[t], [[-1e9, 1, 1], [-1e9, 1, 1]]]), np.append(y[t], [1.0, 1.0])
    want = plain_boost(*full, cuts, 5, 2, 0.3, 15)
    got = {(r.a, r.b): r.p for r in d.where("split = 'train' and y is not null").withColumn("p", m.predict()).collect()}
    for k in range(t.sum()):
        assert got[x[t][k][0], x[t][k][1]] == pytest.approx(want[k], rel=1e-6)
    stopped = mo.boost(d, ["a", "b", "c"], "y", trees=40, depth=3, bins=16, rate=0.8, min_rows=5, patience=2)
    assert len(stopped.trees) == int(np.argmin(stopped.losses)) < 40 and min(stopped.losses) < stopped.losses[0]
    squared = mo.boost(d, ["a", "b"], "y", loss="squared", trees=3, depth=1, bins=8)
    assert squared.losses[-1] < squared.losses[0] and squared.base == pytest.approx(np.append(y[t], [1, 1]).mean())
    with pytest.raises(ValueError, match="no training"):
        mo.boost(d.where("false"), ["a"], "y")


def test_gamma_functions_and_dispersion(spark):
    xs = [1e-6, 0.01, 0.5, 1.0, 1.5, 2.0, 7.3, 50.0, 1e4, 1e9]
    d = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in d.select("x", special.lgamma(F.col("x")).alias("l"), special.digamma(F.col("x")).alias("d"), special.trigamma(F.col("x")).alias("t")).collect():
        assert r.l == pytest.approx(math.lgamma(r.x), rel=1e-11, abs=1e-11)
        h = r.x * 1e-4
        assert r.d == pytest.approx((math.lgamma(r.x + h) - math.lgamma(r.x - h)) / (2 * h), rel=1e-5, abs=1e-5)
        assert r.t > 0
    ones = d.where("x = 1").select(special.digamma(F.col("x")), special.trigamma(F.col("x"))).first()
    assert ones[0] == pytest.approx(-0.5772156649015329, abs=1e-12) and ones[1] == pytest.approx(math.pi**2 / 6, rel=1e-11)
    r = np.random.default_rng(1)
    mu = r.uniform(1, 20, 4000)
    y = r.poisson(r.gamma(2.0, mu / 2.0))
    n = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, mu, strict=True)], "y long, mu double")
    alpha = me.fitted_dispersion(n, "y", "mu")
    assert alpha == pytest.approx(0.5, abs=0.06)
    at = lambda a: n.agg(F.sum(me.negative_binomial("y", "mu", a))).first()[0]
    assert at(alpha) > max(at(alpha * 1.02), at(alpha * 0.98))
    assert me.fitted_dispersion(n.withColumn("y", F.round("mu").cast("long")), "y", "mu") == 0.0 and me.fitted_dispersion(n.where("false"), "y", "mu") is None
