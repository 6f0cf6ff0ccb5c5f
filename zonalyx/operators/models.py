"""Regressions whose every step is one aggregate over the rows: penalty paths and boosted trees.

What tasks give back is of the size of the model (sums by pairs of features, histograms
by node, feature and bin), never of the table. All penalties of a path share each pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalyx.operators.ship import ship
from zonalyx.operators.store import discard, keep

# -- penalty paths --------------------------------------------------------------------------------


@dataclass
class Path:
    """Models of one family for several penalties; weights and intercepts are of the features as given."""

    family: str
    features: list[str]
    alphas: list[float]
    intercepts: list[float]
    weights: list[list[float]]
    #: Mean loss on the validation rows: squared error, or Poisson deviance.
    losses: list[float]

    @property
    def best(self) -> int:
        """The penalty with the least validation loss, of equal ones the first."""
        return min(range(len(self.alphas)), key=lambda k: (self.losses[k], k))

    def predict(self, k: int | None = None) -> Column:
        k = self.best if k is None else k
        eta = reduce(lambda s, fw: s + F.col(fw[0]).cast("double") * fw[1], zip(self.features, self.weights[k], strict=True), F.lit(self.intercepts[k]))
        return F.exp(eta) if self.family == "poisson" else eta


def _rows(df: DataFrame, features: list[str], label: str, split: str) -> DataFrame:
    """Features, label and split of the rows where all numbers are finite, as x0, x1, ..., y, part."""
    columns = [F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(features)]
    rows = df.select(*columns, F.col(label).cast("double").alias("y"), F.col(split).cast("string").alias("part"))
    fine = reduce(Column.__and__, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in rows.columns[:-1]])
    return rows.where(fine)


def ridge_path(df: DataFrame, features: list[str], label: str, alphas: list[float], split: str = "split", train: str = "train", validation: str = "validation") -> Path:
    """Least squares with alpha times the sum of squared weights of standardised features, for all alphas from one pass.

    The pass adds up products of features and label by split. The training rows' give
    one eigendecomposition, from which each alpha is a division; the validation rows'
    give each alpha's error. An alpha of 0 is plain least squares. Rows with a value
    that is not finite are left out. A feature without spread has the weight 0.
    """
    p = len(features)
    names = [f"x{k}" for k in range(p)] + ["y"]
    sums = [F.sum(n).alias(n) for n in names] + [F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    got = {r.part: r for r in _rows(df, features, label, split).where(F.col("part").isin(train, validation)).groupBy("part").agg(F.count(F.lit(1)).alias("n"), *sums).collect()}
    if train not in got:
        raise ValueError("no training rows")

    def moments(r) -> tuple[int, np.ndarray, np.ndarray]:
        m = np.array([r[n] for n in names])
        c = np.array([[r[f"{names[min(i, j)]}_{names[max(i, j)]}"] for j in range(p + 1)] for i in range(p + 1)])
        return r.n, m, c

    n, total, cross = moments(got[train])
    mean = total / n
    centred = cross - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(centred)[:p], 0) / n)
    scale = np.where(scale > 1e-12 * np.maximum(np.abs(mean[:p]), 1e-300), scale, np.inf)
    values, vectors = np.linalg.eigh(centred[:p, :p] / np.outer(scale, scale))
    toward = vectors.T @ (centred[:p, p] / scale)
    out = Path("ridge", list(features), [float(a) for a in alphas], [], [], [])
    for alpha in out.alphas:
        below = values + alpha
        ok = below > 1e-10 * max(values.max(initial=0.0), 1e-300)
        w = vectors @ np.where(ok, toward / np.where(ok, below, 1.0), 0.0) / scale
        b = float(mean[p] - w @ mean[:p])
        out.weights.append([float(v) for v in w])
        out.intercepts.append(b)
        if validation in got:
            m, sums_v, cross_v = moments(got[validation])
            full = np.append(-w, 1.0)
            error = full @ cross_v @ full - 2 * b * (full @ sums_v) + m * b * b
            out.losses.append(float(error / m))
        else:
            out.losses.append(float("nan"))
    return out


def poisson_path(
    df: DataFrame,
    features: list[str],
    label: str,
    alphas: list[float],
    split: str = "split",
    train: str = "train",
    validation: str = "validation",
    steps: int = 50,
    tolerance: float = 1e-10,
) -> Path:
    """Poisson regression with a log link: mean half deviance plus alpha / 2 times the squared weights of standardised features.

    Newton's method for all alphas at once; a step is one pass in which tasks add up
    gradient, curvature and loss of each. A step that raises the loss is halved.
    Negative labels are an error. Rows with a value that is not finite are left out.
    """
    ship(df.sparkSession)
    rows = keep(_rows(df, features, label, split).where(F.col("part").isin(train, validation)), "poisson-rows")
    p, n_alpha = len(features), len(alphas)
    names = [f"x{k}" for k in range(p)]
    stats = rows.where(F.col("part") == train).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"), F.min("y").alias("low"), *[F.avg(c).alias(f"m{c}") for c in names], *[F.stddev_pop(c).alias(f"s{c}") for c in names]).first()
    if not stats.n:
        raise ValueError("no training rows")
    if stats.low < 0:
        raise ValueError("negative counts")
    mean = np.array([stats[f"m{c}"] for c in names])
    scale = np.array([stats[f"s{c}"] if stats[f"s{c}"] > 1e-12 * max(abs(stats[f"m{c}"]), 1e-300) else np.inf for c in names])

    def one_pass(beta: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per alpha: gradient, curvature and half deviance of training rows, deviance and number of validation rows."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((n_alpha, (p + 1) * (p + 2) + 3))
            for batch in batches:
                x = np.stack([np.ones(batch.num_rows), *[(batch.column(k).to_numpy(zero_copy_only=False) - mean[k]) / scale[k] for k in range(p)]], 1)
                y, fit = batch.column(p).to_numpy(zero_copy_only=False), np.array(batch.column(p + 1).to_pylist()) == train
                for a in range(n_alpha):
                    eta = np.clip(x @ beta[a], -700, 700)
                    mu = np.exp(eta)
                    loss = mu - y + np.where(y > 0, y * (np.log(np.where(y > 0, y, 1.0)) - eta), 0.0)
                    t = x[fit]
                    g, h = t.T @ (mu[fit] - y[fit]), (t * mu[fit, None]).T @ t
                    out[a] += np.concatenate([g, h.ravel(), [loss[fit].sum(), 2 * loss[~fit].sum(), (~fit).sum()]])
            at = np.arange(out.size)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out.ravel())], ["at", "v"])

        sums = np.zeros(n_alpha * ((p + 1) * (p + 2) + 3))
        for r in rows.mapInArrow(add, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
            sums[r["at"]] = r.v
        s = sums.reshape(n_alpha, -1)
        k = (p + 1) * (p + 2)
        return s[:, : p + 1], s[:, p + 1 : k].reshape(n_alpha, p + 1, p + 1), s[:, k], s[:, k + 1], s[:, k + 2]

    penalty = np.array(alphas, float)
    beta = np.zeros((n_alpha, p + 1))
    beta[:, 0] = np.log(max(stats.y, 1e-300))
    size, move, settled, best = np.ones(n_alpha), np.zeros_like(beta), np.zeros(n_alpha, bool), np.full(n_alpha, np.inf)
    losses = np.zeros(n_alpha)
    for _ in range(steps):
        g, h, loss, held, m = one_pass(beta)
        goal = loss / stats.n + penalty / 2 * (beta[:, 1:] ** 2).sum(1)
        losses = np.where(m > 0, held / np.maximum(m, 1), np.nan)
        for a in range(n_alpha):
            if settled[a]:
                continue
            if goal[a] > best[a] + 1e-12 * abs(best[a]) and size[a] > 1e-6:
                beta[a] -= move[a] * size[a] / 2
                size[a] /= 2
                continue
            best[a], size[a] = goal[a], 1.0
            full = np.diag(np.append(0.0, np.full(p, penalty[a])))
            slope = g[a] / stats.n + full @ beta[a]
            curve = h[a] / stats.n + full + 1e-12 * np.eye(p + 1)
            move[a] = -np.linalg.solve(curve, slope)
            if np.abs(move[a]).max() <= tolerance:
                settled[a] = True
                continue
            beta[a] += move[a]
        if settled.all():
            break
    discard(rows)
    weights = beta[:, 1:] / scale
    return Path("poisson", list(features), [float(a) for a in alphas], [float(b) for b in beta[:, 0] - weights @ mean], weights.tolist(), losses.tolist())


# -- boosted trees --------------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes in the order they were made; a leaf has feature -1. A row goes left if its value is at most cut, or missing."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for column, v in ((self.feature, -1), (self.bin, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, value), (self.gain, 0.0)):
            column.append(v)
        return len(self.value) - 1

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row of bins ends in."""
        at = np.zeros(len(bins), np.int64)
        feature, cut, left, right = (np.array(c) for c in (self.feature, self.bin, self.left, self.right))
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                return at
            f = np.where(inner, feature[at], 0)
            down = bins[np.arange(len(bins)), f] <= cut[at]
            at = np.where(inner, np.where(down, left[at], right[at]), at)

    def column(self, features: list[str], node: int = 0) -> Column:
        if self.feature[node] < 0:
            return F.lit(self.value[node])
        x = F.col(features[self.feature[node]]).cast("double")
        goes_left = x.isNull() | F.isnan(x) | (x <= self.cut[node])
        return F.when(goes_left, self.column(features, self.left[node])).otherwise(self.column(features, self.right[node]))


@dataclass
class Boosted:
    loss: str
    features: list[str]
    base: float
    trees: list[Tree]
    #: Mean validation loss before the first tree and after each.
    losses: list[float]

    def raw(self) -> Column:
        return reduce(lambda s, t: s + t.column(self.features), self.trees, F.lit(self.base))

    def predict(self) -> Column:
        return F.exp(self.raw()) if self.loss == "poisson" else self.raw()


def boost(
    df: DataFrame,
    features: list[str],
    label: str,
    loss: str = "poisson",
    trees: int = 50,
    depth: int = 3,
    bins: int = 64,
    rate: float = 0.1,
    l2: float = 0.0,
    min_rows: int = 20,
    patience: int = 5,
    split: str = "split",
    train: str = "train",
    validation: str = "validation",
    every: int = 8,
) -> Boosted:
    """Trees by gradient histograms, for counts (Poisson loss, log link) or squared loss.

    Features are cut at values near the quantiles of the training rows, from one sketch
    each; missing values go to the first bin. A level of a tree is one pass in which tasks add up gradient,
    curvature and rows by node, feature and bin. A split has the largest gain
    (G_l^2 / (H_l + l2) + G_r^2 / (H_r + l2) - G^2 / (H + l2)) / 2, of equal ones that
    with the first feature and lowest cut. Boosting ends when the validation loss has
    not fallen for patience trees, and the trees after the best are dropped; without
    validation rows all stay. Scores are written every `every` trees, so a pass
    evaluates few. Rows without a finite label are left out; negative counts are an error.
    """
    ship(df.sparkSession)
    y = F.col(label).cast("double")
    fine = y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf"))
    known = df.where(fine & F.col(split).isin(train, validation))
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    number = lambda f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))
    marks = known.where(F.col(split) == train).agg(*[F.percentile_approx(number(f), shares, F.lit(10_000)).alias(f"c{k}") for k, f in enumerate(features)]).first()
    cuts = [sorted(set(marks[k] or [])) for k in range(len(features))]
    held = lambda f, c: F.when(F.col(f).isNull() | F.isnan(F.col(f).cast("double")), 0).otherwise(reduce(lambda s, v: s + (F.col(f) > v).cast("int"), c, F.lit(0))).cast("int")
    binned = [held(f, c).alias(f"b{k}") for k, (f, c) in enumerate(zip(features, cuts, strict=True))]
    table = keep(known.select(*binned, y.alias("y"), (F.col(split) == train).alias("fit"), F.lit(0.0).alias("score")), "boost")
    s = table.where("fit").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"), F.min("y").alias("low")).first()
    if not s.n:
        raise ValueError("no training rows")
    if loss == "poisson" and (s.low < 0 or s.y <= 0):
        raise ValueError("a Poisson loss needs counts that are not negative, and some above 0")
    base = float(np.log(s.y)) if loss == "poisson" else float(s.y)
    p, width = len(features), max(map(len, cuts), default=0) + 1
    made, losses, fresh = [], [], []

    def scores(batch: pa.RecordBatch, new: list[Tree]) -> tuple[np.ndarray, np.ndarray]:
        b = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(p)], 1)
        f = batch.column(p + 2).to_numpy(zero_copy_only=False) + base
        for t in new:
            f = f + np.array(t.value)[t.nodes(b)]
        return b, f

    def histograms(tree: Tree, open_: list[int], new: list[Tree], with_loss: bool) -> tuple[np.ndarray, float | None]:
        """(open nodes, features, bins, 3) sums of gradient, curvature and rows; the mean validation loss if asked for."""
        place = np.full(len(tree.value), -1)
        place[open_] = np.arange(len(open_))
        cells = len(open_) * p * width

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((3, cells + 1))
            for batch in batches:
                b, f = scores(batch, new)
                y_, fit = batch.column(p).to_numpy(zero_copy_only=False), batch.column(p + 1).to_numpy(zero_copy_only=False)
                mu = np.exp(np.clip(f, -700, 700)) if loss == "poisson" else f
                if with_loss:
                    off = mu[~fit] - y_[~fit] + np.where(y_[~fit] > 0, y_[~fit] * (np.log(np.where(y_[~fit] > 0, y_[~fit], 1.0)) - f[~fit]), 0.0) if loss == "poisson" else (mu[~fit] - y_[~fit]) ** 2
                    out[0, cells] += off.sum()
                    out[2, cells] += len(off)
                at = place[tree.nodes(b)]
                use = fit & (at >= 0)
                g, h = (mu - y_)[use], (mu if loss == "poisson" else np.ones_like(mu))[use]
                for k in range(p):
                    cell = (at[use] * p + k) * width + b[use, k]
                    for row, w in enumerate((g, h, None)):
                        out[row, :cells] += np.bincount(cell, w, cells)
            full = np.flatnonzero(out[2])
            yield pa.RecordBatch.from_arrays([pa.array(full), *[pa.array(out[k, full]) for k in range(3)]], ["at", "g", "h", "n"])

        got = table.mapInArrow(add, "at long, g double, h double, n double").groupBy("at").agg(*[F.sum(c).alias(c) for c in "ghn"]).collect()
        sums, mean_loss = np.zeros((cells, 3)), None
        for r in got:
            if r["at"] == cells:
                mean_loss = r.g / r.n
            else:
                sums[r["at"]] = (r.g, r.h, r.n)
        return sums.reshape(len(open_), p, width, 3), mean_loss

    def leaf(total: np.ndarray) -> float:
        return float(-rate * total[0] / max(total[1] + l2, 1e-12))

    def halves(sums: np.ndarray, limit: int) -> tuple | None:
        """The best split of a node: gain, feature, bin, sums left, sums right."""
        best = None
        for k in range(p):
            left = np.cumsum(sums[k], 0)[: len(cuts[k])]
            right = sums[k].sum(0) - left
            part = lambda z: z[..., 0] ** 2 / np.maximum(z[..., 1] + l2, 1e-12)
            gain = (part(left) + part(right) - part(sums[k].sum(0))) / 2
            gain = np.where((left[:, 2] >= limit) & (right[:, 2] >= limit), gain, -np.inf)
            if len(gain):
                at = int(np.argmax(np.round(gain, 9)))
                if gain[at] > 1e-9 and (best is None or round(float(gain[at]), 9) > round(best[0], 9)):
                    best = (float(gain[at]), k, at, left[at], right[at])
        return best

    for number in range(trees + 1):
        tree = Tree()
        tree.add(0.0)
        open_, first = [0], True
        for _ in range(depth if number < trees else 1):
            sums, seen = histograms(tree, open_, fresh, first)
            if first:
                losses.append(float("nan") if seen is None else seen)
                first = False
                if number == trees:
                    break
            nxt = []
            for node, h in zip(open_, sums, strict=True):
                got = halves(h, min_rows)
                if got is None:
                    if node == 0:
                        tree.value[0] = leaf(h[0].sum(0)) if p else 0.0
                    continue
                gain, k, at, low, high = got
                tree.feature[node], tree.bin[node], tree.cut[node], tree.gain[node] = k, at, cuts[k][at], gain
                tree.left[node], tree.right[node] = tree.add(leaf(low)), tree.add(leaf(high))
                nxt += [tree.left[node], tree.right[node]]
            open_ = nxt
            if not open_:
                break
        best = int(np.nanargmin(losses)) if not np.isnan(losses).all() else len(losses) - 1
        if number == trees or len(losses) - 1 - best >= patience:
            break
        made.append(tree)
        fresh.append(tree)
        if len(fresh) >= every:
            done = list(fresh)

            def put(batches: Iterator[pa.RecordBatch], done: list[Tree] = done) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores(batch, done)[1] - base)], batch.schema.names)

            table, old = keep(table.mapInArrow(put, table.schema), "boost"), table
            discard(old)
            fresh.clear()
    if not np.isnan(losses).all():
        made, losses = made[: int(np.nanargmin(losses))], losses
    discard(table)
    return Boosted(loss, list(features), base, made, losses)
