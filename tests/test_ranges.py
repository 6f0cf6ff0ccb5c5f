"""Ranks, group metrics, quantiles and resampling that no group holds in one task, against plain versions."""

import math
import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonalyx.functions import windows as w
from zonalyx.operators import frames as fr
from zonalyx.operators import metrics as me
from zonalyx.operators import quantiles as qu
from zonalyx.operators import ranges, resample

GROUPS = ("a", "b", "c", None, "e")


@pytest.fixture
def many_ranges(spark, monkeypatch):
    """24 ranges that stay apart, and hot keys from a few rows on."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr(ranges, "MIN_HOT_ROWS", 20)
    monkeypatch.setattr(ranges, "HOT_SHARE", 50)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def scored(n=900, seed=3):
    """Groups of which one has most rows; most of its observed values tie."""
    r = random.Random(seed)
    return [(r.choices(GROUPS, (1, 20, 2, 3, 1))[0], f"k{k:05d}", float(0 if r.random() < 0.5 else r.randrange(-2, 40)), float(r.randrange(60))) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, k string, observed double, predicted double").repartition(4)


def average(values):
    order = sorted(values)
    first = {v: order.index(v) for v in set(values)}
    return [first[v] + (values.count(v) + 1) / 2 for v in values]


def by_group(rows):
    out = defaultdict(list)
    for g, k, y, p in rows:
        out[g].append((k, y, p))
    return out


def plans_group_windows(df):
    """Windows that take a whole group by g alone and are not cut to a few rows first."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return "Window" in text and "WindowGroupLimit" not in text and "[g#" in text and "__p" not in text


def test_group_metrics_against_one_window(spark, many_ranges):
    rows = scored()
    d, groups = frame(spark, rows), by_group(rows)
    rho = {r.g: (r.spearman, r.n) for r in me.spearman(d, ["g"]).collect()}
    for g, z in groups.items():
        a, b = average([y for _, y, _ in z]), average([p for _, _, p in z])
        assert rho[g] == (pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-9), len(z))
    tau = {r.g: r.kendall for r in me.kendall(d, ["g"], "k").collect()}
    sign = lambda x: (x > 0) - (x < 0)
    for g, z in groups.items():
        pairs = [(sign(a[1] - b[1]), sign(a[2] - b[2])) for a, b in combinations(z, 2)]
        assert tau[g] == pytest.approx(sum(x * y for x, y in pairs) / math.sqrt(sum(abs(x) for x, _ in pairs) * sum(abs(y) for _, y in pairs)), abs=1e-9)
    labelled = d.withColumn("label", (F.col("observed") > 10).cast("int"))
    auc = {r.g: r.auroc for r in me.auroc(labelled, ["g"], "label", "predicted").collect()}
    ap = {r.g: r.average_precision for r in me.average_precision(labelled, ["g"], "k", "label", "predicted").collect()}
    for g, z in groups.items():
        pos, neg = [p for _, y, p in z if y > 10], [p for _, y, p in z if y <= 10]
        want = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg)) if pos and neg else None
        assert auc[g] == (None if want is None else pytest.approx(want, abs=1e-9))
        order, hits, shares = sorted(z, key=lambda r: (-r[2], r[0])), 0, []
        for n, (_, y, _) in enumerate(order, 1):
            if y > 10:
                hits += 1
                shares.append(hits / n)
        assert ap[g] == (pytest.approx(sum(shares) / len(shares)) if shares else None)
    assert not plans_group_windows(me.auroc(labelled, ["g"], "label", "predicted"))
    assert not plans_group_windows(me.average_precision(labelled, ["g"], "k", "label", "predicted"))
    assert not plans_group_windows(me.spearman(d, ["g"])) and not plans_group_windows(me.kendall(d, ["g"], "k"))


@pytest.mark.parametrize(("k", "share"), [(7, None), (None, 0.1)])
def test_top_k_and_ndcg(spark, many_ranges, k, share):
    rows = scored(700, 5)
    d, groups = frame(spark, rows), by_group(rows)
    top = {r.g: r for r in me.top_k(d, ["g"], "k", k=k, share=share).collect()}
    for g, z in groups.items():
        size = min(k, len(z)) if k else max(1, math.ceil(len(z) * share))
        first = lambda c, z=z, size=size: {r[0] for r in sorted(z, key=lambda r: (-r[c], r[0]))[:size]}
        a, b = first(1), first(2)
        positive = {r[0] for r in z if r[1] > 0}
        assert (top[g].k, top[g].hits, top[g].precision) == (size, len(a & b), pytest.approx(len(b & positive) / size))
        assert top[g].jaccard == pytest.approx(len(a & b) / len(a | b)) and top[g].recall == pytest.approx(len(b & positive) / len(positive))
    if not k:
        return
    for shift in (False, True):
        got = {r.g: r.ndcg for r in me.ndcg(d, ["g"], "k", k, shift=shift).collect()}
        for g, z in groups.items():
            low = min(0.0, min(r[1] for r in z)) if shift else 0.0
            gain = lambda c, z=z, low=low: sum((max(r[1], 0) if not shift else r[1] - low) / math.log2(n + 2) for n, r in enumerate(sorted(z, key=lambda r: (-r[c], r[0]))[:k]))
            assert got[g] == (pytest.approx(gain(2) / gain(1)) if gain(1) else None)
    assert "WindowGroupLimit" in me.ndcg(d, ["g"], "k", k)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("method", ["min", "max", "average", "dense"])
def test_ranks_by_group_over_ranges(spark, many_ranges, monkeypatch, method):
    rows = [(g, k, None if k.endswith("7") else y) for g, k, y, _ in scored(600, 9)]
    d = spark.createDataFrame(rows, "g string, k string, v double")
    for ascending in (True, False):
        want = {r.k: r.r for r in w.rank_over(d, "v", "r", ["g"], ascending, method).collect()}
        with monkeypatch.context() as m:
            m.setattr(w, "SINGLE_WINDOW_ROWS", 10)
            got = {r.k: r.r for r in w.rank_over(d, "v", "r", ["g"], ascending, method).collect()}
            share = {r.k: r.r for r in w.percentile_rank(d, "v", "r", ["g"], ascending, method).collect()}
            place = {r.k: r.r for r in w.competition_rank(d, "v", "r", ["g"]).collect()}
        assert got == want
        assert share == {r.k: r.r for r in w.percentile_rank(d, "v", "r", ["g"], ascending, method).collect()}
        assert place == {r.k: r.r for r in w.competition_rank(d, "v", "r", ["g"]).collect()}


# -- quantiles ----------------------------------------------------------------------------------


@pytest.mark.parametrize("sort_values", [60, 10_000])
def test_quantiles_by_selection(spark, monkeypatch, sort_values):
    monkeypatch.setattr(ranges, "MIN_HOT_ROWS", 20)
    monkeypatch.setattr(qu, "SORT_VALUES", sort_values)
    monkeypatch.setattr(qu, "GRID", 50)
    monkeypatch.setattr(qu, "ACCURACY", 500)
    r = random.Random(1)
    rows = [(g, r.choice([0.0, 0.0, 5.0, r.gauss(0, 1), r.expovariate(1) ** 9])) for g in ("a", "b", None) for _ in range(500)]
    rows += [("one", 3.5), ("two", 1.0), ("two", 2.0), ("none", None), ("nan", float("nan")), ("same", 7.0), ("same", 7.0)]
    d = spark.createDataFrame(rows, "g string, v double")
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {x.g: list(x)[1:] for x in qu.quantiles(d, "v", shares, ["g"]).collect()}
    held = defaultdict(list)
    for g, v in rows:
        held[g].extend([v] if v is not None and v == v else [])
    for g, z in held.items():
        assert got[g] == ([pytest.approx(x, rel=1e-12) for x in np.quantile(z, shares)] if z else [None] * 5)
    all_of = [v for z in held.values() for v in z]
    assert list(qu.quantiles(d, "v", [0.25, 0.99]).first()) == [pytest.approx(x) for x in np.quantile(all_of, [0.25, 0.99])]
    assert list(qu.quantiles(d.where("v > 1e300"), "v", [0.5]).first()) == [None]


def test_quantiles_open_a_wrong_bracket(spark, monkeypatch):
    monkeypatch.setattr(qu, "ACCURACY", 2)  # a sketch that is wrong
    monkeypatch.setattr(qu, "GRID", 50)
    monkeypatch.setattr(qu, "SORT_VALUES", 50)
    d = spark.range(3000).select((F.col("id") * 7919 % 3001).cast("double").alias("v"))
    want = np.quantile([k * 7919 % 3001 for k in range(3000)], [0.3, 0.77])
    assert list(qu.quantiles(d, "v", [0.3, 0.77]).first()) == [pytest.approx(x) for x in want]


def test_quantiles_of_two_million_distinct_values(spark):
    d = spark.range(2_000_000, numPartitions=8).select((F.col("id") * 736_879 % 2_000_003).cast("double").alias("v"))
    got = qu.quantiles(d, "v", [0.5, 0.999]).first()
    want = d.agg(F.percentile("v", F.array(F.lit(0.5), F.lit(0.999)))).first()[0]
    assert list(got) == want


# -- resampling ---------------------------------------------------------------------------------


def test_permutations_are_bijections():
    a, b = resample.feistel_keys(7, 20)
    for n in (1, 2, 3, 10, 26, 1000):
        got = resample.permuted(np.arange(n), n, a, b)
        assert (np.sort(got, 0) == np.arange(n)[:, None]).all()
    few = resample.permuted(np.arange(4), 4, *resample.feistel_keys(1, 3000))
    seen = np.unique(few.T, axis=0, return_counts=True)[1]
    assert len(seen) == 24 and seen.min() > 60 and seen.max() < 200


def test_permutation_null_by_broadcast_and_by_join(spark, monkeypatch):
    r = random.Random(4)
    rows = [(k, x, x + r.gauss(0, 3), r.gauss(0, 1), None if k % 9 == 0 else 1.0) for k in range(300) for x in [r.gauss(0, 1)]] + [(900, float("nan"), 1.0, 1.0, 1.0)]
    d = spark.createDataFrame(rows, "k long, x double, near double, far double, flat double")
    got = {t.target: t for t in resample.permutation_null(d, "k", "x", ["near", "far", "flat"], 60).collect()}
    assert got["near"].p_value == pytest.approx(1 / 61) and got["far"].p_value > 0.05 and got["flat"].p_value is None and got["flat"].observed is None
    assert got["near"].permutations == 60 and abs(got["near"].null_mean) < 0.03 and got["near"].null_deviation == pytest.approx(1 / math.sqrt(299), rel=0.3)
    monkeypatch.setattr(resample, "BROADCAST_ROWS", 10)
    joined = {t.target: t for t in resample.permutation_null(d, "k", "x", ["near", "far", "flat"], 60).collect()}
    for t in got:
        assert [x if not isinstance(x, float) else pytest.approx(x, abs=1e-9) for x in got[t]] == list(joined[t])


def test_bootstrap_interval(spark):
    r = random.Random(8)
    rows = [(k, r.gauss(10, 4), None if k % 3 else r.gauss(0, 1), float("inf") if k == 5 else 2.0) for k in range(2000)]
    d = spark.createDataFrame(rows, "k long, a double, b double, c double")
    got = {x.column: x for x in resample.bootstrap_means(d, "k", ["a", "b", "c"], 400).collect()}
    a = np.array([x[1] for x in rows])
    assert got["a"].mean == pytest.approx(a.mean(), abs=0.02) and got["a"].deviation == pytest.approx(a.std() / math.sqrt(2000), rel=0.15)
    assert got["a"].low < a.mean() < got["a"].high and got["a"].high - got["a"].low == pytest.approx(2 * 1.96 * a.std() / math.sqrt(2000), rel=0.2)
    assert got["c"].low == got["c"].high == 2.0 and got["b"].replicates == 400
    again = {x.column: x for x in resample.bootstrap_means(d.repartition(5), "k", ["a"], 400).collect()}
    assert again["a"].low == pytest.approx(got["a"].low)
    none = resample.bootstrap_means(d.where("false"), "k", ["a"], 5).first()
    assert none.replicates == 0 and none.mean is None


# -- interval join ------------------------------------------------------------------------------


def test_interval_join_of_long_intervals_and_shuffled_rows(spark):
    r = random.Random(6)
    left = [(k % 3, float(r.randrange(100_000)), f"l{k}") for k in range(200)]
    right = [(k % 3, float(s), float(s + r.choice([0, 1, 10, 5000, 90_000])), f"r{k}") for k in range(60) for s in [r.randrange(100_000)]] + [(1, 50.0, None, "open")]
    a = spark.createDataFrame(left, "g long, at double, name string").repartition(7)
    b = spark.createDataFrame(right, "g long, start double, end double, what string")
    got = sorted((x.name, x.what) for x in fr.interval_join(a, b, ["g"], "at", "start", "end", bucket=1.0).collect())
    want = []
    for g, at, name in left:
        hits = [what for h, s, e, what in right if h == g and s <= at and (e is None or at < e)]
        want += [(name, what) for what in hits] or [(name, None)]
    assert sorted(got, key=str) == sorted(want, key=str)
