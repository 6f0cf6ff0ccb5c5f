"""Forecast and ranking metrics as aggregates over (observed, predicted)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonalyx.functions.special import digamma, lgamma, trigamma
from zonalyx.operators.ranges import hot_limit, null_safe_join, rank_of, rank_table, running, spread_join
from zonalyx.operators.store import dense_id, keep

EPS = 1e-9


def finite_pairs(df: DataFrame, y: str = "observed", p: str = "predicted") -> DataFrame:
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    return df.where(ok(y) & ok(p))


def correlation(a: str, b: str) -> Column:
    """Pearson's r; NULL where either side does not vary."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def regression(y: str = "observed", p: str = "predicted") -> list[Column]:
    """mae, rmse, bias, mape over positive y, Poisson deviance, r, n."""
    e = F.col(p) - F.col(y)
    mu = F.greatest(F.col(p).cast("double"), F.lit(EPS))
    dev = 2 * (mu - F.col(y) + F.when(F.col(y) > 0, F.col(y) * F.ln(F.col(y) / mu)).otherwise(0.0))
    return [
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(e).alias("bias"),
        F.avg(F.when(F.col(y) > 0, F.abs(e) / F.col(y))).alias("mape"),
        F.avg(dev).alias("poisson_deviance"),
        correlation(y, p).alias("pearson"),
        F.count(F.lit(1)).alias("n"),
    ]


def negative_binomial(y: str, mu: str, alpha: Column | float) -> Column:
    """The NB2 log likelihood of each row's count: mean mu, variance mu + alpha mu^2."""
    k, m, r = F.col(y).cast("double"), F.greatest(F.col(mu).cast("double"), F.lit(EPS)), 1.0 / (alpha if isinstance(alpha, Column) else F.lit(float(alpha)))
    return lgamma(k + r) - lgamma(r) - lgamma(k + 1.0) - r * F.log1p(m / r) + k * (F.ln(m) - F.ln(m + r))


def fitted_dispersion(df: DataFrame, y: str, mu: str, steps: int = 60) -> float | None:
    """The alpha that maximises the sum of NB2 log likelihoods; None without counts, 0.0 where counts spread less than Poisson's.

    Newton's method on ln(r), r = 1 / alpha; a step is one aggregate of the first two
    derivatives, and is cut to a factor of e.
    """
    k, m = F.col(y).cast("double"), F.greatest(F.col(mu).cast("double"), F.lit(EPS))
    rows = df.where(k.isNotNull() & F.col(mu).isNotNull())
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.sum((k - m) * (k - m) - k).alias("over"), F.sum(m * m).alias("mm")).first()
    if not s.n:
        return None
    if s.over <= 0:
        return 0.0
    t = math.log(s.mm / s.over)
    for _ in range(steps):
        r = F.lit(math.exp(t))
        first = digamma(k + r) - digamma(r) + F.ln(r / (r + m)) + 1 - (k + r) / (r + m)
        second = trigamma(k + r) - trigamma(r) + 1.0 / r - 2.0 / (r + m) + (k + r) / ((r + m) * (r + m))
        a, b = rows.agg(F.sum(first), F.sum(second)).first()
        slope, curve = a * math.exp(t), b * math.exp(2 * t) + a * math.exp(t)
        move = -slope / curve if curve < 0 else math.copysign(1.0, slope)
        t += max(-1.0, min(1.0, move))
        if abs(move) < 1e-10:
            break
        if t > 30:  # Poisson is as good
            return 0.0
    return math.exp(-t)


def spearman(df: DataFrame, by: list[str], y: str = "observed", p: str = "predicted") -> DataFrame:
    """spearman and n by group, from average ranks; NULL where either side does not vary.

    Rows are counted by pair of values; the ranks of both sides come from sums over
    ranges and are joined to the pairs, so ties are one row and no group is one task.
    """
    pairs = keep(finite_pairs(df, y, p).groupBy(*by, y, p).agg(F.count(F.lit(1)).alias("__w")), "pairs")
    limit = hot_limit(pairs.count())
    for column, out in ((y, "__a"), (p, "__b")):
        ranks = rank_table(pairs, by, column, F.col("__w")).select(*by, column, rank_of("average").alias(out), F.col("rows").alias("__rows"))
        pairs = spread_join(pairs, keep(ranks, "ranks"), [*by, column], "__rows", limit).drop("__rows")
    w, a, b = F.col("__w"), F.col("__a"), F.col("__b")
    s = {"n": w, "a": w * a, "b": w * b, "aa": w * a * a, "bb": w * b * b, "ab": w * a * b}
    g = pairs.groupBy(*by).agg(*[F.sum(c).alias(f"__s{k}") for k, c in s.items()])
    n, sa, sb = F.col("__sn"), F.col("__sa"), F.col("__sb")
    spread = F.sqrt(n * F.col("__saa") - sa * sa) * F.sqrt(n * F.col("__sbb") - sb * sb)
    return g.select(*by, F.try_divide(n * F.col("__sab") - sa * sb, F.nullif(spread, F.lit(0.0))).alias("spearman"), n.alias("n"))


def kendall(df: DataFrame, by: list[str], key: str, y: str = "observed", p: str = "predicted") -> DataFrame:
    """Tau-b inside each group of two rows at least, without looking at pairs.

    Two rows with different ranks of p differ first in one bit of them. So for each
    bit, rows that agree in the bits above it are sorted by y, and those with the bit
    count those without it before them (and the other way round): concordant and
    discordant pairs, in n log n. Counts before are sums over ranges of (group, bit,
    bits above, y), so the highest bit, which takes whole groups, is many tasks too.
    """
    pairs = keep(finite_pairs(df, y, p).groupBy(*by, y, p).agg(F.count(F.lit(1)).alias("__w")), "pairs")
    limit = hot_limit(pairs.count())
    places = keep(rank_table(pairs, by, p, F.col("__w")), "ranks")
    ties = lambda t, out: t.groupBy(*by).agg(F.sum("n").alias("__n"), F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias(out), F.max("values_before").alias("__top"), F.sum("rows").alias("__pairs"))
    group = keep(ties(places, "__tp"), "groups")
    ranked = spread_join(pairs, places.select(*by, p, F.col("values_before").alias("__r"), "rows"), [*by, p], "rows", limit).drop("rows")
    ranked = spread_join(ranked, group.select(*by, "__top", "__pairs"), by, "__pairs", limit)
    # as many bits as the longest group needs
    bits = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.col("__top") + 1.0)).cast("int") - 1, F.lit(0)))
    each = ranked.withColumn("__b", F.explode(bits))
    on = F.getbit("__r", F.col("__b")).cast("long")
    above = [*by, "__b", "__above"]
    counted = each.withColumn("__above", F.expr("shiftright(__r, __b + 1)")).groupBy(*above, y).agg(F.sum(on * F.col("__w")).alias("__on"), F.sum((1 - on) * F.col("__w")).alias("__off"))
    before = running(counted, above, [F.col(y)], {"__ons": F.col("__on"), "__offs": F.col("__off")}, "kendall")
    real = lambda c: F.col(c).cast("double")
    gain = real("__on") * (real("__offs") - real("__off")) - real("__off") * (real("__ons") - real("__on"))
    score = before.groupBy(*by).agg(F.sum(gain).alias("__c"))
    sides = null_safe_join(group, ties(rank_table(pairs, by, y, F.col("__w")), "__ty").select(*by, "__ty"), by)
    g = null_safe_join(score, sides, by).where("__n > 1")
    all_pairs = real("__n") * (F.col("__n") - 1) / 2
    scale = F.sqrt((all_pairs - F.col("__ty")) * (all_pairs - F.col("__tp")))
    return g.select(*by, F.try_divide(F.col("__c"), F.nullif(scale, F.lit(0.0))).alias("kendall"))


def _largest(d: DataFrame, by: list[str], key: str, column: str, k: int) -> DataFrame:
    """The k first rows of each group by falling column, then key, with their place; each task passes on k rows of a group at most."""
    return d.withColumn("__place", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(column).desc(), key))).where(F.col("__place") <= k)


def top_k(df: DataFrame, by: list[str], key: str, k: int | None = None, share: float | None = None, y: str = "observed", p: str = "predicted") -> DataFrame:
    """Overlap, precision, recall and Jaccard of the k largest by y and by p (or the share of n, rounded up).

    key tells the rows of a group apart. A number k is cut in the tasks that read the
    rows; a share has no bound, so places are then counted over ranges.
    """
    d = finite_pairs(df, y, p).select(*by, key, y, p)
    sizes = d.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col(y) > 0).alias("relevant"))
    if k:
        sizes = sizes.withColumn("__k", F.least(F.lit(k), F.col("__n")).cast("long"))
        first = lambda c: _largest(d, by, key, c, k)
    else:
        d, sizes = keep(d, "pairs"), keep(sizes.withColumn("__k", F.greatest(F.lit(1), F.ceil(F.col("__n") * share)).cast("long")), "groups")
        limit = hot_limit(d.count())
        places = lambda c: running(d, by, [F.col(c).desc(), F.col(key)], {"__place": F.lit(1).cast("long")}, "places")
        first = lambda c: spread_join(places(c), sizes.select(*by, "__k", "__n"), by, "__n", limit).where("__place <= __k")
    best = first(p)
    both = null_safe_join(first(y).select(*by, key), best.select(*by, key), [*by, key]).groupBy(*by).agg(F.count(F.lit(1)).alias("hits"))
    hit = best.groupBy(*by).agg(F.count_if(F.col(y) > 0).alias("relevant_hits"))
    g = null_safe_join(null_safe_join(sizes, both, by, "left"), hit, by, "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    g = g.withColumnRenamed("__k", "k")
    return g.select(
        *by,
        "k",
        "hits",
        (F.col("hits") / F.col("k")).alias("overlap"),
        (F.col("relevant_hits") / F.col("k")).alias("precision"),
        F.try_divide(F.col("relevant_hits").cast("double"), F.nullif(F.col("relevant"), F.lit(0))).alias("recall"),
        (F.col("hits") / (2 * F.col("k") - F.col("hits"))).alias("jaccard"),
    )


def ndcg(df: DataFrame, by: list[str], key: str, k: int, y: str = "observed", p: str = "predicted", shift: bool = False) -> DataFrame:
    """Linear gains over log2(place + 1); NULL if the ideal is 0.

    Negatives count as 0, or, with shift, all gains of a group rise by its least value
    if that is negative. Each task passes on k rows of a group at most.
    """
    d = finite_pairs(df, y, p).select(*by, key, y, p)
    value = F.col(y).cast("double")
    part = lambda c, out: _largest(d, by, key, c, k).groupBy(*by).agg(
        F.sum(F.greatest(value, F.lit(0.0)) / F.log2(F.col("__place") + 1.0)).alias(out),
        F.sum(value / F.log2(F.col("__place") + 1.0)).alias(f"{out}_whole"),
        F.sum(1 / F.log2(F.col("__place") + 1.0)).alias(f"{out}_ones"),
    )
    g = null_safe_join(part(p, "dcg"), part(y, "ideal"), by)
    if shift:
        low = d.groupBy(*by).agg(F.least(F.min(value), F.lit(0.0)).alias("__low"))
        g = null_safe_join(g, low, by).withColumns({c: F.col(f"{c}_whole") - F.col("__low") * F.col(f"{c}_ones") for c in ("dcg", "ideal")})
    return g.select(*by, "dcg", F.try_divide(F.col("dcg"), F.nullif(F.col("ideal"), F.lit(0.0))).alias("ndcg"))


def auroc(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """Rank-sum with average ranks; NULL with one class. Rows are counted by score; what lies below a score is a sum over ranges."""
    pos = F.col(label) > 0
    counts = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("n"), F.count_if(pos).alias("__pos"), F.count_if(~pos).alias("__neg"))
    below = running(counts, by, [F.col(score).asc_nulls_first()], {"__upto": F.col("n")}, "scores")
    rank = F.col("__upto") - F.col("n") + (F.col("n") + 1) / 2
    g = below.groupBy(*by).agg(F.sum(F.when(F.col("__pos") > 0, F.col("__pos") * rank)).alias("__s"), F.sum("__pos").alias("__a"), F.sum("__neg").alias("__b"))
    a, b = F.col("__a").cast("double"), F.col("__b").cast("double")
    return g.select(*by, F.when((a > 0) & (b > 0), (F.col("__s") - a * (a + 1) / 2) / (a * b)).alias("auroc"))


def average_precision(df: DataFrame, by: list[str], key: str, label: str, score: str) -> DataFrame:
    """Mean over the positive rows of the share of positives down to them, in the order of falling score, then key; counts are sums over ranges."""
    rows = df.select(*by, key, score, (F.col(label) > 0).alias("__pos"))
    hit = F.coalesce(F.col("__pos").cast("long"), F.lit(0))
    r = running(rows, by, [F.col(score).desc(), F.col(key)], {"__n": F.lit(1).cast("long"), "__tp": hit}, "scores")
    return r.groupBy(*by).agg(F.avg(F.when(F.col("__pos"), F.col("__tp") / F.col("__n"))).alias("average_precision"))


def classification(label: str, score: str, threshold: float = 0.5) -> list[Column]:
    y, p = F.col(label) > 0, F.col(score) >= threshold
    tp, fp, fn, tn = F.count_if(y & p), F.count_if(~y & p), F.count_if(y & ~p), F.count_if(~y & ~p)
    rate = lambda a, b: F.try_divide(a.cast("double"), F.nullif(b, F.lit(0)))
    return [
        tp.alias("tp"),
        fp.alias("fp"),
        fn.alias("fn"),
        tn.alias("tn"),
        rate(tp, tp + fp).alias("precision"),
        rate(tp, tp + fn).alias("recall"),
        rate(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ((rate(tp, tp + fn) + rate(tn, tn + fp)) / 2).alias("balanced_accuracy"),
        F.avg(F.pow(F.col(score) - y.cast("double"), F.lit(2))).alias("brier"),
    ]


#: Whether larger is better.
DIRECTION = {
    "mae": False,
    "rmse": False,
    "bias": False,
    "mape": False,
    "poisson_deviance": False,
    "pearson": True,
    "spearman": True,
    "ndcg": True,
    "auroc": True,
}


def long_metrics(wide: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """metric_name, metric_value, higher_is_better and the group, from a row per group."""
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric_name"),
                F.col(m).cast("double").alias("metric_value"),
                F.lit(DIRECTION.get(m, False)).alias("higher_is_better"),
            ) for m in names
        ]
    )
    return wide.select(*by, F.explode(rows).alias("m")).select(*by, "m.*")


# -- rankings of zones ----------------------------------------------------------------------------


def ranking_scores(df: DataFrame, key: str, scorers: dict[str, str], seed: int = 42) -> DataFrame:
    """A row per zone and scorer (scorer, score): named columns, and "random" by a hash of the key."""
    given = [F.struct(F.lit(name).alias("scorer"), F.col(c).cast("double").alias("score")) for name, c in scorers.items()]
    drawn = F.struct(F.lit("random").alias("scorer"), (F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)).alias("score"))
    return df.withColumn("__s", F.explode(F.array(*given, drawn))).select("*", "__s.*").drop("__s")


def ranking_evaluation(scored: DataFrame, key: str, targets: list[str], k: int = 10) -> DataFrame:
    """scorer, target, n, spearman, kendall, overlap (of the k largest) and ndcg for each scorer and target.

    NULL instead of a figure where fewer than three zones, or fewer than two distinct
    values of either side, are there.
    """
    rows = [F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("observed")) for t in targets]
    long = finite_pairs(scored.withColumn("__t", F.explode(F.array(*rows))).select(key, "scorer", F.col("score").alias("predicted"), "__t.*"))
    by = ["scorer", "target"]
    sizes = long.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("observed").alias("__a"), F.count_distinct("predicted").alias("__b"))
    out = sizes.join(spearman(long, by).drop("n"), by, "left").join(kendall(long, by, key), by, "left")
    out = out.join(top_k(long, by, key, k=k).select(*by, "overlap"), by, "left").join(ndcg(long, by, key, k).select(*by, "ndcg"), by, "left")
    enough = (F.col("n") >= 3) & (F.col("__a") >= 2) & (F.col("__b") >= 2)
    return out.select(*by, "n", *[F.when(enough, F.col(c)).alias(c) for c in ("spearman", "kendall", "overlap", "ndcg")])


def audit(df: DataFrame, reported: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """metric_name, reported, recomputed, difference, agrees: figures of one plan against those of sums made anew.

    df has observed and predicted; reported has metric_name and metric_value.
    """
    d = finite_pairs(df).select(F.col("observed").cast("double").alias("y"), F.col("predicted").cast("double").alias("p"))
    s = d.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(n) for n, c in {"sy": F.col("y"), "sp": F.col("p"), "syy": F.col("y") * F.col("y"), "spp": F.col("p") * F.col("p"), "syp": F.col("y") * F.col("p"), "ae": F.abs(F.col("p") - F.col("y"))}.items()])
    n = F.col("n")
    anew = {
        "mae": F.col("ae") / n,
        "rmse": F.sqrt((F.col("spp") - 2 * F.col("syp") + F.col("syy")) / n),
        "bias": (F.col("sp") - F.col("sy")) / n,
        "pearson": F.try_divide(
            n * F.col("syp") - F.col("sy") * F.col("sp"),
            F.nullif(F.sqrt(n * F.col("syy") - F.col("sy") * F.col("sy")) * F.sqrt(n * F.col("spp") - F.col("sp") * F.col("sp")), F.lit(0.0)),
        ),
    }
    long = s.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric_name"), v.alias("recomputed")) for k, v in anew.items()])).alias("m")).select("m.*")
    gap = F.abs(F.col("metric_value") - F.col("recomputed"))
    return reported.join(long, "metric_name").select(
        "metric_name",
        F.col("metric_value").alias("reported"),
        "recomputed",
        gap.alias("difference"),
        (gap <= tolerance * F.greatest(F.abs("recomputed"), F.lit(1.0))).alias("agrees"),
    )


def permutation_importance(df: DataFrame, model, features: list[str], observed: str, key: str, seed: int = 42) -> DataFrame:
    """feature, rise: how much the mean squared error of a fitted pipeline rises when the feature's values are dealt anew by a hash."""
    def error(d: DataFrame) -> float:
        return model.transform(d).agg(F.avg(F.pow(F.col("prediction") - F.col(observed), F.lit(2)))).first()[0] or 0.0

    base, rows = error(df), []
    for k, f in enumerate(features):
        a = dense_id(df.drop(f), "__i", key)
        b = dense_id(df.select(f, F.xxhash64(F.col(key), F.lit(seed + k)).alias("__h"), F.col(key).alias("__k")), "__i", "__h", "__k").select("__i", f)
        rows.append((f, float(error(a.join(b, "__i")) - base)))
    return df.sparkSession.createDataFrame(rows, "feature string, rise double")


def partial_dependence(df: DataFrame, model, feature: str, grid: list[float]) -> DataFrame:
    """value, mean, low and high (10 and 90 percent) of predictions with the feature set to each value of the grid."""
    many = df.drop(feature).withColumn(feature, F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    q = F.percentile("prediction", F.array(F.lit(0.1), F.lit(0.9)))
    return model.transform(many).groupBy(F.col(feature).alias("value")).agg(F.avg("prediction").alias("mean"), q[0].alias("low"), q[1].alias("high"))
