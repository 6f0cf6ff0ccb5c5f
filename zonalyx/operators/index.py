"""Composite indices: recipes, normalising, orienting, imputing, factors, standard output.

Everything per row is a column expression; what must be known about a whole
column is fetched by one aggregate. Factor algebra works on a covariance matrix of
the variables' size, which one aggregate computes; rows never reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalyx.functions.windows import competition_rank, deviation_band, percentile_rank
from zonalyx.operators.frames import ContractError

TINY = 1e-12


@dataclass(frozen=True)
class Variable:
    name: str
    direction: str = "positive"  # positive, negative, none
    weight: float | None = None
    domain: str | None = None
    kind: str = "number"  # number, proportion, percentage


@dataclass(frozen=True)
class Recipe:
    name: str
    variables: tuple[Variable, ...]
    id_column: str = "zone_id"
    normalise: str = "minmax"  # none, minmax, zscore, vector, percentile_rank
    aggregate: str = "weighted_sum"  # sum, mean, weighted_sum
    missing: str = "error"  # error, drop_units, median, mean, zero, keep
    flags: bool = True
    classes: int = 5
    population: str | None = None
    extra: dict = field(default_factory=dict)

    @staticmethod
    def from_mapping(given: dict) -> Recipe:
        """From what a YAML or JSON recipe holds; unknown keys are kept in extra."""
        known = {"name", "id_column", "normalise", "aggregate", "missing", "flags", "classes", "population"}
        variables = tuple(Variable(name, **{k: v for k, v in (spec or {}).items() if k in ("direction", "weight", "domain", "kind")}) for name, spec in given["variables"].items())
        return Recipe(
            variables=variables,
            extra={k: v for k, v in given.items() if k not in known | {"variables"}},
            **{k: v for k, v in given.items() if k in known},
        )


#: What the fields of a recipe may hold.
CHOICES = {
    "direction": ("positive", "negative", "none"),
    "kind": ("number", "nonnegative", "proportion", "percentage"),
    "normalise": ("none", "minmax", "zscore", "vector", "percentile_rank"),
    "aggregate": ("sum", "mean", "weighted_sum"),
    "missing": ("error", "drop_units", "median", "mean", "zero", "keep"),
}


def recipe_issues(recipe: Recipe) -> list[tuple[str, str]]:
    """(field, what is wrong) of a recipe, before any table is read; nothing of a sound one."""
    out = [] if recipe.variables else [("variables", "none")]
    names = [v.name for v in recipe.variables]
    out += [("variables", f"{n} is given twice") for n in sorted({n for n in names if names.count(n) > 1})]
    out += [(f, f"unknown: {getattr(recipe, f)}") for f in ("normalise", "aggregate", "missing") if getattr(recipe, f) not in CHOICES[f]]
    for v in recipe.variables:
        out += [(f"{v.name}.{f}", f"unknown: {getattr(v, f)}") for f in ("direction", "kind") if getattr(v, f) not in CHOICES[f]]
        if recipe.aggregate == "weighted_sum" and v.weight is None:
            out.append((f"{v.name}.weight", "absent"))
    if recipe.classes < 1:
        out.append(("classes", f"not positive: {recipe.classes}"))
    return out


def recipe_table_issues(rows: DataFrame, recipe: str = "recipe") -> DataFrame:
    """recipe, field, issue of recipes in a table, one row a variable: variable, direction, weight, and normalise, aggregate, missing, classes of the recipe."""
    unknown = lambda f: ~F.coalesce(F.col(f).isin(*CHOICES[f]), F.lit(False))
    said = lambda f: F.concat(F.lit("unknown: "), F.coalesce(F.col(f), F.lit("null")))
    found = lambda when, field, issue: F.when(when, F.struct(field.alias("field"), issue.alias("issue")))
    of_variable = [
        found(unknown("direction"), F.concat("variable", F.lit(".direction")), said("direction")),
        found((F.col("aggregate") == "weighted_sum") & F.col("weight").isNull(), F.concat("variable", F.lit(".weight")), F.lit("absent")),
        found(F.col("times") > 1, F.lit("variables"), F.concat("variable", F.lit(" is given twice"))),
    ]
    first = [F.min(f).alias(f) for f in ("normalise", "aggregate", "missing", "classes")]
    one = rows.groupBy(recipe, "variable", "direction", "weight", "aggregate").agg(F.count(F.lit(1)).alias("times"))
    of_recipe = [found(unknown(f), F.lit(f), said(f)) for f in ("normalise", "aggregate", "missing")]
    of_recipe.append(found(F.coalesce(F.col("classes") < 1, F.lit(True)), F.lit("classes"), F.concat(F.lit("not positive: "), F.coalesce(F.col("classes").cast("string"), F.lit("null")))))
    parts = [df.select(recipe, F.explode(F.array_compact(F.array(*issues))).alias("i")).select(recipe, "i.*") for df, issues in ((one, of_variable), (rows.groupBy(recipe).agg(*first), of_recipe))]
    return parts[0].unionByName(parts[1])


def checked(recipe: Recipe) -> Recipe:
    found = recipe_issues(recipe)
    if found:
        raise ContractError("; ".join(f"{field}: {what}" for field, what in found))
    return recipe


# -- one variable -------------------------------------------------------------------------------


def fit_normaliser(df: DataFrame, columns: list[str], method: str) -> dict[str, dict[str, float | None]]:
    """What normalise needs to know of each column, by one pass."""
    parts = []
    for c in columns:
        parts.append(
            F.struct(
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
                F.avg(c).alias("mean"),
                F.stddev_pop(c).alias("sd"),
                F.sqrt(F.sum(F.col(c).cast("double") * F.col(c))).alias("norm"),
            ).alias(c)
        )
    row = df.agg(*parts).first()
    return {c: row[c].asDict() for c in columns}


def normalise(
    df: DataFrame,
    columns: list[str],
    method: str = "minmax",
    params: dict | None = None,
    constant: float | None = 0.0,
    suffix: str = "",
) -> DataFrame:
    """Columns by method; a constant column becomes `constant`. params: those of an earlier fit."""
    if method == "none":
        return df
    if method == "percentile_rank":
        rows = df.count()
        for c in columns:
            df = percentile_rank(df, c, c + suffix, rows=rows)
        return df
    params = params or fit_normaliser(df, columns, method)
    for c in columns:
        p = params[c]
        shift, scale = {
            "minmax": (p["min"], None if p["max"] is None else p["max"] - p["min"]),
            "zscore": (p["mean"], p["sd"]),
            "vector": (0.0, p["norm"]),
        }[method]
        flat = scale is None or scale <= TINY
        value = F.lit(constant).cast("double") if flat else (F.col(c).cast("double") - shift) / scale
        df = df.withColumn(c + suffix, F.when(F.col(c).isNotNull(), value))
    return df


def orient(x: Column, direction: str, unit: bool = True) -> Column:
    if direction in ("positive", "none"):
        return x
    if direction == "negative":
        return 1 - x if unit else -x
    raise ContractError(f"unknown direction {direction!r}")


def impute(df: DataFrame, columns: list[str], strategy: str, flags: bool = True, values: dict | None = None) -> tuple[DataFrame, dict]:
    """Missing values by strategy, with <column>__missing_flag from before; and the values used."""
    used: dict = {}
    if flags:
        for c in columns:
            df = df.withColumn(f"{c}__missing_flag", F.col(c).isNull())
    if strategy == "error":
        bad = df.agg(*[(F.count(F.lit(1)) - F.count(c)).alias(c) for c in columns]).first()
        wrong = [c for c in columns if bad[c]]
        if wrong:
            raise ContractError(f"missing values in {wrong}")
    elif strategy == "drop_units":
        df = df.dropna(how="any", subset=columns)
    elif strategy in ("median", "mean", "zero"):
        f = {"median": F.median, "mean": F.avg, "zero": lambda c: F.lit(0.0)}[strategy]
        used = values or df.agg(*[f(c).alias(c) for c in columns]).first().asDict()
        df = df.fillna({c: float(v) for c, v in used.items() if v is not None})
    elif strategy != "keep":
        raise ContractError(f"unknown strategy {strategy!r}")
    return df, used


def combine(columns: list[str], how: str, weights: list[float | None] | None = None) -> Column:
    """Row-wise sum or mean over what is not NULL, or a weighted sum that NULL makes NULL."""
    total, n = F.lit(0.0), F.lit(0)
    if how == "weighted_sum":
        if not weights or any(w is None for w in weights):
            raise ContractError("a weighted sum needs a weight for each variable")
        for c, w in zip(columns, weights, strict=True):
            total = total + F.col(c) * float(w)
        return total
    for c in columns:
        total, n = total + F.coalesce(c, F.lit(0.0)), n + F.col(c).isNotNull().cast("int")
    if how == "sum":
        return total
    if how == "mean":
        return F.try_divide(total, F.nullif(n, F.lit(0)))
    raise ContractError(f"unknown aggregation {how!r}")


# -- standard output ----------------------------------------------------------------------------


def standard_output(
    df: DataFrame,
    id_column: str,
    score: str,
    index_name: str,
    missing: Column | None = None,
    flag: Column | None = None,
    run_id: str = "run",
    level: str = "full",
    direction: str = "higher_is_worse",
) -> DataFrame:
    """The fixed columns of every index's result."""
    out = df.withColumn("__missing", missing if missing is not None else F.lit(0)).withColumn("__flag", flag if flag is not None else F.lit("ok"))
    p = fit_normaliser(out, [score], "minmax")[score]
    flat = p["max"] is None or p["max"] - p["min"] <= TINY
    out = out.withColumn("__unit", F.when(F.col(score).isNotNull(), F.lit(0.0) if flat else (F.col(score) - p["min"]) / (p["max"] - p["min"])))
    rows = out.count()
    out = competition_rank(percentile_rank(out, score, "__pct", rows=rows), score, "__rank", rows=rows)
    return out.select(
        F.col(id_column).cast("string").alias("zone_id"),
        F.lit(index_name).alias("index_name"),
        F.lit(run_id).alias("run_id"),
        F.col(score).cast("double").alias("score_raw"),
        F.col("__unit").alias("score_normalized_0_1"),
        F.lit(direction).alias("score_direction"),
        F.col("__rank").alias("rank"),
        F.col("__pct").alias("percentile"),
        F.col("__missing").cast("long").alias("missing_count"),
        F.col("__flag").alias("quality_flag"),
        F.lit(level).alias("reproduction_level"),
    )


def explain(output: DataFrame, zone: str) -> dict:
    row = output.where(F.col("zone_id") == zone).first()
    if row is None:
        raise KeyError(zone)
    return row.asDict()


# -- the three indices --------------------------------------------------------------------------


def additive_index(df: DataFrame, recipe: Recipe) -> DataFrame:
    """Impute, normalise, orient, combine: id, oriented variables and score."""
    checked(recipe)
    names = [v.name for v in recipe.variables]
    df, _ = impute(df, names, recipe.missing, recipe.flags)
    df = normalise(df, names, recipe.normalise)
    unit = recipe.normalise in ("minmax", "percentile_rank")
    for v in recipe.variables:
        df = df.withColumn(v.name, orient(F.col(v.name), v.direction, unit))
    return df.withColumn("score", combine(names, recipe.aggregate, [v.weight for v in recipe.variables]))


def rank_index(df: DataFrame, recipe: Recipe, high: float = 0.9) -> DataFrame:
    """Variable ranks to domain sums to domain ranks to a total and its rank; flags count ranks of high and more.

    Sums are rounded to 12 decimals, so that equal ranks stay equal whatever the order of adding.
    """
    if recipe.population:
        df = df.where(F.col(recipe.population) > 0)
    rows = df.count()
    domains: dict[str, list[str]] = {}
    for v in recipe.variables:
        df = percentile_rank(df, v.name, f"pr_{v.name}", ascending=v.direction != "negative", rows=rows)
        df = df.withColumn(f"flag_{v.name}", F.coalesce((F.col(f"pr_{v.name}") >= high).cast("int"), F.lit(0)))
        domains.setdefault(v.domain or "all", []).append(v.name)
    for d, names in domains.items():
        parts = [f"pr_{n}" for n in names]
        some = F.coalesce(*parts).isNotNull()
        df = df.withColumn(f"{d}_sum", F.when(some, F.round(combine(parts, "sum"), 12)))
        df = percentile_rank(df, f"{d}_sum", f"{d}_pr", rows=rows)
    ranks = [f"{d}_pr" for d in domains]
    flags = F.lit(0)
    for v in recipe.variables:
        flags = flags + F.col(f"flag_{v.name}")
    df = df.withColumn("flags", flags).withColumn("total", F.when(F.coalesce(*ranks).isNotNull(), F.round(combine(ranks, "sum"), 12)))
    return percentile_rank(df, "total", "score", rows=rows)


def covariance(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """(means, covariance with n - 1, rows), by one pass over the rows."""
    parts = [F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]]
    p = len(columns)
    parts += [F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)]
    row = df.agg(*parts).first()
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(p)] for i in range(p)])
    return np.array([row[f"m{i}"] for i in range(p)], float), cov, row.n


def retain(eigenvalues: np.ndarray, keep: int | float = 1.0) -> int:
    """How many factors stay: those above keep if it is a float, as many as keep says if an int; none, or more than there are, is an error."""
    k = keep if isinstance(keep, int) else int((np.asarray(eigenvalues) > keep).sum())
    if not 0 < k <= len(eigenvalues):
        raise ContractError(f"{k} factors of {len(eigenvalues)} variables")
    return k


def principal_factors(cov: np.ndarray, keep: int | float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(loadings of the factors that retain() keeps, all eigenvalues); each factor's largest entry is positive."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order]
    k = retain(values, keep)
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), range(vectors.shape[1])])
    return vectors[:, :k] * np.sqrt(np.maximum(values[:k], 0)), values


@dataclass(frozen=True)
class Rotation:
    loadings: np.ndarray
    turn: np.ndarray
    rounds: int
    converged: bool


def rotate(loadings: np.ndarray, tolerance: float = 1e-6, most: int = 500) -> Rotation:
    """Varimax, with rows scaled to length 1 while rotating: loadings, the orthogonal turn, and whether it settled."""
    p, k = loadings.shape
    if k < 2:
        return Rotation(loadings.copy(), np.eye(k), 0, True)
    length = np.sqrt((loadings**2).sum(1, keepdims=True))
    length[length < TINY] = 1.0
    a, turn, before = loadings / length, np.eye(k), 0.0
    for n in range(1, most + 1):
        b = a @ turn
        u, s, vt = np.linalg.svd(a.T @ (b**3 - b @ np.diag((b**2).sum(0)) / p))
        turn = u @ vt
        if s.sum() - before <= tolerance * max(1.0, s.sum()):
            return Rotation((a @ turn) * length, turn, n, True)
        before = s.sum()
    return Rotation((a @ turn) * length, turn, most, False)


def varimax(loadings: np.ndarray, tolerance: float = 1e-6, most: int = 500) -> np.ndarray:
    return rotate(loadings, tolerance, most).loadings


METHODS = ("positive", "negative", "absolute", "none", "anchor")


def orientation_of(given: dict, loadings: np.ndarray, used: list[str], unconfigured: str = "none") -> list[dict]:
    """What is done with each factor: method, sign, configured, rationale, anchor.

    given: factor number to a method, or to a mapping with method, anchor (a
    variable whose loading is to be positive) and rationale. A factor that is not
    given is an error, left as it is with a warning, or left as it is (none).
    """
    out = []
    for k in range(loadings.shape[1]):
        said = given.get(k + 1)
        if said is None and unconfigured == "error":
            raise ContractError(f"no orientation for factor_{k + 1}")
        spec = {"method": "none", "rationale": "not configured"} if said is None else {"method": said} if isinstance(said, str) else dict(said)
        method, anchor = spec.get("method", "none"), spec.get("anchor")
        if method not in METHODS:
            raise ContractError(f"unknown orientation {method!r} for factor_{k + 1}")
        sign = -1.0 if method == "negative" else 1.0
        if method == "anchor":
            if anchor not in used:
                raise ContractError(f"the anchor {anchor!r} of factor_{k + 1} is no variable in use")
            sign = 1.0 if loadings[used.index(anchor), k] >= 0 else -1.0
        out.append(
            {
                "method": method,
                "sign": sign,
                "configured": said is not None,
                "rationale": spec.get("rationale"),
                "anchor": anchor,
                "warning": said is None and unconfigured == "warn",
            }
        )
    return out


def score_weights(rotated: np.ndarray) -> np.ndarray:
    """What each standardised variable counts in each rotated factor's score."""
    return rotated @ np.linalg.pinv(rotated.T @ rotated)


def factor_index(df: DataFrame, recipe: Recipe, keep: int | float = 1.0, orientation: dict | None = None, unconfigured: str = "none") -> tuple[DataFrame, dict]:
    """Impute, standardise, factors, varimax, scores, orient, sum: factor_<k>, score and band; and what was fitted."""
    names = [v.name for v in recipe.variables]
    df, filled = impute(df, names, recipe.missing, recipe.flags)
    fit = fit_normaliser(df, names, "zscore")
    used = [c for c in names if (fit[c]["sd"] or 0.0) > TINY]
    df = normalise(df, used, "zscore", fit, suffix="__z")
    z = [f"{c}__z" for c in used]
    _, cov, n = covariance(df, z)
    loadings, values = principal_factors(cov, keep)
    rotation = rotate(loadings)
    rotated, weights = rotation.loadings, score_weights(rotation.loadings)
    turned = orientation_of(orientation or {}, rotated, used, unconfigured)
    total = F.lit(0.0)
    for k in range(weights.shape[1]):
        score = F.lit(0.0)
        for c, w in zip(z, weights[:, k], strict=True):
            score = score + F.col(c) * float(w)
        score = F.abs(score) if turned[k]["method"] == "absolute" else score * turned[k]["sign"]
        df = df.withColumn(f"factor_{k + 1}", score)
        total = total + F.col(f"factor_{k + 1}")
    df = df.withColumn("score", total)
    s = fit_normaliser(df, ["score"], "zscore")["score"]
    band = F.lit(0.0) if (s["sd"] or 0) <= TINY else (F.col("score") - s["mean"]) / s["sd"]
    info = {
        "loadings": rotated,
        "unrotated": loadings,
        "eigenvalues": values,
        "used": used,
        "dropped": [c for c in names if c not in used],
        "imputed": filled,
        "rows": n,
        "orientation": turned,
        "rounds": rotation.rounds,
        "converged": rotation.converged,
    }
    return df.withColumn("band", deviation_band(band)), info


def factor_summary(info: dict) -> list[dict]:
    """A row per factor: eigenvalue and its share, the leading variables by size and by sign, and its orientation."""
    values, out = np.asarray(info["eigenvalues"]), []
    for k in range(info["loadings"].shape[1]):
        x = info["loadings"][:, k]
        said = lambda order: "; ".join(f"{info['used'][i]}:{x[i]:.4f}" for i in order)  # noqa: B023, E731
        size, falling, rising = np.argsort(-np.abs(x), kind="stable"), np.argsort(-x, kind="stable"), np.argsort(x, kind="stable")
        o = info["orientation"][k]
        out.append(
            {
                "factor": f"factor_{k + 1}",
                "eigenvalue": float(values[k]),
                "explained": float(values[k] / values.sum()),
                "leading": said(size[:5]),
                "leading_positive": said(falling[:3]),
                "leading_negative": said(rising[:3]),
                "orientation": o["method"],
                "rationale": o["rationale"],
                "configured": o["configured"],
            }
        )
    return out


INDICES: dict[str, Callable] = {"additive": additive_index, "rank_based": rank_index, "factor_based": factor_index}


def get_index(name: str) -> Callable:
    key = name.strip().lower().replace("-", "_").replace(" ", "_")
    if key not in INDICES:
        raise ContractError(f"no index {name!r}; there are {sorted(INDICES)}")
    return INDICES[key]


# -- regressions --------------------------------------------------------------------------------


def ridge_log_counts(df: DataFrame, x: list[str], y: str, alpha: float = 1.0) -> tuple[float, dict[str, float]]:
    """Intercept and coefficients of log1p(y) on x; the intercept is not penalised."""
    t = df.select(*[F.col(c).cast("double").alias(c) for c in x], F.log1p(F.greatest(F.col(y).cast("double"), F.lit(0.0))).alias("__y")).dropna()
    means, cov, n = covariance(t, [*x, "__y"])
    scatter = cov * max(0, n - 1)
    a, b = scatter[:-1, :-1] + alpha * np.eye(len(x)), scatter[:-1, -1]
    try:
        w = np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        w = np.linalg.pinv(a) @ b
    return float(means[-1] - means[:-1] @ w), dict(zip(x, map(float, w), strict=True))


def predict_log_counts(fit: tuple[float, dict[str, float]]) -> Column:
    out = F.lit(fit[0])
    for c, w in fit[1].items():
        out = out + F.col(c) * w
    return F.when(F.expm1(out) < 0, 0.0).otherwise(F.expm1(out))
