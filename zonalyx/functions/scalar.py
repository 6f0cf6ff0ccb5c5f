"""Scalar functions as Column builders. NaN and infinities become NULL on the way in."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NULL for NaN and infinities."""
    d = x.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), None).otherwise(d)


def safe_number(text: Column, drop: str = ",$") -> Column:
    """The number in a text without the characters in drop; NULL if there is none."""
    return finite(F.trim(F.translate(text, drop, "")).try_cast("double"))


def safe_divide(n: Column, d: Column) -> Column:
    """n / d, NULL where d is NULL or 0."""
    return F.try_divide(n.cast("double"), F.nullif(d.cast("double"), F.lit(0.0)))


def safe_rate(n: Column, d: Column, per: float = 1.0) -> Column:
    """n / d * per, NULL where d is not positive."""
    return F.when(d > 0, n.cast("double") / d.cast("double") * per)


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """x within the bounds; NULL stays NULL."""
    out = x
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(high)).otherwise(out)
    return out


def bounded_proportion(n: Column, d: Column) -> Column:
    return clip(safe_divide(n, d), 0.0, 1.0)


def percent_to_proportion(x: Column) -> Column:
    return clip(finite(x) / 100.0, 0.0, 1.0)


def log1p_floor(x: Column) -> Column:
    return F.log1p(clip(x.cast("double"), 0.0))


def expm1_floor(x: Column) -> Column:
    return clip(F.expm1(x.cast("double")), 0.0)


def poisson_any(mu: Column) -> Column:
    """The probability of at least one event at the rate mu."""
    return 1 - F.exp(-clip(mu.cast("double"), 0.0))


# -- time ---------------------------------------------------------------------------------------


def month_key(x: Column) -> Column:
    """yyyy-MM of whatever a timestamp can be read from; NULL otherwise."""
    return F.date_format(F.try_to_timestamp(x.cast("string")), "yyyy-MM")


def month_ordinal(key: Column) -> Column:
    """Months since year 0 of a yyyy-MM key."""
    return F.substring(key, 1, 4).cast("int") * 12 + F.substring(key, 6, 2).cast("int") - 1


def month_of(ordinal: Column) -> Column:
    """The yyyy-MM key of an ordinal."""
    return F.format_string("%04d-%02d", F.floor(ordinal / 12).cast("int"), (F.pmod(ordinal, F.lit(12)) + 1).cast("int"))


def period_fields(key: Column) -> list[Column]:
    """year, month, period_start and period_end of a yyyy-MM key."""
    first = F.to_date(F.concat(key, F.lit("-01")))
    return [
        F.year(first).alias("year"),
        F.month(first).alias("month"),
        F.date_format(first, "yyyy-MM-dd").alias("period_start"),
        F.date_format(F.last_day(first), "yyyy-MM-dd").alias("period_end"),
    ]


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 3.6e9


def season(month: Column, shift: int = 0) -> list[Column]:
    """month_sin and month_cos of the angle 2 pi (month - shift) / 12."""
    angle = (month - shift) * (2 * math.pi / 12)
    return [F.sin(angle).alias("month_sin"), F.cos(angle).alias("month_cos")]


def month_indicators(month: Column) -> list[Column]:
    """month_2 to month_12; January is the base."""
    return [(month == m).cast("int").alias(f"month_{m}") for m in range(2, 13)]


def horizon_features(h: Column, bands: int = 2) -> list[Column]:
    """log1p(h) and its sine and cosine at the scales 2 ** k."""
    x = F.log1p(h.cast("double"))
    out = [x.alias("h_log")]
    for k in range(bands):
        out += [F.sin(x / float(2**k)).alias(f"h_sin_{k}"), F.cos(x / float(2**k)).alias(f"h_cos_{k}")]
    return out


# -- text ---------------------------------------------------------------------------------------

#: Accented letters and what they fold to.
ACCENTED = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿœæ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyoa"


def fold(text: Column) -> Column:
    """Lower case, accents and odd blanks and dashes folded, white space collapsed."""
    t = F.translate(F.lower(text), ACCENTED, PLAIN)
    t = F.regexp_replace(t, "[‐-―−]", "-")
    return F.trim(F.regexp_replace(t, r"[\s ]+", " "))


def normal_name(name: str) -> str:
    """A column name in lower case with other characters folded or turned to _."""
    import re
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFKD", name.strip()) if not unicodedata.combining(c))
    return re.sub(r"[^0-9a-z]+", "_", plain.lower()).strip("_")


def keyword_family(text: Column, families: list[tuple[str, list[str]]], other: str = "other") -> Column:
    """The first family one of whose substrings the text has."""
    out = None
    for name, words in families:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.coalesce(out.otherwise(other) if out is not None else F.lit(other), F.lit(other))


def decimal_id(x: Column) -> Column:
    """An id as text with two decimals."""
    return F.format_string("%.2f", x.cast("string").try_cast("double"))


def code_id(x: Column, width: int = 4) -> Column:
    """The last digits of an id, padded with zeros; a trailing .0 is dropped first."""
    digits = F.regexp_replace(F.regexp_replace(F.trim(x.cast("string")), r"\.0+$", ""), r"\D", "")
    return F.when(digits != "", F.lpad(F.right(digits, F.lit(width)), width, "0"))


def is_mojibake(text: Column) -> Column:
    """Whether a text shows the marks of UTF-8 read as Latin-1."""
    return F.coalesce(text.rlike("[ÃÂ�]"), F.lit(False))


def better_name(*names: Column) -> Column:
    """The first that is neither blank nor mojibake, else the first that is not blank."""
    good = [F.when((F.trim(n) != "") & ~is_mojibake(n), n) for n in names]
    return F.coalesce(*good, *[F.when(F.trim(n) != "", n) for n in names])


def split_suffix(text: Column, suffixes: list[str]) -> tuple[Column, Column]:
    """(what stands before, the suffix) for the first of suffixes the text ends with; the suffix is NULL if none."""
    body, tail = F.trim(text), F.lit(None).cast("string")
    for s in reversed(suffixes):
        hit = F.endswith(F.trim(text), F.lit(" " + s))
        body = F.when(hit, F.trim(F.substr(F.trim(text), F.lit(1), F.length(F.trim(text)) - len(s)))).otherwise(body)
        tail = F.when(hit, F.lit(s)).otherwise(tail)
    return body, tail


#: Ordinal class labels and their scores.
CLASS_SCORES = {"none": 0, "very_low": 1, "low": 2, "moderate": 3, "high": 4, "very_high": 5}


def class_score(label: Column) -> Column:
    """The score of an ordinal label; NULL for unknown ones."""
    key = F.regexp_replace(F.trim(F.lower(label)), r"[\s\-]+", "_")
    return F.coalesce(*[F.when(key == k, v) for k, v in CLASS_SCORES.items()])


def orient_rank(x: Column, name: str) -> Column:
    """Minus the column if its name says rank and not percentile, so that larger is always worse."""
    return -x if "rank" in name.lower() and "percentile" not in name.lower() else x


def share_colour(x: Column, colours: tuple[str, ...] = ("#ffffb2", "#fecc5c", "#fd8d3c", "#f03b20", "#bd0026")) -> Column:
    """A colour per equal step of 0 .. 1; NULL is grey."""
    step = F.least(F.floor(x * len(colours)), F.lit(len(colours) - 1)).cast("int") + 1
    return F.when(x.isNull(), "#cccccc").otherwise(F.element_at(F.array(*map(F.lit, colours)), step))


# -- space --------------------------------------------------------------------------------------


def grid_id(x: Column, y: Column, size: int = 25) -> Column:
    """grid<size>m_<x0>_<y0> of the cell that holds a point; exact for negative coordinates."""
    low = lambda c: (F.floor(c / size) * size).cast("long").cast("string")
    return F.concat(F.lit(f"grid{size}m_"), low(x), F.lit("_"), low(y))


def grid_corner(cell: Column) -> tuple[Column, Column]:
    pattern = r"^grid\d+m_(-?\d+)_(-?\d+)$"
    return F.regexp_extract(cell, pattern, 1).cast("long"), F.regexp_extract(cell, pattern, 2).cast("long")


def grid_ring(cell: Column, size: int = 25) -> Column:
    """The closed ring of a cell's square."""
    x, y = (c.cast("double") for c in grid_corner(cell))
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return F.array(point(x, y), point(x + size, y), point(x + size, y + size), point(x, y + size), point(x, y))


def _cross(ring: Column, f, near: bool = False) -> Column:
    """Sum of f(p, q) over a ring's edges; near: points count from the ring's first one, which keeps small rings far from 0 exact."""
    n = F.size(ring)
    if near:
        ring = F.transform(ring, lambda p: F.struct((p["x"] - ring[0]["x"]).alias("x"), (p["y"] - ring[0]["y"]).alias("y")))
    pairs = F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), f)
    return F.aggregate(pairs, F.lit(0.0), lambda a, v: a + v)


def ring_signed_area(ring: Column) -> Column:
    """Positive if the ring turns left."""
    return _cross(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"], near=True) / 2


def ring_area(ring: Column) -> Column:
    return F.abs(ring_signed_area(ring))


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    twice = _cross(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"], near=True)
    cx = _cross(ring, lambda p, q: (p["x"] + q["x"]) * (p["x"] * q["y"] - q["x"] * p["y"]), near=True)
    cy = _cross(ring, lambda p, q: (p["y"] + q["y"]) * (p["x"] * q["y"] - q["x"] * p["y"]), near=True)
    return ring[0]["x"] + cx / (3 * twice), ring[0]["y"] + cy / (3 * twice)


def ring_bounds(ring: Column) -> list[Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return [F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y")]


def ring_valid(ring: Column) -> Column:
    """Closed, of four points at least, with an area."""
    return F.coalesce((F.size(ring) >= 4) & (F.element_at(ring, 1) == F.element_at(ring, -1)) & (ring_area(ring) > 0), F.lit(False))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is inside, by ray casting; of the boundary, lower and left edges count as inside."""
    crosses = lambda p, q: F.when(
        ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]),
        1.0,
    ).otherwise(0.0)
    return _cross(ring, crosses) % 2 == 1


def spatial_weight(distance: Column, kind: str = "binary", bandwidth: float = 1.0) -> Column:
    if kind == "binary":
        return F.lit(1.0)
    if kind == "inverse":
        return 1.0 / F.greatest(distance, F.lit(1e-6))
    if kind == "rbf":
        return F.exp(-distance / bandwidth)
    raise ValueError(f"unknown weighting {kind!r}")


def pair_id(a: Column, b: Column) -> Column:
    return F.concat_ws("__", F.least(a, b), F.greatest(a, b))


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:4326 degrees to EPSG:3857 metres."""
    r = 6378137.0
    return F.radians(lon) * r, F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * r
