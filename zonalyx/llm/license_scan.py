"""Licence scan: Dice coefficient over word bigrams against licence templates.

A document's units are its whole text, its blocks between blank lines and its
lines. Templates that no unit matches are looked for in every run of consecutive
words, so that a notice of several paragraphs inside other text, a wrapped sentence
or a block of a CRLF file is found too. A unit matches a template if 2|A and B| / (|A| + |B|) >= threshold for the
sets A, B of their word bigrams. Since |A and B| <= min(|A|, |B|), only templates
with threshold / (2 - threshold) <= |B| / |A| <= (2 - threshold) / threshold can
match; sizes outside every template's bounds end the comparison before it starts.
For the same reason a match shares threshold / (2 - threshold) of B at least, so it
holds one of a few anchor words without which too few of B's bigrams are left;
units without any anchor are not cut into words.

Runs of words are compared only where the whole text holds as many of B's bigrams as
a match needs. None has more distinct bigrams than B's bounds allow, and those that may
be best begin and end at few places (_best_run), so this is exact and linear in the text.

Everything is one projection: no shuffle, and a row holds no more than its document.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalyx.llm.license_templates import TEMPLATES

#: Words: digits, ASCII letters and whatever is outside ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
THRESHOLD = 0.9
#: A run is widened fourfold up to so many times, which is more than a value can hold.
WIDENED = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bigram_set(text: str) -> list[str]:
    words = [w.translate(str.maketrans(_UPPER, _LOWER)) for w in re.findall(WORD, text)]
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def size_bounds(size: int, threshold: float) -> tuple[int, int]:
    """Sizes that a set can have and still reach the threshold against one of this size."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


def anchors(sets: list[list[str]], threshold: float) -> list[str]:
    """Words of which every set that matches one of sets has at least one; the longest are taken first."""
    out: set[str] = set()
    for grams in sets:
        spare = len(grams) - math.ceil(len(grams) * threshold / (2 - threshold) - 1e-9)
        left = [g.split(" ") for g in grams]
        for word in sorted({w for g in left for w in g}, key=lambda w: (w not in out, -len(w), w)):
            if len(grams) - len(left) > spare:
                break
            if any(word in g for g in left):
                left = [g for g in left if word not in g]
                out.add(word)
    return sorted(w for w in out if not any(v != w and v in w for v in out))


def _let(value: Column, use) -> Column:
    """use(value), where value is computed once however often use names it."""
    return F.transform(F.array(value), use)[0]


def _pairs(words: Column) -> Column:
    low = F.transform(words, lambda w: F.translate(w, _UPPER, _LOWER))
    rest = F.greatest(F.size(low) - 1, F.lit(0))
    return _let(low, lambda v: F.zip_with(F.slice(v, 1, rest), F.slice(v, 2, rest), lambda a, b: F.concat(a, F.lit(" "), b)))


def _bigrams(words: Column) -> Column:
    return F.array_distinct(_pairs(words))


def _places(pairs: Column) -> Column:
    """(p, before, after, b) of each bigram b in order: its place and those of the same bigram before it (or -1) and after it (or the end)."""

    def linked(s: Column) -> Column:
        def one(e: Column, i: Column) -> Column:
            last, following = F.get(s, i - 1), F.get(s, i + 1)
            before = F.when(last["b"] == e["b"], last["p"]).otherwise(-1)
            after = F.when(following["b"] == e["b"], following["p"]).otherwise(F.size(s))
            return F.struct(e["p"].alias("p"), before.alias("before"), after.alias("after"), e["b"].alias("b"))

        return F.array_sort(F.transform(s, one))

    return _let(F.array_sort(F.transform(pairs, lambda b, i: F.struct(b.alias("b"), i.alias("p")))), linked)


def _best_run(places: Column, t: Column) -> Column:
    """The least -Dice of template t over all runs of consecutive words; null if no bigram is t's.

    Of the best runs take a shortest: its first bigram is one of t's and does not come
    again in it. Let it reach back over the block of t's bigrams that it begins in,
    which makes it no worse. So a run begins with a block, and ends before the last
    of the places where a bigram of the block comes next. These spans add up to the
    length of the text times the size of t at most, however often the text repeats.
    """

    def search(q: Column) -> Column:
        def run(block: Column) -> Column:
            start = block["p"]
            span = F.array_max(F.transform(F.slice(q, start + 1, block["length"]), lambda e: e["after"])) - start
            # bigrams that are new since the start; the bound is on these, however many repeats lie between
            new = lambda n: F.filter(F.slice(q, start + 1, F.least(n, span)), lambda e: e["before"] < start)
            wide = lambda k: (4 * t["hi"] * F.pow(F.lit(4), k)).cast("int")
            enough = lambda v, k: (F.size(v) >= t["hi"]) | (wide(k - 1) >= span)
            steps = F.aggregate(F.sequence(F.lit(1), F.lit(WIDENED)), new(4 * t["hi"]), lambda v, k: F.when(enough(v, k), v).otherwise(new(wide(k))))

            def step(z: Column, e: Column) -> Column:
                a, x = z["a"] + 1, z["x"] + e["hit"]
                return F.struct(a.alias("a"), x.alias("x"), F.least(z["less"], -2.0 * x / (a + F.size(t["grams"]))).alias("less"))

            return F.aggregate(F.slice(steps, 1, t["hi"]), F.struct(F.lit(0).alias("a"), F.lit(0).alias("x"), F.lit(0.0).alias("less")), step)["less"]

        hit = lambda e: F.coalesce(e["hit"], F.lit(0)) == 1
        starts = F.filter(q, lambda e, i: hit(e) & ~hit(F.get(q, i - 1)))
        ends = F.filter(q, lambda e, i: hit(e) & ~hit(F.get(q, i + 1)))
        blocks = F.zip_with(starts, ends, lambda a, b: F.struct(a["p"].alias("p"), (b["p"] - a["p"] + 1).alias("length")))
        return F.array_min(F.transform(blocks, run))

    return _let(
        F.transform(places, lambda e: F.struct(e["p"].alias("p"), e["before"].alias("before"), e["after"].alias("after"), F.array_contains(t["grams"], e["b"]).cast("int").alias("hit"))),
        search,
    )


def scan_licenses(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    threshold: float = THRESHOLD,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
) -> DataFrame:
    """One row per input row: id, n_units, n_matches, licenses, best_license, best_dice.

    n_units counts the whole text, its blocks and its lines; n_matches counts pairs of a
    unit and a template that match, and one for each template that no unit matches but
    a run of words does. licenses: identifiers of the matched templates, distinct, sorted, comma-joined
    (empty without a match). best_license is the one with the largest coefficient,
    of equal ones the first by name; null without a match. Null and empty texts
    have no units. Repeated rows are scanned each. Time is linear in the length of a
    text, whatever it repeats.
    """
    sets = [(name, bigram_set(text)) for name, text in templates]
    table = [(name, grams, *size_bounds(len(grams), threshold)) for name, grams in sets if grams]
    least, most = min(t[2] for t in table), max(t[3] for t in table)
    known = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(g).alias("grams"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(k).alias("k")) for k, (n, g, lo, hi) in enumerate(table)])
    every = F.lit(sorted({b for t in table for b in t[1]}))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    blocks = F.when(F.contains(text, F.lit("\n\n")), F.split(text, "\n\n+")).otherwise(F.array(F.lit("")))
    units = F.filter(F.array_distinct(F.concat(F.array(text), blocks, F.split(text, "\n"))), lambda u: u != "")
    marks = anchors([t[1] for t in table], threshold)

    def anchored(unit: Column) -> Column:
        low, out = F.lower(unit), F.lit(False)
        for word in marks:
            out = out | F.contains(low, F.lit(word))
        return out

    base = df.select(F.col(f"`{id_col}`").alias("id"), units.alias("all_units"), anchored(text).alias("any"), text.alias("text"))
    base = base.select(
        "id",
        F.size("all_units").alias("n_units"),
        F.when(F.col("any"), F.filter("all_units", anchored)).otherwise(F.array().cast("array<string>")).alias("units"),
        F.when(F.col("any"), F.col("text")).otherwise("").alias("text"),
    )
    # a set is never larger than its words less one: units with fewer words than any template allows end here
    words = F.filter(F.transform("units", lambda u: F.regexp_extract_all(u, F.lit(WORD), 0)), lambda w: F.size(w) > least)
    grams = F.filter(F.transform(words, _bigrams), lambda g: F.size(g).between(least, most))

    def compare(g: Column) -> Column:
        fits = F.filter(known, lambda t: F.size(g).between(t["lo"], t["hi"]))
        return F.transform(
            fits,
            lambda t: F.struct(
                (-2.0 * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + F.size(t["grams"]))).alias("less"),
                t["name"].alias("name"),
                t["k"].alias("k"),
            ),
        )

    def runs(pairs: Column, found: Column) -> Column:
        """The matches of runs of words with templates that are not among those found."""
        open_ = F.filter(known, lambda t: ~F.exists(found, lambda m: m["k"] == t["k"]))
        near = _let(F.array_intersect(pairs, every), lambda c: F.filter(open_, lambda t: F.size(F.array_intersect(c, t["grams"])) >= t["lo"]))
        search = lambda ts: _let(
            _places(pairs),
            lambda p: F.transform(ts, lambda t: F.struct(_best_run(p, t).alias("less"), t["name"].alias("name"), t["k"].alias("k"))),
        )
        return _let(near, lambda ts: F.when(F.size(ts) > 0, F.filter(search(ts), lambda m: m["less"] <= -threshold)).otherwise(F.slice(found, 1, 0)))

    found = F.filter(F.flatten(F.transform("grams", compare)), lambda m: m["less"] <= -threshold)
    got = base.select("id", F.col("n_units").cast("long").alias("n_units"), grams.alias("grams"), "text").select("id", "n_units", found.alias("found"), "text")
    pairs = _pairs(F.regexp_extract_all("text", F.lit(WORD), 0))
    both = _let(F.col("found"), lambda f: _let(pairs, lambda p: F.concat(f, runs(p, f))))
    got = got.select("id", "n_units", F.when(F.col("text") == "", F.col("found")).otherwise(both).alias("found"))
    best = F.array_min("found")
    return got.select(
        F.col("id").alias(id_col),
        "n_units",
        F.size("found").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda m: m["name"]))), ",").alias("licenses"),
        best["name"].alias("best_license"),
        (-best["less"]).alias("best_dice"),
    )
