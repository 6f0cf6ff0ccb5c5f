"""Clustering, the prefix trie and mixing against brute force, with odd rows, ties and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.llm.helpers import table
from zonalyx.llm import centroids, chat_format, license_scan, mixing, prefix_trie, warc
from zonalyx.operators import ranges

# -- clustering ---------------------------------------------------------------------------------


def lloyd(rows, k, rounds, dim, scale):
    """(id, cluster, distance) of every kept row, and the centroids, by full rounds."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        at = [min((gap(v, m), j) for j, m in enumerate(c)) for _, v in kept]
        if r < rounds:
            for j in range(len(c)):
                own = [v for (_, v), (_, o) in zip(kept, at, strict=True) if o == j]
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)] if own else c[j]
    return sorted(((i, j, d) for (i, _), (d, j) in zip(kept, at, strict=True)), key=str), [tuple(x) for x in c]


def vectors(n, dim, seed, spread_of=2.0):
    r = random.Random(seed)
    return [(k, [r.gauss(0, spread_of) for _ in range(dim)]) for k in range(n)]


ODD_VECTORS = [(900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None, 2.0, 3.0]), (904, [1.0, float("nan"), 2.0, 3.0]), (905, [float("inf"), 1.0, 2.0, 3.0]), (None, [0.5, 0.25, -0.5, 1.0]), (7, [0.1, 0.2, 0.3, 0.4])]


@pytest.mark.parametrize("rounds", [0, 1, 3, 8])
def test_clusters_against_full_rounds(spark, rounds):
    rows = vectors(150, 4, 3) + ODD_VECTORS + [(k, [1.0, 1.0, 1.0, 1.0]) for k in range(200, 260)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("mine") for c in ("id", "v", "owner", "was", "distance", "x")})
    found = centroids.cluster(d.repartition(5), k=6, rounds=rounds, dim=4, scale=8.0)
    want, c = lloyd(rows, 6, rounds, 4, 8.0)
    got = sorted(((r.id, r.cluster, r.distance) for r in centroids.digest(found).collect()), key=str)
    assert got == want and found.centroids == c


def test_clusters_of_few_rows_ties_and_none(spark):
    kind = "vec_id long, embedding array<double>"
    none = centroids.digest(centroids.cluster(spark.createDataFrame([], kind), dim=2))
    assert none.count() == 0 and none.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    same = centroids.digest(centroids.cluster(spark.createDataFrame([(k, [1.0, -1.0]) for k in range(9)], kind), k=4, dim=2)).collect()
    assert {r.cluster for r in same} == {0} and {r.inertia for r in same} == {0}
    few = centroids.cluster(spark.createDataFrame([(1, [0.0, 0.0]), (2, [5.0, 5.0])], kind), k=16, dim=2)
    assert len(few.centroids) == 2 and sum(few.counts) == 2
    with pytest.raises(PySparkException):
        centroids.cluster(spark.createDataFrame([(1, [1e300, 0.0])], kind), dim=2)


def test_large_components_are_exact(spark):
    rows = [(k, [float(r), float(-r)]) for k, r in enumerate([2**29, 2**29 - 1, -(2**29), 3, 2**21 + 1, -(2**27)])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want, c = lloyd(rows, 2, 2, 2, 1.0)
    found = centroids.cluster(d, k=2, rounds=2, dim=2, scale=1.0)
    assert sorted(((r.id, r.cluster, r.distance) for r in centroids.digest(found).collect()), key=str) == want and found.centroids == c


def test_a_round_compares_changed_centroids_only():
    x = np.arange(40, dtype=np.float64).reshape(-1, 2)
    c = np.array([[0, 1], [20, 21], [38, 39]])
    all_new = np.array([True] * 3)
    owner, distance = centroids.nearest(x, c, all_new, np.full(20, -1), np.zeros(20, np.int64))
    moved = c.copy()
    moved[1] = [26, 27]
    got = centroids.nearest(x, moved, np.array([False, True, False]), owner, distance)
    want = centroids.nearest(x, moved, all_new, np.full(20, -1), np.zeros(20, np.int64))
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


# -- prefix trie --------------------------------------------------------------------------------


def trie(rows, most=6, every=100):
    """Nodes of the rebuilt conversations, by a dictionary of all starts."""
    said = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            said[c].append((t, r or "", x or ""))
    key = lambda z: (z[0] is not None, z[0] or 0, hashlib.sha256(f"{len(z[1].encode())}:{z[1]}{z[2]}".encode()).digest())
    said = {c: [(r, x) for _, r, x in sorted(v, key=key)] for c, v in said.items()}
    whole = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % most
        whole[c] = said.get(c - int(math.fmod(c, every)), [])[:h] + said[c][h:]
    nodes, kids = defaultdict(list), defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + (len(nodes[k]) - 1) * (len(k[-1][1]) if k else 0)
    ends = lambda k: hashlib.sha256(",".join(str(c) for c in sorted(nodes[k]) if len(whole[c]) == len(k)).encode()).hexdigest()
    return sorted(((min(v), len(k), min(nodes[k[:-1]]) if k else None, len(v), len(kids[k]), leaves[k], saved[k], ends(k)) for k, v in nodes.items()), key=lambda r: r[:2])


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def spark_trie(spark, rows, every=100):
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("mine") for c in ("position", "row", "turn_sha", "tokens", "node", "depth", "base", "h")})
    c = F.col("conv_id")
    turns, ids = prefix_trie.rebuilt(prefix_trie.number_turns(d.repartition(3)), F.crc32(c.cast("string").cast("binary")) % 6, c - c % every, 5)
    return sorted((tuple(r[x] for x in COLUMNS) for r in prefix_trie.prefix_trie(turns, ids).collect()), key=lambda r: r[:2])


def test_trie_against_all_starts(spark, monkeypatch):
    monkeypatch.setattr(ranges, "MIN_HOT_ROWS", 4)
    monkeypatch.setattr(ranges, "HOT_SHARE", 8)
    r = random.Random(5)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", r.choice("abc") * (1 + t)) for c in range(-30, 230) for t in range(r.randrange(1, 8))]
    rows += [(c, t, "user", f"same {t}") for c in range(400, 460) for t in range(9)]  # copies, the last place differs for some
    rows += [(c, 9, "user", f"own {c % 3}") for c in range(400, 430)]
    rows += [(700, t, "user", "long") for t in range(300)] + [(701, t, "user", "long") for t in range(300)]
    rows += [(5, None, None, None), (6, None, "user", None), (7, 0, "user", "tie"), (7, 0, "user", "tie"), (7, 0, "a", "tie"), (None, 0, "user", "x"), (800, 0, "", ""), (801, 0, "u", "é" * 20_000)]
    assert spark_trie(spark, rows) == trie(rows)


def test_trie_of_turns_that_part_late_and_of_nothing(spark):
    rows = [(c, t, "user", "say" if t < 12 else f"{c}") for c in (1, 2, 3) for t in range(14)]
    assert spark_trie(spark, rows, every=1) == trie(rows, every=1)
    assert spark_trie(spark, []) == []
    turns = spark.createDataFrame([(1, 1, b"a", 3)], "conv_id long, position long, turn_sha binary, tokens long")
    got = prefix_trie.prefix_trie(turns, spark.createDataFrame([(1,), (2,)], "conv_id long"))
    assert sorted((r.conv_id, r.depth, r.n_convs, r.n_children, r.ends_sha256[:4]) for r in got.collect()) == [(1, 0, 2, 1, hashlib.sha256(b"2").hexdigest()[:4]), (1, 1, 1, 0, hashlib.sha256(b"1").hexdigest()[:4])]


def test_running_sums_over_torn_groups(spark):
    rows = [(k % 3 if k % 5 else 7, k, k % 11) for k in range(4000)]
    d = spark.createDataFrame(rows, "g long, o long, x long").repartition(6)
    got = ranges.running(d, ["g"], [F.col("o")], {"upto": F.col("x"), "n": F.lit(1).cast("long")}, "test").collect()
    sums, counts, want = Counter(), Counter(), []
    for g, o, x in sorted(rows):
        sums[g] += x
        counts[g] += 1
        want.append((g, o, x, sums[g], counts[g]))
    assert sorted((r.g, r.o, r.x, r.upto, r.n) for r in got) == want


# -- mixing -------------------------------------------------------------------------------------


def water(sizes, most=3.0):
    """Targets by source: rank by name with null last, caps and sharing again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        rate = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if rate * weight[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else rate * weight[s] for s in names}
        capped |= over


def test_mix_meets_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 40)
    monkeypatch.setattr(ranges, "MIN_HOT_ROWS", 50)
    r = random.Random(2)
    text = lambda n: " ".join(["w"] * n)
    rows = [(k, text(r.choice([1, 5, 20, 90])), r.choice(["a", "b", "b", "b", "b", "c", "d"])) for k in range(900)]
    rows += [(1000 + k, text(3), "tiny") for k in range(4)] + [(2000 + k, text(9), None) for k in range(30)]
    rows += [(3000, None, "c"), (3001, "", "c"), (3002, " \t\n", "empty"), (3003, None, "empty"), (None, text(7), "a"), (5, "x", "a"), (5, "x", "a"), (4000, "y" * 200_000 + " z", "é")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("mine") for c in ("id", "size", "block", "coin", "name", "named", "whole", "target", "n_docs")})
    got = mixing.mix(d.repartition(7)).collect()
    assert Counter((x.id, x.size) for x in got) == Counter((k, len((t or "").split())) for k, t, _ in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = water(sizes)
    taken, largest = Counter(), Counter()
    for x in got:
        taken[x.source] += x.taken
        largest[x.source] = max(largest[x.source], x.size)
        assert x.source_size == sizes[x.source] and abs(x.target - want[x.source]) < 1e-6 and x.taken == x.copies * x.size <= 3 * x.size
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(2, largest[s] / 2)
    again = mixing.mix(d.repartition(2)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mix_of_nothing_and_of_empty_texts(spark):
    kind = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], kind)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], kind)).collect()
    assert [(x.target, x.taken) for x in got] == [(0.0, 0), (0.0, 0)]


def test_flight_keeps_expectations():
    """Over many coins every document is taken as often as its probability says, and blocks keep tokens and number."""
    sizes, chances = [random.Random(1).choice([2, 9, 30, 31]) for _ in range(40)], [0.3] * 40
    hits = Counter()
    for seed in range(3000):
        r = random.Random(seed)
        left = list(mixing.flight(iter([(("s",), p, a, r.random(), (k, a)) for k, (p, a) in enumerate(zip(chances, sizes, strict=True))]), land=False))
        assert len([1 for _, p in left if 0 < p < 1]) <= mixing.RESERVE + 2
        assert abs(sum(p * row[1] for row, p in left) - 0.3 * sum(sizes)) < 1e-6 and abs(sum(p for _, p in left) - 12) < 1e-6
        hits.update({row[0]: p for row, p in left})
    assert all(abs(hits[k] / 3000 - 0.3) < 0.04 for k in range(40))


# -- licence scan and chat records ----------------------------------------------------------------


def test_runs_of_words_against_every_run(spark):
    """Texts that repeat parts of a template in every way, against all runs of consecutive words."""
    r = random.Random(12)
    templates = (("A", "one two three four five six seven eight nine ten eleven twelve"), ("B", "red blue red green blue red yellow black white red blue grey"))
    sets = {n: set(license_scan.bigram_set(t)) for n, t in templates}
    vocabulary = sorted({w for _, t in templates for w in t.split()}) + ["x", "y"]

    def text():
        out = []
        for _ in range(r.randrange(1, 9)):
            part = list(r.choice(templates)[1].split())
            for _ in range(r.randrange(3)):
                part[r.randrange(len(part))] = r.choice(vocabulary)
            out += part[r.randrange(4) : 12 - r.randrange(4)] + [r.choice(vocabulary) for _ in range(r.randrange(3))]
        return " ".join(out)

    texts = [text() for _ in range(250)]
    for threshold in (0.7, 0.9):
        got = {x.doc_id: (x.licenses, x.best_dice) for x in license_scan.scan_licenses(table(spark, texts), threshold=threshold, templates=templates).collect()}
        for k, t in enumerate(texts):
            g = [f"{a} {b}" for a, b in zip(t.split(), t.split()[1:], strict=False)]
            best = {n: max((2 * len(set(g[i:j]) & b) / (len(set(g[i:j])) + len(b)) for i in range(len(g)) for j in range(i + 1, len(g) + 1)), default=0) for n, b in sets.items()}
            assert got[k][0] == ",".join(sorted(n for n, x in best.items() if x >= threshold))
            if got[k][0]:
                whole = {n: 2 * len(set(g) & b) / (len(set(g)) + len(b)) for n, b in sets.items()}
                assert got[k][1] == pytest.approx(max(x if x >= threshold else best[n] for n, x in whole.items() if best[n] >= threshold))


def test_licence_scan_is_linear_in_a_text_that_repeats_a_changed_notice(spark):
    import time

    words_of = dict((n, t) for n, t in license_scan.TEMPLATES if len(t) > 400)["MIT"].split()
    took = []
    for size in (200_000, 2_000_000):
        for fixed in (True, False):
            out, n = [], 0
            while n < size:
                part = [(f"changed{0 if fixed else len(out) + k}" if k % 13 == 5 else w) for k, w in enumerate(words_of)]
                out += part
                n += sum(map(len, part)) + len(part)
            began = time.perf_counter()
            assert license_scan.scan_licenses(table(spark, [" ".join(out)])).first().n_units == 1
            took.append(time.perf_counter() - began)
    assert max(took[2:]) < 60


def test_records_whose_members_differ(spark):
    said = [
        '{"messages":[{"role":"system"},{"role":"user","content":"q"}]}',
        '{"messages":[{"role":"user","content":null},null,{"content":"a","role":"assistant","id":3}]}',
        '{"conversations":[{"from":"human"},{"value":"only value"}]}',
        '{"messages":[{"role":"user"}]}',
        '{"messages":[]}',
        '{"prompt":"p","messages":7,"completion":"c"}',
    ]
    rows = spark.createDataFrame(list(enumerate(said)), "id long, record string")
    got = sorted(((x.conv_id, x.turn, x.role, x.text) for x in chat_format.turns_from_json(rows, "record", "id").collect()), key=str)
    assert [g[1:] for g in got if g[0] == 0] == [(0, "system", ""), (1, "user", "q")]
    assert [g[3] for g in got if g[0] == 1][-1] == "a" and [g[2:] for g in got if g[0] == 2] == [("user", ""), ("", "only value")]
    assert [g[1:] for g in got if g[0] in (3, 4)] == [(None, None, None)] * 2


# -- archives -------------------------------------------------------------------------------------


def test_archives_of_pages_of_very_different_sizes(spark, tmp_path):
    sizes = [10] * 400 + [9_000] * 30 + [150_000] * 6 + [3_000_000]
    rows = [(k, f"http://x/{k}", chr(97 + k % 26) * n if k % 5 else "same" * (n // 4)) for k, n in enumerate(sizes)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    plan = warc.plan_records(d)
    path = warc.write_warc(plan, str(tmp_path / "w"), archive_bytes=200_000, mean_bytes=sum(sizes) / len(sizes), max_bytes=max(sizes))
    held = sorted(f.stat().st_size for f in (tmp_path / "w").glob("part-*"))
    assert held[-1] < 3_010_000 and held[-2] < 16 * 200_000 + 200_000 and len(held) < 80
    assert warc.read_warc(spark, path).count() == len(rows)
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(d).collect()}
    first = {}
    for k, _, html in rows:
        first.setdefault(html, k)
    assert got == {k: (len(h), "response" if first[h] == k else "revisit", None if first[h] == k else first[h]) for k, _, h in rows}
