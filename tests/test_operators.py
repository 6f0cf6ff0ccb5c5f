import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonalyx.functions import scalar as s
from zonalyx.functions import windows as w
from zonalyx.operators import aggregates as ag
from zonalyx.operators import frames as fr
from zonalyx.operators import graph as g
from zonalyx.operators import index as ix
from zonalyx.operators import metrics as me
from zonalyx.operators import splits as sp
from zonalyx.operators import validate as va
from zonalyx.sources import tables as src


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_percentile_rank_nulls_ties_and_one_row(spark):
    d = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 5.0), (4, None)], "k int, v double")
    got = dict(values(w.percentile_rank(d, "v", "p"), "k", "p"))
    assert got == {1: 0.0, 2: 0.0, 3: 1.0, 4: None}
    assert values(w.percentile_rank(d.where("k = 3"), "v", "p"), "p") == [(0.0,)]
    assert w.percentile_rank(d.where("k > 9"), "v", "p").count() == 0
    assert dict(values(w.competition_rank(d, "v", "r"), "k", "r")) == {1: 2, 2: 2, 3: 1, 4: 4}


def test_rank_over_ranges_is_the_same_as_one_window(spark, monkeypatch):
    d = spark.range(500).select("id", (F.col("id") * 37 % 91).cast("double").alias("v"))
    for method in ("min", "max", "average", "dense"):
        for ascending in (True, False):
            want = dict(values(w.rank_over(d, "v", "r", ascending=ascending, method=method), "id", "r"))
            monkeypatch.setattr(w, "SINGLE_WINDOW_ROWS", 10)
            got = dict(values(w.rank_over(d, "v", "r", ascending=ascending, method=method), "id", "r"))
            monkeypatch.undo()
            assert got == want


def test_additive_index_golden_scores(spark):
    rows = [("A", 90000.0, 0.05, 0.0), ("B", 30000.0, 0.30, 0.8), ("C", 60000.0, 0.15, 0.4), ("D", 45000.0, 0.20, 0.6), ("E", 75000.0, 0.10, 0.1)]
    d = spark.createDataFrame(rows, "zone_id string, income double, old double, flood double")
    r = ix.Recipe("dummy", (ix.Variable("income", "negative", 0.4), ix.Variable("old", "positive", 0.3), ix.Variable("flood", "positive", 0.3)))
    got = dict(values(ix.additive_index(d, r), "zone_id", "score"))
    assert {k: round(v, 6) for k, v in got.items()} == {"A": 0.0, "B": 1.0, "C": 0.47, "D": 0.705, "E": 0.1975}
    with pytest.raises(fr.ContractError):
        ix.additive_index(d.withColumn("old", F.lit(None).cast("double")), r)


def test_normalise_and_impute(spark):
    d = spark.createDataFrame([(10.0, 1.0), (20.0, 1.0), (30.0, None)], "a double, b double")
    assert [round(x[0], 6) for x in values(ix.normalise(d, ["a"]), "a")] == [0, 0.5, 1]
    assert values(ix.normalise(d, ["b"]), "b") == [(0.0,), (0.0,), (None,)]
    got, used = ix.impute(d, ["b"], "median")
    assert used == {"b": 1.0} and values(got, "b", "b__missing_flag")[2] == (1.0, True)


def test_factor_index(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 2))
    rows = [(str(i), float(a), float(a + 0.1 * b), float(b), 3.0) for i, (a, b) in enumerate(x)]
    d = spark.createDataFrame(rows, "zone_id string, p double, q double, r double, flat double")
    r = ix.Recipe("f", tuple(ix.Variable(c) for c in ("p", "q", "r", "flat")), missing="median", flags=False)
    out, fit = ix.factor_index(d, r, keep=2)
    assert fit["dropped"] == ["flat"] and fit["loadings"].shape == (3, 2)
    f = np.array(values(out, "factor_1", "factor_2", "score"))
    assert np.allclose(f[:, 0] + f[:, 1], f[:, 2]) and np.allclose(f.mean(0), 0, atol=1e-9)
    with pytest.raises(fr.ContractError):
        ix.principal_factors(np.eye(2), 5)
    turned = ix.rotate(fit["unrotated"])
    assert turned.converged and np.allclose(turned.loadings, fit["loadings"]) and np.allclose((turned.loadings**2).sum(1), (fit["unrotated"] ** 2).sum(1))
    rows = ix.factor_summary(fit)
    assert len(rows) == 2 and rows[0]["leading"].count(":") == 3 and not rows[0]["configured"]
    with pytest.raises(fr.ContractError):
        ix.factor_index(d, r, keep=2, orientation={1: "positive"}, unconfigured="error")
    with pytest.raises(fr.ContractError):
        ix.factor_index(d, r, keep=2, orientation={1: {"method": "anchor", "anchor": "flat"}})
    flipped, _ = ix.factor_index(d, r, keep=2, orientation={1: "negative", 2: "absolute"})
    h = np.array(values(flipped, "factor_1", "factor_2"))
    assert np.allclose(h[:, 0], -f[:, 0]) and np.allclose(h[:, 1], np.abs(f[:, 1]))


def test_segments_and_softmax(spark):
    d = spark.createDataFrame(list(zip([0, 0, 2, 2, 2, 4], [1.0, 3.0, -2.0, 4.0, 6.0, 5.0], strict=True)), "seg int, v double")
    got = sorted(values(g.segments(d, "seg", "v", 5), "segment", "sum", "mean", "max", "n"))
    assert [x[1] for x in got] == [4, 0, 8, 0, 5] and [x[3] for x in got] == [3, 0, 6, 0, 5] and [x[4] for x in got] == [2, 0, 3, 0, 1]
    assert math.isclose(got[2][2], 8 / 3)
    sums = g.softmax(d, "v", ["seg"], "p").groupBy("seg").agg(F.sum("p").alias("s"))
    assert all(math.isclose(x[0], 1.0) for x in values(sums, "s"))


def test_joins_and_grids(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    right = spark.createDataFrame([(1, 5), (1, 6)], "k int, x int")
    with pytest.raises(fr.ContractError):
        fr.left_join(left, right, ["k"])
    p = spark.createDataFrame([("z", "2020-01", 1), ("z", "2020-03", 3)], "zone string, period string, y int")
    full = fr.complete_grid(p, "zone", "period", start="2020-01", end="2020-03", zeros=["y"])
    assert sorted(values(full, "period", "y")) == [("2020-01", 1), ("2020-02", 0), ("2020-03", 3)]
    assert dict(values(fr.lag_join(p, "zone", "period", "y", 1, "before"), "period", "before")) == {"2020-01": None, "2020-03": None}


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(np.concatenate([rng.normal(0, 1, (60, 2)), rng.normal(500, 1, (3, 2))]))]
    got = sorted(values(fr.nearest(spark.createDataFrame(pts, "id int, x double, y double"), "id", "x", "y", 5), "source", "knn_rank", "target"))
    want = []
    for i, a, b in pts:
        near = sorted((math.hypot(a - c, b - e), j) for j, c, e in pts if j != i)[:5]
        want += [(i, k + 1, j) for k, (_, j) in enumerate(near)]
    assert got == sorted(want)


def test_nearest_of_crowds_and_copies(spark):
    rng = np.random.default_rng(4)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(np.concatenate([rng.normal(0, 1e-4, (80, 2)), np.zeros((30, 2)), [[1e6, 1e6], [-3e5, 2.0]]]))]
    got = sorted(values(fr.nearest(spark.createDataFrame(pts, "id int, x double, y double"), "id", "x", "y", 3), "source", "knn_rank", "target"))
    want = []
    for i, a, b in pts:
        near = sorted((math.hypot(a - c, b - e), j) for j, c, e in pts if j != i)[:3]
        want += [(i, k + 1, j) for k, (_, j) in enumerate(near)]
    assert got == sorted(want)


def test_kendall_against_pairs(spark):
    rng = np.random.default_rng(5)
    data = [(g_, str(k), float(rng.integers(0, 6)), float(rng.integers(0, 9))) for g_ in ("a", "b") for k in range(40)] + [("c", "1", 1.0, 2.0), ("d", "1", 1.0, 1.0), ("d", "2", 1.0, 2.0)]
    got = dict(values(me.kendall(spark.createDataFrame(data, "s string, k string, observed double, predicted double"), ["s"], "k"), "s", "kendall"))
    for name in "abcd":
        z = [(y, p) for s_, _, y, p in data if s_ == name]
        sign = lambda v: (v > 0) - (v < 0)
        pairs = [(sign(a[0] - b[0]), sign(a[1] - b[1])) for i, a in enumerate(z) for b in z[:i]]
        bottom = math.sqrt(sum(abs(x) for x, _ in pairs) * sum(abs(x) for _, x in pairs))
        assert got.get(name) == (None if not bottom else pytest.approx(sum(x * y for x, y in pairs) / bottom))


def test_interval_join_keeps_every_left_row(spark):
    left = spark.createDataFrame([(1, "u", 5), (2, "v", 5), (3, "u", 12), (4, "u", 30), (5, None, 5)], "id int, k string, at int")
    right = spark.createDataFrame([("u", 10, 20, "a"), ("u", 11, None, "b"), ("u", 40, 39, "c")], "k string, s int, e int, name string")
    for bucket in (None, 4.0):
        got = sorted(values(fr.interval_join(left, right, ["k"], "at", "s", "e", bucket), "id", "name"), key=str)
        assert got == [(1, None), (2, None), (3, "a"), (3, "b"), (4, "b"), (5, None)]


def test_feature_table_codes(spark):
    d = spark.createDataFrame([("A", 50.0, 0.2, 1), ("B", 0.5, 0.4, 1), ("B", -0.1, None, 1)], "z string, share double, pct double, one int")
    got = {(r.code, r.column): r.severity for r in va.feature_table(d, "z", {"share": "proportion", "pct": "percentage", "one": "number"}, strategy="median").collect()}
    assert got == {
        ("duplicate_spatial_ids", "z"): "error",
        ("negative_values_for_nonnegative_variable", "share"): "warning",
        ("proportion_out_of_range", "share"): "warning",
        ("suspicious_percentage_scale", "share"): "warning",
        ("missing_values_detected", "pct"): "warning",
        ("high_missingness", "pct"): "warning",
        ("suspicious_proportion_scale", "pct"): "warning",
        ("constant_column", "one"): "warning",
    }
    assert [r.code for r in va.feature_table(d, "nope", {}).collect()] == ["missing_spatial_id_column"]
    part = {r.code: r.severity for r in va.rank_index_table(d, "z", {"gone": "number"}, population="z", partial=True).collect()}
    assert part["missing_required_variable_partial_svi_like"] == "warning" and part["nonnumeric_population_column"] == "error"


def _ring(*xy):
    return [{"x": float(x), "y": float(y)} for x, y in xy]


def test_polygons_with_holes_and_bays(spark):
    from zonalyx.operators import spatial as sl
    from zonalyx.operators.planar import region

    outer, hole = _ring((0, 0), (10, 0), (10, 10), (0, 10), (0, 0)), _ring((3, 3), (3, 6), (6, 6), (6, 3), (3, 3))
    bay = _ring((20, 0), (30, 0), (30, 10), (25, 2), (20, 10), (20, 0))
    kind = "zone string, rings array<array<struct<x: double, y: double>>>"
    z = spark.createDataFrame([("a", [outer, hole]), ("b", [bay]), ("c", [_ring((10, 0), (20, 0), (20, 10), (10, 10), (10, 0))]), ("n", None)], kind)
    pts = [(1, 1.0, 1.0), (2, 4.0, 4.0), (3, 25.0, 5.0), (4, 21.0, 5.0), (5, 10.0, 5.0), (6, 3.0, 4.0), (7, None, 1.0), (8, 10.0, 10.0), (9, 99.0, 9.0)]
    got = {r.k: (r.zone, r.method, r.n_zones) for r in sl.point_in_polygon(spark.createDataFrame(pts, "k int, x double, y double"), z, "k", "zone").collect()}
    assert got == {1: ("a", sl.WITHIN, 1), 2: (None, sl.UNMATCHED, 0), 3: (None, sl.UNMATCHED, 0), 4: ("b", sl.WITHIN, 1), 5: ("a", sl.FALLBACK, 2), 6: ("a", sl.FALLBACK, 1), 7: (None, sl.UNMATCHED, 0), 8: ("a", sl.FALLBACK, 2), 9: (None, sl.UNMATCHED, 0)}
    assert sorted(values(sl.adjacent(z, "zone"), "source", "target")) == [("a", "c"), ("b", "c"), ("c", "a"), ("c", "b")]
    assert sorted(values(sl.adjacent_by_length(z, "zone"), "source", "target", "shared_length")) == [("a", "c", 10.0), ("b", "c", 10.0)]
    assert region([outer, hole], [outer, hole])[1] == pytest.approx(91) and region([bay], [bay])[1] == pytest.approx(60)
    assert region([outer, hole], [_ring((2, 2), (2, 5), (5, 5), (5, 2), (2, 2))])[1] == pytest.approx(5)
    assert region([bay], [_ring((22, 5), (28, 5), (28, 10), (22, 10), (22, 5))])[1] == pytest.approx(_bay_above())
    ok = z.where("rings is not null").select("zone", sl.valid_polygon(F.col("rings")).alias("v"))
    assert dict(values(ok, "zone", "v")) == {"a": True, "b": True, "c": True}


def _bay_above():
    """Area of the bay's two towers within x 22 .. 28 and y 5 .. 10: the towers' inner sides are lines from (25, 2) to (20, 10) and (30, 10)."""
    # at height y a tower reaches from its outer side to 25 - 5 (y - 2) / 8; within x >= 22 that ends where the line meets 22, at y = 6.8
    return 2 * (25 - 5 * (5 - 2) / 8 - 22) * (6.8 - 5) / 2


def test_projections_at_their_origins(spark):
    from zonalyx.functions import projections as sl

    at = lambda f, lon, lat: spark.range(1).select(*[c.alias(n) for c, n in zip(f(F.lit(lon), F.lit(lat)), "xy", strict=True)]).first()
    x, y = at(sl.lambert_conic, -91.866666666666667, 63.390675)
    assert abs(x - 6_200_000) < 1e-6 and abs(y - 3_000_000) < 1e-6
    x, y = at(sl.transverse_mercator, -73.5, 0.0)
    assert abs(x - 304_800) < 1e-6 and abs(y) < 1e-6
    # a degree of the meridian at 45.5 is 111,141 m, and the quarter meridian 10,001,966 m
    (_, a), (_, b), (_, pole) = at(sl.transverse_mercator, -73.5, 45.0), at(sl.transverse_mercator, -73.5, 46.0), at(sl.transverse_mercator, -73.5, 90.0)
    assert abs((b - a) / 0.9999 - 111_141) < 20 and abs(pole / 0.9999 - 10_001_965.729) < 1e-2


def test_rewired_graph_keeps_degrees_and_changes(spark):
    from collections import Counter

    e = [(a, b) for a in range(30) for b in range(a + 1, 30) if (a * b + a + b) % 11 == 0]
    d = spark.createDataFrame([*e, (3, 3), (e[0][1], e[0][0])], "source long, target long")
    got = values(g.rewire(d, rounds=4), "source", "target")
    degree = lambda es: Counter(x for p in es for x in p)
    assert degree(got) == degree(e) and len(set(got)) == len(e) and all(a < b for a, b in got) and len(set(got) - set(e)) > len(e) // 10


def test_message_passing(spark):
    n = spark.range(6).withColumnRenamed("id", "node_id")
    e = spark.createDataFrame([(0, 1, 2.0), (0, 1, 4.0), (2, 2, 1.0), (3, 4, 5.0)], "source long, target long, h double")
    assert sorted(values(g.target_aggregate(e, n, ["h"]), "node_id", "n_in", "h_sum", "h_mean")) == [(0, 0, 0, 0), (1, 2, 6, 3), (2, 1, 1, 1), (3, 0, 0, 0), (4, 1, 5, 5), (5, 0, 0, 0)]
    near = g.neighbour_mean(e.withColumn("edge_weight", F.lit(1.0)).drop("h"), n.withColumn("y", F.col("node_id") * 1.0), ["y"])
    assert sorted(values(near, "node_id", "y_near")) == [(0, 0), (1, 0), (2, 2), (3, 0), (4, 3), (5, 0)]
    with pytest.raises(Exception, match="unknown relation"):
        g.encode_relations(spark.createDataFrame([("rumour",)], "relation string")).collect()
    h = spark.createDataFrame([(1.0, 2.0, True, False), (None, 3.0, True, None)], "a double, b double, am boolean, bm boolean")
    got = values(h.select(*[g.pool_history(["a", "b"], ["am", "bm"], k, 9.0).alias(k) for k in ("last_valid", "masked_mean", "masked_max")]), "last_valid", "masked_mean", "masked_max")
    assert got == [(1.0, 1.0, 1.0), (9.0, 9.0, 9.0)]


def test_no_folder_of_one_machine_on_a_cluster(spark, monkeypatch):
    from zonalyx.operators import store

    assert store.shared_dir(spark)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://elsewhere:7077")
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            store.shared_dir(spark)


def test_metrics_edge_cases(spark):
    d = spark.createDataFrame([("g", "a", 1.0, 1.0), ("g", "b", 2.0, 2.0), ("g", "c", 3.0, None)], "s string, k string, observed double, predicted double")
    r = me.finite_pairs(d).groupBy("s").agg(*me.regression()).first()
    assert r.mae == 0 and r.n == 2
    assert me.kendall(d, ["s"], "k").first().kendall == 1.0
    one = d.withColumn("label", F.lit(1))
    assert me.auroc(one.where("predicted is not null"), ["s"], "label", "predicted").first().auroc is None


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "source long, target long")
    assert sorted(values(g.connected(e), "node", "component")) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)]
    n = spark.createDataFrame([(i, 0, "train") for i in range(1, 4)], "node_id long, m int, split string")
    x = e.withColumn("edge_type", F.lit("knn")).withColumn("edge_weight", F.lit(1.0))
    assert dict(values(va.edges(x, n), "check", "n"))["unknown_ends"] == 2


def test_text_and_numbers(spark):
    d = spark.createDataFrame([(" $1,234.50 ", "Côte–d’Or  X"), ("n/a", None)], "a string, b string")
    assert values(d.select(s.safe_number(F.col("a")).alias("x")), "x") == [(1234.5,), (None,)]
    assert values(d.select(s.fold(F.col("b")).alias("x")), "x") == [("cote-d’or x",), (None,)]
    assert values(d.select(s.safe_divide(F.lit(1), F.lit(0)).alias("x")), "x")[0] == (None,)


def test_splits(spark):
    d = spark.range(101).withColumn("x", F.col("id") * 7 % 50).withColumn("y", F.col("id") * 13 % 50)
    n = dict(values(sp.random_rows(d, "id").groupBy("split").count(), "split", "count"))
    assert n == {"train": 71, "validation": 15, "test": 15}
    b = sp.spatial_blocks(d, "id", "x", "y")
    assert b.groupBy("block").agg(F.count_distinct("split").alias("k")).agg(F.max("k")).first()[0] == 1


def test_sources_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("a;b", 1), ("é", 2)], "name string, n int")
    src.write_both(d, str(tmp_path / "t"))
    assert src.read_table(spark, str(tmp_path / "t.parquet")).count() == 2
    got = src.read_csv(spark, str(tmp_path / "t.csv"), ["name"])
    assert sorted(values(got, "name")) == [("a;b",), ("é",)]
    (tmp_path / "l.csv").write_bytes("nom;n\nétat;1\n".encode("latin-1"))
    assert values(src.read_csv_probed(spark, str(tmp_path / "l.csv")), "nom", "n") == [("état", "1")]
    ring = spark.createDataFrame([("grid25m_0_-25",)], "cell string").withColumn("rings", F.array(s.grid_ring(F.col("cell"))))
    src.write_geojson(ring, str(tmp_path / "g"), "rings", ["cell"])
    assert src.read_geojson(spark, str(tmp_path / "g" / "features"), multi_line=False).first().rings[0][2].x == 25.0
    src.feature_collection(ring, str(tmp_path / "c.geojson"), "rings", ["cell"], "EPSG:3347")
    assert src.read_table(spark, str(tmp_path / "c.geojson")).first().crs == "EPSG:3347"
    # a Latin-1 byte after the first 64 KB, a quoted line feed, and rows of the wrong length
    late = "a,b\n" + "x,1\n" * 40_000 + '"fi\nn",é\nshort\nlong,1,2\n'
    (tmp_path / "late.csv").write_bytes(late.encode("latin-1"))
    got = src.read_csv_probed(spark, str(tmp_path / "late.csv"), corrupt="bad")
    assert got.count() == 40_003 and sorted(values(got.where("a <> 'x'"), "a", "b")) == [("fi\nn", "é"), ("long", "1"), ("short", None)]
    assert len(values(got.where("bad is not null"), "a", "bad")) == 2
    assert src.fingerprint({"b": 1, "a": 2}) == src.fingerprint({"a": 2, "b": 1})
    src.write_text(str(tmp_path / "r" / "x.md"), src.report("t", d, ["n"]))
    assert "| é | 2 |" in (tmp_path / "r" / "x.md").read_text()


def test_aggregates(spark):
    d = spark.createDataFrame([(1, None, None), (1, 2.0, 0.0), (2, 4.0, 1.0)], "k int, v double, w double")
    got = dict(values(d.groupBy("k").agg(ag.weighted_mean(F.col("v"), F.col("w")).alias("m")), "k", "m"))
    assert got == {1: 2.0, 2: 4.0}
    with pytest.raises(fr.ContractError):
        ag.reconcile(d.withColumn("x", F.col("v") + 1), ["v", "x"], "v")
    assert dict(values(ag.missingness(d), "column", "missing")) == {"k": 0, "v": 1, "w": 1}


def test_stream_equals_batch(spark, tmp_path):
    from zonalyx.streaming import events as st

    e = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,id) as ts, if(id % 2 = 0, 'a', 'b') as kind, cast(id as double) as value from range(72)")
    e.write.parquet(str(tmp_path / "e"))
    q = st.daily_counts(st.read_stream(spark, str(tmp_path / "e"), e.schema), "ts", "kind", "value").writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, st.daily_counts(e, "ts", "kind", "value").collect()))


def test_windows_of_a_stream_equal_batch(spark, tmp_path):
    from zonalyx.streaming import events as st

    e = spark.sql("select timestamp'2024-01-30 00:00:00' + make_interval(0,0,0,0,id * (1 + id % 3)) as ts, concat('u', id % 4) as user from range(90)")
    # the last row closes all windows before it
    e = e.union(spark.sql("select timestamp'2025-01-01 00:00:00', 'late'"))
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    for name, f in {"months": lambda d: st.monthly_counts(d, "ts", "user"), "sliding": lambda d: st.sliding_counts(d, "ts"), "sessions": lambda d: st.sessions(d, "ts", "user")}.items():
        mode = "complete" if name == "months" else "append"
        q = f(st.read_stream(spark, str(tmp_path / "e"), e.schema)).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        want = f(e if name == "months" else e.where("user <> 'late'")).collect()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, want)), name


def test_segments_refuse_ids_outside(spark):
    for bad in (-1, 3):
        d = spark.createDataFrame([(0, 1.0), (bad, 2.0)], "seg int, v double")
        with pytest.raises(Exception, match="outside 0 .. 2"):
            g.segments(d, "seg", "v", 3).collect()
    d = spark.createDataFrame([(0, 1.0), (None, 2.0)], "seg int, v double")
    assert sorted(values(g.segments(d, "seg", "v", 2), "segment", "n")) == [(0, 1), (1, 0)]


def test_placebo_edges_keep_source_degrees(spark):
    # month 0 has 2 nodes, month 1 has 5, month 2 has 1
    n = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1), (7, 2)], "node_id long, m int")
    pairs = [(a, b, 1.0) for a in range(2) for b in range(2) if a != b] + [(a, b, 0.5) for a in range(2, 7) for b in range(2, 7) if a != b] + [(0, b, 1.0) for b in range(2, 7)] + [(7, 7, 1.0)]
    e = spark.createDataFrame(pairs, "source long, target long, edge_weight double")
    month = lambda k: (k > 1) + (k > 6)
    for seed in range(5):
        got = values(g.placebo_edges(e, n, "m", seed), "source", "target", "edge_weight")
        assert all(s_ != t for s_, t, _ in got)
        want = [(a, month(b), x) for a, b, x in pairs if a != 7]
        assert sorted((a, month(b), x) for a, b, x in got) == sorted(want)
    # every other node of the month can be drawn
    many = spark.range(400).select(F.lit(4).cast("long").alias("source"), (F.col("id") % 5 + 2).alias("target"), F.lit(1.0).alias("edge_weight"))
    drawn = {t for seed in range(8) for (t,) in values(g.placebo_edges(many, n, "m", seed).distinct(), "target")}
    assert drawn == {2, 3, 5, 6}
