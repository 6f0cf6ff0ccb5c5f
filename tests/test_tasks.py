"""Sorts and hashes of a task stay small, whatever the bytes that Spark counts."""

import os
import re
from collections import Counter

from pyspark.sql import functions as F

from zonalyx.operators import frames as fr
from zonalyx.operators import graph as g
from zonalyx.operators.store import ROWS_A_TASK, by_rows, dense_id, keep, recorded
from zonalyx.plans import registry


def dealt(df, key):
    """Tasks of the shuffles by a number that is asked for, and by a key that begins so."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [int(n) for n in re.findall(rf"hashpartitioning\({key}[^)]*, (\d+)\), REPARTITION_BY_NUM", plan)]


def test_rows_of_a_task_are_bounded(spark):
    assert by_rows(spark.range(10), "id").rdd.getNumPartitions() == 4
    assert by_rows(spark.range(10), "id", rows=20 * ROWS_A_TASK).rdd.getNumPartitions() == 20


def test_unstacked_rows_are_dealt_by_number(spark):
    wide = registry.queries()["r058_unstack"](spark, "/root/testdata/sf0.001")
    assert dealt(wide, "l_orderkey") and "hashpartitioning(l_orderkey" in wide._jdf.queryExecution().executedPlan().toString()


def test_mutual_edges_are_dealt_by_number_and_repeat_as_before(spark):
    e = spark.createDataFrame([(1, 2, "a"), (2, 1, "b"), (2, 1, "c"), (3, 1, "d"), (4, 4, "e"), (None, 1, "f")], "source long, target long, t string")
    m = g.mutual(e, rows=9 * ROWS_A_TASK)
    assert dealt(m, "source") and set(dealt(m, "source")) == {9}
    assert {r.t: r.mutual for r in m.collect()} == {"a": True, "b": True, "c": True, "d": False, "e": True, "f": False}


def test_pairs_of_neighbours_are_dealt_by_points(spark):
    p = spark.range(9000).selectExpr("id", "cast(id * 37 % 101 as double) as x", "cast(id * 61 % 997 as double) as y")
    near = fr.nearest(p, "id", "x", "y", 3)
    assert dealt(near, "level") and set(dealt(near, "level")) == {12}
    assert near.count() == 27000


def test_rows_are_numbered_without_a_second_shuffle(spark):
    d = spark.range(5000).selectExpr("id", "id * 7919 % 1000 as k").repartition(7)
    n = dense_id(d, "n", "k", "id")
    assert "Exchange" not in n._jdf.queryExecution().executedPlan().toString()
    rows = sorted(n.collect(), key=lambda r: r.n)
    assert [r.n for r in rows] == list(range(5000)) and [(r.k, r.id) for r in rows] == sorted((r.k, r.id) for r in rows)
    assert dense_id(d.where("id < 0"), "n", "k").count() == 0


def test_rewiring_leaves_its_result_only(spark):
    e = spark.range(301).selectExpr("id as source", "(id * 31 + 7) % 301 as target")
    paths = []
    with recorded(paths):
        got = g.rewire(e, rounds=3)
        assert got.count() == e.selectExpr("least(source, target) u", "greatest(source, target) v").where("u <> v").distinct().count()
    assert sum(os.path.isdir(p) for p in paths) == 1


def moved(spark, run):
    """Bytes that Spark shuffles, spills and writes while run() runs."""
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._gateway.jvm.double, 0)

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes() for s in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc._jsc.sc().statusStore().stageList(None, False, False, none, None))}

    last = max(stages(), default=(-1, 0))
    run()
    return sum(b for at, b in stages().items() if at > last)


def test_a_round_of_rewiring_moves_few_bytes(spark):
    e = keep(spark.range(60_000).selectExpr("id % 997 as source", "xxhash64(id) % 15000 + 20000 as target"), "edges")
    one, three = (moved(spark, lambda k=k: g.rewire(e, rounds=k).count()) for k in (1, 3))
    assert (three - one) / 2 / 60_000 < 80


def test_edges_are_paired_over_the_borders_of_buckets(spark, monkeypatch):
    monkeypatch.setattr(g, "BUCKET", 3)
    for n in (1, 2, 41, 400, 401):
        e = spark.range(n).selectExpr("id % 9 as u", "id * 7 + 9 as v")
        h = F.xxhash64("u", "v", F.lit(5))
        rows = [(r.u, r.v) for r in e.orderBy(h, "u", "v").collect()]
        got = {r.pair: ((r.pu, r.pv), (r.qu, r.qv)) for r in g._two_by_two(e, h, n).collect()}
        assert got == {i // 2: (rows[i], rows[i + 1] if i + 1 < n else (None, None)) for i in range(0, n, 2)}


def test_pairs_of_a_dense_graph_stay_where_they_clash(spark, monkeypatch):
    monkeypatch.setattr(g, "BUCKET", 50)
    e = sorted({(min(a, b), max(a, b)) for a in range(40) for b in range(40) if a != b and (a * b + a + b) % 3 == 0})
    d = spark.createDataFrame(e, "source long, target long")
    hashed = {(r.source, r.target): r.h for r in d.withColumn("h", F.xxhash64("source", "target", F.lit(42), F.lit(0))).collect()}
    order, pairs, made = sorted(e, key=lambda x: (hashed[x], x)), [], Counter(e)
    for p, q in zip(order[::2], order[1::2]):
        c, to = q if hashed[p] % 2 == 0 else q[::-1]
        pairs.append(((p, q), [tuple(sorted((p[0], to))), tuple(sorted((c, p[1])))]))
        made.update(pairs[-1][1])
    want = [x for old, new in pairs for x in (new if all(a != b and made[a, b] == 1 for a, b in new) else old)] + order[len(pairs) * 2 :]
    assert sorted((r.source, r.target) for r in g.rewire(d, rounds=1).collect()) == sorted(want) and set(want) != set(e)


def test_degrees_count_loops_and_repeats(spark):
    e = [(1, 2), (2, 1), (1, 2), (3, 3), (3, 3), (1, 3), (4, 5)]
    ends = [x for a, b in e for x in ((a, b), (b, a))]
    want = {n: (len(o := [b for a, b in ends if a == n]), o.count(n), len(o) - len(set(o))) for n in range(1, 6)}
    got = g.undirected_degrees(spark.createDataFrame(e, "source long, target long"))
    assert {r.node: (r.degree, r.loops, r.repeats) for r in got.collect()} == want
