"""Zone-by-month graphs as node and edge tables, and aggregation over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonalyx.operators.components import components
from zonalyx.operators.frames import dense_id, lookup_side, union_all
from zonalyx.operators.store import by_rows, discard, keep, tasks_for

#: What an edge type is.
KINDS = {"lag_1": "temporal", "lag_12": "temporal", "knn": "spatial", "adjacency": "spatial", "placebo": "placebo"}
REGIMES = {
    "none": (),
    "temporal": ("temporal",),
    "spatial": ("spatial",),
    "spatial_temporal": ("spatial", "temporal"),
    "placebo": ("placebo",),
    "temporal_placebo": ("temporal", "placebo"),
    "all": ("spatial", "temporal", "placebo"),
}


def nodes(panel: DataFrame, zone: str, ordinal: str) -> DataFrame:
    """The panel with node_id, dense from 0 in the order of month and zone."""
    return dense_id(panel, "node_id", ordinal, zone)


def lag_edges(node_table: DataFrame, zone: str, ordinal: str, lag: int) -> DataFrame:
    """An edge of weight 1 from each node to the same zone's node lag months later."""
    a = node_table.select(F.col("node_id").alias("source"), zone, (F.col(ordinal) + lag).alias(ordinal))
    b = node_table.select(F.col("node_id").alias("target"), zone, ordinal)
    return a.join(b, [zone, ordinal]).select("source", "target", F.lit(f"lag_{lag}").alias("edge_type"), F.lit(1.0).alias("edge_weight"))


def month_edges(pairs: DataFrame, node_table: DataFrame, zone: str, ordinal: str, edge_type: str) -> DataFrame:
    """Zone pairs (source, target, edge_weight) in every month that has both ends."""
    a = node_table.select(F.col("node_id").alias("s"), F.col(zone).alias("source"), ordinal)
    b = node_table.select(F.col("node_id").alias("t"), F.col(zone).alias("target"), ordinal)
    return pairs.join(a, "source").join(b, ["target", ordinal]).select(
        F.col("s").alias("source"),
        F.col("t").alias("target"),
        F.lit(edge_type).alias("edge_type"),
        "edge_weight",
    )


def placebo_edges(edges: DataFrame, node_table: DataFrame, ordinal: str, seed: int = 42) -> DataFrame:
    """Each edge's target replaced by a node of the target's month, drawn by a hash of the edge among all but the source.

    An edge goes only where that month has no other node than the source.
    """
    month = Window.partitionBy(ordinal)
    places = node_table.select(F.col("node_id").alias("new"), F.col(ordinal).alias("m"), (F.row_number().over(month.orderBy("node_id")) - 1).alias("i"))
    of = node_table.select(F.col("node_id").alias("target"), F.col(ordinal).alias("m"))
    sizes = node_table.groupBy(F.col(ordinal).alias("m")).count()
    own = places.select(F.col("new").alias("source"), "m", F.col("i").alias("own"))
    # the source's own place is left out: places from it on move up by one
    e = edges.join(of, "target").join(lookup_side(sizes), "m").join(own, ["source", "m"], "left")
    e = e.withColumn("count", F.col("count") - F.col("own").isNotNull().cast("int")).where("count > 0")
    e = e.withColumn("i", F.pmod(F.xxhash64("source", "target", F.lit(seed)), F.col("count")).cast("int"))
    e = e.withColumn("i", F.col("i") + F.coalesce((F.col("i") >= F.col("own")).cast("int"), F.lit(0)))
    return e.join(places, ["m", "i"]).select("source", F.col("new").alias("target"), F.lit("placebo").alias("edge_type"), "edge_weight")


def edge_table(*families: DataFrame) -> DataFrame:
    return dense_id(union_all(*families), "edge_id", "edge_type", "source", "target")


def annotate(edges: DataFrame, node_table: DataFrame, split: str) -> DataFrame:
    """source_split, target_split (NULL is missing) and crosses_split, train_train, touches_test."""
    of = lambda end: node_table.select(F.col("node_id").alias(end), F.coalesce(split, F.lit("missing")).alias(f"{end}_split"))
    e = edges.join(of("source"), "source", "left").join(of("target"), "target", "left").fillna("missing", subset=["source_split", "target_split"])
    return e.withColumn("crosses_split", F.col("source_split") != F.col("target_split")).withColumn("train_train", (F.col("source_split") == "train") & (F.col("target_split") == "train")).withColumn(
        "touches_test",
        (F.col("source_split") == "test") | (F.col("target_split") == "test"),
    )


def regime(edges: DataFrame, name: str) -> DataFrame:
    return edges.where(F.col("edge_type").isin([t for t, kind in KINDS.items() if kind in REGIMES[name]]))


def mutual(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """edges with mutual: whether there is an edge back. rows: how many edges there are, if known."""
    n = edges.count() if rows is None else rows
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    edges, back = (by_rows(e, "source", "target", rows=n) for e in (edges, back))
    back = back.distinct().withColumn("__b", F.lit(True))
    return edges.join(back, ["source", "target"], "left").withColumn("mutual", F.coalesce("__b", F.lit(False))).drop("__b")


def degrees(node_table: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, in_degree, out_degree, isolated."""
    i = edges.groupBy(F.col("target").alias("node_id")).agg(F.count(F.lit(1)).alias("in_degree"))
    o = edges.groupBy(F.col("source").alias("node_id")).agg(F.count(F.lit(1)).alias("out_degree"))
    d = node_table.select("node_id").join(i, "node_id", "left").join(o, "node_id", "left").fillna(0)
    return d.withColumn("isolated", (F.col("in_degree") + F.col("out_degree")) == 0)


def connected(edges: DataFrame, a: str = "source", b: str = "target") -> DataFrame:
    """(node, component): the smallest node reachable; a node with edges to itself only is its own.

    Rounds go on until nothing changes; an error tells if they never do.
    """
    found = components(edges, a, b)
    alone = edges.where(F.col(a) == F.col(b)).select(F.col(a).alias("node")).distinct().join(found, "node", "left_anti")
    return found.unionByName(alone.withColumn("component", F.col("node")))


#: Edges that a bucket of hashes has, about; a task takes many buckets.
BUCKET = 20_000


def _two_by_two(e: DataFrame, h: Column, n: int) -> DataFrame:
    """(pair, pu, pv, qu, qv): the n rows (u, v) two by two in the order of h, u, v; the last of an odd n has no q.

    A bucket is a range of the hash h, which deals rows evenly. Rows are shuffled once, to
    their bucket's task; a bucket's first row whose partner is the last one of the bucket
    before is looked up there.
    """
    spark, bits = e.sparkSession, max(1, (n // BUCKET).bit_length())
    b = F.shiftright(h, 64 - bits)
    starts, firsts, total, before = [], [], 0, None
    for bucket, size, least in sorted(e.groupBy(b.alias("b")).agg(F.count(F.lit(1)), F.min(h)).collect()):
        starts.append((bucket, total))
        if total % 2:
            firsts.append((before, least))
        total, before = total + size, bucket
    starts, firsts = spark.createDataFrame(starts, "b long, start long"), spark.createDataFrame(firsts, "b long, h long")
    firsts = e.withColumn("h", h).join(F.broadcast(firsts), "h").groupBy("b").agg(F.min(F.struct("u", "v")).alias("first"))
    w = Window.partitionBy("b").orderBy("h", "u", "v")
    rows = e.repartition(tasks_for(spark, n), b).withColumn("b", b).withColumn("h", h)
    rows = rows.select("b", "u", "v", F.row_number().over(w).alias("place"), F.lead("u").over(w).alias("qu"), F.lead("v").over(w).alias("qv"))
    rows = rows.join(F.broadcast(starts), "b").withColumn("i", F.col("start") + F.col("place") - 1).where("i % 2 = 0").join(F.broadcast(firsts), "b", "left")
    return rows.select(
        F.shiftright("i", 1).alias("pair"),
        F.col("u").alias("pu"),
        F.col("v").alias("pv"),
        F.coalesce("qu", "first.u").alias("qu"),
        F.coalesce("qv", "first.v").alias("qv"),
    )


def rewire(pairs: DataFrame, seed: int = 42, rounds: int = 5) -> DataFrame:
    """(source, target), source < target: a random graph in which every node keeps its degree.

    In each round edges are numbered in the order of a hash and taken two by two; a
    pair swaps ends unless that makes a loop, an edge that there is, or one that
    another pair makes. Loops and repeated edges of the input are dropped first.
    A round shuffles each edge by its hash and, old and made, by its ends; which pairs
    stay comes back as a bit each.
    """
    e = pairs.select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).where("u <> v").distinct()
    e = keep(e, "rewire")
    n = e.count()
    for k in range(rounds if n else 0):
        hashed = lambda u, v, k=k: F.xxhash64(u, v, F.lit(seed), F.lit(k))
        two = keep(_two_by_two(e, hashed("u", "v"), n), "rewire")
        turn = hashed("pu", "pv") % 2 == 0
        c, d = F.when(turn, F.col("qu")).otherwise(F.col("qv")), F.when(turn, F.col("qv")).otherwise(F.col("qu"))
        edge = lambda a, b: F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
        old, made = F.array(edge("pu", "pv"), edge("qu", "qv")), F.array(edge("pu", d), edge(c, "pv"))
        # edges that are made, and, without a pair, those that there are
        both = two.where("qu is not null").select("pair", F.explode(made).alias("m")).select("pair", "m.*")
        both = by_rows(both.unionByName(e.select(F.lit(None).cast("long").alias("pair"), "u", "v")), "u", "v", rows=2 * n)
        clash = (F.col("u") == F.col("v")) | (F.count(F.lit(1)).over(Window.partitionBy("u", "v")) > 1)
        block, at = F.bitmap_bucket_number("pair"), F.bitmap_bit_position("pair")
        bad = both.withColumn("clash", clash).where("clash and pair is not null").select("pair", block.alias("block"))
        # dealt before bits are set: tasks that set some of each block's would grow with the square of the edges
        bad = keep(by_rows(bad, "block", rows=n).groupBy("block").agg(F.bitmap_construct_agg(at).alias("bits")), "rewire")
        byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
        stay = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
        after = two.withColumn("block", block).join(bad, "block", "left")
        after = after.select(F.explode(F.when(F.col("qu").isNull(), F.array(edge("pu", "pv"))).when(stay, old).otherwise(made)).alias("m"))
        new = keep(after.select("m.*"), "rewire")
        discard(e, two, bad)
        e = new
    return e.toDF("source", "target")


def undirected_degrees(edges: DataFrame) -> DataFrame:
    """node, degree, loops, repeats (ends that lead where another end of the node leads); a loop has both ends at its node."""
    u, v = F.least("source", "target"), F.greatest("source", "target")
    e = edges.groupBy(u.alias("u"), v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    loop = F.col("u") == F.col("v")
    ends = e.select(F.explode(F.when(loop, F.array("u")).otherwise(F.array("u", "v"))).alias("node"), F.when(loop, F.col("n") * 2).otherwise(F.col("n")).alias("n"), loop.alias("loop"))
    return ends.groupBy("node").agg(
        F.sum("n").alias("degree"),
        F.sum(F.when(F.col("loop"), F.col("n")).otherwise(F.lit(0))).alias("loops"),
        F.sum(F.col("n") - 1).alias("repeats"),
    )


def neighbour_mean(edges: DataFrame, features: DataFrame, columns: list[str], weighted: bool = True, by_type: bool = False) -> DataFrame:
    """Per target node sum(w h) / max(sum(w), 1), w not negative; unweighted sum(h) / max(degree, 1).

    features has a row per node; a node without incoming edges (of any type, or of
    each type that the edges have) gets 0.
    """
    w = F.greatest(F.col("edge_weight"), F.lit(0.0)) if weighted else F.lit(1.0)
    keys = ["node_id", *(["edge_type"] if by_type else [])]
    j = edges.withColumnRenamed("node_id", "__n").join(features.withColumnRenamed("node_id", "source"), "source").withColumnRenamed("target", "node_id")
    got = j.groupBy(*keys).agg(*[(F.sum(w * F.col(c)) / F.greatest(F.sum(w), F.lit(1.0))).alias(f"{c}_near") for c in columns])
    every = features.select("node_id")
    if by_type:
        # as many types as the registry names, not as there are edges
        types = [F.lit(r[0]) for r in edges.select("edge_type").distinct().orderBy("edge_type").collect()]
        every = every.withColumn("edge_type", F.explode(F.array(*types).cast("array<string>")))
    return every.join(got, keys, "left").fillna(0.0, subset=[f"{c}_near" for c in columns])


def edge_masks(annotated: DataFrame, scheme: str) -> DataFrame:
    """<scheme>_all, _train_train and _no_test for edges that annotate() has given split columns of that scheme."""
    return annotated.withColumns({f"{scheme}_all": F.lit(True), f"{scheme}_train_train": F.col("train_train"), f"{scheme}_no_test": ~F.col("touches_test")})


def leakage_audit(edges: DataFrame, node_table: DataFrame, ordinal: str, split: str) -> DataFrame:
    """check, violations: edges into the past, spatial edges across months, edges from test into train."""
    of = lambda end: node_table.select(F.col("node_id").alias(end), F.col(ordinal).alias(f"{end}_m"), F.col(split).alias(f"{end}_s"))
    e = edges.join(of("source"), "source").join(of("target"), "target")
    spatial = F.col("edge_type").isin([t for t, k in KINDS.items() if k == "spatial"])
    checks = {
        "future_to_past": F.col("source_m") > F.col("target_m"),
        "spatial_across_months": spatial & (F.col("source_m") != F.col("target_m")),
        "test_into_train": (F.col("source_s") == "test") & (F.col("target_s") == "train"),
    }
    one = e.agg(*[F.count_if(c).alias(n) for n, c in checks.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in checks])).alias("c")).select("c.*")


# -- segments -----------------------------------------------------------------------------------


def segments(df: DataFrame, seg: str, value: str, n: int) -> DataFrame:
    """segment, n, present, sum, mean, max for 0 .. n - 1; absent ones are 0. Other ids raise an error; a null id is in no segment."""
    id_ = F.col(seg).cast("long")
    inside = F.when(id_.between(0, n - 1) | id_.isNull(), id_).otherwise(
        F.raise_error(F.concat(F.lit("segment "), id_.cast("string"), F.lit(f" is outside 0 .. {n - 1}"))).cast("long")
    )
    g = df.groupBy(inside.alias("segment")).agg(
        F.count(value).alias("n"),
        F.sum(value).cast("double").alias("sum"),
        F.avg(value).alias("mean"),
        F.max(value).cast("double").alias("max"),
    )
    every = df.sparkSession.range(n).withColumnRenamed("id", "segment")
    return every.join(g, "segment", "left").fillna(0).withColumn("present", F.col("n") > 0)


def grouped_softmax(value: str, by: list[str]) -> Column:
    """exp(x - max) over its sum in the group; use on a table that has max as __max (see softmax)."""
    e = F.exp(F.col(value) - F.col("__max"))
    return e / F.sum(e).over(Window.partitionBy(*by))


def softmax(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    top = df.withColumn("__max", F.max(value).over(Window.partitionBy(*by)))
    return top.withColumn(out, grouped_softmax(value, by)).drop("__max")


def masked_mean(values: list[str], masks: list[str]) -> Column:
    total, n = F.lit(0.0), F.lit(0.0)
    for v, m in zip(values, masks, strict=True):
        on = F.coalesce(F.col(m).cast("double"), F.lit(0.0))
        total, n = total + F.coalesce(F.col(v).cast("double"), F.lit(0.0)) * on, n + on
    return F.try_divide(total, F.nullif(n, F.lit(0.0)))


def gate(left: Column, right: Column, bias: float = 0.0) -> Column:
    """The sigmoid of the scaled dot product of two arrays."""
    dot = F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    return 1 / (1 + F.exp(-(dot / F.sqrt(F.size(left).cast("double")) + bias)))


# -- message passing ----------------------------------------------------------------------------


def target_aggregate(edges: DataFrame, node_table: DataFrame, columns: list[str]) -> DataFrame:
    """node_id, n_in, and <column>_sum, _mean of the messages on incoming edges.

    Every edge counts, parallel ones and loops too; nodes without any have 0.
    """
    made = [f(c).cast("double").alias(f"{c}_{name}") for c in columns for name, f in (("sum", F.sum), ("mean", F.avg))]
    g = edges.groupBy(F.col("target").alias("node_id")).agg(F.count(F.lit(1)).alias("n_in"), *made)
    return node_table.select("node_id").join(g, "node_id", "left").fillna(0)


#: Coefficients of an edge by the degrees of its ends.
EDGE_NORMALS = {
    "none": lambda out_source, in_target: F.lit(1.0),
    "target_degree": lambda out_source, in_target: 1.0 / in_target,
    "source_degree": lambda out_source, in_target: 1.0 / out_source,
    "symmetric_degree": lambda out_source, in_target: 1.0 / F.sqrt(out_source.cast("double") * in_target),
}


def normalise_edges(edges: DataFrame, kind: str = "none", by: list[str] | None = None) -> DataFrame:
    """edges with source_degree, target_degree (of edges in the same group `by`) and coefficient."""
    by = by or []
    n = lambda end: F.count(F.lit(1)).over(Window.partitionBy(end, *by))
    e = edges.withColumn("source_degree", n("source")).withColumn("target_degree", n("target"))
    return e.withColumn("coefficient", EDGE_NORMALS[kind](F.col("source_degree"), F.col("target_degree")))


def attention(edges: DataFrame, logits: str, out: str, relation: str = "edge_type") -> DataFrame:
    """A row per edge and head (0-based) of the array logits, with its softmax among edges of the same target, relation and head."""
    heads = edges.select("*", F.posexplode(logits).alias("head", "__logit")).drop(logits)
    return softmax(heads, "__logit", ["target", relation, "head"], out).drop("__logit")


def pool_history(values: list[str], masks: list[str], kind: str, empty: float | None = None) -> Column:
    """last_valid, masked_mean or masked_max over slots from the oldest to the newest; `empty` where no slot is valid."""
    on = [F.coalesce(F.col(m).cast("boolean"), F.lit(False)) & F.col(v).isNotNull() for v, m in zip(values, masks, strict=True)]
    shown = [F.when(o, F.col(v).cast("double")) for o, v in zip(on, values, strict=True)]
    if kind == "last_valid":
        found = F.coalesce(*reversed(shown))
    elif kind == "masked_max":
        found = F.array_max(F.array(*shown))
    elif kind == "masked_mean":
        found = F.aggregate(
            F.filter(F.array(*shown), lambda x: x.isNotNull()),
            F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
            lambda a, x: F.struct((a["s"] + x).alias("s"), (a["n"] + 1).alias("n")),
            lambda a: F.try_divide(a["s"], F.nullif(a["n"], F.lit(0))),
        )
    else:
        raise ValueError(f"unknown pooling {kind!r}")
    return F.coalesce(found, F.lit(empty).cast("double"))


def pool_attention(values: list[str], masks: list[str], logits: list[list[Column]], reduction: str = "mean", head_weights: list[float] | None = None, empty: float | None = None) -> Column:
    """Attention over slots: in each head (a logit a slot) the softmax of valid slots weighs their values; heads are averaged, plainly or by head_weights.

    Slots that are masked, or have no value or logit, get no weight; where none is
    left, `empty`. reduction: single_head, mean or weighted_mean.
    """
    if reduction == "single_head" and len(logits) != 1 or reduction == "weighted_mean" and len(head_weights or ()) != len(logits):
        raise ValueError(f"{len(logits)} heads do not fit {reduction!r}")
    if reduction not in ("single_head", "mean", "weighted_mean"):
        raise ValueError(f"unknown reduction {reduction!r}")
    share = [w / sum(head_weights) for w in head_weights] if reduction == "weighted_mean" else [1.0 / len(logits)] * len(logits)
    total = F.lit(0.0)
    for head, part in zip(logits, share, strict=True):
        slots = [
            F.when(F.coalesce(F.col(m).cast("boolean"), F.lit(False)) & F.col(v).isNotNull() & z.isNotNull(), F.struct(z.cast("double").alias("z"), F.col(v).cast("double").alias("v")))
            for v, m, z in zip(values, masks, head, strict=True)
        ]
        valid = F.array_compact(F.array(*slots))
        most = F.array_max(F.transform(valid, lambda e: e["z"]))
        sums = F.aggregate(
            F.transform(valid, lambda e: F.struct(F.exp(e["z"] - most).alias("w"), e["v"].alias("v"))),  # noqa: B023
            F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("s")),
            lambda a, e: F.struct((a["w"] + e["w"]).alias("w"), (a["s"] + e["w"] * e["v"]).alias("s")),
        )
        total = total + F.try_divide(sums["s"], F.nullif(sums["w"], F.lit(0.0))) * part
    return F.coalesce(total, F.lit(empty).cast("double"))


# -- registries ---------------------------------------------------------------------------------

#: Names of relations, in the order of their indices.
RELATIONS = (
    "identity_no_edge",
    "random_placebo",
    "centroid_knn",
    "spatial_adjacency",
    "administrative_membership",
    "temporal_memory",
    "historical_event_propagation",
    "hydrological_exposure",
    "flood_zone_exposure",
    "low_elevation_exposure",
    "heat_exposure",
    "impervious_surface_exposure",
    "canopy_protection",
    "cooling_access",
    "service_access",
    "road_access",
    "drainage_dependency",
    "infrastructure_dependency",
    "critical_facility_dependency",
    "reporting_similarity",
    "socioeconomic_similarity",
    "cross_scale_parent",
    "cross_scale_child",
)
#: Relations that are controls, not mechanisms.
CONTROLS = ("identity_no_edge", "random_placebo", "centroid_knn")


def relation_table(spark) -> DataFrame:
    """relation_index (dense from 0), relation, is_control: the dimension that edges are checked against and encoded by."""
    rows = ", ".join(f"({k}, '{name}', {str(name in CONTROLS).lower()})" for k, name in enumerate(RELATIONS))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(relation_index, relation, is_control)")


def encode_relations(edges: DataFrame, relation: str = "relation") -> DataFrame:
    """edges with relation_index; an unknown relation raises an error."""
    known = F.create_map(*[F.lit(x) for k, name in enumerate(RELATIONS) for x in (name, k)])
    found = F.element_at(known, F.col(relation))
    unknown = F.raise_error(F.concat(F.lit("unknown relation "), F.coalesce(F.col(relation), F.lit("NULL")))).cast("int")
    return edges.withColumn("relation_index", F.coalesce(found, unknown))


def prior_matrix(priors: DataFrame, hazards: list[str], hazard: str = "hazard", relation: str = "relation", prior: str = "prior") -> DataFrame:
    """A row per relation of the registry and a column per hazard; pairs that are not given are 0, repeated ones an error."""
    checked = priors.groupBy(relation, hazard).agg(F.count(F.lit(1)).alias("n"), F.first(prior).alias("p"))
    one = F.when(F.col("n") == 1, F.col("p")).otherwise(F.raise_error(F.lit("a prior is given twice")).cast("double"))
    wide = checked.withColumn("p", one).groupBy(F.col(relation).alias("relation")).pivot(hazard, hazards).agg(F.first("p"))
    return relation_table(priors.sparkSession).join(wide, "relation", "left").fillna(0.0, subset=hazards)
