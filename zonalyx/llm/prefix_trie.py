"""The trie of conversations that start alike, built level by level.

Depth by depth, live conversations are grouped by (node, next turn); a group is a
child node and is named by its smallest conv_id. Texts do not travel: a turn is the
SHA-256 of its role and text and the number of its code points. Turns are written
once in the order of their place, so that a level reads its own turns only.

A conversation is live as long as its node also holds one that differs from it. A
node whose members all say the same to their ends is closed: the chain of nodes below
it follows from one member's turns without further grouping. So there are as many
levels as the last place where conversations part, however long they are.

Leaves and saved tokens then go up from the deepest level, each level joined with the
sums of its children; a closed chain's sums follow from what is left of its turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalyx.llm.arrow import ship
from zonalyx.llm.spread import hot_limit, running, spread_join
from zonalyx.llm.store import discard, keep, new_path

NO_ENDS = hashlib.sha256(b"").hexdigest()

#: Columns of written levels. rest: tokens from the node's turn to the end, where all members agree.
NODES = "conv_id long, parent_conv_id long, n_convs long, tokens long, rest long, length long, closed boolean"
MEMBERS = "conv_id long, node long, length long, k1 long, k2 long, closed boolean"
SUMS = "conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def number_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, position (from 1), turn_sha, tokens of every turn of a conversation, in the order of turn, null first.

    Null role and text count as empty. Turns with the same number follow the SHA-256
    of their role and text; turns that agree in that too are all kept. Rows without
    a conv_id belong to no conversation. tokens are the code points of the text.
    """
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    said = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.select(F.col(f"`{id_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), F.unhex(said).alias("turn_sha"), F.length(text).cast("long").alias("tokens"))
    rows = rows.where("conv_id IS NOT NULL").withColumn("row", F.monotonically_increasing_id())
    order = [F.col("turn").asc_nulls_first(), F.col("turn_sha"), F.col("row")]
    return running(rows, ["conv_id"], order, {"position": F.lit(1).cast("long")}, "turns").select("conv_id", "position", "turn_sha", "tokens")


def rebuilt(numbered: DataFrame, prefix_turns: Column, base_id: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(turns, ids): every conversation with its first turns taken from another one.

    Conversation c gets the first h turns of conversation base, then its own turns
    after its first h; prefix_turns and base_id say h (at most `most`) and base in
    terms of conv_id. A base with fewer turns gives all it has, an absent one none.
    """
    ids = keep(numbered.select("conv_id").distinct().select("conv_id", prefix_turns.cast("long").alias("h"), base_id.cast("long").alias("base")), "conversations")
    heads = numbered.where(F.col("position") <= most).select(F.col("conv_id").alias("base"), "position", "turn_sha", "tokens")
    shared = ids.where("h > 0").join(heads, "base").where("position <= h").select("conv_id", "position", "turn_sha", "tokens")
    given = heads.groupBy("base").agg(F.count(F.lit(1)).alias("has"))
    shift = ids.join(given, "base", "left").select("conv_id", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("got"))
    sizes = numbered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    shift = keep(shift.join(sizes, "conv_id"), "shifts")
    limit = hot_limit(shift.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    own = spread_join(numbered, shift, ["conv_id"], "n", limit).where("position > h")
    own = own.select("conv_id", (F.col("position") - F.col("h") + F.col("got")).alias("position"), "turn_sha", "tokens")
    return shared.unionByName(own), ids.select("conv_id")


def _same() -> Column:
    """Whether all members of a group say the same to their ends: they agree so far and in the hashes of the whole."""
    return (F.min("length") == F.max("length")) & (F.min("k1") == F.max("k1")) & (F.min("k2") == F.max("k2"))


def _ends(members: DataFrame, rows: int) -> DataFrame:
    """node, depth, ends_sha256 of nodes where conversations end; the ids of a node pass through one task in order and are not held."""
    ends = members.where("closed OR length = depth").select("node", F.col("length").alias("depth"), "conv_id")
    sizes = ends.groupBy("node", "depth").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("only"))
    alone = sizes.where("n = 1").select("node", "depth", F.sha2(F.col("only").cast("string"), 256).alias("ends_sha256"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, out = None, None, []
        for batch in batches:
            for node, depth, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (node, depth) == at:
                    state.update(b",%d" % conv)
                    continue
                if at is not None:
                    out.append((*at, state.hexdigest()))
                at, state = (node, depth), hashlib.sha256(b"%d" % conv)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([], [], []), _ENDS.types, strict=True)], schema=_ENDS)
            out = []
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*at, state.hexdigest()), _ENDS.types, strict=True)], schema=_ENDS)

    crowds = spread_join(ends, sizes.where("n > 1").drop("only"), ["node", "depth"], "n", hot_limit(rows)).select("node", "depth", "conv_id")
    sent = crowds.repartition("node", "depth").sortWithinPartitions("node", "depth", "conv_id")
    return alone.unionByName(sent.mapInArrow(digest, "node long, depth long, ends_sha256 string"))


_ENDS = pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])


def prefix_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per distinct start of conversations, the empty one (the root) included.

    turns: conv_id, position from 1 without gaps, turn_sha, tokens, as number_turns
    makes them; ids: every conv_id once, those without turns included. Returned per
    node: conv_id, the smallest member; depth; parent_conv_id, null for the root;
    n_convs, members; n_children; n_leaves, childless nodes in the subtree;
    saved_tokens, over the subtree the tokens of a node's last turn times its members
    but one; ends_sha256, of the ids that end at the node, ascending and joined by
    commas. No ids give no rows. Whole conversations are told apart by two 64-bit
    hashes and their length, turns by SHA-256.
    """
    spark = ship(ids.sparkSession)
    summed = running(turns, ["conv_id"], [F.col("position").desc()], {"rest": F.col("tokens")}, "trie-sums")
    placed = keep(summed.select("conv_id", "position", "turn_sha", "tokens", "rest").repartitionByRange("position", "conv_id"), "trie-turns")
    key = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "position", "turn_sha"))
    whole = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"), key("a").alias("k1"), key("b").alias("k2"), F.sum("tokens").alias("total"))
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("length", "k1", "k2", "total")]
    members = keep(ids.select("conv_id").join(whole, "conv_id", "left").select("conv_id", *filled), "trie-members")
    nodes_at, members_at, sums_at = (new_path(spark, f"trie-{name}") for name in ("nodes", "live", "nodes-up"))

    def level(path: str, schema: str, depth: int) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{path}/depth={depth}")

    top = members.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("length").alias("turns"), F.max("total").alias("rest"), F.min("length").alias("length"), _same().alias("closed"))
    root = top.first()
    if not root.n_convs:
        return spark.createDataFrame([], f"{SUMS}, depth long, ends_sha256 string")
    number = F.lit(None).cast("long").alias("parent_conv_id"), F.lit(0).cast("long").alias("tokens")
    top.select("conv_id", number[0], "n_convs", number[1], "rest", "length", "closed").write.parquet(f"{nodes_at}/depth=0")
    members.select("conv_id", F.lit(root.conv_id).alias("node"), "length", "k1", "k2", F.lit(root.closed).alias("closed")).write.parquet(f"{members_at}/depth=0")
    limit, depth = hot_limit(root.n_convs), 0
    while True:
        live = level(members_at, MEMBERS, depth).where(~F.col("closed") & (F.col("length") > depth))
        if live.isEmpty():
            break
        step = live.drop("closed").join(placed.where(F.col("position") == depth + 1).drop("position"), "conv_id")
        step = keep(step, "trie-step")
        groups = step.groupBy("node", "turn_sha").agg(F.min("conv_id").alias("child"), F.count(F.lit(1)).alias("n_convs"), F.min("tokens").alias("tokens"), F.min("rest").alias("rest"), F.min("length").alias("length"), _same().alias("closed"))
        groups = keep(groups, "trie-groups")
        depth += 1
        groups.select(F.col("child").alias("conv_id"), F.col("node").alias("parent_conv_id"), "n_convs", "tokens", "rest", "length", "closed").write.parquet(f"{nodes_at}/depth={depth}")
        shared = groups.where("n_convs > 1").select("node", "turn_sha", "child", "closed", "n_convs")
        went = spread_join(step, shared, ["node", "turn_sha"], "n_convs", limit)
        went.select("conv_id", F.col("child").alias("node"), "length", "k1", "k2", "closed").write.parquet(f"{members_at}/depth={depth}")
        discard(step, groups)
    for d in range(depth, -1, -1):
        rows = level(nodes_at, NODES, d)
        if d < depth:
            below = level(sums_at, SUMS, d + 1).groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            rows = rows.join(below, "conv_id", "left")
        else:
            rows = rows.select("*", *[F.lit(None).cast("long").alias(c) for c in ("kids", "leaves", "saved")])
        again = F.col("n_convs") - 1
        rows.select(
            "conv_id",
            "parent_conv_id",
            "n_convs",
            F.when(F.col("closed"), (F.col("length") > d).cast("long")).otherwise(F.col("kids")).alias("n_children"),
            F.when(F.col("closed"), F.lit(1)).otherwise(F.col("leaves")).alias("n_leaves"),
            F.when(F.col("closed"), again * F.col("rest")).otherwise(again * F.col("tokens") + F.col("saved")).alias("saved_tokens"),
        ).write.parquet(f"{sums_at}/depth={d}")
    upper = spark.read.schema(f"{SUMS}, depth long").parquet(sums_at)
    closed = spark.read.schema(f"{NODES}, depth long").parquet(nodes_at).where("closed AND length > depth")
    tails = spread_join(placed, closed.select("conv_id", F.col("depth").alias("top"), "n_convs", "length"), ["conv_id"], "length", hot_limit(root.turns or 0)).where("position > top")
    lower = tails.select(
        "conv_id",
        F.col("conv_id").alias("parent_conv_id"),
        "n_convs",
        (F.col("position") < F.col("length")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("rest")).alias("saved_tokens"),
        F.col("position").alias("depth"),
    )
    ended = _ends(spark.read.schema(f"{MEMBERS}, depth long").parquet(members_at), root.n_convs).withColumnRenamed("node", "conv_id")
    out = upper.unionByName(lower).join(ended, ["conv_id", "depth"], "left")
    own = F.when((F.col("n_convs") == 1) & (F.col("n_children") == 0), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NO_ENDS))
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", own))
