"""Reachability without all pairs: intervals over a spanning tree, and what surplus arcs add to them.

Every node hangs below its deepest parent; in an order of that tree the nodes below a node are
one interval. Arcs outside the tree lead elsewhere: bottom-up, layer by layer, each node takes
from its children the intervals that its own doesn't hold, and intervals that touch become one. So
a node's intervals cover exactly what reaches it, and their lengths count it. Rows of the
tree's arcs are dropped before they are gathered, as a parent's interval holds them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved, saved_rows
from .closure import longest_depth, named_by

#: Parts over which the children of one node are dealt where they are summed up.
PARTS = 64


@dataclass(frozen=True)
class LabelIndex:
    #: (node, at): place of each node in the order of the tree.
    places: DataFrame
    #: (node, lo, hi): disjoint runs of places that cover the node and all below it.
    runs: DataFrame


def _earlier(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over the rows of its key that stand earlier; in two levels, so that a hot key is dealt."""
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(order), F.lit(PARTS)))
    by_part = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(key, "_part").agg(F.sum(value).alias("_sum"))
    starts = starts.select(key, "_part", F.coalesce(F.sum("_sum").over(by_part), F.lit(0)).alias("_start"))
    within = Window.partitionBy(key, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("_inner", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return inner.join(starts, [key, "_part"]).withColumn("before", F.col("_start") + F.col("_inner")).drop("_part", "_start", "_inner")


def _tree(arcs: DataFrame, depths: DataFrame, height: int) -> DataFrame:
    """(node, depth, at, last): the nodes' places in an order of the spanning tree, and the last place below each."""
    depth_of = depths.toDF("dst", "up_depth")
    deepest = named_by(arcs, "dst", depth_of, "src").groupBy("src").agg(F.max_by("dst", F.struct("up_depth", -F.col("dst"))).alias("up"))
    nodes = saved(depths.join(deepest.withColumnRenamed("src", "node").hint("merge"), "node", "left"))
    sized, layers = None, []
    for depth in range(height, 0, -1):
        own = nodes.where(F.col("depth") == depth)
        below = own.select(F.col("node").alias("up"), F.lit(0).cast("long").alias("below")).where("false") if sized is None else sized.groupBy("up").agg(F.sum("size").alias("below"))
        sized = own.join(below.withColumnRenamed("up", "node").hint("merge"), "node", "left")
        sized = saved(sized.select("node", "depth", "up", (F.coalesce("below", F.lit(0)) + 1).alias("size")))
        layers.append(sized)
    rows = layers[0]
    for more in layers[1:]:
        rows = rows.union(more)
    rows = _earlier(rows.withColumn("_up", F.coalesce("up", F.lit(-1))), "_up", "node", "size")
    # A place is the sum of what stands earlier on the way from the root; the way is halved each round.
    step = F.col("before") + F.when(F.col("up").isNull(), 0).otherwise(1)
    found, left = saved_rows(rows.select("node", "depth", "size", "up", step.alias("at")), "up is not null")
    while left:
        above = found.select(F.col("node").alias("up"), F.col("up").alias("top"), F.col("at").alias("more"))
        found = named_by(found, "up", above, "node", "left").select("node", "depth", "size", F.col("top").alias("up"), (F.col("at") + F.coalesce("more", F.lit(0))).alias("at"))
        found, left = saved_rows(found, "up is not null")
    return found.select("node", "depth", "at", (F.col("at") + F.col("size") - 1).alias("last"))


def label_index(arcs: DataFrame) -> LabelIndex:
    """Index of a DAG of arcs (src child, dst parent); a cycle raises."""
    arcs = saved(arcs.select("src", "dst").where("src <> dst").distinct())
    depths = longest_depth(arcs)
    height = depths.agg(F.max("depth")).first()[0] or 0
    tree = saved(_tree(arcs, depths, height))
    parents = tree.select(F.col("node").alias("dst"), F.col("depth").alias("to"), F.col("at").alias("first"), F.col("last"))
    known = saved(named_by(named_by(arcs, "dst", parents, "src"), "src", depths.toDF("src", "from"), "dst"))
    # Layers that tell a layer something: at most the square of the height.
    tells: dict[int, set[int]] = {}
    for row in known.select("to", "from").distinct().collect():
        tells.setdefault(row["to"], set()).add(row["from"])
    told, runs = {}, []
    for depth in range(height, 0, -1):
        rows = tree.where(F.col("depth") == depth).select("node", F.col("at").alias("lo"), F.col("last").alias("hi"))
        for k in sorted(tells.get(depth, set()) & told.keys()):
            rows = rows.union(told[k].where(F.col("to") == depth).select(F.col("dst").alias("node"), "lo", "hi"))
        before = Window.partitionBy("node").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
        begins = F.col("lo") > F.coalesce(F.max("hi").over(before), F.lit(-2)) + 1
        group = F.sum(F.col("begins").cast("long")).over(Window.partitionBy("node").orderBy("lo", "hi"))
        merged = rows.distinct().withColumn("begins", begins).withColumn("run", group).groupBy("node", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        merged = saved(merged.select("node", "lo", "hi"))
        runs.append(merged)
        met = known.where(F.col("from") == depth).join(merged.hint("merge"), F.col("src") == F.col("node")).where("lo < first or hi > last")
        more, n_more = saved_rows(met.select("dst", "to", "lo", "hi"))
        if n_more:
            told[depth] = more
    found = tree.select("node", F.col("at").alias("lo"), F.col("last").alias("hi")).where("false")
    for more in runs:
        found = found.union(more)
    return LabelIndex(tree.select("node", "at"), found)


#: Levels of blocks: places lie below 2 ** LEVELS.
LEVELS = 40


def keys(index: LabelIndex) -> DataFrame:
    """(node, level, block): the blocks of all sizes 2 ** level that hold each node's place, up to the whole range."""
    most = index.places.agg(F.max("at")).first()[0] or 0
    levels = F.sequence(F.lit(0), F.lit(most.bit_length()))
    return index.places.select("node", "at", F.explode(levels).alias("level")).select("node", "level", F.expr("shiftright(at, level)").alias("block"))


def covers(index: LabelIndex) -> DataFrame:
    """(node, level, block): the few largest blocks that make up each node's runs, two a size at most.

    A node lies below another just if one of its ``keys`` is one of the other's ``covers``: an equi-join.
    """
    runs = index.runs.select("node", "lo", "hi", F.explode(F.sequence(F.lit(0), F.least(F.lit(LEVELS), F.ceil(F.log2(F.col("hi") - F.col("lo") + 2)).cast("int")))).alias("level"))
    runs = runs.select("node", "level", F.expr("shiftright(lo + shiftleft(1L, level) - 1, level)").alias("a"), F.expr("shiftright(hi + 1, level) - 1").alias("b"))
    ends = F.array_compact(F.array(F.when(F.col("a") % 2 == 1, F.col("a")), F.when(F.col("b") % 2 == 0, F.col("b"))))
    return runs.where("a <= b").select("node", "level", F.explode(ends).alias("block"))


def is_ancestor(index: LabelIndex, pairs: DataFrame) -> DataFrame:
    """Pairs (n1, n2) with ``is_anc``: whether n2 is n1 or one of its ancestors; one place and one run a pair."""
    placed = pairs.distinct().join(index.places.toDF("n1", "at"), "n1")
    hit = placed.join(index.runs.withColumnRenamed("node", "n2"), "n2").where("at between lo and hi").select("n1", "n2", F.lit(True).alias("hit"))
    return pairs.join(hit, ["n1", "n2"], "left").select("n1", "n2", (F.coalesce("hit", F.lit(False)) | (F.col("n1") == F.col("n2"))).alias("is_anc"))


def below_counts(index: LabelIndex) -> DataFrame:
    """(node, n): how many nodes lie below each, itself excluded; exact, as the runs are disjoint."""
    return index.runs.groupBy("node").agg((F.sum(F.col("hi") - F.col("lo") + 1) - 1).alias("n"))


def neighbor_counts(arcs: DataFrame) -> DataFrame:
    """(node, anc_all, desc_all) of every node of child -> parent arcs, without a closure: an index for each direction."""
    down = below_counts(label_index(arcs)).toDF("node", "desc_all")
    up = below_counts(label_index(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))).toDF("node", "anc_all")
    return up.join(down, "node").select("node", "anc_all", "desc_all")
