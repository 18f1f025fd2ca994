"""Ancestors, descendants and their counts over a materialised closure (desc, anc, hops)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import GraphError
from ..session import saved
from .closure import LISTS, all_pairs, named_by, packed_closure, reach


def _rooted(arcs: DataFrame) -> DataFrame:
    """The arcs between different nodes; edges without any root raise."""
    arcs = arcs.where("src <> dst")
    roots = arcs.select("dst").subtract(arcs.select("src"))
    if roots.isEmpty() and not arcs.isEmpty():
        raise GraphError("root", "the hierarchy has edges but no root")
    return arcs


def closure_index(arcs: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(desc, anc, hops) of all pairs of child -> parent arcs (src, dst), up to ``max_hops``; edges without any root raise."""
    return all_pairs(_rooted(arcs), max_hops).toDF("desc", "anc", "hops")


def packed_index(arcs: DataFrame) -> DataFrame:
    """``closure_index`` with a row a node: (desc, ancs, hops), where hops[k] belongs to ancs[k]. A hierarchy with cycles is walked pair by pair."""
    arcs = _rooted(arcs)
    try:
        return packed_closure(arcs).toDF("desc", "ancs", "hops")
    except GraphError as found:
        if found.kind != "cycle":
            raise
    return _packed(all_pairs(arcs).toDF("desc", "anc", "hops"))


def unpacked_index(packed: DataFrame) -> DataFrame:
    """(desc, anc, hops) of a ``packed_index``."""
    return packed.select("desc", F.inline(F.arrays_zip(F.col("ancs").alias("anc"), "hops"))).select("desc", "anc", F.col("hops").cast("long").alias("hops"))


def _packed(index: DataFrame) -> DataFrame:
    if "ancs" in index.columns:
        return index
    return index.groupBy("desc").agg(F.collect_list("anc").alias("ancs"), F.collect_list(F.col("hops").cast("short")).alias("hops"))


def index_below(arcs: DataFrame, nodes: DataFrame, max_hops: int | None = None) -> DataFrame:
    """The rows of ``closure_index`` whose ancestor is one of the nodes (node): walked down from them, without the closure."""
    down = _rooted(arcs).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = reach(down, nodes.select(F.col("node").alias("seed")), max_hops).where("hops > 0")
    return found.select(F.col("node").alias("desc"), F.col("seed").alias("anc"), "hops")


def is_ancestor(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (n1, n2) with ``is_anc``: whether n2 is n1 or one of its ancestors."""
    hit = index.select(F.col("desc").alias("n1"), F.col("anc").alias("n2"), F.lit(True).alias("hit"))
    return pairs.join(hit, ["n1", "n2"], "left").select("n1", "n2", (F.coalesce("hit", F.lit(False)) | (F.col("n1") == F.col("n2"))).alias("is_anc"))


def ancestors(index: DataFrame, nodes: DataFrame, level: int | None = None) -> DataFrame:
    """(node, anc, hops) of the given nodes, themselves excluded, up to a level (None or 0: all)."""
    found = index.join(nodes.select(F.col("node").alias("desc")).distinct(), "desc", "left_semi")
    found = found.where(F.col("hops") <= level) if level else found
    return found.select(F.col("desc").alias("node"), "anc", "hops")


def descendants(index: DataFrame, nodes: DataFrame, level: int | None = None) -> DataFrame:
    found = index.join(nodes.select(F.col("node").alias("anc")).distinct(), "anc", "left_semi")
    found = found.where(F.col("hops") <= level) if level else found
    return found.select(F.col("anc").alias("node"), "desc", "hops")


def neighbor_counts(index: DataFrame, levels: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(node, anc_all, anc_1, .., desc_all, desc_1, ..) for every node of the hierarchy."""
    counts = {"all": F.lit(True)} | {str(k): F.col("hops") <= k for k in levels}
    side = lambda end, name: index.groupBy(F.col(end).alias("node")).agg(*(F.count_if(c).alias(f"{name}_{k}") for k, c in counts.items()))
    both = side("desc", "anc").join(side("anc", "desc"), "node", "full_outer")
    return both.select("node", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in both.columns if c != "node"))


def estimate_count(index: DataFrame, nodes: DataFrame, hops: int | None = None, incoming: bool = True) -> DataFrame:
    """One row: neighbours of the given nodes within some hops, summed; -1 if none of them is in the index."""
    end = "anc" if incoming else "desc"
    known = index.select(F.col("desc").alias("node")).union(index.select("anc")).distinct().join(nodes.select("node").distinct(), "node", "left_semi")
    near = F.col("hops").isNotNull() if not hops else F.col("hops") <= hops
    counted = known.join(index, known["node"] == index[end], "left")
    return counted.agg(F.when(F.countDistinct("node") == 0, F.lit(-1)).otherwise(F.count_if(near)).cast("long").alias("n_neighbors"))


def near_count(arcs: DataFrame, nodes: DataFrame, hops: int | None = None, incoming: bool = True) -> DataFrame:
    """``estimate_count`` from the arcs (src, dst): walked from the nodes for as many hops, without an index."""
    arcs = _rooted(arcs).select("src", "dst")
    nodes = nodes.select("node").distinct()
    known = nodes.join(arcs.select(F.col("src").alias("node")).union(arcs.select("dst")).distinct(), "node", "left_semi")
    ways = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if incoming else arcs
    found = reach(ways, known.select(F.col("node").alias("seed")), hops or None)
    n = F.count_if(F.col("hops") > 0)
    return found.agg(F.when(F.count("*") == 0, F.lit(-1)).otherwise(n).cast("long").alias("n_neighbors"))


def lowest_common_ancestors(index: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, lca) of groups (grp, node): of the common ancestors-or-selves none of which lies above another, the nearest.

    Nearness is the sum of hops from the group's nodes; ties go to the least node. A group
    without a common ancestor gives no row. ``index`` has a row a pair or is packed. What lies above a common ancestor is common too, so
    one lies above another just if it is the parent of one: only single hops are looked up.
    """
    packed = _packed(index)
    own = F.array(F.struct(F.col("node").alias("anc"), F.lit(0).cast("short").alias("hops")))
    groups = groups.select("grp", "node").distinct()
    above = groups.join(packed, F.col("node") == F.col("desc"), "left").repartition(max(1, -(-groups.count() // LISTS)), "grp")
    above = above.select("grp", "node", F.explode(F.concat(own, F.coalesce(F.arrays_zip(F.col("ancs").alias("anc"), "hops"), F.array()))).alias("x"))
    size = F.count_if(F.col("x.anc") == F.col("node"))
    counted = above.groupBy("grp", F.col("x.anc").alias("anc")).agg(F.count("*").alias("n"), F.sum("x.hops").alias("hops"), size.alias("own"))
    counted = counted.withColumn("size", F.sum("own").over(Window.partitionBy("grp")))
    common = saved(counted.where("n = size").select("grp", "anc", "hops"))
    parents = packed.select("desc", F.filter(F.arrays_zip(F.col("ancs").alias("anc"), "hops"), lambda x: x["hops"] == 1)["anc"].alias("up"))
    parents = parents.join(common.select(F.col("anc").alias("desc")).distinct().hint("merge"), "desc")
    upper = named_by(common.select("grp", F.col("anc").alias("desc")), "desc", parents, "grp").select("grp", F.explode("up").alias("anc"))
    lowest = common.join(upper.distinct(), ["grp", "anc"], "left_anti")
    return lowest.groupBy("grp").agg(F.min_by("anc", F.struct("hops", "anc")).alias("lca"))


def shortest_paths(arcs: DataFrame, index: DataFrame, pairs: DataFrame) -> DataFrame:
    """(desc, anc, step, node): one shortest upward path of each related pair (desc, anc), least nodes first.

    ``index`` needs the rows of the pairs' ancestors only. Every node below such an ancestor knows its next node towards it.
    """
    pairs = pairs.select("desc", "anc").distinct()
    ends = pairs.select("anc").distinct()
    far = saved(named_by(index.select("desc", "anc", "hops"), "anc", ends, "desc", "left_semi").select("desc", "anc", "hops"))
    left = far.toDF("next", "anc", "left").unionByName(ends.select(F.col("anc").alias("next"), "anc", F.lit(0).cast("long").alias("left")))
    step = far.join(arcs.select(F.col("src").alias("desc"), F.col("dst").alias("next")), "desc").join(left, ["next", "anc"]).where("left = hops - 1")
    step = saved(step.groupBy(F.col("desc").alias("node"), "anc").agg(F.min("next").alias("next")))
    at = saved(pairs.join(far, ["desc", "anc"]).select("desc", "anc", "hops", F.col("desc").alias("node")))
    longest = at.agg(F.max("hops")).first()[0] or 0
    found = at.select("desc", "anc", F.lit(0).alias("step"), "node")
    for k in range(1, longest + 1):
        at = saved(at.where(F.col("hops") >= k).join(step, ["node", "anc"]).select("desc", "anc", "hops", F.col("next").alias("node")))
        found = found.unionByName(at.select("desc", "anc", F.lit(k).alias("step"), "node"))
    return found
