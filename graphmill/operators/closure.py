"""Recursion over edges: reachability, closures, components and longest depths.

Every loop is semi-naive: only the newest rows meet the edges, rows already known are
dropped by an anti join, and each round's delta is checkpointed, so the lineage stays
one round long and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import GraphError
from ..session import saved, saved_rows

#: Parts over which the rows of a hot node are dealt.
SALTS = 16
#: Lists of ancestors that a task cuts into rows.
LISTS = 10_000


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def reach(arcs: DataFrame, seeds: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(seed, node, hops): every node that each seed reaches over arcs (src, dst), with the least number of hops.

    The seed itself has 0 hops. Cycles and self-loops end by themselves.
    """
    arcs = saved(arcs.select("src", "dst").where("src <> dst").distinct())
    frontier = saved(seeds.select("seed", F.col("seed").alias("node")).distinct().withColumn("hops", F.lit(0).cast("long")))
    known, hop = [frontier], 0
    while max_hops is None or hop < max_hops:
        hop += 1
        step = frontier.join(arcs, frontier["node"] == arcs["src"]).select("seed", F.col("dst").alias("node")).distinct()
        seen = _union(known).select("seed", "node")
        frontier, left = saved_rows(step.join(seen, ["seed", "node"], "left_anti").withColumn("hops", F.lit(hop).cast("long")))
        if not left:
            break
        known.append(frontier)
    return _union(known)


def all_pairs(arcs: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(src, dst, hops) of every pair with a path of one arc or more, and ``max_hops`` at most, between different nodes."""
    arcs = saved(arcs.select("src", "dst").where("src <> dst").distinct())
    frontier = arcs.withColumn("hops", F.lit(1).cast("long"))
    known, hop = [frontier], 1
    while max_hops is None or hop < max_hops:
        hop += 1
        step = frontier.select("src", F.col("dst").alias("mid")).join(arcs.toDF("mid", "dst"), "mid").select("src", "dst").where("src <> dst").distinct()
        seen = _union(known).select("src", "dst")
        frontier, left = saved_rows(step.join(seen, ["src", "dst"], "left_anti").withColumn("hops", F.lit(hop).cast("long")))
        if not left:
            break
        known.append(frontier)
    return _union(known)


def layered(arcs: DataFrame) -> tuple[DataFrame, DataFrame, dict[int, dict[int, int]]]:
    """A rooted DAG of arcs (src child, dst parent) by longest depths: (node, depth); its arcs (src, dst, at, from) with the depths of their
    ends; how many arcs each depth has from each other. A cycle raises."""
    arcs = saved(arcs.select("src", "dst").where("src <> dst").distinct())
    depths = saved(longest_depth(arcs))
    placed = named_by(arcs, "src", depths.toDF("src", "at"), "dst")
    placed = saved(named_by(placed, "dst", depths.toDF("dst", "from"), "src"))
    # Which layers a layer takes from: at most the square of the height.
    feeds: dict[int, dict[int, int]] = {}
    for row in placed.groupBy("at", "from").agg(F.count("*").alias("n")).collect():
        feeds.setdefault(row["at"], {})[row["from"]] = row["n"]
    return depths, placed, feeds


def packed_closure(arcs: DataFrame) -> DataFrame:
    """(node, ancs, hops) of every node of a rooted DAG of arcs (src child, dst parent): all its ancestors and, at the same places, their least hops.

    Layer by layer of longest depths: a node takes the lists of its parents, so that a list moves once an arc and layer, and what is
    known is never gathered again. A list of parents moves whole and is cut into rows beside its node only. A cycle raises.
    """
    depths, placed, feeds = layered(arcs)
    layers = {1: depths.where("depth = 1").select("node", F.array().cast("array<long>").alias("ancs"), F.array().cast("array<short>").alias("hops"))}
    for depth in sorted(feeds):
        step = placed.where(F.col("at") == depth)
        told = _union([step.where(F.col("from") == k).join(layers[k], F.col("dst") == F.col("node")).select("src", "dst", "ancs", "hops") for k in sorted(feeds[depth])])
        told = told.repartition(-(-sum(feeds[depth].values()) // LISTS), "src").select("src", F.explode(F.concat(F.array(F.struct(F.col("dst").alias("anc"), F.lit(0).cast("short").alias("hops"))), F.arrays_zip(F.col("ancs").alias("anc"), "hops"))).alias("x"))
        least = told.groupBy("src", F.col("x.anc").alias("anc")).agg((F.min("x.hops") + 1).cast("short").alias("hops"))
        layers[depth] = saved(least.groupBy(F.col("src").alias("node")).agg(F.collect_list("anc").alias("ancs"), F.collect_list("hops").alias("hops")))
    return _union([layers[k] for k in sorted(layers)])


def named_by(rows: DataFrame, keys: str | list[str], table: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has few rows a key, on the columns ``keys``.

    Rows of a hot key are dealt over ``SALTS`` tasks by their column ``by``, the table's rows repeated for each.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    repeated = table.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(repeated.hint("merge"), [*([keys] if isinstance(keys, str) else keys), "_salt"], how).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b); a component is named by its least node.

    Each round hooks every node to its least neighbour, jumps to the roots by doubling, and
    goes on with the edges between different roots only. A round is one job for each doubling
    and one for the edges that are left.
    """
    edges, left = saved_rows(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    rounds = []
    while left:
        both = edges.select("a", "b").union(edges.select("b", "a"))
        roots, moved = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("up")), 1
        while moved:
            jumped = named_by(roots, "up", roots.toDF("up", "top"), "node")
            roots, moved = saved_rows(jumped.select("node", F.col("top").alias("up"), F.col("up").alias("before")), "up <> before")
            roots = roots.select("node", "up")
        rounds.append(roots)
        ends = named_by(named_by(edges, "a", roots.toDF("a", "ua"), "b"), "b", roots.toDF("b", "ub"), "a")
        edges, left = saved_rows(ends.where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct())
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    label = rounds[0].toDF("node", "component")
    for roots in rounds[1:]:
        label = named_by(label, "component", roots.toDF("component", "top"), "node", "left").select("node", F.coalesce("top", "component").alias("component"))
    return saved(label)


def _trimmed(arcs: DataFrame, n_arcs: int) -> tuple[DataFrame, int]:
    """The arcs (src, dst) on a way from a cycle to a cycle: those of nodes that nothing enters or leaves go, round by round."""
    while n_arcs:
        entered, left = arcs.select(F.col("dst").alias("src")).distinct(), arcs.select(F.col("src").alias("dst")).distinct()
        kept, n_kept = saved_rows(arcs.join(entered.hint("merge"), "src", "left_semi").join(left.hint("merge"), "dst", "left_semi").select("src", "dst"))
        if n_kept == n_arcs:
            break
        arcs, n_arcs = kept, n_kept
    return arcs, n_arcs


def strong_components(arcs: DataFrame) -> DataFrame:
    """(node, component) of the nodes on cycles of arcs (src, dst): nodes that reach one another share a component, named by its greatest node.

    Arcs off all cycles are trimmed. Then every node takes the greatest node that reaches it as
    its colour; what reaches the node that gave a colour, within that colour, is a component. Arcs
    between the other nodes of one colour go on. Only nodes whose colour is new move on in a
    round; the rounds are bounded by the length of the longest simple way within a colour.
    """
    arcs, n_arcs = _trimmed(*saved_rows(arcs.select("src", "dst").where("src <> dst").distinct()))
    found = []
    while n_arcs:
        nodes = arcs.select(F.col("src").alias("node"), F.col("src").alias("colour")).distinct()
        colours, newest, n_new = nodes, nodes, 1
        while n_new:
            told = newest.join(arcs.hint("merge"), newest["node"] == arcs["src"]).groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("told"))
            merged = colours.join(told.hint("merge"), "node", "left")
            merged = merged.select("node", F.greatest("colour", F.coalesce("told", "colour")).alias("colour"), (F.coalesce("told", "colour") > F.col("colour")).alias("new"))
            merged, n_new = saved_rows(merged, "new")
            colours, newest = merged.select("node", "colour"), merged.where("new").select("node", "colour")
        ends = named_by(named_by(arcs, "src", colours.toDF("src", "of"), "dst"), "dst", colours.toDF("dst", "to"), "src").where("of = to")
        arcs = saved(ends.select("src", "dst"))
        # Backwards from the nodes that gave their colours; within a colour each node belongs to one of them.
        members = [saved(colours.where("node = colour"))]
        while True:
            step = arcs.join(members[-1].hint("merge"), arcs["dst"] == members[-1]["node"]).select(F.col("src").alias("node"), "colour").distinct()
            more, n_more = saved_rows(step.join(_union(members).select("node").hint("merge"), "node", "left_anti"))
            if not n_more:
                break
            members.append(more)
        found.append(_union(members).select("node", F.col("colour").alias("component")))
        done = found[-1].select(F.col("node").alias("src"))
        rest = arcs.join(done.hint("merge"), "src", "left_anti").join(done.toDF("dst").hint("merge"), "dst", "left_anti").select("src", "dst")
        arcs, n_arcs = _trimmed(*saved_rows(rest))
    if not found:
        return arcs.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return _union(found)


def longest_depth(arcs: DataFrame, equivalent: DataFrame | None = None) -> DataFrame:
    """(node, depth): nodes of a rooted DAG of arcs (src child, dst parent) by their longest path from a root, roots at 1.

    Layers by counting open parents: a node is in the layer after the last of its parents, so
    each arc is used once and a cycle is never entered. ``equivalent`` (node, component) names
    groups of nodes: those that lie on a cycle of arcs within their group count as one node and
    share a depth. Any other cycle raises.
    """
    arcs = saved(arcs.select("src", "dst").where("src <> dst").distinct())
    nodes = arcs.select(F.col("src").alias("node")).union(arcs.select("dst")).distinct()
    one = None
    if equivalent is not None:
        group = equivalent.select("node", "component")
        within = named_by(named_by(arcs, "src", group.toDF("src", "a"), "dst"), "dst", group.toDF("dst", "b"), "src").where("a = b")
        one = saved(strong_components(within.select("src", "dst")))
        ends = named_by(named_by(arcs, "src", one.toDF("src", "a"), "dst", "left"), "dst", one.toDF("dst", "b"), "src", "left")
        arcs = saved(ends.select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst")).where("src <> dst").distinct())
        nodes = named_by(nodes, "node", one, "node", "left").select(F.coalesce("component", "node").alias("node")).distinct()
    nodes = saved(nodes)
    needs = arcs.groupBy("src").agg(F.count("*").alias("need"))
    arcs = saved(named_by(arcs, "src", needs, "dst"))
    layer, left = saved_rows(nodes.join(needs.select(F.col("src").alias("node")).hint("merge"), "node", "left_anti"))
    waiting = arcs.select(F.col("src").alias("node"), "need", F.col("need").alias("met")).where("false")
    depth, layers = 0, [nodes.withColumn("depth", F.lit(0).cast("long")).where("false")]
    while left:
        depth += 1
        layers.append(layer.select("node", F.lit(depth).cast("long").alias("depth")))
        met = arcs.join(layer.hint("merge"), arcs["dst"] == layer["node"]).select(F.col("src").alias("node"), "need", F.lit(1).cast("long").alias("met"))
        touched = met.union(waiting).groupBy("node", "need").agg(F.sum("met").alias("met"))
        touched, left = saved_rows(touched, "met = need")
        layer, waiting = touched.where("met = need").select("node"), touched.where("met < need")
    found = saved(_union(layers))
    if found.count() < nodes.count():
        raise GraphError("cycle", "a longest depth needs a graph without cycles")
    if one is None:
        return found
    rest = found.join(one.select(F.col("component").alias("node")).distinct().hint("merge"), "node", "left_anti")
    return rest.union(named_by(one, "component", found.select(F.col("node").alias("component"), "depth"), "node").select("node", "depth"))
