"""Rules that add or move edges: equivalence groups, set expansion, inverses, inheritance, obsolescence, clean-up."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import DEFINING_TYPES, EDGE_COLUMNS, EDGE_KEY, OWL, RETIRED_ROOTS, Graph, GraphError
from ..session import saved, saved_rows
from .closure import LISTS, components, layered, named_by, reach

#: Objects a bin holds at most, about, when inherited edges are packed in lists.
OBJECTS = 50_000


def as_edges(found: DataFrame, kbid: int | Column = 1, **flags) -> DataFrame:
    """Edges with all columns from a frame that holds the key; ``flags`` set other columns."""
    own = lambda c: F.col(c) if c in found.columns else None
    default = {
        "kbid": kbid if isinstance(kbid, Column) else F.lit(kbid), "org_rid1": F.lit(None).cast("long"), "org_rid2": F.lit(None).cast("long"),
        "derived": F.lit(False), "hidden": F.lit(False), "restriction_type": F.lit(None).cast("string"),
        "restriction_stmt": F.lit(None).cast("string"), "is_obsolete": F.lit(False),
    }
    pick = lambda c: F.lit(flags[c]) if c in flags else own(c) if own(c) is not None else default[c]
    return found.select(*(pick(c).alias(c) for c in EDGE_COLUMNS))


def property_id(graph: Graph, name: str) -> DataFrame:
    return graph.properties.where(F.col("name") == name).select(F.col("id").alias("pid"))


def of_property(graph: Graph, name: str) -> DataFrame:
    return graph.live_edges.join(F.broadcast(property_id(graph, name)), "pid", "left_semi")  # one property row: its edges needn't meet in one task


def equivalence_groups(graph: Graph) -> DataFrame:
    """(rid, ridm): members of groups of equivalent named classes and their representative.

    The representative is the least id that is not obsolete, or the least id of all.
    """
    pairs = of_property(graph, "equivalentClass").where("rtid1 = 1 and rtid2 = 1").select(F.col("rid1").alias("a"), F.col("rid2").alias("b"))
    label = components(pairs)
    classes = graph.nodes.where("rtid = 1").select(F.col("rid").alias("node"), "is_obsolete")
    members = label.join(classes, "node", "left")
    rep = members.groupBy("component").agg(
        F.coalesce(F.min(F.when(~F.coalesce("is_obsolete", F.lit(False)), F.col("node"))), F.min("node")).alias("rid")
    )
    return members.join(rep, "component").select("rid", F.col("node").alias("ridm"))


def move_equivalent_edges(graph: Graph, groups: DataFrame) -> DataFrame:
    """All edges with class ends on members moved to their representatives; repeats fall away, equivalentClass edges stay."""
    same = property_id(graph, "equivalentClass").withColumn("stays", F.lit(True))
    reps = groups.where("rid <> ridm")
    out = graph.edges.join(F.broadcast(same), "pid", "left")  # one property row
    for k in "12":
        own = reps.select(F.col("ridm").alias(f"rid{k}"), F.lit(1).alias(f"rtid{k}"), F.col("rid").alias(f"rep{k}"))
        out = out.join(own, [f"rid{k}", f"rtid{k}"], "left")
        out = out.withColumn(f"rep{k}", F.when(F.col("stays").isNull(), F.col(f"rep{k}")))
    moved = out.select(
        F.coalesce("rep1", "rid1").alias("rid1"), "rtid1", "pid", F.coalesce("rep2", "rid2").alias("rid2"), "rtid2", "kbid",
        F.when(F.col("rep1").isNotNull(), F.col("rid1")).otherwise(F.col("org_rid1")).alias("org_rid1"),
        F.when(F.col("rep2").isNotNull(), F.col("rid2")).otherwise(F.col("org_rid2")).alias("org_rid2"),
        *EDGE_COLUMNS[8:],
    )
    # Of edges that become equal, the one that did not move comes first.
    order = Window.partitionBy(*EDGE_KEY).orderBy(F.col("org_rid1").asc_nulls_first(), F.col("org_rid2").asc_nulls_first())
    return moved.withColumn("turn", F.row_number().over(order)).where("turn = 1").select(*EDGE_COLUMNS)


def backfill_labels(graph: Graph, groups: DataFrame) -> DataFrame:
    """Nodes; a representative whose label is its bare name takes the least other label in its group."""
    classes = graph.nodes.where("rtid = 1")
    proper = classes.where("label <> name").select(F.col("rid").alias("ridm"), "label")
    best = groups.join(proper, "ridm").groupBy("rid").agg(F.min("label").alias("better")).withColumn("rtid", F.lit(1))
    joined = graph.nodes.join(best, ["rid", "rtid"], "left")
    label = F.when(F.coalesce(F.col("label") == F.col("name"), F.lit(True)), F.coalesce("better", "label")).otherwise(F.col("label"))
    return joined.select(*(label.alias(c) if c == "label" else c for c in graph.nodes.columns))


def _new_only(found: DataFrame, known: DataFrame) -> DataFrame:
    return found.select(*EDGE_KEY).distinct().join(known.select(*EDGE_KEY).distinct(), list(EDGE_KEY), "left_anti")


def set_subclasses(graph: Graph, intersections: DataFrame, unions: DataFrame) -> DataFrame:
    """New subClassOf edges: A equivalent to an intersection is below its parts, an equivalent union's parts are below A,
    and a class below an intersection is below the parts, through nested intersections to the end.

    ``intersections`` and ``unions`` hold (id, classid, rtid): the parts of each set class.
    """
    pid = property_id(graph, "subClassOf")
    same = of_property(graph, "equivalentClass")
    turned = same.select(F.col("rid2").alias("rid1"), F.col("rtid2").alias("rtid1"), F.col("rid1").alias("rid2"), F.col("rtid1").alias("rtid2"))
    named = same.select("rid1", "rtid1", "rid2", "rtid2").unionByName(turned).where("rtid1 = 1")
    below = of_property(graph, "subClassOf").where("rtid1 = 1").select("rid1", "rtid1", "rid2", "rtid2").unionByName(named)
    parts = intersections.where("rtid in (1, 8)").select(F.col("id").alias("rid2"), "classid", F.col("rtid").alias("part_type"))
    frontier, left = saved_rows(below.where("rtid2 = 8").select("rid1", "rtid1", "rid2").distinct())
    found, seen = None, frontier
    while left:
        step = frontier.join(parts, "rid2").select("rid1", "rtid1", F.col("classid").alias("rid2"), F.col("part_type").alias("rtid2"))
        found = step if found is None else found.unionByName(step)
        deeper = step.where("rtid2 = 8").select("rid1", "rtid1", "rid2").distinct()
        frontier, left = saved_rows(deeper.join(seen, ["rid1", "rtid1", "rid2"], "left_anti"))
        seen = seen.unionByName(frontier)
    members = unions.where("rtid in (1, 9)").select(F.col("id").alias("rid2"), F.col("classid").alias("part"), F.col("rtid").alias("part_type"))
    upward = named.where("rtid2 = 9").join(members, "rid2").select(
        F.col("part").alias("rid1"), F.col("part_type").alias("rtid1"), F.col("rid1").alias("rid2"), F.col("rtid1").alias("rtid2")
    )
    found = upward if found is None else found.unionByName(upward)
    found = found.where("not (rid1 = rid2 and rtid1 = rtid2)").crossJoin(F.broadcast(pid))  # one property row
    return as_edges(_new_only(found, graph.edges), derived=True)


def inverse_edges(graph: Graph) -> DataFrame:
    """New edges that inverse properties imply, in both directions."""
    pairs = graph.inverse_properties.select(F.col("propertyid1").alias("pid"), F.col("propertyid2").alias("other"))
    pairs = pairs.union(pairs.select("other", "pid")).distinct()
    turned = named_by(graph.live_edges.where("not hidden"), "pid", pairs, "rid1").select(
        F.col("rid2").alias("rid1"), F.col("rtid2").alias("rtid1"), F.col("other").alias("pid"), F.col("rid1").alias("rid2"), F.col("rtid1").alias("rtid2")
    )
    return as_edges(_new_only(turned, graph.edges), derived=True)


def inheritable_edges(graph: Graph, pid: int, sub_properties: list[int]) -> DataFrame:
    """New edges C -p-> X where C is below D and D -p-> X, unless C has an edge to X by p or a sub-property of it already.

    The property of the new edge is the inherited edge's own, that of the nearest D. A hierarchy with cycles is walked edge by edge.
    """
    family = sorted({pid, *sub_properties})
    arcs = of_property(graph, "subClassOf").where("rtid1 = 1 and rtid2 = 1 and rid1 <> rid2").select(F.col("rid1").alias("src"), F.col("rid2").alias("dst"))
    arcs = saved(arcs.distinct())
    own = graph.live_edges.where(F.col("pid").isin(family) & (F.col("rtid1") == 1) & ~F.col("hidden"))
    own = saved(own.select("rid1", "pid", "rid2", "rtid2").distinct())
    try:
        new = _inherited_by_layers(arcs, own, len(family) > 1)
    except GraphError as found:
        if found.kind != "cycle":
            raise
        new = _inherited_in_rounds(arcs, own)
    return as_edges(new.withColumn("rtid1", F.lit(1)), derived=True)


def _inherited_by_layers(arcs: DataFrame, own: DataFrame, several: bool) -> DataFrame:
    """(rid1, pid, rid2, rtid2) inherited over a DAG of arcs (src child, dst parent), layer by layer of longest depths; a cycle raises.

    A class takes the lists of its parents, so that a list moves once an arc and what is held is never gathered again. Objects are
    dealt into bins of some ``OBJECTS``, a list a class and bin. ``several``: more than one property, so the nearest edge tells which.
    """
    depths, placed, feeds = layered(arcs)
    entry = ["rid2", "rtid2", "pid", "hops"]
    bins = own.select(F.approx_count_distinct(F.xxhash64("rid2", "rtid2"))).first()[0] // OBJECTS + 1
    # A step adds a hop, so own edges begin below 0.
    start = own.select(F.col("rid1").alias("node"), F.pmod(F.xxhash64("rid2", "rtid2"), F.lit(bins)).alias("bin"), "rid2", "rtid2", "pid", F.lit(-1).alias("hops"))
    start = saved(named_by(start, "node", depths, "rid2"))
    n_own = {r["depth"]: r["n"] for r in start.groupBy("depth").agg(F.count("*").alias("n")).collect()}  # a row a layer
    layers: dict[int, DataFrame] = {}
    for depth in sorted({1, *n_own, *feeds}):
        told = start.where(F.col("depth") == depth).select("node", "bin", *(F.array(c).alias(c) for c in entry))
        if depth in feeds:
            above = functools.reduce(DataFrame.unionByName, (layers[k] for k in sorted(feeds[depth])))
            step = placed.where(F.col("at") == depth).join(above.hint("merge"), F.col("dst") == F.col("node"))
            told = told.unionByName(step.select(F.col("src").alias("node"), "bin", *entry))
        tasks = -(-(n_own.get(depth, 0) + bins * sum(feeds.get(depth, {}).values())) // LISTS)
        told = told.repartition(max(tasks, 1), "node", "bin").select("node", "bin", F.inline(F.arrays_zip(*entry)))
        held = told.groupBy("node", "bin", "rid2", "rtid2", "pid").agg((F.min("hops") + 1).alias("hops"))
        if several:
            near = Window.partitionBy("node", "bin", "rid2", "rtid2")
            held = held.withColumn("near", F.min("hops").over(near)).where("hops = near")
        layers[depth] = saved(held.groupBy("node", "bin").agg(*(F.collect_list(c).alias(c) for c in entry)))
    every = functools.reduce(DataFrame.unionByName, layers.values())
    return every.select(F.col("node").alias("rid1"), F.inline(F.arrays_zip(*entry))).where("hops > 0").select("rid1", "pid", "rid2", "rtid2")


def _inherited_in_rounds(arcs: DataFrame, own: DataFrame) -> DataFrame:
    """(rid1, pid, rid2, rtid2) inherited over any arcs (src child, dst parent): semi-naive to the fixpoint."""
    frontier, new = own, own.where("false")
    held = own.select("rid1", "rid2", "rtid2").distinct()
    while True:
        step = frontier.join(arcs, frontier["rid1"] == arcs["dst"]).select(F.col("src").alias("rid1"), "pid", "rid2", "rtid2").distinct()
        frontier, left = saved_rows(step.join(held, ["rid1", "rid2", "rtid2"], "left_anti"))
        if not left:
            return new
        held = held.unionByName(frontier.select("rid1", "rid2", "rtid2").distinct())
        new = new.unionByName(frontier)


def copy_across_equivalents(graph: Graph) -> DataFrame:
    """New edges from copying those at either end of a class to its equivalent classes, both ways; two-cycles of subClassOf are left out."""
    same = of_property(graph, "equivalentClass").where("rtid1 = 1 and rtid2 = 1").select(F.col("rid1").alias("a"), F.col("rid2").alias("b"))
    same = same.union(same.select("b", "a")).distinct()
    eq, sub = (F.broadcast(property_id(graph, n)) for n in ("equivalentClass", "subClassOf"))  # one property row each
    edges = graph.live_edges.where("not hidden").join(eq, "pid", "left_anti")
    subject = edges.where("rtid1 = 1").join(same, F.col("rid1") == F.col("a")).withColumn("rid1", F.col("b"))
    object_ = edges.where("rtid2 = 1").join(same, F.col("rid2") == F.col("a")).withColumn("rid2", F.col("b"))
    new = saved(_new_only(subject.select(*EDGE_KEY).unionByName(object_.select(*EDGE_KEY)), graph.edges).where("not (rid1 = rid2 and rtid1 = rtid2)"))
    every = graph.edges.select(*EDGE_KEY).unionByName(new).join(sub, "pid", "left_semi")
    turned = every.select(F.col("rid2").alias("rid1"), F.col("rtid2").alias("rtid1"), "pid", F.col("rid1").alias("rid2"), F.col("rtid1").alias("rtid2")).distinct()
    return as_edges(new.join(turned, list(EDGE_KEY), "left_anti"), derived=True)


def without_mutual(pairs: DataFrame, child: str, parent: str) -> DataFrame:
    """Pairs whose reverse is not there as well; self-pairs fall away."""
    reverse = pairs.select(F.col(parent).alias(child), F.col(child).alias(parent)).distinct()
    return pairs.join(reverse.hint("merge"), [child, parent], "left_anti")


def domain_range_edges(domains: DataFrame, ranges: DataFrame, top: int) -> DataFrame:
    """(rid1, pid, rid2): every domain of a property to every range of it; a missing side is the top class."""
    d = domains.select("pid", F.col("rid").alias("rid1")).distinct()
    r = ranges.select("pid", F.col("rid").alias("rid2")).distinct()
    both = d.join(r, "pid", "full_outer")
    return both.select(F.coalesce("rid1", F.lit(top)).alias("rid1"), "pid", F.coalesce("rid2", F.lit(top)).alias("rid2"))


def unhide_restrictions(edges: DataFrame) -> DataFrame:
    """Edges; a hidden one shows where its subject is the object of a visible one."""
    shown = edges.where("not hidden").select(F.col("rid2").alias("rid1"), F.col("rtid2").alias("rtid1"), F.lit(True).alias("shown")).distinct()
    hidden = edges.where("hidden").join(shown.hint("merge"), ["rid1", "rtid1"], "left").withColumn("hidden", F.col("shown").isNull())
    return edges.where("hidden is not true").unionByName(hidden.select(*edges.columns))


def deprecated_classes(graph: Graph) -> DataFrame:
    """(rid) of the classes that the vocabulary's ``deprecated`` calls true."""
    mark = graph.nodes.where((F.col("rtid") == 15) & (F.col("uri") == f"{OWL}deprecated")).select(F.col("rid").alias("pid"))
    true = graph.nodes.where("rtid = 13 and name = 'true'").select(F.col("rid").alias("rid2"))
    said = graph.edges.where("rtid1 = 1 and rtid2 = 13").join(mark, "pid", "left_semi").join(true, "rid2", "left_semi")
    return said.select(F.col("rid1").alias("rid")).distinct()


def retired_roots(graph: Graph) -> DataFrame:
    """(rid) of the classes below which all are retired, by name or label."""
    named = F.lower("name").isin(*map(str.lower, RETIRED_ROOTS)) | F.lower("label").isin(*map(str.lower, RETIRED_ROOTS))
    return graph.nodes.where((F.col("rtid") == 1) & named).select("rid").distinct()


def propagate_obsolete(graph: Graph, deprecated: DataFrame, retired: DataFrame) -> Graph:
    """The graph with flags set: deprecated classes (rid), all classes below a retired root (rid), and every edge that touches one.

    A root itself stays: only what lies below it is retired.
    """
    arcs = of_property(graph, "subClassOf").where("rtid1 = 1 and rtid2 = 1").select(F.col("rid2").alias("src"), F.col("rid1").alias("dst"))
    below = reach(arcs, retired.select(F.col("rid").alias("seed"))).where("hops > 0").select(F.col("node").alias("rid"))
    gone = saved(deprecated.select("rid").union(below).distinct().withColumns({"rtid": F.lit(1), "gone": F.lit(True)}))
    flag = lambda *hits: F.col("is_obsolete") | F.coalesce(*hits, F.lit(False))
    nodes = graph.nodes.join(gone, ["rid", "rtid"], "left")
    nodes = nodes.select(*(flag("gone").alias(c) if c == "is_obsolete" else F.col(c) for c in graph.nodes.columns))
    dead = saved(nodes.where("is_obsolete").select("rid", "rtid").distinct())
    edges = graph.edges
    for k in "12":
        edges = edges.join(dead.select(F.col("rid").alias(f"rid{k}"), F.col("rtid").alias(f"rtid{k}"), F.lit(True).alias(f"dead{k}")), [f"rid{k}", f"rtid{k}"], "left")
    edges = edges.select(*(flag("dead1", "dead2").alias(c) if c == "is_obsolete" else F.col(c) for c in graph.edges.columns))
    return Graph(nodes, edges, graph.properties, graph.sub_properties, graph.inverse_properties, graph.kbs, graph.extra)


def without_duplicate_synonyms(graph: Graph, name: str = "synonym") -> DataFrame:
    """Edges less the synonym edges whose literal is the class's own label, whatever the case."""
    label = lambda k: graph.nodes.select(F.col("rid").alias(f"rid{k}"), F.col("rtid").alias(f"rtid{k}"), F.lower(F.coalesce("label", "name")).alias(f"l{k}"))
    repeats = graph.edges.join(property_id(graph, name), "pid", "left_semi").where("rtid2 = 13")
    repeats = repeats.join(label(1), ["rid1", "rtid1"]).join(label(2), ["rid2", "rtid2"]).where("l1 = l2").select(*EDGE_KEY)
    return graph.edges.join(repeats, list(EDGE_KEY), "left_anti")


def replace_labels(graph: Graph, root: DataFrame, name: str) -> DataFrame:
    """Nodes; all classes below the root (rid) take the least value of a property as their label."""
    arcs = of_property(graph, "subClassOf").where("rtid1 = 1 and rtid2 = 1").select(F.col("rid2").alias("src"), F.col("rid1").alias("dst"))
    below = reach(arcs, root.select(F.col("rid").alias("seed"))).select(F.col("node").alias("rid")).distinct()
    value = of_property(graph, name).where("rtid1 = 1").select(F.col("rid1").alias("rid"), F.col("rid2").alias("v"))
    texts = graph.nodes.where("rtid = 13").select(F.col("rid").alias("v"), F.coalesce("label", "name").alias("text"))
    better = value.join(below, "rid", "left_semi").join(texts, "v").groupBy("rid").agg(F.min("text").alias("better")).withColumn("rtid", F.lit(1))
    joined = graph.nodes.join(better, ["rid", "rtid"], "left")
    return joined.select(*(F.coalesce("better", "label").alias(c) if c == "label" else F.col(c) for c in graph.nodes.columns))


def single_use_instances(graph: Graph, of_class: DataFrame, type_name: str = "type") -> DataFrame:
    """(rid) of individuals of the classes (rid) with exactly one relationship: candidates to delete."""
    typed = of_property(graph, type_name).join(of_class.select(F.col("rid").alias("rid2")), "rid2", "left_semi").where("rtid1 = 12").select("rid1").distinct()
    uses = graph.live_edges.where("rtid1 = 12").join(typed, "rid1", "left_semi").groupBy("rid1").count()
    return uses.where("count = 1").select(F.col("rid1").alias("rid"))


def pathway_labels(names: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(rid, label): display name, else standard name; a reaction's label is ``[l1]+[l2] -> [r1]`` of its sides (rid, part)."""
    label = names.select("rid", F.coalesce("display_name", "standard_name").alias("label"))
    side = lambda parts, out: (
        parts.join(label.toDF("part", "part_label"), "part").groupBy("rid")
        .agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("["), "part_label", F.lit("]")))), "+").alias(out))
    )
    reactions = side(left, "l").join(side(right, "r"), "rid", "full_outer")
    composed = reactions.select("rid", F.concat(F.coalesce("l", F.lit("")), F.lit(" -> "), F.coalesce("r", F.lit(""))).alias("composed"))
    return label.join(composed, "rid", "full_outer").select("rid", F.coalesce("composed", "label").alias("label"))


def has_definition(graph: Graph) -> DataFrame:
    """(rid) of named classes with an equivalent class of a defining type."""
    edges = of_property(graph, "equivalentClass").where(F.col("rtid2").isin(*DEFINING_TYPES)).where("rtid1 = 1")
    return edges.select(F.col("rid1").alias("rid")).distinct()


def delete_kb(graph: Graph, kbid: int) -> Graph:
    """The graph without one knowledge base."""
    keep = lambda df: df.where(F.col("kbid") != kbid)
    parts = (graph.nodes, graph.edges, graph.properties, graph.sub_properties, graph.inverse_properties)
    return Graph(*map(keep, parts), graph.kbs.where(F.col("id") != kbid), graph.extra)


def rename_kb(graph: Graph, old: str, new: str) -> Graph:
    """The graph with one knowledge base under a new name; the one that had it before goes."""
    replaced = [r["id"] for r in graph.kbs.where(F.col("name") == new).select("id").collect()]
    for kbid in replaced:
        graph = delete_kb(graph, kbid)
    kbs = graph.kbs.withColumn("name", F.when(F.col("name") == old, F.lit(new)).otherwise(F.col("name")))
    return Graph(graph.nodes, graph.edges, graph.properties, graph.sub_properties, graph.inverse_properties, kbs, graph.extra)
