"""Neighbourhoods and edge closures."""

from __future__ import annotations

from collections.abc import Iterable
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import EDGE_KEY, Graph, GraphError, ResourceType, nid
from ..session import saved
from .closure import reach

#: Most edges that a neighbourhood request of the API returns.
NEIGHBOR_LIMIT = 1000
#: Properties that graph requests never follow (fixed values).
NEVER_FOLLOWED = ("disjointWith", "sameAs")


class Kind(Enum):
    """Kinds of graph requests: property followed, and whether edges are read from object to subject."""

    PARENTS = ("subClassOf", False)
    CHILDREN = ("subClassOf", True)
    SUPERCLASSES = ("subClassOf", False)
    SUBCLASSES = ("subClassOf", True)
    PARTS = ("part_of", True)
    WHOLE = ("part_of", False)
    ALL = (None, None)


def expand_properties(graph: Graph, pids: Iterable[int]) -> list[int]:
    """The properties and all their direct and indirect sub-properties. Property tables are dictionaries: a few rows reach the driver."""
    below: dict[int, set[int]] = {}
    for r in graph.sub_properties.select("parentid", "childid").collect():
        below.setdefault(r["parentid"], set()).add(r["childid"])
    found, todo = set(), list(pids)
    while todo:
        p = todo.pop()
        if p not in found:
            found.add(p)
            todo += below.get(p, ())
    return sorted(found)


def property_ids(graph: Graph, names: Iterable[str]) -> list[int]:
    return [r["id"] for r in graph.properties.where(F.col("name").isin(list(names))).select("id").orderBy("id").collect()]


def chosen_edges(
    graph: Graph,
    include: Iterable[str] | None = None,
    exclude: Iterable[str] = (),
    sub_properties: bool = False,
    hidden: bool = False,
) -> DataFrame:
    """Live edges of the wanted properties. An unknown wanted property gives no edges; none or ``*`` means all."""
    edges = graph.live_edges if hidden else graph.live_edges.where("not hidden")
    wanted = [n for n in include or () if n not in ("", "*")]
    if include and wanted:
        pids = property_ids(graph, wanted)
        edges = edges.where(F.col("pid").isin(expand_properties(graph, pids) if sub_properties else pids))
    unwanted = property_ids(graph, exclude)
    if unwanted:
        edges = edges.where(~F.col("pid").isin(expand_properties(graph, unwanted) if sub_properties else unwanted))
    return edges


def arcs_of(edges: DataFrame, incoming: bool = False) -> DataFrame:
    """(src, dst) in the direction of travel: against the edges if ``incoming``."""
    subject, object_ = nid("rid1", "rtid1"), nid("rid2", "rtid2")
    return edges.select((object_ if incoming else subject).alias("src"), (subject if incoming else object_).alias("dst"))


def representatives(graph: Graph, seeds: DataFrame) -> DataFrame:
    """Seeds (rid, rtid) with equivalent classes replaced by the representative of their group."""
    groups = graph.extra.get("equivalence")
    if groups is None:
        return seeds.select("rid", "rtid")
    groups = groups.select(F.col("rid").alias("rep"), F.col("ridm").alias("rid"))
    is_class = F.col("rtid") == int(ResourceType.CLASS)
    return seeds.join(groups, "rid", "left").select(F.when(is_class, F.coalesce("rep", "rid")).otherwise(F.col("rid")).alias("rid"), "rtid").distinct()


def neighborhood(edges: DataFrame, seeds: DataFrame, hops: int | None = 1, incoming: bool = False, class_only: bool = False) -> DataFrame:
    """Every edge that leaves (or enters) a node within ``hops`` of the seeds (rid, rtid); None or 0: without bound.

    Edges to nodes already visited are kept, self-loops are not. ``class_only`` drops edges
    with an end that is not a named class, but the walk goes on through them.
    """
    edges = edges.where("not (rid1 = rid2 and rtid1 = rtid2)")
    seeds = seeds.select(nid("rid", "rtid").alias("seed"))
    if hops == 1:
        near = seeds.select(F.col("seed").alias("node")).distinct()
    else:
        one = seeds.select(F.lit(0).alias("seed"), F.col("seed").alias("node"))
        near = _from_any(arcs_of(edges, incoming), one, hops - 1 if hops else None).select("node")
    end = nid("rid2", "rtid2") if incoming else nid("rid1", "rtid1")
    found = edges.join(near, end == near["node"], "left_semi")
    if class_only:
        found = found.where(f"rtid1 = {int(ResourceType.CLASS)} and rtid2 = {int(ResourceType.CLASS)}")
    return found.dropDuplicates(list(EDGE_KEY))


def _from_any(arcs: DataFrame, start: DataFrame, max_hops: int | None) -> DataFrame:
    """(node, hops): nodes within reach of any start, by least hops."""
    arcs = saved(arcs.where("src <> dst").distinct())
    frontier = saved(start.select("node").distinct().withColumn("hops", F.lit(0).cast("long")))
    known, hop = frontier, 0
    while max_hops is None or hop < max_hops:
        hop += 1
        step = arcs.join(frontier, arcs["src"] == frontier["node"], "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = saved(step.join(known, "node", "left_anti").withColumn("hops", F.lit(hop).cast("long")))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def edge_closure(edges: DataFrame, seeds: DataFrame, incoming: bool = False, max_depth: int = 100) -> DataFrame:
    """The edges of a closure from the seeds, each once with its least ``depth`` (1: at a seed)."""
    edges = edges.where("not (rid1 = rid2 and rtid1 = rtid2)")
    start = seeds.select(nid("rid", "rtid").alias("node"))
    near = _from_any(arcs_of(edges, incoming), start, max_depth - 1)
    end = nid("rid2", "rtid2") if incoming else nid("rid1", "rtid1")
    return edges.join(near, end == near["node"]).withColumn("depth", F.col("hops") + 1).drop("node", "hops").dropDuplicates(list(EDGE_KEY))


def named(graph: Graph, edges: DataFrame, label: bool = False) -> DataFrame:
    """Edges as (rid1, rtid1, name1, rid2, rtid2, name2, pid, pname) plus ``depth`` where there is one."""
    names = graph.live_nodes.select("rid", "rtid", F.coalesce("label", "name").alias("n") if label else F.col("name").alias("n"))
    props = graph.properties.select(F.col("id").alias("pid"), F.col("name").alias("pname"))
    out = edges
    for k in "12":
        out = out.join(names.toDF(f"rid{k}", f"rtid{k}", f"name{k}"), [f"rid{k}", f"rtid{k}"], "left")
    out = out.join(props, "pid", "left")
    columns = ["rid1", "rtid1", "name1", "rid2", "rtid2", "name2", "pid", "pname"] + (["depth"] if "depth" in edges.columns else [])
    return out.select(*columns)


def neighbors(
    graph: Graph, seeds: DataFrame, include=None, exclude=(), hops: int | None = 1, direction: str = "out", sub_properties=False,
    class_only=False, hidden=False,
) -> DataFrame:
    """Named edges around the seeds; ``both`` is the two directions one after the other, duplicates kept."""
    if direction not in ("out", "in", "both"):
        raise GraphError("argument", f"unknown direction {direction!r}")
    edges = chosen_edges(graph, include, exclude, sub_properties, hidden)
    seeds = representatives(graph, seeds)
    parts = [neighborhood(edges, seeds, hops, d == "in", class_only) for d in ("out", "in") if direction in (d, "both")]
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return named(graph, found)


def graph_request(graph: Graph, kind: Kind, seeds: DataFrame, hops: int | None = 1) -> DataFrame:
    """The relationships of one kind of request, each once."""
    name, incoming = kind.value
    direction = "both" if incoming is None else "in" if incoming else "out"
    found = neighbors(graph, seeds, [name] if name else None, NEVER_FOLLOWED, hops, direction, sub_properties=True)
    return found.dropDuplicates(list(EDGE_KEY))


def subclasses(graph: Graph, seeds: DataFrame, hops: int | None = None) -> DataFrame:
    return neighbors(graph, seeds, ["subClassOf"], hops=hops, direction="in", sub_properties=True)


def superclasses(graph: Graph, seeds: DataFrame, hops: int | None = None) -> DataFrame:
    return neighbors(graph, seeds, ["subClassOf"], hops=hops, direction="out", sub_properties=True)


def closure_by_property(graph: Graph, seeds: DataFrame, name: str, incoming: bool, equivalents: bool = False, max_depth: int = 100) -> DataFrame:
    """Edge closure over a property, which must exist, and its sub-properties.

    Without equivalents, edges to restriction, intersection and union classes are left out;
    with them, equivalentClass edges take part and are followed both ways.
    """
    if not property_ids(graph, [name]):
        raise GraphError("property", f"no property {name!r}")
    edges = chosen_edges(graph, [name], sub_properties=True)
    if equivalents:
        same = chosen_edges(graph, ["equivalentClass"])
        ends = {"rid1": "rid2", "rtid1": "rtid2", "rid2": "rid1", "rtid2": "rtid1"}
        edges = edges.unionByName(same).unionByName(same.select(*(F.col(ends.get(c, c)).alias(c) for c in same.columns)))
    else:
        far = "rtid1" if incoming else "rtid2"
        edges = edges.where(~F.col(far).isin(3, 8, 9))
    return named(graph, edge_closure(edges, representatives(graph, seeds), incoming, max_depth))


def one_hop(graph: Graph, terms: Iterable[str], names: Iterable[str] | None = None) -> DataFrame:
    """Class-to-class edges at classes with one of the terms as name, label or synonym; edges of symmetric properties are read both ways."""
    from .search import ids_by_term

    seeds = ids_by_term(graph, terms, use_label=True, synonyms=True, class_only=True).select("rid", "rtid").distinct()
    edges = chosen_edges(graph, names, NEVER_FOLLOWED).where("rtid1 = 1 and rtid2 = 1")
    symmetric = graph.properties.where("is_symmetric").select(F.col("id").alias("pid"))
    ends = {"rid1": "rid2", "rtid1": "rtid2", "rid2": "rid1", "rtid2": "rtid1"}
    turned = edges.join(symmetric, "pid", "left_semi").select(*(F.col(ends.get(c, c)).alias(c) for c in edges.columns))
    both = edges.unionByName(turned)
    parts = [neighborhood(both, seeds, 1, incoming) for incoming in (False, True)]
    return named(graph, parts[0].unionByName(parts[1]).dropDuplicates(list(EDGE_KEY)))


def truncated(found: DataFrame, limit: int = NEIGHBOR_LIMIT) -> tuple[DataFrame, bool]:
    """The first ``limit`` rows in the order of all columns, and whether there were more."""
    more = found.orderBy(*found.columns).limit(limit + 1)
    return more.limit(limit), more.count() > limit


__all__ = [
    "Kind", "chosen_edges", "closure_by_property", "edge_closure", "expand_properties", "graph_request", "named", "neighborhood",
    "neighbors", "one_hop", "property_ids", "reach", "representatives", "subclasses", "superclasses", "truncated",
]
