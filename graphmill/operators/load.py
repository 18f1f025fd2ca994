"""What follows the load of an ontology: the rules in their order, each on the graph that the ones before it left."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..session import saved
from . import dag, infer
from .traverse import expand_properties

#: Properties that classes inherit, and those that get an index with whether their subject stands above (fixed values).
INHERITED = ("part_of",)
INDEXED = {"has_part": True, "subClassOf": False}


def _with(graph: Graph, **changed) -> Graph:
    return replace(graph, extra=dict(graph.extra), **changed)


def _added(graph: Graph, new: DataFrame) -> Graph:
    return _with(graph, edges=saved(graph.edges.unionByName(new)))


def class_arcs(graph: Graph, name: str, subject_above: bool) -> DataFrame:
    """(src child, dst parent) between live classes over one property."""
    edges = infer.of_property(graph, name).where("rtid1 = 1 and rtid2 = 1 and not hidden")
    below, above = ("rid2", "rid1") if subject_above else ("rid1", "rid2")
    return edges.select(F.col(below).alias("src"), F.col(above).alias("dst")).distinct()


def post_processed(graph: Graph, inherited: tuple[str, ...] = INHERITED, indexed: dict[str, bool] | None = None) -> Graph:
    """The graph after all rules: equivalent classes merged, duplicate synonyms gone, set classes expanded, parts inherited, inverses added.

    ``extra`` gains the equivalence groups, and per indexed property its closure and neighbour counts
    (``index:name``, ``counts:name``); a property without edges has none.
    """
    groups = saved(infer.equivalence_groups(graph))
    graph = _with(graph, nodes=saved(infer.backfill_labels(graph, groups)), edges=saved(infer.move_equivalent_edges(graph, groups)))
    graph.extra["equivalence"] = groups
    graph = _with(graph, edges=saved(infer.without_duplicate_synonyms(graph)))
    if "intersections" in graph.extra:
        graph = _added(graph, infer.set_subclasses(graph, graph.extra["intersections"], graph.extra["unions"]))
    wanted = graph.live_nodes.where(F.lower("label").isin(*inherited) & (F.col("rtid") == 15)).select("rid").orderBy("rid").collect()  # a few properties
    for r in wanted:
        graph = _added(graph, infer.inheritable_edges(graph, r["rid"], expand_properties(graph, [r["rid"]])))
    graph = _added(graph, infer.inverse_edges(graph))
    for name, subject_above in (INDEXED if indexed is None else indexed).items():
        arcs = saved(class_arcs(graph, name, subject_above).where("src <> dst"))
        if not arcs.isEmpty():
            graph.extra[f"index:{name}"] = saved(dag.closure_index(arcs))
            graph.extra[f"counts:{name}"] = saved(dag.neighbor_counts(graph.extra[f"index:{name}"]))
    return graph
