"""A graph's operators as functions of SQL statements, scalar and table-valued, for use with LATERAL.

They are SQL functions that Spark inlines into the statement's plan, so that a lateral join
becomes a join on ids. Ancestors and descendants come from reachability labels cut into
power-of-two blocks, not from a closure: both sides of a block are equi-joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..model import Graph
from ..operators import labels

FUNCTIONS = {
    "graph_name(rid BIGINT, rtid INT) RETURNS STRING": "(SELECT max(n.name) FROM graph_nodes n WHERE n.rid = graph_name.rid AND n.rtid = graph_name.rtid)",
    "graph_neighbors_out(rid BIGINT, rtid INT, pid INT) RETURNS TABLE(rid BIGINT, rtid INT)": (
        "SELECT e.rid2, e.rtid2 FROM graph_edges e WHERE e.rid1 = graph_neighbors_out.rid AND e.rtid1 = graph_neighbors_out.rtid AND e.pid = graph_neighbors_out.pid"
    ),
    "graph_neighbors_in(rid BIGINT, rtid INT, pid INT) RETURNS TABLE(rid BIGINT, rtid INT)": (
        "SELECT e.rid1, e.rtid1 FROM graph_edges e WHERE e.rid2 = graph_neighbors_in.rid AND e.rtid2 = graph_neighbors_in.rtid AND e.pid = graph_neighbors_in.pid"
    ),
}
OF_HIERARCHY = {
    "graph_ancestors(rid BIGINT) RETURNS TABLE(rid BIGINT)": (
        "SELECT c.node FROM graph_keys k JOIN graph_covers c ON c.level = k.level AND c.block = k.block WHERE k.node = graph_ancestors.rid AND c.node <> k.node"
    ),
    "graph_descendants(rid BIGINT) RETURNS TABLE(rid BIGINT)": (
        "SELECT k.node FROM graph_covers c JOIN graph_keys k ON c.level = k.level AND c.block = k.block WHERE c.node = graph_descendants.rid AND c.node <> k.node"
    ),
}


def register(graph: Graph, arcs: DataFrame | None = None) -> SparkSession:
    """Views ``graph_nodes``, ``graph_edges`` and ``graph_properties``, and the functions over them.

    With the child -> parent ``arcs`` (src, dst) of a hierarchy, its ancestors and descendants too.
    """
    spark = graph.nodes.sparkSession
    tables = {"nodes": graph.live_nodes, "edges": graph.live_edges, "properties": graph.properties}
    functions = dict(FUNCTIONS)
    if arcs is not None:
        index = labels.label_index(arcs)
        tables |= {"keys": labels.keys(index), "covers": labels.covers(index)}
        functions |= OF_HIERARCHY
    for name, table in tables.items():
        table.createOrReplaceTempView(f"graph_{name}")
    for head, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return spark
