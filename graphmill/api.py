"""The request surface as functions: each takes a graph and parameters and returns a DataFrame.

Routes of the service that this library replaces map to: ontologies -> ``ontologies``; concepts by id, address,
term or search -> ``concept`` and ``concept_search``; siblings -> ``siblings_of``; rel/{type} -> ``relations``;
keyword (with ancestors) -> ``keyword``; reconcile -> ``reconciled``; getprop -> ``property_list``; cards ->
``card_listing``; the XML responses of relationships -> ``neighborhood_document``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import render, sql
from .model import SYNONYM_PROPERTIES, Graph, GraphError
from .operators import category, dag, search, traverse

#: Literal properties of each part of a concept's details (fixed values).
DETAILS = {
    "definitions": ["definition", "externallySourcedDefinition", "IAO_0000115"],
    "comments": ["comment", "curatorNote"],
    "synonyms": [name for name in SYNONYM_PROPERTIES if name not in ("label", "prefLabel")],
}

Function = Callable[..., DataFrame]
#: Named functions that callers may extend: (graph, **parameters) -> DataFrame.
FUNCTIONS: dict[str, Function] = {}


def function(name: str) -> Callable[[Function], Function]:
    def add(f: Function) -> Function:
        FUNCTIONS[name] = f
        return f

    return add


def execute(graph: Graph, name: str, **parameters) -> DataFrame:
    if name not in FUNCTIONS:
        raise GraphError("function", f"no function {name!r}")
    return FUNCTIONS[name](graph, **parameters)


def seeds(graph: Graph, terms: Iterable[str] = (), ids: Iterable[tuple[int, int]] = (), uris: Iterable[str] = ()) -> DataFrame:
    """(rid, rtid) of terms, ids and addresses."""
    spark = graph.nodes.sparkSession
    found = spark.createDataFrame(list(ids), "rid long, rtid int")
    if terms := list(terms):
        found = found.union(search.ids_by_term(graph, terms, use_label=True).select("rid", "rtid"))
    if uris := list(uris):
        found = found.union(graph.live_nodes.where(F.col("uri").isin(uris)).select("rid", "rtid"))
    return found.distinct()


@function("sql")
def run_sql(graph: Graph, statement: str, hierarchy: DataFrame | None = None, **arguments) -> DataFrame:
    """A statement over the graph's tables (nodes, edges, properties) and functions, with named arguments, never pasted text.

    ``hierarchy``: child -> parent arcs (src, dst) whose ancestors and descendants the statement may ask for.
    """
    return sql.register(graph, hierarchy).sql(statement, args=arguments or None)


@function("ontologies")
def ontologies(graph: Graph) -> DataFrame:
    """(id, name, rid, rtid, uri): knowledge bases and the ontologies in them; one without an ontology has nulls."""
    own = graph.live_nodes.where("rtid = 18").select("rid", "rtid", F.coalesce("uri", "name").alias("uri"), F.col("kbid").alias("id"))
    return search.list_kbs(graph).join(own, "id", "left").select("id", "name", "rid", "rtid", "uri")


@function("concept")
def concept(graph: Graph, terms=(), ids=(), uris=()) -> DataFrame:
    wanted = seeds(graph, terms, ids, uris).where("rtid = 1").select("rid")
    return search.concept_details(graph, DETAILS).join(wanted, "rid", "left_semi")


@function("concept_search")
def concept_search(graph: Graph, text: str, limit: int = search.CONCEPT_LIMIT, max_distance: int = search.MAX_EDIT_DISTANCE) -> DataFrame:
    return search.search_concepts(graph, text, DETAILS, limit, max_distance)


@function("siblings")
def siblings_of(graph: Graph, name: str = "subClassOf", **wanted) -> DataFrame:
    arcs = traverse.chosen_edges(graph, [name]).where("rtid1 = 1 and rtid2 = 1").select(F.col("rid1").alias("src"), F.col("rid2").alias("dst"))
    asked = seeds(graph, **wanted).select(F.col("rid").alias("node"))
    found = search.siblings(arcs).join(asked, "node", "left_semi").select(F.col("sibling").alias("rid")).distinct()
    return found.join(asked.withColumnRenamed("node", "rid"), "rid", "left_anti")


@function("relations")
def relations(graph: Graph, kind: str = "all", level: int = 1, name: str | None = None, **wanted) -> DataFrame:
    """Relationships of a kind: parents, children, subclasses, superclasses, parts, whole, all, edge_relation, all_subclasses,
    all_parts_of, all_has_parts or closure. The closures of part_of name their direction: parts of a whole come in, wholes go out."""
    if kind == "edge_relation":
        return traverse.named(graph, search.edge_relation(graph, name or ""))
    at = seeds(graph, **wanted)
    closures = {"all_subclasses": ("subClassOf", True), "all_parts_of": ("part_of", True), "all_has_parts": ("part_of", False), "closure": (name, False)}
    if kind in closures:
        followed, incoming = closures[kind]
        return traverse.closure_by_property(graph, at, followed or "", incoming)
    try:
        wanted_kind = traverse.Kind[kind.upper()]
    except KeyError:
        raise GraphError("argument", f"unknown kind {kind!r}") from None
    return traverse.graph_request(graph, wanted_kind, at, level or None)


@function("keyword")
def keyword(graph: Graph, text: str, limit: int = search.TERM_LIMIT, ancestors: Iterable[str] = (), index: DataFrame | None = None) -> DataFrame:
    terms = search.term_dictionary(graph)
    if ancestors := list(ancestors):
        if index is None:
            arcs = traverse.chosen_edges(graph, ["subClassOf"]).where("rtid1 = 1 and rtid2 = 1")
            index = dag.index_below(arcs.select(F.col("rid1").alias("src"), F.col("rid2").alias("dst")), seeds(graph, ancestors).select(F.col("rid").alias("node")))
        terms = search.with_ancestor(terms, index, seeds(graph, ancestors))
    return search.autocomplete(terms, text, limit)


@function("reconcile")
def reconciled(graph: Graph, text: str, categories: DataFrame, **options) -> DataFrame:
    """Candidates of a text among categorised classes (rid, category)."""
    return search.reconcile(search.term_dictionary(graph).join(categories, "rid"), text, **options)


@function("properties")
def property_list(graph: Graph, kinds: Iterable[str] = ()) -> DataFrame:
    return search.property_nodes(graph, kinds)


@function("cards")
def card_listing(graph: Graph, roots: Iterable[str], pivots: dict[str, str], index: DataFrame | None = None) -> DataFrame:
    """(line) the cards of the classes below the roots, a tab-separated line each."""
    if index is None:
        arcs = traverse.chosen_edges(graph, ["subClassOf"]).where("rtid1 = 1 and rtid2 = 1")
        index = dag.index_below(arcs.select(F.col("rid1").alias("src"), F.col("rid2").alias("dst")), seeds(graph, roots).select(F.col("rid").alias("node")))
    return render.tab_separated(category.card(graph, index, seeds(graph, roots).select("rid"), pivots))


@function("neighborhood_document")
def neighborhood_document(graph: Graph, kind: str = "all", level: int = 1, limit: int = traverse.NEIGHBOR_LIMIT, **wanted) -> DataFrame:
    """(xml) the response to a request of relationships: at most ``limit`` of them, and whether there were more."""
    found, more = traverse.truncated(relations(graph, kind, level, **wanted), limit)
    return render.relationships_document(found, more)


def cursor(found: DataFrame):
    """Rows one after another, partition by partition: never the whole result at once."""
    return found.toLocalIterator(prefetchPartitions=True)
