"""Lookups and searches for names, ids and terms."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import matches
from ..model import DEFINING_TYPES, SYNONYM_PROPERTIES, Graph, GraphError, ResourceType, resource_types
from .closure import named_by

#: Default limits of the API (fixed values).
TERM_LIMIT, CONCEPT_LIMIT, MAX_EDIT_DISTANCE = 20, 100, 50
#: Terms that suggestions leave out.
REGIONAL = "regional part of"


def kb_id(graph: Graph, name: str) -> int:
    """Id of the one knowledge base of that name."""
    found = [r["id"] for r in graph.kbs.where(F.col("name") == name).limit(2).collect()]
    if len(found) != 1:
        raise GraphError("kb", f"{len(found) or 'no'} knowledge bases named {name!r}")
    return found[0]


def list_kbs(graph: Graph) -> DataFrame:
    return graph.kbs.select("id", "name")


def get_names(graph: Graph, ids: DataFrame, label: bool = False, default: Column | str | None = None) -> DataFrame:
    """(rid, rtid, name) of the wanted ids; a missing or nameless node gets the default."""
    names = graph.live_nodes.select("rid", "rtid", F.coalesce("label", "name").alias("found") if label else F.col("name").alias("found"))
    default = default if isinstance(default, Column) else F.lit(default).cast("string")
    return ids.select("rid", "rtid").join(names, ["rid", "rtid"], "left").select("rid", "rtid", F.coalesce("found", default).alias("name"))


def get_property_value(graph: Graph, name: str, subjects: DataFrame | None = None) -> DataFrame:
    """(rid, rtid, value): labels of the objects of a property, over edges that are not hidden."""
    pid = graph.properties.where(F.col("name") == name).select(F.col("id").alias("pid"))
    edges = graph.live_edges.where("not hidden").join(pid, "pid", "left_semi")
    if subjects is not None:
        edges = edges.join(subjects.select(F.col("rid").alias("rid1"), F.col("rtid").alias("rtid1")), ["rid1", "rtid1"], "left_semi")
    values = graph.live_nodes.select(F.col("rid").alias("rid2"), F.col("rtid").alias("rtid2"), F.coalesce("label", "name").alias("value"))
    return edges.join(values, ["rid2", "rtid2"]).select(F.col("rid1").alias("rid"), F.col("rtid1").alias("rtid"), "value")


def get_ontology_url(graph: Graph) -> DataFrame:
    """(rid, rtid, url) of all nodes; only classes, individuals and properties have one."""
    has = F.col("rtid").isin(1, 12, 15)
    return graph.nodes.select("rid", "rtid", F.when(has, F.col("uri")).alias("url"))


def scan(graph: Graph, left: Iterable[int] | None = None, right: Iterable[int] | None = None, kbids: Iterable[int] = ()) -> DataFrame:
    """Live edges that are not hidden, by the types of their ends; an empty list of kbs means all."""
    edges = graph.live_edges.where("not hidden")
    for column, wanted in (("rtid1", left), ("rtid2", right), ("kbid", list(kbids) or None)):
        if wanted is not None:
            edges = edges.where(F.col(column).isin(list(wanted)))
    return edges.select("rid1", "rtid1", "rid2", "rtid2", "pid")


def scan_weighted(graph: Graph) -> DataFrame:
    """Edges with a weight, literals left out."""
    literal = int(ResourceType.LITERAL)
    edges = graph.live_edges.where(f"not hidden and rtid1 <> {literal} and rtid2 <> {literal}")
    return edges.join(graph.extra["weights"], ["rid1", "rtid1", "pid", "rid2", "rtid2"]).select("rid1", "rtid1", "rid2", "rtid2", "pid", "weight")


def synonym_edges(graph: Graph, names: Iterable[str] = SYNONYM_PROPERTIES) -> DataFrame:
    """(rid, rtid, term): subjects and the literals of their synonym properties."""
    pids = graph.properties.where(F.lower("name").isin([n.lower() for n in names])).select(F.col("id").alias("pid"))
    edges = graph.live_edges.where("rtid2 = 13").join(pids, "pid", "left_semi").select("rid1", "rtid1", "rid2")
    literals = graph.live_nodes.where("rtid = 13").select(F.col("rid").alias("rid2"), F.coalesce("label", "name").alias("term"))
    return edges.join(literals, "rid2").select(F.col("rid1").alias("rid"), F.col("rtid1").alias("rtid"), "term")


def ids_by_term(graph: Graph, terms: Iterable[str], use_label: bool = False, synonyms: bool = True, class_only: bool = False) -> DataFrame:
    """(rid, rtid, name) of nodes with one of the terms as name (or label), whatever the case; a synonym gives its subject with the literal's text."""
    wanted = [t.lower() for t in terms]
    nodes = graph.live_nodes
    hit = F.lower("name").isin(wanted)
    found = nodes.where(hit | F.lower("label").isin(wanted) if use_label else hit).select("rid", "rtid", F.col("label" if use_label else "name").alias("name"))
    if synonyms:
        other = synonym_edges(graph).where(F.lower("term").isin(wanted)).select("rid", "rtid", F.col("term").alias("name"))
        found = found.unionByName(other.join(nodes.select("rid", "rtid"), ["rid", "rtid"], "left_semi"))
    return (found.where("rtid = 1") if class_only else found).distinct()


def _ranked(found: DataFrame, text: str, max_distance: int, limit: int) -> DataFrame:
    """Distinct names by edit distance to the text as given, then by name; 0 means no bound."""
    found = found.select("name").distinct().withColumn("dist", F.levenshtein("name", F.lit(text)).cast("long"))
    found = found.where(F.col("dist") <= max_distance) if max_distance else found
    return found.orderBy("dist", "name").limit(limit) if limit else found


def search_names(
    graph: Graph, text: str, type_mask: int = 1, negated: bool = False, prefix: bool = False, max_distance: int = 0, limit: int = 0
) -> DataFrame:
    """(name, dist): names of the wanted types that contain the text (or begin with it, or don't), nearest first."""
    nodes = graph.live_nodes.where(F.col("rtid").isin(resource_types(type_mask)) & ~F.col("anonymous"))
    hit = matches("name", text, prefix)
    return _ranked(nodes.where(~hit if negated else hit), text, max_distance, limit)


def search_ids(graph: Graph, text: str, type_mask: int = 1, negated: bool = False, prefix: bool = False, max_distance: int = 0, limit: int = 0) -> DataFrame:
    """(rid, rtid, name, dist): as ``search_names``, with the ids; a name that several nodes bear comes once for each."""
    nodes = graph.live_nodes.where(F.col("rtid").isin(resource_types(type_mask)) & ~F.col("anonymous"))
    hit = matches("name", text, prefix)
    found = nodes.where(~hit if negated else hit).select("rid", "rtid", "name").distinct()
    found = found.withColumn("dist", F.levenshtein("name", F.lit(text)).cast("long"))
    found = found.where(F.col("dist") <= max_distance) if max_distance else found
    return found.orderBy("dist", "name", "rtid", "rid").limit(limit) if limit else found


def search_terms(graph: Graph, text: str, max_distance: int = 0, limit: int = 0) -> DataFrame:
    """(name, dist) over class names and the literals that some synonym property uses."""
    classes = graph.live_nodes.where("rtid = 1 and not anonymous").select("name")
    terms = synonym_edges(graph).select(F.col("term").alias("name"))
    return _ranked(classes.union(terms).where(matches("name", text)), text, max_distance, limit)


def search_regex(graph: Graph, pattern: str, type_mask: int = 1, negated: bool = False, limit: int = 0) -> DataFrame:
    """Distinct names that match the expression, whatever the case, in order."""
    hit = F.regexp_like("name", F.lit("(?i)" + pattern))
    nodes = graph.live_nodes.where(F.col("rtid").isin(resource_types(type_mask)))
    found = nodes.where(~hit if negated else hit).select("name").distinct().orderBy("name")
    return found.limit(limit) if limit else found


def search_like(graph: Graph, text: str, type_mask: int = 1, by_label: bool = True) -> DataFrame:
    """(rid, rtid, name) by rdfs label edges, or by the nodes' own labels; the other way is taken only where the first finds nothing."""
    types = resource_types(type_mask)
    labels = synonym_edges(graph, ["label"]).where(F.col("rtid").isin(types)).select("rid", "rtid", F.col("term").alias("name"))
    own = graph.live_nodes.where(F.col("rtid").isin(types)).select("rid", "rtid", F.coalesce("label", "name").alias("name"))
    first, second = ((labels, own) if by_label else (own, labels))
    first = first.where(matches("name", text)).distinct()
    return second.where(matches("name", text)).distinct() if first.isEmpty() else first


def roots(graph: Graph, hierarchy: DataFrame, top: DataFrame | None = None) -> DataFrame:
    """(rid, name) of root classes: parents that are no child, or classes whose only named parent is the given top."""
    arcs = hierarchy.select("src", "dst").where("src <> dst").distinct()
    if top is None:
        found = arcs.select(F.col("dst").alias("rid")).distinct().join(arcs.select(F.col("src").alias("rid")), "rid", "left_anti")
    else:
        to_top = arcs.join(top.select(F.col("rid").alias("dst")), "dst", "left_semi").select(F.col("src").alias("rid")).distinct()
        others = arcs.join(top.select(F.col("rid").alias("dst")), "dst", "left_anti").select(F.col("src").alias("rid"))
        found = to_top.join(others, "rid", "left_anti")
    return found.join(graph.live_nodes.where("rtid = 1").select("rid", "name"), "rid")


def term_dictionary(graph: Graph) -> DataFrame:
    """(term, rid, rtid): names of classes and their synonyms."""
    classes = graph.live_nodes.where("rtid = 1 and not anonymous")
    own = classes.select(F.col("name").alias("term"), "rid", "rtid")
    other = synonym_edges(graph).where("rtid = 1").select("term", "rid", "rtid")
    return own.unionByName(other).distinct()


def autocomplete(terms: DataFrame, text: str, limit: int = TERM_LIMIT) -> DataFrame:
    """(term, dist): terms that begin with the text, the nearest ``limit``, then without regional ones and repeats in another case."""
    found = terms.where(matches("term", text, prefix=True)).select("term").distinct()
    found = found.withColumn("dist", F.levenshtein("term", F.lit(text)).cast("long")).orderBy("dist", "term").limit(limit)
    found = found.where(~F.startswith(F.lower("term"), F.lit(REGIONAL)))
    first = F.row_number().over(Window.partitionBy(F.lower("term")).orderBy("dist", "term"))
    return found.withColumn("turn", first).where("turn = 1").select("term", "dist")


def with_ancestor(terms: DataFrame, index: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Terms of classes that have one of the ancestors (or are one)."""
    wanted = ancestors.select(F.col("rid").alias("anc"))
    below = named_by(index, "anc", wanted, "desc", "left_semi").select(F.col("desc").alias("rid")).union(wanted.select(F.col("anc").alias("rid"))).distinct()
    return terms.join(below, "rid", "left_semi")


def reconcile(
    terms: DataFrame, text: str, max_distance: int = MAX_EDIT_DISTANCE, limit: int = TERM_LIMIT, prefix: bool = False,
    category: str | None = None, type_strict: str = "any",
) -> DataFrame:
    """Candidates (term, rid, category, score, is_match) of a text, nearest first; score is 1 - dist / max_distance."""
    if type_strict == "all":
        raise GraphError("argument", "type_strict 'all' is not supported")
    found = terms.where(matches("term", text, prefix))
    if category is not None:
        found = found.where(F.col("category") == category)
    found = found.withColumn("dist", F.levenshtein("term", F.lit(text)).cast("long")).where(F.col("dist") <= max_distance)
    found = found.orderBy("dist", "term", "rid", "category").limit(limit).where(~F.startswith(F.lower("term"), F.lit(REGIONAL)))
    score = F.round(1 - F.col("dist") / F.lit(max_distance), 6)
    return found.select("term", "rid", "category", score.alias("score"), (score > 0.5).alias("is_match"))


def concept_details(graph: Graph, groups: dict[str, list[str]]) -> DataFrame:
    """(rid, name, one column per group): per class the texts of each group of literal properties, and its superclasses."""
    names = {n.lower(): g for g, found in groups.items() for n in found}
    props = graph.properties.select(F.col("id").alias("pid"), F.lower("name").alias("pname"))
    texts = graph.live_nodes.where("rtid = 13").select(F.col("rid").alias("rid2"), F.coalesce("label", "name").alias("value"))
    literal = graph.live_edges.where("rtid1 = 1 and rtid2 = 13 and not hidden").join(props.where(F.col("pname").isin(list(names))), "pid").join(texts, "rid2")
    of = lambda g: F.col("pname").isin([n for n, x in names.items() if x == g])
    found = literal.groupBy(F.col("rid1").alias("rid")).agg(
        *(F.array_join(F.array_sort(F.collect_set(F.when(of(g), F.col("value")))), "|").alias(g) for g in groups)
    )
    parents = graph.live_nodes.where("rtid = 1").select(F.col("rid").alias("rid2"), F.col("name").alias("parent"))
    up = graph.live_edges.where("rtid1 = 1 and rtid2 = 1 and not hidden").join(props.where("pname = 'subclassof'"), "pid").join(parents, "rid2")
    up = up.groupBy(F.col("rid1").alias("rid")).agg(F.array_join(F.array_sort(F.collect_set("parent")), "|").alias("superclasses"))
    classes = graph.live_nodes.where("rtid = 1").select("rid", "name")
    out = classes.join(found, "rid", "left").join(up, "rid", "left")
    return out.select("rid", "name", *(F.coalesce(g, F.lit("")).alias(g) for g in (*groups, "superclasses")))


def search_concepts(graph: Graph, text: str, groups: dict[str, list[str]], limit: int = CONCEPT_LIMIT, max_distance: int = MAX_EDIT_DISTANCE) -> DataFrame:
    """Details of the concepts whose name or synonym is among the nearest terms: one join, not one request a term."""
    terms = search_terms(graph, text, max_distance, limit).select(F.lower("name").alias("key")).distinct()
    found = term_dictionary(graph).withColumn("key", F.lower("term")).join(terms, "key", "left_semi").select("rid").distinct()
    return concept_details(graph, groups).join(found, "rid", "left_semi")


def siblings(arcs: DataFrame) -> DataFrame:
    """(node, sibling): other children of a node's parents, over child -> parent arcs (src, dst)."""
    arcs = arcs.select("src", "dst").where("src <> dst").distinct()
    pairs = arcs.toDF("node", "parent").join(arcs.toDF("sibling", "parent"), "parent")
    return pairs.where("node <> sibling").select("node", "sibling").distinct()


def property_nodes(graph: Graph, kinds: Iterable[str] = ()) -> DataFrame:
    """(rid, name) of property nodes of any of the kinds object, datatype, annotation, system; none means all."""
    known = {"object": "is_object", "datatype": "is_datatype", "annotation": "is_annotation", "system": "is_system"}
    wanted = [k for k in kinds if k != "all"]
    if bad := set(wanted) - set(known):
        raise GraphError("argument", f"unknown property kinds {sorted(bad)}")
    hit = F.lit(True) if not wanted else F.lit(False)
    for k in wanted:
        hit = hit | F.col(known[k])
    props = graph.properties.where(hit).select(F.col("id").alias("rid"))
    return graph.live_nodes.where("rtid = 15").join(props, "rid", "left_semi").select("rid", "name")


def edge_relation(graph: Graph, name: str) -> DataFrame:
    """All edges of a property, obsolete ones included."""
    pid = graph.properties.where(F.col("name") == name).select(F.col("id").alias("pid"))
    return graph.edges.join(pid, "pid", "left_semi").select("rid1", "rtid1", "rid2", "rtid2", "pid")


def concept_count(graph: Graph) -> DataFrame:
    return graph.live_nodes.where("rtid = 1 and not anonymous").agg(F.countDistinct("rid").alias("n_concepts"))


def term_count(graph: Graph) -> DataFrame:
    return term_dictionary(graph).agg(F.countDistinct("term").alias("n_terms"))


def has_inferred_definition(graph: Graph) -> DataFrame:
    """(rid, rtid) of classes with an equivalent class of a defining type."""
    pid = graph.properties.where("name = 'equivalentClass'").select(F.col("id").alias("pid"))
    edges = graph.live_edges.join(pid, "pid", "left_semi").where(F.col("rtid1") == 1).where(F.col("rtid2").isin(*DEFINING_TYPES))
    return edges.select(F.col("rid1").alias("rid"), F.col("rtid1").alias("rtid")).distinct()
