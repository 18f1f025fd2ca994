"""The graph model: resource types, column sets, property name lists and the catalog of one graph."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import IntEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ResourceType(IntEnum):
    """Kinds of resources; an id is unique within its kind (fixed values)."""

    CLASS = 1
    ALL_VALUES_FROM = 2
    SOME_VALUES_FROM = 3
    CARDINALITY = 4
    MIN_CARDINALITY = 5
    MAX_CARDINALITY = 6
    COMPLEMENT = 7
    INTERSECTION = 8
    UNION = 9
    HAS_VALUE = 10
    ONE_OF = 11
    INDIVIDUAL = 12
    LITERAL = 13
    DATATYPE = 14
    PROPERTY = 15
    DATA_RANGE = 16
    ALL_DIFFERENT = 17
    ONTOLOGY = 18
    HAS_SELF = 20
    DATATYPE_RESTRICTION = 21


#: Types whose equivalence gives a class an inferred definition (fixed values; cardinalities are not among them).
DEFINING_TYPES = (2, 3, 7, 8, 9, 10, 11)
#: Resource types by bit of a search mask (fixed values).
TYPE_BITS = {1: ResourceType.CLASS, 2: ResourceType.INDIVIDUAL, 4: ResourceType.PROPERTY, 8: ResourceType.LITERAL}
#: Properties whose literals name their subject (fixed values).
SYNONYM_PROPERTIES = (
    "prefLabel", "label", "has_exact_synonym", "hasExactSynonym", "synonym", "abbrev", "has_related_synonym", "hasRelatedSynonym",
    "acronym", "taxonomicCommonName", "ncbiTaxScientificName", "ncbiTaxGenbankCommonName", "ncbiTaxBlastName", "ncbiIncludesName",
    "ncbiInPartName", "has_narrow_synonym", "hasNarrowSynonym", "misspelling", "misnomer", "has_broad_synonym", "hasBroadSynonym",
)
ABBREVIATIONS, ACRONYMS = ("abbrev", "abbreviation"), ("acronym",)
#: Classes below which all are obsolete, and namespaces of the vocabulary (fixed values).
RETIRED_ROOTS = ("_birnlex_retired_class", "ObsoleteClass", "DeprecatedClass")
RDF, RDFS, OWL, XSD = (
    "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#",
    "http://www.w3.org/2001/XMLSchema#",
)
#: System properties by namespace, and those that are symmetric, annotations of resources or of texts (fixed values).
SYSTEM_PROPERTIES = {
    OWL: (
        "allValuesFrom", "backwardCompatibleWith", "cardinality", "complementOf", "deprecated", "differentFrom", "disjointUnion", "disjointWith",
        "distinctMembers", "equivalentClass", "equivalentProperty", "hasValue", "imports", "incompatibleWith", "intersectionOf", "inverseOf",
        "maxCardinality", "minCardinality", "onDatatype", "onProperty", "oneOf", "priorVersion", "sameAs", "someValuesFrom", "unionOf",
        "valuesFrom", "versionInfo",
    ),
    RDF: ("first", "object", "predicate", "rest", "subject", "type", "value"),
    RDFS: ("comment", "domain", "isDefinedBy", "label", "member", "range", "seeAlso", "subClassOf", "subPropertyOf"),
}
SYMMETRIC = ("complementOf", "differentFrom", "disjointWith", "equivalentClass", "equivalentProperty", "inverseOf", "sameAs")
RESOURCE_ANNOTATIONS = ("backwardCompatibleWith", "incompatibleWith", "priorVersion", "isDefinedBy", "seeAlso")
TEXT_ANNOTATIONS = ("versionInfo", "comment", "label", "deprecated")

NODE_COLUMNS = ("rid", "rtid", "name", "label", "kbid", "anonymous", "is_obsolete", "uri")
EDGE_COLUMNS = (
    "rid1", "rtid1", "pid", "rid2", "rtid2", "kbid", "org_rid1", "org_rid2", "derived", "hidden",
    "restriction_type", "restriction_stmt", "is_obsolete",
)
EDGE_KEY = ("rid1", "rtid1", "pid", "rid2", "rtid2")

NODES_SCHEMA = "rid long, rtid int, name string, label string, kbid int, anonymous boolean, is_obsolete boolean, uri string"
EDGES_SCHEMA = (
    "rid1 long, rtid1 int, pid long, rid2 long, rtid2 int, kbid int, org_rid1 long, org_rid2 long, derived boolean, hidden boolean, "
    "restriction_type string, restriction_stmt string, is_obsolete boolean"
)
PROPERTY_SCHEMA = (
    "id long, name string, is_object boolean, is_transitive boolean, is_symmetric boolean, is_functional boolean, "
    "is_datatype boolean, is_annotation boolean, is_system boolean, kbid int"
)

#: A resource id holds in 48 bits of a node's number; its type takes the bits above.
TYPE_SHIFT = 48


class GraphError(ValueError):
    """A request that the graph can't answer; ``kind`` names the reason."""

    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind = kind


def nid(rid: Column | str, rtid: Column | str) -> Column:
    """One long for a node (its type above its id), so that joins and groupings hash one column."""
    of = lambda x: F.col(x) if isinstance(x, str) else x
    return F.shiftleft(of(rtid).cast("long"), TYPE_SHIFT).bitwiseOR(of(rid).cast("long"))


def rid_of(number: Column | str) -> Column:
    number = F.col(number) if isinstance(number, str) else number
    return number.bitwiseAND(F.lit((1 << TYPE_SHIFT) - 1))


def rtid_of(number: Column | str) -> Column:
    return F.shiftright(F.col(number) if isinstance(number, str) else number, TYPE_SHIFT).cast("int")


def node_id(rid: Column, rtid: Column) -> Column:
    """Public id of a node, ``rid-rtid``."""
    return F.concat_ws("-", rid, rtid)


def parsed_id(text: Column | str) -> tuple[Column, Column]:
    """(rid, rtid) of a public id; an id of another form raises."""
    text = F.col(text) if isinstance(text, str) else text
    good = F.regexp_like(text, F.lit(r"^\d+-\d+$"))
    part = lambda k: F.when(good, F.split_part(text, F.lit("-"), F.lit(k))).otherwise(F.raise_error(F.concat(F.lit("malformed id: "), text)))
    return part(1).cast("long"), part(2).cast("int")


def resource_types(mask: int) -> list[int]:
    """Resource types of a search mask."""
    return [int(t) for bit, t in TYPE_BITS.items() if mask & bit]


@dataclass
class Graph:
    """The tables of a graph; ``extra`` holds further ones (weights, closures, groups) by name."""

    nodes: DataFrame
    edges: DataFrame
    properties: DataFrame
    sub_properties: DataFrame
    inverse_properties: DataFrame
    kbs: DataFrame
    extra: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def live_nodes(self) -> DataFrame:
        return self.nodes.where("not is_obsolete")

    @property
    def live_edges(self) -> DataFrame:
        return self.edges.where("not is_obsolete")
