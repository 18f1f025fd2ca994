"""OWL documents in RDF/XML or N-Triples: files to triples in tasks, triples to the tables of a shredded ontology.

Files are cut at their top-level elements or lines, so that many tasks read one (``documents``);
elements become (subject, predicate, object) rows as a stream. Everything after that is joins
on predicates, and many documents load side by side. Ids come from two-level ranks of a stable
key, never from the order of rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import partial, reduce
from itertools import count, islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalized_literal
from ..model import OWL, RDF, RDFS, RESOURCE_ANNOTATIONS, SYSTEM_PROPERTIES, TEXT_ANNOTATIONS, XSD, GraphError
from ..model import ResourceType as T
from ..session import saved, saved_rows, shipped
from . import documents

XML = "{http://www.w3.org/XML/1998/namespace}"
MEMBER = "urn:member"
#: Predicate of the rows (namespace, PREFIX, prefix) that tell what a document calls its namespaces.
PREFIX = "urn:prefix"
TRIPLES = "s string, p string, o string, literal boolean, lang string, datatype string"
#: Axioms that a load refuses (fixed values): keys, negative assertions, rules; definitions of datatypes are refused as well.
REFUSED = (f"{OWL}hasKey", f"{OWL}NegativePropertyAssertion", "http://www.w3.org/2003/11/swrl#Imp")
#: Annotations of the vocabulary: properties that need no declaration.
ANNOTATIONS = [url + name for url, names in SYSTEM_PROPERTIES.items() for name in names if name in RESOURCE_ANNOTATIONS + TEXT_ANNOTATIONS]
#: Between a literal's text, language and datatype where they make up its key.
MARK = "\u0001"
#: Triples that a task hands over at once.
BATCH = 50_000
PROPERTY_KINDS = ("ObjectProperty", "DatatypeProperty", "AnnotationProperty", "TransitiveProperty", "SymmetricProperty", "FunctionalProperty")
CLASS_KINDS = (f"{OWL}Class", f"{RDFS}Class")


def triples_of(data: bytes, source: str, piece: str = "", prefixes: bool = False) -> Iterator[tuple]:
    """Triples of one RDF/XML document, in one pass over its elements; blank nodes are named after the document.

    ``piece`` tells the parts of a document apart in the names of nodes without a label; with
    ``prefixes`` there is a row of ``PREFIX`` for each that the document declares.

    Property attributes, nested bases and languages, collections, and properties parsed as resources or as literals are read.
    """
    blanks = count(1)
    name = lambda tag: tag[1:].replace("}", "", 1) if tag[0] == "{" else tag
    rdf = lambda element, key: element.get(f"{{{RDF}}}{key}")
    fresh = lambda: f"_:{source}/{piece}{next(blanks)}"
    plain = lambda key: not key.startswith((f"{{{RDF}}}", XML)) and key[0] == "{"

    def iri(value: str, base: str) -> str:
        return value if ":" in value.split("/")[0] else base + (value if value.startswith("#") or not value else "#" + value)

    # Open elements: kind ("root", "node", "property", "literal", "inner"), subject, predicate, list or object, base, language, parts.
    path: list[dict] = []
    for event, element in ElementTree.iterparse(io.BytesIO(data), ("start", "end", *(["start-ns"] if prefixes else []))):
        if event == "start-ns":
            if element[0]:
                yield element[1], PREFIX, element[0], False, None, None
        elif event == "start":
            above = path[-1] if path else {"kind": "", "base": "", "lang": None, "parts": 0}
            above["parts"] += 1
            own = {"base": element.get(f"{XML}base", above["base"]).rstrip("#"), "lang": element.get(f"{XML}lang", above["lang"]), "parts": 0}
            path.append(own)
            if above["kind"] in ("literal", "inner"):
                own["kind"] = "inner"
            elif not above["kind"] and element.tag == f"{{{RDF}}}RDF":
                own["kind"] = "root"
            elif above["kind"] == "node":
                p, kind = name(element.tag), rdf(element, "parseType")
                resource, label = rdf(element, "resource"), rdf(element, "nodeID")
                if p == f"{RDF}li":
                    above["members"] = above.get("members", 0) + 1
                    p = f"{RDF}_{above['members']}"
                own |= {"kind": "property", "s": above["s"], "p": p, "list": None, "done": False}
                said = [(name(k), v) for k, v in element.attrib.items() if plain(k)]
                if kind == "Collection":
                    own |= {"list": fresh(), "done": True}
                    yield own["s"], p, own["list"], False, None, None
                elif kind == "Resource":
                    own |= {"kind": "node", "s": fresh()}
                    yield above["s"], p, own["s"], False, None, None
                elif kind == "Literal":
                    own["kind"] = "literal"
                elif resource is not None or label is not None or said:
                    o = iri(resource, own["base"]) if resource is not None else f"_:{source}/{label}" if label is not None else fresh()
                    own["done"] = True
                    yield own["s"], p, o, False, None, None
                    for q, v in said:
                        yield o, q, v, True, own["lang"], None
            else:  # a node: below the root, a property or nothing at all
                about, given, label = (rdf(element, k) for k in ("about", "ID", "nodeID"))
                s = iri(about, own["base"]) if about is not None else iri("#" + given, own["base"]) if given is not None else None
                s = s if s is not None else f"_:{source}/{label}" if label is not None else fresh()
                own |= {"kind": "node", "s": s}
                if element.tag != f"{{{RDF}}}Description":
                    yield s, f"{RDF}type", name(element.tag), False, None, None
                for k, v in element.attrib.items():
                    if k == f"{{{RDF}}}type":
                        yield s, f"{RDF}type", iri(v, own["base"]), False, None, None
                    elif plain(k):
                        yield s, name(k), v, True, own["lang"], None
                if above["kind"] == "property":
                    if above["list"]:
                        yield above["list"], MEMBER, s, False, None, None
                    else:
                        above["done"] = True
                        yield above["s"], above["p"], s, False, None, None
        else:
            own = path.pop()
            if own["kind"] == "literal":
                inner = (element.text or "") + "".join(ElementTree.tostring(x, "unicode") for x in element)
                yield own["s"], own["p"], inner, True, None, f"{RDF}XMLLiteral"
            elif own["kind"] == "property" and not own["done"]:
                yield own["s"], own["p"], element.text or "", True, own["lang"], rdf(element, "datatype")
            if own["kind"] != "inner":
                element.clear()


def read_triples(spark: SparkSession, path: str, split: bool = True) -> DataFrame:
    """Triples of all files of a path: N-Triples in files named ``.nt``, RDF/XML in all others.

    Without ``split`` each RDF/XML file is read by one task as it is, in any encoding.
    """
    columns = [c.split()[0] for c in TRIPLES.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"], strict=True):
                rows = triples_of(bytes(data), file.rsplit("/", 1)[-1], prefixes=True)
                while part := list(islice(rows, BATCH)):
                    yield pd.DataFrame(part, columns=columns)

    shipped(spark)
    if path.endswith(".nt"):
        return documents.with_members(saved(documents.read_lines(spark, path)), MEMBER)
    if split:
        return documents.with_members(documents.read_split(spark, path, partial(triples_of, prefixes=True)), MEMBER)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, TRIPLES)


def literal_key(text: Column, lang: Column, datatype: Column) -> Column:
    """What tells literals apart: the normalised text, with language and datatype behind it if there are any."""
    tail = F.concat(F.lit(MARK), F.coalesce(lang, F.lit("")), F.lit(MARK), F.coalesce(datatype, F.lit("")))
    return F.concat(text, F.when(lang.isNotNull() | datatype.isNotNull(), tail).otherwise(F.lit("")))


def dense_ids(keys: DataFrame, key: str = "key") -> DataFrame:
    """(key, id): ids 1, 2, .. that depend on the keys alone; ranks within hash buckets, behind the sizes of earlier buckets."""
    keys = keys.select(key).distinct().withColumn("part", F.substring(F.md5(key), 1, 2))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = keys.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    turn = F.row_number().over(Window.partitionBy("part").orderBy(key))
    return keys.withColumn("turn", turn).join(starts, "part").select(key, (F.col("start") + F.col("turn")).alias("id"))


def local_name(iri: Column) -> Column:
    return F.regexp_extract(iri, r"([^#/]*)$", 1)


def shred(triples: DataFrame) -> dict[str, DataFrame]:
    """The tables of an ontology from its triples."""
    every = saved(triples.distinct())
    t = every.where(F.col("p") != PREFIX)
    refused = t.where((F.col("p") == f"{RDF}type") & F.col("o").isin(*REFUSED)).select("o").union(t.where(F.col("p").isin(*REFUSED)).select("p"))
    kinds_of_data = t.where((F.col("p") == f"{RDF}type") & (F.col("o") == f"{RDFS}Datatype")).select("s")
    defined = t.where(F.col("p") == f"{OWL}equivalentClass").join(kinds_of_data, "s", "left_semi").select(F.lit("a definition of a datatype"))
    if bad := refused.union(defined).first():
        raise GraphError("axiom", f"{bad[0]} is not supported")
    of = lambda *names: t.where(F.col("p").isin(*names) & ~F.col("literal")).select("s", "o")
    key = literal_key(normalized_literal("o"), F.col("lang"), F.col("datatype"))
    texts = lambda name, keyed=False: t.where((F.col("p") == name) & F.col("literal")).select("s", key.alias("o") if keyed else "o")
    is_blank = lambda c: F.startswith(F.col(c), F.lit("_:"))
    types = of(f"{RDF}type")
    member = of(MEMBER).toDF("list", "item")

    # names of all kinds
    props = types.where(F.col("o").isin(*(OWL + k for k in PROPERTY_KINDS), f"{RDF}Property"))
    has = lambda kind: F.max(F.col("o") == OWL + kind).alias(kind)
    props = props.groupBy(F.col("s").alias("key")).agg(*map(has, PROPERTY_KINDS)).withColumn("system", F.lit(False))
    # the vocabulary's annotations count where they are used
    used = t.where(F.col("p").isin(*ANNOTATIONS)).select(F.col("p").alias("key")).distinct().join(props.select("key"), "key", "left_anti")
    flags = {k: F.lit(k == "AnnotationProperty") for k in PROPERTY_KINDS} | {"system": F.lit(True)}
    props = props.unionByName(used.withColumns(flags))
    classes = types.where(F.col("o").isin(*CLASS_KINDS) & ~is_blank("s")).select(F.col("s").alias("key")).distinct()
    known = [OWL + k for k in (*PROPERTY_KINDS, "Class", "Restriction", "Ontology", "AllDifferent", "Axiom")] + [f"{RDFS}Datatype", f"{RDFS}Class", f"{RDF}Property"]
    persons = types.where(~F.col("o").isin(*known) & ~is_blank("s")).select(F.col("s").alias("key")).distinct()
    used = of(f"{RDFS}range", f"{OWL}onDatatype").where(F.startswith("o", F.lit(XSD))).select(F.col("o").alias("key"))
    used = used.union(t.where("datatype is not null").select("datatype"))
    datatypes = types.where(F.col("o") == f"{RDFS}Datatype").select(F.col("s").alias("key")).union(used).distinct()
    # annotation values that name nothing known count as literals
    named = reduce(DataFrame.union, [classes, persons, props.select("key"), datatypes]).distinct()
    literal = t.where("literal").select(key.alias("key"))
    stray = t.where("not literal").select("s", "o").where(~is_blank("o")).select(F.col("o").alias("key"))
    stray = stray.join(named, "key", "left_anti").where(~F.startswith("key", F.lit(OWL)) & ~F.startswith("key", F.lit(RDFS)) & ~F.startswith("key", F.lit(XSD)))
    literals = literal.union(stray).distinct()

    ids = {k: saved(dense_ids(df)) for k, df in (("c", classes), ("i", persons), ("p", props.select("key")), ("d", datatypes), ("l", literals))}
    kinds = {"c": T.CLASS, "i": T.INDIVIDUAL, "p": T.PROPERTY, "d": T.DATATYPE}
    spaces = reduce(DataFrame.union, [ids[k].select("key") for k in "cip"]).select(F.regexp_extract("key", r"^(.*[#/])[^#/]*$", 1).alias("key")).where("key <> ''").distinct()
    space = saved(dense_ids(spaces))
    in_space = lambda df: df.withColumn("url", F.regexp_extract("key", r"^(.*[#/])[^#/]*$", 1)).join(space.toDF("url", "nsid"), "url", "left")
    prefixes = every.where(F.col("p") == PREFIX).groupBy(F.col("s").alias("key")).agg(F.min("o").alias("prefix"))
    flags = props.join(ids["p"], "key")
    out = {
        "namespace": space.join(prefixes, "key", "left").select("id", "prefix", F.col("key").alias("url")),
        "primitiveclass": in_space(ids["c"]).select("id", local_name(F.col("key")).alias("name"), "nsid", F.lit(False).alias("is_system")),
        "individual": in_space(ids["i"]).select("id", local_name(F.col("key")).alias("name"), "nsid"),
        "datatype": ids["d"].select("id", local_name(F.col("key")).alias("name")),
        "literal": _literals(ids["l"], ids["d"]),
        "property": in_space(flags).select(
            "id", local_name(F.col("key")).alias("name"), "nsid", F.col("ObjectProperty").alias("is_object"), F.col("TransitiveProperty").alias("is_transitive"),
            F.col("SymmetricProperty").alias("is_symmetric"), F.col("FunctionalProperty").alias("is_functional"),
            F.col("DatatypeProperty").alias("is_datatype"), F.col("AnnotationProperty").alias("is_annotation"), F.col("system").alias("is_system"),
        ),
    }
    ontologies = types.where(F.col("o") == f"{OWL}Ontology").select(F.col("s").alias("key"))
    out["ontologyuri"] = dense_ids(ontologies).select("id", F.col("key").alias("uri"))

    # class expressions: each anonymous node gets a kind and a text; equal texts are one expression
    expressions = saved(_expressions(of, texts, member))
    text = saved(_browser_texts(expressions))
    unique = saved(text.groupBy("kind", "text").agg(F.min("node").alias("first")))
    number = saved(dense_ids(unique.select("first"), "first"))
    interned = saved(
        text.join(unique, ["kind", "text"]).join(number, "first").select("node", "kind", "text", "id", (F.col("node") == F.col("first")).alias("kept"))
    )
    nodes = reduce(DataFrame.unionByName, [ids[k].select(F.col("key").alias("node"), "id", F.lit(int(v)).alias("rtid")) for k, v in kinds.items()])
    nodes = saved(nodes.unionByName(interned.select("node", "id", F.col("kind").alias("rtid"))))
    all_nodes = nodes.unionByName(ids["l"].select(F.col("key").alias("node"), "id", F.lit(int(T.LITERAL)).alias("rtid")))
    out |= _expression_tables(expressions, interned, nodes, all_nodes, ids["p"])

    def pairs(found: DataFrame, left: str, right: str, source: DataFrame = nodes) -> DataFrame:
        a = nodes.select(F.col("node").alias("s"), F.col("id").alias("a"), F.col("rtid").alias("at"))
        b = source.select(F.col("node").alias("o"), F.col("id").alias("b"), F.col("rtid").alias("bt"))
        return found.join(a, "s").join(b, "o").select(F.col("a").alias(left.split()[0]), F.col("at").alias(left.split()[1]), F.col("b").alias(right.split()[0]), F.col("bt").alias(right.split()[1]))

    everyone = lambda list_property: _all_pairs(of(list_property).toDF("axiom", "list").join(member, "list"))
    out["subclassof"] = pairs(of(f"{RDFS}subClassOf"), "childid child_rtid", "parentid parent_rtid")
    out["equivalentclass"] = pairs(of(f"{OWL}equivalentClass"), "classid1 rtid1", "classid2 rtid2")
    out["disjointclass"] = pairs(of(f"{OWL}disjointWith").union(everyone(f"{OWL}members")), "classid1 rtid1", "classid2 rtid2")
    united = of(f"{OWL}disjointUnionOf").toDF("s", "list").join(member, "list").select("s", F.col("item").alias("o"))
    out["disjointunionclass"] = pairs(united, "classid1 rtid1", "classid2 rtid2")
    out["typeof"] = pairs(types, "instanceid instance_rtid", "classid class_rtid").where("instance_rtid = 12")
    for table, name in (("domain", f"{RDFS}domain"), ("range", f"{RDFS}range")):
        out[table] = pairs(of(name), "propertyid at", "rid rtid").where("at = 15").drop("at")
    for table, name, columns in (
        ("subpropertyof", f"{RDFS}subPropertyOf", ("childid", "parentid")), ("equivalentproperty", f"{OWL}equivalentProperty", ("propertyid1", "propertyid2")),
        ("inversepropertyof", f"{OWL}inverseOf", ("propertyid1", "propertyid2")), ("sameindividual", f"{OWL}sameAs", ("individualid1", "individualid2")),
    ):
        kind = 12 if table == "sameindividual" else 15
        found = pairs(of(name), f"{columns[0]} at", f"{columns[1]} bt")
        out[table] = found.where(f"at = {kind} and bt = {kind}").select(*columns)
    different = pairs(of(f"{OWL}differentFrom").union(everyone(f"{OWL}distinctMembers")), "individualid1 at", "individualid2 bt")
    out["differentindividual"] = different.where("at = 12 and bt = 12").select("individualid1", "individualid2")
    # assertions of the ontology's own properties, and annotations of the vocabulary's
    own = t.join(ids["p"].toDF("p", "propertyid"), "p")
    value = F.when(F.col("literal"), key).otherwise(F.col("o"))
    a = nodes.select(F.col("node").alias("s"), F.col("id").alias("subjectid"), F.col("rtid").alias("subject_rtid"))
    b = all_nodes.select(F.col("node").alias("v"), F.col("id").alias("objectid"), F.col("rtid").alias("object_rtid"))
    right_kind = F.col("literal") == (F.col("object_rtid") == int(T.LITERAL))
    said = own.withColumn("v", value).join(a, "s").join(b, "v").where(right_kind | (F.col("object_rtid") == int(T.LITERAL)))
    out["relationship"] = said.select("subjectid", "subject_rtid", "propertyid", "objectid", "object_rtid").distinct()
    return out


def _literals(ids: DataFrame, datatypes: DataFrame) -> DataFrame:
    """The literal table from the keys: text, language and datatype."""
    parts = F.split("key", MARK)
    part = lambda k: F.when((F.size(parts) > 1) & (F.get(parts, F.lit(k)) != ""), F.get(parts, F.lit(k)))
    found = ids.select("id", F.get(parts, F.lit(0)).alias("lexicalform"), part(1).alias("langtag"), part(2).alias("datatype"))
    return found.join(datatypes.toDF("datatype", "datatypeid"), "datatype", "left").select("id", "lexicalform", "langtag", "datatypeid")


def _all_pairs(members: DataFrame) -> DataFrame:
    """Both-way-distinct pairs (s, o) of the items of each list: an axiom over n things is one of each pair of them."""
    return members.toDF("list", "axiom", "s").join(members.toDF("list", "axiom", "o"), ["list", "axiom"]).where("s < o").select("s", "o")


def _expressions(of, texts, member: DataFrame) -> DataFrame:
    """(node, kind, prop, value, literal): parts of each class expression."""
    on = of(f"{OWL}onProperty").toDF("node", "prop")
    null = F.lit(None).cast("string")
    row = lambda df, kind, value="value": df.select("node", F.lit(int(kind)).alias("kind"), F.col("prop"), F.col(value).alias("value"))
    quant = lambda name: on.join(of(OWL + name).toDF("node", "value"), "node")
    count = lambda *names: on.join(reduce(DataFrame.union, [texts(OWL + n) for n in names]).toDF("node", "value"), "node")
    listed = lambda name: of(OWL + name).toDF("node", "list").join(member, "list").select("node", null.alias("prop"), F.col("item").alias("value"))
    return reduce(
        DataFrame.unionByName,
        [
            row(quant("allValuesFrom"), T.ALL_VALUES_FROM), row(quant("someValuesFrom"), T.SOME_VALUES_FROM),
            row(quant("hasValue").union(on.join(texts(f"{OWL}hasValue", keyed=True).toDF("node", "value"), "node")), T.HAS_VALUE),
            row(count("cardinality", "qualifiedCardinality"), T.CARDINALITY), row(count("minCardinality", "minQualifiedCardinality"), T.MIN_CARDINALITY),
            row(count("maxCardinality", "maxQualifiedCardinality"), T.MAX_CARDINALITY), row(count("hasSelf"), T.HAS_SELF),
            row(of(f"{OWL}complementOf").toDF("node", "value").withColumn("prop", null), T.COMPLEMENT),
            row(listed("intersectionOf"), T.INTERSECTION), row(listed("unionOf"), T.UNION), row(listed("oneOf"), T.ONE_OF),
        ],
    )


def _browser_texts(parts: DataFrame) -> DataFrame:
    """(node, kind, text) of the expressions: their parts' names and texts, inside out; an expression within itself has none."""
    words = {2: "only", 3: "some", 4: "exactly", 5: "min", 6: "max", 7: "not", 8: "and", 9: "or", 10: "value", 11: "one of", 20: "self"}
    word = F.element_at(F.create_map(*(F.lit(x) for k in words.items() for x in k)), F.col("kind"))
    plain = ~F.startswith(F.col("value"), F.lit("_:"))
    texts, added = parts.where("false").select("node", "kind", F.lit("").alias("text")), 1
    while added:
        inner = texts.select(F.col("node").alias("value"), F.concat(F.lit("("), "text", F.lit(")")).alias("inner"))
        left = parts.join(texts.select("node"), "node", "left_anti")
        filled = left.join(inner, "value", "left").withColumn("shown", F.when(plain, F.split_part("value", F.lit(MARK), F.lit(1))).otherwise(F.col("inner")))
        text = F.concat_ws(" ", F.first("prop"), word, F.array_join(F.array_sort(F.collect_list("shown")), ", "))
        new = filled.groupBy("node", "kind").agg(text.alias("text"), F.count_if(F.col("shown").isNull()).alias("open")).where("open = 0")
        new, added = saved_rows(new.select("node", "kind", "text"))
        texts = saved(texts.unionByName(new)) if added else texts
    return texts


def _expression_tables(parts: DataFrame, interned: DataFrame, nodes: DataFrame, all_nodes: DataFrame, prop_ids: DataFrame) -> dict[str, DataFrame]:
    kept = parts.join(interned.where("kept").select("node", "kind", "id", F.col("text").alias("browsertext")), ["node", "kind"])
    kept = kept.join(prop_ids.toDF("prop", "propertyid"), "prop", "left")
    value = nodes.select(F.col("node").alias("value"), F.col("id").alias("vid"), F.col("rtid").cast("int"))
    any_value = all_nodes.select(F.col("node").alias("value"), F.col("id").alias("vid"), F.col("rtid").cast("int"))
    of = lambda kind: kept.where(F.col("kind") == int(kind))
    out = {}
    for table, kind in (("allvaluesfromclass", T.ALL_VALUES_FROM), ("somevaluesfromclass", T.SOME_VALUES_FROM)):
        out[table] = of(kind).join(value, "value").select("id", "propertyid", F.col("vid").alias("rangeclassid"), "rtid", "browsertext")
    for table, kind in (("cardinalityclass", T.CARDINALITY), ("mincardinalityclass", T.MIN_CARDINALITY), ("maxcardinalityclass", T.MAX_CARDINALITY)):
        out[table] = of(kind).select("id", "propertyid", F.col("value").cast("int").alias("cardinality"), "browsertext")
    for table, kind, column in (
        ("complementclass", T.COMPLEMENT, "classid"), ("intersectionclass", T.INTERSECTION, "classid"), ("unionclass", T.UNION, "classid"), ("oneof", T.ONE_OF, "valueid"),
    ):
        out[table] = of(kind).join(value, "value").select("id", F.col("vid").alias(column), "rtid", "browsertext").distinct()
    out["hasvalue"] = of(T.HAS_VALUE).join(any_value, "value").select("id", "propertyid", F.col("vid").alias("valueid"), "rtid", "browsertext")
    out["hasself"] = of(T.HAS_SELF).select("id", "propertyid", "browsertext")
    return out


def load_spool(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A spooled table: tab-separated text with ``[NULL]`` for nulls."""
    return spark.read.csv(path, sep="\t", nullValue="[NULL]", schema=schema, quote="")
