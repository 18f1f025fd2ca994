"""Graph construction: nodes, edges and labels from the tables of a shredded ontology.

Each kind of statement is one branch of a union; tables that an ontology lacks are empty.
Ids of all tables are longs, types of resources are those of ``ResourceType``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EDGE_KEY, NODE_COLUMNS, OWL, RESOURCE_ANNOTATIONS, SYMMETRIC, SYSTEM_PROPERTIES, TEXT_ANNOTATIONS, Graph
from ..model import ResourceType as T
from ..session import saved, saved_rows
from .closure import named_by
from .infer import as_edges, deprecated_classes, propagate_obsolete, retired_roots, unhide_restrictions, without_mutual

#: Columns of the tables of a shredded ontology (fixed values).
TABLES = {
    "namespace": "id long, prefix string, url string",
    "primitiveclass": "id long, name string, nsid long, is_system boolean",
    "individual": "id long, name string, nsid long",
    "property": (
        "id long, name string, nsid long, is_object boolean, is_transitive boolean, is_symmetric boolean, is_functional boolean, "
        "is_datatype boolean, is_annotation boolean, is_system boolean"
    ),
    "datatype": "id long, name string",
    "literal": "id long, lexicalform string, langtag string, datatypeid long",
    "ontologyuri": "id long, uri string",
    "allvaluesfromclass": "id long, propertyid long, rangeclassid long, rtid int, browsertext string",
    "somevaluesfromclass": "id long, propertyid long, rangeclassid long, rtid int, browsertext string",
    "cardinalityclass": "id long, propertyid long, cardinality int, browsertext string",
    "mincardinalityclass": "id long, propertyid long, cardinality int, browsertext string",
    "maxcardinalityclass": "id long, propertyid long, cardinality int, browsertext string",
    "complementclass": "id long, classid long, rtid int, browsertext string",
    "intersectionclass": "id long, classid long, rtid int, browsertext string",
    "unionclass": "id long, classid long, rtid int, browsertext string",
    "oneof": "id long, valueid long, rtid int, browsertext string",
    "hasvalue": "id long, propertyid long, valueid long, rtid int, browsertext string",
    "hasself": "id long, propertyid long, browsertext string",
    "datarange": "id long, browsertext string",
    "datatype_restriction": "id long, dtid long, facetpropid long, literalid long, browsertext string",
    "alldifferentindividual": "id long, individualid long, browsertext string",
    "subclassof": "childid long, child_rtid int, parentid long, parent_rtid int",
    "equivalentclass": "classid1 long, rtid1 int, classid2 long, rtid2 int",
    "disjointclass": "classid1 long, rtid1 int, classid2 long, rtid2 int",
    "disjointunionclass": "classid1 long, rtid1 int, classid2 long, rtid2 int",
    "typeof": "instanceid long, instance_rtid int, classid long, class_rtid int",
    "relationship": "subjectid long, subject_rtid int, propertyid long, objectid long, object_rtid int",
    "subpropertyof": "childid long, parentid long",
    "equivalentproperty": "propertyid1 long, propertyid2 long",
    "inversepropertyof": "propertyid1 long, propertyid2 long",
    "domain": "propertyid long, rid long, rtid int",
    "range": "propertyid long, rid long, rtid int",
    "differentindividual": "individualid1 long, individualid2 long",
    "sameindividual": "individualid1 long, individualid2 long",
}

#: Names of anonymous nodes by table (fixed values).
ANONYMOUS = {
    "cardinalityclass": (T.CARDINALITY, "Cardinality Restriction"), "mincardinalityclass": (T.MIN_CARDINALITY, "Min Cardinality Restriction"),
    "maxcardinalityclass": (T.MAX_CARDINALITY, "Max Cardinality Restriction"), "somevaluesfromclass": (T.SOME_VALUES_FROM, "SomeValuesFrom Restriction"),
    "allvaluesfromclass": (T.ALL_VALUES_FROM, "AllValuesFrom Restriction"), "complementclass": (T.COMPLEMENT, "Complement class"),
    "unionclass": (T.UNION, "Union Class"), "intersectionclass": (T.INTERSECTION, "Intersection Class"), "oneof": (T.ONE_OF, "Enumeration Class"),
    "alldifferentindividual": (T.ALL_DIFFERENT, "All Different Individuals"), "hasself": (T.HAS_SELF, "hasSelf class"),
    "datatype_restriction": (T.DATATYPE_RESTRICTION, "datatype restriction"), "hasvalue": (T.HAS_VALUE, "hasValue class"),
}
#: Restriction codes and statements of hidden edges (fixed values).
QUANTIFIERS = {"allvaluesfromclass": (T.ALL_VALUES_FROM, "a", "forall", "allValuesFrom"), "somevaluesfromclass": (T.SOME_VALUES_FROM, "v", "exists", "someValuesFrom")}
CARDINALITIES = {"cardinalityclass": (T.CARDINALITY, "b", "="), "mincardinalityclass": (T.MIN_CARDINALITY, "m", ">="), "maxcardinalityclass": (T.MAX_CARDINALITY, "n", "<=")}
#: System classes that the rules need (fixed values).
SYSTEM_CLASSES = ("Thing", "Restriction")
#: Properties that give a label, the first that is there.
LABEL_PROPERTIES = ("label", "IAO_0000589")
LITERAL_LENGTH = 1500
#: Statements that a task makes edges of.
STATEMENTS = 250_000
#: First id of what the rules add to the system vocabulary.
SYSTEM_ID = 1 << 40


def system_rows() -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Namespaces, classes and properties of the system vocabulary; a row's id follows from its place in the lists."""
    spaces = [(SYSTEM_ID + k, url) for k, url in enumerate(SYSTEM_PROPERTIES)]
    classes = [(SYSTEM_ID + k, name, OWL) for k, name in enumerate(SYSTEM_CLASSES)]
    names = [(url, name) for url, listed in SYSTEM_PROPERTIES.items() for name in listed]
    of = lambda n: (n in RESOURCE_ANNOTATIONS, n in SYMMETRIC, n in TEXT_ANNOTATIONS, n in RESOURCE_ANNOTATIONS + TEXT_ANNOTATIONS)
    return spaces, classes, [(SYSTEM_ID + k, name, url, *of(name)) for k, (url, name) in enumerate(names)]


def complete(spark: SparkSession, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables, with empty ones for those that are missing and with the system vocabulary."""
    out = {name: tables.get(name, spark.createDataFrame([], schema)) for name, schema in TABLES.items()}
    spaces, classes, properties = system_rows()
    own = spark.createDataFrame(spaces, "id long, url string").join(out["namespace"].select("url"), "url", "left_anti")
    out["namespace"] = out["namespace"].unionByName(own, allowMissingColumns=True)
    at = out["namespace"].groupBy("url").agg(F.min("id").alias("nsid"))

    def with_system(table: str, rows: list[tuple], schema: str) -> DataFrame:
        wanted = spark.createDataFrame(rows, schema).join(at, "url", "left").drop("url").withColumn("is_system", F.lit(True))
        missing = wanted.join(out[table].where("is_system").select("name"), "name", "left_anti")
        filled = missing.withColumns({c: F.lit(False) for c in out[table].columns if c not in missing.columns})
        return out[table].unionByName(filled)

    out["primitiveclass"] = with_system("primitiveclass", classes, "id long, name string, url string")
    flags = "is_object boolean, is_symmetric boolean, is_datatype boolean, is_annotation boolean"
    out["property"] = with_system("property", properties, f"id long, name string, url string, {flags}")
    ints = spark.createDataFrame([(SYSTEM_ID, "int")], TABLES["datatype"])
    out["datatype"] = out["datatype"].unionByName(ints.join(out["datatype"].select("name"), "name", "left_anti"))
    return out


def build_nodes(t: dict[str, DataFrame], kbid: int) -> DataFrame:
    """Named nodes with their address, literals cut to their first 1500 characters, and anonymous nodes."""
    text = lambda c: c if isinstance(c, Column) else F.lit(c).cast("string")

    def nodes(df: DataFrame, rtid: T, name, label=None, anonymous: bool = False, uri=None) -> DataFrame:
        return df.select(
            F.col("id").alias("rid"), F.lit(int(rtid)).alias("rtid"), text(name).alias("name"), text(label).alias("label"), F.lit(kbid).alias("kbid"),
            F.lit(anonymous).alias("anonymous"), F.lit(False).alias("is_obsolete"), text(uri).alias("uri"),
        )

    space = t["namespace"].select(F.col("id").alias("nsid"), "url")
    name = F.col("name")
    parts = [
        nodes(t[table].join(space, "nsid", "left"), kind, name, uri=F.concat("url", "name"))
        for table, kind in (("primitiveclass", T.CLASS), ("individual", T.INDIVIDUAL), ("property", T.PROPERTY))
    ]
    parts.append(nodes(t["literal"], T.LITERAL, F.substring("lexicalform", 1, LITERAL_LENGTH)))
    parts.append(nodes(t["datatype"], T.DATATYPE, name))
    parts.append(nodes(t["datarange"].distinct(), T.DATA_RANGE, F.col("browsertext"), F.col("browsertext"), anonymous=True))
    parts.append(nodes(t["ontologyuri"].distinct(), T.ONTOLOGY, F.col("uri"), F.col("uri")))
    for table, (kind, fixed) in ANONYMOUS.items():
        parts.append(nodes(t[table].select("id", "browsertext").dropDuplicates(["id"]), kind, fixed, F.col("browsertext"), anonymous=True))
    return reduce(DataFrame.unionByName, parts)


def build_edges(t: dict[str, DataFrame], kbid: int) -> DataFrame:
    """All edges of the statements; hidden ones are shown where something visible leads to them."""
    # Ids of the vocabulary by name: as many rows as it has names.
    ids = lambda table, names: {
        r["name"]: r["id"] for r in t[table].where(F.col("name").isin(list(names))).groupBy("name").agg(F.min("id").alias("id")).collect()
    }
    system = ids("property", [n for names in SYSTEM_PROPERTIES.values() for n in names])
    classes, integer = ids("primitiveclass", SYSTEM_CLASSES), ids("datatype", ["int"])["int"]

    def edge(df: DataFrame, left, left_type, pid, right, right_type, **flags) -> DataFrame:
        of = lambda x: F.col(x) if isinstance(x, str) else F.lit(int(x)) if not isinstance(x, Column) else x
        pid = system[pid[0]] if isinstance(pid, tuple) else pid  # a system property by name
        found = df.select(
            of(left).cast("long").alias("rid1"), of(left_type).cast("int").alias("rtid1"), of(pid).cast("long").alias("pid"),
            of(right).cast("long").alias("rid2"), of(right_type).cast("int").alias("rtid2"),
            *([flags.pop("stmt").alias("restriction_stmt")] if "stmt" in flags else []),
        )
        return as_edges(found, kbid, **flags)

    thing, restriction = (F.lit(classes[n]) for n in SYSTEM_CLASSES)
    p = T.PROPERTY
    # a pair and its reverse meet under one key; self-pairs fall away
    tasks = lambda df: max(1, -(-df.count() // STATEMENTS))
    child, parent = F.struct("childid", "child_rtid"), F.struct(F.col("parentid").alias("childid"), F.col("parent_rtid").alias("child_rtid"))
    met = t["subclassof"].select(F.least(child, parent).alias("lo"), F.greatest(child, parent).alias("hi"), (child < parent).alias("rising")).where("lo <> hi")
    met = met.repartition(tasks(t["subclassof"]), "lo", "hi").groupBy("lo", "hi")
    met = met.agg(F.bool_and("rising").alias("all"), F.bool_or("rising").alias("rising")).where("all = rising")
    end = lambda rising, falling: F.when(F.col("rising"), F.col(rising)).otherwise(F.col(falling))
    up = met.select(end("lo.childid", "hi.childid").alias("childid"), end("lo.child_rtid", "hi.child_rtid").alias("child_rtid"),
                    end("hi.childid", "lo.childid").alias("parentid"), end("hi.child_rtid", "lo.child_rtid").alias("parent_rtid"))
    below = without_mutual(t["subpropertyof"].select("childid", "parentid").distinct(), "childid", "parentid")
    parts = [
        edge(up, "childid", "child_rtid", ("subClassOf",), "parentid", "parent_rtid"),
        edge(t["equivalentclass"], "classid1", "rtid1", ("equivalentClass",), "classid2", "rtid2"),
        edge(t["typeof"].where("instance_rtid <> 1"), "instanceid", "instance_rtid", ("type",), "classid", "class_rtid"),
        edge(t["relationship"], "subjectid", "subject_rtid", "propertyid", "objectid", "object_rtid"),
        edge(below, "childid", p, ("subPropertyOf",), "parentid", p),
        edge(t["equivalentproperty"], "propertyid1", p, ("equivalentProperty",), "propertyid2", p),
        edge(t["inversepropertyof"], "propertyid1", p, ("inverseOf",), "propertyid2", p),
        edge(t["disjointclass"], "classid1", "rtid1", ("disjointWith",), "classid2", "rtid2"),
        edge(t["disjointunionclass"], "classid1", "rtid1", ("disjointUnion",), "classid2", "rtid2"),
        edge(t["differentindividual"], "individualid1", T.INDIVIDUAL, ("differentFrom",), "individualid2", T.INDIVIDUAL),
        edge(t["sameindividual"], "individualid1", T.INDIVIDUAL, ("sameAs",), "individualid2", T.INDIVIDUAL),
        edge(t["domain"], "propertyid", p, ("domain",), "rid", "rtid"),
        edge(t["range"], "propertyid", p, ("range",), "rid", "rtid"),
        edge(t["complementclass"], "id", T.COMPLEMENT, ("complementOf",), "classid", "rtid"),
        edge(t["unionclass"], "id", T.UNION, ("unionOf",), "classid", "rtid"),
        edge(t["intersectionclass"], "id", T.INTERSECTION, ("intersectionOf",), "classid", "rtid"),
        edge(t["oneof"], "id", T.ONE_OF, ("oneOf",), "valueid", "rtid"),
        edge(t["alldifferentindividual"], "id", T.ALL_DIFFERENT, ("distinctMembers",), "individualid", T.INDIVIDUAL),
    ]
    # every restriction is of type Restriction, on a property, with its value
    values = {"hasvalue": (T.HAS_VALUE, "hasValue", "valueid"), "hasself": (T.HAS_SELF, None, None)}
    values |= {table: (kind, name, "rangeclassid") for table, (kind, _, _, name) in QUANTIFIERS.items()}
    for table, (kind, name, value) in values.items():
        parts.append(edge(t[table], "id", kind, ("type",), restriction, T.CLASS, derived=True))
        parts.append(edge(t[table], "id", kind, ("onProperty",), "propertyid", p, derived=True))
        if name:
            parts.append(edge(t[table], "id", kind, (name,), value, "rtid", derived=True))
    # domains to ranges; a side that a property lacks is Thing
    domain, range_ = t["domain"].toDF("propertyid", "drid", "drtid"), t["range"].toDF("propertyid", "rrid", "rrtid")
    parts.append(edge(domain.join(range_, "propertyid"), "drid", "drtid", "propertyid", "rrid", "rrtid"))
    parts.append(edge(domain.join(range_, "propertyid", "left_anti"), "drid", "drtid", "propertyid", thing, T.CLASS, derived=True))
    parts.append(edge(range_.join(domain, "propertyid", "left_anti"), thing, T.CLASS, "propertyid", "rrid", "rrtid", derived=True))
    for table, (kind, code, stmt, _) in QUANTIFIERS.items():
        parts.append(edge(t[table], "id", kind, "propertyid", "rangeclassid", "rtid", hidden=True, restriction_type=code, restriction_stmt=stmt))
    counted = []
    for table, (kind, code, sign) in CARDINALITIES.items():
        own = t[table].withColumn("stmt", F.concat(F.lit(f"cardinality{sign}"), F.col("cardinality").cast("string")))
        parts.append(edge(own, "id", kind, "propertyid", integer, T.DATATYPE, hidden=True, restriction_type=code, stmt=F.col("stmt")))
        child = t["subclassof"].where(f"parent_rtid = {int(kind)}").join(own.hint("merge"), F.col("parentid") == F.col("id"))
        counted.append(edge(child, "childid", "child_rtid", "propertyid", integer, T.DATATYPE, derived=True, restriction_type=code, stmt=F.col("stmt")))
    facet = {"derived": True, "restriction_type": "d", "restriction_stmt": "datatype"}
    parts.append(edge(t["datatype_restriction"], "id", T.DATATYPE_RESTRICTION, ("onDatatype",), "dtid", T.DATATYPE, **facet))
    parts.append(edge(t["datatype_restriction"], "id", T.DATATYPE_RESTRICTION, "facetpropid", "literalid", T.LITERAL, **facet))
    # Statements are dealt by their ends before a task gathers any, so that none holds all of a file or a branch; an asserted one goes before a derived one.
    key = [*EDGE_KEY, "hidden", "restriction_type", "restriction_stmt"]
    given = reduce(DataFrame.unionByName, parts).select(*key, "derived")
    dealt = given.repartition(tasks(given), *EDGE_KEY)
    edges = saved(as_edges(dealt.groupBy(*key).agg(F.bool_and("derived").alias("derived")), kbid))
    new = reduce(DataFrame.unionByName, counted).join(edges.select(*EDGE_KEY).hint("merge"), list(EDGE_KEY), "left_anti")
    return unhide_restrictions(edges.unionByName(new))


def quoted_at(column: str, mark: str) -> Column:
    return F.when(F.contains(F.col(column), F.lit(mark)), F.concat(F.lit('"'), F.col(column), F.lit('"'))).otherwise(F.col(column))


def set_labels(t: dict[str, DataFrame], nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with labels: a label property's text, else the own name, else text composed from the parts of the definition.

    Composed labels need their parts' labels first, so rounds go on until none is added; what
    is left (a definition in terms of itself) takes its name.
    """
    names = t["property"].where(F.col("name").isin(*LABEL_PROPERTIES)).select(F.col("id").alias("pid"), (F.col("name") != LABEL_PROPERTIES[0]).alias("later"))
    texts = nodes.select(F.col("rid").alias("rid2"), F.col("rtid").alias("rtid2"), F.col("name").alias("text"))
    given = edges.join(names, "pid").join(texts.hint("merge"), ["rid2", "rtid2"]).groupBy(F.col("rid1").alias("rid"), F.col("rtid1").alias("rtid"))
    given = given.agg(F.min(F.struct("later", "text")).alias("best")).select("rid", "rtid", F.col("best.text").alias("given"))
    own = F.when(F.col("rtid").isin(1, 12, 13, 14, 15, 18), F.col("name")).when(F.col("rtid") == int(T.DATA_RANGE), F.expr("substring(name, 5)"))
    own = F.when(F.col("rtid").isin(17, 20, 21), F.col("label")).otherwise(own)
    base = nodes.join(given.hint("merge"), ["rid", "rtid"], "left").select("rid", "rtid", F.coalesce("given", own).alias("found"))
    known = saved(base.where("found is not null"))
    # Sizes are guessed from files that are small for what they hold, so joins on nodes are told not to send either side to the driver.
    label = lambda rid, rtid, out: known.select(F.col("rid").alias(rid), F.col("rtid").alias(rtid), F.col("found").alias(out)).hint("merge")
    of_property = saved(known.where(F.col("rtid") == int(T.PROPERTY)).select(F.col("rid").alias("propertyid"), F.col("found").alias("p")))
    prop = lambda df: named_by(df, "propertyid", of_property, "id")
    some = lambda kind, df, text: df.select(F.col("id").alias("rid"), F.lit(int(kind)).alias("rtid"), text.alias("found"))
    added = 1
    while added:
        new = []
        for table, (kind, _, sign) in CARDINALITIES.items():
            new.append(some(kind, prop(t[table]), F.concat(F.lit("something with "), quoted_at("p", " "), F.lit(f" {sign} "), F.col("cardinality").cast("string"))))
        value = prop(t["hasvalue"]).join(label("valueid", "rtid", "v"), ["valueid", "rtid"])
        new.append(some(T.HAS_VALUE, value, F.concat(F.lit("something with value of "), quoted_at("p", " "), F.lit(" to be "), quoted_at("v", " "))))
        other = t["complementclass"].join(label("classid", "rtid", "v"), ["classid", "rtid"])
        new.append(some(T.COMPLEMENT, other, F.concat(F.lit("not ("), F.col("v"), F.lit(")"))))
        for table, (kind, _, _, _) in QUANTIFIERS.items():
            word = "forall" if kind == T.ALL_VALUES_FROM else "exists"
            filler = prop(t[table]).join(label("rangeclassid", "rtid", "v"), ["rangeclassid", "rtid"])
            new.append(some(kind, filler, F.concat(F.lit(f"something [{word}]"), quoted_at("p", " "), F.lit(" "), quoted_at("v", " "))))
        for table, kind, word, value_column in (
            ("intersectionclass", T.INTERSECTION, "intersection", "classid"), ("unionclass", T.UNION, "union", "classid"), ("oneof", T.ONE_OF, "one", "valueid"),
        ):
            member = t[table].select("id", value_column, "rtid").distinct().join(label(value_column, "rtid", "v"), [value_column, "rtid"], "left")
            whole = member.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(quoted_at("v", ","))), ", ").alias("v"), F.count_if(F.col("v").isNull()).alias("open"))
            new.append(some(kind, whole.where("open = 0"), F.concat(F.lit(f"{word} of ("), F.col("v"), F.lit(")"))))
        found = reduce(DataFrame.unionByName, new).where("found is not null").groupBy("rid", "rtid").agg(F.min("found").alias("found"))
        found, added = saved_rows(found.join(known.select("rid", "rtid").hint("merge"), ["rid", "rtid"], "left_anti"))
        known = saved(known.unionByName(found)) if added else known
    out = nodes.join(known.hint("merge"), ["rid", "rtid"], "left")
    return out.select(*(F.coalesce("found", "name").alias(c) if c == "label" else F.col(c) for c in NODE_COLUMNS))


def build_graph(spark: SparkSession, tables: dict[str, DataFrame], kbid: int = 1, kb: str = "kb") -> Graph:
    """A graph from the tables of one ontology, obsolete classes and their edges flagged.

    The edges before any inference are kept as ``extra['raw_edges']``.
    """
    t = complete(spark, tables)
    nodes, edges = saved(build_nodes(t, kbid)), saved(build_edges(t, kbid))
    graph = Graph(
        nodes=saved(set_labels(t, nodes, edges)),
        edges=edges,
        properties=t["property"].withColumn("kbid", F.lit(kbid)),
        sub_properties=t["subpropertyof"].withColumn("kbid", F.lit(kbid)),
        inverse_properties=t["inversepropertyof"].withColumn("kbid", F.lit(kbid)),
        kbs=spark.createDataFrame([(kbid, kb)], "id int, name string"),
        extra={"intersections": t["intersectionclass"], "unions": t["unionclass"]},
    )
    graph = propagate_obsolete(graph, deprecated_classes(graph), retired_roots(graph))
    graph.nodes, graph.edges = saved(graph.nodes), saved(graph.edges)
    graph.extra["raw_edges"] = graph.edges
    return graph
