"""An OWL document from file to graph."""

from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from graphmill import api, session
from graphmill.model import SYNONYM_PROPERTIES, GraphError
from graphmill.operators import build, dag, infer, load, search, traverse
from graphmill.plans import load_queries
from graphmill.sources import owl

SF = "/root/testdata/sf0.001"
HEAD = (
    '<?xml version="1.0"?><rdf:RDF xmlns="http://x.org/o#" xml:base="http://x.org/o" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" '
    'xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:xsd="http://www.w3.org/2001/XMLSchema#">'
)
BODY = """
<owl:Ontology rdf:about="http://x.org/o"/>
<owl:AnnotationProperty rdf:about="#synonym"/>
<owl:ObjectProperty rdf:about="#part_of"><rdf:type rdf:resource="http://www.w3.org/2002/07/owl#TransitiveProperty"/><owl:inverseOf rdf:resource="#has_part"/></owl:ObjectProperty>
<owl:ObjectProperty rdf:about="#has_part"/>
<owl:ObjectProperty rdf:about="#proper_part_of"><rdfs:subPropertyOf rdf:resource="#part_of"/><rdfs:domain rdf:resource="#Organ"/></owl:ObjectProperty>
<owl:DatatypeProperty rdf:about="#age"><rdfs:range rdf:resource="http://www.w3.org/2001/XMLSchema#int"/></owl:DatatypeProperty>
<owl:Class rdf:about="#Body"/>
<owl:Class rdf:about="#Organ"><synonym>Body  part</synonym></owl:Class>
<owl:Class rdf:about="#Brain">
  <rdfs:subClassOf rdf:resource="#Organ"/>
  <rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="#part_of"/><owl:someValuesFrom rdf:resource="#Body"/></owl:Restriction></rdfs:subClassOf>
</owl:Class>
<owl:Class rdf:about="#Heart">
  <rdfs:subClassOf rdf:resource="#Organ"/>
  <rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="#part_of"/><owl:someValuesFrom rdf:resource="#Body"/></owl:Restriction></rdfs:subClassOf>
  <owl:disjointWith rdf:resource="#Brain"/>
</owl:Class>
<owl:Class rdf:about="#Mind"><owl:equivalentClass><owl:Class><owl:intersectionOf rdf:parseType="Collection">
  <rdf:Description rdf:about="#Brain"/><owl:Class><owl:complementOf rdf:resource="#Heart"/></owl:Class></owl:intersectionOf></owl:Class></owl:equivalentClass></owl:Class>
<owl:Class rdf:about="#Pair"><rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="#has_part"/>
  <owl:cardinality rdf:datatype="http://www.w3.org/2001/XMLSchema#int">2</owl:cardinality></owl:Restriction></rdfs:subClassOf></owl:Class>
<Brain rdf:about="#mine"><age>42</age><part_of rdf:resource="#me"/></Brain>
<Body rdf:about="#me"/>
"""


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("owl")
    (folder / "one.owl").write_text(HEAD + BODY + "</rdf:RDF>")
    return owl.shred(owl.read_triples(spark, str(folder)))


def test_tables(tables):
    names = lambda t: {r["name"] for r in tables[t].collect()}
    assert names("primitiveclass") == {"Body", "Organ", "Brain", "Heart", "Mind", "Pair"}
    assert names("individual") == {"mine", "me"} and names("property") == {"synonym", "part_of", "has_part", "proper_part_of", "age"}
    assert tables["property"].where("is_transitive").count() == 1
    assert tables["somevaluesfromclass"].count() == 1  # the two restrictions read alike
    assert tables["intersectionclass"].count() == 2 and tables["complementclass"].count() == 1
    assert [r["cardinality"] for r in tables["cardinalityclass"].collect()] == [2]
    assert tables["subclassof"].count() == 5 and tables["equivalentclass"].count() == 1 and tables["disjointclass"].count() == 1
    assert {r["lexicalform"] for r in tables["literal"].collect()} >= {"Body part", "42"}
    assert tables["relationship"].count() == 3
    for t, columns in build.TABLES.items():
        if t in tables:
            assert set(tables[t].columns) == {c.split()[0] for c in columns.split(", ")}, t


def test_graph(spark, tables):
    g = build.build_graph(spark, tables, kb="o")
    label = {(r["rid"], r["rtid"]): r["label"] for r in g.nodes.collect()}
    assert len(label) == g.nodes.count() and None not in label.values()
    shown = set(label.values())
    assert {"something [exists]part_of Body", "not (Heart)", "intersection of (Brain, not (Heart))", "something with has_part = 2"} <= shown
    name = {r["id"]: r["name"] for r in g.properties.collect()}
    edges = {(label[r["rid1"], r["rtid1"]], name[r["pid"]], label[r["rid2"], r["rtid2"]], r["hidden"], r["derived"]) for r in g.edges.collect()}
    for want in (
        ("Brain", "subClassOf", "Organ", False, False), ("Brain", "subClassOf", "something [exists]part_of Body", False, False),
        ("something [exists]part_of Body", "part_of", "Body", False, False), ("something [exists]part_of Body", "onProperty", "part_of", False, True),
        ("mine", "part_of", "me", False, False), ("mine", "type", "Brain", False, False), ("mine", "age", "42", False, False),
        ("Organ", "proper_part_of", "Thing", False, True), ("Thing", "age", "int", False, True), ("Pair", "has_part", "int", False, True),
        ("proper_part_of", "subPropertyOf", "part_of", False, False), ("Organ", "synonym", "Body part", False, False),
    ):
        assert want in edges, want
    found = infer.set_subclasses(g, g.extra["intersections"], g.extra["unions"])
    assert {(label[r["rid1"], r["rtid1"]], label[r["rid2"], r["rtid2"]]) for r in found.collect()} == {("Mind", "Brain")}
    brain = search.ids_by_term(g, ["brain"], class_only=True)
    around = traverse.neighbors(g, brain, ["subClassOf"], hops=None)
    assert {r["name2"] for r in around.collect()} >= {"Organ", "SomeValuesFrom Restriction"}
    assert {r["name"] for r in search.get_names(g, search.has_inferred_definition(g)).collect()} == {"Mind"}
    named = g.edges.where("rtid1 = 1 and rtid2 = 1").join(infer.property_id(g, "subClassOf"), "pid", "left_semi")
    assert dag.closure_index(named.selectExpr("rid1 as src", "rid2 as dst")).count() == 2
    assert {r["name"] for r in search.property_nodes(g, ["annotation"]).collect()} >= {"synonym"}
    with pytest.raises(GraphError):
        search.property_nodes(g, ["strange"])


def test_post_processing(spark, tables):
    g = load.post_processed(build.build_graph(spark, tables, kb="o"))
    label = {(r["rid"], r["rtid"]): r["label"] for r in g.nodes.collect()}
    name = {r["id"]: r["name"] for r in g.properties.collect()}
    edges = {(label[r["rid1"], r["rtid1"]], name[r["pid"]], label[r["rid2"], r["rtid2"]], r["derived"]) for r in g.edges.collect()}
    assert {("Mind", "subClassOf", "Brain", True), ("me", "has_part", "mine", True), ("mine", "part_of", "me", False)} <= edges
    pairs = {(label[r["desc"], 1], label[r["anc"], 1]) for r in g.extra["index:subClassOf"].collect()}
    assert {("Mind", "Brain"), ("Mind", "Organ"), ("Heart", "Organ")} <= pairs and ("Organ", "Mind") not in pairs
    counts = {label[r["node"], 1]: (r["anc_all"], r["desc_all"]) for r in g.extra["counts:subClassOf"].collect()}
    assert counts["Mind"] == (2, 0) and counts["Organ"] == (0, 3)
    assert g.extra["raw_edges"].count() < g.edges.count()
    xml = api.execute(g, "neighborhood_document", kind="parents", terms=["Heart"]).first()["xml"]
    root = ElementTree.fromstring(xml)
    assert root.find("truncatedResults").text == "false" and {x.text for x in root.iter("object")} == {"Organ", "SomeValuesFrom Restriction"}
    assert ElementTree.fromstring(api.execute(g, "neighborhood_document", kind="parents", terms=["Heart"], limit=1).first()["xml"]).find("truncatedResults").text == "true"
    lines = sorted(r["line"].split("\t")[1:3] for r in api.execute(g, "cards", roots=["Organ"], pivots={"synonym": "synonyms"}).collect())
    assert lines == [["Brain", "Organ"], ["Heart", "Organ"], ["Mind", "Brain"]]
    assert [(r["name"], r["uri"]) for r in api.execute(g, "ontologies").collect()] == [("o", "http://x.org/o")]
    assert [r["name"] for r in search.search_ids(g, "hear").collect()] == ["Heart"]


def test_refused_axioms(spark, tmp_path):
    (tmp_path / "bad.owl").write_text(HEAD + '<owl:Class rdf:about="#A"><owl:hasKey rdf:parseType="Collection"><rdf:Description rdf:about="#p"/></owl:hasKey></owl:Class></rdf:RDF>')
    with pytest.raises(GraphError):
        owl.shred(owl.read_triples(spark, str(tmp_path)))


def test_refused_rules_and_definitions(spark, tmp_path):
    bodies = {
        "rule": '<rdf:Description rdf:about="#r"><rdf:type rdf:resource="http://www.w3.org/2003/11/swrl#Imp"/></rdf:Description>',
        "data": '<rdfs:Datatype rdf:about="#d"><owl:equivalentClass rdf:resource="http://www.w3.org/2001/XMLSchema#int"/></rdfs:Datatype>',
    }
    for name, body in bodies.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "bad.owl").write_text(HEAD + body + "</rdf:RDF>")
        with pytest.raises(GraphError):
            owl.shred(owl.read_triples(spark, str(tmp_path / name)))


def test_syntax():
    body = """<owl:Class rdf:about="#A" rdfs:label="a label"><rdfs:comment xml:lang="en">hi</rdfs:comment>
      <note xml:base="http://y.org/z" rdf:resource="#there"/><note rdf:parseType="Resource"><deep>1</deep></note>
      <note rdf:parseType="Literal">x <b>y</b></note><note rdf:nodeID="n"/><note rdfs:label="blank"/></owl:Class>
      <rdf:Bag rdf:nodeID="n"><rdf:li>p</rdf:li><rdf:li>q</rdf:li></rdf:Bag>"""
    o, rdf, rdfs = "http://x.org/o#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#"
    got = list(owl.triples_of((HEAD + body + "</rdf:RDF>").encode(), "f"))
    for want in (
        (o + "A", rdfs + "label", "a label", True, None, None), (o + "A", rdfs + "comment", "hi", True, "en", None),
        (o + "A", o + "note", "http://y.org/z#there", False, None, None), (o + "A", o + "note", "_:f/1", False, None, None),
        ("_:f/1", o + "deep", "1", True, None, None), (o + "A", o + "note", 'x <ns0:b xmlns:ns0="http://x.org/o#">y</ns0:b>', True, None, rdf + "XMLLiteral"),
        (o + "A", o + "note", "_:f/n", False, None, None), ("_:f/2", rdfs + "label", "blank", True, None, None),
        ("_:f/n", rdf + "_1", "p", True, None, None), ("_:f/n", rdf + "_2", "q", True, None, None),
    ):
        assert want in got, want
    deep = '<owl:Class rdf:about="#A">' + "<note><owl:Class>" * 3000 + "</owl:Class></note>" * 3000 + "</owl:Class>"
    assert len(list(owl.triples_of((HEAD + deep + "</rdf:RDF>").encode(), "f"))) == 6001


def test_obsolete_labels_and_synonyms(spark, tmp_path):
    lines = [
        '<owl:Ontology rdf:about="http://x.org/o"/><owl:Class rdf:about="#ObsoleteClass"/><owl:Class rdf:about="#Top"/>',
        '<owl:Class rdf:about="#Old"><rdfs:subClassOf rdf:resource="#ObsoleteClass"/></owl:Class>',
        '<owl:Class rdf:about="#Older"><rdfs:subClassOf rdf:resource="#Old"/></owl:Class>',
        '<owl:Class rdf:about="#Gone"><rdfs:label xml:lang="en">gone class</rdfs:label><rdfs:subClassOf rdf:resource="#Top"/>'
        '<owl:deprecated rdf:datatype="http://www.w3.org/2001/XMLSchema#boolean">true</owl:deprecated></owl:Class>',
    ]
    for k, name in enumerate(SYNONYM_PROPERTIES):
        if name != "label":
            lines.append(f'<owl:AnnotationProperty rdf:about="#{name}"/>')
        tag = "rdfs:label" if name == "label" else name
        lines.append(f'<owl:Class rdf:about="#C{k}"><{tag}>also called {k}</{tag}></owl:Class>')
    (tmp_path / "a.owl").write_text(HEAD + "".join(lines) + "</rdf:RDF>")
    tables = owl.shred(owl.read_triples(spark, str(tmp_path)))
    said = {r["lexicalform"]: (r["langtag"], r["datatypeid"] is not None) for r in tables["literal"].collect()}
    assert said["gone class"] == ("en", False) and said["true"] == (None, True) and said["also called 3"] == (None, False)
    g = build.build_graph(spark, tables, kb="o")
    name = {r["rid"]: (r["name"], r["label"], r["is_obsolete"]) for r in g.nodes.where("rtid = 1").collect()}
    assert {n for n, _, gone in name.values() if gone} == {"Old", "Older", "Gone"}
    assert ("Gone", "gone class", True) in name.values()
    dead = g.edges.where("is_obsolete and rtid2 = 1").collect()
    assert {(name[r["rid1"]][0], name[r["rid2"]][0]) for r in dead} == {("Old", "ObsoleteClass"), ("Older", "Old"), ("Gone", "Top")}
    for k in range(len(SYNONYM_PROPERTIES)):
        found = search.ids_by_term(g, [f"Also called {k}"], use_label=False, synonyms=True).collect()
        assert [name[r["rid"]][0] for r in found if r["rtid"] == 1] == [f"C{k}"], SYNONYM_PROPERTIES[k]


def test_spool(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("1\tx\t[NULL]\n2\t[NULL]\t0\n")
    rows = owl.load_spool(spark, str(tmp_path), "id long, name string, nsid long").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "x", None), (2, None, 0)]


def test_rows_are_dealt(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(build, "STATEMENTS", 100, raising=False)
    monkeypatch.setattr(build, "saved", lambda df: seen.append(session.saved(df)) or seen[-1])
    build.build_edges(build.complete(spark, load_queries.star_tables(spark, SF)), 1)
    assert seen[0].rdd.getNumPartitions() >= seen[0].count() // 100 > 4
    triples, owl_tables = [], owl.shred
    monkeypatch.setattr(load_queries, "PARTS", 20, raising=False)
    monkeypatch.setattr(load_queries.owl, "shred", lambda found: triples.append(found) or owl_tables(found))
    load_queries._expressions(spark, SF)
    parts = spark.read.parquet(f"{SF}/part.parquet").count()
    assert triples[0].rdd.getNumPartitions() == -(-parts // 20) > 1


def test_labels_send_no_nodes_to_the_driver(spark):
    tables = build.complete(spark, load_queries.star_tables(spark, SF))
    nodes = session.saved(build.build_nodes(tables, 1))
    edges = nodes.select(F.col("rid").alias("rid1"), F.col("rtid").alias("rtid1"), F.lit(-1).alias("pid"), F.col("rid").alias("rid2"), F.col("rtid").alias("rtid2")).where("false")
    found = build.set_labels(tables, nodes, edges)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
