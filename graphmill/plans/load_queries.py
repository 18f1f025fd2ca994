"""Queries on the load path: tables of a shredded ontology made from the star-schema tables, then nodes, edges and labels.

Parts are classes, suppliers individuals; class expressions over them are synthetic overlays by the part's number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import OWL, RDF, RDFS
from ..model import ResourceType as T
from ..operators import build
from ..session import saved
from ..sources import owl, star
from .star_queries import big

KB = 1
SUPPLIED_BY, PART_OF, PROPER = 1, 2, 3
PROPERTIES = ((SUPPLIED_BY, "supplied_by"), (PART_OF, "part_of"), (PROPER, "proper part of"))
#: Parts, and items of orders, of which a task makes rows; a part gives many.
PARTS, ITEMS = 20_000, 250_000
SPACES, CLASSES, SYSTEM = build.system_rows()
SYSTEM_PID = {name: i for i, name, *_ in SYSTEM}


def dealt(rows: DataFrame, n_rows: int, most: int, *keys: str) -> DataFrame:
    """The rows over as many tasks as their number asks for: their files are small for what they give."""
    return rows.repartition(max(1, -(-n_rows // most)), *keys)


def star_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The star-schema tables as tables of a shredded ontology."""
    t = star.tables(spark, sf_dir)
    top = t["part"].count()
    p = dealt(t["part"].select(F.col("p_partkey").cast("long").alias("p"), "p_name", "p_type"), top, PARTS, "p")
    s = t["supplier"].select(F.col("s_suppkey").cast("long").alias("s"), "s_name")
    items = t["lineitem"].select("l_partkey", "l_suppkey")
    lit = star.literals(t)
    sel = lambda df, where, **columns: df.where(where).select(*(F.expr(x).alias(c) for c, x in columns.items()))
    union = lambda *parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(*parts[1:]))
    half, third = "p div 2", "p div 3"
    kid = {"childid": "p", "child_rtid": "1"}
    same = {"classid1": "p", "rtid1": "1"}
    props = [(i, n, 1, n == "supplied_by") + (False,) * 4 + (False, False) for i, n in PROPERTIES]
    return {
        "namespace": spark.createDataFrame([(1, None, star.URL)], build.TABLES["namespace"]),
        "primitiveclass": sel(p, "true", id="p", name="p_name", nsid="1L", is_system="false"),
        "individual": sel(s, "true", id="s", name="s_name", nsid="1L"),
        "property": spark.createDataFrame(props, build.TABLES["property"]),
        "literal": sel(lit, "true", id="rid", lexicalform="txt", langtag="cast(null as string)", datatypeid="cast(null as long)"),
        "somevaluesfromclass": sel(p, "p % 3 = 0", id="p", propertyid="2L", rangeclassid=third, rtid="1", browsertext="concat('some ', p)"),
        "allvaluesfromclass": sel(p, "p % 8 = 0", id="p", propertyid="3L", rangeclassid=half, rtid="1", browsertext="concat('all ', p)"),
        "cardinalityclass": sel(p, "p % 7 = 0", id="p", propertyid="2L", cardinality="cast(p % 5 + 1 as int)", browsertext="concat('card ', p)"),
        "complementclass": sel(p, "p % 11 = 0", id="p", classid=half, rtid="1", browsertext="concat('not ', p)"),
        "hasvalue": sel(p, "p % 19 = 0", id="p", propertyid="1L", valueid="p % 5 + 1", rtid="12", browsertext="concat('value ', p)"),
        "intersectionclass": union(
            sel(p, "p % 13 = 0", id="p", classid=half, rtid="1", browsertext="concat('and ', p)"),
            sel(p, "p % 39 = 0", id="p", classid="p", rtid="3", browsertext="concat('and ', p)"),
        ),
        "unionclass": union(
            sel(p, "p % 17 = 0", id="p", classid=half, rtid="1", browsertext="concat('or ', p)"),
            sel(p, "p % 221 = 0", id="p", classid="p", rtid="8", browsertext="concat('or ', p)"),
        ),
        "subclassof": union(
            sel(p, "p >= 2", **kid, parentid=half, parent_rtid="1"), sel(p, "p % 3 = 0", **kid, parentid="p", parent_rtid="3"),
            sel(p, "p % 7 = 0", **kid, parentid="p", parent_rtid="4"),
            sel(p, "p % 50 = 0", childid=half, child_rtid="1", parentid="p", parent_rtid="1"),
        ),
        "equivalentclass": union(
            sel(p, f"p % 10 = 5 and p < {top}", **same, classid2="p + 1", rtid2="1"), sel(p, "p % 13 = 0", **same, classid2="p", rtid2="8"),
        ),
        "typeof": sel(s, "true", instanceid="s", instance_rtid="12", classid="s", class_rtid="1"),
        "relationship": union(
            sel(dealt(items, items.count(), ITEMS, *items.columns).distinct(), "true", subjectid="cast(l_partkey as long)", subject_rtid="1", propertyid="1L",
                objectid="cast(l_suppkey as long)", object_rtid="12"),
            sel(p.where("p % 4 = 0").join(lit, F.col("p_type") == F.col("txt")), "true", subjectid="p", subject_rtid="1",
                propertyid=f"{SYSTEM_PID['label']}L", objectid="rid", object_rtid="13"),
        ),
        "subpropertyof": spark.createDataFrame([(PROPER, PART_OF)], build.TABLES["subpropertyof"]),
        "domain": spark.createDataFrame([(SUPPLIED_BY, 1, 1), (PROPER, 2, 1)], build.TABLES["domain"]),
        "range": spark.createDataFrame([(SUPPLIED_BY, 1, 12), (PART_OF, 3, 1)], build.TABLES["range"]),
    }


def _values(rows: list[tuple]) -> str:
    text = lambda x: f"'{x}'" if isinstance(x, str) else f"{x}::BIGINT"
    return "(VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + ")"


#: Anonymous nodes: table, type, condition, browser text.
EXPRESSIONS = {
    "somevaluesfromclass": ("p % 3 = 0", "some "), "allvaluesfromclass": ("p % 8 = 0", "all "), "cardinalityclass": ("p % 7 = 0", "card "),
    "complementclass": ("p % 11 = 0", "not "), "hasvalue": ("p % 19 = 0", "value "), "intersectionclass": ("p % 13 = 0", "and "),
    "unionclass": ("p % 17 = 0", "or "),
}
#: Common table expressions of the nodes and edges that the tables give.
LOAD_SQL = f"""
p AS (SELECT p_partkey::BIGINT AS p, p_name, p_type FROM part),
s AS (SELECT s_suppkey::BIGINT AS s, s_name FROM supplier),
lit AS (
  SELECT row_number() OVER (ORDER BY txt) AS rid, txt
  FROM (SELECT p_type AS txt FROM part UNION SELECT p_brand FROM part UNION SELECT c_mktsegment FROM customer)
),
anon AS ({" UNION ALL ".join(f"SELECT p AS rid, {int(build.ANONYMOUS[t][0])} AS rtid, '{build.ANONYMOUS[t][1]}' AS name, '{b}' || p AS label FROM p WHERE {w}" for t, (w, b) in EXPRESSIONS.items())}),
nodes AS (
  SELECT p AS rid, 1 AS rtid, p_name AS name, NULL AS label, false AS anonymous, '{star.URL}' || p_name AS uri FROM p
  UNION ALL SELECT col0, 1, col1, NULL, false, col2 || col1 FROM {_values(CLASSES)}
  UNION ALL SELECT s, 12, s_name, NULL, false, '{star.URL}' || s_name FROM s
  UNION ALL SELECT col0, 15, col1, NULL, false, '{star.URL}' || col1 FROM {_values(list(PROPERTIES))}
  UNION ALL SELECT col0, 15, col1, NULL, false, col2 || col1 FROM {_values([r[:3] for r in SYSTEM])}
  UNION ALL SELECT rid, 13, txt, NULL, false, NULL FROM lit
  UNION ALL SELECT {build.SYSTEM_ID}, 14, 'int', NULL, false, NULL
  UNION ALL SELECT rid, rtid, name, label, true, NULL FROM anon
),
up AS (
  SELECT p AS c, 1 AS ct, p // 2 AS u, 1 AS ut FROM p WHERE p >= 2 UNION SELECT p, 1, p, 3 FROM p WHERE p % 3 = 0
  UNION SELECT p, 1, p, 4 FROM p WHERE p % 7 = 0 UNION SELECT p // 2, 1, p, 1 FROM p WHERE p % 50 = 0
),
reified AS (
  SELECT p AS id, 3 AS t, 2 AS pid, p // 3 AS v, 1 AS vt, 'someValuesFrom' AS verb, 'v' AS code, 'exists' AS stmt FROM p WHERE p % 3 = 0
  UNION ALL SELECT p, 2, 3, p // 2, 1, 'allValuesFrom', 'a', 'forall' FROM p WHERE p % 8 = 0
  UNION ALL SELECT p, 10, 1, p % 5 + 1, 12, 'hasValue', NULL, NULL FROM p WHERE p % 19 = 0
),
sys(name, pid) AS {_values([(name, pid) for name, pid in SYSTEM_PID.items()])},
drawn AS (
  SELECT c AS rid1, ct AS rtid1, {SYSTEM_PID["subClassOf"]} AS pid, u AS rid2, ut AS rtid2, false AS derived, false AS hidden, NULL AS code, NULL AS stmt
  FROM up WHERE NOT (ct = 1 AND ut = 1 AND (c % 50 = 0 AND u = c // 2 OR u % 50 = 0 AND c = u // 2))
  UNION ALL SELECT p, 1, {SYSTEM_PID["equivalentClass"]}, p + 1, 1, false, false, NULL, NULL FROM p WHERE p % 10 = 5 AND p < (SELECT count(*) FROM part)
  UNION ALL SELECT p, 1, {SYSTEM_PID["equivalentClass"]}, p, 8, false, false, NULL, NULL FROM p WHERE p % 13 = 0
  UNION ALL SELECT s, 12, {SYSTEM_PID["type"]}, s, 1, false, false, NULL, NULL FROM s
  UNION ALL SELECT DISTINCT l_partkey, 1, 1, l_suppkey, 12, false, false, NULL, NULL FROM lineitem
  UNION ALL SELECT p, 1, {SYSTEM_PID["label"]}, rid, 13, false, false, NULL, NULL FROM p JOIN lit ON txt = p_type WHERE p % 4 = 0
  UNION ALL SELECT 3, 15, {SYSTEM_PID["subPropertyOf"]}, 2, 15, false, false, NULL, NULL
  UNION ALL SELECT col0, 15, {SYSTEM_PID["domain"]}, col1, 1, false, false, NULL, NULL FROM (VALUES (1, 1), (3, 2))
  UNION ALL SELECT col0, 15, {SYSTEM_PID["range"]}, col1, col2, false, false, NULL, NULL FROM (VALUES (1, 1, 12), (2, 3, 1))
  UNION ALL SELECT p, 7, {SYSTEM_PID["complementOf"]}, p // 2, 1, false, false, NULL, NULL FROM p WHERE p % 11 = 0
  UNION ALL SELECT p, 9, {SYSTEM_PID["unionOf"]}, p // 2, 1, false, false, NULL, NULL FROM p WHERE p % 17 = 0
  UNION ALL SELECT p, 9, {SYSTEM_PID["unionOf"]}, p, 8, false, false, NULL, NULL FROM p WHERE p % 221 = 0
  UNION ALL SELECT p, 8, {SYSTEM_PID["intersectionOf"]}, p // 2, 1, false, false, NULL, NULL FROM p WHERE p % 13 = 0
  UNION ALL SELECT p, 8, {SYSTEM_PID["intersectionOf"]}, p, 3, false, false, NULL, NULL FROM p WHERE p % 39 = 0
  UNION ALL SELECT id, t, {SYSTEM_PID["type"]}, {CLASSES[1][0]}, 1, true, false, NULL, NULL FROM reified
  UNION ALL SELECT id, t, {SYSTEM_PID["onProperty"]}, pid, 15, true, false, NULL, NULL FROM reified
  UNION ALL SELECT id, t, sys.pid, v, vt, true, false, NULL, NULL FROM reified JOIN sys ON sys.name = verb
  UNION ALL SELECT 1, 1, 1, 1, 12, false, false, NULL, NULL
  UNION ALL SELECT 2, 1, 3, {CLASSES[0][0]}, 1, true, false, NULL, NULL
  UNION ALL SELECT {CLASSES[0][0]}, 1, 2, 3, 1, true, false, NULL, NULL
  UNION ALL SELECT id, t, pid, v, vt, false, true, code, stmt FROM reified WHERE code IS NOT NULL
  UNION ALL SELECT p, 4, 2, {build.SYSTEM_ID}, 14, false, true, 'b', 'cardinality=' || (p % 5 + 1) FROM p WHERE p % 7 = 0
  UNION ALL SELECT p, 1, 2, {build.SYSTEM_ID}, 14, true, false, 'b', 'cardinality=' || (p % 5 + 1) FROM p WHERE p % 7 = 0
),
met AS (SELECT DISTINCT rid2, rtid2 FROM drawn WHERE NOT hidden),
edges AS (
  SELECT d.rid1, d.rtid1, d.pid, d.rid2, d.rtid2, d.derived, d.hidden AND m.rid2 IS NULL AS hidden, d.code, d.stmt
  FROM (SELECT DISTINCT * FROM drawn) d LEFT JOIN met m ON m.rid2 = d.rid1 AND m.rtid2 = d.rtid1
)"""
LABEL_SQL = f""",
named AS (SELECT p, coalesce(CASE WHEN p % 4 = 0 THEN p_type END, p_name) AS l FROM p),
quoted AS (SELECT p, CASE WHEN contains(l, ' ') THEN '"' || l || '"' ELSE l END AS l FROM named),
listed AS (SELECT p, CASE WHEN contains(l, ',') THEN '"' || l || '"' ELSE l END AS l FROM named),
held AS (SELECT p.p, 'something [exists]part_of ' || q.l AS l FROM p JOIN quoted q ON q.p = p.p // 3 WHERE p.p % 3 = 0),
joint AS (
  SELECT p.p, 'intersection of (' || (SELECT string_agg(x, ', ' ORDER BY x) FROM (VALUES (a.l), (s.l)) v(x) WHERE x IS NOT NULL) || ')' AS l
  FROM p JOIN listed a ON a.p = p.p // 2 LEFT JOIN held s ON s.p = p.p AND p.p % 39 = 0 WHERE p.p % 13 = 0
),
labels AS (
  SELECT p AS rid, 1 AS rtid, l AS label FROM named
  UNION ALL SELECT rid, rtid, name FROM nodes WHERE rtid IN (12, 13, 14, 15) OR rid >= {build.SYSTEM_ID} AND rtid = 1
  UNION ALL SELECT p, 3, l FROM held
  UNION ALL SELECT p.p, 2, 'something [forall]"proper part of" ' || q.l FROM p JOIN quoted q ON q.p = p.p // 2 WHERE p.p % 8 = 0
  UNION ALL SELECT p, 4, 'something with part_of = ' || (p % 5 + 1) FROM p WHERE p % 7 = 0
  UNION ALL SELECT p.p, 7, 'not (' || n.l || ')' FROM p JOIN named n ON n.p = p.p // 2 WHERE p.p % 11 = 0
  UNION ALL SELECT p, 10, 'something with value of supplied_by to be ' || CASE WHEN contains(s_name, ' ') THEN '"' || s_name || '"' ELSE s_name END
    FROM p JOIN s ON s = p % 5 + 1 WHERE p % 19 = 0
  UNION ALL SELECT p, 8, l FROM joint
  UNION ALL SELECT p.p, 9, 'union of (' || (SELECT string_agg(x, ', ' ORDER BY x) FROM (VALUES (a.l), (CASE WHEN contains(b.l, ',') THEN '"' || b.l || '"' ELSE b.l END)) v(x) WHERE x IS NOT NULL) || ')'
    FROM p JOIN listed a ON a.p = p.p // 2 LEFT JOIN joint b ON b.p = p.p AND p.p % 221 = 0 WHERE p.p % 17 = 0
)"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = build.build_nodes(build.complete(spark, star_tables(spark, sf_dir)), KB)
    return big(found.select("rid", "rtid", "name", "label", "anonymous", "uri"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = build.build_edges(build.complete(spark, star_tables(spark, sf_dir)), KB)
    kept = ("rid1", "rtid1", "pid", "rid2", "rtid2", "derived", "hidden")
    return big(found.select(*kept, F.col("restriction_type").alias("code"), F.col("restriction_stmt").alias("stmt")))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = build.complete(spark, star_tables(spark, sf_dir))
    nodes, edges = saved(build.build_nodes(t, KB)), saved(build.build_edges(t, KB))
    return big(build.set_labels(t, nodes, edges).select("rid", "rtid", "label"))


def restriction_triples(parts: DataFrame) -> DataFrame:
    """Triples of an ontology in which part k lies below ``part_of some C`` and ``not C`` of class k // 4, each time by an expression of its own."""
    at = "http://example.org/kb#"
    p = F.col("p_partkey")
    cls, blank, other = F.concat(F.lit(f"{at}C"), p.cast("string")), F.concat(F.lit("_:a/"), p.cast("string")), F.concat(F.lit("_:b/"), p.cast("string"))
    filler = F.concat(F.lit(f"{at}C"), F.floor(p / 4).cast("string"))
    resource = lambda x: F.lit(x) if isinstance(x, str) else x
    said = [
        (cls, f"{RDF}type", f"{OWL}Class"), (cls, f"{RDFS}subClassOf", blank), (blank, f"{RDF}type", f"{OWL}Restriction"),
        (blank, f"{OWL}onProperty", f"{at}part_of"), (blank, f"{OWL}someValuesFrom", filler), (cls, f"{RDFS}subClassOf", other),
        (other, f"{RDF}type", f"{OWL}Class"), (other, f"{OWL}complementOf", filler), (filler, f"{RDF}type", f"{OWL}Class"),
        (F.lit(f"{at}part_of"), f"{RDF}type", f"{OWL}ObjectProperty"),
    ]
    null = F.lit(None).cast("string")
    row = [F.struct(s.alias("s"), F.lit(k).alias("p"), resource(o).alias("o"), F.lit(False).alias("literal"), null.alias("lang"), null.alias("datatype")) for s, k, o in said]
    return parts.select(F.explode(F.array(*row)).alias("t")).select("t.*")


def _expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = star.tables(spark, sf_dir)["part"].select("p_partkey")
    tables = owl.shred(restriction_triples(dealt(parts, parts.count(), PARTS, "p_partkey")))
    kinds = (("somevaluesfromclass", T.SOME_VALUES_FROM), ("complementclass", T.COMPLEMENT))
    texts = [tables[t].select(F.lit(int(k)).cast("long").alias("kind"), F.col("browsertext").alias("text")) for t, k in kinds]
    used = tables["subclassof"].groupBy(F.col("parent_rtid").cast("long").alias("kind")).agg(F.count("*").alias("n_uses"))
    return texts[0].unionByName(texts[1]).join(used, "kind").select("kind", "text", "n_uses")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "build_nodes": _nodes, "build_edges": _edges, "set_labels": _labels, "shred_expressions": _expressions,
}

SQL: dict[str, str] = {
    "build_nodes": f"WITH {LOAD_SQL} SELECT rid, rtid::BIGINT AS rtid, name, label, anonymous, uri FROM nodes",
    "build_edges": f"WITH {LOAD_SQL} SELECT rid1, rtid1::BIGINT AS rtid1, pid::BIGINT AS pid, rid2::BIGINT AS rid2, rtid2::BIGINT AS rtid2, derived, hidden, code, stmt FROM edges",
    "set_labels": f"WITH {LOAD_SQL}{LABEL_SQL} SELECT rid, rtid::BIGINT AS rtid, label FROM labels",
    "shred_expressions": """WITH c AS (SELECT DISTINCT 'http://example.org/kb#C' || (p_partkey // 4) AS c FROM part)
      SELECT 3::BIGINT AS kind, 'http://example.org/kb#part_of some ' || c AS text, (SELECT count(*) FROM part)::BIGINT AS n_uses FROM c
      UNION ALL SELECT 7, 'not ' || c, (SELECT count(*) FROM part) FROM c""",
}
