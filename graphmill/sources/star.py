"""A graph from the star-schema tables: parts as classes, customers, suppliers, nations and regions as individuals.

The hierarchy over parts (part k below part k // 2 and part k // 3), the equivalences and
the sub-property are synthetic overlays, as the tables hold no ontology.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EDGES_SCHEMA, Graph, ResourceType

KB = 1
SUPPLIER, NATION, REGION = 10_000_000, 20_000_000, 21_000_000
#: (id, name, symmetric, annotation); ids of the graph's properties.
PROPERTIES = (
    (1, "subClassOf", False, False), (2, "part_of", False, False), (3, "supplied_by", False, False), (4, "synonym", False, True),
    (5, "label", False, True), (6, "segment", False, True), (7, "equivalentClass", True, False), (8, "proper_part_of", False, False),
    (9, "subPropertyOf", False, False), (10, "has_part", False, False),
)
URL = "http://example.org/kb#"


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "customer", "supplier", "nation", "region", "lineitem")}


def literals(t: dict[str, DataFrame]) -> DataFrame:
    """(rid, txt): literal texts, numbered in order. The texts are few (types, brands, segments)."""
    from pyspark.sql import Window

    texts = t["part"].select(F.col("p_type").alias("txt")).union(t["part"].select("p_brand")).union(t["customer"].select("c_mktsegment")).distinct()
    return texts.select(F.row_number().over(Window.orderBy("txt")).cast("long").alias("rid"), "txt")


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    t = tables(spark, sf_dir)
    lit = literals(t)
    kind = lambda df, rid, rtid, name, uri=True: df.select(
        F.expr(rid).cast("long").alias("rid"), F.lit(int(rtid)).alias("rtid"), F.col(name).alias("name"), F.col(name).alias("label"),
        F.lit(KB).alias("kbid"), F.lit(False).alias("anonymous"), F.lit(False).alias("is_obsolete"),
        (F.concat(F.lit(URL), F.col(name)) if uri else F.lit(None).cast("string")).alias("uri"),
    )
    props = spark.createDataFrame([(p[0], p[1]) for p in PROPERTIES], "id long, name string")
    nodes = (
        kind(t["part"], "p_partkey", ResourceType.CLASS, "p_name")
        .unionByName(kind(t["customer"], "c_custkey", ResourceType.INDIVIDUAL, "c_name"))
        .unionByName(kind(t["supplier"], f"s_suppkey + {SUPPLIER}", ResourceType.INDIVIDUAL, "s_name"))
        .unionByName(kind(t["nation"], f"n_nationkey + {NATION}", ResourceType.INDIVIDUAL, "n_name"))
        .unionByName(kind(t["region"], f"r_regionkey + {REGION}", ResourceType.INDIVIDUAL, "r_name"))
        .unionByName(kind(lit, "rid", ResourceType.LITERAL, "txt", uri=False))
        .unionByName(kind(props, "id", ResourceType.PROPERTY, "name"))
    )
    part, sup = t["part"], t["supplier"]

    def edge(df: DataFrame, rid1: str, rtid1: int, pid: int, rid2: str, rtid2: int) -> DataFrame:
        return df.select(
            F.expr(rid1).cast("long").alias("rid1"), F.lit(rtid1).alias("rtid1"), F.lit(pid).cast("long").alias("pid"),
            F.expr(rid2).cast("long").alias("rid2"), F.lit(rtid2).alias("rtid2"),
        )

    keys = part.select("p_partkey")
    up = [edge(keys.where(f"p_partkey >= {k}"), "p_partkey", 1, 1, f"p_partkey div {k}", 1) for k in (2, 3)]
    has = lambda texts, column: texts.join(lit, texts[column] == lit["txt"])
    same = keys.where("p_partkey % 10 = 5").join(keys.select((F.col("p_partkey") - 1).alias("below")), F.col("p_partkey") == F.col("below"))
    parts = [
        up[0].unionByName(up[1]).distinct(),
        edge(t["customer"], "c_custkey", 12, 2, f"c_nationkey + {NATION}", 12),
        edge(sup, f"s_suppkey + {SUPPLIER}", 12, 2, f"s_nationkey + {NATION}", 12),
        edge(t["nation"], f"n_nationkey + {NATION}", 12, 2, f"n_regionkey + {REGION}", 12),
        edge(t["lineitem"].select("l_partkey", "l_suppkey").distinct(), "l_partkey", 1, 3, f"l_suppkey + {SUPPLIER}", 12),
        edge(has(part, "p_brand"), "p_partkey", 1, 4, "rid", 13),
        edge(has(part, "p_type"), "p_partkey", 1, 5, "rid", 13),
        edge(has(t["customer"], "c_mktsegment"), "c_custkey", 12, 6, "rid", 13),
        edge(same, "p_partkey", 1, 7, "p_partkey + 1", 1),
        edge(sup.where("s_suppkey % 2 = 0"), f"s_suppkey + {SUPPLIER}", 12, 8, f"s_nationkey + {NATION}", 12),
        edge(spark.range(1), "8", 15, 9, "2", 15),
    ]
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionByName(p)
    rest = {"kbid": F.lit(KB), "derived": F.lit(False), "hidden": F.lit(False), "is_obsolete": F.lit(False)}
    rest |= {c: F.lit(None).cast(k) for c, k in (("org_rid1", "long"), ("org_rid2", "long"), ("restriction_type", "string"), ("restriction_stmt", "string"))}
    edges = edges.withColumns(rest).select(*(x.split()[0] for x in EDGES_SCHEMA.split(", ")))
    flags = [(i, n, not a, False, s, False, False, a, False, KB) for i, n, s, a in PROPERTIES]
    schema = (
        "id long, name string, is_object boolean, is_transitive boolean, is_symmetric boolean, is_functional boolean, "
        "is_datatype boolean, is_annotation boolean, is_system boolean, kbid int"
    )
    weights = t["lineitem"].groupBy("l_partkey", "l_suppkey").agg(F.count("*").cast("double").alias("weight"))
    weights = weights.select(
        F.col("l_partkey").alias("rid1"), F.lit(1).alias("rtid1"), F.lit(3).cast("long").alias("pid"),
        (F.col("l_suppkey") + SUPPLIER).alias("rid2"), F.lit(12).alias("rtid2"), "weight",
    )
    return Graph(
        nodes=nodes,
        edges=edges,
        properties=spark.createDataFrame(flags, schema),
        sub_properties=spark.createDataFrame([(8, 2, KB)], "childid long, parentid long, kbid int"),
        inverse_properties=spark.createDataFrame([(2, 10, KB)], "propertyid1 long, propertyid2 long, kbid int"),
        kbs=spark.createDataFrame([(KB, "star")], "id int, name string"),
        extra={"weights": weights},
    )


#: The same graph as SQL common table expressions.
GRAPH_SQL = f"""
lit AS (
  SELECT row_number() OVER (ORDER BY txt) AS rid, txt
  FROM (SELECT p_type AS txt FROM part UNION SELECT p_brand FROM part UNION SELECT c_mktsegment FROM customer)
),
prop(pid, pname, sym) AS (VALUES {", ".join(f"({i}::BIGINT, '{n}', {str(s).lower()})" for i, n, s, _ in PROPERTIES)}),
nodes AS (
  SELECT p_partkey::BIGINT AS rid, 1 AS rtid, p_name AS name FROM part
  UNION ALL SELECT c_custkey, 12, c_name FROM customer
  UNION ALL SELECT s_suppkey + {SUPPLIER}, 12, s_name FROM supplier
  UNION ALL SELECT n_nationkey + {NATION}, 12, n_name FROM nation
  UNION ALL SELECT r_regionkey + {REGION}, 12, r_name FROM region
  UNION ALL SELECT rid, 13, txt FROM lit
  UNION ALL SELECT pid, 15, pname FROM prop
),
sub AS (SELECT DISTINCT p_partkey AS src, p_partkey // k AS dst FROM part, (VALUES (2), (3)) t(k) WHERE p_partkey >= k),
edges AS (
  SELECT src::BIGINT AS rid1, 1 AS rtid1, 1::BIGINT AS pid, dst::BIGINT AS rid2, 1 AS rtid2 FROM sub
  UNION ALL SELECT c_custkey, 12, 2, c_nationkey + {NATION}, 12 FROM customer
  UNION ALL SELECT s_suppkey + {SUPPLIER}, 12, 2, s_nationkey + {NATION}, 12 FROM supplier
  UNION ALL SELECT n_nationkey + {NATION}, 12, 2, n_regionkey + {REGION}, 12 FROM nation
  UNION ALL SELECT DISTINCT l_partkey, 1, 3, l_suppkey + {SUPPLIER}, 12 FROM lineitem
  UNION ALL SELECT p_partkey, 1, 4, rid, 13 FROM part JOIN lit ON p_brand = txt
  UNION ALL SELECT p_partkey, 1, 5, rid, 13 FROM part JOIN lit ON p_type = txt
  UNION ALL SELECT c_custkey, 12, 6, rid, 13 FROM customer JOIN lit ON c_mktsegment = txt
  UNION ALL SELECT p_partkey, 1, 7, p_partkey + 1, 1 FROM part WHERE p_partkey % 10 = 5 AND p_partkey + 1 IN (SELECT p_partkey FROM part)
  UNION ALL SELECT s_suppkey + {SUPPLIER}, 12, 8, s_nationkey + {NATION}, 12 FROM supplier WHERE s_suppkey % 2 = 0
  UNION ALL SELECT 8, 15, 9, 2, 15
)"""
