"""Result rendering: XML, JSON and tab-separated rows, built as columns so that output is written where the rows are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import GraphError, node_id


def relationships_xml(edges: DataFrame) -> DataFrame:
    """(xml) one ``relationship`` element per named edge: subject, property and object with their ids."""
    end = lambda k: F.struct(node_id(F.col(f"rid{k}"), F.col(f"rtid{k}")).alias("_id"), F.col(f"name{k}").alias("_VALUE"))
    row = F.struct(
        end(1).alias("subject"),
        F.struct(node_id(F.col("pid"), F.lit(15)).alias("_id"), F.col("pname").alias("_VALUE")).alias("property"),
        end(2).alias("object"),
    )
    return edges.select(F.to_xml(row, {"rowTag": "relationship"}).alias("xml"))


def relationships_document(edges: DataFrame, truncated: bool) -> DataFrame:
    """(xml) one row: the response to a neighbourhood request, whose edges a limit bounds, and whether there were more.

    The names of its elements are fixed values.
    """
    rows = relationships_xml(edges)
    inner = F.array_join(F.array_sort(F.collect_list("xml")), "")
    head, flag = "<success><data><ontGraph><relationships>", str(truncated).lower()
    tail = f"</relationships></ontGraph></data><truncatedResults>{flag}</truncatedResults></success>"
    return rows.agg(F.concat(F.lit(head), inner, F.lit(tail)).alias("xml"))


def classes_xml(details: DataFrame) -> DataFrame:
    """(xml) one ``class`` element per row of concept details."""
    rest = [F.col(c) for c in details.columns if c not in ("rid", "name")]
    row = F.struct(node_id(F.col("rid"), F.lit(1)).alias("_id"), F.col("name"), *rest)
    return details.select(F.to_xml(row, {"rowTag": "class"}).alias("xml"))


def terms_xml(terms: DataFrame) -> DataFrame:
    """(xml) one ``term`` element per suggested term."""
    return terms.select(F.to_xml(F.struct(F.col("term").alias("_VALUE"), F.col("dist").alias("_distance")), {"rowTag": "term"}).alias("xml"))


def reconcile_json(found: DataFrame, callback: str | None = None) -> DataFrame:
    """(json) one row: all candidates, best first, as the response of a reconciliation service; wrapped for a callback if given.

    Candidates are a top-k result, so their list is bounded by its limit.
    """
    row = F.struct(
        (-F.col("score")).alias("order"), F.col("term").alias("name"),
        F.struct(F.col("rid").alias("id"), "term", "score", F.col("is_match").alias("match"), F.array("category").alias("type")).alias("row"),
    )
    rows = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["row"])
    text: Column = F.to_json(F.struct(rows.alias("result")))
    return found.agg((F.concat(F.lit(f"{callback}("), text, F.lit(")")) if callback else text).alias("json"))


def tab_separated(rows: DataFrame) -> DataFrame:
    """(line) one tab-separated line per row: nulls empty, tabs and line breaks within values as spaces."""
    value = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]+", " ")
    return rows.select(F.concat_ws("\t", *map(value, rows.columns)).alias("line"))


def error_envelope(error: GraphError) -> dict[str, str]:
    return {"type": error.kind, "message": str(error)}
