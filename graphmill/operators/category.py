"""Categorised term dictionaries and pivoted cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ABBREVIATIONS, ACRONYMS, SYNONYM_PROPERTIES, Graph
from .closure import named_by
from .infer import has_definition, of_property
from .search import ids_by_term, synonym_edges


def categorised(index: DataFrame, categories: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(rid, cat): classes below each category class (cat) or equal to it, of nested categories the lowest only.

    Members of an equivalence group (rid, ridm) share the categories of the group's representative. ``index`` needs the rows
    of the categories only. Rows of a category, which may be most of the classes, are dealt over several tasks.
    """
    cats = categories.select("cat").distinct()
    held = named_by(index.select(F.col("desc").alias("rid"), F.col("anc").alias("cat")), "cat", cats, "rid").select("rid", "cat")
    below = held.union(cats.select(F.col("cat").alias("rid"), "cat"))
    if groups is not None:
        member = groups.where("rid <> ridm")
        below = below.union(below.join(member, "rid").select(F.col("ridm").alias("rid"), "cat")).distinct()
    # A pair goes if the same class has a category below this one.
    upper = held.select(F.col("rid").alias("cat"), F.col("cat").alias("up")).join(cats, "cat", "left_semi").groupBy("cat").agg(F.collect_set("up").alias("ups"))
    above = named_by(below, "cat", upper, "rid").select("rid", F.explode("ups").alias("cat")).distinct()
    return below.distinct().join(above, ["rid", "cat"], "left_anti")


def term_categories(graph: Graph, index: DataFrame, category_terms: list[str], groups: DataFrame | None = None) -> DataFrame:
    """(rid, label, category, synonyms, abbreviations, acronyms, inferred): classes with their categories and term lists."""
    cats = ids_by_term(graph, category_terms, use_label=True, synonyms=False, class_only=True).select(F.col("rid").alias("cat"))
    found = categorised(index, cats, groups)
    classes = graph.live_nodes.where("rtid = 1").select("rid", F.coalesce("label", "name").alias("label"))
    text = lambda names, out: (
        synonym_edges(graph, names).where("rtid = 1").groupBy("rid").agg(F.array_join(F.array_sort(F.collect_set("term")), ",").alias(out))
    )
    other = [n for n in SYNONYM_PROPERTIES if n not in ("label", "prefLabel", *ABBREVIATIONS, *ACRONYMS)]
    alt = text(["altLabel"], "alt")
    out = found.join(classes, "rid").join(classes.toDF("cat", "category"), "cat").join(alt, "rid", "left").join(text(other, "synonyms"), "rid", "left")
    out = out.join(text(ABBREVIATIONS, "abbreviations"), "rid", "left").join(text(ACRONYMS, "acronyms"), "rid", "left")
    inferred = has_definition(graph).withColumn("inferred", F.lit(True))
    out = out.join(inferred, "rid", "left")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select(
        "rid", F.coalesce("alt", "label").alias("label"), "category", *map(blank, ("synonyms", "abbreviations", "acronyms")),
        F.coalesce("inferred", F.lit(False)).alias("inferred"),
    )


def card(graph: Graph, index: DataFrame, root: DataFrame, pivots: dict[str, str]) -> DataFrame:
    """(rid, name, parents, one column per pivot): classes below the root (rid), their parents' names and literal properties side by side."""
    below = named_by(index, "anc", root.select(F.col("rid").alias("anc")), "desc", "left_semi").select(F.col("desc").alias("rid")).distinct()
    classes = graph.live_nodes.where("rtid = 1").select("rid", "name")
    up = of_property(graph, "subClassOf").where("rtid1 = 1 and rtid2 = 1").select(F.col("rid1").alias("rid"), F.col("rid2").alias("p")).join(classes.toDF("p", "parent"), "p")
    parents = up.groupBy("rid").agg(F.array_join(F.array_sort(F.collect_set("parent")), ";").alias("parents"))
    props = graph.properties.where(F.col("name").isin(list(pivots))).select(F.col("id").alias("pid"), F.col("name").alias("pname"))
    texts = graph.live_nodes.where("rtid = 13").select(F.col("rid").alias("rid2"), F.coalesce("label", "name").alias("v"))
    values = graph.live_edges.where("rtid1 = 1 and rtid2 = 13").join(props, "pid").join(texts, "rid2").groupBy(F.col("rid1").alias("rid")).agg(
        *(F.array_join(F.array_sort(F.collect_set(F.when(F.col("pname") == p, F.col("v")))), ";").alias(c) for p, c in pivots.items())
    )
    out = below.join(classes, "rid").join(parents, "rid", "left").join(values, "rid", "left")
    return out.select("rid", "name", *(F.coalesce(c, F.lit("")).alias(c) for c in ("parents", *pivots.values())))


def located(direct: DataFrame, via: list[DataFrame], up: DataFrame, part: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(cell, region): direct places (cell, region), those over a chain of pairs (src, dst), and everything above a place by
    either closure (desc, anc), less the excluded derived pairs."""
    if via:
        chain = via[0]
        for k, more in enumerate(via[1:]):
            chain = chain.toDF("src", f"m{k}").join(more.toDF(f"m{k}", "dst"), f"m{k}").select("src", "dst")
        direct = direct.union(chain.toDF("cell", "region")).distinct()
    above = up.select("desc", "anc").union(part.select("desc", "anc")).distinct()
    derived = direct.join(above, direct["region"] == above["desc"]).select("cell", F.col("anc").alias("region"))
    if excluded is not None:
        derived = derived.join(excluded, ["cell", "region"], "left_anti")
    return direct.union(derived).distinct()
