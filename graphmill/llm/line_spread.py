"""Cross-site boilerplate lines, found by their distinct-site spread. DataFrame functions only.

A HyperLogLog sketch of sites is built for each line hash; partial sketches merge
by aggregation, so a line that occurs everywhere costs one sketch a task. Lines
whose estimate lies near the threshold get an exact distinct count. Lines on
``min_sites`` sites or more are removed from every document, by their numbers in its text.

A line is a ``\\n``-separated part of a text with at least one word; lines without
a word are never removed. Defined results: a null site counts for no line; a null
text has no lines and stays null; a null doc_id and repeated rows keep their rows; other
columns stay as they are, but for those named like a column of the result, which replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.closure import named_by
from ..session import saved_rows
from .common import WORD, packed, unpacked

MIN_SITES = 5
#: Columns of the result; they replace those of the documents with the same names.
OWN = ("kept_text", "n_lines", "n_removed")
SKETCH_BITS = 12
#: Relative standard error of such a sketch, times four.
MARGIN = 4 * 1.04 / 2 ** (SKETCH_BITS / 2)


#: Lines whose hashes are broadcast at most (12 bytes each); beyond it the join is a salted shuffle.
MOST_LINES = 250_000


def _lines(docs: DataFrame, *keys: Column) -> DataFrame:
    """The keys, number ``place`` and 96 bits of hash (a, b) of each line with a word."""
    # The keys are computed below the explode: beside it, they would be computed again for every line.
    whole = docs.select(*keys, docs["text"].alias("_text"))
    own = whole.columns[:-1]
    found = whole.select(*own, F.posexplode(F.split("_text", "\n")).alias("place", "line")).where(F.regexp_like("line", F.lit(WORD)))
    return found.select(*own, "place", F.xxhash64("line").alias("a"), F.hash("line").alias("b"))


def _met(lines: DataFrame, table: DataFrame, n_table: int, by: str) -> DataFrame:
    """The lines whose hashes ``table`` holds; a line that a third of all documents hold is dealt over many tasks, by column ``by``."""
    if n_table <= MOST_LINES:
        return lines.join(F.broadcast(table), ["a", "b"])
    return named_by(lines, ["a", "b"], table, by)


def spread_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes (a, b) and number of sites of the lines on at least ``min_sites`` sites."""
    lines = _lines(docs, docs[site].alias("site")).where("site is not null").select("site", "a", "b")
    # Copies of one line on one site collapse in the map-side combine of this grouping.
    estimates = lines.groupBy("a", "b").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_BITS))).alias("n_sites"))
    slack = max(1.0, MARGIN * min_sites)
    near = F.abs(F.col("n_sites") - min_sites) <= slack
    candidates, n_near = saved_rows(estimates.where(F.col("n_sites") >= min_sites - slack).withColumn("near", near), "near")
    # Only near lines get here: they have few sites, so few distinct pairs.
    exact = (
        _met(lines, candidates.where("near").select("a", "b"), n_near, "site")
        .distinct()
        .groupBy("a", "b")
        .agg(F.count("*").alias("n_sites"))
        .where(F.col("n_sites") >= min_sites)
    )
    return candidates.where("not near").select("a", "b", "n_sites").unionByName(exact)


def remove_spread_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """The documents with ``kept_text`` (boilerplate lines taken out), ``n_lines`` and ``n_removed``."""
    spread, n_spread = saved_rows(spread_lines(docs, site, min_sites).select("a", "b"))
    key = [docs["doc_id"].cast("long").alias("id"), F.xxhash64(docs["text"]).alias("tie")]
    hits = (
        _met(_lines(docs, *key), spread, n_spread, "tie")
        .groupBy("id", "tie")
        .agg(F.collect_set("place").alias("gone"))  # at most the lines of one text
        .select(F.col("id").alias("of_id"), F.col("tie").alias("of_tie"), "gone")
    )
    joined = packed(docs, *key).join(hits, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("tie") == F.col("of_tie")), "left")
    # The lines are bound to a lambda's variable: inlined, they would be split again for every line.
    staying = lambda p: F.array_except(F.sequence(F.lit(0), F.size(p) - 1), "gone")
    kept = F.transform(F.array(F.split("row.text", "\n")), lambda p: F.array_join(F.transform(staying(p), lambda i: F.get(p, i)), "\n"))
    n_lines = F.size(F.filter(F.split("row.text", "\n"), lambda x: F.regexp_like(x, F.lit(WORD))))
    # Computed before the documents' columns stand beside them, as those may bear any name.
    found = joined.select(
        "row",
        F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.element_at(kept, 1)).alias("kept_text"),
        F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
    return found.select(*unpacked(docs, OWN), *OWN)


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select(
        F.col("doc_id").cast("long"),
        "n_lines",
        "n_removed",
        F.coalesce(F.length("kept_text"), F.lit(0)).cast("long").alias("kept_chars"),
        F.md5(F.coalesce(F.col("kept_text"), F.lit(""))).alias("kept_md5"),
    )


ORACLE_SQL = f"""
WITH lines AS (
  SELECT d.doc_id, d.source, d.text, u.line, u.k
  FROM (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL) d,
       LATERAL (SELECT unnest(d.ls) AS line, unnest(range(len(d.ls))) AS k) u
),
worded AS (SELECT * FROM lines WHERE regexp_matches(line, '[^ \\t-\\r]')),
spread AS (SELECT line FROM worded GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (
  SELECT l.doc_id, l.line, l.k, regexp_matches(l.line, '[^ \\t-\\r]') AS worded, s.line IS NOT NULL AS gone
  FROM lines l LEFT JOIN (SELECT line FROM spread) s ON l.line = s.line
),
cleaned AS (
  SELECT doc_id, count(*) FILTER (WHERE worded) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') AS kept
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(c.n_lines, 0)::BIGINT AS n_lines, coalesce(c.n_removed, 0)::BIGINT AS n_removed,
       length(coalesce(c.kept, ''))::BIGINT AS kept_chars, md5(coalesce(c.kept, '')) AS kept_md5
FROM documents d LEFT JOIN cleaned c USING (doc_id)
"""
