"""Merkle manifest of a dataset: a tree of fanout 16 for each source, and one tree over the sources.

1. Leaves: a hash of each row's fields, taken where the row is read; only hashes go on.
2. Index: leaves are dealt by ranges of (source, doc_id), so that a hot source lies in many
   partitions; counts of (source, partition) give every leaf its number within its source.
3. Mountain range: each part of a source goes through one task in order. Its peaks form a
   stack, a list of at most 15 pending nodes a level. Sixteen aligned nodes become their
   parent, which carries into the next level; a record holds the parent and its children. Nodes
   of runs that begin or end in another part come out as loose nodes, some 30 a level and part.
4. Merging: level by level, loose nodes of all parts meet by their run and become its
   parent; the last run of a level is shorter and hashed as it is, without padding.
5. Proofs: from the root down, each record hands its children what stands left and right of
   them on the way to the root; documents meet the record of their run.

Defined results: nulls hash as ``-``; a null doc_id comes first and is never tampered with;
rows that share a doc_id stand in order of their leaves; repeated rows are leaves of their own;
an empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Of documents whose id has a checksum divisible by this, a tampered copy is checked.
TAMPERED = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of a hash.
WIDE = 64

RECORDS = "tree string, n long, level int, idx long, node string, kids string, place string, changed string"


def _leaf(docs: DataFrame, text: Column) -> Column:
    """Hash of a row's fields, each ``-`` or its number of bytes, a colon and the value."""
    values = [text if c == "text" else docs[c].cast("long").cast("string") if c in ("doc_id", "n_chars") else docs[c] for c in FIELDS]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, place, leaf, changed): ``place`` is the doc_id, ``tree`` sorts as the source does, null first; ``changed`` is the leaf of a tampered copy."""
    doc_id = docs["doc_id"].cast("long")
    lower = _leaf(docs, F.translate(docs["text"], UPPER, LOWER))
    return docs.select(
        F.coalesce(F.concat(F.lit("s"), docs["source"]), F.lit("")).alias("tree"),
        doc_id.alias("place"),
        _leaf(docs, docs["text"]).alias("leaf"),
        F.when(F.crc32(doc_id.cast("string")) % TAMPERED == 0, lower).alias("changed"),
    )


def _stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves, finished runs and loose nodes of each part of a tree, whose leaves come in order."""
    names = ("tree", "n", "level", "idx", "node", "kids", "place", "changed")
    schema = pa.schema([(c, pa.int32() if c == "level" else pa.int64() if c in ("n", "idx") else pa.string()) for c in names])
    out: list[tuple] = []
    key, peaks = None, []

    def add(tree: str, n: int, level: int, idx: int, node: str) -> None:
        while True:
            if level == len(peaks):
                peaks.append([])
            peaks[level].append((idx, node))
            if idx % FANOUT != FANOUT - 1:
                return
            if len(peaks[level]) < FANOUT:  # the run began in another part
                loose(tree, n, level)
                return
            kids = "".join(x for _, x in peaks[level])
            peaks[level] = []
            level, idx, node = level + 1, idx // FANOUT, hashlib.sha256(kids.encode()).hexdigest()
            out.append((tree, n, level - 1, idx, node, kids, None, None))

    def loose(tree: str, n: int, level: int) -> None:
        out.extend((tree, n, level, idx, node, None, None, None) for idx, node in peaks[level])
        peaks[level] = []

    def batch() -> pa.RecordBatch:
        found = pa.record_batch([pa.array(col, field.type) for col, field in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        out.clear()
        return found

    for rows in batches:
        columns = (rows.column(c).to_pylist() for c in ("tree", "part", "n", "idx", "place", "leaf", "changed"))
        for tree, part, n, idx, place, leaf, changed in zip(*columns, strict=True):
            if key != (tree, part):
                for level in range(len(peaks)):
                    loose(*own, level)
                key, peaks = (tree, part), []
            own = (tree, n)
            out.append((tree, n, -1, idx, leaf, None, place, changed))
            add(tree, n, 0, idx, leaf)
        if out:
            yield batch()
    for level in range(len(peaks)):
        loose(*own, level)
    if out:
        yield batch()


def _width(level: int) -> Column:
    """Nodes on a level of a tree of n leaves."""
    return F.ceil(F.col("n") / float(FANOUT**level))


class Forest:
    """Trees over ``rows`` (tree, place, leaf, changed), ordered by ``place`` and leaf within each tree.

    ``records``: leaves (level -1), finished runs and loose nodes; ``runs[l]``: all runs of level
    l as (tree, n, idx, kids); ``tops``: (tree, n, subroot).
    """

    def __init__(self, rows: DataFrame):
        order = ["place", "leaf"]
        placed = saved(rows).repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
        placed = saved(placed.withColumn("part", F.spark_partition_id()))
        # A row for each tree and partition.
        counts = placed.groupBy("tree", "part").count()
        by_tree = Window.partitionBy("tree")
        before = by_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.select("tree", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"), F.sum("count").over(by_tree).alias("n"))
        within = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order))
        indexed = placed.withColumn("rn", within).join(counts.hint("merge"), ["tree", "part"])
        indexed = indexed.select("tree", "part", "n", (F.col("start") + F.col("rn") - 1).alias("idx"), F.col("place").cast("string"), "leaf", "changed")
        self.records = saved(indexed.sortWithinPartitions("tree", "part", "idx").mapInArrow(_stacked, RECORDS))
        most = self.records.agg(F.max("n")).first()[0] or 0
        self.levels = 0
        while FANOUT**self.levels < most:
            self.levels += 1
        self._merge()

    def _merge(self) -> None:
        nodes = self.records.where("level >= 0 and kids is null").select("tree", "n", "level", "idx", "node")
        carried, self.runs, tops = nodes.where("false"), [], []
        for level in range(self.levels + 1):
            here = nodes.where(F.col("level") == level).union(carried)
            tops.append(here.where(_width(level) == 1).select("tree", "n", F.col("node").alias("subroot")))
            if level < self.levels:
                run = here.where(_width(level) > 1).groupBy("tree", "n", F.expr(f"idx div {FANOUT}").alias("idx"))
                run = run.agg(F.array_sort(F.collect_list(F.struct(here["idx"].alias("at"), "node"))).alias("kids"))  # sixteen at most
                run = saved(run.select("tree", "n", "idx", F.array_join("kids.node", "").alias("kids")))
                whole = self.records.where((F.col("level") == level) & F.col("kids").isNotNull()).select("tree", "n", "idx", "kids")
                self.runs.append(whole.union(run))
                carried = run.select("tree", "n", F.lit(level + 1).alias("level"), "idx", F.sha2("kids", 256).alias("node"))
        found = tops[0]
        for more in tops[1:]:
            found = found.union(more)
        self.tops = saved(found)

    def ways(self, outer: DataFrame) -> DataFrame:
        """(place, leaf, changed, way, *others) of every leaf: ``way`` holds (left, right) of each level up to the root.

        ``outer`` (tree, way, *others) has what comes above each tree's top.
        """
        others = [c for c in outer.columns if c not in ("tree", "way")]
        above = None
        for level in range(self.levels - 1, -1, -1):
            runs = self.runs[level]
            top = _width(level + 1) == 1
            here = runs.where(top).join(outer.hint("merge"), "tree").select("tree", "idx", "kids", "way", *others)
            if above is not None:
                here = here.union(self._below(runs.where(~top), above, ["kids"], others).select("tree", "idx", "kids", "way", *others))
            above = here
        own = ["place", "leaf", "changed"]
        found = self.records.where("level = -1").withColumnRenamed("node", "leaf").select("tree", "n", "idx", *own)
        alone = found.where("n = 1").join(outer.hint("merge"), "tree").select(*own, "way", *others)
        return alone if above is None else alone.union(self._below(found.where("n > 1"), above, own, others).select(*own, "way", *others))

    @staticmethod
    def _below(rows: DataFrame, above: DataFrame, own: list[str], others: list[str]) -> DataFrame:
        """``rows`` (tree, idx, *own) with the way from each through its run in ``above``."""
        runs = above.select("tree", F.col("idx").alias("up"), F.col("kids").alias("run"), "way", *others)
        met = rows.withColumn("up", F.expr(f"idx div {FANOUT}")).join(runs.hint("merge"), ["tree", "up"])
        at = (F.pmod("idx", F.lit(FANOUT)) * WIDE).cast("int")
        sides = F.struct(F.substring(F.col("run"), F.lit(1), at).alias("left"), F.substring(F.col("run"), at + WIDE + 1, F.lit(FANOUT * WIDE)).alias("right"))
        return met.select("tree", "idx", *own, F.concat(F.array(sides), "way").alias("way"), *others)


def manifest(docs: DataFrame) -> DataFrame:
    """Per row: leaf, roots, the hash of its proof, and the root recomputed from the row as it is found (some are tampered with)."""
    forest = Forest(leaves(docs))
    subroots = forest.tops.select(F.lit("").alias("tree"), F.col("tree").alias("place"), F.col("subroot").alias("leaf"), F.lit(None).cast("string").alias("changed"))
    sources = Forest(subroots)
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    whole = sources.tops.select("tree", nothing.alias("way"), F.col("subroot").alias("root"))
    outer = saved(sources.ways(whole).select(F.col("place").alias("tree"), F.col("leaf").alias("subroot"), "way", "root"))
    folded = F.aggregate("way", F.coalesce("changed", "leaf"), lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))
    proof = F.sha2(F.array_join(F.transform("way", lambda p: F.concat(p["left"], p["right"])), ""), 256)
    found = forest.ways(outer).select(F.col("place").cast("long").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 6, source_levels: int = 4) -> str:
    """The registered query in SQL, for 16 ** levels documents a source and 16 ** source_levels sources."""
    value = lambda x: f"coalesce(strlen({x})::VARCHAR || ':' || {x}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(value, ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text))) + ")"
    parts = [
        f"""crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k:
          CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i)))""",
        f"""base AS (SELECT doc_id, source, {leaf("text")} AS leaf, {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} AS lower,
          xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
            lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS crc FROM documents, crc_table)""",
        f"""docs AS (SELECT *, CASE WHEN crc % {TAMPERED} = 0 THEN lower ELSE leaf END AS found,
          CASE WHEN source IS NULL THEN '' ELSE 's' || source END AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM base)""",
        "a0 AS (SELECT tree, idx, leaf AS node, count(*) OVER (PARTITION BY tree) AS m FROM docs)",
    ]

    def tree(name: str, levels: int) -> None:
        for k in range(levels):
            parts.append(
                f"""{name}{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS m FROM (SELECT tree, idx // {FANOUT} AS idx,
                  CASE WHEN any_value(m) = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY idx)) END AS node FROM {name}{k} GROUP BY tree, idx // {FANOUT}))"""
            )

    def fold(rows: str, name: str, levels: int, start: int) -> None:
        for k in range(levels):
            parts.append(
                f"""{rows}{start + k + 1} AS (
                  SELECT * EXCLUDE (proof, h, idx, before, after, single), idx // {FANOUT} AS idx, proof || before || after AS proof,
                    CASE WHEN single THEN h ELSE sha256(before || h || after) END AS h
                  FROM (SELECT d.*, coalesce(string_agg(n.node, '' ORDER BY n.idx) FILTER (WHERE n.idx < d.idx), '') AS before,
                    coalesce(string_agg(n.node, '' ORDER BY n.idx) FILTER (WHERE n.idx > d.idx), '') AS after, bool_and(n.m = 1) AS single
                    FROM {rows}{start + k} d JOIN {name}{k} n ON n.tree = d.{name}_tree AND n.idx // {FANOUT} = d.idx // {FANOUT} GROUP BY ALL))"""
            )

    tree("a", levels)
    parts.append(f"b0 AS (SELECT 'all' AS tree, row_number() OVER (ORDER BY tree) - 1 AS idx, tree AS name, node, count(*) OVER () AS m FROM a{levels})")
    tree("b", source_levels)
    parts.append("d0 AS (SELECT row_number() OVER () AS rid, doc_id, leaf, tree AS a_tree, 'all' AS b_tree, idx, found AS h, '' AS proof FROM docs)")
    fold("d", "a", levels, 0)
    parts.append(f"e{levels} AS (SELECT d.* EXCLUDE (idx), b0.idx FROM d{levels} d JOIN b0 ON b0.name = d.a_tree)")
    fold("e", "b", source_levels, levels)
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT e.doc_id, e.leaf, s.node AS subroot, r.node AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = r.node AS verified
FROM e{levels + source_levels} e JOIN a{levels} s ON s.tree = e.a_tree JOIN b{source_levels} r ON r.tree = e.b_tree
"""
    )


ORACLE_SQL = _sql()
