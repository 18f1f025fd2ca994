"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

1. Targets: sources (by code point, null last) weigh 3, 1, 2, repeating, and share 150 %
   of all words; no target exceeds twice its source, the excess is shared again. A source's
   quota is its rounded target, one word at least if the target is above 0.
2. Blocks: each source's documents stand in a shuffled order (by MD5 of the id), a ring of
   words cut into equal blocks. A block has 256 words, or less if the mix were below 1024 blocks,
   or more if it were above 2 ** 22. A source needs as many blocks as its quota fills.
3. Schedule: point i is ``frac(i * phi)`` (as 32-bit integers), mapped through the sources'
   cumulative numbers of blocks. No gap between the first 2 n points of that sequence is as wide as
   1 / n, so twice as many points as blocks give every source the slots it needs; points are
   ranked per source, and those beyond its blocks stay empty.
4. Joining: the first point of a source tells, by its place in the source's range, at which
   block of the ring the source begins. Its slot of rank k hands out the k-th block from there,
   the last one up to the quota. What a document gives is what the slots hand out of it.

Ranks and word offsets come from two-level prefix sums (per bucket, then within), so no
window ever holds a whole source. Defined results: a null text has size 0; null sources are
one source, the last; documents of size 0 take nothing; repeated rows are rows of their own
(which of equal rows takes which words is left open); an empty table gives no rows; other
columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.closure import named_by
from .common import WORD, n_words, packed, saved, unpacked

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_TIMES = 2
#: Words in a block, unless the mix had fewer or more blocks than these.
BLOCK, LEAST_BLOCKS, MOST_BLOCKS = 256, 1024, 1 << 22
#: floor(2**32 / golden ratio), the step of the point sequence (fixed value).
STEP = 2654435769
#: Slots in a bucket of the ranking; hex digits of the hash that make a shuffle bucket.
SLOTS, DIGITS = 65536, 3


def _key(docs: DataFrame) -> list[Column]:
    """What tells a document from others: id, source, hash of the text and size in words."""
    text = docs["text"]
    return [docs["doc_id"].cast("long").alias("doc_id"), docs["source"].alias("source"), F.xxhash64(text).alias("tie"), n_words(text).alias("size")]


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, hash and size in words of each document, saved: the texts are read once for them."""
    return saved(docs.select(*_key(docs)))


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source: rank ``src``, ``source_size``, ``target`` and ``quota``."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Windows over one row per source.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    ranked = total.select("source", "source_size", F.row_number().over(by_name).cast("long").alias("src"))
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("src") - 1) % len(WEIGHTS) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", (F.col("source_size") * MOST_TIMES).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "src").rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.withColumn(
        "level",
        (F.sum("source_size").over(everything) * SHARE - F.coalesce(F.sum("cap").over(order), F.lit(0.0)))
        / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(order), F.lit(0.0))),
    )
    open_level = F.max(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.col("level"))).over(everything)
    found = level.withColumn("target", F.least(F.col("cap"), F.coalesce(open_level, F.lit(0.0)) * F.col("w")))
    quota = F.when(F.col("target") > 0, F.greatest(F.round("target"), F.lit(1.0))).otherwise(0).cast("long")
    return saved(found.select("source", "src", "source_size", "target", quota.alias("quota")))


def block_words(goal: DataFrame, block: int = BLOCK, least_blocks: int = LEAST_BLOCKS, most_blocks: int = MOST_BLOCKS) -> int:
    """Words in a block, from the sum of the quotas."""
    total = goal.agg(F.sum("quota")).first()[0] or 0
    return max(1, min(block, total // least_blocks), total // most_blocks)


def schedule(goal: DataFrame, block: int) -> DataFrame:
    """(src, k, slot, begin): the slot of each block of each source, and the word of the ring at which the source begins."""
    # A window over one row per source.
    need = F.ceil(F.col("quota") / block)
    upto = F.sum(need).over(Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0))
    found = goal.select("src", "source_size", need.alias("need"), upto.alias("upto")).where("need > 0")
    blocks = found.agg(F.max("upto")).first()[0] or 0
    if not blocks:
        return goal.select("src", F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("begin")).where("false")
    border = lambda x: F.expr(f"({x} << 32) div {blocks}")
    found = found.select("src", "source_size", "need", border("(upto - need)").alias("lo"), border("upto").alias("hi"))
    points = goal.sparkSession.range(2 * blocks).select(F.col("id").alias("slot"), ((F.col("id") * STEP) % F.lit(2**32)).alias("point"))
    # One row per source against every point would be a cross join; equal-width cells of the point range, as many
    # as blocks, make it an equi-join: a source's range is cut at cell borders.
    cell = max(1, 2**32 // blocks)
    cells = F.sequence(F.floor(F.col("lo") / cell).cast("long"), F.floor((F.col("hi") - 1) / cell).cast("long"))
    owned = points.withColumn("cell", F.floor(F.col("point") / cell).cast("long")).join(found.withColumn("cell", F.explode(cells)).hint("merge"), "cell")
    owned = owned.where("point >= lo and point < hi").withColumn("part", F.floor(F.col("slot") / SLOTS))
    before = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = owned.groupBy("src", "part").count().select("src", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("src", "part").orderBy("slot")
    ranked = owned.withColumn("rn", F.row_number().over(within)).join(starts.hint("merge"), ["src", "part"]).withColumn("k", F.col("start") + F.col("rn") - 1)
    ranked = ranked.where("k < need")
    ring = F.ceil(F.col("source_size") / block)
    begin = F.floor((F.col("point") - F.col("lo")) / (F.col("hi") - F.col("lo")) * ring) * block
    first = ranked.where("k = 0").select("src", begin.cast("long").alias("begin"))
    return ranked.select("src", "k", "slot").join(first.hint("merge"), "src")


def placed(sizes: DataFrame, goal: DataFrame) -> DataFrame:
    """Documents with their source's numbers and ``first``: the words before them in the shuffled source."""
    shuffle = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    # A struct of the source, as null is a source too; a hot source is dealt by the hash of the id.
    goal = goal.select(F.struct("source").alias("of"), "src", "source_size", "target", "quota")
    rows = named_by(sizes.withColumn("of", F.struct("source")).withColumn("shuffle", shuffle), "of", goal, "shuffle")
    rows = rows.withColumn("bucket", F.substring("shuffle", 1, DIGITS))
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("src", "bucket").agg(F.sum("size").alias("in_bucket"))
    starts = starts.select("src", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("src", "bucket").orderBy("shuffle", "doc_id", "size", "tie")
    numbered = rows.select(
        "doc_id", "source", "tie", "size", "src", "source_size", "target", "quota", "bucket", "shuffle",
        F.row_number().over(within).alias("rn"),
        F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("inner"),
    )
    joined = numbered.join(starts, ["src", "bucket"])
    return joined.withColumn("first", F.col("start") + F.col("inner")).drop("start", "inner")


def pieces(rows: DataFrame, slots: DataFrame, block: int) -> DataFrame:
    """Which words of which document each slot hands out: one row per document, ``turn`` of the ring and block ``k``.

    A document that no slot takes from has one row, with null ``turn`` and ``slot``.
    """
    begins = slots.where("k = 0").select("src", "begin")
    rows = named_by(rows, "src", begins, "shuffle", "left").withColumn("begin", F.coalesce("begin", F.lit(0)))
    start = lambda t: F.col("first") + F.col("source_size") * t - F.col("begin")
    spans = F.array(
        *(
            F.struct(
                F.lit(t).alias("turn"), start(t).alias("at"), F.greatest(start(t), F.lit(0)).alias("a"), F.least(start(t) + F.col("size"), "quota").alias("b")
            )
            for t in range(MOST_TIMES + 1)
        )
    )
    cut = rows.withColumn("span", F.explode_outer(F.filter(spans, lambda x: x["b"] > x["a"]))).select("*", "span.*").drop("span")
    cut = cut.withColumn("k", F.explode_outer(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))))
    lo, hi = F.greatest("a", F.col("k") * block), F.least("b", (F.col("k") + 1) * block)
    cut = cut.withColumns({"from_word": lo - F.col("at"), "to_word": hi - F.col("at")}).drop("a", "b", "at", "begin")
    # Every block that is needed has its slot; the outer side keeps the documents that give nothing.
    return cut.join(slots.select("src", "k", "slot").hint("merge"), ["src", "k"], "left")


def _cut(docs: DataFrame) -> DataFrame:
    sizes = sized(docs)
    goal = targets(sizes)
    block = block_words(goal)
    return pieces(placed(sizes, goal), saved(schedule(goal, block)), block)


def mix(docs: DataFrame) -> DataFrame:
    """Per document: its size, its source's size and target, the words that the mix takes of it, and the first slot that does."""
    keys = ["src", "bucket", "rn", "doc_id", "size", "source_size", "target"]
    took = F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("to_word") - F.col("from_word"))), F.lit(0)).cast("long")
    found = _cut(docs).groupBy(*keys).agg(took.alias("taken"), F.min("slot").alias("first_slot"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of the documents: a row for each time that a document is taken, in order of the schedule.

    The documents in which its source begins or its quota ends keep the taken words, joined by one space.
    """
    same = ["doc_id", "source", "tie", "size"]
    turns = _cut(docs).where("slot is not null").groupBy(*same, "src", "bucket", "rn", "turn")
    turns = turns.agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"), F.min("from_word").alias("from"), F.min("slot").alias("slot"))
    # Rows that share all four are told apart by their place among their like.
    like = lambda *order: F.dense_rank().over(Window.partitionBy(*same).orderBy(*order))
    turns = turns.withColumn("like", like("src", "bucket", "rn")).select(F.struct(*same).alias("same"), "like", "src", "slot", "from", "taken")
    texts = packed(docs, *_key(docs)).withColumn("like", F.row_number().over(Window.partitionBy(*same).orderBy("size")))
    taken = texts.select("row", F.struct(*same).alias("same"), "like").join(turns.hint("merge"), ["same", "like"])
    words = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)), F.col("from").cast("int") + 1, F.col("taken").cast("int")), " ")
    text = F.when(F.col("taken") < F.col("same.size"), words).otherwise(F.col("row.text"))
    own = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    ordered = taken.orderBy("slot", "src", "same.doc_id")
    return ordered.select(*(own[c].alias(c) if c in own else whole for c, whole in zip(docs.columns, unpacked(docs), strict=True)))


ORACLE_SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0)::BIGINT AS size FROM documents
),
total AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS src FROM total
),
weighed AS (
  SELECT *, [{", ".join(f"{w}.0::DOUBLE" for w in WEIGHTS)}][((src - 1) % {len(WEIGHTS)} + 1)::INT] AS w, (source_size * {MOST_TIMES})::DOUBLE AS cap FROM ranked
),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM weighed)::DOUBLE * {SHARE}
    - coalesce(sum(cap) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / ((SELECT sum(w) FROM weighed) - coalesce(sum(w) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed
),
aims AS (
  SELECT *, least(cap, coalesce((SELECT max(level) FROM levels WHERE cap / w >= level), 0) * w) AS target FROM levels
),
goal AS (SELECT *, CASE WHEN target > 0 THEN greatest(round(target), 1)::BIGINT ELSE 0 END AS quota FROM aims),
plan AS (
  SELECT greatest(1, least({BLOCK}, whole // {LEAST_BLOCKS}), whole // {MOST_BLOCKS}) AS block FROM (SELECT coalesce(sum(quota), 0)::BIGINT AS whole FROM goal)
),
needs AS (SELECT *, (quota + block - 1) // block AS need, sum((quota + block - 1) // block) OVER (ORDER BY src)::BIGINT AS upto FROM goal, plan),
ranges AS (
  SELECT *, ((upto - need) << 32) // blocks AS lo, (upto << 32) // blocks AS hi FROM (SELECT *, max(upto) OVER () AS blocks FROM needs) WHERE need > 0
),
slots AS (
  SELECT * FROM (
    SELECT src, need, i AS slot, row_number() OVER (PARTITION BY src ORDER BY i) - 1 AS k,
           floor((point - lo)::DOUBLE / (hi - lo)::DOUBLE * ((source_size + block - 1) // block)::DOUBLE)::BIGINT * block AS begin
    FROM (SELECT i, (i * {STEP}) % 4294967296 AS point FROM range((SELECT 2 * max(blocks) FROM ranges)) t(i)) p
    JOIN ranges r ON p.point >= r.lo AND p.point < r.hi
  ) WHERE k < need
),
placed AS (
  SELECT s.doc_id, s.size, r.src, r.source_size, r.target, r.quota,
    coalesce(sum(s.size) OVER (PARTITION BY r.src ORDER BY md5('mix:' || coalesce(s.doc_id::VARCHAR, '')), s.doc_id, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first
  FROM sizes s JOIN goal r ON s.source IS NOT DISTINCT FROM r.source
),
spans AS (
  SELECT p.*, row_number() OVER () AS rid, greatest(0, first + t * source_size - coalesce(begin, 0)) AS a, least(first + t * source_size - coalesce(begin, 0) + size, quota) AS b
  FROM (SELECT p.*, s.begin, row_number() OVER () AS id FROM placed p LEFT JOIN slots s ON s.src = p.src AND s.k = 0) p, range({MOST_TIMES + 1}) t(t)
),
handed AS (
  SELECT sp.id, sum(least(b, (k + 1) * block) - greatest(a, k * block)) AS taken, min(slot) AS first_slot
  FROM spans sp JOIN plan ON true JOIN slots s ON s.src = sp.src AND k * block < b AND (k + 1) * block > a WHERE b > a GROUP BY sp.id
)
SELECT doc_id, size, source_size, target, coalesce(max(taken), 0)::BIGINT AS taken, max(first_slot)::BIGINT AS first_slot
FROM spans LEFT JOIN handed USING (id) GROUP BY id, doc_id, size, source_size, target
"""
