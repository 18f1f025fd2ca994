"""Benchmark decontamination by a prefix-filtered set join. DataFrame functions only.

An item's windows are 13 consecutive words (or all words of a shorter item); equal windows
of all items are one. A window's shingles are ordered by rarity among all windows (longer
shingles first where they are alike); as a window must be contained whole, its first shingle in
that order is a sufficient prefix. Only these shingles, one a window, are joined with the
shingles of the texts, in one pass over them. Length and position bounds drop windows that
would stick out of the document, and the rest is verified word by word. Items are looked up for
windows that occur.

Defined results: a null text has no words; a null item text has no windows; rows that
share id and text are judged alike; null ids are ids of their own texts; an empty benchmark
leaves every document clean; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.closure import named_by
from ..session import saved_rows
from .common import packed, saved, unpacked

#: Words of lower-cased text.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
SHINGLE = 3
#: A document with 1 / 20 of its words hit is contaminated.
SHARE = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of the windows' shingles that are broadcast at most (40 a window), and documents whose ids are; beyond it the join is a salted shuffle.
MOST_BYTES, MOST_DOCS = 32 << 20, 250_000


def words(text: str) -> Column:
    found = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(WORDS), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def _shingles(of: str, width: int) -> Column:
    """Hashes of ``width`` consecutive words, in order."""
    at = lambda i: F.xxhash64(*(F.get(F.col(of), i + j) for j in range(width)))
    return F.when(F.size(of) >= width, F.transform(F.sequence(F.lit(0), F.size(of) - width), at))


def _met(rows: DataFrame, keys: list[str], table: DataFrame, n_bytes: int) -> DataFrame:
    return rows.join(F.broadcast(table), keys) if n_bytes <= MOST_BYTES else named_by(rows, keys, table, "pos")


def _key(docs: DataFrame) -> Column:
    """What tells texts apart, as one value that is never null."""
    return F.struct(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("hash")).alias("key")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(win, len, width, items): the different windows, the words in their shingles, and the items that hold them."""
    items = benchmark.select("item_id", words("text").alias("words")).withColumn("n", F.size("words")).where("n > 0")
    length = F.least("n", F.lit(window))
    slices = F.transform(F.sequence(F.lit(0), F.col("n") - length), lambda p: F.slice("words", p + 1, length))
    found = items.select("item_id", F.explode(slices).alias("win")).groupBy("win").agg(F.collect_set("item_id").alias("items"))
    return found.select("win", F.size("win").alias("len"), F.least(F.size("win"), F.lit(SHINGLE)).alias("width"), "items")


def _shingles_of(column: str, widths: list[int]) -> Column:
    """(width, h, place) of all shingles of the wanted widths."""
    entry = lambda k: lambda h, i: F.struct(F.lit(k).alias("width"), h.alias("h"), i.alias("place"))
    by_width = [F.transform(_shingles(column, k), entry(k)) for k in widths]
    return F.explode(F.flatten(F.filter(F.array(*by_width), lambda x: x.isNotNull())))


def hits(docs: DataFrame, windows: DataFrame) -> DataFrame | None:
    """(key, n_words, found: array of (start, win)) of the texts with an occurring window; None without windows."""
    widths = sorted(r[0] for r in windows.select("width").distinct().collect())  # three rows at most
    if not widths:
        return None
    own_width = lambda x: x.where("shingle.width = width")
    shingles = own_width(windows.select("win", "len", "width", _shingles_of("win", widths).alias("shingle")))
    shingles = saved(shingles.select("win", "len", "width", "shingle.h", F.col("shingle.place").alias("j")))
    rarity = shingles.groupBy("width", "h").agg(F.count("*").alias("often"))
    length = F.octet_length(F.array_join(F.slice("win", F.col("j") + 1, F.col("width")), ""))
    order = F.struct("often", (-length).alias("length"), "h", "j")
    prefix = shingles.join(rarity.hint("merge"), ["width", "h"]).groupBy("win", "len", "width").agg(F.min(order).alias("first"))
    prefix, n_prefix = saved_rows(prefix.select("width", "first.h", "first.j", "len", F.xxhash64("win").alias("of")))
    split = docs.select(_key(docs), words("text").alias("words"))
    places = split.select("key", F.size("words").alias("n_words"), _shingles_of("words", widths).alias("at"))
    places = places.select("key", "n_words", "at.width", "at.h", F.col("at.place").alias("pos"))
    candidates = _met(places, ["width", "h"], prefix, 40 * n_prefix).withColumn("start", F.col("pos") - F.col("j"))
    candidates = candidates.where("start >= 0 and start + len <= n_words").select("key", "start", "of")
    candidates = named_by(candidates, "of", windows.select(F.xxhash64("win").alias("of"), "win"), "key")
    tries, n_docs = saved_rows(candidates.groupBy("key").agg(F.collect_set(F.struct("start", "win")).alias("tries")))
    texts = docs.select(_key(docs), "text")
    if n_docs <= MOST_DOCS:  # few enough documents: the other texts needn't move
        texts = texts.join(F.broadcast(tries.select("key")), "key", "left_semi")
    exact = lambda w: F.filter("tries", lambda t: F.slice(w, t["start"] + 1, F.size(t["win"])) == t["win"])
    tried = texts.dropDuplicates(["key"]).join(tries.hint("merge"), "key")
    # The words are bound to a lambda's variable: inlined, they would be split again for every window.
    both = F.transform(F.array(words("text")), lambda w: F.struct(F.size(w).alias("n_words"), exact(w).alias("found")))
    return tried.select("key", F.element_at(both, 1).alias("x")).select("key", "x.n_words", "x.found").where(F.size("found") > 0)


def _n_hit(found: Column) -> Column:
    return F.size(F.array_distinct(F.flatten(F.transform(found, lambda x: F.sequence(x["start"], x["start"] + F.size(x["win"]) - 1)))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: words, hit words, items found and the verdict."""
    windows = saved(item_windows(benchmark, window))
    found = hits(docs, windows)
    upper = WORDS.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")  # the same words before lower-casing
    counted = docs.select(_key(docs), F.coalesce(F.regexp_count("text", F.lit(upper)), F.lit(0)).alias("n_words"))
    if found is None:
        counted = counted.withColumns({"hit": F.lit(0), "ids": F.array().cast("array<string>")})
    else:
        found = saved(found.select("key", _n_hit(F.col("found")).alias("hit"), F.array_distinct("found.win").alias("wins")))
        # A passage that a third of the documents hold is dealt by document.
        items = named_by(found.select("key", F.explode("wins").alias("win")), "win", windows.select("win", "items"), "key")
        items = items.select("key", F.explode("items").alias("item_id")).groupBy("key").agg(F.collect_set("item_id").alias("items"))
        ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
        items = found.select("key", "hit").join(items.hint("merge"), "key", "left").select("key", "hit", ids.alias("ids"))
        counted = counted.join(items.hint("merge"), "key", "left")
    n_hit = F.coalesce("hit", F.lit(0))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return counted.select(
        "key.doc_id",
        F.col("n_words").cast("long"),
        n_hit.cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * SHARE >= F.col("n_words"))).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    found = hits(docs, saved(item_windows(benchmark, window)))
    if found is None:
        return docs
    dirty, n_dirty = saved_rows(found.where(_n_hit(F.col("found")) * SHARE >= F.col("n_words")).select("key"))
    dirty = F.broadcast(dirty) if n_dirty <= MOST_DOCS else dirty.hint("merge")
    return packed(docs, _key(docs)).join(dirty, "key", "left_anti").select(*unpacked(docs))


_SPLIT = "regexp_extract_all(translate({t}, '" + UPPER + "', '" + LOWER + "'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_SPLIT.format(t="text")}, []) AS w FROM documents),
b AS (SELECT item_id, coalesce({_SPLIT.format(t="text")}, []) AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[p + 1 : p + least(len(w), {WINDOW})], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(len(w) - least(len(w), {WINDOW}) + 1)) AS p FROM b WHERE len(w) > 0)
),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, n, p, array_to_string(w[p + 1 : p + n], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS p FROM d, lens WHERE len(w) >= n)
),
occ AS (SELECT DISTINCT dw.doc_id, dw.p, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS k FROM occ) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS joined
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM occ) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256,
       (coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(d.w)) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
