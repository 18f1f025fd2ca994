"""MinHash near-duplicates: fast similarity sketching, banding, exact verification.

A document's set holds its distinct word shingles. Its sketch has ``BANDS * ROWS``
coordinates: in round i each shingle falls into one hashed bin with a value between i
and i + 1, and a bin keeps its least value; after as many rounds as bins, round t + j
puts every shingle into bin j, so that every coordinate is filled. Documents that agree
on all rows of a band share a bucket. Texts of the same words are one representative
throughout, told by 128 bits of BLAKE2b of the words.

Links within buckets are found without all pairs: every member first meets the least of
its buckets' least members, then those of them that connected components still keep
apart. Members of one bucket that are then still in different components meet only if
they share enough of what tells them from the bucket's least member. All candidate pairs
are verified on their full sets, word by word: a text and those to be held against it stream through a
task side by side, at most some ``RUN`` of them, so that no group of copies lands in one
task. Components come from hooking to the least neighbour and contraction.

Defined results: a null or empty text has an empty set and is linked with nothing; rows
that share a doc_id are one node, whatever their texts; a row without doc_id has no
component and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.closure import components, named_by
from ..session import saved_rows
from .common import saved, unpacked
from .textbytes import HASH_BITS, LOWER, U64, buffer_of, distinct, mix, normal_words, shingle_sets, shingles, slices, sums_by

BANDS, ROWS = 48, 7
SLOTS = BANDS * ROWS
#: Similarity in hundredths, and words in a shingle.
PERCENT, WIDTH = 80, 4
#: Candidate pairs whose ids are broadcast to pick their texts (8 bytes each); beyond it the texts are shuffled.
MOST_BROADCAST = 250_000
#: Texts that are held against one other in a task, about.
RUN = 250
#: Members of a group that meet its rows in one task, about.
MEET = 256

SKETCH_SCHEMA = "doc_id long, n_shingles long, words_hi long, words_lo long, bands array<long>"
_SEEDS = mix(np.arange(1, 2 * SLOTS + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
_EMPTY = U64(0xFFFFFFFFFFFFFFFF)


def sketches(keys: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """Sketch of each of n sets, given as sorted distinct ``keyed`` hashes; all ones for an empty set."""
    doc, h = (keys >> U64(HASH_BITS)).astype(np.int64), keys & U64((1 << HASH_BITS) - 1)
    out = np.full(n * slots, _EMPTY, np.uint64)
    table = out.reshape(n, slots)
    size = U64(slots)
    for i in range(slots):
        if not len(doc):
            return table
        x = mix(h ^ _SEEDS[i])
        place = (((x >> U64(32)) * size) >> U64(32)).astype(np.int64)
        np.minimum.at(out, doc * slots + place, (U64(i) << U64(32)) | (x & U64(0xFFFFFFFF)))
        having = np.unique(doc) if i else np.flatnonzero(np.bincount(doc, minlength=n))
        open_docs = having[(table[having] == _EMPTY).any(1)]
        if len(open_docs) < len(having):
            still = np.zeros(n, bool)
            still[open_docs] = True
            keep = still[doc]
            doc, h = doc[keep], h[keep]
    if len(doc):
        starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        owners = doc[starts]
        for j in range(slots):
            missing = table[owners, j] == _EMPTY
            if missing.any():
                least = np.minimum.reduceat(mix(h ^ _SEEDS[slots + j]) & U64(0xFFFFFFFF), starts)
                table[owners[missing], j] = ((U64(slots + j) << U64(32)) | least)[missing]
    return table


def band_hashes(table: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = table.reshape(len(table), bands, rows)
    acc = np.broadcast_to(np.arange(bands, dtype=np.uint64) * U64(0xC2B2AE3D27D4EB4F), (len(table), bands))
    for r in range(rows):
        acc = mix(acc * U64(0x9FB21C651E98DF25) + parts[:, :, r])
    return acc


def sketched(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row: set size, a 128-bit digest of the words, and bucket of each band."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffer_of(batch.column("text"))
            for i, j in slices(off):
                part, cut = LOWER[data[off[i] : off[j]]], off[i : j + 1] - off[i]
                keys = shingle_sets(part, cut, width)
                n = j - i
                doc = (keys >> U64(HASH_BITS)).astype(np.int64)
                many = sums_by(doc, n)
                table = sketches(keys, n)
                plain, upto = normal_words(part, cut)
                raw, upto = plain.tobytes(), upto.tolist()
                digests = b"".join(blake2b(raw[p:q], digest_size=16).digest() for p, q in zip(upto, upto[1:], strict=False))
                whole = np.frombuffer(digests, np.int64).reshape(-1, 2)
                ends = np.concatenate(([0], np.cumsum(np.where(many > 0, BANDS, 0)))).astype(np.int32)
                filled = many > 0
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id").slice(i, n),
                        "n_shingles": pa.array(many),
                        "words_hi": pa.array(whole[:, 0]),
                        "words_lo": pa.array(whole[:, 1]),
                        "bands": pa.ListArray.from_arrays(pa.array(ends), pa.array(band_hashes(table[filled]).reshape(-1).view(np.int64))),
                    }
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(read, SKETCH_SCHEMA)


def _beside(pairs: DataFrame, n_pairs: int, docs: DataFrame) -> DataFrame:
    """Texts of the pairs (a, b), sorted within partitions: one row for a (role 0), then a row for each b (role 1).

    The b's of one a are dealt into ``part``s of about ``RUN``; the text of a goes to each.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / RUN).alias("parts"))
    members = named_by(pairs, "a", sizes, "b")
    part = F.pmod(F.xxhash64("b"), "parts")
    member_ids = members.select(F.col("b").alias("doc_id"), "a", part.alias("part"), F.lit(1).alias("role"))
    heads = sizes.select(F.col("a").alias("doc_id"), "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    wanted = heads.withColumn("role", F.lit(0)).union(member_ids)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    if n_pairs <= MOST_BROADCAST:  # few enough ids: the other texts needn't move
        ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        texts = texts.join(F.broadcast(ids), "doc_id", "left_semi")
    # Rows that repeat an id and its text collapse before they are joined.
    texts = texts.dropDuplicates(["doc_id", "text"])
    joined = texts.join(wanted.hint("merge"), "doc_id").select("a", "part", "role", F.col("doc_id").alias("b"), "text")
    return joined.repartition("a", "part").sortWithinPartitions("a", "part", "role", "b", "text")


def _streamed(beside: DataFrame, compare, schema: str) -> DataFrame:
    """``compare(a, texts of a, b's, their bytes, offsets)`` for every run of ``_beside`` rows, lower-cased."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heads = None, []
        for batch in batches:
            data, off = buffer_of(batch.column("text"))
            a, part, role, b = (batch.column(x).to_numpy() for x in ("a", "part", "role", "b"))
            for i, j in slices(off):
                lower = LOWER[data[off[i] : off[j]]]
                edges = np.flatnonzero((a[i + 1 : j] != a[i : j - 1]) | (part[i + 1 : j] != part[i : j - 1]) | (role[i + 1 : j] != role[i : j - 1])) + 1
                for p, q in zip([0, *edges.tolist()], [*edges.tolist(), j - i], strict=True):
                    if key != (a[i + p], part[i + p]):
                        key, heads = (a[i + p], part[i + p]), []
                    cut = off[i + p : i + q + 1] - off[i]
                    if role[i + p] == 0:
                        heads += [lower[x:y] for x, y in zip(cut, cut[1:], strict=False)]
                    elif heads:
                        yield compare(key[0], heads, b[i + p : i + q], lower[cut[0] : cut[-1]], cut - cut[0])

    return beside.mapInArrow(read, schema)


def _with_head(head: np.ndarray, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with ``head`` in front as number 0."""
    return np.concatenate((head, data)), np.concatenate(([0], off + len(head)))


def overlaps(head: np.ndarray, data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, int, np.ndarray]:
    """Set size of each text, of ``head``, and the shingles that both have, by their words."""
    doc, shingle = shingles(*_with_head(head, data, off), width)
    if not len(doc):
        return np.zeros(len(off) - 1, np.int64), 0, np.zeros(len(off) - 1, np.int64)
    most = int(shingle.max()) + 1
    pairs = distinct(doc * most + shingle)
    doc, shingle = pairs // most, pairs % most
    held = np.zeros(most, bool)
    held[shingle[doc == 0]] = True
    size, shared = sums_by(doc, len(off)), sums_by(doc[held[shingle]], len(off))
    return size[1:], int(size[0]), shared[1:]


def _verified(pairs: DataFrame, n_pairs: int, docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, int]:
    """The pairs whose full sets are similar enough, and their number."""

    def confirm(a, heads, b, data, off) -> pa.RecordBatch:
        good = np.zeros(len(b), bool)
        for head in heads:
            size, own, shared = overlaps(head, data, off, width)
            both = size + own - shared
            good |= (100 * shared >= percent * both) & (both > 0)
        return pa.record_batch({"a": pa.array(np.full(good.sum(), a)), "b": pa.array(b[good])})

    return saved_rows(_streamed(_beside(pairs, n_pairs, docs), confirm, "a long, b long").distinct())


def _differences(stars: DataFrame, n_stars: int, docs: DataFrame, width: int) -> DataFrame:
    """(c, x, v, n, diff): size of each set v of x, and the shingles that only one of the centre c and x has."""

    def compare(a, heads, b, data, off) -> pa.RecordBatch:
        # any one text of the centre serves as the origin, if it is the same for all
        keys = shingle_sets(*_with_head(heads[0], data, off), width)
        doc, h = (keys >> U64(HASH_BITS)).astype(np.int64), keys & U64((1 << HASH_BITS) - 1)
        upto = np.searchsorted(doc, np.arange(len(off) + 1))
        head, *sets = [h[upto[k] : upto[k + 1]] for k in range(len(off))]
        diff = [np.setxor1d(head, x, assume_unique=True) for x in sets]
        ends = np.cumsum([0, *map(len, diff)]).astype(np.int32)
        return pa.record_batch(
            {
                "c": pa.array(np.full(len(b), a)),
                "x": pa.array(b),
                "v": pa.array([int(mix(x).sum(dtype=np.uint64).view(np.int64)) if len(x) else 0 for x in sets], pa.int64()),
                "n": pa.array(np.diff(upto)[1:].astype(np.int64)),
                "diff": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(diff).view(np.int64))),
            }
        )

    pairs = stars.select(F.col("c").alias("a"), F.col("x").alias("b"))
    return saved(_streamed(_beside(pairs, n_stars, docs), compare, "c long, x long, v long, n long, diff array<long>"))


def _pairs_around(stars: DataFrame, n_stars: int, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of members (c, x, component) of the same centre c, of different components, that may be similar.

    With D the shingles by which a member differs from the centre, and sizes n, two members
    are similar just if their D share at least ((u D_x - v n_x) + (u D_y - v n_y)) / 2u shingles,
    where u = 100 + percent and v = 100 - percent; that is one at least unless both are similar to
    the centre, which has linked them. So the members' differences are joined on prefixes of
    their rarest shingles, with positions bounding the overlap: members that differ from the
    centre each in its own way never meet. Rows of a hot centre or shingle are dealt by member.
    """
    u, v = 100 + percent, 100 - percent
    diff = _differences(stars, n_stars, docs, width)
    heads = diff.select("c", "x", "v", F.size("diff").alias("d"), (u * F.size("diff") - v * F.col("n")).alias("w"))
    heads = heads.join(stars.hint("merge"), ["c", "x"])
    heads = named_by(heads, "c", heads.groupBy("c").agg(F.min("w").alias("least_w")), "x")
    shared = F.greatest(F.lit(1), F.ceil((F.col("w") + F.col("least_w")) / (2 * u)))
    heads = heads.withColumn("keep", F.col("d") - shared + 1)
    # How often each shingle tells a member from the centre: counted per salt, then over the salts.
    items = diff.select("c", "x", "v", F.explode("diff").alias("e"), F.pmod(F.xxhash64("x"), F.lit(32)).alias("salt"))
    some = items.groupBy("c", "e", "salt").agg(F.count("*").alias("many"))
    often = some.groupBy("c", "e").agg(F.sum("many").alias("often"), F.collect_set("salt").alias("salts")).where("often > 1")
    counted = items.join(often.select("c", "e", "often", F.explode("salts").alias("salt")).hint("merge"), ["c", "e", "salt"])
    place = F.row_number().over(Window.partitionBy("c", "x", "v").orderBy(F.col("often").desc(), F.col("e").desc()))  # within one set
    # The prefix counts all shingles of the difference; those that no other member has stand first and meet none.
    ranked = counted.withColumn("from_end", place).join(heads.hint("merge"), ["c", "x", "v"]).withColumn("i", F.col("d") - F.col("from_end") + 1)
    prefix = ranked.where("i <= keep").withColumn("parts", F.least(F.ceil(F.col("often") / MEET), F.lit(1024)))
    left = prefix.select("c", "e", F.pmod(F.xxhash64("x"), "parts").alias("part"), *(F.col(k).alias(f"{k}a") for k in ("x", "i", "d", "w", "component")))
    right = prefix.select(
        "c", "e", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), *(F.col(k).alias(f"{k}b") for k in ("x", "i", "d", "w", "component"))
    )
    enough = f"{2 * u} * (1 + least(da - ia, db - ib)) >= wa + wb"
    met = left.join(right.hint("merge"), ["c", "e", "part"]).where(f"xa < xb and componenta <> componentb and {enough}")
    return met.select(F.col("xa").alias("a"), F.col("xb").alias("b")).distinct()


def _joined(label: DataFrame, found: DataFrame) -> DataFrame:
    """``label`` (node, component) after more links (a, b): the components of its components."""
    ends = _labelled(_labelled(found, "a", label, "b"), "b", label, "a")
    merged = components(ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))).toDF("component", "top")
    old = named_by(label, "component", merged, "node", "left").select("node", F.coalesce("top", "component").alias("component"))
    new = merged.toDF("node", "component").join(label.select("node").hint("merge"), "node", "left_anti")
    return saved(old.union(new))


def _labelled(rows: DataFrame, x: str, label: DataFrame, by: str) -> DataFrame:
    """``rows`` with ``of_x``: the component of the node in column x, null for one without a link."""
    return named_by(rows, x, label.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")), by, "left")


def links(docs: DataFrame, reps: DataFrame, owned: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(node, component) of the sets with a link, by their least doc_id ``rep``; ``owned`` tells the sets of each doc_id."""
    if percent < PERCENT:
        raise ValueError(f"the bands are set for similarities of {PERCENT} percent or more")
    members = reps.select("rep", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select("bucket", "least")
    shared = saved(members.join(buckets.hint("merge"), "bucket").where("rep <> least"))
    first, n_first = saved_rows(shared.groupBy(F.col("rep").alias("b")).agg(F.min("least").alias("a")).select("a", "b"))
    # An id that stands in several sets links them.
    others = owned.where("rep <> doc_id").groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    own = others.join(reps.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    same_id = others.where("lo < hi").select(F.col("lo").alias("a"), F.col("hi").alias("b")).union(own.select("lo", "doc_id"))
    found, _ = _verified(first, n_first, docs, width, percent)
    label = components(found.union(same_id))
    # A member's other centres matter only where its component differs from theirs.
    stars = shared.select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
    apart = _labelled(_labelled(stars, "a", label, "b"), "b", label, "a").where("coalesce(of_a, a) <> coalesce(of_b, b)").select("a", "b")
    apart, n_apart = saved_rows(apart.join(first.hint("merge"), ["a", "b"], "left_anti"))
    if n_apart:
        found, n_found = _verified(apart, n_apart, docs, width, percent)
        label = _joined(label, found) if n_found else label
    labelled = _labelled(shared, "rep", label, "bucket").select("bucket", "rep", "least", F.coalesce("of_rep", "rep").alias("component"))
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    around = named_by(labelled, "bucket", mixed, "rep").select(F.col("least").alias("c"), F.col("rep").alias("x"), "component").distinct()
    around, n_around = saved_rows(around)
    if n_around:
        met, n_met = saved_rows(_pairs_around(around, n_around, docs, width, percent))
        if n_met:
            found, n_found = _verified(met, n_met, docs, width, percent)
            label = _joined(label, found) if n_found else label
    return label


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: set size, component and whether it is its component's least document."""
    rows = saved(sketched(docs, width))
    same_words = ["words_hi", "words_lo", "n_shingles"]
    named = rows.where("doc_id is not null and n_shingles > 0")
    reps = saved(named.groupBy(*same_words).agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands")))
    owned = saved(named_by(rows.drop("bands"), same_words, reps.drop("bands"), "doc_id", "left").select("doc_id", "n_shingles", "rep"))
    label = links(docs, reps, owned.where("doc_id is not null and rep is not null"), width, percent)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of_rep", "rep", "doc_id"))
    return _labelled(owned, "rep", label, "doc_id").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def deduplicated(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One document of each component, the one with the least doc_id, with its own columns.

    Of rows that share that doc_id one stays, the one with the least text; rows without doc_id stay.
    """
    rows = near_duplicates(docs, width, percent).where("doc_id is not null")
    verdict = saved(rows.groupBy("doc_id").agg(F.bool_and("kept").alias("_kept"), F.count("*").alias("_rows")).where("not _kept or _rows > 1"))
    own, flagged = F.struct(*(docs[f"`{c}`"].alias(c) for c in docs.columns)).alias("row"), verdict.select(F.col("doc_id").alias("id"), "_kept")
    carried = docs.select(own, docs["doc_id"].cast("long").alias("id"))
    once = carried.join(flagged, "id", "left_anti")
    again = carried.join(flagged.where("_kept"), "id").groupBy("id").agg(F.min_by("row", F.struct("row.text")).alias("row")).select("id", "row")
    return once.union(again).select(*unpacked(docs))


#: The registered query in SQL: shingles joined with themselves, links, and the least node reached.
ORACLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+'), []) AS w FROM documents
),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[p + 1 : p + {WIDTH}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - {WIDTH - 1}, 1))) AS p FROM d WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM met JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= {PERCENT} * (a.n + b.n - c)),
way AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reached AS (SELECT doc_id AS node, doc_id AS low FROM d UNION SELECT way.y, low FROM reached JOIN way ON way.x = node WHERE low < way.y),
least AS (SELECT node, min(low) AS component_id FROM reached GROUP BY node)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN sizes USING (doc_id) JOIN least ON node = doc_id
"""
