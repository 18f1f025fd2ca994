"""Repeated 100-byte strings, found with suffix arrays and adjacent common prefixes.

Every 100-byte window is keyed by the least hash of the 24-byte strings in it, so equal
windows have equal keys wherever they stand. Consecutive windows with one key form a
piece (about 140 bytes). Pieces are pre-aggregated: within each batch of rows by comparing
their bytes, and by key after the shuffle through 128-bit BLAKE2b digests of their bytes; only
the earliest of equal pieces goes on, the others repeat it whole. Keys left with two or more
different pieces get suffix arrays: the bytes of their pieces are sorted in two stages
(suffixes smaller than their successors directly, the others induced from them by a scan of
the buckets), and windows whose adjacent common prefix reaches 100 bytes are equal; all but
the earliest are removed.

A key under which very many different pieces meet is dealt out again by single windows, which
are pre-aggregated by their bytes within each batch, then within salts of their hash, and meet
in one task only as one row a salt.

Order of documents: by doc_id, a missing one last; rows that share an id by the hash of
their text. Rows that share id and text are one document and get equal results. A null
text is empty; texts below 100 bytes are never cut; matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textbytes import U64, buffer_of, gram_hashes, mix, slices, span_hashes

LENGTH = 100
GRAM = 24
SPAN = LENGTH - GRAM + 1
#: Bytes of pieces that one suffix array takes together; a key's pieces stay together.
BUFFER = 1 << 20
LAST = (1 << 63) - 1

#: Different pieces under one key that are searched together; a key with more is dealt out by its windows.
MOST_PIECES = 20_000
#: Parts over which the equal windows of a crowded key are dealt before they meet.
SALTS = 64

PIECE_SCHEMA = "again boolean, loops boolean, key long, piece long, rest long, doc long, tie long, start long, len long"
FETCH_SCHEMA = "key long, salt long, doc long, tie long, start long, len long, body binary"


def window_keys(grams: np.ndarray) -> np.ndarray:
    """Least gram hash of the window at each place, from the hash of each gram."""
    n = len(grams) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.full(-(-len(grams) // SPAN) * SPAN, U64(0xFFFFFFFFFFFFFFFF))
    padded[: len(grams)] = grams
    blocks = padded.reshape(-1, SPAN)
    fore = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], fore[SPAN - 1 : SPAN - 1 + n])


def pieces_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document, start, length, key, content hash and ``loops`` of each run of windows with one key.

    Two windows of one piece can only be equal if its least gram occurs again after the
    first of them has passed it; ``loops`` tells that.
    """
    grams = gram_hashes(data, GRAM)
    keys = window_keys(grams)
    size = np.diff(off)
    fits = np.maximum(size - LENGTH + 1, 0)
    doc = np.repeat(np.arange(len(size)), fits)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(fits) - fits, fits) + off[:-1][doc]
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    key = keys[at]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    start, end = at[first], at[last] + LENGTH
    passed = grams[at] == key
    passed[last] = False
    loops = np.logical_or.reduceat(passed, first)
    return doc[first], start - off[:-1][doc[first]], end - start, key[first], span_hashes(data, start, end), loops


def _pieces(docs: DataFrame) -> DataFrame:
    """Pieces of all documents. ``again``: an equal piece stands earlier in the same batch of rows.

    Such pieces are settled; they get a key of their own, so that a piece which many
    documents share doesn't fill one partition.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffer_of(batch.column("text"))
            ids, ties = batch.column("doc").to_numpy(), batch.column("tie").to_numpy()
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            for i, j in slices(off, most_bytes=1 << 20, most_docs=1 << 30):
                doc, start, length, key, content, loops = pieces_of(data[off[i] : off[j]], off[i : j + 1] - off[i])
                for col, x in zip(cols, (loops, key, content, doc + i, start, length), strict=True):
                    col.append(x)
            if not any(map(len, cols[0])):
                continue
            loops, key, content, row, start, length = map(np.concatenate, cols)
            doc, tie = ids[row], ties[row]
            begin = off[:-1][row] + start
            again = later_equals(content ^ key, doc, tie, start, data, begin, length)
            digest = digests(data, begin, np.where(again, 0, length))
            own = mix(doc.astype(np.uint64) ^ mix(tie.astype(np.uint64) + start.astype(np.uint64)))
            key = np.where(again, own, key)
            columns = (again, loops, key.view(np.int64), digest[:, 0], digest[:, 1], doc, tie, start, length)
            yield pa.record_batch(dict(zip(("again", "loops", "key", "piece", "rest", "doc", "tie", "start", "len"), map(pa.array, columns), strict=True)))

    return docs.mapInArrow(cut, PIECE_SCHEMA)


def digests(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """128 bits of BLAKE2b of each span, as two numbers."""
    raw = data.tobytes()
    found = [hashlib.blake2b(raw[p:q], digest_size=16).digest() for p, q in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
    return np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)


def later_equals(content, doc, tie, start, data, begin, length) -> np.ndarray:
    """Which of the strings have an equal, by hash and by bytes, at the earliest place of their hash among them."""
    out = np.zeros(len(content), bool)
    if len(content) < 2:
        return out
    order = np.argsort(content, kind="stable")
    equal = content[order][1:] == content[order][:-1]
    many = order[np.concatenate(([False], equal)) | np.concatenate((equal, [False]))]
    order = many[np.lexsort((start[many], tie[many], doc[many], content[many]))]
    if len(order) > 1:
        same = content[order][1:] == content[order][:-1]
        # behind the first place of its run: rows that stand twice share that place
        run = np.cumsum(np.concatenate(([True], ~same)))
        first = order[np.flatnonzero(np.concatenate(([True], ~same)))][run - 1]
        later = (doc[first] != doc[order]) | (tie[first] != tie[order]) | (start[first] != start[order])
        raw = data.tobytes()
        places = zip(begin[first[later]].tolist(), begin[order[later]].tolist(), length[first[later]].tolist(), length[order[later]].tolist(), strict=True)
        out[order[later]] = [m == n and raw[p : p + n] == raw[q : q + n] for p, q, m, n in places]
    return out


def _fetched(todo: DataFrame, docs: DataFrame) -> DataFrame:
    """Bytes of the wanted pieces (by key), and the merged spans of those known to repeat (no body)."""
    wanted = todo.groupBy("doc", "tie").agg(F.collect_list(F.struct("whole", "crowded", "key", "start", "len")).alias("parts"))
    # All columns of the documents stay, so that their exchange serves the last join as well.
    joined = docs.join(wanted, ["doc", "tie"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffer_of(batch.column("text"))
            raw = data.tobytes()
            lists = batch.column("parts")
            flat = lists.flatten()
            sizes = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes)), sizes)
            whole = flat.field("whole").to_numpy(zero_copy_only=False)
            start, length, key = (flat.field(x).to_numpy() for x in ("start", "len", "key"))
            ids, ties = batch.column("doc").to_numpy(), batch.column("tie").to_numpy()
            crowded = flat.field("crowded").to_numpy(zero_copy_only=False) & ~whole
            salt = np.zeros(len(row), np.int64)
            if crowded.any():
                row, start, length, key, whole, salt = dealt(data, off, ids, ties, row, start, length, key, whole, crowded)
            begin = off[:-1][row] + start
            bodies = [raw[b : b + n] for b, n in zip(begin[~whole].tolist(), length[~whole].tolist(), strict=True)]
            r, s, e = merged(row[whole], start[whole], start[whole] + length[whole])
            owner = np.concatenate((row[~whole], r))
            yield pa.record_batch(
                {
                    "key": pa.array(np.concatenate((key[~whole], mix((ids[r] ^ ties[r]).view(np.uint64)).view(np.int64)))),
                    "salt": pa.array(np.concatenate((salt[~whole], np.zeros(len(r), np.int64)))),
                    "doc": pa.array(ids[owner]),
                    "tie": pa.array(ties[owner]),
                    "start": pa.array(np.concatenate((start[~whole], s))),
                    "len": pa.array(np.concatenate((length[~whole], e - s))),
                    "body": pa.array(bodies + [None] * len(r), pa.binary()),
                }
            )

    return joined.mapInArrow(fetch, FETCH_SCHEMA)


def dealt(data, off, ids, ties, row, start, length, key, whole, crowded) -> tuple[np.ndarray, ...]:
    """Parts in which the pieces of crowded keys are replaced by their windows, each under a key of its own and salted.

    Of equal windows in the batch only the earliest is searched for, the others are known to repeat.
    """
    kept = ~crowded
    many = length[crowded] - LENGTH + 1
    r = np.repeat(row[crowded], many)
    s = np.repeat(start[crowded], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    owners = np.unique(r)
    sizes = off[owners + 1] - off[owners]
    base = np.zeros(len(off) - 1, np.int64)
    base[owners] = np.cumsum(sizes) - sizes
    text = np.concatenate([data[off[k] : off[k + 1]] for k in owners.tolist()])
    h = span_hashes(text, base[r] + s, base[r] + s + LENGTH)
    wide = np.full(len(r), LENGTH)
    again = later_equals(h, ids[r], ties[r], s, text, base[r] + s, wide)
    salt = 1 + (mix(ids[r].astype(np.uint64) ^ ties[r].astype(np.uint64)) % U64(SALTS)).astype(np.int64)
    return (
        np.concatenate((row[kept], r)), np.concatenate((start[kept], s)), np.concatenate((length[kept], wide)),
        np.concatenate((key[kept], mix(h).view(np.int64))), np.concatenate((whole[kept], again)), np.concatenate((np.zeros(kept.sum(), np.int64), salt)),
    )


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the spans of each row: spans that overlap or touch become one."""
    if not len(row):
        return row, start, end
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    base = (row - row[0]).astype(np.int64) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(base + end)
    new = np.concatenate(([True], base[1:] + start[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    return row[first], start[first], reach[last] - base[last]


def _direct(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes ``at`` sorted by their first ``depth`` bytes; only ties go deeper."""
    order = at[np.argsort(words[at], kind="stable")]
    key = words[order]
    group = np.cumsum(np.concatenate(([0], key[1:] != key[:-1]))) if len(order) else np.zeros(0, int)
    for d in range(8, depth, 8):
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        key = words[order[tied] + d]
        g = group[tied]
        turn = np.lexsort((key, g))
        order[tied] = order[tied][turn]
        key = key[turn]
        split = np.zeros(len(order), np.int64)
        split[tied[1:]] = (g[1:] == g[:-1]) & (key[1:] != key[:-1])
        group = np.cumsum(np.concatenate(([0], group[1:] != group[:-1])) + split)
    return order


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of a byte buffer in the order of their first ``depth`` bytes at least, in two stages."""
    n = len(text)
    t = text.astype(np.int16)
    after = np.append(t[1:], np.int16(-1))
    change = np.where(t != after, np.arange(n), n)
    change = np.minimum.accumulate(change[::-1])[::-1]
    rising = t[change] < after[change]  # smaller than its successor
    padded = np.concatenate((text, np.zeros(depth + 16, np.uint8)))
    words = np.zeros(len(padded) - 7, np.uint64)
    for j in range(8):
        words = (words << U64(8)) | padded[j : j + len(words)]
    direct = _direct(words, np.flatnonzero(rising), depth)
    bounds = np.searchsorted(t[direct], np.arange(257))
    falling: list[list[np.ndarray]] = [[] for _ in range(256)]
    falling[text[-1]].append(np.array([n - 1]))
    out = []

    def induce(scanned: np.ndarray, byte: int) -> np.ndarray:
        """Put the falling suffixes before the scanned ones into their buckets; those of this bucket come back."""
        p = scanned[scanned > 0] - 1
        p = p[~rising[p]]
        b = text[p]
        higher = p[b > byte]
        if len(higher):
            turn = np.argsort(text[higher], kind="stable")
            higher = higher[turn]
            ends = np.searchsorted(text[higher], np.arange(257))
            for c in np.unique(text[higher]).tolist():
                falling[c].append(higher[ends[c] : ends[c + 1]])
        return p[b == byte]

    for byte in range(256):
        wave = np.concatenate(falling[byte]) if falling[byte] else np.zeros(0, np.int64)
        while len(wave):
            out.append(wave)
            wave = induce(wave, byte)
        own = direct[bounds[byte] : bounds[byte + 1]]
        if len(own):
            out.append(own)
            induce(own, byte)
    return np.concatenate(out)


def equal_windows(text: np.ndarray, room: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places with ``length`` bytes of room, in suffix order, and whether each has the one before as its equal."""
    order = suffix_array(text, length + 4)
    order = order[room[order] >= length]
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        alike = np.ones(len(a), bool)  # adjacent common prefix, compared where it still holds
        for d in range(length):
            live = np.flatnonzero(alike)
            if not len(live):
                break
            alike[live] = text[a[live] + d] == text[b[live] + d]
        same[1:] = alike
    return order, same


def repeated_in(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, bodies: list[bytes]) -> tuple[np.ndarray, ...]:
    """(doc, tie, start, len) of the windows in the pieces that also start earlier."""
    size = np.array([len(x) for x in bodies])
    text = np.frombuffer(b"\x00".join(bodies) + b"\x00", np.uint8)
    first = np.cumsum(size + 1) - size - 1
    piece = np.repeat(np.arange(len(size)), size + 1)
    room = first[piece] + size[piece] - np.arange(len(text))
    order, same = equal_windows(text, room)
    if not same.any():
        none = np.zeros(0, np.int64)
        return none, none, none, none
    by_doc = np.lexsort((tie, doc))
    new = np.concatenate(([False], (doc[by_doc][1:] != doc[by_doc][:-1]) | (tie[by_doc][1:] != tie[by_doc][:-1])))
    rank = np.empty(len(doc), np.int64)
    rank[by_doc] = np.cumsum(new)
    p = piece[order]
    at = start[p] + order - first[p]
    place = rank[p] * (int(at.max()) + 1) + at
    heads = np.flatnonzero(~same)
    earliest = np.repeat(np.minimum.reduceat(place, heads), np.diff(np.append(heads, len(order))))
    later = place > earliest
    r, s, e = merged(rank[p][later], at[later], at[later] + LENGTH)
    head = by_doc[np.searchsorted(rank[by_doc], r)]
    return doc[head], tie[head], s, e - s


def earliest(table: pa.Table) -> np.ndarray:
    """Of the salted windows in a table, those that no equal one in it precedes."""
    first: dict[bytes, tuple] = {}
    rows = list(zip(*(table.column(x).to_pylist() for x in ("body", "doc", "tie", "start")), strict=True))
    for body, *place in rows:
        first[body] = min(first.get(body, tuple(place)), tuple(place))
    return np.array([first[body] == tuple(place) for body, *place in rows], bool)


def _spans(fetched: DataFrame, salted: bool) -> DataFrame:
    """Rows without a body: spans that repeat. With ``salted``, windows of crowded keys meet within their salts, the earliest goes on."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            cols = [rows.column(x).to_numpy() for x in ("doc", "tie", "start")]
            found = repeated_in(*cols, rows.column("body").to_pylist())
            nothing = {"key": found[0] ^ found[1], "salt": np.zeros(len(found[0]), np.int64)}
            spans = nothing | dict(zip(("doc", "tie", "start", "len"), found, strict=True))
            yield pa.record_batch({k: pa.array(v) for k, v in spans.items()} | {"body": pa.nulls(len(found[0]), pa.binary())})
            crowded = rows.filter(pa.compute.greater(rows.column("salt"), 0)) if salted else rows.slice(0, 0)
            if crowded.num_rows:
                yield from crowded.filter(pa.array(earliest(crowded))).to_batches()

        bytes_held = 0
        for batch in batches:
            known = batch.filter(pa.compute.is_null(batch.column("body")))
            if known.num_rows:
                yield known
            batch = batch.filter(pa.compute.is_valid(batch.column("body")))
            at = 0
            while at < batch.num_rows:
                key = batch.column("key").to_numpy()[at:]
                total = np.cumsum(batch.column("len").to_numpy()[at:])
                full = int(np.searchsorted(total, BUFFER - bytes_held))
                if full >= len(key):
                    held.append(batch.slice(at))
                    bytes_held += int(total[-1])
                    break
                # Cut where a key ends: behind the run that fills the buffer.
                end = full + 1
                while end < len(key) and key[end] == key[full]:
                    end += 1
                held.append(batch.slice(at, end))
                bytes_held += int(total[end - 1])
                at += end
                if at < batch.num_rows:
                    yield from done(pa.Table.from_batches(held))
                    held, bytes_held = [], 0
            if bytes_held > 2 * BUFFER:  # all but the last key, which the next batch may continue
                rows = pa.Table.from_batches(held)
                key = rows.column("key").to_numpy()
                cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
                if cut:
                    yield from done(rows.slice(0, cut))
                    held = rows.slice(cut).to_batches()
                    bytes_held = int(sum(x.column("len").to_numpy().sum() for x in held))
        if held:
            yield from done(pa.Table.from_batches(held))

    # A key's pieces meet in one task, in order of the key.
    keys = ["key", "salt"] if salted else ["key"]
    return fetched.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(search, FETCH_SCHEMA)


def removed_spans(docs: DataFrame) -> DataFrame:
    """(doc, tie, start, len) of bytes to remove; spans of one document may overlap."""
    found = _pieces(docs.select("doc", "tie", "text")).repartition("key")
    equal = Window.partitionBy("key", "piece", "rest", "len").orderBy("doc", "tie", "start")
    alike = Window.partitionBy("key")
    ranked = found.withColumns({"row": F.row_number().over(equal), "rank": F.rank().over(equal)})
    differ = lambda c: F.min(c).over(alike) != F.max(c).over(alike)
    ranked = ranked.withColumns({"several": differ("piece") | differ("rest"), "crowded": F.count_if(F.col("row") == 1).over(alike) > MOST_PIECES})
    # Rows that stand twice are one document: one of them is searched.
    todo = ranked.where("row = rank").withColumn("whole", F.col("again") | (F.col("rank") > 1)).where("whole or several or loops")
    parts = _fetched(todo.select("whole", "crowded", "key", "doc", "tie", "start", "len"), docs)
    return _spans(_spans(parts, salted=True), salted=False).select("doc", "tie", "start", "len")


def dedup(docs: DataFrame) -> DataFrame:
    """One row per document: bytes, removed bytes and runs, and the hash of what is left."""
    own = F.col("doc_id").cast("long")
    keyed = docs.select(own.alias("doc_id"), F.coalesce(own, F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("tie"), "text")
    parts = (
        removed_spans(keyed)
        .groupBy("doc", "tie")
        .agg(F.collect_list(F.struct("start", "len")).alias("spans"))  # at most the windows of one document
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffer_of(batch.column("text"))
            raw = data.tobytes()
            lists = batch.column("spans")
            sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy()
            flat = lists.flatten()
            row = np.repeat(np.arange(len(sizes)), sizes)
            start, length = (flat.field(x).to_numpy() for x in ("start", "len"))
            r, s, e = merged(row, start, start + length)
            runs = np.bincount(r, minlength=len(sizes)).astype(np.int64)
            gone = np.bincount(r, weights=e - s, minlength=len(sizes)).astype(np.int64)
            ends = np.cumsum(runs)
            hashes = []
            for k in range(len(sizes)):
                body = raw[off[k] : off[k + 1]]
                digest, at = hashlib.sha256(), 0
                for q in range(ends[k] - runs[k], ends[k]):
                    digest.update(body[at : s[q]])
                    at = e[q]
                digest.update(body[at:])
                hashes.append(digest.hexdigest())
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_bytes": pa.array(np.diff(off)),
                    "n_removed": pa.array(gone),
                    "n_spans": pa.array(runs),
                    "kept_sha256": pa.array(hashes, pa.string()),
                }
            )

    joined = keyed.join(parts, ["doc", "tie"], "left")
    return joined.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


#: The registered query in SQL: all windows as hexadecimal text, their first places, and the islands of later ones.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS h FROM documents),
win AS (
  SELECT doc_id, p, md5_number(substring(h, 2 * p + 1, {2 * LENGTH})) AS s
  FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - {LENGTH - 1})) AS p FROM d WHERE len(h) >= {2 * LENGTH})
),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS turn FROM win) WHERE turn > 1),
cut AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= {LENGTH} THEN 0 ELSE 1 END AS new FROM later),
runs AS (
  SELECT doc_id, run, min(p) AS a, max(p) + {LENGTH} AS b FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM cut) GROUP BY ALL
),
gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before, lead(a) OVER (PARTITION BY doc_id ORDER BY a) IS NULL AS last FROM runs
),
cuts AS (
  SELECT g.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans,
    string_agg(substring(h, 2 * before + 1, 2 * (a - before)) || CASE WHEN last THEN substring(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept
  FROM gaps g JOIN d USING (doc_id) GROUP BY g.doc_id
)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cuts USING (doc_id)
"""
