"""Token-ID output: tokenise, split overlong documents, pack best-fit-decreasing, write id matrices.

Documents are dealt into shards of bounded text by a hash of their id; each shard
is packed on its own, so nothing grows with the corpus but the number of shards. A
task streams through its shards in order; a shard that copies of one id blow up beyond
``MOST_TIMES`` its size is packed in several parts.
Within a shard, segments go longest first into the fullest row that still holds
them; a segment tree over remaining capacities finds that row in ``log(seq_len)``
steps. Documents longer than a row are cut into row-sized segments, none dropped.

One output row is one packed row of a shard's matrix:

* ``token_ids``: ``seq_len`` little-endian ids, padded with ``pad_id``,
* ``position_ids``: as many positions, starting again at 0 with each segment (0 in padding),
* ``cu_seqlens``: cumulative segment lengths, from 0 to ``n_tokens``,
* ``doc_ids`` and ``doc_starts``: the document and token offset of each segment.

Defined results: null and empty texts have no tokens and so no segment; a null
doc_id is packed under a null; repeated rows are packed as often as they occur;
an empty table gives no rows.
"""

from __future__ import annotations

import base64
import math
import os
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import buffer_of, numbered, slices

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The pre-token pattern that belongs to the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEQ_LEN = 2048
PAD_ID = 50256
#: Bytes of text in a shard on average: bounds what one task holds.
SHARD_BYTES = 8 << 20
#: Tasks over which the shards are dealt at most; each streams through its own.
MOST_TASKS = 20_000
#: Times the bytes of a shard that are packed together at most.
MOST_TIMES = 4
#: Distinct chunks whose ids a task remembers at once.
MOST_KNOWN = 200_000

SCHEMA = (
    "shard long, row long, n_tokens long, n_segments long, token_ids binary, position_ids binary, "
    "cu_seqlens array<int>, doc_ids array<long>, doc_starts array<long>"
)


@cache
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class ChunkEncoder:
    """Ids of many texts at once; each distinct chunk between safe cuts is encoded once and known by its bytes.

    A cut stands before a single space that follows a printable ASCII character, or
    follows a non-ASCII one and precedes a printable ASCII one. The pattern never
    joins two sides of such a place, so the ids are those of the whole text.
    """

    def __init__(self, path: str):
        self.encode = encoder(path).encode_ordinary
        self.known: dict[bytes, int] = {}
        self.clear()

    def clear(self) -> None:
        self.known.clear()
        # Ids of all known chunks one after another, and where each ends.
        self.flat, self.ends = array("H"), array("q", [0])

    def ids(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        if not len(data):
            return np.zeros(0, np.uint16), np.zeros(len(off) - 1, np.int64)
        if len(self.ends) > MOST_KNOWN:
            self.clear()
        before, after = np.roll(data, 1), np.roll(data, -1)
        shown, shown_after = (before > 0x20) & (before < 0x7F), (after > 0x20) & (after < 0x7F)
        cut = (data == 0x20) & (shown | (before >= 0x80) & shown_after)
        cut[off[:-1][off[:-1] < len(data)]] = True
        cut[0] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        inverse, first = numbered(data, start, end)
        raw = data.tobytes()
        number = np.empty(len(first), np.int64)
        known = self.known
        for k, (p, q) in enumerate(zip(start[first].tolist(), end[first].tolist(), strict=True)):
            chunk = raw[p:q]
            n = known.get(chunk)
            if n is None:
                n = known[chunk] = len(self.ends) - 1
                self.flat.extend(self.encode(chunk.decode("utf-8", "replace")))
                self.ends.append(len(self.flat))
            number[k] = n
        ends, flat = np.frombuffer(self.ends, np.int64), np.frombuffer(self.flat, np.uint16)
        begin, width = ends[number][inverse], (ends[number + 1] - ends[number])[inverse]
        total = np.cumsum(width)
        out = flat[np.repeat(begin - (total - width), width) + np.arange(total[-1])]
        owner = np.searchsorted(off, start, "right") - 1
        return out, np.bincount(owner, weights=width, minlength=len(off) - 1).astype(np.int64)


class Capacities:
    """Segment tree over remaining capacities 0..most; a leaf counts the rows with that capacity."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.tree = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def add(self, capacity: int, row: int) -> None:
        self.rows.setdefault(capacity, []).append(row)
        k = capacity + self.size
        while k:
            self.tree[k] += 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least capacity of at least ``need``, and that capacity; it leaves the tree."""
        tree, k = self.tree, need + self.size
        if not tree[k]:
            while k > 1 and not (k % 2 == 0 and tree[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if tree[2 * k] else 2 * k + 1
        capacity = k - self.size
        while k:
            tree[k] -= 1
            k >>= 1
        return self.rows[capacity].pop(), capacity


def best_fit_decreasing(lengths: list[int], seq_len: int) -> list[list[int]]:
    """Rows of segment numbers; every segment is at most ``seq_len`` long."""
    rows: list[list[int]] = []
    free = Capacities(seq_len)
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        found = free.take(lengths[k])
        row, capacity = found or (len(rows), seq_len)
        if found is None:
            rows.append([])
        rows[row].append(k)
        if capacity > lengths[k]:
            free.add(capacity - lengths[k], row)
    return rows


def shard_count(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> int:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, math.ceil(total / shard_bytes))


def pack(
    docs: DataFrame, seq_len: int = SEQ_LEN, pad_id: int = PAD_ID, tokenizers: str = TOKENIZERS, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Packed rows of all documents (see the module's description)."""
    path = f"{tokenizers}/{VOCABULARY}"
    shards = shard_count(docs, shard_bytes)

    def pack_part(shard: int, from_row: int, part: pa.Table, chunks: ChunkEncoder) -> pa.RecordBatch:
        data, off = buffer_of(part.column("text"))
        own = part.column("doc_id").to_pylist()
        parts, counts = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
        for i, j in slices(off):
            ids, n = chunks.ids(data[off[i] : off[j]], off[i : j + 1] - off[i])
            parts.append(ids)
            counts.append(n)
        ids, n = np.concatenate(parts), np.concatenate(counts)
        first = np.cumsum(n) - n
        pieces = -(-n // seq_len)
        owner = np.repeat(np.arange(len(n)), pieces)
        start = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * seq_len
        length = np.minimum(n[owner] - start, seq_len)
        rows = best_fit_decreasing(length.tolist(), seq_len)
        out: dict[str, list] = {f: [] for f in ("token_ids", "position_ids", "cu_seqlens", "doc_ids", "doc_starts")}
        steps = np.arange(seq_len, dtype=np.uint16)
        for row in rows:
            held, places, bounds = np.full(seq_len, pad_id, np.uint16), np.zeros(seq_len, np.uint16), [0]
            for k in row:
                a, b = bounds[-1], bounds[-1] + int(length[k])
                at = first[owner[k]] + start[k]
                held[a:b] = ids[at : at + length[k]]
                places[a:b] = steps[: b - a]
                bounds.append(b)
            out["token_ids"].append(held.astype("<u2").tobytes())
            out["position_ids"].append(places.astype("<u2").tobytes())
            out["cu_seqlens"].append(bounds)
            out["doc_ids"].append([own[owner[k]] for k in row])
            out["doc_starts"].append([int(start[k]) for k in row])
        return pa.record_batch(
            {
                "shard": pa.array([shard] * len(rows), pa.int64()),
                "row": pa.array(range(from_row, from_row + len(rows)), pa.int64()),
                "n_tokens": pa.array([x[-1] for x in out["cu_seqlens"]], pa.int64()),
                "n_segments": pa.array([len(x) for x in out["doc_ids"]], pa.int64()),
                "token_ids": pa.array(out["token_ids"], pa.binary()),
                "position_ids": pa.array(out["position_ids"], pa.binary()),
                "cu_seqlens": pa.array(out["cu_seqlens"], pa.list_(pa.int32())),
                "doc_ids": pa.array(out["doc_ids"], pa.list_(pa.int64())),
                "doc_starts": pa.array(out["doc_starts"], pa.list_(pa.int64())),
            }
        )

    def pack_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, held, held_bytes, shard, row = ChunkEncoder(path), [], 0, None, 0
        for batch in batches:
            shards_here = batch.column("shard").to_numpy()
            size = pa.compute.binary_length(batch.column("text")).to_numpy()
            cuts = [0, *(np.flatnonzero(shards_here[1:] != shards_here[:-1]) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                new = i < j and shards_here[i] != shard
                if held and (new or held_bytes > MOST_TIMES * shard_bytes):
                    packed = pack_part(shard, row, pa.Table.from_batches(held), chunks)
                    yield packed
                    held, held_bytes, row = [], 0, 0 if new else row + packed.num_rows
                if i < j:
                    shard = int(shards_here[i])
                    held.append(batch.slice(i, j - i))
                    held_bytes += int(size[i:j].sum())
        if held:
            yield pack_part(shard, row, pa.Table.from_batches(held), chunks)

    dealt = docs.select(
        F.pmod(F.xxhash64(F.lit("shard"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))), F.lit(shards)).alias("shard"),
        F.col("doc_id").cast("long"),
        "text",
    ).where(F.length("text") > 0)
    # A hash of few numbers is uneven, but some shards in one task are no harm.
    return dealt.repartition(min(shards, MOST_TASKS), "shard").sortWithinPartitions("shard", "doc_id", "text").mapInArrow(pack_all, SCHEMA)


def segments_of(packed: Iterator) -> Iterator[tuple[int | None, int, list[int]]]:
    """(doc_id, token offset, ids) of each segment in packed rows: the inverse of packing."""
    for r in packed:
        ids = np.frombuffer(bytes(r["token_ids"]), "<u2")
        for k, doc in enumerate(r["doc_ids"]):
            yield doc, r["doc_starts"][k], ids[r["cu_seqlens"][k] : r["cu_seqlens"][k + 1]].tolist()


__all__ = ["Capacities", "ChunkEncoder", "best_fit_decreasing", "encoder", "pack", "segments_of"]
