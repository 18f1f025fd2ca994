"""Alignment of two tokenizers: shared cuts, groups of tokens between them, and links of tokens that overlap.

Both tokenizers encode a space and the text: A is byte-level BPE (``byte_bpe_50k``), B is BPE of
pieces with byte fallback (``piece_bpe_32k.model``, which adds the space itself).

1. A text is cut before spaces where neither tokenizer can join the two sides; each distinct
   chunk is encoded once and remembered by its bytes.
2. The ends of a chunk's tokens are marked in two packed bitsets over its bytes. Their AND has
   the shared cuts; ranks (popcounts summed up) turn byte places into token numbers, so that a
   shared cut tells where its group ends among the tokens of A and of B, and the byte range of
   an A token tells the first and last B token that overlaps it. These ranges expand to links.
3. What each document links is saved: its different pairs of ids and how often each. Partial
   counts per task tell in how many documents a pair is linked; then each document sums the
   counts over its links.

The table of counts is broadcast up to ``MOST_PAIRS``; beyond it each document's pairs meet it
in a salted join.

Defined results: texts that are null or empty, or whose tokens' bytes aren't those of a space
and the text (as with U+2581 in the text), have no tokens; a null doc_id passes through; every
row is a document, so repeated rows count as often; other columns take no part.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.closure import named_by
from ..session import saved, saved_rows
from .packing import TOKENIZERS, VOCABULARY, encoder
from .textbytes import U64, buffer_of, numbered, slices

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs of ids that are broadcast at most (17 bytes each).
MOST_PAIRS = 3_000_000
#: Chunks that a task remembers, and different pairs whose counts it holds at once.
MOST_KNOWN, MOST_COUNTED = 500_000, 1_000_000
#: Bits of a B id in a pair.
B_BITS = 16

SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
SUMS = ("n_a", "n_b", "n_groups", "n_links")


def byte_letters() -> dict[str, int]:
    """The character by which byte-level vocabularies write each byte: printable ones as themselves, the others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@cache
def tokenizers_of(folder: str):
    """(encode texts by A, bytes of A's ids, B, bytes of B's ids, whether B never joins letters and a following space)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{folder}/{A_FILE}")
    a.encode_special_tokens = True
    letters, vocabulary = byte_letters(), a.get_vocab(with_added_tokens=True)
    a_bytes = [b""] * (max(vocabulary.values()) + 1)
    for entry, k in vocabulary.items():
        a_bytes[k] = bytes(letters[c] for c in entry)
    b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{B_FILE}")
    pieces = [b.id_to_piece(k) for k in range(b.get_piece_size())]
    b_bytes = [bytes([int(x[3:5], 16)]) if b.is_byte(k) else x.replace("▁", " ").encode() for k, x in enumerate(pieces)]
    splits = not any("▁" in x.lstrip("▁") for x in pieces)
    plain = encoder(f"{folder}/{VOCABULARY}").encode_ordinary  # the same vocabulary; faster on single words

    def encode_a(texts: list[str]) -> list[list[int]]:
        other = iter(a.encode_batch_fast([x for x in texts if not x.isascii()], add_special_tokens=False))
        return [plain(x) if x.isascii() else next(other).ids for x in texts]

    return encode_a, a_bytes, b, b_bytes, splits


def _flat(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([len(x) for x in strings]), np.frombuffer(b"".join(strings), np.uint8)


def _gathered(flat: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The strings of the ids one after another; ``flat`` has those of all ids in order."""
    begin, width = (np.cumsum(sizes) - sizes)[ids], sizes[ids]
    return flat[np.repeat(begin - (np.cumsum(width) - width), width) + np.arange(width.sum())]


def _joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    many = np.array([len(x) for x in lists])
    return np.fromiter(chain.from_iterable(lists), np.int64, many.sum()), many


class Ends:
    """Token ends as a packed bitset: bit k is set if a token ends behind byte k."""

    def __init__(self, length: np.ndarray):
        total = int(length.sum())
        marks = np.zeros(-(-total // 64) * 64 + 64, bool)
        marks[np.cumsum(length) - 1] = True
        self.words = np.packbits(marks, bitorder="little").view(np.uint64)
        self._index()

    def _index(self) -> None:
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))))

    def __and__(self, other: Ends) -> Ends:
        out = object.__new__(Ends)
        out.words = self.words & other.words
        out._index()
        return out

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ends among the first ``at`` bytes."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((U64(1) << bit) - U64(1))).astype(np.int64)

    def select(self) -> np.ndarray:
        """Bytes in front of each end, in order."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little")) + 1


class Chunks:
    """Tokens, groups and links of chunks, known by their bytes."""

    def __init__(self, folder: str):
        self.encode_a, self.a_bytes, self.b, self.b_bytes, self.splits = tokenizers_of(folder)
        self.a_size, self.a_flat = _flat(self.a_bytes)
        self.b_size, self.b_flat = _flat(self.b_bytes)
        self.name_size, self.name_flat = _flat([b"%d " % k for k in range(max(len(self.a_bytes), len(self.b_bytes)))])
        self.blank = self.b.piece_to_id("▁")
        self.known: dict[bytes, int] = {}
        self.clear()

    def clear(self) -> None:
        self.known.clear()
        self.numbers = {c: array("q") for c in SUMS}
        self.groups: list[bytes] = []
        self.good = bytearray()
        self.pairs, self.ends = array("q"), array("q", [0])

    def of(self, chunks: list[bytes]) -> np.ndarray:
        """Numbers of the chunks; new ones are encoded."""
        fresh = [c for c in dict.fromkeys(chunks) if c not in self.known]
        if fresh:
            self._add(fresh)
        return np.array([self.known[c] for c in chunks], np.int64)

    def _add(self, fresh: list[bytes]) -> None:
        texts = [c.decode("utf-8", "replace") for c in fresh]
        a, n_a = _joined(self.encode_a(texts))
        b, n_b = _joined([ids or [self.blank] for ids in self.b.encode([x[1:] for x in texts], num_threads=1)])
        # A chunk counts if the tokens' bytes are its own.
        size, whole = np.array([len(c) for c in fresh]), np.frombuffer(b"".join(fresh), np.uint8)
        good = self._spells(a, n_a, self.a_size, self.a_flat, size, whole) & self._spells(b, n_b, self.b_size, self.b_flat, size, whole)
        if not good.all():
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b, size = n_a * good, n_b * good, size * good
        a_ends, b_ends = Ends(self.a_size[a]), Ends(self.b_size[b])
        shared = a_ends & b_ends
        cuts = shared.select()
        stop = np.cumsum(size)
        n_groups = shared.rank(stop) - shared.rank(stop - size)
        # The range of each A token, from its first byte to its last, meets the B tokens around both.
        last = np.cumsum(self.a_size[a])
        from_b, upto_b = b_ends.rank(last - self.a_size[a]), b_ends.rank(last - 1)
        many = upto_b - from_b + 1
        place = np.repeat(np.arange(len(a)), many)
        pairs = (a[place] << B_BITS) | b[np.repeat(from_b - (np.cumsum(many) - many), many) + np.arange(len(place))]
        links = np.concatenate(([0], np.cumsum(many)))
        a_stop = np.concatenate(([0], np.cumsum(n_a)))
        n_links = links[a_stop[1:]] - links[a_stop[:-1]]
        # Texts of the groups: between shared cuts the A ids, then the B ids, each name with what follows it in place of its space.
        a_cut, b_cut = a_ends.rank(cuts), b_ends.rank(cuts)
        turn = np.concatenate((2 * np.searchsorted(a_cut, np.arange(len(a)), "right"), 2 * np.searchsorted(b_cut, np.arange(len(b)), "right") + 1))
        order = np.argsort(turn, kind="stable")
        turn, ids = turn[order], np.concatenate((a, b))[order]
        behind = np.where(turn[:-1] == turn[1:], 0x2C, np.where(turn[:-1] % 2 == 0, 0x7C, 0x3B)).astype(np.uint8)  # , | ;
        width = self.name_size[ids]
        written = _gathered(self.name_flat, self.name_size, ids)
        stops = np.cumsum(width)
        written[stops[:-1] - 1] = behind
        tokens = np.concatenate(([0], np.cumsum(n_a + n_b)))
        upto = np.concatenate(([0], stops))[tokens].tolist()
        raw = written.tobytes()
        self.groups += [raw[p : max(p, q - 1)] for p, q in zip(upto, upto[1:], strict=False)]
        for name, values in zip(SUMS, (n_a, n_b, n_groups, n_links), strict=True):
            self.numbers[name].extend(values.tolist())
        self.good.extend(good.tolist())
        self.pairs.frombytes(pairs.astype(np.int64).tobytes())
        self.ends.extend((np.cumsum(n_links) + self.ends[-1]).tolist())
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))

    @staticmethod
    def _spells(ids: np.ndarray, many: np.ndarray, sizes: np.ndarray, flat: np.ndarray, size: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Which chunks (of ``many`` ids each) have the bytes of their tokens, chunk by chunk."""
        upto = np.concatenate(([0], np.cumsum(sizes[ids])))
        stop = np.cumsum(many)
        same = upto[stop] - upto[stop - many] == size
        if not same.all():  # compare where the lengths agree
            ids, whole = ids[np.repeat(same, many)], whole[np.repeat(same, size)]
        differ = np.concatenate(([0], np.cumsum(_gathered(flat, sizes, ids) != whole)))
        end = np.cumsum(size * same)
        return same & (differ[end] == differ[end - size * same])

    def read(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, chunk) of a slice's chunks, in order; documents without tokens have none."""
        if len(self.known) > MOST_KNOWN:
            self.clear()
        n = len(off) - 1
        filled = np.flatnonzero(np.diff(off) > 0)
        cut = np.concatenate(([0], np.cumsum(np.diff(off)[filled] + 1)))
        spaced = np.full(int(cut[-1]), 0x20, np.uint8)
        inside = np.ones(len(spaced), bool)
        inside[cut[:-1]] = False
        spaced[inside] = data[off[0] : off[-1]]
        begins = np.zeros(len(spaced), bool)
        if self.splits and len(spaced):
            before, after = np.roll(spaced, 1), np.roll(spaced, -1)
            shown, shown_after = (before > 0x20) & (before < 0x7F), (after > 0x20) & (after < 0x7F)
            begins = (spaced == 0x20) & (shown | (before >= 0x80) & shown_after)
        begins[cut[:-1]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(spaced))[: len(start)]
        number, first = numbered(spaced, start, end)
        raw = spaced.tobytes()
        chunk = self.of([raw[p:q] for p, q in zip(start[first].tolist(), end[first].tolist(), strict=True)])[number]
        doc = filled[np.searchsorted(cut, start, "right") - 1]
        bad = np.frombuffer(bytes(self.good), np.uint8)[chunk] == 0
        if bad.any():  # chunks whose bytes don't come back: only the whole text decides
            for k in np.unique(doc[bad]).tolist():
                mine = np.flatnonzero(doc == k)
                whole = self.of([raw[start[mine[0]] : end[mine[-1]]]])[0]
                chunk[mine[0]], doc[mine[1:]] = whole, n
                if not self.good[whole]:
                    doc[mine] = n
            chunk, doc = chunk[doc < n], doc[doc < n]
        return doc, chunk

    def pairs_of(self, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the chunks, pair) of all their links."""
        ends = np.frombuffer(self.ends, np.int64)
        begin, many = ends[chunk], ends[chunk + 1] - ends[chunk]
        place = np.repeat(np.arange(len(chunk)), many)
        return place, np.frombuffer(self.pairs, np.int64)[np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(len(place))]


def _added(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Whole-number sums by document, documents in order."""
    upto = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    at = np.searchsorted(doc, np.arange(n + 1))
    return upto[at[1:]] - upto[at[:-1]]


READ = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def aligned(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """Each row's tokens, groups and links; ``pairs`` and ``times``: its different pairs of ids, in order, and how often each is linked."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(folder)
        for batch in batches:
            data, off = buffer_of(batch.column("text"))
            for i, j in slices(off):
                doc, chunk = chunks.read(data[off[i] : off[j]], off[i : j + 1] - off[i])
                most = max(1, len(chunks.known))
                once, often = np.unique(doc * most + chunk, return_counts=True)
                place, pair = chunks.pairs_of(once % most)
                key = ((once // most)[place] << 32) | pair
                order = np.argsort(key)
                key = key[order]
                first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
                times = np.add.reduceat(often[place][order], first) if len(key) else first
                key = key[first]
                at = np.searchsorted(key, np.arange(j - i + 1) << 32).tolist()
                out = {"doc_id": batch.column("doc_id").slice(i, j - i)}
                for name in SUMS:
                    out[name] = pa.array(_added(doc, np.frombuffer(chunks.numbers[name], np.int64)[chunk] if len(chunk) else chunk, j - i))
                cut = np.searchsorted(doc, np.arange(j - i + 1)).tolist()
                numbers, groups = chunk.tolist(), chunks.groups
                shown = [hashlib.sha256(b";".join([groups[k] for k in numbers[p:q]])).hexdigest() if p < q else "" for p, q in zip(cut, cut[1:], strict=False)]
                out["groups_sha256"] = pa.array(shown, pa.string())
                pairs = (key & 0xFFFFFFFF).astype("<u4")
                out["pairs"] = pa.array([pairs[p:q].tobytes() for p, q in zip(at, at[1:], strict=False)], pa.binary())
                out["times"] = pa.array([_narrow(times[p:q]) for p, q in zip(at, at[1:], strict=False)], pa.binary())
                yield pa.record_batch(out)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(read, READ)


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs."""
    top = int(values.max(initial=0))
    return values.astype("u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8").tobytes()


def _wide(found: bytes, n: int) -> np.ndarray:
    return np.frombuffer(found, f"<u{len(found) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _pairs_in(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a batch's rows, and where each row's end."""
    data, off = buffer_of(batch.column("pairs"))
    return np.frombuffer(data.tobytes(), "<u4").astype(np.int64), off // 4


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a, pair, n): in how many of the ``aligned`` rows each pair of ids is linked."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            more, times = np.unique(_pairs_in(batch)[0], return_counts=True)
            pair, number = np.unique(np.concatenate((pair, more)), return_inverse=True)
            weights = np.concatenate((n, times))
            n = np.zeros(len(pair), np.int64)
            np.add.at(n, number, weights)
            if len(pair) > MOST_COUNTED:
                yield pa.record_batch({"pair": pa.array(pair), "n": pa.array(n)})
                pair, n = pair[:0], n[:0]
        yield pa.record_batch({"pair": pa.array(pair), "n": pa.array(n)})

    found = rows.where("n_links > 0").select("pairs").mapInArrow(count, "pair long, n long")
    return found.groupBy("pair").agg(F.sum("n").alias("n")).select(F.shiftright("pair", B_BITS).alias("a"), "pair", "n")


def align(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """One row per document: tokens, groups, links, how many are the best of their A id, the sum of their counts, and the groups' hash."""
    rows = saved(aligned(docs, folder).withColumn("row", F.monotonically_increasing_id()))
    counts, n_pairs = saved_rows(pair_counts(rows))
    # At most as many rows of one A id as there are B ids.
    table = counts.select("pair", "n", (F.col("n") == F.max("n").over(Window.partitionBy("a"))).alias("best"))
    found = _with_table(rows, table) if n_pairs <= MOST_PAIRS else _with_join(rows, table)
    return found.select(*(c.split(" ")[0] for c in SCHEMA.split(", ")))


def _with_table(rows: DataFrame, table: DataFrame) -> DataFrame:
    found = table.orderBy("pair").toArrow()  # ``MOST_PAIRS`` rows at most
    columns = [found.column(c).to_numpy() for c in ("pair", "n", "best")]
    shared = rows.sparkSession.sparkContext.broadcast([columns[0].astype(np.int64), columns[1].astype(np.int64), columns[2].astype(bool)])
    plain = ("doc_id", *SUMS, "groups_sha256")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = shared.value
        for batch in batches:
            pair, off = _pairs_in(batch)
            times = [_wide(x, q - p) for x, p, q in zip(batch.column("times").to_pylist(), off.tolist(), off[1:].tolist(), strict=False)]
            times = np.concatenate([np.zeros(0, np.int64), *times])
            at = np.searchsorted(pairs, pair)
            sums = [np.concatenate(([0], np.cumsum(x, dtype=np.int64))) for x in (times * best[at], times * counts[at])]
            yield pa.record_batch({c: batch.column(c) for c in plain} | {c: pa.array(x[off[1:]] - x[off[:-1]]) for c, x in zip(("n_best", "count_sum"), sums, strict=True)})

    schema = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in plain)
    return rows.mapInArrow(judge, f"{schema}, n_best long, count_sum long")


def _with_join(rows: DataFrame, table: DataFrame) -> DataFrame:
    """The same by a join: each row's pairs meet the table, dealt over salts, and their sums meet the rows."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, off = _pairs_in(batch)
            for k, (p, q) in enumerate(zip(off.tolist(), off[1:].tolist(), strict=False)):
                times = _wide(batch.column("times")[k].as_py(), q - p)
                yield pa.record_batch({"row": pa.array(np.full(q - p, batch.column("row")[k].as_py(), np.int64)), "pair": pa.array(pair[p:q]), "times": pa.array(times)})

    pairs = rows.where("n_links > 0").select("row", "pairs", "times").mapInArrow(linked, "row long, pair long, times long")
    best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")
    sums = named_by(pairs, "pair", table, "row").groupBy("row").agg(best, F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return rows.join(sums.hint("merge"), "row", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_best", "count_sum")})


__all__ = ["Chunks", "Ends", "align", "aligned", "pair_counts"]
