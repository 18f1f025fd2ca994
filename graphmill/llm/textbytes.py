"""Vectorised text helpers for the Arrow tasks of this subpackage.

A batch of texts is one ``uint8`` buffer of UTF-8 plus document offsets. Words,
hashes of spans and distinct counts are computed for a whole slice of documents
at once; nothing here knows about Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Slices of a batch: bounded scratch memory, and few enough documents that a
#: slice-local document number fits beside 54 bits of hash.
SLICE_BYTES, SLICE_DOCS, HASH_BITS = 1 << 20, 1024, 54

#: Bytes up to which a span is hashed in blocks of eight beside the others; longer ones go through BLAKE2b one by one.
LONG = 1024
_FIRST = (np.uint64(1) << (np.arange(8, dtype=np.uint64) * U64(8))) - U64(1)
_MASKS = np.append(_FIRST, U64(0xFFFFFFFFFFFFFFFF))
_BLOCK = U64(0x9E3779B97F4A7C15)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but 0-9, A-Z, a-z and bytes of non-ASCII characters.
NON_ALNUM = np.ones(256, bool)
NON_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def buffer_of(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of a string column; null reads as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most_bytes: int = SLICE_BYTES, most_docs: int = SLICE_DOCS) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of documents within both bounds; a longer document stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + most_bytes, "right")) - 1
        j = min(max(j, i + 1), i + most_docs, n)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift)."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros behind the end."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of a buffer, equal for equal bytes anywhere.

    Every block of eight bytes goes through a finaliser on top of the blocks before it; spans
    beyond ``LONG`` bytes through BLAKE2b. Equal hashes don't prove equal bytes: ``numbered`` does.
    """
    eight, left, at = _eights(data), end - start, start
    out = mix(left.astype(np.uint64) + _BLOCK)
    live = None
    if len(left) and left.max() > LONG:
        raw = data.tobytes()
        for k in np.flatnonzero(left > LONG).tolist():
            out[k] = int.from_bytes(blake2b(raw[start[k] : end[k]], digest_size=8).digest(), "little")
        live = np.flatnonzero(left <= LONG)
        left, at = left[live], at[live]
    while len(at):
        block = eight[at] & _MASKS[np.minimum(left, 8)]
        if live is None:
            out = mix(out * _BLOCK ^ block)
        else:
            out[live] = mix(out[live] * _BLOCK ^ block)
        more = np.flatnonzero(left > 8)
        live = more if live is None else live[more]
        left, at = left[more] - 8, at[more] + 8
    return out


def _same_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, other_end: np.ndarray) -> np.ndarray:
    """Whether each span's bytes are those of the other span beside it."""
    same = end - start == other_end - other
    live = np.flatnonzero(same & (start != other))
    if not len(live):
        return same
    long = live[end[live] - start[live] > LONG]
    if len(long):
        raw = memoryview(data.tobytes())
        same[long] = [raw[start[k] : end[k]] == raw[other[k] : other_end[k]] for k in long.tolist()]
        live = live[end[live] - start[live] <= LONG]
    eight, left, at, by = _eights(data), end[live] - start[live], start[live], other[live]
    while len(at):
        differ = ((eight[at] ^ eight[by]) & _MASKS[np.minimum(left, 8)]) != 0
        same[live[differ]] = False
        more = np.flatnonzero(~differ & (left > 8))
        live, left, at, by = live[more], left[more] - 8, at[more] + 8, by[more] + 8
    return same


def numbered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each span, a span of each number): spans have one number just if their bytes are equal.

    Hashes group the spans, and every span's bytes are compared with its group's first.
    """
    single, first, number = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
    of = first[number]
    wrong = np.flatnonzero(~_same_spans(data, start, end, start[of], end[of]))
    if len(wrong):  # different bytes of one hash: told apart by the bytes themselves
        raw, known, more = data.tobytes(), {}, []
        for k in wrong.tolist():
            n = known.setdefault(raw[start[k] : end[k]], len(single) + len(known))
            if n == len(single) + len(more):
                more.append(k)
            number[k] = n
        first = np.concatenate((first, more))
    return number, first


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes at each position, for k a multiple of 8."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eight = _eights(data)
    out = np.full(n, _BLOCK)
    for j in range(0, k, 8):
        out = mix(out * _BLOCK ^ eight[j : j + n])
    return out


def words_of(data: np.ndarray, off: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each maximal run of bytes that are not in ``gap``."""
    out = gap[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.ones(len(data), bool)
    before[1:] = out[:-1]
    after = np.ones(len(data), bool)
    after[:-1] = out[1:]
    inside = ~out
    start = np.flatnonzero(inside & (before | edge[:-1]))
    end = np.flatnonzero(inside & (after | edge[1:])) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def windows(h: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each ``width`` consecutive words of one document, and the place of its first word."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = np.zeros(n, np.uint64)
    for j in range(width):
        acc = mix(acc * U64(0xA0761D6478BD642F) + h[j : j + n])
    at = np.flatnonzero(doc[:n] == doc[width - 1 :])
    return acc[at], at


def keyed(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Slice-local document number above 54 bits of hash, so that one sort groups by document."""
    return (doc.astype(np.uint64) << U64(HASH_BITS)) | (h >> U64(64 - HASH_BITS))


def sums_by(doc: np.ndarray, n: int, values: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n).astype(np.int64)


def distinct(keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return keys
    keys = np.sort(keys)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))]


def tuples(number: np.ndarray, doc: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Number of the ``width`` words from each place ``at`` on, those of one document: equal just if all their numbers are.

    Words behind a document's end count as one that no document has.
    """
    number = np.concatenate((number + 1, np.zeros(width, np.int64)))
    owner = np.concatenate((doc, np.full(width, -1)))
    most = int(number.max()) + 1
    out = number[at]
    for step in range(1, width):  # one more word at a time
        following = np.where(owner[at + step] == doc[at], number[at + step], 0)
        _, out = np.unique(out * most + following, return_inverse=True)
    return out


def shingles(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, number) of each occurrence of a shingle: ``width`` words, or the whole sequence of a shorter text.

    Shingles have one number just if their words are equal, byte by byte.
    """
    start, end, doc = words_of(data, off)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    many = sums_by(doc, len(off) - 1)
    place = np.arange(len(start)) - (np.cumsum(many) - many)[doc]
    at = np.flatnonzero((place == 0) | (place + width <= many[doc]))
    return doc[at], tuples(numbered(data, start, end)[0], doc, at, width)


def normal_words(data: np.ndarray, off: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The texts with one space behind each word and nothing else between words."""
    start, end, doc = words_of(data, off, gap)
    keep = ~gap[data]
    keep = np.append(keep, False)
    shown = np.append(data, np.uint8(0x20))
    width = end - start + 1
    upto = np.concatenate(([0], np.cumsum(width)))
    out = np.full(int(upto[-1]), 0x20, np.uint8)
    inside = np.ones(len(out), bool)
    inside[upto[1:] - 1] = False
    out[inside] = shown[keep]
    return out, np.concatenate(([0], np.cumsum(np.bincount(doc, weights=width, minlength=len(off) - 1)))).astype(np.int64)


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int) -> np.ndarray:
    """Sorted ``keyed`` hashes of the distinct shingles of each document: ``width`` words each, or the whole sequence of a shorter text.

    Different shingles of one document whose hashes agree are both there.
    """
    n = len(off) - 1
    start, end, doc = words_of(data, off)
    if not len(start):
        return np.zeros(0, np.uint64)
    number, first = numbered(data, start, end)
    h = span_hashes(data, start[first], end[first])[number]
    many = sums_by(doc, n)
    win, at = windows(h, doc, width)
    keys = keyed(win, doc[at])
    short = np.flatnonzero((many > 0) & (many < width))
    if len(short):
        begin = np.cumsum(many) - many
        whole = np.zeros(len(short), np.uint64)
        for j in range(width):
            has = many[short] > j
            place = np.where(has, begin[short] + j, 0)
            whole = np.where(has, mix(whole * U64(0x8EBC6AF09C88C6E3) + h[place] + U64(j + 1)), whole)
        keys = np.concatenate((keys, keyed(mix(whole ^ many[short].astype(np.uint64)), short)))
        at = np.concatenate((at, begin[short]))
    order = np.argsort(keys)
    keys, at = keys[order], at[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    again = np.flatnonzero(~new)
    differ = np.zeros(len(again), bool)
    last = len(number) - 1
    for j in range(width):
        a, b = np.minimum(at[again] + j, last), np.minimum(at[again - 1] + j, last)
        differ |= (number[a] != number[b]) & (doc[a] == doc[at[again]]) & (doc[b] == doc[at[again]])
    for k in again[differ].tolist():  # another shingle of the same hash: unless one like it stands before
        own = number[at[k] : at[k] + width].tolist()
        j = k - 1
        while j >= 0 and keys[j] == keys[k] and number[at[j] : at[j] + width].tolist() != own:
            j -= 1
        new[k] = j < 0 or keys[j] != keys[k]
    return keys[new]
