"""Token counts of a unigram model by dynamic programming on a trie of pre-tokens.

Distinct pre-tokens go into a trie; the best score of a prefix is computed once, at its
node, from the scores of the shorter prefixes above it, and every word with that prefix
shares it. The node where a word ends holds its token count, which the task remembers by
the word's bytes; the memory starts afresh beyond ``MOST_KNOWN`` words, which bounds it and
changes no count.

The vocabulary is a public one (``piece_bpe_32k.model``). Its pieces are ranked by
merge order, so each gets the log probability of a Zipf law, ``-ln(rank + 2)``.
Characters outside the vocabulary fall back to their UTF-8 bytes. Among
segmentations of equal score the one with fewer tokens counts.

Defined results: a null or empty text has no words and no tokens; a null doc_id
passes through; repeated rows give equal rows.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import U64, buffer_of, mix, numbered, slices, sums_by, words_of

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
MODEL = "piece_bpe_32k.model"
#: Words whose counts a task remembers, rows of a trie at once, and letters of words that share one with short words.
MOST_KNOWN, ROWS, WIDE = 2_000_000, 20_000, 60
FACTOR = U64(0x9E3779B97F4A7C15)
MARK = "▁"

SCHEMA = "doc_id long, n_words long, n_tokens long"


@cache
def vocabulary(path: str) -> tuple[dict[str, float], float]:
    """Score of each piece, and of each byte of a character that no piece spells."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte = {}, 0.0
    for k in range(model.get_piece_size()):
        score = -math.log(k + 2)
        if model.is_byte(k):
            byte = min(byte, score)
        elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
            pieces[model.id_to_piece(k)] = score
    lowest = min(pieces.values(), default=0.0)
    return pieces, lowest + byte


class Trie:
    """Forward scores of the prefixes of many words at once.

    Sorted words lie side by side as rows of code points; a node is the first row with a
    prefix, and later rows share its number. Scores are filled by depth, all nodes of a depth
    together: each takes the best piece that ends there on top of its ancestor's score.
    """

    def __init__(self, pieces: dict[str, float], byte: float):
        self.byte, self.pieces = byte, pieces
        self.longest = max(map(len, pieces), default=1)
        names = sorted(pieces)
        hashes = np.array([self._hash(np.array([list(map(ord, x))], np.uint64))[0] for x in names], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.scores = np.array([pieces[x] for x in names])[order] if names else np.zeros(0)
        self.made = 0

    @staticmethod
    def _hash(rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), np.uint64)
        for k in range(rows.shape[1] - 1, -1, -1):
            h = h * FACTOR + mix(rows[:, k])
        return h

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each word."""
        out = np.zeros(len(words), np.int64)
        order = sorted(range(len(words)), key=lambda k: (len(words[k]) > WIDE, words[k]))
        short = sum(len(w) <= WIDE for w in words)
        for i in range(0, short, ROWS):
            part = order[i : min(i + ROWS, short)]
            out[part] = self._counted([words[k] for k in part])
        # Longer words stand alone, as a row is as wide as the longest word beside it: their trie is a chain.
        for k in order[short:]:
            out[k] = self._chain(words[k])
        return out

    def _chain(self, word: str) -> int:
        """Tokens of one word, node by node."""
        pieces, longest, byte = self.pieces, self.longest, self.byte
        score, tokens = [0.0], [0]
        for d in range(1, len(word) + 1):
            width = len(word[d - 1].encode("utf-8", "surrogatepass"))
            best, fewest = score[-1] + byte * width, tokens[-1] + width
            for at in range(d - 1, max(d - longest, 0) - 1, -1):
                found = pieces.get(word[at:d])
                if found is not None:
                    total, count = score[at] + found, tokens[at] + 1
                    if total > best or total == best and count < fewest:
                        best, fewest = total, count
            score.append(best)
            tokens.append(fewest)
        self.made += len(word)
        return tokens[-1]

    def _counted(self, words: list[str]) -> np.ndarray:
        length = np.array([len(w) for w in words])
        wide = int(length.max(initial=0))
        letters = np.zeros((len(words), wide), np.uint64)
        letters[np.arange(wide) < length[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        shared = np.zeros(len(words), np.int64)
        if len(words) > 1:
            same = (letters[1:] == letters[:-1]) & (np.arange(wide) < np.minimum(length[1:], length[:-1])[:, None])
            shared[1:] = np.logical_and.accumulate(same, axis=1).sum(1)
        depths = np.arange(1, wide + 1)
        new = (depths > shared[:, None]) & (depths <= length[:, None])
        node = np.zeros((len(words), wide + 1), np.int64)
        node[:, 1:][new] = np.arange(1, new.sum() + 1)
        node = np.maximum.accumulate(node, axis=0)  # a shared prefix is the node of the row above
        score, tokens = np.zeros(new.sum() + 1), np.zeros(new.sum() + 1, np.int64)
        self.made += int(new.sum())
        for d in range(1, wide + 1):
            rows = np.flatnonzero(new[:, d - 1])
            last = letters[rows, d - 1]
            width = 1 + (last >= 0x80).astype(np.int64) + (last >= 0x800) + (last >= 0x10000)
            above = node[rows, d - 1]
            best, fewest = score[above] + self.byte * width, tokens[above] + width
            h = np.zeros(len(rows), np.uint64)
            mixed = mix(letters[rows, max(0, d - self.longest) : d])
            for size in range(1, min(d, self.longest) + 1):
                h = mixed[:, -size] + h * FACTOR
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                hit = np.flatnonzero(self.hashes[at] == h) if len(self.hashes) else np.zeros(0, int)
                if len(hit):
                    up = node[rows[hit], d - size]
                    total, count = score[up] + self.scores[at[hit]], tokens[up] + 1
                    better = (total > best[hit]) | (total == best[hit]) & (count < fewest[hit])
                    best[hit[better]], fewest[hit[better]] = total[better], count[better]
            at = node[rows, d]
            score[at], tokens[at] = best, fewest
        return tokens[node[np.arange(len(words)), length]]


def count_tokens(docs: DataFrame, tokenizers: str = TOKENIZERS, model: str = MODEL) -> DataFrame:
    """Words and unigram tokens of every text."""
    path = f"{tokenizers}/{model}"

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(*vocabulary(path))
        known: dict[bytes, int] = {}
        for batch in batches:
            data, off = buffer_of(batch.column("text"))
            for i, j in slices(off):
                part, cut = data[off[i] : off[j]], off[i : j + 1] - off[i]
                start, end, doc = words_of(part, cut)
                inverse, first = numbered(part, start, end)
                if len(known) > MOST_KNOWN:
                    known.clear()
                raw = part.tobytes()
                keys = [raw[p:q] for p, q in zip(start[first].tolist(), end[first].tolist(), strict=True)]
                fresh = [w for w in keys if w not in known]
                known.update(zip(fresh, trie.count([MARK + w.decode("utf-8", "replace") for w in fresh]).tolist(), strict=True))
                sizes = np.array([known[w] for w in keys], np.int64)
                total = np.bincount(doc, weights=sizes[inverse], minlength=j - i) if len(keys) else np.zeros(j - i)
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id").slice(i, j - i),
                        "n_words": pa.array(sums_by(doc, j - i)),
                        "n_tokens": pa.array(total.astype(np.int64)),
                    }
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tally, SCHEMA)
