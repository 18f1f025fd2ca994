"""Language identification by multilingual mixture inference.

A text is lower-cased, its runs of other than letters become one space, and its 4-byte grams
are counted in hashed buckets. Each language has a distribution over buckets, learnt from all
labelled documents outside the held-out fold: one count a gram, smoothed by the counts of all
languages together. A document is a mixture of languages: expectation-maximisation finds the
proportions of a set of languages that make its grams most likely. The set grows from the best
single language by the one that the likelihood rises towards most, as long as the likelihood
rises by more than a penalty for one more language; grams overlap, so ``GRAM`` of them count as
one. The language of the largest proportion is predicted; the score is its proportion, times
the probability of the set's likelihood against those of the languages outside it.

The model has at most ``CELLS`` cells, whatever the input: buckets are halved as languages
double beyond 64.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is any
text if no document can be learnt from; a text of unknown grams gets the most frequent language;
a null doc_id is neither held out nor learnt from; of equal languages the least name is predicted;
repeated rows are predicted alike; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import U64, buffer_of, mix, normal_words, slices

#: Bytes in a gram; buckets times languages at most, and buckets at most, as powers of two.
GRAM, CELLS, BUCKETS = 4, 24, 18
#: Folds by checksum of the id, and the one that is held out.
FOLDS, HELD_OUT = 4, 2
#: Grams of the common distribution that stand beside a language's own.
SMOOTHING = 200.0
#: Rounds of expectation-maximisation for each set, those before documents that can't gain enough leave, and languages whose counts a task holds at once.
ROUNDS, FEW, MOST_HELD = 25, 4, 16
UNKNOWN = "und"

NON_LETTER = np.ones(256, bool)
NON_LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = False

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    bits: int
    #: Probability of each bucket in each language; 0 throughout where no language has it.
    chance: np.ndarray
    prior: np.ndarray


def grams(data: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, count) of a slice of lower-cased texts, in order of both."""
    plain, cut = normal_words(data, off, NON_LETTER)
    n = len(cut) - 1
    # two spaces in front of each text, so that one letter makes a gram
    begin = cut[:-1] + 2 * np.arange(n)
    spread = np.full(len(plain) + 2 * n + GRAM, 0x20, np.uint8)
    owner = np.repeat(np.arange(n), np.diff(cut))
    spread[np.arange(len(plain)) + 2 * owner + 2] = plain
    many = np.where(np.diff(cut) > 0, np.diff(cut) + 2 - GRAM + 1, 0)
    doc = np.repeat(np.arange(n), many)
    at = np.repeat(begin, many) + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    word = np.ndarray((len(spread) - GRAM + 1,), "<u4", spread, strides=(1,))[at]
    bucket = mix(word.astype(np.uint64) + U64(0x9E3779B97F4A7C15)) >> U64(64 - bits) if bits else np.zeros(len(at), np.uint64)
    key, count = np.unique((doc.astype(np.uint64) << U64(bits)) | bucket, return_counts=True)
    return (key >> U64(bits)).astype(np.int64), (key & U64((1 << bits) - 1)).astype(np.int64), count


def _fold(docs: DataFrame):
    return F.pmod(F.crc32(docs["doc_id"].cast("long").cast("string")), F.lit(FOLDS))


def gram_counts(docs: DataFrame, bits: int) -> DataFrame:
    """(lang, bucket, n) over all documents that may be learnt from."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                bucket = np.flatnonzero(counts)
                yield pa.record_batch({"lang": pa.array([lang] * len(bucket), pa.string()), "bucket": pa.array(bucket), "n": pa.array(counts[bucket])})
            held.clear()

        for batch in batches:
            data, off = buffer_of(pc.utf8_lower(batch.column("text")))
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            place = np.array([names.index(x) for x in langs], np.int64)
            for i, j in slices(off):
                doc, bucket, many = grams(data[off[i] : off[j]], off[i : j + 1] - off[i], bits)
                of = place[i:j][doc]
                for k in np.unique(of).tolist():
                    if names[k] not in held and len(held) >= MOST_HELD:
                        yield from told()
                    counts = held.setdefault(names[k], np.zeros(1 << bits, np.int64))
                    counts += np.bincount(bucket[of == k], weights=many[of == k], minlength=1 << bits).astype(np.int64)
        yield from told()

    learnt = docs.where(docs["text"].isNotNull() & docs["lang"].isNotNull() & (_fold(docs) != HELD_OUT)).select(docs["lang"].alias("lang"), docs["text"].alias("text"))
    return learnt.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def bits_for(n_langs: int) -> int:
    return max(0, min(BUCKETS, CELLS - (max(1, n_langs) - 1).bit_length()))


def fit(docs: DataFrame) -> Model:
    """Distributions of all languages; the driver gets one vector a language, ``CELLS`` in all at most."""
    bits = bits_for(docs.select(docs["lang"]).where(docs["lang"].isNotNull()).distinct().count())

    def vector(rows: pa.Table) -> pa.Table:
        counts = np.zeros(1 << bits, np.float32)
        counts[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
        return pa.table({"lang": rows.column("lang").slice(0, 1).cast(pa.string()), "counts": pa.array([counts.tobytes()], pa.binary())})

    # At most 2 ** bits rows of a language meet in a task.
    found = sorted((r["lang"], bytes(r["counts"])) for r in gram_counts(docs, bits).groupBy("lang").applyInArrow(vector, "lang string, counts binary").collect())
    return model_of([lang for lang, _ in found], [np.frombuffer(x, np.float32) for _, x in found], bits)


def model_of(langs: list[str], counts: list[np.ndarray], bits: int) -> Model:
    if not langs:
        return Model((), bits, np.zeros((0, 1 << bits), np.float32), np.zeros(0))
    every = np.sum(counts, axis=0, dtype=np.float64)
    total = np.array([c.sum(dtype=np.float64) for c in counts])
    common = SMOOTHING * every / max(every.sum(), 1.0)
    chance = np.stack([((c + common) / (n + SMOOTHING)).astype(np.float32) for c, n in zip(counts, total, strict=True)])
    return Model(tuple(langs), bits, chance, np.log((total + 1.0) / (total + 1.0).sum()))


def proportions(chance: np.ndarray, count: np.ndarray, doc: np.ndarray, starts: np.ndarray, share: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """Proportions of the rows' languages after some rounds of expectation-maximisation on ``share``, and the log likelihood of each document.

    The last value bounds what any proportions of these languages reach: the likelihood is
    concave, so it lies nowhere above the tangent.
    """
    total = np.add.reduceat(count, starts)
    for _ in range(rounds):
        part = chance * share[:, doc]
        part *= count / part.sum(0)
        share = np.add.reduceat(part, starts, axis=1) / total
    likely = np.maximum((chance * share[:, doc]).sum(0), 1e-300)
    value = np.add.reduceat(count * np.log(likely), starts)
    rise = np.add.reduceat(chance * (count / likely), starts, axis=1).max(0)
    return share, value, value + np.maximum(rise - total, 0)


def mixtures(model: Model, doc: np.ndarray, bucket: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the predicted language, score) of each of n documents, from their grams in order."""
    n_langs = len(model.langs)
    best, score = np.full(n, int(np.argmax(model.prior))), np.full(n, np.exp(model.prior.max()))
    chance = model.chance[:, bucket]
    known = chance[0] > 0
    doc, count, chance = doc[known], count[known].astype(np.float64), chance[:, known].astype(np.float64)
    if not len(doc):
        return best, score
    new = np.concatenate(([True], doc[1:] != doc[:-1]))
    starts, row = np.flatnonzero(new), np.cumsum(new) - 1
    own, total = doc[starts], np.add.reduceat(count, starts)
    alone = np.add.reduceat(count * np.log(chance), starts, axis=1)
    worth = alone / GRAM + model.prior[:, None]
    first = worth.argmax(0)
    sets = [[k] for k in first.tolist()]
    shares: list[np.ndarray] = [np.ones(1)] * len(own)
    reached = alone[first, np.arange(len(own))]
    needed = GRAM * (0.5 * np.log(total / GRAM + 1) + np.log(n_langs))
    open_rows = np.arange(len(own))
    while len(open_rows) and len(sets[open_rows[0]]) < n_langs:
        members = np.array([sets[k] for k in open_rows.tolist()]).T
        share = np.array([shares[k] for k in open_rows.tolist()]).T
        part, many, at, begin = _rows_of(open_rows, chance, count, row, len(own))
        # How fast the likelihood rises towards each language.
        likely = (np.take_along_axis(part, members[:, at], 0) * share[:, at]).sum(0)
        rise = np.add.reduceat(part * (many / likely), begin, axis=1) / total[open_rows]
        np.put_along_axis(rise, members, -np.inf, 0)
        more = rise.argmax(0)
        members = np.concatenate((members, more[None]))
        share = np.full(members.shape, 1.0 / len(members))
        # Documents that can't gain enough leave by the tangent's bound, after none and after some rounds.
        left = np.flatnonzero(total[open_rows] * (rise[more, np.arange(len(more))] - 1) > needed[open_rows])
        value = np.full(len(open_rows), -np.inf)
        for rounds in (FEW, ROUNDS):
            if not len(left):
                break
            part, many, at, begin = _rows_of(open_rows[left], chance, count, row, len(own))
            found, reach, most = proportions(np.take_along_axis(part, members[:, left][:, at], 0), many, at, begin, share[:, left], rounds)
            share[:, left], value[left] = found, reach
            left = left[most - reached[open_rows[left]] > needed[open_rows[left]]]
        better = value - reached[open_rows] > needed[open_rows]
        for k in np.flatnonzero(better).tolist():
            sets[open_rows[k]], shares[open_rows[k]] = members[:, k].tolist(), share[:, k]
        reached[open_rows[better]] = value[better]
        open_rows = open_rows[better]
    for k, (members, share) in enumerate(zip(sets, shares, strict=True)):
        top = min(range(len(members)), key=lambda j: (-share[j], members[j]))
        against = np.exp(np.clip(worth[:, k] - (reached[k] / GRAM + model.prior[members[top]]), -700, 700))
        against[members] = 0
        best[own[k]], score[own[k]] = members[top], share[top] / (1 + against.sum())
    return best, score


def _rows_of(wanted: np.ndarray, chance: np.ndarray, count: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """The grams of some documents: chances, counts, place of the document among them, and where each begins."""
    if len(wanted) < n:
        place = np.full(n, -1)
        place[wanted] = np.arange(len(wanted))
        at = place[row]
        mine = at >= 0
        chance, count, row = chance[:, mine], count[mine], at[mine]
    return chance, count, row, np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: whether it was held out, its language and the score."""
    # CELLS numbers at most, whatever the input: a proven bound.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        names = np.array([*fitted.langs, UNKNOWN], object)
        for batch in batches:
            texts = batch.column("text")
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
            data, off = buffer_of(pc.utf8_lower(texts))
            # Few enough grams at once that a number for each of them and each language fits.
            for i, j in slices(off, max(1 << 14, (1 << 21) // max(1, len(fitted.langs)))):
                best, score = np.full(j - i, len(fitted.langs)), np.zeros(j - i)
                if fitted.langs:
                    best, score = mixtures(fitted, *grams(data[off[i] : off[j]], off[i : j + 1] - off[i], fitted.bits), j - i)
                    best, score = np.where(letters[i:j], best, len(fitted.langs)), np.where(letters[i:j], score, 0.0)
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id").slice(i, j - i),
                        "held_out": batch.column("held_out").slice(i, j - i),
                        "lang_pred": pa.array(names[best], pa.string()),
                        "score": pa.array(np.clip(score, 0.0, 1.0)),
                    }
                )

    held_out = F.coalesce(_fold(docs) == HELD_OUT, F.lit(False))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out.alias("held_out"), docs["text"].alias("text")).mapInArrow(predict, SCHEMA)
