"""Quality rules: base text statistics and a calibrated n-gram classifier.

The classifier is a logistic regression over hashed word unigrams, word bigrams
and character 4-grams (code points), each family scaled to unit sum. It is fitted on a bounded
sample of labelled rows (``fit_rows``, those with the smallest hash of doc_id),
calibrated by Platt scaling on a held-out fifth, and applied in Arrow batches
against one fixed threshold.

Defined results: a null or empty text has no words and fails the base rules; a
null doc_id passes through; without labels of both kinds (a doc_id with several labels
counts with the least) the verdict is the base rules' alone; repeated rows are judged
alike, and of labelled rows that share a doc_id the one with the least text is learnt from;
other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import U64, buffer_of, numbered, slices, span_hashes, sums_by, tuples, windows, words_of

BITS = 16
#: Characters in a gram.
CHARS = 4
FAMILIES = 3
#: Rows that the classifier is fitted on at most.
FIT_ROWS = 2000
#: Documents whose calibrated probability of good quality is lower are rejected.
THRESHOLD = 0.5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, quality double"
)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    scale: float
    shift: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * (margin + self.bias) + self.shift, -40, 40)))


def base_counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The contract's five counts for each document of a slice."""
    n = len(off) - 1
    start, end, doc = words_of(data, off)
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    symbols = np.concatenate(([0], np.cumsum(SYMBOLS[data])))
    # lines: from a document's start or a newline to the next newline or the document's end
    breaks = np.flatnonzero(data == 0x0A)
    line_start = np.sort(np.concatenate((off[:-1], breaks + 1)))
    line_doc = np.sort(np.concatenate((np.arange(n), np.searchsorted(off, breaks, "right") - 1)))
    line_end = np.concatenate((line_start[1:], off[-1:]))
    cut = np.zeros(len(data) + 1, bool)
    cut[breaks + 1] = True
    line_end = np.where(cut[line_end] & (line_end > line_start), line_end - 1, line_end)
    first_word = np.searchsorted(start, line_start)
    has_word = (first_word < len(start)) & (np.append(start, len(data) + 1)[first_word] < line_end)
    line, owner = numbered(data, line_start[has_word], line_end[has_word])[0], line_doc[has_word]
    dup = sums_by(owner, n) - sums_by(np.unique(line * n + owner) % n, n) if n else sums_by(owner, n)
    at = np.flatnonzero(doc[:-2] == doc[2:]) if len(doc) > 2 else np.zeros(0, np.int64)
    key = tuples(numbered(data, start, end)[0], doc, at, 3) * n + doc[at] if len(at) else at
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(doc), bool)
    for j in range(3):
        covered[at[twice] + j] = True
    return {
        "n_words": sums_by(doc, n),
        "word_chars": sums_by(doc, n, (lead[end] - lead[start]).astype(float)),
        "n_symbols": symbols[off[1:]] - symbols[off[:-1]],
        "n_dup_lines": dup,
        "n_repeat_words": sums_by(doc[covered], n),
    }


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


def features(data: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(document, hashed feature) of each occurrence, by family; case is kept, as shouting is a feature."""
    start, end, doc = words_of(data, off)
    h = span_hashes(data, start, end)
    pair, at = windows(h, doc, 2)
    lead = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes of the characters
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))[lead]
    whole = np.flatnonzero(owner[: len(lead) - CHARS + 1] == owner[CHARS - 1 :]) if len(lead) >= CHARS else np.zeros(0, np.int64)
    gram = span_hashes(data, lead[whole], np.append(lead, len(data))[whole + CHARS])
    shift = U64(64 - BITS)
    found = [(doc, h), (doc[at], pair), (owner[whole], gram)]
    return [(d, (x >> shift).astype(np.int64) + (k << BITS)) for k, (d, x) in enumerate(found)]


def margins(data: np.ndarray, off: np.ndarray, weights: np.ndarray) -> np.ndarray:
    n = len(off) - 1
    total = np.zeros(n)
    for doc, feature in features(data, off):
        total += np.bincount(doc, weights=weights[feature], minlength=n) / np.maximum(np.bincount(doc, minlength=n), 1)
    return total


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse feature rows of labelled texts."""
    for batch in batches:
        data, off = buffer_of(batch.column("text"))
        for i, j in slices(off):
            part, cut = data[off[i] : off[j]], off[i : j + 1] - off[i]
            found = features(part, cut)
            key = np.concatenate([(d.astype(np.int64) << 32) | f for d, f in found])
            unit = np.concatenate([1.0 / np.maximum(np.bincount(d, minlength=j - i), 1)[d] for d, _ in found])
            feature, inverse = np.unique(key, return_inverse=True)
            value = np.bincount(inverse, weights=unit).astype(np.float32)
            ends = np.searchsorted(feature >> 32, np.arange(j - i + 1)).astype(np.int32)
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id").slice(i, j - i),
                    "label": batch.column("label").slice(i, j - i),
                    "feature": pa.ListArray.from_arrays(pa.array(ends), pa.array((feature & 0xFFFFFFFF).astype(np.int32))),
                    "value": pa.ListArray.from_arrays(pa.array(ends), pa.array(value)),
                }
            )


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, rounds: int = 120) -> Model | None:
    """Fit and calibrate on at most ``fit_rows`` labelled documents; None without both labels.

    One task fits on the sample, whose rows the parameter bounds; the driver gets the weights.
    """
    rank = F.xxhash64(F.lit("quality"), "doc_id")
    picked = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min(F.col("quality").cast("int")).alias("label"))
        .orderBy(rank, "doc_id")
        .limit(fit_rows)
    )
    # At most fit_rows rows of two numbers: a proven bound, so they may be broadcast.
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = sample.mapInArrow(_rows, "doc_id long, label int, feature array<int>, value array<float>")

    def learn(table: pa.Table) -> pa.Table:
        model = _fitted(table.sort_by("doc_id").slice(0, fit_rows), rounds)
        if model is None:
            return pa.table({"weights": pa.array([], pa.binary())} | {c: pa.array([], pa.float64()) for c in ("bias", "scale", "shift")})
        numbers = {c: [getattr(model, c)] for c in ("bias", "scale", "shift")}
        return pa.table({"weights": pa.array([model.weights.tobytes()], pa.binary())} | numbers)

    found = rows.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(learn, "weights binary, bias double, scale double, shift double").collect()
    return Model(np.frombuffer(bytes(found[0]["weights"]), np.float32), *found[0][1:]) if found else None


def _fitted(rows: pa.Table, rounds: int) -> Model | None:
    label = rows.column("label").to_numpy().astype(float)
    if len(np.unique(label)) < 2:
        return None
    lengths = np.array([len(x) for x in rows.column("feature")])
    feature = rows.column("feature").combine_chunks().flatten().to_numpy()
    value = rows.column("value").combine_chunks().flatten().to_numpy().astype(np.float64)
    owner = np.repeat(np.arange(len(label)), lengths)
    held = np.arange(len(label)) % 5 == 4
    if len(np.unique(label[held])) < 2 or len(np.unique(label[~held])) < 2:
        held = np.zeros(len(label), bool)
    use = ~held
    balance = np.where(label == 1, 0.5 / max(label[use].mean(), 1e-9), 0.5 / max(1 - label[use].mean(), 1e-9)) * use
    weights, bias = np.zeros(FAMILIES << BITS), 0.0
    square, square_bias = np.full(len(weights), 1e-6), 1e-6
    for _ in range(rounds):
        margin = np.bincount(owner, weights=weights[feature] * value, minlength=len(label)) + bias
        error = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - label) * balance / max(use.sum(), 1)
        slope = np.bincount(feature, weights=value * error[owner], minlength=len(weights)) + 1e-7 * weights
        square += slope * slope
        square_bias += error.sum() ** 2
        weights -= 0.5 * slope / np.sqrt(square)
        bias -= 0.5 * error.sum() / np.sqrt(square_bias)
    margin = np.bincount(owner, weights=weights[feature] * value, minlength=len(label)) + bias
    scale, shift = _platt(margin[held], label[held]) if held.any() else (1.0, 0.0)
    return Model(weights.astype(np.float32), float(bias), scale, shift)


def _platt(margin: np.ndarray, label: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and offset of the held-out log odds, with Platt's smoothed targets, by Newton steps."""
    good, bad = (label == 1).sum(), (label == 0).sum()
    target = np.where(label == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack((margin, np.ones_like(margin)), 1)
    theta = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        slope = x.T @ (p - target) + 1e-3 * (theta - np.array([1.0, 0.0]))
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        theta -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: base counts, verdict of the base rules, probability and final verdict."""
    # The model has FAMILIES * 2**BITS weights whatever the input: a proven bound.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            data, off = buffer_of(batch.column("text"))
            for i, j in slices(off):
                part, cut = data[off[i] : off[j]], off[i : j + 1] - off[i]
                counts = base_counts(part, cut)
                failed = base_failed(counts)
                quality = fitted.probability(margins(part, cut, fitted.weights)) if fitted else np.full(j - i, np.nan)
                kept = ~failed & (quality >= threshold if fitted else True)
                yield pa.record_batch(
                    {"doc_id": batch.column("doc_id").slice(i, j - i)}
                    | {k: pa.array(v.astype(np.int64)) for k, v in counts.items()}
                    | {"base_failed": pa.array(failed), "kept": pa.array(kept), "quality": pa.array(quality, from_pandas=True)}
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(judge, SCHEMA)


def kept_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents whose final verdict is to keep them, with their own columns.

    The verdict is taken where the row is, so no join and no key is needed.
    """
    model = fit(docs, labels, fit_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # as names may hold dots
    text = f"c{docs.columns.index('text')}"

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            data, off = buffer_of(batch.column(text))
            kept = [np.zeros(0, bool)]
            for i, j in slices(off):
                part, cut = data[off[i] : off[j]], off[i : j + 1] - off[i]
                good = ~base_failed(base_counts(part, cut))
                if fitted:
                    good &= fitted.probability(margins(part, cut, fitted.weights)) >= threshold
                kept.append(good)
            yield batch.filter(pa.array(np.concatenate(kept)))

    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)


__all__ = ["FIT_ROWS", "Model", "THRESHOLD", "base_counts", "base_failed", "fit", "kept_documents", "margins", "score"]
