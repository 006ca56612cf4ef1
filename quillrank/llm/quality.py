"""Quality by positive-unlabelled learning.

Documents labelled good are trusted positives; documents without a label are unlabelled web text. A linear scorer
over binned text measures minimises the non-negative unbiased risk: ``prior * R+(positive) + max(0, R-(unlabelled) -
prior * R-(positive))``. Labels of bad documents are not learned from. The class prior is estimated from the two
samples alone: the largest share of positives that the unlabelled scores leave room for, over score regions.

Fitted on at most ``SAMPLE`` positives and as many unlabelled documents (chosen by a hash of doc_id, rows of the
held-out fold left out); every word of every text is measured.

Edge cases: a null or empty text is measured as a text without words; a document labelled twice is a positive only
if all its labels say so; without positives or unlabelled documents every score is the prior's default;
repeated rows get equal rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import fold, sampled_ids, steps
from quillrank.shipping import ship

SAMPLE = 6000
#: Quantiles of the positives and of the unlabelled that part a measure into bins, the positives' range among them.
INNER, OUTER = (0.0, 0.02, 0.1, 0.3, 0.5, 0.7, 0.9, 0.98, 0.995, 1.0), (0.02, 0.05, 0.1, 0.9, 0.95, 0.98)
BINS = len(INNER) + len(OUTER) + 1
#: Steps of descent, prior without an estimate.
ROUNDS, RATE, DECAY, PRIOR = 800, 0.1, 3e-5, 0.8
#: Characters that running text rarely holds, and those that end its words.
SYMBOLS, POINTS = b"#*$%&|<>{}[]\\^~=", b".,;:!?"
MEASURES = ("words", "letters_a_word", "symbols_a_word", "exclamations_a_word", "upper_share", "digits_share", "distinct_share", "repeats_share", "points_a_word", "words_a_line", "distinct_lines_share", "short_words_share")


@dataclass(frozen=True)
class Model:
    edges: np.ndarray  # measures x (BINS - 1)
    weights: np.ndarray  # measures x BINS
    bias: float
    prior: float


def measures(text: bytes | None) -> list[float]:
    """Of a whole text in UTF-8; letters are counted in bytes."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(MEASURES)
    size = sum(map(len, words))
    drop = lambda signs: len(text) - len(text.translate(None, signs))
    upper = drop(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    lower = drop(b"abcdefghijklmnopqrstuvwxyz")
    lines = [x for x in text.split(b"\n") if x.strip()]
    distinct = len(set(words))
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    short = sum(len(w) <= 3 for w in words)
    return [float(np.log1p(n)), size / n, drop(SYMBOLS) / n, drop(b"!") / n, upper / max(1, upper + lower), drop(b"0123456789") / size, distinct / n**0.8, repeats / n, drop(POINTS) / n, min(200.0, n / max(1, len(lines))), len(set(lines)) / max(1, len(lines)), short / n]


def _cells(table: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The flat index of each measure's bin."""
    return np.stack([np.searchsorted(edges[k], table[:, k], side="right") + k * BINS for k in range(table.shape[1])], axis=1)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, grid: int = 40) -> float:
    """The largest share p for which p times the positives' scores fit below the unlabelled ones: the least ratio of the two distributions' mass above a threshold, of thresholds that at least half of the positives pass."""
    cuts = np.quantile(positive, np.linspace(0, 0.5, grid))
    above_p = (positive[None] >= cuts[:, None]).mean(axis=1)
    above_u = (unlabelled[None] >= cuts[:, None]).mean(axis=1)
    return float(np.clip(np.min(above_u / above_p), 0.05, 0.98))


def descend(positive: np.ndarray, unlabelled: np.ndarray, size: int, prior: float) -> tuple[np.ndarray, float]:
    """Non-negative risk with the logistic loss, by Adam; where the negative part falls below 0 the step undoes it."""
    w, b = np.zeros(size), 0.0
    state = [[np.zeros(size), np.zeros(size)], [np.zeros(1), np.zeros(1)]]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for n in range(1, ROUNDS + 1):
        zp, zu = w[positive].sum(axis=1) + b, w[unlabelled].sum(axis=1) + b
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        up, un = sigmoid(zp), sigmoid(zu)
        if negative >= 0:
            gp, gu = prior * (up - 1) / len(zp) - prior * up / len(zp), un / len(zu)
        else:
            gp, gu = prior * up / len(zp), -un / len(zu)
        slope = np.bincount(positive.ravel(), np.repeat(gp, positive.shape[1]), size) + np.bincount(unlabelled.ravel(), np.repeat(gu, unlabelled.shape[1]), size) + DECAY * w
        for (mean, square), g in zip(state, (slope, np.array([gp.sum() + gu.sum()])), strict=True):
            mean *= 0.9
            mean += 0.1 * g
            square *= 0.99
            square += 0.01 * g * g
        move = [RATE * (m / (1 - 0.9**n)) / (np.sqrt(s / (1 - 0.99**n)) + 1e-8) for m, s in state]
        w, b = w - move[0], b - float(move[1][0])
    return w, b


def fit(good: np.ndarray, mixed: np.ndarray) -> Model:
    """good, mixed: measures of positives and of unlabelled documents, one row each.

    A first scorer with the default prior learns one half of the samples; the prior is estimated on its scores of the other half, then the final scorer is fitted to all.
    """
    good, mixed = (x[np.lexsort(x.T[::-1])] for x in (good, mixed))
    m = len(MEASURES)
    if not len(good) or not len(mixed):
        return Model(np.zeros((m, BINS - 1)), np.zeros((m, BINS)), float(np.log(PRIOR / (1 - PRIOR))), PRIOR)
    edges = np.sort(np.concatenate([np.quantile(good, INNER[:-1], axis=0), np.nextafter(good.max(axis=0), np.inf)[None], np.quantile(mixed, OUTER, axis=0)]), axis=0).T.copy()
    p, u = _cells(good, edges), _cells(mixed, edges)
    prior = PRIOR
    if min(len(p), len(u)) >= 20:  # the scorer of one half judges the other
        w, _ = descend(p[::2], u[::2], m * BINS, prior)
        prior = class_prior(w[p[1::2]].sum(axis=1), w[u[1::2]].sum(axis=1))
    w, b = descend(p, u, m * BINS, prior)
    return Model(edges, w.reshape(m, BINS), b, prior)


def scores(texts: list[bytes | None], model: Model) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    z = model.weights.ravel()[_cells(np.array([measures(t) for t in texts]), model.edges)].sum(axis=1) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, learnable: Column, sample: int = SAMPLE) -> Model:
    """The model of at most ``sample`` trusted positives and as many unlabelled documents."""
    given = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = docs.select("doc_id").where(learnable & F.col("doc_id").isNotNull()).join(given, "doc_id", "left")
    ids = sampled_ids(rows.where(F.col("quality").isNull() | (F.col("quality") > 0)), ["quality"], sample).distinct()
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "quality").distinct()
    schema = pa.schema([("positive", pa.bool_()), ("measures", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                found = [measures(t) for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.record_batch([part.column("quality").is_valid(), pa.array(found, schema.field(1).type)], schema=schema)

    ship(docs.sparkSession)
    # measures, not texts, come to the driver
    rows = texts.mapInArrow(run, "positive boolean, measures array<double>").toArrow()
    table = np.array(rows.column("measures").to_pylist()).reshape(-1, len(MEASURES))
    known = np.array(rows.column("positive").to_pylist(), bool)
    return fit(table[known], table[~known])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row; no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                yield pa.record_batch([part.column("doc_id"), pa.array(scores(part.column("text").cast(pa.binary()).to_pylist(), model), pa.float64())], schema=schema)

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows: learns where crc32(doc_id) mod 5 isn't 0, scores every document."""
    held_out = fold(F.col("doc_id"), 5) == 0
    out = predict(docs, train(docs, labels, ~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
