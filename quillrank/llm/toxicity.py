"""Toxicity by weak supervision.

Many voters look at a document: a fixed lexicon, lexicons mined from the labelled documents and dealt to several
voters, patterns, densities, and the given label where there is one. Each votes toxic, clean or not at all. A
generative model (EM) estimates the prior, each voter's votes given the truth, and which voters err together;
votes of correlated voters are shared out. A linear classifier learns the posteriors and scores every document.

Fitted on at most ``SAMPLE`` documents of each label and as many without one (chosen by a hash of doc_id, rows of
the held-out fold left out); every word of every text is scored.

Edge cases: a null or empty text scores as a text without words; documents without a label vote without it;
with no toxic or no clean label to learn from, the fixed lexicon alone decides; a document labelled twice counts
as toxic if any label says so; repeated rows get equal rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import fold, sampled_ids, steps, written
from quillrank.shipping import ship

SAMPLE = 3000
#: Insults of general use.
INSULTS = frozenset("asshole bastard bitch clown cretin disgusting dumb filth fool freak garbage hate idiot imbecile kill loser moron pathetic pig retard scum shit shut stupid trash ugly vermin worthless".split())
#: Lexicon voters, words that a mined lexicon may hold, toxic documents that a word needs (number, share), how much likelier it is in toxic ones.
GROUPS, MINED, LEAST, SHARE, RATIO = 8, 400, 5, 0.012, 6.0
VOCABULARY, ROUNDS, RATE, DECAY = 30_000, 200, 0.1, 3e-4
_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"[^\W\d_][*@$#!]+[^\W\d_]")
_SHOUT = re.compile(r"!{3,}")
CLEAN, TOXIC, NONE = 0, 1, 2


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]  # by word, for its presence
    mined: frozenset[str]
    dense: np.ndarray
    bias: float


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def dense_features(words: list[str], mined: frozenset[str]) -> list[float]:
    """Of mined words: any, logarithm of the count, distinct ones, share of the words."""
    hits = [w for w in words if w in mined]
    n = len(hits)
    return [float(n > 0), float(np.log1p(n)), min(len(set(hits)), 5) / 5, min(1.0, 20 * n / max(1, len(words)))]


def mine(counts: list[tuple[str, int, int]], n: int, m: int) -> frozenset[str]:
    """Words much likelier in toxic documents, the strongest first, by smoothed log odds times their frequency; counts: word, toxic and clean documents that hold it, of n and m."""
    odds = {w: ((a + 0.1) / max(1, n)) / ((b + 0.5) / max(1, m)) for w, a, b in counts if a >= max(LEAST, SHARE * n)}
    inside = {w: a for w, a, _ in counts}
    strong = [w for w, r in odds.items() if r >= RATIO]
    return frozenset(sorted(strong, key=lambda w: (-inside[w] * np.log(odds[w]), w))[:MINED])


def votes(texts: list[str | None], words: list[list[str]], mined: frozenset[str], given: np.ndarray) -> np.ndarray:
    """One row per document, one column per voter."""
    table = []
    for text, ws, label in zip(texts, words, given, strict=True):
        hits = [w for w in ws if w in mined]
        groups = {zlib.crc32(w.encode()) % GROUPS for w in hits}
        one = lambda yes, no=NONE: TOXIC if yes else no
        row = [one(not INSULTS.isdisjoint(ws)), one(sum(w in INSULTS for w in ws) >= 2), *(one(g in groups) for g in range(GROUPS))]
        row += [one(len(set(hits)) >= 2), one(len(hits) >= 3), one(len(hits) * 50 >= max(1, len(ws))), NONE if hits else CLEAN, NONE if len(hits) > 1 else CLEAN]
        row += [NONE if not INSULTS.isdisjoint(ws) or hits else CLEAN, one(bool(hits) and bool(_SHOUT.search(text or ""))), one(bool(_MASKED.search(text or "")) and bool(hits)), label]
        table.append(row)
    return np.array(table, np.int64).reshape(len(texts), GROUPS + 11)


def label_model(table: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of toxic for each row, each voter's chances (truth x vote), and each voter's share of its correlated group."""
    n, m = table.shape
    cast = np.stack([table == v for v in (CLEAN, TOXIC, NONE)], axis=2).astype(float)
    start = (table == TOXIC).sum(axis=1) - (table == CLEAN).sum(axis=1)
    post, share, chances = np.where(start > 0, 0.8, np.where(start < 0, 0.02, 0.1)).astype(float), np.ones(m), np.zeros((2, m, 3))
    for k in range(rounds):
        both = np.stack([1 - post, post])
        chances = (np.einsum("yn,nmv->ymv", both, cast) + 0.5) / (both.sum(axis=1)[:, None, None] + 1.5)
        prior = (both.sum(axis=1) + 1) / (n + 2)
        if k >= 5:  # errors that remain given the truth: voters that err together share one vote
            signed = (table == TOXIC).astype(float) - (table == CLEAN)
            rest = signed - post[:, None] * (chances[1, :, TOXIC] - chances[1, :, CLEAN]) - (1 - post)[:, None] * (chances[0, :, TOXIC] - chances[0, :, CLEAN])
            spread = np.sqrt((rest**2).mean(axis=0)) + 1e-9
            together = np.abs((rest.T @ rest) / n / np.outer(spread, spread))
            together[together < 0.1] = 0
            np.fill_diagonal(together, 1)
            share = 1 / together.sum(axis=1)
            share[-1] = 1  # the given label stands by itself
        logs = np.einsum("nmv,ymv,m->yn", cast, np.log(chances), share) + np.log(prior)[:, None]
        post = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    return post, chances, share


def fit(given: np.ndarray, found: list[np.ndarray], dense: np.ndarray, table: np.ndarray, words: list[str], times: np.ndarray, mined: frozenset[str]) -> Model:
    """By document: given label, places of its words in words (the vocabulary), dense features, votes; times: documents that hold each word."""
    post, _, _ = label_model(table)
    owner, flat = np.repeat(np.arange(len(found)), [len(f) for f in found]), np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int64)
    scale = 1 / np.sqrt(np.maximum(1, times))  # rare words learn less from one document
    w, d, b = np.zeros(len(words)), np.zeros(dense.shape[1]), -2.0
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, d, np.zeros(1))]
    for n in range(1, ROUNDS + 1):
        z = np.bincount(owner, (w * scale)[flat], len(found)) + dense @ d + b
        error = (1 / (1 + np.exp(-z)) - post) / len(found)
        slopes = [np.bincount(flat, error[owner], len(w)) * scale + DECAY * w, dense.T @ error + 1e-5 * d, np.array([error.sum()])]
        moves = []
        for (mean, square), g in zip(state, slopes, strict=True):
            mean *= 0.9
            mean += 0.1 * g
            square *= 0.99
            square += 0.01 * g * g
            moves.append(RATE * (mean / (1 - 0.9**n)) / (np.sqrt(square / (1 - 0.99**n)) + 1e-8))
        w, d, b = w - moves[0], d - moves[1], b - float(moves[2][0])
    final = w * scale
    return Model({x: float(final[i]) for i, x in enumerate(words) if abs(final[i]) > 1e-4}, mined, d, b)


def score_of(text: str | None, model: Model) -> float:
    words = words_of(text)
    z = model.bias + float(model.dense @ dense_features(words, model.mined)) + sum(map(model.weights.__getitem__, sorted(model.weights.keys() & set(words))))
    return 1 / (1 + float(np.exp(-np.clip(z, -50, 50))))


def train(docs: DataFrame, labels: DataFrame, learnable: Column, sample: int = SAMPLE) -> Model:
    """The model of a bounded sample: at most ``sample`` documents that are toxic, clean and unlabelled."""
    given = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = sampled_ids(docs.select("doc_id").where(learnable & F.col("doc_id").isNotNull()).join(given, "doc_id", "left"), ["toxic"], sample).distinct()
    kind = F.when(F.col("toxic").isNull(), NONE).otherwise((F.col("toxic") > 0).cast("int"))
    rows = written(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", kind.alias("label")).distinct(), "toxicity-sample")
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(TOXIC) or not sizes.get(CLEAN):
        return Model({}, INSULTS, np.array([2.0, 1.0, 1.0, 1.0]), -2.0)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                each = [sorted(set(words_of(t))) for t in part.column("text").to_pylist()]
                label = np.repeat(part.column("label").to_numpy(zero_copy_only=False), [len(ws) for ws in each])
                yield pa.record_batch([pa.array([w for ws in each for w in ws], pa.string()), pa.array(label, pa.int32())], names=["word", "label"])

    ship(docs.sparkSession)
    held = rows.mapInArrow(split, "word string, label int").groupBy("word").agg(*(F.count_if(F.col("label") == k).alias(f"n{k}") for k in (CLEAN, TOXIC)), F.count("*").alias("n"))
    counts = written(held.where("n >= 3"), "toxicity-words")
    # at most VOCABULARY words, and those that so many toxic documents hold; no texts come to the driver
    known = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()
    frequent = counts.where(F.col(f"n{TOXIC}") >= max(LEAST, SHARE * sizes[TOXIC])).collect()
    mined = mine([(r.word, r[f"n{TOXIC}"], r[f"n{CLEAN}"]) for r in frequent], sizes[TOXIC], sizes[CLEAN])
    words = sorted(r.word for r in known)
    shared = docs.sparkSession.sparkContext.broadcast((words, mined))
    schema = pa.schema([("turn", pa.int64()), ("label", pa.int32()), ("found", pa.list_(pa.int32())), ("dense", pa.list_(pa.float64())), ("votes", pa.list_(pa.int8()))])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, mined = shared.value
        place = {w: i for i, w in enumerate(words)}
        for batch in batches:
            for part in steps(batch):
                texts, label = part.column("text").to_pylist(), part.column("label").to_numpy(zero_copy_only=False)
                each = [words_of(t) for t in texts]
                columns = [[sorted(place[w] for w in set(ws) if w in place) for ws in each], [dense_features(ws, mined) for ws in each], votes(texts, each, mined, label).tolist()]
                yield pa.record_batch([part.column("turn"), part.column("label"), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[2:], strict=True))], schema=schema)

    got = rows.select("text", "label", F.xxhash64("text").alias("turn")).mapInArrow(measured, "turn long, label int, found array<int>, dense array<double>, votes array<byte>").toArrow().sort_by([("label", "ascending"), ("turn", "ascending")])
    times = {r.word: r.n for r in known}
    found = [np.array(x, np.int64) for x in got.column("found").to_pylist()]
    return fit(got.column("label").to_numpy(), found, np.array(got.column("dense").to_pylist()), np.array(got.column("votes").to_pylist(), np.int64), words, np.array([times[w] for w in words]), mined)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row; no shuffle."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most VOCABULARY words
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for part in steps(batch):
                yield pa.record_batch([part.column("doc_id"), pa.array([score_of(t, model) for t in part.column("text").to_pylist()], pa.float64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows: learns where crc32(doc_id) mod 5 isn't 0, scores every document."""
    held_out = fold(F.col("doc_id"), 5) == 0
    out = predict(docs, train(docs, labels, ~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
