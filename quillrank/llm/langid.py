"""Language ID by a linear-chain conditional random field over words.

Each word gets a score per language from hashed affix, n-gram and lexicon features; learned transitions tie
neighbouring words; forward-backward gives each word's posterior. A document's language has the largest mean
posterior over all its words, so code-switched texts are labelled word by word and summed.

Training texts carry one language each, so code switching is imitated: a training sequence joins stretches of
up to three training documents. The field starts from at most ``SAMPLE`` documents of each language (chosen by a
hash of doc_id), each with all its words. Where there are more, every training document is then learned from where it lies: each task
goes on from that start through all its documents, and what the tasks have changed is averaged, a feature's weights by how often each met
it. Every word of every text is labelled. A sequence is a whole line, of any length.

Edge cases: a null or empty text or one without letters is ``und`` with score 0; documents without a language
are never learned from; without any training document all are ``und``; ties go to the language first by code
point; repeated rows get equal rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import claim, fold, release, sampled_ids, steps, tidy, written
from quillrank.shipping import ship

UNKNOWN = "und"
#: The start is fitted to at most so many documents of each language, with all their words; all others follow.
SAMPLE = 250
#: Words of a step behind the start, its rate, and features whose weights are averaged together.
TURN, TURN_RATE, CELLS = 50_000, 0.03, 4096
#: Hashed features; a word's n-grams; lexicon entries of each language.
DIMS, GRAMS, LEXICON = 1 << 18, (1, 2, 3), 300
ROUNDS, RATE, DECAY = 30, 0.05, 1e-5
#: Words that forward-backward takes in one block.
BLOCK = 128
#: Bytes of text that a worker judges at once.
STEP = 512 << 10
#: A stage keeps what reaches so much of the least score and support that calibrated documents reach; words that a short text is filled up with.
SLACK, FILL = (0.75, 0.9), 20
#: Words that each of a worker's two generations of memory holds, and their letters.
MEMORY, MEMORY_LETTERS = 150_000, 4 << 20
_WORD = re.compile(r"[^\W\d_]+")
_STATE: dict = {}


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # DIMS x K
    moves: np.ndarray  # K x K, logarithms
    start: np.ndarray  # K
    lexicons: tuple[frozenset[str], ...]
    seen: np.ndarray  # DIMS, whether training met a feature


def words_of(line: str) -> list[str]:
    """Runs of letters."""
    return _WORD.findall(line)


def features(words: list[str], lexicons: tuple[frozenset[str], ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words at once and the word that each belongs to: n-grams within marks of start and end (those at an end are short affixes), affixes of 4 letters, the word, and the lexicons that hold it."""
    u = np.uint64
    code = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), "<u4").astype(u)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(code)) - start[owner]
    each = np.arange(len(words))
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def add(hashes: np.ndarray, of: np.ndarray) -> None:
        x = (hashes + u(len(found) + 1)) * u(0x9E3779B97F4A7C15)
        found.append(((x ^ (x >> u(29))) * u(0xBF58476D1CE4E5B9) >> u(40), of))

    step = u(0x100000001B3)
    with np.errstate(over="ignore"):
        for n in GRAMS:
            end = len(code) - n + 1
            h = np.zeros(max(0, end), u)
            for j in range(n):
                h = h * step + code[j : j + len(h)]
            whole = (size[owner] - place)[: len(h)] >= n
            add(h[whole], owner[: len(h)][whole])
        head, tail = np.zeros(len(words), u), np.zeros(len(words), u)
        for j in range(5):  # a mark and 4 letters, or all that there are
            at = np.minimum(j, size - 1)
            head = head * step + np.where(j < size, code[start + at], u(0))
            tail = tail * step + np.where(j < size, code[start + size - 1 - at], u(0))
        power = np.concatenate([[u(1)], np.cumprod(np.full(int(size.max(initial=1)), step))])
        add(head, each)
        add(tail, each)
        add(np.add.reduceat(code * power[place], start) if len(words) else head, each)
        for held in lexicons:
            hit = np.flatnonzero(np.fromiter((w in held for w in words), bool, len(words)))
            add(np.zeros(len(hit), u), hit)
    flat, of = (np.concatenate(x) for x in zip(*found, strict=True))
    return (flat % u(DIMS)).astype(np.int64), of


def _scores(words: list[str], model: Model) -> np.ndarray:
    """Of each word, its score per language and, last, the share of its features that training met."""
    flat, owner = features(words, model.lexicons)
    size = np.maximum(1, np.bincount(owner, minlength=len(words)))
    return np.stack([*(np.bincount(owner, model.weights[flat, c], len(words)) for c in range(len(model.languages))), np.bincount(owner, model.seen[flat], len(words)) / size], axis=1)


def _sharp(x: np.ndarray, axes: int | tuple[int, ...]) -> np.ndarray:
    return x / x.sum(axis=axes, keepdims=True)


def posteriors(emissions: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Forward-backward over all sequences (none empty) at once; emissions are the sequences' words one after another.

    A sequence is worked on in blocks of ``BLOCK`` words, all blocks of all sequences side by side. What a block does to a
    message from either end is a matrix; the messages go from block to block through these first, so the result is that
    of one pass over the whole sequence. Returns each word's posterior, and with pairs the expected number of each
    transition.
    """
    k = len(start)
    shift = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    step, begin = np.exp(moves), np.exp(start)
    parts = -(-lengths // BLOCK)
    head = np.cumsum(parts) - parts  # each sequence's first block
    turn = np.arange(parts.sum()) - np.repeat(head, parts)
    first = np.repeat(np.cumsum(lengths) - lengths, parts) + turn * BLOCK
    size = np.minimum(BLOCK, np.repeat(lengths, parts) - turn * BLOCK)
    into, back = np.full((len(size), k), 1.0 / k), np.full((len(size), k), 1.0 / k)  # message before a block, at its last word from behind
    many = np.flatnonzero(np.repeat(parts, parts) > 1)
    if len(many):
        held = many[np.argsort(-size[many], kind="stable")]
        through = np.tile(np.eye(k), (len(size), 1, 1))
        for t in range(BLOCK):
            at = held[: np.searchsorted(-size[held], -t, side="left")]
            if not len(at):
                break
            moved = through[at] @ step
            if t == 0:
                moved[turn[at] == 0] = np.diag(begin)
            through[at] = _sharp(moved * shift[first[at] + t][:, None, :], (1, 2))
        long = np.flatnonzero(parts > 1)
        long = long[np.argsort(-parts[long], kind="stable")]
        for j in range(1, int(parts[long[0]])):
            at = head[long[: np.searchsorted(-parts[long], -j, side="left")]] + j
            before = np.ones((len(at), k)) if j == 1 else into[at - 1]
            into[at] = _sharp(np.einsum("nk,nkl->nl", before, through[at - 1]), 1)
        for j in range(int(parts[long[0]]) - 1, 0, -1):
            at = head[long[: np.searchsorted(-parts[long], -j, side="left")]] + j
            back[at - 1] = _sharp(np.einsum("nkl,nl->nk", through[at], back[at]), 1)
    order = np.argsort(-size, kind="stable")
    first, size, turn, into, back = first[order], size[order], turn[order], into[order], back[order]
    live = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
    forward, backward = np.empty_like(shift), np.empty_like(shift)
    for t, n in enumerate(live):
        at = first[:n] + t
        come = np.where((turn == 0)[:, None], begin, into @ step) if t == 0 else forward[at - 1] @ step
        forward[at] = _sharp(shift[at] * come, 1)
    for t in range(len(live) - 1, -1, -1):
        at = first[: live[t]] + t
        y = back[: live[t]].copy()
        if t + 1 < len(live) and (n := live[t + 1]):
            y[:n] = _sharp((backward[at[:n] + 1] * shift[at[:n] + 1]) @ step.T, 1)
        backward[at] = y
    expected = np.zeros_like(moves)
    if pairs:
        inner = np.ones(len(shift), bool)
        inner[np.cumsum(lengths) - 1] = False
        inner = np.flatnonzero(inner)
        for a in range(0, len(inner), 1 << 16):
            i = inner[a : a + (1 << 16)]
            expected += _sharp(forward[i][:, :, None] * step * (backward[i + 1] * shift[i + 1])[:, None, :], (1, 2)).sum(axis=0)
    return _sharp(forward * backward, 1), expected


def fit(rows: list[tuple[str, str]]) -> Model:
    """rows: text and language. Adam on the mean negative log-likelihood; the draws of stretches are seeded."""
    languages = tuple(sorted({lang for _, lang in rows}))
    k = len(languages)
    texts = [(words_of((text or "").lower()), languages.index(lang)) for text, lang in sorted(rows, key=lambda r: (r[1], r[0] or ""))]
    texts = [x for x in texts if x[0]]
    counts = [Counter(w for ws, at in texts if at == i for w in ws) for i in range(k)]
    lexicons = tuple(frozenset(w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]) for c in counts)
    model = Model(languages, np.zeros((DIMS, k)), np.zeros((k, k)), np.zeros(k), lexicons, np.zeros(DIMS, bool))
    if not texts or k == 1:
        if texts:
            model.seen[features(list(counts[0]), lexicons)[0]] = True
        return model
    draw = np.random.default_rng(0)
    words, labels, lengths = [], [], []
    pieces = [(ws[a : a + 40], at) for ws, at in texts for a in range(0, len(ws), 40)]
    pieces = [pieces[i] for i in draw.permutation(len(pieces))]
    at = 0
    while at < len(pieces):  # a sequence joins one to three stretches
        part = pieces[at : at + int(draw.integers(1, 4))]
        at += len(part)
        words += [w for ws, _ in part for w in ws]
        labels += [lang for ws, lang in part for _ in ws]
        lengths.append(sum(len(ws) for ws, _ in part))
    lengths, gold = np.array(lengths), np.array(labels)
    kinds = {w: i for i, w in enumerate(dict.fromkeys(words))}
    which = np.array([kinds[w] for w in words])
    flat, owner = features(list(kinds), lexicons)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    inner = np.ones(len(words), bool)
    inner[starts] = False
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), 1)
    begun = np.bincount(gold[starts], minlength=k)
    values = [model.weights, model.moves, model.start]
    means, squares = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    cells = np.unique(flat)
    model.seen[cells] = True
    for n in range(1, ROUNDS + 1):
        emit = np.stack([np.bincount(owner, values[0][flat, c], len(kinds)) for c in range(k)], axis=1)
        post, pairs = posteriors(emit[which], lengths, values[1], values[2], pairs=True)
        error = post.copy()
        error[np.arange(len(gold)), gold] -= 1
        by_kind = np.stack([np.bincount(which, error[:, c], len(kinds)) for c in range(k)], axis=1)
        slope = np.stack([np.bincount(flat, by_kind[owner, c], DIMS) for c in range(k)], axis=1)
        slopes = [slope / len(words) + DECAY * values[0], (pairs - seen) / len(words) + DECAY * values[1], (post[starts].sum(axis=0) - begun) / len(words) + DECAY * values[2]]
        for i, g in enumerate(slopes):
            rows_of = cells if i == 0 else slice(None)
            means[i][rows_of] = 0.9 * means[i][rows_of] + 0.1 * g[rows_of]
            squares[i][rows_of] = 0.99 * squares[i][rows_of] + 0.01 * g[rows_of] ** 2
            values[i][rows_of] -= RATE * (means[i][rows_of] / (1 - 0.9**n)) / (np.sqrt(squares[i][rows_of] / (1 - 0.99**n)) + 1e-7)
    return Model(languages, values[0].astype(np.float32), values[1], values[2], lexicons, model.seen)


class Learner:
    """A task's own course through its documents: from the start's weights on, a step for each ``TURN`` words of one to three joined stretches."""

    def __init__(self, start: Model):
        self.model, self.k = start, len(start.languages)
        self.at = {lang: i for i, lang in enumerate(start.languages)}
        self.values = [start.weights.astype(float), start.moves.astype(float), start.start.astype(float)]
        self.means, self.squares = [np.zeros_like(v) for v in self.values], [np.zeros_like(v) for v in self.values]
        self.met, self.words, self.turn, self.held, self.place = np.zeros(DIMS), 0, 0, {}, np.zeros(DIMS, np.int64)
        self.draw, self.pieces, self.waiting = np.random.default_rng(0), [], 0

    def read(self, text: str, lang: str) -> None:
        words = words_of(text.lower())
        for a in range(0, len(words), 40):
            self.pieces.append((words[a : a + 40], self.at[lang]))
            self.waiting += len(self.pieces[-1][0])
            if self.waiting >= TURN:
                self.step()

    def _features(self, kinds: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Features of all words, and how many each has."""
        new = [w for w in kinds if w not in self.held]
        if len(self.held) + len(new) > MEMORY:
            self.held, new = {}, kinds
        for a in range(0, len(new), 10_000):
            flat, owner = features(new[a : a + 10_000], self.model.lexicons)
            flat = flat[np.argsort(owner, kind="stable")].astype(np.int32)
            ends = np.cumsum(np.bincount(owner, minlength=len(new[a : a + 10_000]))).tolist()
            self.held.update(zip(new[a : a + 10_000], [flat[i:j] for i, j in zip([0, *ends], ends, strict=False)], strict=True))
        found = [self.held[w] for w in kinds]
        return np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))

    def step(self) -> None:
        if not self.pieces:
            return
        pieces = [self.pieces[i] for i in self.draw.permutation(len(self.pieces))]
        self.pieces, self.waiting, at, lengths = [], 0, 0, []
        while at < len(pieces):
            part = pieces[at : at + int(self.draw.integers(1, 4))]
            at += len(part)
            lengths.append(sum(len(ws) for ws, _ in part))
        words, gold, lengths = [w for ws, _ in pieces for w in ws], np.repeat([lang for _, lang in pieces], [len(ws) for ws, _ in pieces]), np.array(lengths)
        coded = pa.array(words).dictionary_encode()
        which, kinds = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        flat, size = self._features(kinds)
        k, weights = self.k, self.values[0]
        cells = np.flatnonzero(np.bincount(flat, minlength=DIMS))
        self.place[cells] = np.arange(len(cells))
        place = self.place[flat]
        emit = np.add.reduceat(weights[cells][place], np.cumsum(size) - size, axis=0)
        post, pairs = posteriors(emit[which], lengths, self.values[1], self.values[2], pairs=True)
        starts = np.cumsum(lengths) - lengths
        inner = np.ones(len(words), bool)
        inner[starts] = False
        seen = np.zeros((k, k))
        np.add.at(seen, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), 1)
        begun = post[starts].sum(axis=0) - np.bincount(gold[starts], minlength=k)
        post[np.arange(len(gold)), gold] -= 1
        by_kind = np.stack([np.bincount(which, post[:, c], len(kinds)) for c in range(k)], axis=1)
        self.met[cells] += np.bincount(place, np.repeat(np.bincount(which, minlength=len(kinds)), size), len(cells))
        slope = np.stack([np.bincount(place, np.repeat(by_kind[:, c], size), len(cells)) for c in range(k)], axis=1)
        slopes = [slope / len(words) + DECAY * weights[cells], (pairs - seen) / len(words) + DECAY * self.values[1], begun / len(words)]
        self.turn, self.words = self.turn + 1, self.words + len(words)
        for i, g in enumerate(slopes):
            rows = cells if i == 0 else slice(None)
            self.means[i][rows] = 0.9 * self.means[i][rows] + 0.1 * g
            self.squares[i][rows] = 0.99 * self.squares[i][rows] + 0.01 * g**2
            self.values[i][rows] -= TURN_RATE * (self.means[i][rows] / (1 - 0.9**self.turn)) / (np.sqrt(self.squares[i][rows] / (1 - 0.99**self.turn)) + 1e-7)

    def changes(self) -> Iterator[tuple[int, bytes]]:
        """Of each block of ``CELLS`` features that was met, how often and the change times that; last, as block -1, words and the change of all else times that."""
        self.step()
        change = (self.values[0] - self.model.weights) * self.met[:, None]
        for a in range(0, DIMS, CELLS):
            if self.met[a : a + CELLS].any():
                yield a // CELLS, np.column_stack([self.met[a : a + CELLS], change[a : a + CELLS]]).astype("<f4").tobytes()
        rest = np.concatenate([(self.values[1] - self.model.moves).ravel(), self.values[2] - self.model.start])
        yield -1, np.concatenate([[1.0], rest]).astype("<f4").tobytes() if not self.words else (np.concatenate([[1.0], rest]) * self.words).astype("<f4").tobytes()


def learned_from_all(start: Model, kept: DataFrame, rate: float) -> Model:
    """The start after every row of kept (text, lang) has been learned from once, where it lies. rate: documents for each one of the start.

    A feature counts as met if it is as frequent as one that the start met once.
    """
    ship(kept.sparkSession)
    held, k = kept.sparkSession.sparkContext.broadcast(start), len(start.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        claim("langid-learner", lambda: None)
        learner, part = Learner(held.value), TaskContext.get().partitionId()
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                learner.read(text, lang)
        if learner.words or learner.pieces:
            for block, data in learner.changes():
                yield pa.record_batch([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([data], pa.binary())], names=["block", "part", "data"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None

        def mean() -> pa.RecordBatch:
            cells = total.reshape(-1, k + 1 if at >= 0 else len(total))
            cells[:, 1:] /= np.maximum(cells[:, :1], 1)
            return pa.record_batch([pa.array([at], pa.int32()), pa.array([cells.astype("<f4").tobytes()], pa.binary())], names=["block", "data"])

        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if block != at:
                    if at is not None:
                        yield mean()
                    at, total = block, 0.0
                total = total + np.frombuffer(data, "<f4").astype(float)
        if at is not None:
            yield mean()

    # a row for each task and block of features; parts are added in order, so that a rerun over the same files has the same sums
    changes = kept.select("text", "lang").mapInArrow(tidy(run), "block int, part int, data binary").repartition("block").sortWithinPartitions("block", "part")
    weights, met, moves, first = start.weights.astype(float), np.zeros(DIMS), start.moves, start.start
    for r in changes.select("block", "data").mapInArrow(summed, "block int, data binary").collect():  # DIMS x (K + 1) numbers, whatever the input's size
        x = np.frombuffer(bytes(r.data), "<f4").astype(float)
        if r.block < 0:
            moves, first = moves + x[1 : 1 + k * k].reshape(k, k), first + x[1 + k * k :]
        else:
            cells, rows = x.reshape(-1, k + 1), slice(r.block * CELLS, (r.block + 1) * CELLS)
            met[rows], weights[rows] = cells[:, 0], weights[rows] + cells[:, 1:]
    return Model(start.languages, weights.astype(np.float32), moves, first, start.lexicons, met >= max(1.0, rate))


class Labeller:
    """A model with the words it has met, so that features are made once for each word."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.known, self.letters, self.table = {}, 0, np.zeros((0, len(self.model.languages) + 1), np.float32)
        self.old, self.old_table = self.known, self.table

    def _indices(self, words: list[str]) -> np.ndarray:
        all_words = set(words)
        new = all_words.difference(self.known)
        if len(self.known) + len(new) > MEMORY or self.letters > MEMORY_LETTERS:  # what is used again comes back from the older generation
            self.old, self.old_table = self.known, self.table
            self.known, self.letters, self.table, new = {}, 0, self.table[:0], all_words
        back = list(new.intersection(self.old))
        made = list(new.difference(self.old))
        if new:
            self.known.update((w, len(self.table) + i) for i, w in enumerate(back + made))
            self.letters += sum(map(len, new))
            parts = [self.old_table[[self.old[w] for w in back]]] if back else []
            parts += [_scores(made[i : i + 10_000], self.model).astype(np.float32) for i in range(0, len(made), 10_000)]
            self.table = np.concatenate([self.table, *parts])
        known = self.known
        return np.array([known[w] for w in words], np.int64)

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: language, the language's mean posterior, mean share of features that training met, words."""
        words: list[str] = []
        lengths, owners = [], []
        for i, text in enumerate(texts):
            lines = list(map(words_of, (text or "").lower().split("\n")))
            if not any(c.isalpha() for found in lines for w in found for c in w):
                continue  # nothing, or only signs such as fractions
            for found in lines:
                if found:
                    words += found
                    lengths.append(len(found))
                    owners.append(i)
        langs, scores, support = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        if not words or not self.model.languages:
            return langs, scores, support, np.zeros(len(texts), np.int64)
        lengths = np.array(lengths)
        rows = self._emissions(words)
        post, _ = posteriors(rows[:, :-1], lengths, self.model.moves, self.model.start)
        of = np.repeat(np.array(owners), lengths)
        total = np.bincount(of, minlength=len(texts))
        mean = np.stack([np.bincount(of, x, len(texts)) for x in (*post.T, rows[:, -1])], axis=1) / np.maximum(total, 1)[:, None]
        best = mean[:, :-1].argmax(axis=1)
        for i in np.flatnonzero(total):
            langs[i], scores[i], support[i] = self.model.languages[best[i]], min(1.0, mean[i, best[i]]), mean[i, -1]
        return langs, scores, support, total

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores, *_ = self.judge(texts)
        return langs, scores.tolist()

    def _emissions(self, words: list[str]) -> np.ndarray:
        at = self._indices(words)
        return self.table[at]


def train(docs: DataFrame, learnable: Column, sample: int = SAMPLE) -> Model:
    """The model of all documents with a language among those learnable: fitted to at most ``sample`` of each language, and where there are more, led on through all of them."""
    kept = docs.select("doc_id", "text", "lang").where(learnable & F.col("lang").isNotNull() & (F.trim("text") != ""))
    ids = sampled_ids(kept, ["lang"], sample).select("doc_id", "lang").distinct()
    rows = kept.join(F.broadcast(ids), ["doc_id", "lang"]).select("text", "lang").distinct()
    ship(docs.sparkSession)

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [row for batch in batches for row in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True)]
        yield pa.record_batch([pa.array([packed(fit(held))], pa.binary())], names=["model"])

    # One task fits the bounded set, so that neither its texts nor the fit's arrays are in the driver's memory; the driver gets the model.
    found = rows.repartition(1).mapInArrow(tidy(learned), "model binary").collect()
    if not found:
        return fit([])
    start, sizes = unpacked(bytes(found[0].model)), [r["count"] for r in kept.groupBy("lang").count().collect()]
    return learned_from_all(start, kept, sum(sizes) / sum(min(n, sample) for n in sizes)) if max(sizes) > sample else start


def packed(model: Model) -> bytes:
    """A model in bytes, without the weights of features that training never met: they are 0."""
    met = np.flatnonzero(model.seen).astype(np.int32)
    return zlib.compress(pickle.dumps((model.languages, met, model.weights[met], model.moves, model.start, model.lexicons)), 1)


def unpacked(data: bytes) -> Model:
    languages, met, some, moves, start, lexicons = pickle.loads(zlib.decompress(data))
    weights, seen = np.zeros((DIMS, len(languages)), some.dtype), np.zeros(DIMS, bool)
    weights[met], seen[met] = some, True
    return Model(languages, weights, moves, start, lexicons, seen)


def _labeller(held, token: str) -> Labeller:
    """This worker's labeller of a broadcast model; it knows the words that a task has met until the task ends."""
    claim("langid", _STATE.clear)
    if _STATE.get("token") != token:
        _STATE.update(token=token, labeller=Labeller(held.value))
    return _STATE["labeller"]


def predict(docs: DataFrame, model: Model, more: bool = False) -> DataFrame:
    """doc_id, lang_pred and score of every row, and with more support and words; no shuffle."""
    ship(docs.sparkSession)
    held, token = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # DIMS x K numbers, whatever the input's size
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())] + [("support", pa.float64()), ("words", pa.int64())] * more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _labeller(held, token)
        for batch in batches:
            for part in steps(batch, size_bytes=STEP):
                found = labeller.judge(part.column("text").to_pylist())
                yield pa.record_batch([part.column("doc_id"), *(pa.array(x, f.type) for x, f in zip(found, list(schema)[1:], strict=False))], schema=schema)
        labeller.forget()

    kind = "doc_id long, lang_pred string, score double" + ", support double, words long" * more
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), kind)


def identify(docs: DataFrame) -> DataFrame:
    """The contract's rows: learns where crc32(doc_id) mod 4 isn't 2, labels every document."""
    held_out = fold(F.col("doc_id"), 4) == 2
    out = predict(docs, train(docs, ~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@dataclass(frozen=True)
class Limits:
    """The least score and support of a document, and what short texts are filled up with."""

    least: tuple[float, float] = (0.0, 0.0)
    usual: tuple[float, float] = (1.0, 1.0)

    def filled(self, values: tuple[np.ndarray, np.ndarray], words: np.ndarray) -> list[np.ndarray]:
        return [(words * x + FILL * u) / (words + FILL) for x, u in zip(values, self.usual, strict=True)]

    def passes(self, langs: list[str], scores: np.ndarray, support: np.ndarray, words: np.ndarray) -> np.ndarray:
        found = self.filled((scores, support), words)
        return (np.array(langs) != UNKNOWN) & (found[0] >= self.least[0]) & (found[1] >= self.least[1])


def calibrate(docs: DataFrame, model: Model, sample: int = SAMPLE) -> Limits:
    """Limits from all labelled documents, which the model has not learned from: by a margin below what all reach but one in ``sample`` of each language (up to twice as many documents: below the least)."""
    kept = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & (F.trim("text") != ""))
    judged = written(predict(kept, model, more=True).where(F.col("lang_pred") != UNKNOWN).select("score", "support", "words"), "language-limits")
    # values to 4 digits, so that what is counted stays small
    found = judged.agg(F.count("*").alias("n"), *(F.percentile(F.round(c, 4), 0.5).alias(c) for c in ("score", "support"))).first()
    limits = Limits()
    if found.n:
        usual, beyond = (found.score, found.support), found.n // (sample * len(model.languages))
        least = []
        for c, u, slack in zip(("score", "support"), usual, SLACK, strict=True):
            filled = (F.col("words") * F.col(c) + FILL * u) / (F.col("words") + FILL)
            counts = sorted((r.v, r["count"]) for r in judged.groupBy(F.floor(filled * 10_000).alias("v")).count().collect())
            before = np.cumsum([n for _, n in counts])
            least.append(slack * counts[int(np.searchsorted(before, max(1, beyond)))][0] / 10_000)
        limits = Limits(tuple(least), usual)
    release(judged)
    return limits


def filtered(docs: DataFrame) -> DataFrame:
    """The documents (all columns and rows) in a language that the field knows.

    Rejected are those without letters, those whose words agree on no language (the mean posterior of the best one) and
    those whose words are not made of what training met (the share of features known). Both limits come from labelled
    documents that the field has not learned from. The label goes by the text, so rows are judged with their columns
    beside them rather than joined.
    """
    learnable = fold(F.col("doc_id"), 4) != 2
    model = train(docs, learnable)
    limits = calibrate(docs.where(~learnable), model)
    ship(docs.sparkSession)
    held, token = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _labeller(held, token)
        for batch in batches:
            for part in steps(batch, batch.schema.names[at], STEP):
                yield part.filter(pa.array(limits.passes(*labeller.judge(part.column(at).to_pylist()))))
        labeller.forget()

    return docs.mapInArrow(tidy(run), docs.schema)
