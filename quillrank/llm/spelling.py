"""Spelling variants grouped by full neighbourhood generation.

Each word of the vocabulary emits its whole neighbourhood at one edit: every distinct deletion, replacement and insertion
over the characters that the vocabulary holds. A candidate that is itself a word is a near word, found by a hash join of
candidates with the vocabulary; what is joined differs by just one edit, so no distance is verified. A neighbourhood is
bounded by a word's length and the characters, so work grows with the vocabulary, not with its pairs.

Candidates are made as hashes first: a polynomial of a word's characters, of which each edit's is made from the word's
prefixes and suffixes in numpy. Most candidates are no words; a bit filter of the vocabulary whose size is fixed stops
most of these before a text is made of them. It lets some non-words pass and stops no word, so it changes no result.

A word's form is its near word of the largest count, if that is ``TIMES`` its own or more; forms are followed to the last
one by doubling. Counts grow by ``TIMES`` from form to form, so chains are short and never come back.

Words are counted where texts lie, in Arrow batches, and added up by Spark: a frequent word is a row of each task.

Edge cases: a null or empty text holds no words; rows that repeat count each; a null doc_id counts as an empty one; a very
long text is a step of its own, a very long word is worked off in pieces; words that tie in count are ordered by code
points; a vocabulary without words gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import release, steps, tidy, written
from quillrank.shipping import ship

#: Code points and occurrences of a word that counts; how much more frequent a form is.
LEAST, OFTEN, TIMES = 6, 5, 5
#: What words are made of; one in so many occurrences is changed by the contract's hash.
LETTERS, CHANGED = "A-Za-z\u00C0-\u00FF", 199
#: Words that a task counts before it hands them on; candidates made at a time; words of one task; bits of the filter (16 MiB).
HELD, BLOCK, SHARE, FILTER_BITS = 200_000, 1 << 20, 4096, 1 << 27
#: Odd factors of the polynomial and of the filter's place.
BASE, SPREAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Runs of up to so many bytes get their crc32 by tables.
SHORT = 64


def _crc_shifts() -> np.ndarray:
    """What a crc32 becomes when so many bytes follow it, for each of its four bytes apart: the crc32 of two texts is this of the first, exclusive or the second's."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    held = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    out = [held]
    for _ in range(SHORT):
        out.append(one[out[-1] & 255] ^ (out[-1] >> 8))
    return np.array(out)


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n over all texts, after the contract's change of one occurrence in CHANGED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts, held = _crc_shifts(), Counter()

        def out() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return found

        for batch in batches:
            for part in steps(batch):
                _count(part, shifts, held)
                if len(held) > HELD:
                    yield out()
        yield out()

    ship(docs.sparkSession)
    some = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text").mapInArrow(tidy(run), "word string, n long")
    return some.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)


def _count(part: pa.RecordBatch, shifts: np.ndarray, held: Counter) -> None:
    split = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(part.column("text"), "")), f"[^{LETTERS}]+")
    parent = np.repeat(np.arange(part.num_rows), np.asarray(pc.list_value_length(split), np.int64))
    coded = split.flatten().dictionary_encode()
    index = np.asarray(coded.indices, np.int64)
    size = np.asarray(pc.utf8_length(coded.dictionary), np.int64)
    long = size[index] >= LEAST  # before a character may go
    parent, index = parent[long], index[long]
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    own = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    many = np.fromiter(map(len, words), np.int64, len(words))
    front = np.array([zlib.crc32(f"{x}:".encode()) for x in part.column("id").to_pylist()], np.uint32)
    before, after = front[parent], np.minimum(many[index], SHORT)
    h = own[index]
    for k in range(4):
        h = h ^ shifts[after, k, before >> np.uint32(8 * k) & np.uint32(255)]
    for k in np.flatnonzero(many[index] > SHORT).tolist():
        h[k] = zlib.crc32(words[index[k]], int(before[k]))
    changed = h % CHANGED == 0
    count = np.bincount(index[~changed], minlength=len(words))
    for k in np.flatnonzero(count).tolist():
        held[words[k]] += int(count[k])
    for k, x in zip(index[changed].tolist(), h[changed].tolist(), strict=True):
        text = words[k].decode("utf-8")
        at = x % len(text)
        if len(text) > LEAST:
            held[(text[:at] + text[at + 1 :]).encode("utf-8")] += 1


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE, np.uint64)]), dtype=np.uint64)


def hashes(letters: np.ndarray) -> np.ndarray:
    """The polynomial of each row of code points: modulo 2^64, the last character's factor is 1."""
    return (letters.astype(np.uint64) * _powers(letters.shape[1])[:-1][::-1]).sum(axis=1, dtype=np.uint64)


def place(h: np.ndarray) -> np.ndarray:
    """The bit of a hash in the filter."""
    h = h ^ (h >> np.uint64(31))
    return ((h * np.uint64(SPREAD)) >> np.uint64(64 - (FILTER_BITS.bit_length() - 1))).astype(np.int64)


def edits(letters: np.ndarray, alphabet: np.ndarray, first: int, last: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Kind of edit, hash and whether it counts (rows, places from first to last, characters) of the edits of words of one length.

    A candidate that several edits give counts once: a deletion in a run of equal characters at the run's start, an
    insertion of a character only where the one before differs.
    """
    n = letters.shape[1]
    power, wide = _powers(n + 1), letters.astype(np.uint64)
    # hash of what lies before each place, and of what lies from it on
    head, tail = np.zeros((len(letters), n + 1), np.uint64), np.zeros((len(letters), n + 1), np.uint64)
    for k in range(n):
        head[:, k + 1] = head[:, k] * np.uint64(BASE) + wide[:, k]
    for k in range(n - 1, -1, -1):
        tail[:, k] = tail[:, k + 1] + wide[:, k] * power[n - 1 - k]
    at = np.arange(first, min(last, n))
    chars = alphabet.astype(np.uint64)
    again = np.zeros((len(letters), n + 1), bool)
    again[:, 1:n] = letters[:, 1:] == letters[:, :-1]
    if len(at):
        yield "deleted", (head[:, at] * power[n - 1 - at] + tail[:, at + 1])[:, :, None], ~again[:, at, None]
        base = head[:, at] * power[n - at] + tail[:, at + 1]
        yield "replaced", base[:, :, None] + power[n - 1 - at][:, None] * chars, letters[:, at, None] != alphabet
    at = np.arange(first, min(last, n + 1))
    base = head[:, at] * power[n + 1 - at] + tail[:, at]
    new = np.ones((len(letters), len(at), len(alphabet)), bool)
    inner = at > 0
    new[:, inner] = letters[:, at[inner] - 1, None] != alphabet
    yield "inserted", base[:, :, None] + power[n - at][:, None] * chars, new


def neighbours(words: list[str], alphabet: np.ndarray, bits: np.ndarray) -> Iterator[tuple[list[str], list[str]]]:
    """word and candidate, for all candidates of the words' neighbourhoods that the filter lets pass."""
    by_length: dict[int, list[str]] = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for n, same in by_length.items():
        rows = max(1, BLOCK // (len(alphabet) * (n + 1)))
        width = max(1, BLOCK // len(alphabet)) if rows == 1 else n + 1
        for k in range(0, len(same), rows):
            part = same[k : k + rows]
            letters = np.frombuffer("".join(part).encode("utf-32-le"), "<u4").reshape(len(part), n)
            for first in range(0, n + 1, width):
                left, right = [], []
                for kind, h, counts in edits(letters, alphabet, first, first + width):
                    at = place(h)
                    hit = counts & (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                    for r, p, c in zip(*(x.tolist() for x in np.nonzero(hit)), strict=True):
                        w, p = part[r], p + first
                        left.append(w)
                        right.append(w[:p] + ("" if kind == "deleted" else chr(alphabet[c])) + (w[p:] if kind == "inserted" else w[p + 1 :]))
                yield left, right


def _bits(words: DataFrame) -> np.ndarray:
    """The filter: FILTER_BITS / 8 bytes for any vocabulary, so it may go to the driver and to all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("word").to_pylist()
            at = np.zeros(len(texts), np.int64)
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            for n in np.unique(size).tolist():
                same = np.flatnonzero(size == n)
                letters = np.frombuffer("".join([texts[k] for k in same.tolist()]).encode("utf-32-le"), "<u4").reshape(len(same), n)
                at[same] = place(hashes(letters))
            yield pa.RecordBatch.from_arrays([pa.array(at)], names=["at"])

    pieces = words.select("word").mapInArrow(tidy(run), "at long").groupBy((F.col("at") / 32768).cast("int").alias("piece")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in pieces.toLocalIterator():
        out[row["piece"] * 4096 : (row["piece"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def near_pairs(words: DataFrame) -> DataFrame:
    """words: word, n, written already. word, near, near_n of every two words at one edit, in both directions."""
    spark = words.sparkSession
    letters = words.select(F.explode(F.split("word", "")).alias("c")).where("c != ''").distinct()  # fewer than 100 by LETTERS
    alphabet = np.array(sorted(ord(r["c"]) for r in letters.collect()), np.uint32)
    if not len(alphabet):
        return spark.createDataFrame([], "word string, near string, near_n long")
    shared = spark.sparkContext.broadcast((alphabet, _bits(words)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars, bits = shared.value
        for batch in batches:
            for left, right in neighbours(batch.column("word").to_pylist(), chars, bits):
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["word", "near"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words.count() // SHARE))
    every = words.select("word").repartition(parts, "word").mapInArrow(tidy(run), "word string, near string")
    return every.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "near", "near_n")


def forms(counts: DataFrame) -> DataFrame:
    """counts: word, n. word, form, root, n, n_near, form_n."""
    words = written(counts.select("word", "n"), "spelling-words")
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near")))
    found = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("b"))
    is_form = F.col("b.near_n") >= TIMES * F.col("n")
    judged = words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("b.near")).alias("form"), F.when(is_form, F.col("b.near_n")).alias("form_n"))
    judged = written(judged, "spelling-forms")
    release(words)
    roots = last_forms(judged.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def last_forms(steps: DataFrame) -> DataFrame:
    """word and root: the end of each chain of steps, by doubling; the number of rounds is the logarithm of the longest chain."""
    roots = written(steps, "spelling-roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("_last"))
        old = roots
        new = written(roots.join(further, "root", "left").select("word", F.coalesce("_last", "root").alias("root"), F.col("_last").isNotNull().alias("moved")), "spelling-roots")
        release(old)
        roots = new.select("word", "root")
        roots._quillrank_path = new._quillrank_path
        if not new.where("moved").take(1):
            return roots


#: DuckDB SQL of the contract's rows; near words are found another way, by texts that two words share when a character of each goes.
SQL = rf"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
longer AS (SELECT id, run, count(*) AS k FROM runs WHERE length(run) >= {LEAST} GROUP BY ALL),
hashed AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(b)), lambda i: CAST('0x' || substr(hex(b), 2 * i + 1, 2) AS BIGINT))),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM (SELECT *, encode(id || ':' || run) AS b FROM longer), crc),
changed AS (SELECT CASE WHEN h % {CHANGED} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed),
vocab AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM changed WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(k) >= {OFTEN}),
gone AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM (SELECT *, unnest(range(length(word))) AS i FROM vocab)),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM gone a JOIN gone b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT g.word, v.word, v.n FROM gone g JOIN vocab v ON v.word = g.d UNION SELECT v.word, g.word, g.n FROM gone g JOIN vocab v ON v.word = g.d),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
judged AS (SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= {TIMES} * v.n THEN b.near END AS form, CASE WHEN b.near_n >= {TIMES} * v.n THEN b.near_n END AS form_n FROM vocab v LEFT JOIN best b USING (word)),
chain AS (WITH RECURSIVE c AS (SELECT word, word AS root FROM judged UNION ALL SELECT c.word, j.form FROM c JOIN judged j ON j.word = c.root WHERE j.form IS NOT NULL) SELECT c.word, c.root FROM c JOIN judged j ON j.word = c.root WHERE j.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM judged JOIN chain USING (word)
"""
