"""Operators 11 to 13 against plain versions: nulls, empty and long texts, ties, repeats, empty tables, clashing names, hot keys."""

import collections
import datetime
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillrank.llm import rolling, spelling, subwords

CLASHING = ("word", "n", "near", "root", "ids", "series", "time", "cents", "chunk", "change", "run", "id", "h")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns})


# ---- pieces


def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model())


ODD = [None, "", " ", "   ", "\n", "a", " a", "a ", "a  b", "▁", "a▁b", "▁▁ a", "<s>", "</s><unk>", "<0x0A>", "\x00\t\r\n", "ﬁ　é", "中文 門", "😀😀 x", "The  quick\n\n  brown fox", "x" * 3000, " " * 500 + "a", "ab" * 400 + " " + "in" * 30]


def test_pieces_are_those_of_the_library():
    pieces, lib, draw = subwords.Pieces(model()), library(), random.Random(5)
    signs = " ▁\nab the in ing  ééü中文門😀\x00\t<s></s>TtHhEe.,-'　ﬁ0123"
    texts = ODD + ["".join(draw.choice(signs) for _ in range(draw.randrange(300 if k % 40 == 0 else 40))) for k in range(4000)]
    for t, ids in zip(texts, pieces.encode(pa.array(texts)), strict=True):
        assert ids.tolist() == lib.encode(t or ""), t
        assert pieces.decode(ids) == lib.decode(ids.tolist())


def test_heap_and_matrix_agree():
    pieces, draw = subwords.Pieces(model()), random.Random(8)
    for _ in range(300):
        text = "".join(draw.choice("theinganrst▁"[: draw.randrange(2, 12)]) for _ in range(draw.randrange(2, 24)))
        row = np.array([[pieces.ids[c] for c in text]])
        assert [x for x in pieces.merged_rows(row)[0].tolist() if x >= 0] == [pieces.ids[s] for s in pieces.merged(text)], text


def test_slices_decode_like_the_whole(monkeypatch):
    monkeypatch.setattr(subwords, "SLICE", 7)
    pieces, lib = subwords.Pieces(model()), library()
    for t in ODD[1:] + ["one two  three\nfour " * 9, "é" * 50 + " " + "門" * 20]:
        ids = np.array(lib.encode(t), np.int64)
        assert pieces.decode(ids) == lib.decode(ids.tolist()), t


def test_a_difference_from_the_library_raises(monkeypatch):
    pieces = subwords.Pieces(model())
    monkeypatch.setattr(pieces, "merge_all", lambda parts: (np.zeros(len(parts), "<i4"), np.ones(len(parts), np.int64)))
    with pytest.raises(ValueError):
        pieces.encode(pa.array(["hello there"]))


def test_piece_codec_over_rows(spark):
    lib = library()
    draw = random.Random(2)
    texts = ODD + [" ".join("".join(draw.choice("abcdeé.,") for _ in range(draw.randrange(1, 12))) for _ in range(60)) for _ in range(40)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, ODD[9]), (3, ODD[9]), (None, "no id")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = collections.Counter((i, len(x), sha(",".join(map(str, x))), sha(lib.decode(x))) for i, t in rows for x in [lib.encode(t or "")])
    assert collections.Counter(map(tuple, subwords.digest(docs, model()).collect())) == want
    encoded = subwords.encode(docs, model())
    assert {(r.doc_id, tuple(r.ids)) for r in encoded.collect()} == {(i, tuple(lib.encode(t or ""))) for i, t in rows}
    back = {(r.doc_id, r.text) for r in subwords.decode(encoded, model()).collect()}
    assert back == {(i, lib.decode(lib.encode(t or ""))) for i, t in rows}
    assert subwords.digest(docs.limit(0), model()).count() == 0


# ---- spelling variants


def brute_vocabulary(rows):
    counts = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_forms(vocabulary):
    form, near = {}, {}
    for w, n in vocabulary.items():
        near[w] = [v for v in vocabulary if one_edit(w, v)]
        best = min(near[w], key=lambda v: (-vocabulary[v], v), default=None)
        form[w] = best if best is not None and vocabulary[best] >= 5 * n else None
    out = set()
    for w, n in vocabulary.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), vocabulary.get(form[w])))
    return out


def test_spelling_variants_against_all_pairs(spark):
    draw = random.Random(4)
    base = ["wonderful", "zeitgeist", "ÉTÉÉtéé", "aaaaaaab", "naïveté×÷", "wanderer"]
    words = []
    for b in base:
        words += [b] * 700 + [b[:3] + "x" + b[3:]] * 90 + [b[:2] + b[3:]] * 60 + [b[:-1] + "q"] * 11 + [b[:-1] + "qq"] * 6 + [b.upper()] * 7
    words += ["".join(draw.choice("abc") for _ in range(draw.randrange(6, 8))) for _ in range(4000)] + ["l" * 300] * 30 + ["l" * 301] * 5 + ["short"] * 50
    draw.shuffle(words)
    rows = [(k, " ".join(words[40 * k : 40 * k + 40]) + draw.choice([".", "\n", " 12,"])) for k in range(len(words) // 40)]
    rows += [(None, "wonderful wanderer"), (5, None), (6, ""), (7, " ".join(words[:3000])), (8, "wonderful " * 9), (8, "wonderful " * 9)]
    vocabulary = brute_vocabulary(rows)
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)
    counts = spelling.word_counts(docs)
    assert {r.word: r.n for r in counts.collect()} == vocabulary
    found = spelling.forms(counts).collect()
    assert len(found) == len(vocabulary) and {tuple(r) for r in found} == brute_forms(vocabulary)
    assert any(r.root not in (r.word, r.form) for r in found)  # a chain of two
    assert spelling.forms(spelling.word_counts(docs.limit(0))).count() == 0


def test_neighbourhoods_are_whole_and_distinct(monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 40)
    everything = np.full(spelling.FILTER_BITS // 8, 255, np.uint8)
    alphabet = np.array(sorted(map(ord, "abé")), np.uint32)
    for w in ("aab", "aaaa", "abéba", "b"):
        got = [c for _, right in spelling.neighbours([w], alphabet, everything) for c in right]
        want = {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + c + w[k + d :] for k in range(len(w) + 1) for c in "abé" for d in (0, 1)[: 1 + (k < len(w))]} - {w}
        assert len(got) == len(set(got)) and set(got) == want
        for kind, h, counts in spelling.edits(np.array([list(map(ord, w))], np.uint32), alphabet, 0, len(w) + 1):
            for r, p, c in zip(*np.nonzero(counts), strict=True):
                text = w[:p] + ("" if kind == "deleted" else chr(alphabet[c])) + (w[p:] if kind == "inserted" else w[p + 1 :])
                assert spelling.hashes(np.array([list(map(ord, text))], np.uint32))[0] == h[r, p, c if h.shape[2] > 1 else 0]


# ---- rolling medians


def brute_windows(rows):
    """rows: click_id, ts, kind, value without repeats."""
    out = set()
    cents = lambda v: None if v is None or not math.isfinite(v) else math.floor(100 * v + 0.5)
    for i, ts, kind, value in rows:
        if ts is None:
            continue
        w = sorted(c for _, t, k, v in rows if t is not None and k == kind and ts - datetime.timedelta(hours=1) <= t <= ts and (c := cents(v)) is not None)
        n, median, mad, far = len(w), None, None, None
        if n >= 2:
            median = w[(n - 1) // 2] + w[n // 2]
            d = sorted(abs(2 * c - median) for c in w)
            mad = d[(n - 1) // 2] + d[n // 2]
            far = None if cents(value) is None else 2 * abs(2 * cents(value) - median) > 3 * mad
        out.add((i, kind, n, median, mad, far))
    return out


CLICKS = "click_id long, ts timestamp_ntz, kind string, value double"


@pytest.mark.parametrize("events", [20, 50_000])
def test_rolling_medians_against_plain_code(spark, monkeypatch, events):
    monkeypatch.setattr(rolling.windows, "__defaults__", (events,))
    draw, start = random.Random(6), datetime.datetime(2024, 1, 1)
    rows = []
    for k in range(900):
        hot = k % 3 == 0  # a third of all clicks: one kind, one moment
        at = start + datetime.timedelta(hours=2) if hot else start + datetime.timedelta(microseconds=draw.choice([draw.randrange(4 * 3600 * 10**6), 60 * 10**6 * draw.randrange(240)]))
        value = None if draw.random() < 0.05 else draw.choice([ math.nan, math.inf, -0.005, 0.0]) if draw.random() < 0.1 else round(float(draw.choice([draw.uniform(-5, 5), draw.uniform(0, 1e6), draw.randrange(4)])), 2)
        rows.append((k, None if k % 50 == 7 else at, "view" if hot else draw.choice(["view", "click", None, "k"]), value))
    rows.append((900, start + datetime.timedelta(hours=9), "alone", 1.0))
    rows.append((901, start, "none", None))
    want = brute_windows(rows)
    clicks = clashing(spark.createDataFrame(rows + rows[:40] + rows[-2:], CLICKS)).repartition(3)
    found = rolling.outliers(clicks).collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_rolling_medians_of_no_and_broken_clicks(spark):
    clicks = spark.createDataFrame([(1, None, "a", 1.0)], CLICKS)
    assert rolling.outliers(clicks).count() == 0 and rolling.outliers(clicks.limit(0)).count() == 0
    at = datetime.datetime(2024, 1, 1)
    rows = [(None, at, "a", 1.0), (None, at, "a", 3.0), (2, None, "a", 9.0), (2, at, "a", 5.0), (3, at, "a", 1e300)]
    assert sorted((tuple(r) for r in rolling.outliers(spark.createDataFrame(rows, CLICKS)).collect()), key=str) == [(2, "a", 2, 600, 800, False), (3, "a", 2, 600, 800, None), (None, "a", 2, 600, 800, False)]
