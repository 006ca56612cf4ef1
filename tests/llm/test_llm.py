"""Each operator against a plain version, closed forms or held-out labels; edge cases; the pipeline against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrank.llm import langid, linededup, media, mixing, ngramjoin, packing, pii, quality, rules, toxicity

KINDS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def documents(spark, texts, extra=False):
    """Rows from texts, or from (doc_id, text, lang, source); with extra columns that clash with operators' own names."""
    rows = [(t if isinstance(t, tuple) else (i, t, "en", f"src{i % 3}")) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], KINDS)
    return df.withColumns({c: F.lit("x") for c in ("score", "size", "media", "fp", "batch", "start", "w", "known")}) if extra else df


@pytest.fixture(scope="module")
def corpus():
    """Whole texts with copies, near copies, shared lines, nulls, blanks, one long text, repeated rows and a null id."""
    draw = random.Random(7)
    base = [" ".join(draw.choice(WORDS) + str(draw.randrange(40)) for _ in range(draw.randrange(3, 120))) for _ in range(60)]
    texts = base + base[:12] + ["  ".join(t.split()) for t in base[:4]]
    for t in base[:25]:
        ws = t.split()
        for n in (1, 3, 8):
            ws2 = list(ws)
            for _ in range(n):
                ws2[draw.randrange(len(ws2))] = "changed"
            texts.append(" ".join(ws2))
    common = "This very line stands in many of the documents."
    texts = [t + ("\n" + common if i % 4 == 0 else "") + ("\n  " + common.upper() + "\t" if i % 12 == 5 else "") for i, t in enumerate(texts)]
    texts += [None, "", " \n\t ", "a b", "A  B", "a b c d", "a b c d e", "x" * 5000, " ".join(draw.choice(WORDS) for _ in range(20000)), "12 34 + 5", common]
    rows = [(i, t, "en", f"src{draw.randrange(4)}" if i % 3 else "hot") for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, "no id here but words", None, None)]


def words(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]


def shingles(t):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words(t)]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {k: min((d for d in g if d is not None), default=None) for k, g in groups.items()}
    return [(rows[i][0], len(sets[i]), least[find(i)] if sets[i] else rows[i][0]) for i in range(len(rows))]


def key(r):
    return tuple((x is not None, str(x)) for x in r)


def test_ngram_join_against_all_pairs(spark, corpus):
    got = [tuple(r) for r in ngramjoin.similar(documents(spark, corpus, extra=True)).collect()]
    assert sorted(got, key=key) == sorted(brute_components(corpus), key=key)


@pytest.mark.parametrize("light, levels", [(1000, 4), (1, 4), (2, 1)])
def test_ngram_join_of_many_near_copies_and_a_common_passage(spark, monkeypatch, light, levels):
    monkeypatch.setattr(ngramjoin, "LIGHT", light)  # the later cases part every list
    monkeypatch.setattr(ngramjoin, "LEVELS", levels)
    draw = random.Random(3)
    base = [f"w{draw.randrange(10**6)}" for _ in range(80)]
    passage = [f"p{k}" for k in range(40)]
    rows = []
    for i in range(120):  # some link with the base, some only with each other, some with none
        ws = list(base)
        for _ in range(draw.randrange(6)):
            ws[draw.randrange(80)] = f"e{draw.randrange(10**6)}"
        rows.append((i, " ".join(ws), "en", "s"))
    for i in range(120, 240):
        own = [f"o{draw.randrange(10**6)}" for _ in range(draw.choice([2, 8, 30]))]
        rows.append((i, " ".join(own + passage), "en", "s"))
    template = [f"t{k}" for k in range(60)]
    for i in range(240, 340):  # one frame about words of a pool: some link, most don't
        ws = template + [f"v{draw.randrange(8)}{c}" for c in "abcdefghij"] + [f"o{draw.randrange(10**6)}" for _ in range(draw.choice([0, 1, 2, 4, 9]))]
        rows.append((i, " ".join(ws), "en", "s"))
    got = [tuple(r) for r in ngramjoin.similar(documents(spark, rows).repartition(5)).collect()]
    want = brute_components(rows)
    assert sorted(got, key=key) == sorted(want, key=key) and len({c for d, _, c in want if d >= 240}) > 3


def test_one_row_of_each_component_is_kept(spark):
    draw = random.Random(9)
    one, two, three = (" ".join(f"{c}{draw.randrange(10**6)}" for _ in range(30)) for c in "xyz")
    rows = []
    for k in range(0, 80, 10):  # several pairs, so that the order of hashes cannot help
        x, y, z = (t.replace(" ", f" k{k}") for t in (one, two, three))
        rows += [(k + 3, x, "en", "s"), (k + 5, x, "en", "s"), (k + 5, y, "en", "s"), (k + 5, y, "en", "s"), (k + 6, z, "en", "s"), (k + 6, y, "en", "s"), (k + 7, "", "en", "s"), (k + 7, "", "en", "s"), (k + 8, x + " w", "en", "s"), (k + 8, z + " w", "en", "s"), (k + 9, f"a{k} b c", "en", "s"), (k + 9, f"d{k} e f", "en", "s")]
    got = sorted((r.doc_id, r.text) for r in ngramjoin.kept(documents(spark, rows, extra=True)).collect())
    heads = {}
    for (d, text, *_), (_, n, c) in zip(rows, brute_components(rows), strict=True):
        if d == c:
            heads[(d, text)] = n
    assert got == sorted(heads)


def brute_lines(rows):
    strip = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    ids = collections.defaultdict(set)
    order = lambda d: -(2**63) if d is None else d
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            k = line.strip(strip).translate(low)
            if len(k) >= 40:
                ids[k].add(order(d))
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(ids[k := x.strip(strip).translate(low)]) >= 5 and len(k) >= 40 and order(d) < max(ids[k]))]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def test_line_dedup(spark, corpus):
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute_lines(corpus)]
    got = [tuple(r) for r in linededup.dedup(documents(spark, corpus, extra=True)).collect()]
    assert sorted(got, key=key) == sorted(want, key=key) and sum(r[2] for r in want) > 20


@pytest.mark.parametrize("few", [0, 2])
def test_line_dedup_of_documents_with_many_dropped_lines(spark, monkeypatch, few):
    monkeypatch.setattr(linededup, "FEW", few)
    line = lambda k: f"line number {k} is long enough to count as a key"
    rows = [(d, "\n".join([line(k % 7) for k in range(d, d + 9)] + ["short", ""] + [line(100 + d)]), "en", "s") for d in range(8)]
    rows += [(3, line(1) + "\n" + line(2), "en", "s"), (3, line(1) + "\n" + line(2), "en", "t"), (2, None, "en", "s"), (None, "\n".join(line(k) for k in range(7)), None, None)]
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute_lines(rows)]
    got = [tuple(r) for r in linededup.dedup(documents(spark, rows, extra=True)).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_line_dedup_takes_long_texts(spark):
    """Five equal texts of 50,000 lines and one of 200,000, in time that grows with the lines."""
    shared = "\n".join(f"line number {k} is long enough to count as a key" for k in range(50_000))
    own = "\n".join(f"another line, number {k}, long enough to count as a key" for k in range(200_000))
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in linededup.dedup(documents(spark, [shared] * 5 + [own])).collect()}
    assert got == {k: (50_000, 50_000 if k < 4 else 0) for k in range(5)} | {5: (200_000, 0)}


def test_line_runs_stay_few_and_exact(spark):
    runs = linededup.LineRuns(spark, buckets=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(10 * b + d, h, 0) for d in range(3) for h in (1, 100 + b)], "doc long, h1 long, h2 int"))
    assert sum(map(len, runs.levels)) <= 3
    got = {r.h1: (r.n, r.top) for r in runs.counts(1).collect()}
    assert got == {1: (15, 42)} | {100 + b: (3, 10 * b + 2) for b in range(5)}


def test_media_round_trip(spark, corpus):
    df = documents(spark, corpus, extra=True)
    rows = {}
    for r in media.digest(media.decode(media.encode(df))).collect():
        rows.setdefault(r.doc_id, r)
    for d, t, *_ in corpus:
        raw = (t or "").encode()
        p = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = rows[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.fault) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), None)
    decoded = media.decode(media.encode(df).withColumn("media", F.when(F.col("doc_id") == 1, F.overlay("media", F.lit(b"\x00\x01"), F.lit(60))).when(F.col("doc_id") != 2, F.col("media")))).where("doc_id IN (1, 2)").collect()
    assert all(r.fault and r.payload is None for r in decoded)


def test_all_row_filters_are_undone():
    draw = np.random.default_rng(1)
    rows = draw.integers(0, 256, (10, 12), dtype=np.uint8)
    kinds = np.array([0, 1, 2, 3, 4, 4, 3, 2, 1, 0], np.uint8)
    body = np.zeros_like(rows)
    for r in range(10):
        for c in range(12):
            a = int(rows[r, c - 3]) if c >= 3 else 0
            b = int(rows[r - 1, c]) if r else 0
            e = int(rows[r - 1, c - 3]) if r and c >= 3 else 0
            paeth = min((abs(a + b - e - x), k) for k, x in enumerate((a, b, e)))[1]
            guess = (0, a, b, (a + b) // 2, (a, b, e)[paeth])[kinds[r]]
            body[r, c] = (int(rows[r, c]) - guess) % 256
    assert (media._unfiltered(kinds, body, 3) == rows).all()


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_personal(t):
    digits = lambda m: re.sub("[^0-9]", "", m)
    patterns = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, p, ok in patterns for m in re.finditer(p, t or "") if ok(m.group())]


def test_personal_data(spark, corpus):
    hard = ["a@b.c_x@d.e é 😀 1.2.3.4.5.6.7.8 300.1.1.1 00001.2.3.4 99999999999999999999.1.1.1", "+1 (234) 567-8901 +12 +123456789 4111 1111 1111 1111", "4" * 40 + " 4111-1111-1111-1112", "a@b ..@c.d @e.f g@h.i@j.k", "x" * 9000 + "@" + "y.z" * 900, "1" * 9000]
    hard += [f'see token = "{hashlib.sha1(str(i).encode()).hexdigest()}" and antidisestablishmentarianism{"x" * i} or 10.0.0.{i}' for i in range(40)]
    rows = corpus + [(1000 + i, t, "en", "s") for i, t in enumerate(hard)]
    found = {}
    for r in pii.find(documents(spark, rows, extra=True)).collect():
        found.setdefault(r.doc_id, r)
    for d, t, *_ in rows:
        base = brute_personal(t)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        r = found[d]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.spans.startswith(text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in base) for k in ("email", "ip", "card", "phone")]
    assert sum("secret:" in r.spans for r in found.values()) >= 30
    docs = documents(spark, rows).where("doc_id = 1001")
    assert pii.redacted(docs, pii.spans(documents(spark, rows))).first().text == "[phone] +12 +123456789 4111 1111 1111 1111"  # too many digits run together


def brute_candidates(t):
    """Plain code of the generators, features and weak labels."""
    base = brute_personal(t)
    mail = r"[A-Za-z0-9._%+-]"
    patterns = (rf"{mail}+(?:@|\x20?[(\[](?:at|AT)[)\]]\x20?)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*", r"(?<![0-9])[0-9](?:[\x20().-]{0,2}[0-9]){6,40}", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}")
    out = []
    for g, p in enumerate(patterns):
        ends, found = 0, list(re.finditer(p, t))
        for k, m in enumerate(found):
            w, before = m.group(), t[ends : m.start()][-32:]
            after = t[m.end() : found[k + 1].start() if k + 1 < len(found) else len(t)][:8]
            ends = m.end()
            d = re.sub("[^0-9]", "", w)
            known = any(a < m.end() and m.start() < b for _, a, b in base)
            assigned = g == 2 and bool(d) and bool(re.search(r"(?i)(token|secret|passw|pwd|key|auth|bearer|credential)[A-Za-z_]{0,12}[\"']?\s*[:=]?\s*[\"']?$", before))
            context = [k for k, p in ((1, "token|secret|passw|pwd|key|auth|bearer|credential"), (2, "phone|tel|call|fax|mail|contact|card|iban|account|ssn|address"), (3, "version|licen|cc by|isbn|issn|doi")) if re.search(p, before.lower())]
            digits = next((i for i, least in enumerate((7, 9, 13, 16, 20)) if len(d) < least), 5)
            x = (g, min(7, len(w).bit_length() - 1), 8 * len(d) // len(w), digits, min(4, w.count(".")), int("@" in w), int(bool(re.fullmatch("[0-9a-fA-F]+", w))), bool(re.search("[a-z]", w)) + 2 * bool(re.search("[A-Z]", w)), int(before.endswith("+")), int(before[-1:] in ('"', "'") and before != "") + 2 * int(after[:1] in ('"', "'") and after != ""), context[0] if context else 0)
            out.append((m.start(), m.end(), known, assigned, x))
    return out


def test_added_spans_against_plain_code(spark, corpus):
    import struct

    import xxhash

    draw = random.Random(21)
    rows = [(i, f"call {draw.choice(['+49 30 ', '030-', ''])}{draw.randrange(10**7, 10**9)} or {''.join(draw.choice('abcdef0123456789') for _ in range(draw.choice([18, 32, 40])))} {draw.choice(['token: ', 'api_key = ', 'id ', ''])}{''.join(draw.choice('abcXYZ0123456789') for _ in range(24))} and a{i}@b.org u{i} (at) c.net {'long-' * draw.randrange(5)}word", "en", "s") for i in range(300)]
    rows += [(5000 + i, t, *r) for i, (_, t, *r) in enumerate(corpus)]
    counts = collections.Counter()
    each = {d: brute_candidates(t or "") for d, t, *_ in rows}
    for d, found in each.items():
        held = xxhash.xxh64_intdigest(struct.pack("<q", d), seed=42)
        held = (held - 2**64 if held >= 2**63 else held) % 3 == 0
        for _, _, known, assigned, x in found:
            counts[held, x, int(known or assigned)] += 1
    start, trees, limits = pii.learned([(h, (x, y, n)) for (h, x, y), n in counts.items()])
    added = 0
    for r in pii.find(documents(spark, rows)).collect():
        base = brute_personal(next(t for d, t, *_ in rows if d == r.doc_id))
        more = [(list(pii.GENERATORS)[x[0]], a, b) for a, b, known, _, x in each[r.doc_id] if not known and pii.value(start, trees, x) >= limits[x[0]] - 1e-6]
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in base + more)
        added += len(more)
    assert added > 100


def test_personal_data_in_one_long_text(spark):
    text = " ".join(f"user{i}@mail{i}.example.com" for i in range(20_000))
    r = pii.find(documents(spark, [(1, text, "en", "s"), (2, None, "en", "s")])).where("doc_id = 1").first()
    want = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_personal(text))
    assert r.n_email == 20_000 and r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_personal_data_learns_from_rare_patterns(spark):
    features = {f: "0" for f in pii.FEATURES} | {"generator": "IF(id < 21000, 0, 1)", "size": "CAST(id % 150 AS INT)", "digits": "CAST(id DIV 150 AS INT)"}
    one = "named_struct('known', false, 'assigned', id >= 21000 OR id % 2 = 1, " + ", ".join(f"'{f}', {sql}" for f, sql in features.items()) + ")"
    common_and_rare = spark.range(21600).selectExpr("id AS doc_id", f"array_repeat({one}, IF(id < 21000, 2, 1)) AS candidates")
    _, threshold = pii.train(common_and_rare)
    assert float(re.search(r"WHEN 1 THEN ([0-9.]+)D", threshold)[1]) < 100
    assert list(pii.BINS) == list(pii.FEATURES)


TOKENS = None


def tokenizer():
    global TOKENS
    if TOKENS is None:
        import public_tokenizers
        from tokenizers import Tokenizer

        TOKENS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return TOKENS


def brute_pieces(d, t):
    ids = tokenizer().encode(t or "", add_special_tokens=False).ids + [2]
    out, start = [], 0
    while start < len(ids):
        n = min(4096, 1 << (len(ids) - start).bit_length() - 1)
        out.append((d, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()), len(ids)))
        start += n
    return out


def test_packing(spark, corpus):
    import public_tokenizers

    rows = corpus + [(2000 + i, t, "en", "s") for i, t in enumerate(["don't I'LL <|endoftext|> x<|startoftext|>y", "İ, É. É. ½, ǅ! ΑΣ, ñ|", "日本語 テスト\x1c\x85 a", "end. (end.) end..., e.g., U.S.A.", "A <|ENDOFTEXT|> B", "<|EndOfText|>x", "Two <|StartOfText|> THREE <|endoftext|>", "<| UPPER |>"])]
    got = packing.pack(documents(spark, rows, extra=True), public_tokenizers.path("word_bpe_49k.json"), with_ids=True)
    pieces = got.collect()
    want = [p for d, t, *_ in rows for p in brute_pieces(d, t)]
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces), key=key) == sorted(want, key=key)
    assert len({r.sequence_id for r in pieces}) == len(pieces) and all(r.offset == 0 and len(r.ids) == r.length == 1 << r.bucket for r in pieces)
    sums = packing.batches(got, 8192).groupBy("batch").agg(F.sum("length").alias("n"), F.count_distinct("bucket").alias("b")).collect()
    assert all(r.n <= 8192 and r.b == 1 for r in sums)


def brute_rules(t):
    w = words(t)
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    full = [x for x in (t or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(full) - len(set(full)), len(covered))


def test_rules(spark, corpus):
    rows = corpus + [(3000, "one two " * 40, "en", "s"), (3001, "é ü\n" * 30, "en", "s"), (3002, "a\x1cb c\x85d e", "en", "s"), (3003, " | ".join(WORDS * 4), "en", "s")]
    got = {}
    for r in rules.decide(documents(spark, rows, extra=True)).collect():
        got.setdefault(r.doc_id, r)
    for d, t, *_ in rows:
        m, r = brute_rules(t), got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0]) and not (r.base_failed and r.kept)
    ledger = rules.ledger(documents(spark, rows))
    table = {(r.policy, r.rule): r for r in rules.ablation(ledger).collect()}
    failed = [r.failed for r in ledger.collect()]
    for (policy, rule), r in table.items():
        bit, mask = 1 << [n for n, _ in rules.RULES].index(rule), rules.POLICIES[policy]
        assert (r.kept, r.failing, r.removed_alone) == (sum(not f & mask for f in failed), sum(bool(f & bit) for f in failed), sum(f & mask == bit for f in failed))


def brute_mix(rows):
    size = collections.Counter()
    for _, t, _, s in rows:
        size[s] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:
        left, w = sum(size.values()) - sum(target.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 3 * size[s]}
        if not over:
            return size, target | {s: left * weight[s] / w for s in open_}
        target |= {s: 3 * size[s] for s in over}
        open_ -= over


def test_mixing(spark, corpus):
    mixing.SLICES, old = 16, mixing.SLICES
    try:
        df = documents(spark, corpus, extra=True).withColumns({c: F.lit("y") for c in ("target", "source_size", "copies", "_mix_doc", "_mix_key", "a.b")})
        got, again = ([tuple(r) for r in mixing.mix(d).collect()] for d in (df, df.repartition(7)))
        mixed = mixing.mixed(df)
        assert mixed.schema.names == df.columns
        mixed = mixed.collect()
        assert {r["size"] for r in mixed} == {"x"} and {r["target"] for r in mixed} == {"y"}
    finally:
        mixing.SLICES = old
    assert sorted(got, key=key) == sorted(again, key=key) and len(got) == len(corpus)
    size, target = brute_mix(corpus)
    taken = collections.Counter()
    source = {(r[0], len(words(r[1]))): r[3] for r in corpus}
    for d, n, s, t, k in got:
        src = source[d, n]
        assert s == size[src] and t == pytest.approx(target[src]) and 0 <= k <= 3 * n and (n == 0 or k % n == 0)
        taken[src] += k
    largest = max(len(words(r[1])) for r in corpus)
    assert all(abs(taken[s] - target[s]) <= largest / 2 + 1 for s in size)
    rows = collections.Counter()
    for r in mixed:
        rows[r.source] += len(words(r.text))
    assert rows == +taken


LANGS = {"aa": "ka ro mi ta ne".split(), "bb": "schü gro wer ßen tal".split(), "cc": "élé eau tion ré oux".split()}


def made(draw, lang, n):
    return " ".join("".join(draw.choice(LANGS[lang]) for _ in range(draw.randrange(1, 4))) for _ in range(n))


def test_language_id(spark):
    draw = random.Random(5)
    rows = [(i, made(draw, lang := draw.choice(list(LANGS)), draw.randrange(5, 60)), lang, "s") for i in range(400)]
    rows += [(500, None, "aa", "s"), (501, "", "bb", "s"), (502, "12 ² ½ !!", "bb", "s"), (503, made(draw, "bb", 30), None, "s"), (504, "y" * 4000, None, None), rows[0], (None, made(draw, "cc", 20), "cc", "s")]
    df = documents(spark, rows, extra=True)
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    held = [r for r in rows[:400] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(got[r[0]].held_out for r in held) and sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.97 * len(held)
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (500, 501, 502)) and got[503].lang_pred == "bb" and all(0 <= r.score <= 1 for r in got.values())
    odd = [(600 + i, " ".join("".join(draw.choice(letters) for _ in range(draw.randrange(3, 9))) for _ in range(60)), None, "s") for i, letters in enumerate(["bcdfghjklmnpqrstvwxz", "абвгдежзиклмн", "αβγδεζηθικλ"] * 3)]
    kept = langid.filtered(documents(spark, rows + odd, extra=True))
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(got) - {500, 501, 502}
    model = langid.fit([(r[1], r[2]) for r in rows[:200]])
    text = made(draw, "aa", 12) + " " + made(draw, "bb", 12)
    post, _ = langid.posteriors(langid.Labeller(model)._emissions(langid.words_of(text))[:, :-1], np.array([24]), model.moves, model.start)
    best = [model.languages[k] for k in post.argmax(axis=1)]
    assert best.count("aa") >= 10 and best.count("bb") >= 10 and best[0] == "aa" and best[-1] == "bb"
    assert {r.lang_pred for r in langid.identify(df.where("lang IS NULL")).collect()} == {"und"}


def test_language_id_learns_from_whole_texts():
    draw = random.Random(11)
    rows = [(made(draw, "aa", 400), "aa") for _ in range(60)] + [(made(draw, "aa", 170) + "\n" + made(draw, "bb", 230), "bb") for _ in range(20)]
    model = langid.fit(rows)
    assert any(set(w) & set("üß") for w in model.lexicons[1])
    langs, scores = langid.Labeller(model).label([made(draw, "bb", 40) for _ in range(20)] + [made(draw, "aa", 40) for _ in range(20)])
    assert langs == ["bb"] * 20 + ["aa"] * 20 and min(scores[:20]) > 0.9


def test_forward_backward_against_enumeration():
    import itertools

    draw = np.random.default_rng(2)
    e, m, s = draw.normal(size=(4, 3)), draw.normal(size=(3, 3)), draw.normal(size=3)
    total = np.zeros((4, 3))
    for path in itertools.product(range(3), repeat=4):
        total[range(4), path] += np.exp(s[path[0]] + sum(e[t, y] for t, y in enumerate(path)) + sum(m[a, b] for a, b in itertools.pairwise(path)))
    post, pairs = langid.posteriors(e, np.array([4]), m, s, pairs=True)
    assert np.allclose(post, total / total.sum(axis=1, keepdims=True)) and pairs.sum() == pytest.approx(3)


def plain_posteriors(e, moves, start):
    """One sequence, word by word."""
    x, step = np.exp(e - e.max(axis=1, keepdims=True)), np.exp(moves)
    f, b = np.zeros_like(x), np.ones_like(x)
    for t in range(len(x)):
        v = x[t] * (np.exp(start) if t == 0 else f[t - 1] @ step)
        f[t] = v / v.sum()
    for t in range(len(x) - 2, -1, -1):
        v = step @ (b[t + 1] * x[t + 1])
        b[t] = v / v.sum()
    return f * b / (f * b).sum(axis=1, keepdims=True)


def test_blocks_hand_over_messages():
    draw = np.random.default_rng(0)
    lengths = np.array([1, 5, 128, 129, 700, 256, 257, 3, 1000])
    e, m, s = draw.normal(size=(lengths.sum(), 4)) * 3, draw.normal(size=(4, 4)), draw.normal(size=4)
    ends = np.cumsum(lengths)
    want = np.concatenate([plain_posteriors(e[b - n : b], m, s) for n, b in zip(lengths, ends, strict=True)])
    assert np.allclose(langid.posteriors(e, lengths, m, s)[0], want, atol=1e-12)


def plain_features(word, lexicons):
    """Hashed features of one word, by Python's integers."""
    full = (1 << 64) - 1
    code = [ord(c) for c in f"<{word}>"]

    def rolled(cs):
        h = 0
        for c in cs:
            h = (h * 0x100000001B3 + c) & full
        return h

    kinds = [[rolled(code[i : i + n]) for i in range(len(code) - n + 1)] for n in langid.GRAMS]
    kinds += [[rolled((code + [0] * 5)[:5])], [rolled((code[::-1] + [0] * 5)[:5])], [sum(c * pow(0x100000001B3, i, 1 << 64) for i, c in enumerate(code)) & full]]
    kinds += [[0] if word in held else [] for held in lexicons]
    out = []
    for k, hashes in enumerate(kinds):
        for h in hashes:
            x = ((h + k + 1) * 0x9E3779B97F4A7C15) & full
            out.append((((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & full) >> 40)
    return [h % langid.DIMS for h in out]


def plain_judge(text, model):
    """Language, score, support and words of one text by plain code."""
    lines = [[w for w in re.findall(r"[^\W\d_]+", line)] for line in (text or "").lower().split("\n")]
    if not any(c.isalpha() for ws in lines for w in ws for c in w) or not model.languages:
        return "und", 0.0, 0.0, 0
    post, support = [], []
    for ws in filter(None, lines):
        each = [plain_features(w, model.lexicons) for w in ws]
        support += [np.mean([model.seen[i] for i in f]) for f in each]
        post.append(plain_posteriors(np.array([model.weights[f].sum(axis=0) for f in each], float), model.moves, model.start))
    mean = np.concatenate(post).mean(axis=0)
    return model.languages[mean.argmax()], min(1.0, mean.max()), float(np.mean(support)), len(support)


def test_language_id_query_against_plain_code(spark, corpus):
    draw = random.Random(8)
    rows = [(i, made(draw, lang := draw.choice(list(LANGS)), 30) + "\n" + made(draw, draw.choice(list(LANGS)), draw.randrange(1, 300)), lang, "s") for i in range(80)]
    rows += [(1000 + i, t, None, s) for i, (_, t, _, s) in enumerate(corpus)] + [(2000, "z" * 3000 + " É ǅ ½ tal", None, None)]
    df = documents(spark, rows, extra=True)
    model = langid.train(df, F.expr("crc32(CAST(doc_id AS STRING)) % 4 <> 2"))
    texts = {d: t for d, t, *_ in rows}
    for r in langid.identify(df).collect():
        lang, score, *_ = plain_judge(texts[r.doc_id], model)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.score == pytest.approx(score, abs=1e-4) and (r.lang_pred == lang or score < 0.6)


def labelled(spark, kind, n=500):
    draw = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        text = " ".join(draw.choice(WORDS) + str(draw.randrange(30)) for _ in range(draw.randrange(60, 160)))
        bad = draw.random() < 0.25
        if kind == "toxic" and bad:
            ws = text.split()
            for _ in range(3):
                ws.insert(draw.randrange(len(ws)), draw.choice(["grumblefoot", "snotwaffle", "idiot", "trash"]))
            text = " ".join(ws)
        if kind == "quality" and bad:
            text = draw.choice([" ".join(w + "***" for w in text.split()), " ".join([text.split()[0]] * 80), " | ".join(text.split())])
        rows.append((i, text, "en", "s"))
        if draw.random() < 0.6:
            labels.append((i, int(not bad), int(bad)) if kind == "quality" else (i, 1, int(bad)))
    truth = {r[0]: None for r in rows} | {x[0]: x[2] for x in labels}
    rows += [(9000, None, "en", "s"), (9001, "", "en", "s"), (None, "words only", "en", "s"), rows[3]]
    return documents(spark, rows, extra=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), truth


def test_toxicity(spark):
    docs, labels, truth = labelled(spark, "toxic")
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    held = [d for d, t in truth.items() if t is not None and zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d].held_out for d in held) and sum(got[d].predicted == truth[d] for d in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[9000].score == got[9001].score < 0.5
    nothing = {r.predicted for r in toxicity.score(docs, labels.where("doc_id < 0")).collect()}
    assert nothing <= {0, 1}


def test_label_model_finds_voters_worth():
    draw = np.random.default_rng(0)
    y = draw.random(3000) < 0.2
    table = np.stack([np.where(draw.random(3000) < a, y, ~y).astype(int) for a in (0.95, 0.9, 0.85, 0.6)] + [np.full(3000, toxicity.NONE)], axis=1)
    table = np.concatenate([table[:, :3], table[:, 3:4], table[:, 3:4], table[:, 4:]], axis=1)  # a weak voter twice
    post, chances, share = toxicity.label_model(table)
    assert ((post > 0.5) == y).mean() > 0.95 and chances[1, 0, toxicity.TOXIC] > chances[1, 3, toxicity.TOXIC] and share[3] < 0.7 < share[0]


def test_quality(spark):
    docs, labels, truth = labelled(spark, "quality", 900)
    got = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    held = [d for d, t in truth.items() if t is not None and zlib.crc32(str(d).encode()) % 5 == 0]
    right = {bad: [got[d].predicted == 1 - bad for d in held if truth[d] == bad] for bad in (0, 1)}
    assert np.mean(right[0]) >= 0.95 and np.mean(right[1]) >= 0.8
    assert all(0 <= r.score <= 1 for r in got.values()) and got[9000].score == got[9001].score
    assert quality.class_prior(np.arange(100.0), np.concatenate([np.arange(100.0), np.full(100, -9.0)])) == pytest.approx(0.5, abs=0.02)
    assert all(r.score == pytest.approx(quality.PRIOR) for r in quality.score(docs, labels.where("quality = 0")).collect())


def test_empty_tables(spark):
    import public_tokenizers

    none, labels = documents(spark, []).limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (ngramjoin.similar(none), media.digest(media.decode(media.encode(none))), linededup.dedup(none), pii.find(none), packing.pack(none, public_tokenizers.path("word_bpe_49k.json")), rules.decide(none), mixing.mix(none), langid.identify(none), toxicity.score(none, labels), quality.score(none, labels)):
        assert out.count() == 0


def test_stages_on_empty_tables_and_clashing_names(spark, corpus):
    names = ("root", "turn", "list", "doc", "h1", "h2", "n", "top", "line", "lang_pred", "support", "grp", "token", "copies", "target")
    docs = documents(spark, corpus[:12] + corpus[-16:], extra=True).withColumns({c: F.lit("x") for c in names})
    for stage in (langid.filtered, linededup.cleaned, ngramjoin.kept, mixing.mixed):
        assert stage(docs.limit(0)).count() == 0
        out = stage(docs)
        assert out.columns == docs.columns and {r.root for r in out.select("root").distinct().collect()} == {"x"}


def plain_label_model(table, rounds):
    """Expectation and maximisation by loops."""
    n, m = len(table), len(table[0])
    toxic, clean = toxicity.TOXIC, toxicity.CLEAN
    lead = [sum(v == toxic for v in r) - sum(v == clean for v in r) for r in table]
    post, share = [0.8 if d > 0 else 0.02 if d < 0 else 0.1 for d in lead], [1.0] * m
    for k in range(rounds):
        weight = [[1 - p for p in post], post]
        chance = [[[(sum(w for w, r in zip(weight[y], table, strict=True) if r[j] == v) + 0.5) / (sum(weight[y]) + 1.5) for v in range(3)] for j in range(m)] for y in (0, 1)]
        prior = [(sum(weight[y]) + 1) / (n + 2) for y in (0, 1)]
        if k >= 5:
            rest = [[(r[j] == toxic) - (r[j] == clean) - sum(weight[y][i] * (chance[y][j][toxic] - chance[y][j][clean]) for y in (0, 1)) for j in range(m)] for i, r in enumerate(table)]
            spread = [math.sqrt(sum(r[j] ** 2 for r in rest) / n) + 1e-9 for j in range(m)]
            for a in range(m):
                near = [abs(sum(r[a] * r[b] for r in rest) / n / spread[a] / spread[b]) for b in range(m)]
                share[a] = 1 / sum(1 if a == b else c if c >= 0.1 else 0 for b, c in enumerate(near))
            share[-1] = 1
        for i, r in enumerate(table):
            logs = [math.log(prior[y]) + sum(share[j] * math.log(chance[y][j][v]) for j, v in enumerate(r)) for y in (0, 1)]
            post[i] = 1 / (1 + math.exp(min(50, max(-50, logs[0] - logs[1]))))
    return post


def test_label_model_against_loops():
    draw = random.Random(4)
    truth = [draw.random() < 0.3 for _ in range(120)]
    table = [[draw.choice([0, 1, 2]) if draw.random() < e else int(y) for e in (0.1, 0.3, 0.5)] + [2 if draw.random() < 0.5 else int(y)] for y in truth]
    table = [[*r[:2], r[1], *r[2:]] for r in table]
    assert np.allclose(toxicity.label_model(np.array(table), 12)[0], plain_label_model(table, 12), atol=1e-9)


def test_toxicity_query_against_plain_code(spark):
    docs, labels, _ = labelled(spark, "toxic")
    learnable = F.expr("crc32(CAST(coalesce(CAST(doc_id AS STRING), '') AS BINARY)) % 5 <> 0")
    model = toxicity.train(docs, labels, learnable)
    assert model.mined >= {"grumblefoot", "snotwaffle"} and toxicity.train(docs.repartition(7), labels, learnable).weights.keys() == model.weights.keys()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.score(docs, labels).collect():
        ws = re.findall(r"[^\W\d_]+", (texts[r.doc_id] or "").lower())
        hits = [w for w in ws if w in model.mined]
        z = model.bias + sum(model.weights.get(w, 0) for w in set(ws)) + np.dot(model.dense, [bool(hits), math.log1p(len(hits)), min(5, len(set(hits))) / 5, min(1, 20 * len(hits) / max(1, len(ws)))])
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9) and r.predicted == (r.score >= 0.5)


def plain_risk(w, b, positive, unlabelled, prior):
    """The unbiased risk's two parts, by loops."""
    loss = lambda z, y: math.log1p(math.exp(-z if y else z))
    mean = lambda rows, y: sum(loss(sum(w[c] for c in r) + b, y) for r in rows) / len(rows)
    return prior * mean(positive, 1), mean(unlabelled, 0) - prior * mean(positive, 0)


def test_non_negative_risk_against_loops(monkeypatch):
    draw = np.random.default_rng(3)
    size, prior = 12, 0.6
    unlabelled = np.stack([draw.integers(0, 4, 40), 4 + draw.integers(0, 4, 40), 8 + draw.integers(0, 4, 40)], axis=1)
    positive = unlabelled[unlabelled[:, 0] < 2][:15]
    monkeypatch.setattr(quality, "DECAY", 0.0)
    # Adam by loops, with slopes by differences of the plain risk
    w, b, mean, square = [0.0] * size, 0.0, [0.0] * (size + 1), [0.0] * (size + 1)
    for n in range(1, 31):
        def part(ws, bias):
            p, u = plain_risk(ws, bias, positive, unlabelled, prior)
            return p + u if plain_risk(w, b, positive, unlabelled, prior)[1] >= 0 else -u

        slopes = []
        for k in range(size + 1):
            up, down = ([x + s * (i == k) for i, x in enumerate([*w, b])] for s in (1e-6, -1e-6))
            slopes.append((part(up[:-1], up[-1]) - part(down[:-1], down[-1])) / 2e-6)
        for k, g in enumerate(slopes):
            mean[k], square[k] = 0.9 * mean[k] + 0.1 * g, 0.99 * square[k] + 0.01 * g * g
        move = [quality.RATE * (m / (1 - 0.9**n)) / (math.sqrt(s / (1 - 0.99**n)) + 1e-8) for m, s in zip(mean, square, strict=True)]
        w, b = [x - d for x, d in zip(w, move[:-1], strict=True)], b - move[-1]
    monkeypatch.setattr(quality, "ROUNDS", 30)
    got, bias = quality.descend(positive, unlabelled, size, prior)
    assert np.allclose(got, w, atol=0.02) and bias == pytest.approx(b, abs=0.02)


def test_quality_query_against_plain_code(spark):
    docs, labels, _ = labelled(spark, "quality", 900)
    learnable = F.expr("crc32(CAST(coalesce(CAST(doc_id AS STRING), '') AS BINARY)) % 5 <> 0")
    model = quality.train(docs, labels, learnable)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.score(docs, labels).collect():
        t = (texts[r.doc_id] or "").encode()
        ws, lines = t.split(), [x for x in t.split(b"\n") if x.strip()]
        n, chars = max(1, len(ws)), max(1, sum(map(len, ws)))
        count = lambda signs: sum(c in signs for c in t)  # noqa: E731, B023
        upper, lower = count(bytes(range(65, 91))), count(bytes(range(97, 123)))
        m = [math.log1p(len(ws)), chars / n, count(b"#*$%&|<>{}[]\\^~=") / n, t.count(b"!") / n, upper / max(1, upper + lower), count(b"0123456789") / chars, len(set(ws)) / n**0.8, sum(a == b for a, b in zip(ws, ws[1:], strict=False)) / n, count(b".,;:!?") / n, min(200, n / max(1, len(lines))), len(set(lines)) / max(1, len(lines)), sum(len(w) <= 3 for w in ws) / n]
        z = model.bias + sum(model.weights[k][sum(e <= v for e in model.edges[k])] for k, v in enumerate(m if ws else [0.0] * 12))
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9) and r.predicted == (r.score >= 0.3)


def plain_png(data):
    """An independent reader: rows of samples."""
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, packed = 8, b""
    while at < len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        assert zlib.crc32(data[at + 4 : at + 8 + n]) == int.from_bytes(data[at + 8 + n : at + 12 + n], "big")
        packed += data[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    flat, rows = zlib.decompress(packed), []
    for r in range(len(flat) // 193):
        kind, row, above = flat[193 * r], bytearray(flat[193 * r + 1 : 193 * r + 193]), rows[-1] if rows else bytes(192)
        for c in range(192):
            a, b, e = (row[c - 3] if c > 2 else 0), above[c], (above[c - 3] if c > 2 else 0)
            row[c] = (row[c] + (0, a, b, (a + b) // 2, min((abs(a + b - e - v), i, v) for i, v in enumerate((a, b, e)))[2])[kind]) % 256
        rows.append(bytes(row))
    return rows


def test_media_digests_against_plain_code(spark, corpus):
    decoded = {r.doc_id: r for r in media.decode(media.encode(documents(spark, corpus))).collect()}
    for r in media.digest(media.decode(media.encode(documents(spark, corpus)))).collect():
        d = decoded[r.doc_id]
        rows = plain_png(d.media)
        assert b"".join(rows) == d.payload and r.media_bytes == len(d.media) and r.media_sha256 == hashlib.sha256(d.media).hexdigest() and r.payload_sha256 == hashlib.sha256(d.payload).hexdigest()
        grey = [[sum(row[3 * x : 3 * x + 3]) / 3 for x in range(64)] for row in rows]
        h, side = len(grey), 32
        if h > 40 and r.doc_id % 5:
            continue  # long pictures take long by loops
        span = lambda n, k: range(k * n // side, max(k * n // side + 1, (k + 1) * n // side))
        small = [[np.mean([grey[y][x] for y in span(h, i) for x in span(64, j)]) for j in range(side)] for i in range(side)]
        wave = [[math.cos(math.pi * k * (2 * i + 1) / (2 * side)) for i in range(side)] for k in range(8)]
        low = [round(sum(small[i][j] * wave[u][i] * wave[v][j] for i in range(side) for j in range(side)), 6) for u in range(8) for v in range(8)]
        middle = float(np.median(low[1:]))
        bits = [0] + [int(x > middle) for x in low[1:]]
        near = sum(abs(x - middle) < 2e-6 for x in low[1:]) - 1
        got = [int(b) for b in f"{int(r.feature, 16):064b}"]
        assert sum(a != b for a, b in zip(got, bits, strict=True)) <= near


def test_pipeline_against_brute_force(spark, corpus, tmp_path):
    import corpus_pipeline

    top = str(tmp_path / "sf")
    rows = [r for r in corpus if r[0] is not None]
    draw = random.Random(4)
    rows = [(d, t, "xx" if i % 5 == 0 and t else lang, s) for i, (d, t, lang, s) in enumerate(rows)]
    rows += [(2000 + i, " ".join("".join(draw.choice("абвгдежзиклмн") for _ in range(6)) for _ in range(50)), None, "hot") for i in range(2)]
    documents(spark, rows).write.parquet(f"{top}/documents.parquet")
    got = sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in corpus_pipeline.run(spark, top).collect())
    unlearned = F.expr("crc32(CAST(doc_id AS STRING)) % 4 = 2")
    model = langid.train(documents(spark, rows), ~unlearned)
    limits = langid.calibrate(documents(spark, rows).where(unlearned), model)
    judged = [plain_judge(r[1], model) for r in rows]
    fill = [[(j[3] * j[k] + langid.FILL * u) / (j[3] + langid.FILL) for k, u in zip((1, 2), limits.usual, strict=True)] for j in judged]
    stage = [r for r, j, f in zip(rows, judged, fill, strict=True) if j[0] != "und" and all(a >= b for a, b in zip(f, limits.least, strict=True))]
    assert {2000, 2001} & {r[0] for r in rows} and not {2000, 2001} & {r[0] for r in stage} and len(stage) > 100
    stage = [(d, t, *r[2:]) for r, (d, _, _, t) in zip(stage, brute_lines(stage), strict=True)]
    heads = {c for d, _, c in brute_components(stage) if d == c}
    seen, once = set(), []
    for r in stage:
        if r[0] in heads and r[0] not in seen:
            seen.add(r[0])
            once.append(r)
    size, target = brute_mix(once)
    want = []
    for s in size:
        before, laid = 0, sorted((r for r in once if r[3] == s), key=lambda r: hashlib.md5(f"{mixing.SEED}|{r[0]}".encode()).hexdigest())
        epochs = math.floor(target[s] / size[s]) if size[s] else 1
        for r in laid:
            n = len(words(r[1]))
            copies = epochs + (before + n / 2 <= target[s] - epochs * size[s] and epochs < 3)
            before += n
            want += copies * brute_pieces(r[0], r[1])
    assert got == sorted(want)


def test_language_fit_runs_in_a_task(spark, monkeypatch):
    """The field is fitted where no driver memory is used, and comes back as it was fitted."""
    import os

    words = {"x": "alpha beta gamma delta", "y": "uno dos tres cuatro"}
    rows = [(i, f"{words[lang]} {i}", lang) for i, lang in enumerate("xyxyxyxy")]
    want = langid.fit([(text, lang) for _, text, lang in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.train(docs, F.lit(True))
    assert got.languages == want.languages and got.lexicons == want.lexicons and (got.seen == want.seen).all()
    assert got.weights.dtype == want.weights.dtype and np.allclose(got.weights, want.weights) and np.allclose(got.moves, want.moves) and np.allclose(got.start, want.start)
    monkeypatch.setattr(langid, "fit", lambda rows: langid.Model((str(os.getpid()),), np.zeros((langid.DIMS, 1)), np.zeros((1, 1)), np.zeros(1), (frozenset(),), np.zeros(langid.DIMS, bool)))
    assert langid.train(docs, F.lit(True)).languages != (str(os.getpid()),)


def test_ngram_join_leaves_no_used_up_tables(spark, corpus, monkeypatch):
    """The exchange of all shingles ends at a table of the shared ones; that one, edges and labels of rounds that are over are deleted."""
    import os

    made, write = [], ngramjoin.written

    def kept(df, name, free=False):
        made.append(out := write(df, name, free))
        return out

    monkeypatch.setattr(ngramjoin, "written", kept)
    texts = ngramjoin.survivors(documents(spark, corpus))
    counted = next(x for x in made if "/ngram-counted-" in x._quillrank_path)
    assert not os.path.exists(counted._quillrank_path.removeprefix("file:")) and "ngram-counted" not in texts._jdf.queryExecution().toString()
    chain = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(40)], "a string, b string")
    made.clear()
    labels = ngramjoin.components(chain)
    assert {r.root for r in labels.collect()} == {"n00"} and len(made) > 3
    assert [os.path.exists(x._quillrank_path.removeprefix("file:")) for x in made] == [False] * (len(made) - 1) + [True]


def test_language_field_learns_from_every_document(spark):
    """Words that only documents beyond the start have are learned too, and what every task changed is averaged; limits come from all held-out documents."""
    draw = random.Random(3)
    rows = [(i, made(draw, lang, 40), lang) for i in range(90) for lang in ("aa", "bb")]
    rare = [(1000 + i, " ".join(draw.choice(["quux", "zyzzy", "wyrd"]) for _ in range(30)), "bb") for i in range(30)]
    docs = spark.createDataFrame(rows + rare, "doc_id long, text string, lang string").repartition(3).cache()
    start = langid.fit([r[1:] for r in rows[:40]])
    model = langid.learned_from_all(start, docs, 1.0)
    cells = langid.features(["zyzzy"], start.lexicons)[0]
    assert not start.seen[cells].all() and model.seen[cells].all() and (model.weights[cells, 1] > model.weights[cells, 0]).mean() > 0.9
    again = langid.learned_from_all(start, docs, 1.0)
    assert (again.weights == model.weights).all() and (again.moves == model.moves).all()
    lead = lambda m: [w[1] - w[0] for w in langid.Labeller(m)._emissions(["quux", "zyzzy", "wyrd"])]
    assert all(x > y + 0.3 for x, y in zip(lead(model), lead(start), strict=True))
    assert langid.Labeller(model).label([r[1] for r in rows])[0] == [r[2] for r in rows]
    all_, few = langid.train(docs, F.lit(True)), langid.train(docs, F.lit(True), sample=20)
    assert all_.seen[cells].all() and few.seen[cells].mean() > 0.9
    odd = docs.where("doc_id < 1000").unionByName(spark.createDataFrame([(5000, "\u0431\u0432\u0433 " * 40, "bb")], docs.schema))
    assert langid.calibrate(odd, start, sample=90).least[1] < langid.calibrate(docs.where("doc_id < 1000"), start, sample=90).least[1]
