"""Personal data by candidates and boosted trees, by DataFrame functions alone.

Base kinds (email, ip, card, phone) are found by pattern and checked by rule; they always stay. Beside them, generators
of high recall propose spans that may overlap each other (``handle``, ``number``, ``secret``); boosted trees over format
and context judge each, and a threshold for each generator, calibrated on documents that the trees have not seen, selects
what is redacted besides.

The trees learn from weak labels: a candidate that overlaps a checked base span, or that stands where a secret is
assigned, is personal. Candidates are counted by their binned features over all documents, and all of these counts are
what the driver fits to and calibrates on: bins bound their number (``BINS``), whatever the input's size. The fitted
trees are a SQL expression.

Everything of a document is computed in its own row and written once: no shuffle but that of the counts, pre-aggregated.

Patterns start where their class of characters starts, or where the last match ended (the same matches as a plain
search, but each text is passed over once), and use possessive loops, so very long texts cost linear time and no stack;
a text with n spans costs n to the power of 1.5 at most besides, n being looked up by stretches of its square root.

Edge cases: a null or empty text has no spans; equal texts have equal spans; a table without candidates has base spans
alone; repeated rows get equal rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import written

#: Trees, their depth, shrinkage, precision that a threshold must reach.
TREES, DEPTH, SHRINK, PRECISION = 16, 3, 0.4, 0.95
_MAIL = "A-Za-z0-9._%+-"


def _from_start(chars: str) -> str:
    return rf"(?:\G|(?<![{chars}]))"


#: Kind: a cheap test that a text may hold it, the pattern, the condition of a match m.
BASE = {
    "email": ("contains(t, '@')", rf"{_from_start(_MAIL)}[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true"),
    "ip": (r"rlike(t, '[0-9]\\.[0-9]+\\.[0-9]+\\.[0-9]')", rf"{_from_start('0-9')}[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"forall(split(m, '\\.'), x -> coalesce(try_cast(x AS INT) <= 255, false))"),
    "card": (r"rlike(t, '[0-9](?:[\\x20-]?[0-9]){12}')", r"[0-9](?:[\x20-]?[0-9])++", "length(d) BETWEEN 13 AND 19 AND {luhn}"),
    "phone": ("contains(t, '+')", r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 9 AND 15"),
}
GENERATORS = {
    "handle": ("rlike(t, '@|[(\\\\[][aA][tT][)\\\\]]')", rf"{_from_start(_MAIL)}[{_MAIL}]++(?:@|\x20?[(\[](?:at|AT)[)\]]\x20?)[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"),
    "number": (r"rlike(t, '[0-9](?:[\\x20().-]{0,2}[0-9]){6}')", r"(?:\G|(?<![0-9]))[0-9](?:[\x20().-]{0,2}[0-9]){6,40}+"),
    "secret": ("rlike(t, '[A-Za-z0-9_-]{20}')", rf"{_from_start('A-Za-z0-9_-')}[A-Za-z0-9_-]{{20,}}+"),
}
_LUHN = "aggregate(sequence(1, length(d)), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN CAST(substring(d, length(d) + 1 - i, 1) AS INT) WHEN CAST(substring(d, length(d) + 1 - i, 1) AS INT) > 4 THEN 2 * CAST(substring(d, length(d) + 1 - i, 1) AS INT) - 9 ELSE 2 * CAST(substring(d, length(d) + 1 - i, 1) AS INT) END) % 10 = 0"
_ASSIGNED = r"(?i)(token|secret|passw|pwd|key|auth|bearer|credential)[A-Za-z_]{0,12}[\"\x27]?\\s*[:=]?\\s*[\"\x27]?$"
#: Binned features of a candidate c: its text m, digits d, what stands before and after it.
FEATURES = {
    "generator": "c.g",
    "size": "CAST(least(7, floor(log2(length(c.m)))) AS INT)",
    "digit_share": "CAST(floor(8 * length(c.d) / length(c.m)) AS INT)",
    "digits": "CASE WHEN length(c.d) < 7 THEN 0 WHEN length(c.d) < 9 THEN 1 WHEN length(c.d) < 13 THEN 2 WHEN length(c.d) < 16 THEN 3 WHEN length(c.d) < 20 THEN 4 ELSE 5 END",
    "dots": "CAST(least(4, length(c.m) - length(replace(c.m, '.'))) AS INT)",
    "at": "IF(contains(c.m, '@'), 1, 0)",
    "hex": "IF(rlike(c.m, '^[0-9a-fA-F]+$'), 1, 0)",
    "cases": "IF(rlike(c.m, '[a-z]'), 1, 0) + IF(rlike(c.m, '[A-Z]'), 2, 0)",
    "plus": "IF(endswith(c.before, '+'), 1, 0)",
    "quoted": "IF(rlike(c.before, '[\"\\x27]$'), 1, 0) + IF(rlike(c.after, '^[\"\\x27]'), 2, 0)",
    "context": r"CASE WHEN rlike(c.before, '(?i)(token|secret|passw|pwd|key|auth|bearer|credential)') THEN 1 WHEN rlike(c.before, '(?i)(phone|tel|call|fax|mail|contact|card|iban|account|ssn|address)') THEN 2 WHEN rlike(c.before, '(?i)(version|licen|cc by|isbn|issn|doi)') THEN 3 ELSE 0 END",
}
#: Bins of each feature. No more patterns than their product can exist; most of it cannot (a number has no letters, a secret no dots).
BINS = {"generator": 3, "size": 8, "digit_share": 9, "digits": 6, "dots": 5, "at": 2, "hex": 2, "cases": 4, "plus": 2, "quoted": 4, "context": 4}


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _once(value: str, name: str, body: str) -> str:
    """SQL: body, in which name stands for value, worked out once (a lambda over a singleton)."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _blocks(name: str, body: str) -> str:
    """SQL: body for each stretch b of the array called name, of about the square root of its size."""
    side = f"CAST(ceil(sqrt(size({name}))) AS INT)"
    return f"IF(size({name}) = 0, array(), transform(transform(sequence(0, (size({name}) - 1) DIV {side}), j -> slice({name}, CAST(j * {side} + 1 AS INT), {side})), b -> {body}))"


def _sums_before(values: str) -> str:
    """SQL: of an array of INT, the sum of all elements before each, by stretches, so that no step copies what it has beyond a stretch."""
    within = "aggregate(b, struct(0 AS at, CAST(array() AS ARRAY<INT>) AS out), (a, v) -> struct(a.at + v AS at, array_append(a.out, a.at) AS out))"
    ahead = "aggregate(slice(w, 1, k), 0, (a, q) -> a + q.at)"
    return _once(values, "x", _once(_blocks("x", within), "w", f"flatten(transform(w, (q, k) -> {_once(ahead, 'first', 'transform(q.out, o -> o + first)')}))"))


def _found(test: str, pattern: str, extra: str = "") -> str:
    """SQL: all matches of a pattern in t, as structs of start, stop (code points), m, d (its digits) and what is named in extra.

    The pieces between matches and the matches themselves come from the same search, so their lengths give the places.
    """
    p = _quoted(pattern)
    one = f"struct(get(s, k) + length(get(z.p, k)) AS start, get(s, k) + length(get(z.p, k)) + length(m) AS stop, m, regexp_replace(m, '[^0-9]', '') AS d{extra})"
    sums = _sums_before("transform(z.m, (m, k) -> length(get(z.p, k)) + length(m))")
    kinds = "start: INT, stop: INT, m: STRING, d: STRING" + (", g: INT, before: STRING, after: STRING" if extra else "")
    all_of = _once(f"struct(split(t, {p}, -1) AS p, regexp_extract_all(t, {p}, 0) AS m)", "z", _once(sums, "s", f"transform(z.m, (m, k) -> {one})"))
    return f"IF({test} AND rlike(t, {p}), {all_of}, CAST(array() AS ARRAY<STRUCT<{kinds}>>))"


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, t (the text) and for each base kind its checked spans."""
    out = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("t"))
    columns = {}
    for kind, (test, pattern, condition) in BASE.items():
        said = condition.replace("{luhn}", _LUHN)
        for name in "md":
            said = said.replace(f"({name},", f"(x0.{name},").replace(f"({name})", f"(x0.{name})")
        columns[kind] = F.expr(f"filter({_found(test, pattern)}, x0 -> {said})")
    return out.withColumns(columns)


def candidates(spans: DataFrame) -> DataFrame:
    """doc_id, base (all base spans) and candidates: place, known (a base span overlaps it), assigned (it stands where a secret is assigned) and binned features.

    Base spans are looked up by stretches of them in the order of their starts: a candidate reads the stretches' ends and
    the spans of the one or two stretches that it reaches.
    """
    base = "concat(" + ", ".join(f"transform({k}, x -> struct('{k}' AS kind, x.start, x.stop))" for k in BASE) + ")"
    found = []
    for g, (test, pattern) in enumerate(GENERATORS.values()):
        found.append(_found(test, pattern, f", {g} AS g, right(get(z.p, k), 32) AS before, left(get(z.p, k + 1), 8) AS after"))
    binned = ", ".join(f"{sql} AS {name}" for name, sql in FEATURES.items())
    stretches = _once("sort_array(transform(base, x -> struct(x.start, x.stop)))", "places", _blocks("places", "struct(b[0].start AS low, array_max(transform(b, x -> x.stop)) AS high, b AS held)"))
    known = "exists(near, q -> q.low < c.stop AND c.start < q.high AND exists(q.held, b -> b.start < c.stop AND c.start < b.stop))"
    assigned = f"c.g = 2 AND length(c.d) > 0 AND rlike(c.before, '{_ASSIGNED}')"
    each = f"transform(raw, c -> struct(c.start, c.stop, {known} AS known, {assigned} AS assigned, {binned}))"
    with_base = spans.withColumn("base", F.expr(base)).withColumn("raw", F.expr(f"concat({', '.join(found)})"))
    return with_base.select("doc_id", "base", F.expr(_once(stretches, "near", each)).alias("candidates"))


def _fit(rows: list[tuple[tuple[int, ...], int, int]]) -> tuple[float, list]:
    """Boosted trees on counted patterns (features, label, count): logistic loss, second-order gains, nested (feature, cut, left, right)."""
    total, hits = sum(n for *_, n in rows), sum(y * n for _, y, n in rows)
    start = math.log((hits + 1) / (total - hits + 1))
    scores, trees = [start] * len(rows), []

    def grow(at: list[int], slopes: list[tuple[float, float]], depth: int):
        g, h = sum(slopes[i][0] for i in at), sum(slopes[i][1] for i in at)
        best = (1e-6, None)
        for f in range(len(FEATURES)) if depth else ():
            sums: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
            for i in at:
                s = sums[rows[i][0][f]]
                s[0] += slopes[i][0]
                s[1] += slopes[i][1]
            a = b = 0.0
            for cut in sorted(sums)[:-1]:
                a, b = a + sums[cut][0], b + sums[cut][1]
                gain = a * a / (b + 1) + (g - a) ** 2 / (h - b + 1) - g * g / (h + 1)
                if gain > best[0] + 1e-9:
                    best = (gain, (f, cut))
        if best[1] is None:
            return -SHRINK * g / (h + 1)
        f, cut = best[1]
        return (f, cut, grow([i for i in at if rows[i][0][f] <= cut], slopes, depth - 1), grow([i for i in at if rows[i][0][f] > cut], slopes, depth - 1))

    for _ in range(TREES if 0 < hits < total else 0):
        chances = [1 / (1 + math.exp(-s)) for s in scores]
        slopes = [((p - y) * n, p * (1 - p) * n) for p, (_, y, n) in zip(chances, rows, strict=True)]
        trees.append(grow(list(range(len(rows))), slopes, DEPTH))
        scores = [value(s, trees[-1:], x) for s, (x, *_) in zip(scores, rows, strict=True)]
    return start, trees


def _sql(tree) -> str:
    if not isinstance(tree, tuple):
        return f"{tree:.9f}D"
    f, cut, left, right = tree
    return f"IF(c.{list(FEATURES)[f]} <= {cut}, {_sql(left)}, {_sql(right)})"


def value(start: float, trees: list, x: tuple[int, ...]) -> float:
    """The score of binned features."""
    for tree in trees:
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        start += tree
    return start


def learned(rows: list[tuple[bool, tuple[tuple[int, ...], int, int]]]) -> tuple[float, list, dict[int, float]]:
    """rows: whether a pattern is held out, and the counted pattern (features, label, count); start, trees and each generator's threshold."""
    rows = sorted(rows, key=lambda r: (-r[1][2], r[0], *r[1]))
    held, seen = ([r for h, r in rows if h == want] for want in (True, False))
    start, trees = _fit(seen)
    thresholds = {}
    for g in range(len(GENERATORS)):
        mine = sorted(((value(start, trees, x), y, n) for x, y, n in held if x[0] == g), reverse=True)
        best, hits, total, at = 1e9, 0, 0, 0
        while at < len(mine):  # patterns of one score pass together
            level = mine[at][0]
            while at < len(mine) and mine[at][0] == level:
                hits, total, at = hits + mine[at][1] * mine[at][2], total + mine[at][2], at + 1
            if total and hits / total >= PRECISION:
                best = level
        thresholds[g] = max(best, 0.0)  # never what is likelier not personal
    return start, trees, thresholds


def train(spans: DataFrame) -> tuple[str, str]:
    """SQL of a candidate c's score, and of the threshold of its generator."""
    # calibration holds out every third document, by a hash
    label = (F.col("known") | F.col("assigned")).cast("int").alias("label")
    each = spans.select((F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("held"), F.explode("candidates").alias("c")).select("held", "c.*").select("held", label, *FEATURES)
    counts = each.groupBy(*FEATURES).agg(*(F.count_if((F.col("held") == bool(h)) & (F.col("label") == y)).alias(f"n_{h}{y}") for h in (0, 1) for y in (0, 1)))
    rows = []
    for r in counts.toArrow().to_pylist():
        x = tuple(r[f] for f in FEATURES)
        rows += [(h == 1, (x, y, n)) for h in (0, 1) for y in (0, 1) if (n := r[f"n_{h}{y}"])]
    start, trees, thresholds = learned(rows)
    cases = " ".join(f"WHEN {g} THEN {t - 1e-6:.6f}D" for g, t in thresholds.items())
    return " + ".join([f"{start:.9f}D", *map(_sql, trees)]), f"CASE c.generator {cases} END"


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, base and added: arrays of (kind, start, stop), in the order of kinds, then start.

    What is found is written once, for the trees to learn from and to judge.
    """
    proposed = written(candidates(base_spans(docs)), "pii-spans")
    score, threshold = train(proposed)
    names = ", ".join(f"'{g}'" for g in GENERATORS)
    added = f"transform(filter(candidates, c -> NOT c.known AND {score} >= {threshold}), c -> struct(element_at(array({names}), c.generator + 1) AS kind, c.start, c.stop))"
    return proposed.select("doc_id", "base", F.expr(added).alias("added"))


def redacted(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id and text with every span as its kind in brackets (overlapping spans as the first); docs and found by unique doc_id."""
    ordered = "array_sort(concat(base, added), (l, r) -> CASE WHEN l.start <> r.start THEN l.start - r.start ELSE r.stop - l.stop END)"
    step = "(a, x) -> IF(x.start < a.at, a, struct(x.stop AS at, concat(a.s, substring(text, a.at + 1, x.start - a.at), '[', x.kind, ']') AS s))"
    return docs.join(found, "doc_id").select("doc_id", F.expr(f"aggregate({ordered}, struct(0 AS at, '' AS s), {step}, a -> concat(a.s, substring(text, a.at + 1)))").alias("text"))


def find(docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    found = spans(docs)
    text = lambda column: F.expr(f"array_join(transform({column}, x -> concat_ws(':', x.kind, x.start, x.stop)), ',')")
    return found.select("doc_id", *(F.expr(f"CAST(size(filter(base, x -> x.kind = '{k}')) AS LONG) AS n_{k}") for k in BASE), F.sha2(text("base"), 256).alias("base_sha256"), text("concat(base, added)").alias("spans"))
