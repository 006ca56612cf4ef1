"""Similarity join of documents by the Jaccard similarity of their word shingles: a grouped prefix join.

1. Shingles of a document are 64-bit hashes. Documents with equal sets are one text from here on (fingerprint ``fp``).
2. How many texts hold a shingle decides a global order, rare ones first: shingles meet by hash in packed rows, and those
   that one text alone holds end there. A text whose prefix (the first quarter of its shingles, plus one) has no shared
   shingle can have no partner, which ends most texts.
3. Texts with the same size and the same shared prefix are one group. Groups that share a prefix shingle are candidates;
   sizes, numbers of shared shingles and places of the common shingle filter group pairs.
4. Members are verified on their whole shared sets. First each group meets one centre of its lists and each member its
   group's head; then pairs of groups and members whose components still differ are verified, list by list. Texts outside a
   list's largest component meet the list; lists with more than ``LIGHT`` of these are parted first, by size and by
   prefixes counted within the list, again and again while that helps. Every pair that could link is either verified or already in one component, so no
   component is lost and no group emits all its pairs.

A shingle that many texts hold is marked where a mapper sees it often, and its holders do not meet in one task.

Edge cases: a null or empty text, or one of white space, has an empty set and links with nothing; fewer words than a
shingle are one shingle of the whole sequence; equal texts share a component; rows that share a doc_id share a component
only if their texts link; a null doc_id is never a component's id and has a null one if no other document is in its
component; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import coded_words, release, steps, tidy, written
from quillrank.shipping import ship

#: Words of a shingle; two texts link when 100 * intersection >= PERCENT * union.
WORDS, PERCENT = 5, 75
#: Texts of one mapper step that make a shingle a frequent one.
OFTEN = 8
#: Lists that shingles are dealt to, at least.
LISTS = 256
#: Texts outside a list's major component that meet the list at once; lists with more are parted further, so often at most.
LIGHT, LEVELS = 1000, 4
_U = np.uint64
_LIST = _U(0xFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    import xxhash

    words, index, count = coded_words(texts)
    flat = _mixed(np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words)))[index]
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(flat) - WORDS + 1), _U)
        for k in range(WORDS):
            rolled = rolled * _U(0x9E3779B97F4A7C15) + flat[k : k + len(rolled)]
        rolled = _mixed(rolled)
        out, at = [], 0
        for n in count.tolist():
            if n >= WORDS:
                out.append(np.unique(rolled[at : at + n - WORDS + 1]))
            else:
                short = _U(n)
                for h in flat[at : at + n]:
                    short = short * _U(0xD6E8FEB86659FD93) + h
                out.append(_mixed(np.array([short], _U)) if n else np.zeros(0, _U))
            at += n
    return out


def fingerprint(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def digests(docs: DataFrame, turns: bool = False) -> DataFrame:
    """doc_id, n_shingles, fp (null for an empty set), and with turns turn (a hash of the text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp", pa.binary())] + [("turn", pa.int64())] * turns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                sets = shingle_sets(part.column("text"))
                yield pa.record_batch([part.column("doc_id"), pa.array(map(len, sets), pa.int64()), pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary()), *([part.column("turn")] if turns else [])], schema=schema)

    ship(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.xxhash64("text").alias("turn")] if turns else []))
    return slim.mapInArrow(tidy(run), "doc_id long, n_shingles long, fp binary" + (", turn long" if turns else ""))


# Packed rows: column a holds 4 bytes for each entry (the text: first bytes of its fp), b 5 bytes (the shingle: 40 bits
# besides its list), c a class for each entry. Up to 24 more bits tell the list; a step's texts differ in their first 4 bytes.
PACKED = "list int, step binary, kind int, a binary, b binary, c binary"
_PACKED = pa.schema([("list", pa.int32()), ("step", pa.binary()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
ENTRIES, TEXTS, MARKED = 0, 1, 2


def _pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(column), t.type) for column, t in zip(zip(*rows, strict=True), _PACKED, strict=True)], schema=_PACKED)


def _dealt(docs: DataFrame, lists: int) -> DataFrame:
    """Packed rows of all texts by list; copies within a step are sent once."""

    def rows_of(sets: dict[bytes, np.ndarray]) -> Iterator[tuple]:
        step = hashlib.blake2b(b"".join(sorted(sets)), digest_size=16).digest()
        names = np.frombuffer(b"".join(fp[:4] for fp in sets), "<u4")
        sizes = np.array([len(s) for s in sets.values()], "<u4")
        flat, owner = np.concatenate(list(sets.values())), np.repeat(names, sizes)
        home = int.from_bytes(step[:4], "little") % lists
        yield home, step, TEXTS, b"".join(sets), sizes.tobytes(), None
        at, rest = ((flat & _LIST) % _U(lists)).astype(np.int64), flat >> _U(24)
        key = (rest << _U(24)) | at.astype(_U)
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        often = count[back] >= OFTEN
        if often.any():
            # their holders need no meeting: the list only hears of them, and they go straight to the texts
            yield home, step, MARKED, owner[often].tobytes(), rest[often].astype("<u8").tobytes(), at[often].astype("<u4").tobytes()
            told = np.unique(key[often])
            for k in np.unique(told & _LIST):
                yield int(k), step, MARKED, b"", (told[(told & _LIST) == k] >> _U(24)).astype("<u8").tobytes(), None
        at, rest, owner = at[~often], rest[~often], owner[~often]
        order = np.argsort(at, kind="stable")
        at, rest, owner = at[order], rest[order], owner[order]
        edges = np.flatnonzero(np.diff(at)) + 1
        for i, j in zip([0, *edges], [*edges, len(at)], strict=True):
            if j > i:
                yield int(at[i]), step, ENTRIES, owner[i:j].tobytes(), _pack(rest[i:j]), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                seen: list[dict[bytes, np.ndarray]] = [{}]
                for s in shingle_sets(part.column("text")):
                    fp = fingerprint(s)
                    if not len(s) or any(fp in step for step in seen):
                        continue
                    free = next((step for step in seen if not any(fp[:4] == x[:4] for x in step)), None) if len(seen) > 1 or any(fp[:4] == x[:4] for x in seen[0]) else seen[0]
                    if free is None:
                        seen.append(free := {})
                    free[fp] = s
                for step in seen:
                    if step:
                        yield _batch(list(rows_of(step)))

    ship(docs.sparkSession)
    return docs.select("text").mapInArrow(tidy(run), PACKED)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of whole lists: sends back, by step, the entries that two texts or more hold, with a class of how many."""
    held: dict[int, list[tuple]] = defaultdict(list)
    told: dict[int, list[np.ndarray]] = defaultdict(list)
    for batch in batches:
        passing = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[2] == ENTRIES:
                held[row[0]].append(row)
            elif row[2] == MARKED and not row[3]:
                told[row[0]].append(np.frombuffer(row[4], "<u8"))
            else:
                passing.append(row)
        if passing:
            yield _batch(passing)
    while held:  # a list that is done is let go
        k, rows = held.popitem()
        owner = np.concatenate([np.frombuffer(r[3], "<u4") for r in rows])
        key = np.concatenate([_unpack(r[4]) for r in rows])
        order = np.argsort(key, kind="stable")
        ordered, owners = key[order], owner[order]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(ordered)) + 1])
        length = np.diff(np.append(starts, len(ordered)))
        shared = np.minimum.reduceat(owners, starts) != np.maximum.reduceat(owners, starts)
        level = np.frompyfunc(int.bit_length, 1, 1)(length.astype(object)).astype(np.uint8)
        level[~shared] = 0
        if told[k]:
            level[np.isin(ordered[starts], np.concatenate(told[k]))] = 255
        mark = np.empty(len(key), np.uint8)
        mark[order] = np.repeat(level, length)
        at = 0
        for r in rows:
            n = len(r[3]) // 4
            part = mark[at : at + n]
            if part.any():
                yield _batch([(k, r[1], ENTRIES, owner[at : at + n][part > 0].tobytes(), _pack(key[at : at + n][part > 0]), part[part > 0].tobytes())])
            at += n


def prefix_size(n: int) -> int:
    """Shingles of a text of size n of which a partner must hold one."""
    return n - -(-PERCENT * n // 100) + 1


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of whole steps: the texts that may have a partner, with their shared shingles, those of the prefix first."""
    by_step: dict[bytes, list[tuple]] = defaultdict(list)
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            by_step[row[1]].append(row)
    schema = pa.schema([("fp", pa.binary()), ("n", pa.int32()), ("shared", pa.int32()), ("prefix", pa.int32()), ("tokens", pa.list_(pa.int64()))])
    for rows in by_step.values():
        texts = next(r for r in rows if r[2] == TEXTS)
        sizes = np.frombuffer(texts[4], "<u4")
        fps = [texts[3][i : i + 16] for i in range(0, len(texts[3]), 16)]
        owner, token, level = [np.zeros(0, "<u4")], [np.zeros(0, "<u8")], [np.zeros(0, np.uint8)]
        for list_, _, kind, a, b, c in rows:
            if kind == ENTRIES:
                owner.append(np.frombuffer(a, "<u4"))
                token.append(_unpack(b) << _U(24) | _U(list_))
                level.append(np.frombuffer(c, np.uint8))
            elif kind == MARKED:
                owner.append(np.frombuffer(a, "<u4"))
                token.append(np.frombuffer(b, "<u8") << _U(24) | np.frombuffer(c, "<u4").astype(_U))
                level.append(np.full(len(a) // 4, 255, np.uint8))
        owner, token, level = map(np.concatenate, (owner, token, level))
        order = np.lexsort((token, level, owner))
        owner, token = owner[order], token[order]
        out = []
        for fp, n in zip(fps, sizes.tolist(), strict=True):
            name = int.from_bytes(fp[:4], "little")
            i, j = np.searchsorted(owner, name), np.searchsorted(owner, name, side="right")
            own = np.unique(token[i:j], return_index=True)[1] if j > i else []
            prefix = prefix_size(n) - (n - len(own))
            if prefix > 0 and len(own):
                mine = token[i:j][np.sort(own)]
                out.append((fp, n, len(mine), prefix, mine.astype(np.int64)))
        if out:
            yield pa.record_batch([pa.array(list(c), t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def survivors(docs: DataFrame) -> DataFrame:
    """fp, n, shared, prefix (how many of tokens lead), tokens (global order), head (group): one row per text that may have a partner."""
    spark = docs.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    lists = min(max(LISTS, 4 * width), 1 << 24)  # as many more as there are more partitions
    # written, so that the exchange of all shingles is gone before the others are filled
    counted = written(_dealt(docs, lists).repartition(width, "list").mapInArrow(tidy(_counted), PACKED), "ngram-counted", free=True)
    texts = counted.repartition(width, "step").mapInArrow(tidy(_assembled), "fp binary, n int, shared int, prefix int, tokens array<long>")
    once = texts.dropDuplicates(["fp"])  # copies of a text in other steps
    out = written(once.withColumn("grp", F.md5(F.concat_ws(",", "n", F.expr("slice(tokens, 1, prefix)").cast("string")).cast("binary"))), "ngram-texts", free=True)
    release(counted)
    return out


def links(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link."""
    side = lambda x: texts.select(F.col("fp").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"tokens_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("tokens_a", "tokens_b")).alias("i"))
    return common.where(100 * F.col("i") >= PERCENT * (F.col("n_a") + F.col("n_b") - F.col("i"))).select("a", "b")


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """node and root (the smallest node of its component), of the nodes of edges (a, b).

    Each round takes the smallest label around and then the label's own label; written each round, for lineage. Labels of the round before and edges go when they are used up.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "ngram-edges")
    held = labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "ngram-labels")
    for _ in range(limit):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        least = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("root", "m").alias("next"), F.col("root").alias("was"))
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        new = written(least.join(jump, "next").select("node", F.least("next", "far").alias("root"), (F.least("next", "far") != F.col("was")).alias("moved")), "ngram-labels")
        release(held)
        held, labels = new, new.select("node", "root")
        if not new.where("moved").take(1):
            release(both)
            return labels
    raise RuntimeError(f"components did not settle in {limit} rounds")


def _within(x: str, y: str) -> str:
    """SQL: whether sizes and shared shingles of x and y leave room for a link."""
    need = f"{PERCENT} * ({x}.n + {y}.n)"
    return f"{100 + PERCENT} * least({x}.shared, {y}.shared) >= {need} AND {100 + PERCENT} * least({x}.n, {y}.n) >= {need}"


#: Cells of sizes: a text's size and that of the smaller text of a pair, to a twentieth.
_CELLS = 20.5


def _cell(n: str) -> str:
    return f"CAST(floor(ln({n}) * {_CELLS}) AS INT)"


def _mixed_lists(rows: DataFrame) -> DataFrame:
    """list, major (the component with most texts) and minor (texts of other components) of lists of several components; rows: list, root, size."""
    sums = rows.groupBy("list", "root").agg(F.sum("size").alias("size")).groupBy("list").agg(F.max(F.struct("size", "root")).alias("top"), F.sum("size").alias("texts"))
    return sums.select("list", F.col("top.root").alias("major"), (F.col("texts") - F.col("top.size")).alias("minor")).where("minor > 0")


def _pairs(rows: DataFrame, mixed: DataFrame, more: str = "true", salts: int = 1) -> DataFrame:
    """Pairs of (grp, root) of one list that could link: grp_a, root_a, grp_b, root_b; rows: list, grp, n, shared, root.

    Only what lies outside a list's major component goes to meet the list, so copies of one text make no pairs.
    """
    told = rows.join(mixed.select("list", "major"), "list")
    x = told.where("root <> major").withColumn("salt", F.pmod(F.xxhash64("grp", "root"), F.lit(salts))).alias("x")
    y = (told.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))) if salts > 1 else told.withColumn("salt", F.lit(0).cast("long"))).alias("y")
    once = "(y.root = y.major OR struct(x.grp, x.root) < struct(y.grp, y.root))"
    met = x.join(y, F.expr(f"x.list = y.list AND x.salt = y.salt AND x.root <> y.root AND {once} AND {_within('x', 'y')} AND {more}"))
    return met.select(*(F.col(f"{k}.{c}").alias(f"{c}_{n}") for k, n in (("x", "a"), ("y", "b")) for c in ("grp", "root"))).distinct()


def _parted(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Parts lists (list, fp, n, shared, root) so that any two texts of one that link share one of the new lists.

    Every pair belongs to the cell of its smaller size. Within a list and cell, where the least overlap of a link is known
    better than for any size, shingles are counted anew: those of one text there end, and prefixes take the rarest first.
    So what most texts of a list share (a template) leads no prefix, unless little else is left of a text.
    """
    largest = f"least(n, (100 * n - {100 + PERCENT} * (n - shared)) DIV {PERCENT})"
    least = f"CAST(ceil({PERCENT} * n / 100) AS INT)"
    big = f"IF({largest} >= {least}, sequence({_cell(least)}, {_cell(largest)}), CAST(array() AS ARRAY<INT>))"
    dealt = rows.withColumn("bigs", F.expr(big)).withColumn("cell", F.explode(F.expr(f"array_union(bigs, array({_cell('n')}))")))
    dealt = dealt.select("list", "cell", "fp", "n", "root", F.expr("array_contains(bigs, cell)").alias("big"), F.expr(f"cell = {_cell('n')}").alias("small"))
    met = dealt.groupBy("list", "cell").agg(F.max("big").alias("big"), F.max("small").alias("small"), F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size"), F.sum(F.xxhash64("fp").cast("decimal(38,0)")).alias("held"))
    # lists of the same texts are one
    once = met.where("big AND small AND low <> high").groupBy("cell", "size", "held").agg(F.min("list").alias("list")).select("list", "cell")
    live = written(dealt.join(once, ["list", "cell"]), "ngram-cells")
    each = live.join(texts.select("fp", "tokens"), "fp").select("list", "cell", "fp", "n", "big", F.explode("tokens").alias("token"))
    counts = each.groupBy("list", "cell", "token").agg(F.count("*").alias("times")).where("times > 1")
    from pyspark.sql import Window

    own = Window.partitionBy("list", "cell", "fp")
    placed = each.join(counts, ["list", "cell", "token"]).select("*", F.row_number().over(own.orderBy("times", "token")).alias("place"), F.count("*").over(own).alias("kept"))
    other = f"IF(big, greatest({least}, CAST(floor(exp(cell / {_CELLS})) AS INT) - 1), n)"
    need = f"CAST(ceil({PERCENT} * (n + {other}) / {100 + PERCENT}) AS INT)"
    lead = placed.where(f"place <= kept - {need} + 1").select(F.xxhash64("list", "cell", "token").alias("list"), "fp", "n", "kept")
    return lead.join(rows.select("fp", "shared").distinct(), "fp").select("list", "fp", "n", "shared")


def components_of(texts: DataFrame) -> DataFrame:
    """node (fp) and root (fp) of every text that links with another."""
    members = texts.select("grp", "fp", "n", "shared", "prefix")
    # the centre of a group or list is its text with the fewest shingles of its own
    rank = F.struct((F.col("n") - F.col("shared")) / F.col("n"), "fp")
    heads = texts.groupBy("grp").agg(F.min(rank).alias("rank"), F.min("n").alias("n"), F.max("shared").alias("shared"), F.min("prefix").alias("prefix"), F.count("*").alias("size"))
    lists = texts.join(heads.select("grp", F.col("rank.fp").alias("fp")), ["grp", "fp"]).select("grp", "fp", "n", "shared", "prefix", F.posexplode(F.expr("slice(tokens, 1, prefix)")).alias("place", "token"))
    # sizes of a link lie in one band of this width or two that touch
    band = F.floor(F.log("n") / F.lit(np.log(100 / PERCENT).item())).cast("int")
    postings = written(lists.select("token", "grp", "fp", "n", "shared", "place", band.alias("band")), "ngram-postings")
    centre = postings.groupBy("token", "band").agg(F.min(rank).alias("rank"))
    best = postings.join(centre, ["token", "band"]).groupBy("fp").agg(F.min("rank").alias("rank"))
    star = best.select(F.col("fp").alias("a"), F.col("rank.fp").alias("b"))
    inner = members.select("grp", F.col("fp").alias("a")).join(heads.where("size > 1").select("grp", F.col("rank.fp").alias("b")), "grp").select("a", "b")
    edges = written(links(texts, star.union(inner).where("a <> b").distinct()), "ngram-links")
    labels = components(edges)

    def rooted(rows: DataFrame) -> DataFrame:
        return rows.join(labels.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))

    # what is left: lists, groups and members whose components differ
    placed = written(rooted(members), "ngram-placed")
    whole = written(placed.groupBy("grp", "root").agg(F.max("shared").alias("shared"), F.count("*").alias("size")), "ngram-groups")
    posted = postings.select(F.col("token").alias("list"), "grp", "n", "place").join(whole, "grp")
    mixed = written(_mixed_lists(posted), "ngram-mixed")
    rest = f"{100 + PERCENT} * (1 + least(x.n - (x.n - x.shared) - x.place, y.n - (y.n - y.shared) - y.place)) >= {PERCENT} * (x.n + y.n)"
    pairs = _pairs(posted, mixed.where(F.col("minor") <= LIGHT), rest)
    side = lambda x: placed.select(F.col("grp").alias(f"grp_{x}"), F.col("root").alias(f"root_{x}"), F.struct("fp", "n", "shared").alias(x))
    expanded = pairs.join(side("a"), ["grp_a", "root_a"]).join(side("b"), ["grp_b", "root_b"]).where(_within("a", "b"))
    second = written(links(texts, expanded.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()), "ngram-links")
    heavy = postings.select(F.col("token").alias("list"), "grp").join(mixed.where(F.col("minor") > LIGHT).select("list"), "list").join(placed.select("grp", "fp", "n", "shared"), "grp").select("list", "fp", "n", "shared")
    for level in range(LEVELS):
        if second.take(1):
            edges = edges.union(second)
            labels = components(edges)
        if not mixed.where(F.col("minor") > LIGHT).take(1):
            return labels
        parted = written(_parted(rooted(heavy), texts), "ngram-parted")
        near = parted.groupBy("list").agg(F.min(rank).alias("rank"))
        found = rooted(texts.select("fp"))
        star = parted.join(near, "list").select(F.col("fp").alias("a"), F.col("rank.fp").alias("b")).where("a <> b").distinct()
        apart = star.join(found.select(F.col("fp").alias("a"), F.col("root").alias("_a")), "a").join(found.select(F.col("fp").alias("b"), F.col("root").alias("_b")), "b").where("_a <> _b")
        second = written(links(texts, apart.select("a", "b")), "ngram-links")
        if second.take(1):
            edges = edges.union(second)
            labels = components(edges)
        rows = written(rooted(parted).withColumn("grp", F.col("fp")).withColumn("size", F.lit(1)), "ngram-rows")
        mixed = written(_mixed_lists(rows), "ngram-mixed")
        last = level == LEVELS - 1
        pairs = _pairs(rows, mixed if last else mixed.where(F.col("minor") <= LIGHT), salts=16 if last else 1)
        second = written(links(texts, pairs.select(F.col("grp_a").alias("a"), F.col("grp_b").alias("b"))), "ngram-links")
        heavy = rows.select("list", "fp", "n", "shared").join(mixed.where(F.col("minor") > LIGHT).select("list"), "list")
    return components(edges.union(second)) if second.take(1) else labels


def joined(docs: DataFrame, turns: bool = False) -> DataFrame:
    """The contract's rows, root (the component's own name, null without words) and with turns turn."""
    told = written(digests(docs, turns), "ngram-digests", free=True)
    roots = components_of(survivors(docs))
    classes = told.where("fp IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id", "root")
    return told.join(named, "fp", "left").select("doc_id", "n_shingles", F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "root", *(["turn"] if turns else []))


def similar(docs: DataFrame) -> DataFrame:
    return joined(docs).drop("root")


def kept(docs: DataFrame) -> DataFrame:
    """One row of each component stays, of the smallest doc_id; of that id's rows in the component, the one whose text's hash is least.

    Rows that share a doc_id but not a component stay or go each with its own. The wordless rows of a doc_id are a
    component by themselves; rows with a null doc_id stay.
    """
    from pyspark.sql import Window

    # rows that share a doc_id and a text are few: the id is unique but for repeated rows
    own = joined(docs, turns=True).where("doc_id = component_id").groupBy("doc_id", "root").agg(F.min("turn").alias("_ngram_head"))
    heads = own.select(F.col("doc_id").alias("_ngram_id"), "_ngram_head").distinct()
    named = docs.where(F.col("doc_id").isNotNull()).withColumn("_ngram_text", F.xxhash64("text"))
    stay = named.join(heads, (F.col("doc_id") == F.col("_ngram_id")) & (F.col("_ngram_text") == F.col("_ngram_head")), "left_semi")
    turn = Window.partitionBy("doc_id", "_ngram_text").orderBy("_ngram_text")
    once = stay.withColumn("_ngram_turn", F.row_number().over(turn)).where("_ngram_turn = 1")
    return once.select(docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
