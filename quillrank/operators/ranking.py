"""Total orders, rank ledgers and what ties do to them. A block is one (baseline, query)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions import scalars as S
from quillrank.shipping import ship

BLOCK = ["baseline", "query"]
#: Ranks that are looked at together for runs.
STRETCH = 1 << 15


def tie(salt: str) -> Column:
    return S.salted(salt, F.col("query").cast("string"), F.col("target").cast("string"))


def ranked(scores: DataFrame, salt: str, block: list[str] | None = None, tied: str | None = None) -> DataFrame:
    """Ranks by score, then salted hash (the column named tied, if it is made already), then target, and the number of eligible targets. Masked pairs are not in scores.

    Both windows share one exchange by block.
    """
    w = Window.partitionBy(*(block or BLOCK))
    order = w.orderBy(F.desc("score"), F.col(tied) if tied else tie(salt), "target")
    out = scores.withColumn("rank", F.row_number().over(order)).withColumn("eligible", F.count("*").over(w))
    return out.drop(tied) if tied else out


def leading_limits(relevant: DataFrame, blocks: DataFrame, k: int, within: list[str], block: list[str] | None = None) -> DataFrame:
    """block and limit: no relevant cell whose rank is at most k, or the first of its group by ``within``, has a score below it. relevant: block, score and within."""
    block = block or BLOCK
    kth = blocks.where((F.col("start") <= k) & (F.col("end") >= k)).select(*block, F.col("score").alias("_kth"))
    reaches = F.when(F.col("_kth").isNull() | (F.col("score") >= F.col("_kth")), F.col("score"))
    each = relevant.join(kth, block, "left").groupBy(*dict.fromkeys([*block, *within])).agg(F.max("score").alias("_best"), F.min(reaches).alias("_near"))
    return each.groupBy(*block).agg(F.least(F.min("_best"), F.min("_near")).alias("limit"))


def tie_limits(relevant: DataFrame, blocks: DataFrame, limits: DataFrame, k: int, within: list[str], salt: str, block: list[str] | None = None) -> DataFrame:
    """``limits`` with tie_limit, and end, the last rank of the limit's run: no cell of that run whose rank is at most k, nor the first relevant one of a group by ``within``, has a tie above tie_limit.

    So of a run that holds most cells of a block few are ranked. Ties are evenly spread; that enough are below the limit is checked where they are ranked.
    """
    block = block or BLOCK
    run = limits.join(blocks.select(*block, F.col("score").alias("limit"), "start", "end", "size"), [*block, "limit"])
    at = relevant.join(limits, block).where("score = limit").groupBy(*dict.fromkeys([*block, *within])).agg(F.min(tie(salt)).alias("_first"))
    wanted = F.greatest(F.lit(k) - F.col("start") + 1, F.lit(0))
    share = F.when(wanted > 0, (wanted + 10 * F.sqrt(wanted) + 50) / F.col("size")).otherwise(0.0)
    even = F.when(share >= 1, "g").otherwise(F.concat(F.lpad(F.lower(F.hex(F.floor(share * F.lit(float(1 << 60))).cast("long"))), 15, "0"), F.lit("f")))
    firsts = at.groupBy(*block).agg(F.max("_first").alias("_first"))
    return run.join(firsts, block).select(*block, "limit", F.greatest(even, F.col("_first")).alias("tie_limit"), "end", F.least(F.lit(k), F.col("end")).alias("least"))


def leading_ranks(relevant: DataFrame, blocks: DataFrame, above: DataFrame, salt: str, block: list[str] | None = None, limits: DataFrame | None = None) -> DataFrame:
    """Relevant cells with rank: the ledger's where their score reaches the limit, so up to k and for the first of each group; else the first rank of their run, which is above both.

    above: block, target and score of all cells that reach the limit. limits: block and limit, where at hand: relevant cells below it then meet the runs alone, and only the others the ranks.
    With limits of ``tie_limits``, cells of the limit's run with a tie above tie_limit aren't in above and have the last rank of their run, which is above those of the others too.
    """
    block = block or BLOCK
    if limits is not None and "tie_limit" in limits.columns:
        cut = F.broadcast(limits.select(*block, "limit", "tie_limit", F.col("end").alias("_end"), F.col("least").alias("_least")))
        ahead = F.when(F.col("score") > F.col("limit"), True).otherwise((F.col("score") == F.col("limit")) & (tie(salt) <= F.col("tie_limit")))
        placed = relevant.join(cut, block).withColumn("_ahead", ahead)
        exact = ranked(above, salt, block).select(*block, "target", F.col("rank").alias("_rank"), F.col("eligible").alias("_found"))
        rank = F.when(F.col("_found") >= F.col("_least"), F.col("_rank")).otherwise(F.raise_error(F.lit("fewer cells than asked for have ties below the limit")).cast("int"))
        more = ["limit", "tie_limit", "_end", "_least", "_ahead"]
        near = placed.where("_ahead").join(exact, [*block, "target"]).withColumn("rank", rank).drop("_rank", "_found", *more)
        beyond = placed.where("NOT _ahead AND score = limit").withColumn("rank", F.col("_end")).drop(*more)
        far = placed.where("score < limit").join(blocks.select(*block, "score", F.col("start").alias("rank")), [*block, "score"]).drop(*more)
        return near.unionByName(beyond).unionByName(far)
    exact = ranked(above, salt, block).select(*block, "target", F.col("rank").alias("_rank"))
    if limits is not None:
        placed = relevant.join(F.broadcast(limits.select(*block, "limit")), block)
        near = placed.where("score >= limit").join(exact, [*block, "target"]).withColumnRenamed("_rank", "rank").drop("limit")
        far = placed.where("score < limit").join(blocks.select(*block, "score", F.col("start").alias("rank")), [*block, "score"]).drop("limit")
        return near.unionByName(far)
    rows = relevant.join(exact, [*block, "target"], "left").join(blocks.select(*block, "score", "start"), [*block, "score"])
    return rows.withColumn("rank", F.coalesce("_rank", "start")).drop("_rank", "start")


def ranked_beside(cells: DataFrame, salt: str, many: int) -> DataFrame:
    """Ranks _r0, _r1 and so on by the scores _s0, _s1 and so on of a cell, in the order of ``ranked``, and eligible; all windows share one exchange by query. The hash goes as its 8 bytes."""
    w = Window.partitionBy("query")
    rows = cells.withColumn("_tie", F.unhex(tie(salt)))
    for k in range(many):
        rows = rows.withColumn(f"_r{k}", F.row_number().over(w.orderBy(F.desc(f"_s{k}"), "_tie", "target")))
    return rows.drop("_tie").withColumn("eligible", F.count("*").over(w))


def ranked_by_ties(cells: DataFrame, starts: DataFrame, salt: str, many: int, only: str | None = None) -> DataFrame:
    """``ranked_beside`` without a window and without eligible: cells are sorted once, by salted hash and target alone, which is the order inside the runs of every score.

    A rank is the first of its run plus the number of its query's cells of that score that have streamed by, so a task holds a
    count for each run and no cell, and all scores take the one sort.
    starts: query, number (of the score), score and start, the first rank of each run. only: a flag of the cells whose ranks are asked for; the others just count.
    """
    scores = [f"_s{k}" for k in range(many)]
    kind = "query string, target string, " + ", ".join([f"{c} double" for c in scores] + [f"_r{k} int" for k in range(many)])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead: dict[str, list[dict[float, int]]] = {}
        runs: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for whole in batches:
            start = whole.column("_start")
            first = pc.filter(pa.table({"query": whole.column("query"), "number": whole.column("_number"), "score": whole.column("_s0"), "start": start}), pc.is_valid(start))
            for r in first.to_pylist():  # runs come before all cells
                ahead.setdefault(r["query"], [{} for _ in scores])[r["number"]][r["score"]] = r["start"]
            batch = whole.filter(pc.is_null(start))
            if not batch.num_rows:
                continue
            for q in [q for q in ahead if q not in runs]:
                runs[q] = [(np.array(sorted(x)), np.array([x[v] for v in sorted(x)], dtype=np.int64)) for x in ahead[q]]
            coded = batch.column("query").dictionary_encode()
            index = coded.indices.to_numpy(zero_copy_only=False)
            ranks = np.empty((many, batch.num_rows), dtype=np.int64)
            values = [batch.column(c).to_numpy(zero_copy_only=False) for c in scores]
            for code, q in enumerate(coded.dictionary.to_pylist()):
                here = np.flatnonzero(index == code)
                for k in range(many):
                    known, following = runs[q][k]
                    at = np.searchsorted(known, values[k][here])
                    if (known[np.minimum(at, len(known) - 1)] != values[k][here]).any():
                        raise ValueError(f"a score of {q} has no run")
                    order = np.argsort(at, kind="stable")
                    n = np.bincount(at, minlength=len(known))
                    place = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                    ranks[k, here[order]] = following[at[order]] + place
                    following += n
            columns = [batch.column(c) for c in ("query", "target", *scores)] + [pa.array(r.astype(np.int32)) for r in ranks]
            out = pa.RecordBatch.from_arrays(columns, names=["query", "target", *scores, *(f"_r{k}" for k in range(many))])
            yield out.filter(batch.column("_only")) if only else out

    ship(cells.sparkSession)
    shown = F.col(only) if only else F.lit(True)
    rows = cells.select("query", "target", *scores, shown.alias("_only"), F.unhex(tie(salt)).alias("_tie"), F.lit(None).cast("int").alias("_number"), F.lit(None).cast("int").alias("_start"))
    first = starts.select("query", F.lit(None).cast("string").alias("target"), F.col("score").alias("_s0"), *(F.lit(None).cast("double").alias(c) for c in scores[1:]), F.lit(False).alias("_only"), F.lit(None).cast("binary").alias("_tie"), F.col("number").cast("int").alias("_number"), F.col("start").cast("int").alias("_start"))
    placed = rows.unionByName(first).repartition("query").sortWithinPartitions(F.asc_nulls_first("_tie"), "target")
    return placed.drop("_tie").mapInArrow(number, kind)


def ranked_in_ranges(scores: DataFrame, salt: str, block: list[str] | None = None, tied: str | None = None, parts: int | None = None, once: bool = True) -> DataFrame:
    """The same ranks and counts when a block is too large for one task: rows are sorted by ranges of (block, order), and a rank is the number of its block's rows in the ranges before plus the place within the own.

    Spark cuts the ranges, also inside a block. Only a row for each range and block is summed up in order; no window goes over raw rows, and
    what is summed up is written, so that its size is known and the ranked rows needn't be dealt again to meet it. The hash goes as its 8 bytes.
    once: scores are written before they are sampled and read; else they are made twice and take no disk.
    """
    from quillrank.operators.graph import shared

    block = block or BLOCK
    tied_here = scores if tied else scores.withColumn("_tie", F.unhex(tie(salt)))
    order = [*(F.col(c) for c in block), F.desc("score"), F.col(tied or "_tie"), F.col("target")]
    rows = shared(tied_here, "rank-scores") if once else tied_here
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33))
    placed = shared(placed.drop(tied or "_tie"), "rank-ranges")
    each = placed.groupBy(*block, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy(*block)
    ahead = each.withColumns({"_before": F.sum("_n").over(w.orderBy("_part")) - F.col("_n"), "eligible": F.sum("_n").over(w)}).drop("_n")
    out = placed.join(shared(ahead, "rank-ahead"), [*block, "_part"])
    return out.withColumn("rank", F.col("_before") + F.col("_row") - F.col("_first") + 1).select(*[c for c in scores.columns if c != tied], "rank", "eligible")


def tie_blocks(ledger: DataFrame, block: list[str] | None = None) -> DataFrame:
    """First and last rank and size of each run of equal scores. Scores are enough, ranks aren't read: runs are counted, and the counts of better ones summed up."""
    return counted_blocks(ledger.groupBy(*(block or BLOCK), "score").agg(F.count("*").alias("size")), block)


def counted_blocks(out: DataFrame, block: list[str] | None = None) -> DataFrame:
    """The same from the sizes of runs: block, score, size."""
    block = block or BLOCK
    end = F.sum("size").over(Window.partitionBy(*block).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("end", end).select(*block, "score", (F.col("end") - F.col("size") + 1).cast("int").alias("start"), F.col("end").cast("int").alias("end"), "size")


def tie_runs(ledger: DataFrame, block: list[str] | None = None) -> DataFrame:
    """Runs of equal scores by the ledger's own ranks: block, score, runs (how often a run of that score begins), start, end, size.

    A row begins a run where no row of the same score has the rank before its own. Ranks are looked at in stretches of ``STRETCH``, the last
    row of one again before the next, so a block is never gathered or sorted in one task, runs may cross any border, and the ledger is read once.
    """
    by, rank = [*(block or BLOCK), "score"], F.col("rank")
    rows = ledger.select(*by, rank.cast("long").alias("rank"))
    here, following = F.floor(rank / STRETCH), F.floor((rank + 1) / STRETCH)
    each = rows.withColumn("_at", F.explode(F.when(here == following, F.array(here)).otherwise(F.array(here, following)))).withColumn("_own", F.col("_at") == here)
    before = F.count("*").over(Window.partitionBy(*by, "_at").orderBy("rank").rangeBetween(-1, -1))
    marked = each.withColumn("_begins", F.col("_own") & (before == 0)).where("_own")
    return marked.groupBy(*by).agg(F.count_if("_begins").alias("runs"), F.min("rank").alias("start"), F.max("rank").alias("end"), F.count("*").alias("size"))


def broken_ties(runs: DataFrame) -> DataFrame:
    """Scores whose rows aren't one contiguous run of ranks: the run comes again, has a gap or holds a rank twice."""
    return runs.where((F.col("runs") != 1) | (F.col("end") - F.col("start") + 1 != F.col("size")))


def boundary(blocks: DataFrame, k: int) -> DataFrame:
    """The run that holds rank k: whether it goes on beyond k, how many of it are within, and whether its score is 0."""
    held = blocks.where((F.col("start") <= k) & (F.col("end") >= k))
    return held.select(*[c for c in blocks.columns if c not in ("start", "end", "size", "score")], (F.col("end") > k).alias("crosses"), F.col("size").alias("block_size"), (k - F.col("start") + 1).alias("selected"), (F.col("end") - k).alias("excluded"), (F.col("score") == 0).alias("zero_score"))


def score_structure(blocks: DataFrame, block: list[str] | None = None) -> DataFrame:
    n = F.col("size")
    sums = blocks.groupBy(*(block or BLOCK)).agg(
        F.sum(n).alias("eligible"),
        F.coalesce(F.sum(F.when(F.col("score") > 0, n)), F.lit(0)).alias("positive"),
        F.count("*").alias("unique_scores"),
        F.max(n).alias("largest_block"),
        F.count_if(n > 1).alias("tied_blocks"),
    )
    return sums.withColumns({"zero": F.col("eligible") - F.col("positive"), "has_tie": F.col("unique_scores") < F.col("eligible"), "all_zero": F.col("positive") == 0, "constant": F.col("unique_scores") == 1})


def structure_by_baseline(structure: DataFrame) -> DataFrame:
    """Per baseline: queries, those with ties, all zero or constant, and the spread of positives and largest runs."""
    q = lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    spread = structure.groupBy("baseline").agg(F.count("*").alias("queries"), F.count_if("has_tie").alias("with_tie"), F.count_if("all_zero").alias("all_zero"), F.count_if("constant").alias("constant"), *(x for c in ("positive", "largest_block") for x in (F.min(c).alias(f"{c}_min"), q(c).alias(f"_{c}"), F.max(c).alias(f"{c}_max"), F.avg(c).alias(f"{c}_mean"))))
    named = {f"{c}_{n}": F.col(f"_{c}")[i] for c in ("positive", "largest_block") for i, n in enumerate(("q25", "median", "q75"))}
    return spread.withColumns(named).drop("_positive", "_largest_block")


def monotone_faults(ledger: DataFrame, block: list[str] | None = None) -> DataFrame:
    """Rows whose score is above that of the rank before."""
    w = Window.partitionBy(*(block or BLOCK)).orderBy("rank")
    return ledger.withColumn("before", F.lag("score").over(w)).where(F.col("score") > F.col("before"))


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The k first of each group in a total order; Spark drops the rest before the exchange."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)


def cut_ties(rows: DataFrame, by: list[str], score: str, k: int) -> DataFrame:
    """Groups whose k-th score is shared by more rows than fit."""
    last = top_k(rows, by, [F.desc(score)], k).groupBy(*by).agg(F.min(score).alias("_kth"), F.max("place").alias("_n"))
    counts = rows.join(last.where(F.col("_n") == k), by).groupBy(*by).agg(F.count_if(F.col(score) > F.col("_kth")).alias("above"), F.count_if(F.col(score) == F.col("_kth")).alias("equal"))
    return counts.where((F.col("above") < k) & (F.col("above") + F.col("equal") > k))


def aligned(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two ledgers side by side, with rank_a, score_a, rank_b, score_b; a key that one lacks has nulls."""
    side = lambda df, x: df.select(*keys, F.col("rank").alias(f"rank_{x}"), F.col("score").alias(f"score_{x}"))
    return side(a, "a").join(side(b, "b"), keys, "full_outer")


def ledger_changes(both: DataFrame, by: list[str], k: int) -> DataFrame:
    """Changed scores and ranks, sums and maxima of shifts, and how the first k differ."""
    shift = F.abs(F.col("rank_a") - F.col("rank_b"))
    a, b = F.col("rank_a") <= k, F.col("rank_b") <= k
    return both.groupBy(*by).agg(
        F.count("*").alias("rows"), F.count_if(~F.col("score_a").eqNullSafe(F.col("score_b"))).alias("score_changes"), F.count_if(shift > 0).alias("rank_changes"),
        F.coalesce(F.sum(shift), F.lit(0)).alias("total_shift"), F.coalesce(F.max(shift), F.lit(0)).cast("long").alias("largest_shift"), F.count_if(F.coalesce(a, F.lit(False)) != F.coalesce(b, F.lit(False))).alias("top_k_difference"),
    )


def top_jaccard(both: DataFrame, by: list[str], k: int) -> DataFrame:
    a, b = (F.coalesce(F.col(f"rank_{x}") <= k, F.lit(False)) for x in "ab")
    out = both.groupBy(*by).agg(F.count_if(a & b).alias("common"), F.count_if(a | b).alias("either"))
    return out.withColumns({"jaccard": F.when(F.col("either") > 0, F.col("common") / F.col("either")).otherwise(1.0), "identical": F.col("common") == F.col("either")})


def spearman(both: DataFrame, by: list[str]) -> DataFrame:
    """Of two complete rankings of the same n; 1 for n below 2."""
    d = (F.col("rank_a") - F.col("rank_b")).cast("double")
    n = F.col("n").cast("double")
    out = both.groupBy(*by).agg(F.count("*").alias("n"), F.sum(d * d).alias("_d2"))
    return out.withColumn("spearman", F.when(F.col("n") < 2, 1.0).otherwise(1 - 6 * F.col("_d2") / (n * (n * n - 1)))).drop("_d2")


def numbered(keys: DataFrame, column: str, name: str = "query_id", pattern: str = "query_%04d") -> DataFrame:
    """Ids by sorted key. A single order over all keys: for query sets, not fact tables."""
    return keys.select(column).distinct().withColumn(name, F.format_string(pattern, F.row_number().over(Window.orderBy(column))))
