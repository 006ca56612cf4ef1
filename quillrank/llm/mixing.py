"""Mixing sources to target weights, by DataFrame functions alone.

Sources share the total of all sizes by weight, none beyond ``limit`` times its own size (the excess goes to the
others by weight). Each document gets a hash-random key; within a source the documents are laid out in key order and
their sizes summed up; a source's target is met by whole epochs and, of the last one, the documents whose middle lies
before the exact budget.

The running sums are distributed: keys fall into slices of the key range, a window inside each (source, slice) sums up
its rows, and the slices' totals, one small row each, are summed up per source. So a source with a third of all rows
is spread over as many tasks as the others.

Edge cases: a null text has size 0; null is a source of its own, the last; documents of size 0 are laid out and taken
0 words; a table without words gives targets of 0; rows with equal doc_id are ordered by size and otherwise alike, so
reruns agree; a null doc_id has the key of the empty text; other columns are kept by ``mixed``, whatever their names.
Sources are some thousands at most: their totals, one row each, meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.llm.common import WS, written

#: Rows of a source that one task orders, about; slices of the key range, at least.
SLICE_ROWS, SLICES = 20_000, 64
SEED, LIMIT, CYCLE = "mix-1", 3, 3


def words_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{WS[1:]}+")).cast("long")


def key(doc_id: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def targets(sizes: DataFrame, limit: int = LIMIT, cycle: int = CYCLE) -> DataFrame:
    """sizes: source, source_size, rows; one row per source. Adds weight and target.

    Shares by weight under a cap, in one pass: sources in the order of cap by weight fill up while their cap lies below
    the level that the rest would get.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % cycle + 1).withColumn("cap", limit * F.col("source_size"))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    left = weighed.select("*", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("words_left"), (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"), F.row_number().over(filling).alias("turn"))
    stops = F.col("cap") * F.col("weight_left") >= F.col("words_left") * F.col("weight")
    at = left.withColumn("stop", F.min(F.when(stops, F.col("turn"))).over(everything))
    level = at.withColumns({f"stop_{c}": F.max(F.when(F.col("turn") == F.col("stop"), F.col(c))).over(everything) for c in ("words_left", "weight_left")})
    share = F.col("stop_words_left").cast("double") * F.col("weight") / F.col("stop_weight_left")
    return level.select("source", "source_size", "rows", "weight", F.when(F.col("turn") < F.col("stop"), F.col("cap").cast("double")).otherwise(F.coalesce(share, F.col("cap").cast("double"))).alias("target"))


def laid_out(docs: DataFrame, slim: DataFrame, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target and copies (how often the mix takes the document).

    slim: doc_id, source and size of docs, written, so that sizes are counted once for the totals.
    """
    sources = written(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))), "mix-sources")
    rows = sources.agg(F.sum("rows")).first()[0] or 0
    digits = 2
    while 16**digits < max(SLICES, rows / SLICE_ROWS):
        digits += 1
    piece = lambda c: F.substring(c, 1, digits)
    totals = slim.groupBy("source", piece(key(F.col("doc_id"), seed)).alias("_mix_slice")).agg(F.sum("size").alias("_mix_total"))
    ahead = Window.partitionBy("source").orderBy("_mix_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(totals.select("source", "_mix_slice", F.coalesce(F.sum("_mix_total").over(ahead), F.lit(0)).alias("_mix_offset")), "mix-offsets")
    keyed = docs.withColumn("_mix_key", key(F.col("doc_id"), seed)).withColumn("_mix_slice", piece(F.col("_mix_key")))
    inside = Window.partitionBy("source", "_mix_slice").orderBy("_mix_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("_mix_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    for other, by in ((offsets, ["source", "_mix_slice"]), (sources.select("source", "source_size", "target"), ["source"])):
        right = other.select([F.col(c).alias(f"_mix_r_{c}") if c in by else F.col(c) for c in other.columns])
        joined = [placed[c].eqNullSafe(right[f"_mix_r_{c}"]) for c in by]
        placed = placed.join(right, joined, "left").drop(*(f"_mix_r_{c}" for c in by))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1)).cast("long")
    rest = F.col("target") - epochs * F.col("source_size")
    once_more = (F.col("_mix_before") + F.col("_mix_offset") + F.col("size") / 2 <= rest) & (epochs < LIMIT)
    return placed.withColumn("copies", epochs + once_more.cast("long")).drop("_mix_key", "_mix_slice", "_mix_before", "_mix_offset")


def mix(docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    slim = written(docs.select("doc_id", "source", words_count(F.col("text")).alias("size")), "mix-sizes")
    out = laid_out(slim, slim)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each document's row as often as it is taken, with the columns of docs (whatever their names: they travel as one)."""
    sized = docs.select(F.struct("*").alias("_mix_doc"), F.col("doc_id"), F.col("source"), words_count(F.col("text")).alias("size"))
    slim = written(sized.select("doc_id", "source", "size"), "mix-sizes")
    return laid_out(sized, slim).where(F.col("copies") > 0).select("_mix_doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_mix_copy")).select("_mix_doc.*")


#: DuckDB SQL of the contract's rows.
SQL = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
weighed AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {CYCLE} + 1 AS weight
  FROM sized GROUP BY source),
rounds AS (
  SELECT 0 AS n, source, source_size, weight, false AS capped,
         (SELECT sum(source_size) FROM weighed)::BIGINT AS words, (SELECT sum(weight) FROM weighed)::BIGINT AS weights
  FROM weighed
  UNION ALL
  SELECT n + 1, source, source_size, weight, now, (all_words - coalesce(sum({LIMIT} * source_size) FILTER (now) OVER (), 0))::BIGINT,
         (all_weights - coalesce(sum(weight) FILTER (now) OVER (), 0))::BIGINT
  FROM (SELECT *, capped OR {LIMIT} * source_size * weights < words * weight AS now,
               sum(source_size) OVER () AS all_words, sum(weight) OVER () AS all_weights FROM rounds) WHERE n < 40),
sources AS (
  SELECT source, source_size, CASE WHEN capped OR weights = 0 THEN CAST({LIMIT} * source_size AS DOUBLE) ELSE CAST(words AS DOUBLE) * weight / weights END AS target
  FROM rounds WHERE n = 40),
placed AS (
  SELECT doc_id, size, source_size, target, coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 1 END AS epochs
  FROM sized s JOIN sources t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN before + size / 2.0 <= target - epochs * source_size AND epochs < {LIMIT} THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""
