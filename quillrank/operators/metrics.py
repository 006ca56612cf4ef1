"""Retrieval metrics per query, their macro means, and what ties make of them exactly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.functions import scalars as S

BY = ["baseline", "scope", "query"]


def ideal_dcg(n: Column, k: int) -> Column:
    """Of min(k, n) relevant targets in front."""
    return F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), n).cast("int")), F.lit(0.0), lambda a, i: a + S.discount(i))


def per_query(relevant: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """relevant: one row per relevant target, with its rank."""
    hit = F.col("rank") <= k
    sums = relevant.groupBy(*(by or BY)).agg(F.count("*").alias("relevant"), F.count_if(hit).alias("hits"), F.coalesce(F.sum(F.when(hit, S.discount(F.col("rank")))), F.lit(0.0)).alias("_dcg"), (1 / F.min("rank")).alias("mrr"))
    return sums.withColumns({"recall": F.col("hits") / F.col("relevant"), "ndcg": F.col("_dcg") / ideal_dcg(F.col("relevant"), k)}).drop("_dcg")


def at_depths(relevant: DataFrame, depths: tuple[int, ...] = (10, 50), by: list[str] | None = None) -> DataFrame:
    """Recall and NDCG at several depths and the reciprocal rank per query, in one aggregate: relevant, mrr, then recall_k and ndcg_k for each depth k."""
    hit = {k: F.col("rank") <= k for k in depths}
    counts = [F.count_if(c).alias(f"_h{k}") for k, c in hit.items()]
    gains = [F.coalesce(F.sum(F.when(c, S.discount(F.col("rank")))), F.lit(0.0)).alias(f"_d{k}") for k, c in hit.items()]
    sums = relevant.groupBy(*(by or BY)).agg(F.count("*").alias("relevant"), (1 / F.min("rank")).alias("mrr"), *counts, *gains)
    made = {f"recall_{k}": F.col(f"_h{k}") / F.col("relevant") for k in depths} | {f"ndcg_{k}": F.col(f"_d{k}") / ideal_dcg(F.col("relevant"), k) for k in depths}
    return sums.select(*(by or BY), "relevant", "mrr", *(c.alias(n) for n, c in made.items()))


def macro(metrics: DataFrame, by: list[str], names: tuple[str, ...] = ("recall", "ndcg", "mrr")) -> DataFrame:
    return metrics.groupBy(*by).agg(F.count("*").alias("queries"), *(F.avg(n).alias(n) for n in names), *(F.count_if(F.col(n) == 0).alias(f"zero_{n}") for n in names))


def scopes(rows: DataFrame, pair_cold: Column, target_cold: dict[str, Column]) -> DataFrame:
    """Nested scopes: all rows, those whose pair is cold, and of these, per threshold, those whose target is cold too."""
    names = [F.lit("temporal"), F.when(pair_cold, F.lit("scaffold_cold")), *(F.when(pair_cold & c, F.lit(f"joint_{t}")) for t, c in target_cold.items())]
    return rows.withColumn("scope", F.explode(F.filter(F.array(*names), lambda x: x.isNotNull())))


def denominators(rows: DataFrame, names: list[str]) -> DataFrame:
    """Relations, queries, targets and tiers of every scope, also of those without a row."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(n,) for n in names], "scope string")
    counted = rows.groupBy("scope").agg(F.count("*").alias("relations"), F.count_distinct("query").alias("queries"), F.count_distinct("target").alias("targets"), F.count_if(F.col("tier").startswith("A_")).alias("tier_a"), F.count_if(F.col("tier").startswith("B_")).alias("tier_b"))
    out = every.join(counted, "scope", "left").fillna(0)
    return out.withColumn("status", F.when(F.col("queries") == 0, "not_estimable").when(F.col("queries") == 1, "n=1_descriptive_only").otherwise("estimable"))


def _fold(parts: Column, value) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + value(x))


def tie_aware(blocks: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """Exact expectation over uniform orders of ties, and what the best and worst order give, per query.

    blocks: one row per run of equal scores that holds a relevant target: start, end, size, relevant.
    """
    by = by or BY
    m, r = F.col("size"), F.col("relevant")
    start, stop = F.col("start"), F.least(F.col("end"), F.lit(k))
    s = F.greatest(stop - start + 1, F.lit(0))
    forced, possible = F.greatest(r - (m - s), F.lit(0)), F.least(r, s)
    sums = lambda a, b: F.when(b >= a, _fold(F.sequence(a.cast("int"), b.cast("int")), S.discount)).otherwise(0.0)
    none = F.when(s == 0, 1.0).when(m - r < s, 0.0).otherwise(F.when(s > 0, F.aggregate(F.sequence(F.lit(0), (s - 1).cast("int")), F.lit(1.0), lambda a, i: a * (m - r - i) / (m - i))).otherwise(1.0))
    inside, split = F.col("end") <= k, (start <= k) & (F.col("end") > k)
    each = blocks.select(
        *by, r.alias("r"),
        F.when(s > 0, r * s / m).otherwise(0.0).alias("expected"), F.when(s > 0, forced).otherwise(0).alias("worst"), F.when(s > 0, possible).otherwise(0).alias("best"),
        F.when(s > 0, r / m * sums(start, stop)).otherwise(0.0).alias("e_dcg"), F.when(s > 0, sums(stop - forced + 1, stop)).otherwise(0.0).alias("w_dcg"), F.when(s > 0, sums(start, start + possible - 1)).otherwise(0.0).alias("b_dcg"),
        inside.alias("inside"), split.alias("split"), (inside | (split & (forced > 0))).alias("sure"), (inside | split).alias("maybe"), F.when(split, 1 - none).alias("chance"),
    )
    total = lambda c: F.sum(c)
    g = each.groupBy(*by).agg(
        total("r").alias("relevant"), *(total(c).alias(c) for c in ("expected", "worst", "best", "e_dcg", "w_dcg", "b_dcg")), F.bool_or("sure").alias("guaranteed_hit"), F.bool_or("maybe").alias("possible_hit"), F.max("chance").alias("chance"),
        *(F.coalesce(F.sum(F.when(c, F.col("r"))), F.lit(0)).alias(n) for n, c in (("fixed", F.col("inside")), ("boundary", F.col("split")), ("missed", ~F.col("maybe")))),
    )
    ideal = ideal_dcg(F.col("relevant"), k)
    out = g.withColumns({f"{n}_recall": F.col(n) / F.col("relevant") for n in ("expected", "worst", "best")} | {f"{n}_ndcg": F.col(f"{n[0]}_dcg") / ideal for n in ("expected", "worst", "best")})
    hit = F.when(F.col("guaranteed_hit"), 1.0).otherwise(F.coalesce("chance", F.lit(0.0)))
    same = {f"{n}_identifiable": F.abs(F.col(f"best_{n}") - F.col(f"worst_{n}")) <= 1e-12 for n in ("recall", "ndcg")}
    return out.withColumn("hit_probability", hit).withColumns(same).drop("expected", "worst", "best", "e_dcg", "w_dcg", "b_dcg", "chance")


def upper_bound(hits: int, n: int, alpha: float = 0.05) -> float:
    """One-sided exact upper bound of a share; a closed form without hits, else bisection."""
    if hits >= n:
        return 1.0
    if hits == 0:
        return 1 - alpha ** (1 / n)
    from math import comb

    low, high = hits / n, 1.0
    for _ in range(200):
        p = (low + high) / 2
        low, high = (p, high) if sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(hits + 1)) > alpha else (low, p)
    return (low + high) / 2


def exact_upper_bound(hits: Column, n: Column, alpha: float = 0.05, rounds: int = 60) -> Column:
    """The same bound by row, for any number of hits: the binomial tail is summed up in logarithms and the share bisected. Null without trials or hits."""
    x, m = hits.cast("long"), n.cast("double")
    steps = F.when(x > 0, F.sequence(F.lit(1).cast("long"), x)).otherwise(F.array().cast("array<bigint>"))

    def tail(p: Column) -> Column:
        odds, first = F.log(p) - F.log1p(-p), m * F.log1p(-p)
        step = lambda a, i: F.struct((a["t"] + F.log((m - i + 1) / i) + odds).alias("t"), (a["s"] + F.exp(a["t"] + F.log((m - i + 1) / i) + odds)).alias("s"))
        return F.aggregate(steps, F.struct(first.alias("t"), F.exp(first).alias("s")), step, lambda a: a["s"])

    def halved(a: Column, _: Column) -> Column:
        p = (a["low"] + a["high"]) / 2
        above = tail(p) > alpha
        return F.struct(F.when(above, p).otherwise(a["low"]).alias("low"), F.when(above, a["high"]).otherwise(p).alias("high"))

    start = F.struct((x / m).alias("low"), F.lit(1.0).alias("high"))
    bisected = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halved, lambda a: (a["low"] + a["high"]) / 2)
    return F.when((n > 0) & (x >= n), 1.0).when((n > 0) & (x == 0), 1 - F.pow(F.lit(alpha), 1 / m)).when((n > 0) & (x > 0), bisected)


def zero_hit_bounds(counts: DataFrame, n: str, hits: str, alpha: float = 0.05) -> DataFrame:
    """Adds the bound where nothing was hit; null elsewhere and for no trial."""
    return counts.withColumn("upper_bound", F.when((F.col(hits) == 0) & (F.col(n) > 0), 1 - F.pow(F.lit(alpha), 1 / F.col(n))))


def missing_bounds(hits: Column, n: Column, unresolved: Column) -> Column:
    """Struct of the least and largest share that unresolved relations leave open."""
    return F.struct((hits / (n + unresolved)).alias("lower"), ((hits + unresolved) / (n + unresolved)).alias("upper"))


def preserved(a: DataFrame, b: DataFrame, keys: list[str], names: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Keys whose point estimates differ by more than the tolerance, absolutely and relatively, or that one side lacks."""
    r = b.select(*keys, *(F.col(n).alias(f"_b_{n}") for n in names), F.lit(True).alias("_b"))
    gap = lambda n: F.abs(F.col(n) - F.col(f"_b_{n}")) > tolerance * F.greatest(F.lit(1.0), F.abs(F.col(n)), F.abs(F.col(f"_b_{n}")))
    far = reduce(lambda x, y: x | y, (gap(n) for n in names))
    return a.withColumn("_a", F.lit(True)).join(r, keys, "full_outer").where(F.col("_a").isNull() | F.col("_b").isNull() | far).drop("_a", "_b")
