"""Audits: spread of measures, concentration, overlap, attrition, attribution and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUARTILES = (0.25, 0.5, 0.75)


def distribution(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, least, quartiles (between values), largest, mean; nulls are not counted, and an empty group has nulls."""
    q = F.percentile(value, F.array(*map(F.lit, QUARTILES)))
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("least"), q.alias("_q"), F.max(value).alias("largest"), F.avg(value).alias("mean"))
    return out.select(*by, "n", "least", *(F.col("_q")[i].alias(n) for i, n in enumerate(("q25", "median", "q75"))), "largest", "mean")


def concentration(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Gini coefficient, Herfindahl index, effective number, and shares of the 1, 5, 10 and 1 % (one at least) largest.

    df: one row per source with its count. Sources are numbered within a group: for tables of sources, not of facts.
    """
    w = Window.partitionBy(*by)
    v = F.col(value).cast("double")
    up, down = F.row_number().over(w.orderBy(value)), F.row_number().over(w.orderBy(F.desc(value)))
    rows = df.select(*by, v.alias("v"), up.alias("i"), down.alias("j"), F.count("*").over(w).alias("n"), F.sum(v).over(w).alias("t"))
    top = lambda k: F.coalesce(F.sum(F.when(F.col("j") <= k, F.col("v"))), F.lit(0.0)) / F.max("t")
    out = rows.groupBy(*by).agg(F.max("n").alias("sources"), F.max("t").alias("total"), F.sum(F.col("i") * F.col("v")).alias("_w"), F.sum(F.pow(F.col("v") / F.nullif(F.col("t"), F.lit(0.0)), 2)).alias("hhi"), top(F.lit(1)).alias("_top1"), top(F.lit(5)).alias("_top5"), top(F.lit(10)).alias("_top10"), top(F.greatest(F.lit(1), F.ceil(F.col("n") * 0.01))).alias("_top1pct"))
    n = F.col("sources").cast("double")
    gini = F.when(F.col("total") == 0, 0.0).otherwise(2 * F.col("_w") / (n * F.col("total")) - (n + 1) / n)
    return out.withColumns({"gini": gini, "effective": 1 / F.col("hhi")} | {k: F.col(f"_{k}") for k in ("top1", "top5", "top10", "top1pct")}).drop("_w", "_top1", "_top5", "_top10", "_top1pct")


def counted_values(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, n, before and total: how many rows of a group hold a value, how many hold a lower one, and how many there are; nulls are not counted.

    Rows are added up by value before anything is put in order. Values are then sorted by ranges of (by, value); what
    lies before is the ranges before plus the part of the own, so a group of any number of values is dealt to many tasks.
    """
    from quillrank.operators.graph import shared

    counts = shared(df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("n")), "value-counts")
    ranged = shared(counts.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "value").withColumn("_part", F.spark_partition_id()), "value-ranges")
    w = Window.partitionBy(*by)
    each = ranged.groupBy(*by, "_part").agg(F.sum("n").alias("_n"))
    ahead = each.withColumns({"_ahead": F.sum("_n").over(w.orderBy("_part")) - F.col("_n"), "total": F.sum("_n").over(w)}).drop("_n")
    inside = F.sum("n").over(Window.partitionBy(*by, "_part").orderBy("value")) - F.col("n")
    met = ranged.withColumn("_inside", inside)
    return met.join(ahead.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_part").alias("_p"), "_ahead", "total"), [F.col("_part") == F.col("_p"), *(F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by)]).select(*by, "value", "n", (F.col("_ahead") + F.col("_inside")).alias("before"), "total")


def order_statistics(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The same as distribution, and upper_median (the value at n // 2 from 0, never between two), by selection from counted values: no group's values are held together."""
    rows, x = counted_values(df, by, value), F.col("value").cast("double")
    holds = lambda i: (F.col("before") <= i) & (i < F.col("before") + F.col("n"))

    def between(q: float) -> Column:
        place = (F.col("total") - 1) * q
        low = F.max(F.when(holds(F.floor(place)), x))
        return low + (F.max(F.when(holds(F.ceil(place)), x)) - low) * F.max(place - F.floor(place))

    names = {n: between(q) for n, q in zip(("q25", "median", "q75"), QUARTILES, strict=True)}
    return rows.groupBy(*by).agg(F.max("total").alias("n"), F.min(x).alias("least"), *(c.alias(n) for n, c in names.items()), F.max(x).alias("largest"), (F.sum(x * F.col("n")) / F.sum("n")).alias("mean"), F.max(F.when(holds(F.floor(F.col("total") / 2)), x)).alias("upper_median"))


def concentration_by_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The same as concentration, by counted values: n equal counts take the places before + 1 to before + n together."""
    rows = counted_values(df, by, value)
    x, n, total = F.col("value").cast("double"), F.col("n"), F.col("total")
    above = total - F.col("before") - n
    top = lambda k: F.sum(x * F.greatest(F.lit(0), F.least(n, k - above)))
    sums = rows.groupBy(*by).agg(F.max("total").alias("sources"), F.sum(x * n).alias("total"), F.sum(x * (n * F.col("before") + n * (n + 1) / 2)).alias("_w"), F.sum(x * x * n).alias("_s"), top(F.lit(1)).alias("_top1"), top(F.lit(5)).alias("_top5"), top(F.lit(10)).alias("_top10"), top(F.greatest(F.lit(1), F.ceil(total * 0.01))).alias("_top1pct"))
    m, t = F.col("sources").cast("double"), F.nullif(F.col("total"), F.lit(0.0))
    gini = F.when(F.col("total") == 0, 0.0).otherwise(2 * F.col("_w") / (m * F.col("total")) - (m + 1) / m)
    hhi = F.col("_s") / (t * t)
    return sums.select(*by, "sources", "total", hhi.alias("hhi"), gini.alias("gini"), (1 / hhi).alias("effective"), *((F.col(f"_{k}") / t).alias(k) for k in ("top1", "top5", "top10", "top1pct")))


def degrees(edges: DataFrame, nodes: DataFrame, node: str, other: str) -> DataFrame:
    """Distinct neighbours of every node, 0 for those without an edge."""
    return nodes.select(node).distinct().join(edges.groupBy(node).agg(F.count_distinct(other).alias("degree")), node, "left").fillna(0, ["degree"])


def cohort_overlap(a: DataFrame, b: DataFrame, document: str, relation: str) -> DataFrame:
    """Documents that both cohorts cite, and the share of each cohort's relations that cite one."""
    common = a.select(document).intersect(b.select(document))
    counts = lambda df, x: df.join(common.withColumn("_c", F.lit(1)), document, "left").agg(F.count_distinct(relation).alias(f"relations_{x}"), F.count_distinct(F.when(F.col("_c") == 1, F.col(relation))).alias(f"sharing_{x}"), F.count_distinct(document).alias(f"documents_{x}"))
    out = common.agg(F.count("*").alias("shared_documents")).crossJoin(counts(a, "a")).crossJoin(counts(b, "b"))
    return out.withColumns({f"fraction_{x}": F.col(f"sharing_{x}") / F.nullif(F.col(f"relations_{x}"), F.lit(0)) for x in "ab"})


def attrition(rows: DataFrame, by: list[str], pair: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("records"), F.count_distinct(pair).alias("pairs"))


def collisions(df: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Distinct keys, keys of several rows, and rows beyond the first."""
    groups = df.groupBy(*by, key).agg(F.count("*").alias("_n"))
    return groups.groupBy(*by).agg(F.count("*").alias("distinct_keys"), F.count_if(F.col("_n") > 1).alias("shared_keys"), F.sum(F.col("_n") - 1).alias("excess"))


def attribution(relevant: DataFrame, blocks: DataFrame, by: list[str], k: int) -> DataFrame:
    """Relevant targets by score (zero or positive), tie (unique or tied) and rank (within k or beyond).

    relevant: baseline, query, target, rank, score; blocks: runs of equal scores with size.
    """
    rows = relevant.join(blocks.select("baseline", "query", "score", "size"), ["baseline", "query", "score"])
    zero, tied, within = F.col("score") == 0, F.col("size") > 1, F.col("rank") <= k
    cells = {f"{a}_{b}_{c}": x & y & z for a, x in (("zero", zero), ("positive", ~zero)) for b, y in (("unique", ~tied), ("tied", tied)) for c, z in (("within", within), ("beyond", ~within))}
    return rows.groupBy(*by).agg(F.count("*").alias("relations"), *(F.count_if(c).alias(n) for n, c in cells.items()))


def first_hits(relevant: DataFrame, blocks: DataFrame) -> DataFrame:
    """The best-ranked relevant target of each block with its score and run size."""
    rows = relevant.join(blocks.select("baseline", "query", "score", "size"), ["baseline", "query", "score"])
    return rows.groupBy("baseline", "query").agg(F.min_by(F.struct("target", "rank", "score", "size"), "rank").alias("_r")).select("baseline", "query", "_r.*")


def attribution_sums(relevant: DataFrame, blocks: DataFrame, by: list[str]) -> DataFrame:
    """Relations by score and tie (three kinds), queries by those of their first hit (four kinds), and what the kinds leave of either total.

    relevant: baseline, query, rank, score and by; blocks: runs of equal scores with size. A zero score that is not tied
    belongs to no kind of relation, so relation_gap counts such; a first hit of that sort is first_other.
    """
    kind = F.when(F.col("size") > 1, F.when(F.col("score") == 0, "zero_tied").otherwise("positive_tied")).when(F.col("score") > 0, "positive_unique").otherwise("other")
    rows = relevant.join(blocks.select("baseline", "query", "score", "size"), ["baseline", "query", "score"]).withColumn("_k", kind)
    names = ("zero_tied", "positive_tied", "positive_unique")
    per_query = rows.groupBy(*dict.fromkeys([*by, "baseline", "query"])).agg(F.count("*").alias("_n"), F.min_by("_k", "rank").alias("_first"), *(F.count_if(F.col("_k") == n).alias(f"_{n}") for n in names))
    out = per_query.groupBy(*by).agg(F.sum("_n").alias("relations"), F.count("*").alias("queries"), *(F.sum(f"_{n}").alias(n) for n in names), *(F.count_if(F.col("_first") == n).alias(f"first_{n}") for n in (*names, "other")))
    gap = lambda total, parts: F.col(total) - sum((F.col(c) for c in parts), F.lit(0))
    return out.withColumns({"relation_gap": gap("relations", names), "query_gap": gap("queries", [f"first_{n}" for n in (*names, "other")])})


def cohort_summary(df: DataFrame, by: str, measures: list[str], flags: list[str]) -> DataFrame:
    """Long table of counts and shares of flags and of distributions of measures per cohort: by, measure, statistic, value."""
    q = lambda m: F.percentile(m, F.array(*map(F.lit, QUARTILES)))
    wide = df.groupBy(by).agg(F.count("*").alias("_n"), *(F.count_if(f).alias(f"_f_{f}") for f in flags), *(x for m in measures for x in (F.min(m).alias(f"_least_{m}"), q(m).alias(f"_q_{m}"), F.max(m).alias(f"_largest_{m}"), F.avg(m).alias(f"_mean_{m}"))))
    cell = lambda m, s, v: F.struct(F.lit(m).alias("measure"), F.lit(s).alias("statistic"), v.cast("double").alias("value"))
    cells = [cell("relations", "count", F.col("_n"))]
    for f in flags:
        cells += [cell(f, "count", F.col(f"_f_{f}")), cell(f, "fraction", F.col(f"_f_{f}") / F.col("_n"))]
    for m in measures:
        cells += [cell(m, "least", F.col(f"_least_{m}")), *(cell(m, s, F.col(f"_q_{m}")[i]) for i, s in enumerate(("q25", "median", "q75"))), cell(m, "largest", F.col(f"_largest_{m}")), cell(m, "mean", F.col(f"_mean_{m}"))]
    return wide.select(by, F.explode(F.array(*cells)).alias("c")).select(by, "c.*")


def cohort_difference(summary: DataFrame, by: str, a: str, b: str) -> DataFrame:
    side = lambda x, n: summary.where(F.col(by) == x).select("measure", "statistic", F.col("value").alias(n))
    return side(a, "value_a").join(side(b, "value_b"), ["measure", "statistic"], "full_outer").withColumn("difference", F.col("value_a") - F.col("value_b"))


def reasons(rows: DataFrame, by: list[str], reason: Column) -> DataFrame:
    """Count and share of each reason among all rows of a group."""
    n = rows.groupBy(*by, reason.alias("reason")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def max_similarity(items: DataFrame, similarity: DataFrame, key: str, by: list[str], censored: bool) -> DataFrame:
    """Spread of each item's largest similarity. Complete similarities miss only zeros; censored ones are unknown where missing, and counted apart."""
    best = similarity.groupBy(key).agg(F.max("similarity").alias("_s"))
    rows = items.join(best, key, "left")
    if not censored:
        return distribution(rows.withColumn("value", F.coalesce("_s", F.lit(0.0))), by, "value")
    known = distribution(rows.withColumnRenamed("_s", "value"), by, "value")
    return known.join(rows.groupBy(*by).agg(F.count_if(F.col("_s").isNull()).alias("without_hit"), F.count("*").alias("items")), by)


def fidelity(both: DataFrame, by: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Of aligned ledgers: exact and tolerable score changes, largest error, rank shifts."""
    error, shift = F.abs(F.col("score_a") - F.col("score_b")), F.abs(F.col("rank_a") - F.col("rank_b"))
    q = F.percentile(shift, F.array(*map(F.lit, QUARTILES)))
    out = both.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(error > 0).alias("changed"), F.count_if(error > tolerance).alias("beyond_tolerance"), F.max(error).alias("largest_error"), F.avg(error).alias("mean_error"), F.count_if(shift > 0).alias("rank_changed"), q.alias("_q"), F.max(shift).alias("largest_shift"))
    return out.withColumns({f"shift_{n}": F.col("_q")[i] for i, n in enumerate(("q25", "median", "q75"))}).drop("_q")


def deltas(a: DataFrame, b: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Per-query differences b - a of a metric."""
    r = b.select(*keys, F.col(name).alias("_b"))
    return a.join(r, keys).select(*keys, (F.col("_b") - F.col(name)).alias("delta"))


def delta_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("queries"), F.count_if(F.col("delta") != 0).alias("changed"), F.max(F.abs("delta")).alias("largest"), F.percentile("delta", F.lit(0.5)).alias("median"), F.avg("delta").alias("mean"))


def scope_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Relations and queries that enter and leave each scope from a to b. Both: scope, query, target, distinct."""
    r = a.select("scope", "query", "target", F.lit(1).alias("_a")).join(b.select("scope", "query", "target", F.lit(1).alias("_b")), ["scope", "query", "target"], "full_outer")
    per_query = r.groupBy("scope", "query").agg(F.count_if(F.col("_a").isNull()).alias("entries"), F.count_if(F.col("_b").isNull()).alias("exits"), F.bool_or(F.col("_a") == 1).alias("in_a"), F.bool_or(F.col("_b") == 1).alias("in_b"))
    false = F.lit(False)
    return per_query.groupBy("scope").agg(F.sum("entries").alias("relation_entries"), F.sum("exits").alias("relation_exits"), F.sum(F.col("entries") + F.col("exits")).alias("relation_difference"), F.count_if(~F.coalesce("in_a", false)).alias("query_entries"), F.count_if(~F.coalesce("in_b", false)).alias("query_exits"))


def effect_split(ranks_a: DataFrame, ranks_b: DataFrame, scope_a: DataFrame, scope_b: DataFrame, k: int) -> DataFrame:
    """Recall of new ranks on the new scope, of old ranks on the new scope, and of old ranks on the old one: the parts due to ranks and to membership."""

    def mean(ranks: DataFrame, scope: DataFrame, name: str) -> DataFrame:
        hit = scope.join(ranks.select("baseline", "query", "target", "rank"), ["query", "target"]).groupBy("scope", "baseline", "query").agg(F.avg((F.col("rank") <= k).cast("double")).alias("r"))
        return hit.groupBy("scope", "baseline").agg(F.avg("r").alias(name))

    out = mean(ranks_b, scope_b, "new_new").join(mean(ranks_a, scope_b, "old_new"), ["scope", "baseline"], "full_outer").join(mean(ranks_a, scope_a, "old_old"), ["scope", "baseline"], "full_outer")
    return out.withColumns({"rank_effect": F.col("new_new") - F.col("old_new"), "membership_effect": F.col("old_new") - F.col("old_old")})


def scored_once(states: DataFrame, name: str, digest: str = "sha256") -> DataFrame:
    """Adds scored_as, the first of the scenarios whose states are equal, and status. One row per scenario comes in."""
    first = states.groupBy(digest).agg(F.min(name).alias("scored_as"))
    return states.join(first, digest).withColumn("status", F.when(F.col(name) == F.col("scored_as"), "scored").otherwise("equal_state_reused"))


def rank_differences(frozen: DataFrame, made: DataFrame) -> DataFrame:
    """Rows of a ledger whose rank differs from the frozen one, or that one side lacks."""
    keys = ["baseline", "query", "target"]
    both = frozen.select(*keys, "rank").join(made.select(*keys, F.col("rank").alias("_made")), keys, "full_outer")
    return both.where(~F.col("rank").eqNullSafe(F.col("_made")))


def rank_differences_beside(both: DataFrame, frozen: str, made: str) -> DataFrame:
    """The same where both ranks stand in one row, as after ``ranked_beside`` or with a rank made from the other: no join of two ledgers."""
    return both.where(~F.col(frozen).eqNullSafe(F.col(made)))


def calibration(parts: dict[str, DataFrame]) -> DataFrame:
    """part and differences: how many rows break each part of the reference's reproduction. Perturbed results count only where all are 0 (``contracts.require``)."""
    from functools import reduce

    counts = [df.agg(F.count("*").alias("differences")).select(F.lit(part).alias("part"), "differences") for part, df in parts.items()]
    return reduce(DataFrame.union, counts)
