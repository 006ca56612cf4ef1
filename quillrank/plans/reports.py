"""Tables of a report as queries: flow of rows, changes between ledgers, metrics at several depths, corrected summaries, attributions and their sums, sources of figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.operators import audits, metrics, ranking, resample, shaping, temporal
from quillrank.plans.binding import CUTOFF, HIST, REL, Binding, K
from quillrank.plans.catalog import _DIST, _DIST_D, _LEAK, _LED2, _POLICY, _REPS, _SCOPES, _TIES, _both, _leak, _policy_history, _tied, query

DEPTHS = (10, 50)

# flow of rows to the endpoint

_FLOW = REL + _LEAK.removeprefix(HIST) + f""",
elig AS (SELECT CASE WHEN ref_kind <> 'PMID' THEN 'excluded_not_numeric_pmid' WHEN NOT found THEN 'excluded_pubmed_not_found' WHEN precision <> 'day' THEN 'excluded_non_day_precision' WHEN odate <= DATE '{CUTOFF}' THEN 'eligible_pre_cutoff' ELSE 'excluded_after_cutoff' END AS item FROM prim WHERE version = 'v2'),
flow AS (SELECT count(*)::DOUBLE AS initial_pairs, count(*) FILTER (status = 'historical_activity_recorded_in_chembl31')::DOUBLE AS excluded_historical, count(*) FILTER (status = 'entity_pair_not_sqlite_validated')::DOUBLE AS excluded_unresolved,
  count(*) FILTER (status = 'no_activity_found_in_validated_chembl31_entity_pair')::DOUBLE AS final_relations FROM aud),
den AS (SELECT scope, coalesce(r, 0)::DOUBLE AS relations, coalesce(q, 0)::DOUBLE AS queries, coalesce(t, 0)::DOUBLE AS targets, coalesce(a, 0)::DOUBLE AS tier_a, coalesce(b, 0)::DOUBLE AS tier_b FROM (SELECT unnest({list(_SCOPES)}) AS scope)
  LEFT JOIN (SELECT scope, count(*) AS r, count(DISTINCT query) AS q, count(DISTINCT target) AS t, count(*) FILTER (tier[1] = 'A') AS a, count(*) FILTER (tier[1] = 'B') AS b FROM scoped GROUP BY scope) USING (scope))"""


@query("SELECT 'row_eligibility' AS section, NULL::VARCHAR AS scope, item, count(*)::DOUBLE AS value FROM elig GROUP BY item UNION ALL SELECT 'endpoint_construction', NULL, item, value FROM (SELECT *, initial_pairs - excluded_historical - excluded_unresolved - final_relations AS gap FROM flow) UNPIVOT (value FOR item IN (initial_pairs, excluded_historical, excluded_unresolved, final_relations, gap)) UNION ALL SELECT 'scope', scope, item, value FROM den UNPIVOT (value FOR item IN (relations, queries, targets, tier_a, tier_b))", _FLOW, ("value",))
def table_flow(b: Binding) -> DataFrame:
    """Eligibility of the older version's rows, the way to the endpoint with what it fails to account for, and the size of each scope."""
    old = b.dated.where((F.col("version") == "v2") & F.col("is_primary"))
    status = temporal.row_status(F.col("ref_kind"), F.col("ref"), F.col("found"), F.col("precision"), F.col("published"), b.cutoff)
    eligible = old.groupBy(status.alias("item")).agg(F.count("*").cast("double").alias("value")).withColumn("section", F.lit("row_eligibility"))
    of = lambda s: F.count_if(F.col("status") == s)
    flow = _leak(b).agg(F.count("*").alias("initial_pairs"), of("historical_activity_recorded_in_chembl31").alias("excluded_historical"), of("entity_pair_not_sqlite_validated").alias("excluded_unresolved"), of("no_activity_found_in_validated_chembl31_entity_pair").alias("final_relations"))
    flow = flow.withColumn("gap", shaping.closure_gap(F.col("initial_pairs"), [F.col("excluded_historical"), F.col("excluded_unresolved")], F.col("final_relations")))
    sizes = shaping.unpivot(metrics.denominators(b.scoped, list(_SCOPES)).drop("status"), ["scope"], "scope").drop("status")
    return shaping.stacked([eligible, shaping.key_values(flow, "endpoint_construction"), sizes]).select("section", "scope", "item", "value")


# changes between two ledgers

_CHANGES = REL + _LED2[_LED2.index(",\npop2") :] + f""",
chq AS (SELECT query, count(*) AS rows, count(*) FILTER (score_a <> score_b) AS sc, count(*) FILTER (rank_a <> rank_b) AS rc, sum(abs(rank_a - rank_b)) AS ts, max(abs(rank_a - rank_b)) AS ls, count(*) FILTER ((rank_a <= {K}) <> (rank_b <= {K})) AS td FROM bth GROUP BY query),
chs AS (SELECT sum(rows)::DOUBLE AS rows, sum(sc)::DOUBLE AS score_changes, sum(rc)::DOUBLE AS rank_changes, sum(ts)::DOUBLE AS total_shift, max(ls)::DOUBLE AS largest_shift, count(*)::DOUBLE AS queries, count(*) FILTER (rc > 0)::DOUBLE AS queries_changed, count(*) FILTER (td > 0)::DOUBLE AS queries_top_changed, sum(td)::DOUBLE AS top_k_difference,
  sum(rc) / sum(rows)::DOUBLE AS rank_changed_share, sum(ts) / sum(rows)::DOUBLE AS mean_shift FROM chq),
chm AS (SELECT scope, avg(x) AS old_value, avg(y) AS new_value, avg(y) - avg(x) AS difference FROM (SELECT scope, query, avg(CASE WHEN rank_a <= {K} THEN 1.0::DOUBLE ELSE 0 END) AS x, avg(CASE WHEN rank_b <= {K} THEN 1.0::DOUBLE ELSE 0 END) AS y FROM scoped JOIN bth USING (query, target) GROUP BY ALL) GROUP BY scope)"""


@query("SELECT 'rank_change' AS section, NULL::VARCHAR AS scope, item, value FROM chs UNPIVOT (value FOR item IN (rows, score_changes, rank_changes, total_shift, largest_shift, queries, queries_changed, queries_top_changed, top_k_difference, rank_changed_share, mean_shift)) UNION ALL SELECT 'recall', scope, item, value FROM chm UNPIVOT (value FOR item IN (old_value, new_value, difference))", _CHANGES, ("value",))
def table_before_after(b: Binding) -> DataFrame:
    """What other weights change: ranks and first places over all queries, recall by scope. Both ledgers are aligned once."""
    both = _both(b)
    per = ranking.ledger_changes(both, ["query"], K)
    sums = [F.sum(c).alias(c) for c in ("rows", "score_changes", "rank_changes", "total_shift", "top_k_difference")]
    total = per.agg(*sums, F.max("largest_shift").alias("largest_shift"), F.count("*").alias("queries"), F.count_if(F.col("rank_changes") > 0).alias("queries_changed"), F.count_if(F.col("top_k_difference") > 0).alias("queries_top_changed"))
    total = total.withColumns({"rank_changed_share": F.col("rank_changes") / F.col("rows"), "mean_shift": F.col("total_shift") / F.col("rows")})
    hit = lambda x: F.avg(F.when(F.col(f"rank_{x}") <= K, 1.0).otherwise(0.0)).alias(x)
    recall = b.scoped.join(both, ["query", "target"]).groupBy("scope", "query").agg(hit("a"), hit("b")).groupBy("scope").agg(F.avg("a").alias("old_value"), F.avg("b").alias("new_value"))
    recall = shaping.unpivot(recall.withColumn("difference", F.col("new_value") - F.col("old_value")), ["scope"], "recall").drop("status")
    return shaping.stacked([shaping.key_values(total, "rank_change"), recall]).select("section", "scope", "item", "value")


# metrics at several depths

_AT = ", ".join(
    f"avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0 END) AS recall_{k}, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= {k}), 0) / list_sum(list_transform(range(1, least({k}, count(*)) + 1), lambda i: 1 / log2(i + 1))) AS ndcg_{k}" for k in DEPTHS
)
_CELLS = tuple(f"{m}_{k}" for k in DEPTHS for m in ("recall", "ndcg")) + ("mrr",)
_DEPTH = REL + f",\npd AS (SELECT baseline, scope, query, count(*) AS relevant, 1.0 / min(rank) AS mrr, {_AT} FROM rel GROUP BY ALL)"


@query("SELECT baseline, scope, sum(relevant)::BIGINT AS relations, count(*) AS queries, " + ", ".join(f"avg({c}) AS {c}, count(*) FILTER ({c} = 0) AS zero_{c}" for c in _CELLS) + " FROM pd GROUP BY ALL", _DEPTH, _CELLS)
def table_metrics_at_depths(b: Binding) -> DataFrame:
    """Means and zero results of recall and NDCG at both depths and of the reciprocal rank; one aggregate of the relevant rows serves all."""
    per = metrics.at_depths(b.leading(max(DEPTHS)), DEPTHS)
    return per.groupBy("baseline", "scope").agg(F.sum("relevant").alias("relations"), F.count("*").alias("queries"), *(x for c in _CELLS for x in (F.avg(c).alias(c), F.count_if(F.col(c) == 0).alias(f"zero_{c}"))))


# summaries corrected for ties

_CORRECTED = _TIES + f""",
op AS (SELECT baseline, query, max(score) > 0 AS operable FROM led GROUP BY ALL),
pt AS (SELECT ta.baseline, ta.scope, query, ta.relevant, expected_recall, worst_recall, best_recall, recall AS salted, hits, operable, abs(best_recall - worst_recall) <= 1e-12 AS ident FROM ta JOIN op USING (baseline, query) JOIN pq USING (baseline, scope, query)),
ps AS (SELECT 'all_queries' AS subset, * FROM pt UNION ALL SELECT CASE WHEN operable THEN 'operable' ELSE 'structural_all_zero' END, * FROM pt),
cq AS (SELECT subset, scope, baseline, expected_recall AS v, row_number() OVER (PARTITION BY subset, scope, baseline ORDER BY query) - 1 AS pick, count(*) OVER (PARTITION BY subset, scope, baseline) AS n FROM ps),
cd AS (SELECT n, rep, CAST('0x' || substr(md5('20260719|' || rep || '|' || slot), 1, 8) AS BIGINT) % n AS pick, count(*) AS times FROM (SELECT n, rep, unnest(range(1, n + 1)) AS slot FROM (SELECT DISTINCT n FROM cq) CROSS JOIN range(1, {_REPS + 1}) r(rep)) GROUP BY ALL),
cr AS (SELECT subset, scope, baseline, rep, sum(v * times) / any_value(n) AS m FROM cd JOIN cq USING (n, pick) GROUP BY ALL),
ci AS (SELECT subset, scope, baseline, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM cr GROUP BY ALL),
cs0 AS (SELECT subset, scope, baseline, count(*) AS queries, sum(relevant)::BIGINT AS relations, avg(salted) AS salted_recall, avg(expected_recall) AS expected_recall, avg(worst_recall) AS worst_recall, avg(best_recall) AS best_recall, count(*) FILTER (ident) AS identifiable, count(*) FILTER (NOT ident) AS tie_dependent, count(*) FILTER (hits > 0) AS queries_with_hit FROM ps GROUP BY ALL)"""
_SHARES = ("salted_recall", "expected_recall", "worst_recall", "best_recall")


@query("SELECT *, CASE WHEN queries_with_hit = 0 THEN 1 - power(0.05, 1.0 / queries) END AS upper_bound, CASE WHEN subset = 'structural_all_zero' THEN 'non_operational_uniform_tie_allocation' WHEN tie_dependent > 0 THEN 'tie_dependent' ELSE 'score_identifiable' END AS result_class FROM cs0 JOIN ci USING (subset, scope, baseline)", _CORRECTED, (*_SHARES, "low", "high", "upper_bound"))
def table_corrected(b: Binding) -> DataFrame:
    """Recall as salted and as ties allow, with intervals of its expectation, over all queries, those with a score above zero and the others."""
    operable = b.blocks.groupBy("baseline", "query").agg((F.max("score") > 0).alias("operable"))
    salted = metrics.per_query(b.relevant, K).select(*metrics.BY, F.col("recall").alias("salted_recall"), "hits")
    rows = _tied(b).join(salted, metrics.BY).join(operable, ["baseline", "query"])
    rows = rows.withColumn("subset", F.explode(F.array(F.lit("all_queries"), F.when(F.col("operable"), "operable").otherwise("structural_all_zero"))))
    by = ["subset", "scope", "baseline"]
    sums = rows.groupBy(*by).agg(F.count("*").alias("queries"), F.sum("relevant").alias("relations"), *(F.avg(c).alias(c) for c in _SHARES), F.count_if("recall_identifiable").alias("identifiable"), F.count_if(~F.col("recall_identifiable")).alias("tie_dependent"), F.count_if(F.col("hits") > 0).alias("queries_with_hit"))
    ends = resample.hashed_intervals(rows, F.col("expected_recall"), by, "query", _REPS).select(*by, "low", "high")
    kind = F.when(F.col("subset") == "structural_all_zero", "non_operational_uniform_tie_allocation").when(F.col("tie_dependent") > 0, "tie_dependent").otherwise("score_identifiable")
    return metrics.zero_hit_bounds(sums.join(ends, by), "queries", "queries_with_hit").withColumn("result_class", kind)


# attributions and their sums

_KINDS = REL + """,
rk AS (SELECT *, CASE WHEN size > 1 THEN CASE WHEN score = 0 THEN 'zero_tied' ELSE 'positive_tied' END WHEN score > 0 THEN 'positive_unique' ELSE 'other' END AS kind FROM rel JOIN blocks USING (baseline, query, score)),
fk AS (SELECT baseline, scope, query, kind FROM (SELECT *, row_number() OVER (PARTITION BY baseline, scope, query ORDER BY rank) AS place FROM rk) WHERE place = 1),
att AS (SELECT * FROM (SELECT baseline, scope, count(*) AS relations, count(*) FILTER (kind = 'zero_tied') AS zero_tied, count(*) FILTER (kind = 'positive_tied') AS positive_tied, count(*) FILTER (kind = 'positive_unique') AS positive_unique, count(*) FILTER (kind = 'other') AS relation_gap FROM rk GROUP BY ALL)
  JOIN (SELECT baseline, scope, count(*) AS queries, count(*) FILTER (kind = 'zero_tied') AS first_zero_tied, count(*) FILTER (kind = 'positive_tied') AS first_positive_tied, count(*) FILTER (kind = 'positive_unique') AS first_positive_unique, count(*) FILTER (kind = 'other') AS first_other, count(*) - count(*) FILTER (kind IN ('zero_tied', 'positive_tied', 'positive_unique', 'other')) AS query_gap FROM fk GROUP BY ALL) USING (baseline, scope))"""


@query("SELECT baseline, scope, relations, queries, zero_tied, positive_tied, positive_unique, first_zero_tied, first_positive_tied, first_positive_unique, first_other, relation_gap, query_gap FROM att", _KINDS)
def table_attribution(b: Binding) -> DataFrame:
    """Relations in three kinds and first hits in four, with what the kinds leave of the denominators."""
    return audits.attribution_sums(b.relevant, b.blocks, ["baseline", "scope"])


@query("SELECT baseline, scope, item, \"left\", \"right\" FROM (SELECT baseline, scope, unnest([{'item': 'relations', 'left': r, 'right': x}, {'item': 'queries', 'left': q, 'right': y}], recursive := true) FROM (SELECT baseline, scope, count(*)::DOUBLE AS r, count(DISTINCT query)::DOUBLE AS q FROM rel GROUP BY ALL) FULL JOIN (SELECT baseline, scope, count(*)::DOUBLE AS x, count(DISTINCT query)::DOUBLE AS y FROM rk WHERE scope <> 'joint_0.70' AND NOT (scope = 'scaffold_cold' AND kind = 'positive_unique') AND NOT (scope = 'joint_0.30' AND query < 'N02') GROUP BY ALL) USING (baseline, scope)) WHERE \"left\" IS DISTINCT FROM \"right\"", _KINDS)
def table_denominator_faults(b: Binding) -> DataFrame:
    """Denominators of the metrics against those of an attribution that was spoiled: it lacks one scope, some queries of another and some relations of a third."""
    blocks = b.blocks
    odd = b.relevant.join(blocks.where((F.col("size") == 1) & (F.col("score") > 0)).select("baseline", "query", "score"), ["baseline", "query", "score"], "left_semi").where("scope = 'scaffold_cold'")
    kept = b.relevant.where("scope <> 'joint_0.70' AND NOT (scope = 'joint_0.30' AND query < 'N02')").join(odd.select("baseline", "scope", "query", "target"), ["baseline", "scope", "query", "target"], "left_anti")
    by = ["baseline", "scope"]
    whole = b.relevant.groupBy(*by).agg(F.count("*").alias("relations"), F.count_distinct("query").alias("queries"))
    return shaping.disagreeing(whole, audits.attribution_sums(kept, blocks, by), by, ["relations", "queries"])


# sources of figures


@query("SELECT policy, count(*) FILTER (tier[1] = 'A') AS affinity, count(*) FILTER (tier[1] = 'B') AS functional, count(*) AS pairs FROM ph GROUP BY policy", _POLICY)
def figure_policy_matrix(b: Binding) -> DataFrame:
    """Pairs of each date policy by tier, a column for each."""
    name = F.when(F.col("best_tier").startswith("A_"), "affinity").otherwise("functional")
    counts = _policy_history(b).groupBy("policy", name.alias("kind")).agg(F.count("*").alias("n"))
    return shaping.matrix(counts, ["policy"], "kind", ["affinity", "functional"], "n").fillna(0, ["affinity", "functional"]).withColumn("pairs", F.col("affinity") + F.col("functional"))


@query(f"SELECT baseline, scope, {_DIST} FROM (SELECT baseline, scope, rank AS value FROM rel) GROUP BY ALL", REL, _DIST_D)
def figure_rank_boxes(b: Binding) -> DataFrame:
    """Five numbers and mean of the ranks of relevant targets, by selection from counted values."""
    return audits.order_statistics(b.relevant_ranks.select("baseline", "scope", "rank"), ["baseline", "scope"], "rank").drop("upper_median")
