"""Closed forms, enumerations and edge cases of the relational and ranking operators."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrank.functions import scalars as S
from quillrank.operators import audits, chemistry, contracts, evidence, gate, graph, metrics, ranking, resample, scoring, shaping, similarity, temporal


def one(spark, column, **values):
    row = [(*values.values(),)] if values else [(1,)]
    kinds = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'bigint'}" for k, v in values.items()) or "x bigint"
    return spark.createDataFrame(row, kinds).select(column.alias("r")).first().r


def test_recall_ndcg_mrr(spark):
    rel = spark.createDataFrame([("q1", 1), ("q1", 3), ("q2", 2), ("q2", 3)], "query string, rank int")
    got = {r.query: r for r in metrics.per_query(rel, 10, ["query"]).collect()}
    assert got["q1"].recall == 1 and got["q1"].mrr == 1
    assert got["q1"].ndcg == pytest.approx((1 + 0.5) / (1 + 1 / math.log2(3)))
    two = metrics.macro(metrics.per_query(rel, 2, ["query"]).withColumn("s", F.lit(1)), ["s"]).first()
    assert two.recall == 0.5 and two.queries == 2 and two.zero_recall == 0


def tie(spark, blocks, k):
    df = spark.createDataFrame([("b", "s", "q", *x) for x in blocks], "baseline string, scope string, query string, start bigint, end bigint, size bigint, relevant bigint")
    return metrics.tie_aware(df, k).first()


def test_ties_as_enumerated(spark):
    blocks, k = [(1, 3, 3, 1), (4, 5, 2, 1)], 4
    r = tie(spark, blocks, k)
    assert (r.expected_recall, r.worst_recall, r.best_recall, r.hit_probability, r.fixed, r.boundary, r.missed) == (0.75, 0.5, 1.0, 1.0, 1, 1, 0)
    values, gains, hits = [], [], []
    for a, b in itertools.product(itertools.permutations([1, 0, 0]), itertools.permutations([1, 0])):
        order = [*a, *b]
        values.append(sum(order[:k]) / 2)
        gains.append(sum(x / math.log2(i + 2) for i, x in enumerate(order[:k])) / (1 + 1 / math.log2(3)))
        hits.append(any(order[:k]))
    assert r.expected_recall == pytest.approx(sum(values) / len(values)) and (r.worst_recall, r.best_recall) == (min(values), max(values))
    assert r.expected_ndcg == pytest.approx(sum(gains) / len(gains)) and r.worst_ndcg == pytest.approx(min(gains)) and r.best_ndcg == pytest.approx(max(gains))


def test_all_zero_block_and_identifiability(spark):
    r = tie(spark, [(1, 100, 100, 2)], 10)
    assert (r.expected_recall, r.worst_recall, r.best_recall) == (0.1, 0, 1)
    assert r.hit_probability == pytest.approx(1 - math.comb(98, 10) / math.comb(100, 10))
    r = tie(spark, [(1, 3, 3, 1)], 3)
    assert r.recall_identifiable and not r.ndcg_identifiable


def test_bounds_of_no_hits_and_missing_data(spark):
    assert metrics.upper_bound(0, 19) == pytest.approx(0.1458685033, abs=1e-9) and metrics.upper_bound(0, 22) == pytest.approx(0.1273054317, abs=1e-9)
    assert metrics.upper_bound(1, 20) == pytest.approx(0.216106, abs=1e-5) and metrics.upper_bound(3, 3) == 1
    b = one(spark, metrics.missing_bounds(F.col("h"), F.col("n"), F.col("u")), h=54, n=358, u=65)
    assert (b.lower, b.upper) == (54 / 423, 119 / 423)


@pytest.mark.parametrize(("text", "value", "precision"), [("2019 Feb 3", "2019-02-03", "day"), ("2019 Feb 30", "2019-02", "month"), ("2019 Spring", "2019", "year"), ("2019", "2019", "year"), ("n.d.", "", "unparseable"), ("", "", "missing"), (None, "", "missing"), ("  2020 february 29;", "2020-02-29", "day"), ("1799 Mar 1", "", "unparseable")])
def test_partial_dates(spark, text, value, precision):
    assert tuple(one(spark, S.partial_date(F.col("t")), t=text)) == (value, precision)


def test_intervals_and_policies(spark):
    rows = spark.createDataFrame([("2020-02", "month"), ("2022", "year"), ("2022-08-31", "day"), ("", "missing")], "value string, precision string")
    got = {r.value: r for r in temporal.dated(rows, "value", "precision", F.lit("2022-08-31").cast("date")).collect()}
    assert (str(got["2020-02"].lo), str(got["2020-02"].hi)) == ("2020-02-01", "2020-02-29")
    assert got["2022"].interval_status == "crossing_cutoff" and got["2022-08-31"].interval_status == "definitely_before_or_on_cutoff" and got[""].interval_status == "unresolved"
    assert (got["2022"].day_precise_only, got["2022"].interval_certain, got["2022"].interval_earliest_bound) == (False, False, True)


def test_tiers(spark):
    t = lambda *x: one(spark, S.tier(*(F.lit(v) for v in x)))
    assert t("=", "KI", "10", "nM").tier.startswith("A_") and t("=", "KI", "10", "nM").p_activity == pytest.approx(8)
    assert t("=", "KI", "10", "%").tier.startswith("Q_") and t("<", "KI", "10", "nM").tier.startswith("D_") and t("=", "AC50", "1", "uM").tier.startswith("Q_")
    assert t("=", "IC50", "NaN", "nM").reason == "missing_or_non_numeric_value" and t("=", "ic50", " 1e3 ", "μM").tier.startswith("B_")
    assert one(spark, S.finite(F.col("t")), t="inf") is None and one(spark, S.normal_token(F.col("t")), t=" p1; p2") == "P1" and one(spark, S.normal_token(F.col("t")), t="N.A.") == ""


@pytest.mark.parametrize(("text", "values"), [("true", (True, True, True)), ("1", (True, True, None)), ("YES", (True, True, None)), ("False", (False, False, False)), ("0", (False, False, None)), ("", (None, False, None)), ("unknown", (None, None, None))])
def test_boolean_dialects(spark, text, values):
    assert tuple(one(spark, S.boolean_text(F.col("t"), d), t=text) for d in ("strict", "blank_false", "words")) == values


def test_small_scalars(spark):
    assert one(spark, S.list_count(F.col("t")), t="a; b;a;; ") == 2
    assert one(spark, S.bit_overlap(F.array(F.lit(3).cast("long")), F.array(F.lit(6).cast("long")))) == pytest.approx(1 / 3)
    assert one(spark, S.direction(F.lit(-1.0))) == "decrease" and S.threshold_text("0.3") == "0.30"
    with pytest.raises(ValueError):
        S.threshold_text(0)
    assert one(spark, S.pair_key_fault(F.lit("a|b"), F.lit("a"), F.lit("b"))) is None and one(spark, S.pair_key_fault(F.lit("a|c"), F.lit("a"), F.lit("b"))) == "key_differs"


def test_popularity_and_activation(spark):
    h = spark.createDataFrame([("e1", "t1", "A_affinity_candidate"), ("e2", "t1", "B_quantitative_functional_candidate"), ("e2", "t2", "B_quantitative_functional_candidate")], "entity string, target string, tier string")
    weights = {v: {"A_affinity_candidate": 1.0, "B_quantitative_functional_candidate": w} for v, w in (("half", 0.5), ("seven", 0.7), ("full", 1.0))}
    varied = scoring.weight_variants(h, weights)
    got = {(r.variant, r.target): r.s for r in varied.groupBy("variant", "target").agg(F.sum("weight").alias("s")).collect()}
    assert [got[v, "t1"] for v in weights] == [1.5, 1.7, 2.0] and [got[v, "t2"] for v in weights] == [0.5, 0.7, 1.0]
    exact = {r.target: r.score for r in scoring.popularity(varied.where("variant = 'seven'"), exact=True).collect()}
    assert exact["t1"] == pytest.approx(1.7, abs=1e-6)
    sims = spark.createDataFrame([("q", "e1", 0.4), ("q", "e2", 0.8)], "query string, entity string, similarity double")
    active = {r.target: r.score for r in scoring.score_fingerprint(varied.where("variant = 'half'"), None, sims).collect()}
    assert (active["t1"], active["t2"]) == (0.4, 0.4)


def test_no_scorer_takes_the_endpoint():
    import inspect

    for f in (*scoring.SCORERS.values(), scoring.ledger, scoring.candidates):
        assert not {"endpoint", "relevant", "labels"} & set(inspect.signature(f).parameters)


def test_ledger_is_a_permutation_and_masks_history(spark):
    h = spark.createDataFrame([("q1", "a", 1.0), ("q2", "b", 0.7)], "entity string, target string, weight double")
    q, t = spark.createDataFrame([("q1",), ("q2",)], "query string"), spark.createDataFrame([(x,) for x in "abcd"], "target string")
    led = scoring.ledger(h, q, t, "s", (scoring.POPULARITY,))
    contracts.require(contracts.rank_faults(led, ranking.BLOCK), "ranks")
    assert {(r.query, r.target) for r in led.collect()} == {(a, b) for a in ("q1", "q2") for b in "abcd"} - {("q1", "a"), ("q2", "b")}
    assert led.where("rank = 1 AND query = 'q1'").first().target == "b"
    spoiled = led.withColumn("rank", F.when(F.col("rank") == 2, 3).otherwise(F.col("rank")))
    with pytest.raises(contracts.ContractError):
        contracts.require(contracts.rank_faults(spoiled, ranking.BLOCK), "ranks")


def test_boundary_and_changes(spark):
    led = spark.createDataFrame([("b", "q", "x", 1.0, 1), ("b", "q", "y", 0.5, 2), ("b", "q", "z", 0.5, 3)], "baseline string, query string, target string, score double, rank int")
    b = ranking.boundary(ranking.tie_blocks(led), 2).first()
    assert b.crosses and (b.block_size, b.selected, b.excluded) == (2, 1, 1)
    assert not ranking.boundary(ranking.tie_blocks(led), 3).first().crosses
    before = spark.createDataFrame([("q", "x", 3.0, 1), ("q", "y", 2.0, 2), ("q", "z", 1.0, 51)], "query string, target string, score double, rank int")
    after = spark.createDataFrame([("q", "x", 2.0, 2), ("q", "y", 3.0, 1), ("q", "z", 1.0, 49)], "query string, target string, score double, rank int")
    c = ranking.ledger_changes(ranking.aligned(before, after, ["query", "target"]), ["query"], 50).first()
    assert (c.score_changes, c.rank_changes, c.total_shift, c.top_k_difference) == (2, 3, 4, 1)
    assert ranking.monotone_faults(led.withColumn("score", F.lit(1.0) * F.col("rank"))).count() == 2


def test_components_and_mode_and_gini(spark):
    edges = spark.createDataFrame([("q1", "d1"), ("q2", "d1"), ("q3", "d2")], "q string, d string")
    s = graph.component_summary(graph.component_sizes(graph.components(edges, "q", "d"))).first()
    assert (s.components, s.single_left, s.largest_left_nodes, s.total_nodes) == (2, 1, 2, 5)
    m = spark.createDataFrame([(1, x) for x in ("b", "a", "b", "a", "", None)], "k int, v string")
    assert evidence.lexical_mode(m, ["k"], "v").first().mode == "a"
    for values, want in (([1, 1, 1, 1], 0), ([0, 0, 0, 4], 0.75)):
        df = spark.createDataFrame([("g", v) for v in values], "g string, v int")
        assert audits.concentration(df, ["g"], "v").first().gini == pytest.approx(want)
    assert audits.distribution(spark.createDataFrame([("g", None)], "g string, v double"), ["g"], "v").first().n == 0


def test_contracts(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("", 3), ("b", 4)], "k string, v int")
    assert {r.k for r in contracts.duplicates(df, ["k"]).collect()} == {"a", ""}
    other = spark.createDataFrame([("b",), ("c",)], "k string")
    assert {(r.k, r.side) for r in contracts.keyset_difference(df, other, ["k"]).collect()} == {("a", "left_only"), ("", "left_only"), ("c", "right_only")}
    assert contracts.partition_gap(df, F.col("k"), 4).count() == 0 and contracts.partition_gap(df, F.col("k"), 5).count() == 1
    import hashlib

    assert contracts.membership_hash(other, ["k"]).first().sha256 == hashlib.sha256(b"b\nc\n").hexdigest()
    with pytest.raises(contracts.ContractError):
        shaping.unique_row(df, k="a")
    assert shaping.closure_gap(442, [19, 65], 358) == 0


def test_pair_decisions_order(spark):
    kinds = "version string, pair_key string, entity string, target string, tier string, is_primary boolean, is_strict boolean, pre_cutoff_status string, cross_version_status string, temporal_screen_status string"
    a = "A_affinity_candidate"
    rows = [
        ("v2", "p1", "e", "t", a, True, True, "pre_cutoff", "shared", None), ("v3", "p1", "e", "t", a, True, True, "x", "shared", "future_candidate_pmid_only"),
        ("v3", "p2", "e", "t", a, True, True, "x", "v3_only", "future_candidate_pmid_only"),
        ("v2", "p3", "e", "t", a, True, True, "v2_primary_pmid_after_cutoff", "v2_only", None),
        ("v3", "p4", "e", "t", "Q_unverified_screen_or_other_exact", False, True, "x", "v3_only", None),
    ]
    got = {r.pair_key: r for r in evidence.pair_decisions(evidence.pair_states(spark.createDataFrame(rows, kinds))).collect()}
    assert [got[f"p{i}"].decision for i in (1, 2, 3, 4)] == list(evidence.DECISIONS)
    assert got["p3"].reasons == "v2_primary_pmid_after_cutoff" and got["p4"].reasons == "no_primary_A_or_B_P1_exact_record;v3_temporal_screen_missing"


def test_scaffold_outcomes_in_order(spark):
    pairs = lambda *x: spark.createDataFrame(x, "pair_key string, entity string")
    sc = spark.createDataFrame([("h1", "S1", "ok"), ("f1", "S1", "ok"), ("f2", "S2", "ok"), ("f3", "", "ok")], "entity string, scaffold string, scaffold_status string")
    future, full, open_ = pairs(("a", "f1"), ("b", "f2"), ("c", "f3"), ("d", "f4"), ("e", "f2")), pairs(("e", "h1")), pairs(("e", "h1"), ("x", "h9"))
    got = {r.pair_key: r.outcome for r in graph.scaffold_coldness(future, full, sc).collect()}
    assert got["a"].startswith("not_scaffold_cold") and got["b"].startswith("eligible") and got["c"] == "excluded_future_ok_status_but_empty_scaffold_key" and got["d"] == "excluded_future_missing_scaffold_row" and got["e"].startswith("excluded_future_pair")
    assert {r.pair_key: r.outcome for r in graph.scaffold_coldness(future, open_, sc).collect()}["b"].startswith("coldness_unresolved")


def test_similarity_against_brute_force(spark):
    texts = {"a": "small ring", "b": "small rod", "c": "xy", "d": "aaaa"}
    df = spark.createDataFrame(list(texts.items()), "k string, t string")
    w = similarity.gram_weights(df, "k", "t")
    norms = {r.k: r.n for r in w.groupBy("k").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()}
    assert set(norms) == {"a", "b", "d"} and all(n == pytest.approx(1) for n in norms.values())
    bits = {"x": {1, 2, 3}, "y": {2, 3, 4}, "z": {9}}
    b = spark.createDataFrame([(k, i) for k, s in bits.items() for i in s], "l string, bit int")
    got = {(r.l, r.r): r.similarity for r in similarity.tanimoto_join(b, b.withColumnRenamed("l", "r"), "l", "r").collect()}
    assert got == {(k, m): len(s & t) / len(s | t) for k, s in bits.items() for m, t in bits.items() if s & t}


def test_bootstraps(spark):
    m = spark.createDataFrame([("s", b, f"q{i}", float(i % 2)) for b in "xy" for i in range(20)] + [("t", "x", "q", 1.0)], "scope string, baseline string, query string, recall double")
    got = {(r.scope, r.baseline): r for r in resample.query_intervals(m, ["recall"], 500).collect()}
    assert got["s", "x"].low == got["s", "y"].low and 0.2 < got["s", "x"].low < 0.5 < got["s", "x"].high < 0.8 and got["t", "x"].status == "n=1_descriptive_only"
    one_cluster = spark.createDataFrame([("s", "u", 1.0, 2)], "scope string, unit string, top double, bottom int")
    assert resample.cluster_intervals(one_cluster, ["scope"], "unit", "top", "bottom", 20).first().status == "not_estimable"


def _plain_draws(n, replicates, seed):
    from hashlib import md5

    return [[int(md5(f"{seed}|{r}|{k}".encode()).hexdigest()[:8], 16) % n for k in range(1, n + 1)] for r in range(1, replicates + 1)]


def test_replicates_as_weights(spark, monkeypatch):
    """Against plain draws: groups of the same and of other sizes over several blocks and parts, nulls, a null key, one unit, no units."""
    monkeypatch.setattr(resample, "UNITS", 16)
    monkeypatch.setattr(resample, "PART", 7)
    rows = [(g, i, (i * 37 % 11) / 7 if i % 5 else None, float(i % 3)) for g, n in (("a", 50), ("b", 50), (None, 33), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i int, x double, y double")
    got = {(r.g, r.metric): r for r in resample.metric_intervals(df, ["x", "y"], ["g"], "i", 20, 5).collect()}
    assert len(got) == 8
    for g in ("a", "b", None, "c"):
        for k, m in ((2, "x"), (3, "y")):
            v = np.array([r[k] or 0.0 for r in rows if r[0] == g])
            means = [v[d].mean() for d in _plain_draws(len(v), 20, 5)]
            r = got[g, m]
            assert (r.n, r.status) == (len(v), "estimated" if len(v) > 1 else "n=1_descriptive_only")
            assert [r.mean, r.low, r.high] == pytest.approx([v.mean(), *np.quantile(means, resample.LEVELS)])
    assert resample.metric_intervals(df.where("false"), ["x"], ["g"], "i", 20).count() == 0
    ratio = resample.cluster_intervals(df.where("g = 'a'"), ["g"], "i", "x", "y", 20, 5).first()
    x, y = (np.array([r[k] or 0.0 for r in rows if r[0] == "a"]) for k in (2, 3))
    assert [ratio.mean, ratio.low, ratio.high] == pytest.approx([x.sum() / y.sum(), *np.quantile([x[d].sum() / y[d].sum() for d in _plain_draws(50, 20, 5)], resample.LEVELS)])
    nothing = resample.cluster_intervals(df.where("g = 'a'").withColumn("y", F.lit(0)), ["g"], "i", "x", "y", 20).first()
    assert (nothing.clusters, nothing.mean, nothing.low) == (50, None, None)


def test_pcg64_intervals_against_numpy(spark):
    from quillrank.functions.scalars import derived_seed

    v = {b: [(i * k % 13) / 13 for i in range(30)] for b, k in (("x", 5), ("y", 7))}
    m = spark.createDataFrame([("s", b, f"q{i:02}", x) for b, xs in v.items() for i, x in enumerate(xs)], "scope string, baseline string, query string, recall double")
    got = {r.baseline: r for r in resample.query_intervals(m, ["recall"], 700, 3).collect()}
    draw = np.random.Generator(np.random.PCG64(derived_seed(3, "s")))
    index = np.concatenate([draw.integers(0, 30, size=(k, 30)) for k in (500, 200)])
    for b, xs in v.items():
        assert [got[b].mean, got[b].low, got[b].high] == pytest.approx([np.mean(xs), *np.quantile(np.array(xs)[index].mean(axis=1), (0.025, 0.975))])


def test_gate_and_plug_ins(spark):
    pairs = spark.createDataFrame([("a", "1;2; ", "x"), ("b", "", "x")], "pair_key string, e string, t string")
    assert {tuple(r) for r in gate.expand_mappings(pairs, "e", "t").collect()} == {("a", "1", "x"), ("a", "2", "x")}
    maps = spark.createDataFrame([("a", True), ("b", False)], "pair_key string, validated boolean")
    acts = spark.createDataFrame([], "pair_key string, activity_id string")
    audit = gate.pair_audit(pairs, maps, acts)
    assert gate.gate_faults(audit).count() == 0 and {r.pair_key: r.status for r in audit.collect()}["b"] == "entity_pair_not_sqlite_validated"
    s = chemistry.scaffold_rows(spark.createDataFrame([("a", "C1CC1"), ("b", "CC"), ("c", "?")], "k string, s string"), "k", "s", lambda t: None if t == "?" else "ring" if "1" in t else "")
    assert {tuple(r) for r in s.select("k", "scaffold", "scaffold_status").collect()} == {("a", "ring", "ok"), ("b", "", "acyclic_or_empty_bemis_murcko"), ("c", "", "invalid_smiles")}


def test_number_literals(spark):
    texts = {"5d": None, "5D": None, "1.5f": None, "0x1p3": None, "NaN": None, "inf": None, "-Infinity": None, "": None, None: None, "1__0": None, "_1": None, "1_": None, "1e": None, ".": None, "1e999": None,
             "5": 5.0, " 5\t\n": 5.0, "+5.": 5.0, "-.5": -0.5, "1_000.2_5": 1000.25, "1e3": 1000.0, "2E-2": 0.02, "007": 7.0}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.finite(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in got} == texts


def test_seeds_and_thresholds_by_row(spark):
    rows = spark.createDataFrame([("a", "0.3"), ("b", "1"), ("c", "0"), ("d", "1.2"), ("e", "x"), ("f", None)], "k string, t string")
    got = {r.k: (r.seed, r.t) for r in rows.select("k", S.derived_seed_text(7, F.col("k"), F.lit("z")).alias("seed"), S.threshold_of(F.col("t")).alias("t")).collect()}
    assert all(int(seed, 16) == S.derived_seed(7, k, "z") for k, (seed, _) in got.items())
    assert [got[k][1] for k in "abcdef"] == ["0.30", "1.00", None, None, None, None]


def test_ranks_in_ranges_part_one_block(spark):
    """One query with most targets, most of them tied at 0: many ranges hold it, none much more than its share."""
    n = 60_000
    grid = spark.range(n).select(F.lit("b").alias("baseline"), F.lit("q").alias("query"), F.format_string("t%06d", "id").alias("target"), F.when(F.col("id") % 10 == 0, F.col("id") % 97).otherwise(0).cast("double").alias("score"))
    grid = grid.union(grid.where("score > 90").withColumn("query", F.lit("other"))).union(grid.limit(1).withColumn("query", F.lit("lone")))
    keys = ["baseline", "query", "target"]
    a, b = ranking.ranked(grid, "salt"), ranking.ranked_in_ranges(grid, "salt", parts=16)
    both = a.select(*keys, "rank", "eligible").join(b.select(*keys, F.col("rank").alias("r"), F.col("eligible").alias("e")), keys, "full_outer")
    assert both.count() == grid.count() and both.where("NOT (rank <=> r AND eligible <=> e)").count() == 0
    empty = ranking.ranked_in_ranges(grid.limit(0), "salt")
    assert empty.count() == 0 and empty.columns == [*grid.columns, "rank", "eligible"]


def test_broken_runs_are_found(spark):
    rows = [("b", "q", f"t{r}", s, r) for r, s in enumerate([3.0, 2.0, 2.0, 1.0, 0.0, 0.0, 0.0], 1)]
    led = spark.createDataFrame(rows, "baseline string, query string, target string, score double, rank int")
    assert ranking.broken_ties(ranking.tie_runs(led)).count() == 0
    swapped = led.withColumn("rank", F.when(F.col("rank") == 3, 4).when(F.col("rank") == 4, 3).otherwise(F.col("rank")))
    assert [tuple(r) for r in ranking.broken_ties(ranking.tie_runs(swapped)).collect()] == [("b", "q", 2.0, 2, 2, 4, 2)]
    gap = led.withColumn("rank", F.when(F.col("rank") == 7, 9).otherwise(F.col("rank")))
    twice = led.withColumn("rank", F.when(F.col("rank") == 6, 5).otherwise(F.col("rank")))
    assert [r.score for r in ranking.broken_ties(ranking.tie_runs(gap)).collect()] == [0.0] == [r.score for r in ranking.broken_ties(ranking.tie_runs(twice)).collect()]


def test_bounded_joins_against_full_ones(spark):
    import random

    draw = random.Random(3)
    parts = ["alpha", "beta", "gam", "delt", "eps", "zeta", "eta", "iota"]
    names = [(k, " ".join(draw.choice(parts) for _ in range(draw.randrange(1, 5)))) for k in range(150)] + [(900, "x"), (901, None)]
    g = similarity.gram_weights(spark.createDataFrame(names, "k long, t string"), "k", "t").cache()
    l, r = g.withColumnRenamed("k", "a"), g.withColumnRenamed("k", "b").where("b % 3 <> 0")
    full = {(x.a, x.b): x.similarity for x in similarity.cosine_join(l, r, "a", "b").collect()}
    for least in (0.3, 0.7, 1.0):
        got = {(x.a, x.b): x.similarity for x in similarity.cosine_join_above(l, r, "a", "b", least).collect()}
        assert set(got) == {p for p, s in full.items() if s >= least - 1e-9} and all(abs(s - full[p]) < 1e-9 for p, s in got.items())
    want = {(x.a, x.b): x.place for x in ranking.top_k(similarity.cosine_join(l, r, "a", "b"), ["a"], [F.desc(F.round("similarity", 9)), F.col("b")], 6).collect()}
    assert {(x.a, x.b): x.place for x in similarity.nearest(l, r, "a", "b", 6).collect()} == want
    bits = spark.createDataFrame([(k, b) for k in range(60) for b in {draw.randrange(12) for _ in range(draw.randrange(1, 8))} | {99}], "k long, bit long")
    x, y = bits.withColumnRenamed("k", "a"), bits.withColumnRenamed("k", "b")
    every = {(p.a, p.b): p.similarity for p in similarity.tanimoto_join(x, y, "a", "b").collect()}
    for least in (0.25, 0.6, 1.0):
        assert {(p.a, p.b): p.similarity for p in similarity.tanimoto_join_above(x, y, "a", "b", least).collect()} == {p: s for p, s in every.items() if s >= least}


def test_a_gram_of_all_names_makes_no_pairs(spark):
    """20,000 names of which all share a gram and none shares another: the bounded join makes no candidates of them."""
    n = 20_000
    rows = spark.range(n).select(F.col("id").alias("k"), F.explode(F.array(F.struct(F.lit("all").alias("gram"), F.lit(0.6).alias("weight")), F.struct(F.concat(F.lit("own"), F.col("id").cast("string")).alias("gram"), F.lit(0.8).alias("weight")))).alias("e")).select("k", "e.*")
    got = similarity.cosine_join_above(rows.withColumnRenamed("k", "a"), rows.withColumnRenamed("k", "b"), "a", "b", 0.7)
    assert got.agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same")).first() == (n, n)


def test_contraction_settles_hubs_and_paths(spark):
    """A hub of 20,000 neighbours, a path of 3,000 nodes and a pair: labels are the smallest nodes."""
    hub = spark.range(20_000).select(F.format_string("h%05d", "id").alias("l"), F.lit("hub").alias("r"))
    path = spark.range(1500).select(F.explode(F.array(F.struct(F.format_string("p%04d", "id").alias("l"), F.format_string("p%04d", "id").alias("r")), F.struct(F.format_string("p%04d", F.col("id") + 1).alias("l"), F.format_string("p%04d", "id").alias("r")))).alias("e")).select("e.*")
    edges = hub.union(path).union(spark.createDataFrame([("a", "z"), ("a", "z"), (None, "q"), ("q", None)], "l string, r string"))
    got = {r.component: r.n for r in graph.contracted_components(edges, "l", "r").groupBy("component").agg(F.count("*").alias("n")).collect()}
    assert got == {"L|h00000": 20_001, "L|p0000": 3001, "L|a": 2}
    assert graph.contracted_components(edges.limit(0), "l", "r").count() == 0


def test_exact_bounds_against_bisection(spark):
    cases = [(0, 5), (1, 5), (4, 5), (5, 5), (3, 400), (57, 300), (0, 0), (200, 1000)]
    got = spark.createDataFrame(cases, "x int, n int").select("x", "n", metrics.exact_upper_bound(F.col("x"), F.col("n")).alias("u")).collect()
    for r in got:
        assert r.u is None if r.n == 0 else abs(r.u - metrics.upper_bound(r.x, r.n)) < 1e-9, r


def test_popularity_in_32_bits(spark):
    """Sums in the order of entities, over batches and for a target that most rows hold."""
    import numpy as np

    rows = [("hot", f"e{k:05d}", 0.1 + k % 7) for k in range(25_000)] + [(f"t{k % 9}", f"e{k}", 0.3 * k) for k in range(200)] + [(None, "e", 1.0), ("t1", "x", None)]
    history = spark.createDataFrame(rows, "target string, entity string, weight double").repartition(7)
    want = {}
    for t, e, w in sorted(r for r in rows if None not in r):
        want[t] = np.float32(want.get(t, np.float32(0)) + np.float32(w))
    assert {r.target: np.float32(r.score) for r in scoring.popularity_in_order(history).collect()} == want
    assert scoring.popularity_in_order(history.limit(0)).count() == 0


def test_order_statistics_by_counts(spark):
    import random

    draw = random.Random(9)
    rows = [(g, None if k % 11 == 0 else float(draw.choice([draw.randrange(3), draw.uniform(0, 9)]))) for g, n in (("a", 700), ("b", 1), ("c", 2), (None, 30)) for k in range(1, n + 1)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {r.g: r for r in audits.distribution(df, ["g"], "v").collect() if r.n}
    got = {r.g: r for r in audits.order_statistics(df, ["g"], "v").collect()}
    assert set(got) == set(want)
    for g, r in got.items():
        v = sorted(x for h, x in rows if h == g and x is not None)
        assert r.upper_median == v[len(v) // 2] and r.n == len(v)
        assert all(math.isclose(r[c], want[g][c], rel_tol=1e-12, abs_tol=1e-12) for c in ("least", "q25", "median", "q75", "largest", "mean"))
    counts = spark.createDataFrame([(g, k) for g in "xy" for k in ([1] * 300 + [5, 5, 9, 40] if g == "x" else [3])], "g string, v long")
    a, b = ({r.g: r for r in f(counts, ["g"], "v").collect()} for f in (audits.concentration, audits.concentration_by_counts))
    assert all(math.isclose(a[g][c], b[g][c], rel_tol=1e-12, abs_tol=1e-12) for g in "xy" for c in ("sources", "total", "hhi", "gini", "effective", "top1", "top5", "top10", "top1pct"))


def test_metrics_at_depths_are_those_of_each_depth(spark):
    rows = [("b", "s", f"q{q}", f"t{q}-{r}", r) for q, ranks in enumerate([(1, 2, 60), (11, 12), (50, 51), (10,), (999,)]) for r in ranks]
    relevant = spark.createDataFrame(rows, "baseline string, scope string, query string, target string, rank int")
    many = {r.query: r for r in metrics.at_depths(relevant, (10, 50)).collect()}
    for k in (10, 50):
        for r in metrics.per_query(relevant, k).collect():
            got = many[r.query]
            assert (got.relevant, got.mrr, got[f"recall_{k}"]) == (r.relevant, r.mrr, r.recall) and got[f"ndcg_{k}"] == pytest.approx(r.ndcg, abs=1e-12)
    assert many["q3"].recall_10 == 1 and many["q1"].recall_10 == 0 and many["q2"].recall_50 == 0.5
    assert metrics.at_depths(relevant.where("false")).collect() == []


def test_attribution_sums_count_what_the_kinds_leave(spark):
    kinds = "baseline string, scope string, query string, target string, rank int, score double"
    # scores of q1: 0.9 once, 0.5 twice, 0 twice; of q2: 0.4 once, 0 once (a zero that is not tied)
    relevant = spark.createDataFrame([("b", "s", "q1", "t1", 1, 0.9), ("b", "s", "q1", "t2", 2, 0.5), ("b", "s", "q1", "t4", 4, 0.0), ("b", "s", "q2", "t9", 2, 0.0), ("b", "u", "q1", "t4", 4, 0.0)], kinds)
    blocks = spark.createDataFrame([("b", "q1", 0.9, 1), ("b", "q1", 0.5, 2), ("b", "q1", 0.0, 2), ("b", "q2", 0.4, 1), ("b", "q2", 0.0, 1)], "baseline string, query string, score double, size bigint")
    got = {r.scope: r.asDict() for r in audits.attribution_sums(relevant, blocks, ["baseline", "scope"]).collect()}
    assert got["s"] == {"baseline": "b", "scope": "s", "relations": 4, "queries": 2, "zero_tied": 1, "positive_tied": 1, "positive_unique": 1, "first_zero_tied": 0, "first_positive_tied": 0, "first_positive_unique": 1, "first_other": 1, "relation_gap": 1, "query_gap": 0}
    assert (got["u"]["first_zero_tied"], got["u"]["relation_gap"], got["u"]["zero_tied"]) == (1, 0, 1)
    assert audits.attribution_sums(relevant.where("false"), blocks, ["baseline", "scope"]).collect() == []


def test_denominators_that_disagree(spark):
    a = spark.createDataFrame([("x", 1, 2), ("y", 3, 4), ("z", None, 5), ("gone", 0, None)], "k string, n bigint, m bigint")
    b = spark.createDataFrame([("x", 1, 2), ("y", 3, 5), ("z", None, 5), ("new", 7, 8)], "k string, n bigint, m bigint")
    got = {tuple(r) for r in shaping.disagreeing(a, b, ["k"], ["n", "m"]).collect()}
    assert got == {("y", "m", 4.0, 5.0), ("gone", "n", 0.0, None), ("gone", "m", None, None), ("new", "n", None, 7.0), ("new", "m", None, 8.0)}
    assert shaping.disagreeing(a, a, ["k"], ["n", "m"]).collect() == []


def test_pair_states_by_flags_are_those_by_sets(spark):
    tiers = list(S.TIERS)
    rows = [
        (("v2", "v3")[i % 2], f"p{i % 5}", "e", f"t{i % 5}", tiers[i % 5 if i % 4 else 0], i % 3 != 0, i % 4 != 1, ("PMID", "DOI")[i % 7 == 6], str(i), ("day", "month")[i % 6 == 5], f"20{10 + i % 10}-01-02") for i in range(60)
    ] + [("v2", "only old", "e", "t", tiers[1], True, True, "DOI", "x", "missing", None), ("v3", "only new", "e", "t", tiers[4], False, False, "PMID", "8", "day", "2019-03-04")]
    kinds = "version string, pair_key string, entity string, target string, tier string, is_primary boolean, is_strict boolean, ref_kind string, ref string, precision string, day string"
    cutoff = F.lit("2015-06-30").cast("date")
    df = spark.createDataFrame(rows, kinds).withColumn("published", F.when(F.col("precision") == "day", F.to_date("day"))).drop("day")
    df = df.withColumn("pre_cutoff_status", temporal.pre_cutoff_status(F.col("ref_kind"), F.col("ref"), F.col("precision"), F.col("published"), cutoff))
    given = df.join(evidence.version_membership(df).select("pair_key", "cross_version_status"), "pair_key").join(temporal.pair_screen(df.where("version = 'v3'"), cutoff).select("pair_key", "temporal_screen_status"), "pair_key", "left")
    want, got = evidence.pair_states(given), evidence.pair_states_at_once(df, cutoff)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) and got.count() == 7


def test_ledger_joins_and_shuffles_no_product(spark, capsys):
    """Popularity, transfer from entities and the mask are found beside a target: one exchange of the product, by query, and no join that sorts it."""
    from quillrank.operators import scoring

    h = spark.createDataFrame([("a", "t1", 1.0), ("a", "t2", 0.7), ("b", "t1", 0.7)], "entity string, target string, weight double")
    q, t = spark.createDataFrame([("a",), ("b",), ("new",)], "query string"), spark.createDataFrame([("t1",), ("t2",), ("t3",)], "target string")
    sims = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 0.5), ("b", "a", 0.5), ("b", "b", 1.0)], "query string, entity string, similarity double")
    led = scoring.ledger(h, q, t, "s", (scoring.POPULARITY, scoring.FINGERPRINT), entity_similarity=sims)
    got = {(r.baseline == scoring.POPULARITY, r.query, r.target): r.score for r in led.collect()}
    assert {k[1:]: v for k, v in got.items() if k[0]} == {("a", "t3"): 0.0, ("b", "t2"): 0.7, ("b", "t3"): 0.0, ("new", "t1"): 1.7, ("new", "t2"): 0.7, ("new", "t3"): 0.0}
    assert {k[1:]: v for k, v in got.items() if not k[0]} == {("a", "t3"): 0.0, ("b", "t2"): 0.35, ("b", "t3"): 0.0, ("new", "t1"): 0.0, ("new", "t2"): 0.0, ("new", "t3"): 0.0}
    led.explain()
    plan = capsys.readouterr().out
    exchanges = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert exchanges and "LeftAnti" not in plan
    assert not [line for line in exchanges if "baseline#" in line.split("),")[0] or {"query", "target"} <= set(line.split("(", 1)[1].replace("#", ",").replace(" ", "").split(","))]


def test_number_of_a_text_is_parsed_once(spark):
    from quillrank.functions import scalars as S

    texts = [" 5\n", "\t1_0.5e1 ", "1__0", "nan", "1e999", "0x1p3", "5d", "", None, "5 ", "-.5"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    assert [r.x for r in df.select(S.finite(F.col("t")).alias("x")).collect()] == [5.0, 105.0, None, None, None, None, None, None, None, None, -0.5]
    plan = df.select(S.tier(F.lit("="), F.lit("Ki"), F.col("t"), F.lit("nM")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 1


def test_two_ledgers_are_aligned_without_a_join_of_products(spark, capsys):
    h = spark.createDataFrame([("a", "t1", 1.0), ("b", "t1", 0.7), ("c", "t2", 0.7), ("b", "t2", 0.7)], "entity string, target string, weight double")
    q, t = spark.createDataFrame([("a",), ("new",)], "query string"), spark.createDataFrame([("t1",), ("t2",), ("t3",)], "target string")
    both = scoring.aligned(h, q, t, "s", scoring.POPULARITY, scoring.ENTITIES)
    one, other = scoring.ledger(h, q, t, "s", (scoring.POPULARITY,)), scoring.ledger(h.withColumn("weight", F.lit(1.0)), q, t, "s", (scoring.POPULARITY,))
    want = ranking.aligned(one, other, ["query", "target"])
    assert both.columns == want.columns and sorted(map(tuple, both.collect())) == sorted(map(tuple, want.collect()))
    both.explain()
    assert "FullOuter" not in capsys.readouterr().out


def test_texts_are_read_once_each(spark):
    """What texts alone decide is found for each distinct combination, nulls among them, and joined: rows are not parsed."""
    from quillrank.functions import scalars as S
    from quillrank.operators import evidence

    rows = [("=", "Ki", "5", "nM"), ("=", "Ki", "5", "nM"), (None, "Ki", "5", "nM"), ("=", None, None, "nM"), ("<", "IC50", "7", "uM")] * 3
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, relation string, endpoint string, value string, unit string")
    texts = ["relation", "endpoint", "value", "unit"]
    found = S.tier(*map(F.col, texts))
    got = evidence.by_text(df, texts, found)
    want = df.select("*", found.alias("_t")).select("*", "_t.*").drop("_t")
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "RLIKE" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_leading_ranks_are_the_ledgers_without_it(spark):
    """Counts of scores, relevant scores and leading ranks, against the full ledger; only cells that reach the limit are ranked."""
    import random

    from quillrank.operators import metrics, ranking, scoring

    rng, k = random.Random(5), 3
    entities, targets = [f"e{i}" for i in range(6)], [f"t{i:02d}" for i in range(40)]
    pairs = {(e, t): rng.choice([1.0, 0.7]) for e in entities[:5] for t in targets[:30] if rng.random() < 0.3}
    h = spark.createDataFrame([(e, t, w) for (e, t), w in pairs.items()], "entity string, target string, weight double")
    q, t = spark.createDataFrame([(e,) for e in entities], "query string"), spark.createDataFrame([(x,) for x in targets], "target string")
    sims = spark.createDataFrame([(a, b, 1.0 if a == b else round(rng.random(), 2)) for a in entities[:5] for b in entities[:4]], "query string, entity string, similarity double")
    wanted = spark.createDataFrame([(s, e, x) for s in ("wide", "narrow") for e in entities for x in targets if (e, x) not in pairs and rng.random() < (0.2 if s == "wide" else 0.03)], "scope string, query string, target string")
    names = (scoring.POPULARITY, scoring.FINGERPRINT)
    led = scoring.ledger(h, q, t, "s", names, entity_similarity=sims).cache()
    u = scoring.Universe(h, q, t, wanted, sims)
    both = lambda f: f(names[0]).withColumn("baseline", F.lit(names[0])).unionByName(f(names[1]).withColumn("baseline", F.lit(names[1])))
    blocks = ranking.counted_blocks(both(u.counts))
    assert sorted(map(str, blocks.select("baseline", "query", "score", "start", "end", "size").collect())) == sorted(map(str, ranking.tie_blocks(led).select("baseline", "query", "score", "start", "end", "size").collect()))
    relevant = wanted.join(both(u.asked), ["query", "target"]).select("baseline", "scope", "query", "target", "score")
    full = wanted.join(led, ["query", "target"]).select("baseline", "scope", "query", "target", "score", "rank")
    limits = ranking.leading_limits(relevant, blocks, k, ["scope"])
    above = both(lambda n: u.above(n, limits.where(F.col("baseline") == n).select("query", "limit")))
    got = ranking.leading_ranks(relevant, blocks, above, "s")
    assert sorted(map(str, metrics.per_query(got, k).collect())) == sorted(map(str, metrics.per_query(full, k).collect()))
    true = {tuple(r[:4]): r.rank for r in full.collect()}
    assert {tuple(r[:4]) for r in got.select(full.columns[:4]).collect()} == set(true)
    assert all(r.rank == true[r[:4]] or k < r.rank <= true[r[:4]] for r in got.select(*full.columns).collect())
    assert above.count() < led.count()
    found = scoring.score_fingerprint(h, q, sims)
    plain = sims.join(h, "entity").groupBy("query", "target").agg(F.max(F.col("similarity") * F.col("weight")).alias("score"))
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.select(found.columns).collect()))


def test_universe_meets_both_baselines_in_one_pass(spark, monkeypatch):
    """Runs, relevant cells and leaders of both baselines against the full ledger, from rows made beside their targets; a task sends each score of a query once, and a weight of 0 makes no NaN of a missing similarity."""
    import random

    from quillrank.operators import ranking, scoring

    monkeypatch.setattr(scoring, "TARGETS_AT_ONCE", 4)
    rng, names = random.Random(11), (scoring.POPULARITY, scoring.FINGERPRINT)
    entities, targets = [f"e{i}" for i in range(6)], [(f"t{i:02d}", i) for i in range(40)]
    pairs = [(e, x, rng.choice([1.0, 0.7, 0.0, None]), rng.choice(["A", None])) for e in entities[:5] for x, _ in targets[:30] if rng.random() < 0.4]
    p = spark.createDataFrame([(e, x, w, None if w is not None else g) for e, x, w, g in pairs], "entity string, target string, weight double, grade string")
    h, wanted = p.where("weight IS NOT NULL").select("entity", "target", "weight"), p.where("grade IS NOT NULL").select(F.col("entity").alias("query"), "target", "grade")
    q, t = spark.createDataFrame([(e,) for e in entities], "query string"), spark.createDataFrame(targets, "target string, size int")
    sims = spark.createDataFrame([(a, b, 1.0 if a == b else round(rng.random(), 1)) for a in entities[:5] for b in entities[:4] if a == b or rng.random() < 0.6], "query string, entity string, similarity double")
    led = scoring.ledger(h, q, t, "s", names, entity_similarity=sims).cache()
    given = scoring.Universe(h, q, t, wanted, sims)
    raw = scoring._transferred(given.rows.coalesce(1), sims, q, "counts")
    assert raw.count() == raw.drop("size").distinct().count()
    assert raw.where("isnan(score)").count() == 0
    u = scoring.Universe(h, q, t, wanted, sims, t.join(scoring.Universe.beside(p, F.col("weight"), F.col("grade")), "target", "left"), ("size",))
    texts = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    run = ("baseline", "query", "score", "start", "end", "size")
    blocks = ranking.counted_blocks(u.runs())
    assert texts(blocks, *run) == texts(ranking.tie_blocks(led), *run)
    asked = scoring._long(u.both_asked(), names, "grade", "size")
    cell = ("baseline", "query", "target", "score", "grade", "size")
    want = wanted.join(led, ["query", "target"]).join(t, "target")
    assert wanted.count() and texts(asked, *cell) == texts(want, *cell)
    limits = ranking.leading_limits(asked, blocks, 3, [])
    limits = spark.createDataFrame(limits.collect(), limits.schema)
    above = u.both_above(limits)
    assert texts(above, *cell[:4]) == texts(led.join(limits, ["baseline", "query"]).where("score >= limit"), *cell[:4])
    assert above._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = ranking.leading_ranks(asked, blocks, above, "s", limits=limits)
    assert texts(got, *cell) == texts(want, *cell)
    true = {r[:3]: r.rank for r in want.select(*cell[:3], "rank").collect()}
    assert all(r.rank == true[r[:3]] or 3 < r.rank <= true[r[:3]] for r in got.select(*cell[:3], "rank").collect())


def test_leaders_by_popularity_need_no_product(spark):
    """Recall and first ranks under several policies are those of the full ranking; the plan has no product of queries and targets."""
    import random

    from quillrank.operators import metrics, ranking, scoring

    rng, k = random.Random(8), 2
    qs, ts = [f"q{i}" for i in range(4)], [f"t{i:02d}" for i in range(25)]
    own = sorted({(p, e, t) for p in ("a", "b") for e in qs[:3] for t in ts[:20] if rng.random() < 0.35})
    h = spark.createDataFrame([(*x, rng.choice([1.0, 0.7])) for x in own], "policy string, entity string, target string, weight double")
    q, t = spark.createDataFrame([(x,) for x in qs], "query string"), spark.createDataFrame([(x,) for x in ts], "target string")
    asked = spark.createDataFrame([(x, y) for x in qs for y in ts if rng.random() < 0.3], "query string, target string")
    got = scoring.popularity_leaders(h, q, t, asked, "s", "policy", k)
    grid = q.crossJoin(t).crossJoin(h.select("policy").distinct()).join(h.select("policy", F.col("entity").alias("query"), "target"), ["policy", "query", "target"], "left_anti")
    scores = grid.join(h.groupBy("policy", "target").agg(F.sum("weight").alias("_s")), ["policy", "target"], "left").withColumn("score", F.round(F.coalesce("_s", F.lit(0.0)), 9))
    want = asked.join(ranking.ranked(scores, "s", ["policy", "query"]), ["query", "target"])
    per = lambda df: sorted(map(str, metrics.per_query(df, k, ["policy", "query"]).collect()))
    assert per(got) == per(want) and got.count() == want.count()


def test_ranks_by_ties_are_those_of_the_windows(spark, monkeypatch):
    """One sort by ties numbers both baselines as the windows do, over targets in several tasks; relevant cells alone have the same ranks."""
    import random

    from quillrank.operators import ranking, scoring

    rng = random.Random(11)
    entities, targets = [f"e{i}" for i in range(5)], [f"t{i:02d}" for i in range(60)]
    pairs = {(e, t): rng.choice([1.0, 0.7]) for e in entities[:4] for t in targets[:40] if rng.random() < 0.3}
    h = spark.createDataFrame([(e, t, w) for (e, t), w in pairs.items()], "entity string, target string, weight double")
    q, t = spark.createDataFrame([(e,) for e in entities[1:]], "query string"), spark.createDataFrame([(x,) for x in targets], "target string")
    sims = spark.createDataFrame([(a, b, 1.0 if a == b else 0.5) for a in entities for b in entities[:3]], "query string, entity string, similarity double")
    wanted = spark.createDataFrame([(e, x) for e in entities for x in targets if (e, x) not in pairs and rng.random() < 0.2], "query string, target string")
    names = (scoring.POPULARITY, scoring.FINGERPRINT)
    led = scoring.ledger(h, q, t, "s", names, entity_similarity=sims)
    u = scoring.Universe(h, q, t, wanted, sims)
    assert u.rows.rdd.getNumPartitions() > 1  # small rows, large product
    blocks = ranking.tie_blocks(led)
    got = u.ledger(blocks, "s")
    assert got.columns == led.columns and sorted(map(str, got.collect())) == sorted(map(str, led.collect()))
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    few = led.join(wanted, ["query", "target"], "left_semi").select(led.columns)
    assert sorted(map(str, u.ledger(blocks, "s", asked=True).collect())) == sorted(map(str, few.collect()))


def test_runs_of_ranks_need_no_join_and_cross_stretches(spark, monkeypatch):
    """A run that goes over a border of stretches is one; a rank that comes twice begins twice; the ledger is read once."""
    from quillrank.operators import ranking

    monkeypatch.setattr(ranking, "STRETCH", 3)
    rows = [("b", "q", 1.0, r) for r in (1, 2, 3, 4, 5, 6, 7)] + [("b", "q", 0.5, r) for r in (8, 10, 11, 12, 12)] + [("b", "p", 0.5, r) for r in (2, 2, 3)]
    runs = ranking.tie_runs(spark.createDataFrame(rows, "baseline string, query string, score double, rank int"))
    assert sorted(map(tuple, runs.collect())) == [("b", "p", 0.5, 2, 2, 3, 3), ("b", "q", 0.5, 2, 8, 12, 5), ("b", "q", 1.0, 1, 1, 7, 7)]
    assert "Join" not in runs._jdf.queryExecution().optimizedPlan().toString()


def test_rank_faults_of_large_ranks_and_differences_beside(spark):
    """Squares whose sum is above 64 bits stay exact, and two ranks in one row are told apart without a join."""
    from quillrank.operators import audits, contracts

    rows = [("b", "q", r) for r in (1, 3_000_000_000, 2_147_483_647, 2_147_483_646)]
    led = spark.createDataFrame(rows, "baseline string, query string, rank long")
    got = contracts.rank_faults(led, ["baseline", "query"]).first()
    assert (int(got.s1), int(got.s2)) == (sum(r[2] for r in rows), sum(r[2] ** 2 for r in rows))
    both = spark.createDataFrame([(1, 1), (2, 3), (4, None), (None, None)], "a int, b int")
    told = audits.rank_differences_beside(both, "a", "b")
    assert told.count() == 2 and "Join" not in told._jdf.queryExecution().optimizedPlan().toString()


def test_further_baselines_need_no_product(spark):
    """Scores that hang on a target's text lie beside the two others: runs, leaders and ledger of all four are those of the full product, and of a run that all cells share few are ranked."""
    import random

    from quillrank.operators import metrics, ranking, scoring

    rng, k = random.Random(13), 3
    names = (scoring.POPULARITY, scoring.FINGERPRINT, scoring.SEQUENCE, scoring.PAIR)
    entities, targets = [f"e{i}" for i in range(4)], [(f"t{i:03d}", f"n{i % 5}" if i % 11 else None) for i in range(600)]
    pairs = {(e, t): rng.choice([1.0, 0.7]) for e in entities[:3] for t, _ in targets[:400] if rng.random() < 0.1}
    h = spark.createDataFrame([(e, t, w) for (e, t), w in pairs.items()], "entity string, target string, weight double")
    q, t = spark.createDataFrame([(e,) for e in entities], "query string"), spark.createDataFrame(targets, "target string, text string")
    sims = spark.createDataFrame([(a, b, 1.0 if a == b else 0.5) for a in entities for b in entities[:3]], "query string, entity string, similarity double")
    wanted = spark.createDataFrame([(s, e, x) for s in ("wide", "narrow") for e in entities for x, _ in targets if (e, x) not in pairs and rng.random() < (0.1 if s == "wide" else 0.01)], "scope string, query string, target string")
    flat = spark.createDataFrame([(e, f"n{i}", 1.0) for e in entities[:3] for i in range(5)], "query string, text string, score double")
    some = spark.createDataFrame([(e, f"n{i}", rng.random()) for e in entities[1:] for i in range(3)], "query string, text string, score double")
    by_target = lambda df: t.join(df, "text").select("query", "target", "score")
    led = ranking.ranked(scoring.candidates(h, q, t, "s", names, {scoring.SEQUENCE: by_target(flat), scoring.PAIR: by_target(some)}, entity_similarity=sims).drop("_tie"), "s").cache()
    u = scoring.Universe(h, q, t, wanted, sims, t.join(scoring.Universe(h, q, t, wanted, sims).rows, "target"), ("text",))
    u.scored_by("text", {scoring.SEQUENCE: flat, scoring.PAIR: some})
    texts = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    run, cell = ("baseline", "query", "score", "start", "end", "size"), ("baseline", "query", "target", "score", "rank", "eligible")
    blocks = ranking.counted_blocks(u.runs()).cache()
    assert u.names == names and texts(blocks, *run) == texts(ranking.tie_blocks(led), *run)
    assert texts(u.ledger(blocks, "s"), *cell) == texts(led, *cell)
    cells = scoring._long(u.both_asked(), names).dropDuplicates()
    relevant = wanted.join(cells, ["query", "target"])
    limits = ranking.tie_limits(relevant, blocks, ranking.leading_limits(relevant, blocks, k, ["scope"]), k, ["scope"], "s")
    limits = spark.createDataFrame(limits.collect(), limits.schema)
    above, plain = u.both_above(limits, "s"), u.both_above(limits)
    assert 2 * above.count() < plain.count() < led.count()
    got = wanted.join(ranking.leading_ranks(cells, blocks, above, "s", limits=limits), ["query", "target"])
    full = wanted.join(led, ["query", "target"])
    assert got.count() == full.count() and texts(metrics.per_query(got, k), *metrics.BY, "relevant", "hits", "mrr", "recall", "ndcg") == texts(metrics.per_query(full, k), *metrics.BY, "relevant", "hits", "mrr", "recall", "ndcg")


def test_ranks_in_ranges_deal_the_rows_once(spark, monkeypatch):
    """Rows that can be made twice are not written before they are sampled, and meet what is ahead of their range without a second exchange."""
    from quillrank.operators import graph

    names, write = [], graph.shared
    monkeypatch.setattr(graph, "shared", lambda df, name: names.append(name) or write(df, name))
    grid = spark.range(3000).select(F.lit("b").alias("baseline"), F.lit("q").alias("query"), F.format_string("t%06d", "id").alias("target"), (F.col("id") % 7).cast("double").alias("score"))
    got, want = ranking.ranked_in_ranges(grid, "salt", parts=8, once=False), ranking.ranked(grid, "salt")
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert names == ["rank-ranges", "rank-ahead"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
