"""From measurement rows to pair decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions import scalars as S
from quillrank.operators import temporal

# Rank of tiers, best first; statuses, reasons against a date and decisions.
BEST = list(S.TIERS)
STRICT_MAPPING = "strict_one_to_one_reviewed_human"
REASONS = ("v2_primary_pmid_after_cutoff", "v2_primary_pmid_missing_or_not_day_precise", "v2_primary_reference_not_pmid")
DECISIONS = ("strict_pre_cutoff_training_candidate", "strict_post_cutoff_future_candidate", "historical_snapshot_candidate_not_date_verified_for_training", "excluded_from_strict_temporal_pair_tables")
RATIONALES = ("at_least_one_primary_A_or_B_P1_record_has_day_precise_PMID_on_or_before_cutoff", "absent_from_v2_and_all_v3_records_are_v3_only_PMID_screened_future_candidates", "v2_snapshot_primary_candidate_retained_separately_until_record_level_PubMed_dates_are_archived", "does_not_meet_all_primary_evidence_entity_and_temporal_conditions")


def by_text(rows: DataFrame, texts: list[str], found: Column) -> DataFrame:
    """Rows with the fields of the struct ``found``, which is made from texts alone: once for each distinct combination of them, null being one.

    What is distinct is written, so the planner knows its size: it broadcasts few and sorts many.
    """
    from quillrank.operators.graph import shared

    known = rows.select(*texts).distinct().withColumn("_f", found)
    known = shared(known.select(*(F.col(c).alias(f"_{c}") for c in texts), "_f.*"), "texts")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in texts))
    return rows.join(known, same).drop(*(f"_{c}" for c in texts))


def version_membership(rows: DataFrame, key: str = "pair_key", version: str = "version", names: tuple[str, str] = ("v2", "v3")) -> DataFrame:
    """Rows of each key by version, and whether one or both have it."""
    old, new = names
    counted = rows.groupBy(key).agg(*(F.count_if(F.col(version) == v).alias(f"{v}_records") for v in names))
    status = F.when((F.col(f"{old}_records") > 0) & (F.col(f"{new}_records") > 0), "shared").when(F.col(f"{old}_records") > 0, f"{old}_only").otherwise(f"{new}_only")
    return counted.withColumn("cross_version_status", status)


def tier_rank(tier: Column) -> Column:
    """1 for the best; null for a tier that doesn't exist."""
    return F.nullif(F.array_position(F.array(*map(F.lit, BEST)), tier), F.lit(0)).cast("int")


def best_tier(rows: DataFrame, keys: list[str], tier: str = "tier") -> DataFrame:
    """The best tier of each key; a tier that doesn't exist fails the query."""
    rank = tier_rank(F.col(tier))
    checked = F.when(rank.isNotNull(), rank).otherwise(F.raise_error(F.concat(F.lit("no such tier: "), F.coalesce(F.col(tier), F.lit("null")))).cast("int"))
    return rows.groupBy(*keys).agg(F.element_at(F.array(*map(F.lit, BEST)), F.min(checked)).alias("best_tier"), F.count("*").alias("eligible_row_count"))


def lexical_mode(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The most frequent text that isn't blank, the least of those on a tie."""
    return rows.groupBy(*keys).agg(F.mode(S.blank_to_null(F.col(column)), True).alias("mode"))


def first_rows(rows: DataFrame, keys: list[str], order: list[Column], multiplicity: str | None = None) -> DataFrame:
    """The first row of each key in a total order, with how many there were. An aggregate, so a hot key is combined before it is shuffled."""
    first = F.min_by(F.struct(*rows.columns), F.struct(*order))
    out = rows.groupBy(*keys).agg(first.alias("_row"), F.count("*").alias("_n"))
    return out.select("_row.*", *([F.col("_n").alias(multiplicity)] if multiplicity else []))


def tier_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("version", "tier").agg(F.count("*").alias("records"), F.count_distinct("pair_key").alias("pairs"), F.count_distinct("entity").alias("entities"), F.count_distinct("target").alias("targets"))


def one_to_one(rows: DataFrame, source: str, entry: str, reviewed: Column, taxon: Column, human: str = "9606") -> DataFrame:
    """Status of each source identifier by the entries it maps to."""
    ok = (F.lower(F.trim(reviewed)) == "reviewed") & (F.trim(taxon) == human)
    sets = rows.groupBy(source).agg(F.array_sort(F.collect_set(S.blank_to_null(F.col(entry)))).alias("entries"), F.count("*").alias("mapping_row_count"), F.coalesce(F.bool_or(F.when(S.blank_to_null(F.col(entry)).isNotNull(), ok)), F.lit(False)).alias("ok"))
    n = F.size("entries")
    status = F.when(n == 0, "unmapped_or_deleted").when(n > 1, "one_to_many_mapping").when(F.col("ok"), STRICT_MAPPING).otherwise("not_reviewed_human")
    return sets.select(source, F.when(n == 1, F.col("entries")[0]).otherwise("").alias("canonical"), status.alias("mapping_status"), "mapping_row_count", n.cast("long").alias("mapping_entry_count"))


def _state_counts(versions: tuple[str, str]) -> dict[str, Column]:
    """Counts of a pair's rows: version, is_primary, is_strict, pre_cutoff_status."""
    old, _ = versions
    v = lambda name: F.col("version") == name
    strict = F.col("is_primary") & F.col("is_strict")
    counts = {}
    for name in versions:
        counts |= {f"{name}_all": v(name), f"{name}_primary": v(name) & F.col("is_primary"), f"{name}_strict": v(name) & strict}
    counts[f"{old}_pre_cutoff"] = v(old) & strict & (F.col("pre_cutoff_status") == "pre_cutoff")
    return {n: F.count_if(c) for n, c in counts.items()}


def _state_values(versions: tuple[str, str]) -> dict[str, Column]:
    """What the sets of a pair hold: version, tier, and why a row has no usable date; null where a row adds nothing."""
    open_ = (F.col("version") == versions[0]) & F.col("is_primary") & F.col("is_strict") & (F.col("pre_cutoff_status") != "pre_cutoff")
    return {"versions": F.col("version"), "primary_tiers": F.when(F.col("is_primary"), F.col("tier")), "date_reasons": F.when(open_, F.col("pre_cutoff_status"))}


def _state_columns(versions: tuple[str, str]) -> dict[str, Column]:
    return _state_counts(versions) | {n: F.array_sort(F.collect_set(c)) for n, c in _state_values(versions).items()}


def pair_states(rows: DataFrame, versions: tuple[str, str] = ("v2", "v3")) -> DataFrame:
    """One row per pair of counts and sets. rows: version, pair_key, entity, target, tier, is_primary, is_strict, pre_cutoff_status, cross_version_status, temporal_screen_status."""
    seen = lambda c: F.array_sort(F.collect_set(F.when(F.col("version") == versions[1], F.coalesce(c, F.lit("")))))
    given = {"cross_statuses": seen("cross_version_status"), "screen_statuses": seen("temporal_screen_status")}
    return rows.groupBy("pair_key", "entity", "target").agg(*(c.alias(n) for n, c in (_state_columns(versions) | given).items()))


def pair_states_at_once(rows: DataFrame, cutoff: Column, versions: tuple[str, str] = ("v2", "v3")) -> DataFrame:
    """The same from rows without the two statuses (but with ref_kind, ref, precision, published): both belong to a pair, so one aggregate of its rows gives them.

    Sets are made of one flag for each value they may hold (the two versions, the tiers, the reasons), so all sums are of
    fixed width and no set is gathered; other values are not listed.
    """
    old, new = versions
    known = {"versions": sorted(versions), "primary_tiers": sorted(S.TIERS), "date_reasons": sorted(REASONS)}
    flags = [F.bool_or(c == x).alias(f"_{n}_{k}") for n, c in _state_values(versions).items() for k, x in enumerate(known[n])]
    sums = rows.groupBy("pair_key", "entity", "target").agg(*(c.alias(n) for n, c in _state_counts(versions).items()), *flags, *temporal.screen_sums(F.col("version") == new))
    sets = {n: F.array_compact(F.array(*(F.when(F.col(f"_{n}_{k}"), x) for k, x in enumerate(values)))) for n, values in known.items()}
    cross = F.when((F.col(f"{old}_all") > 0) & (F.col(f"{new}_all") > 0), "shared").otherwise(f"{new}_only")
    held = lambda c: F.when(F.col(f"{new}_all") > 0, F.array(c)).otherwise(F.array().cast("array<string>"))
    out = sums.withColumns(sets | {"cross_statuses": held(cross), "screen_statuses": held(temporal.screen_status(cutoff))})
    return out.select("pair_key", "entity", "target", *_state_counts(versions), *sets, "cross_statuses", "screen_statuses")


def pair_decisions(states: DataFrame) -> DataFrame:
    """Decision, rationale and ordered reasons of each pair. States are of versions v2 and v3 with dates at hand."""
    only = lambda c, x: F.col(c) == F.array(F.lit(x))
    primary, strict = (F.col(f"v2_{k}") + F.col(f"v3_{k}") > 0 for k in ("primary", "strict"))
    has_old, has_new = F.col("v2_all") > 0, F.col("v3_all") > 0
    training = F.col("v2_pre_cutoff") > 0
    future = ~has_old & (F.col("v3_strict") > 0) & only("cross_statuses", "v3_only") & only("screen_statuses", "future_candidate_pmid_only")
    snapshot = ~training & ~future & (F.col("v2_strict") > 0)
    pick = lambda names: F.when(training, names[0]).when(future, names[1]).when(snapshot, names[2]).otherwise(names[3])
    open_new = has_new & ~future & ~training
    one = lambda when, text: F.when(when, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    named = F.transform(F.filter("screen_statuses", lambda x: x != "future_candidate_pmid_only"), lambda x: F.concat(F.lit("v3_temporal_screen_"), F.when(x == "", "missing").otherwise(x)))
    reasons = F.concat(
        F.when(snapshot, F.col("date_reasons")).otherwise(F.array().cast("array<string>")),
        one(~primary, "no_primary_A_or_B_P1_exact_record"),
        one(primary & ~strict, "no_primary_record_with_strict_reviewed_human_sequence_mapping"),
        one(open_new & has_old, "historical_pair_present_in_v2"),
        one(open_new & ~only("cross_statuses", "v3_only"), "v3_pair_not_exclusively_v3_only"),
        F.when(open_new, named).otherwise(F.array().cast("array<string>")),
    )
    return states.select("pair_key", "entity", "target", "v2_all", "v3_all", "v2_strict", "v3_strict", "v2_pre_cutoff", pick(DECISIONS).alias("decision"), pick(RATIONALES).alias("rationale"), F.array_join(F.array_sort(F.array_distinct(reasons)), ";").alias("reasons"))


def reason_histogram(rows: DataFrame, column: str, sep: str = ";") -> DataFrame:
    return rows.select(F.explode(F.split(column, sep)).alias("reason")).where("reason <> ''").groupBy("reason").agg(F.count("*").alias("n"))


def upper_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The element at floor(n/2) of the sorted values, never between two."""
    w = Window.partitionBy(*keys)
    placed = rows.select(*keys, value, F.row_number().over(w.orderBy(value)).alias("_i"), F.count("*").over(w).alias("_n"))
    return placed.where(F.col("_i") == F.floor(F.col("_n") / 2) + 1).select(*keys, F.col(value).alias("upper_median"))
