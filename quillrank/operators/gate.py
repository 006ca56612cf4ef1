"""Leakage gate: what a reference release records about each pair, and what that decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Status and action of a pair.
STATUSES = {
    "historical_activity_recorded_in_chembl31": "exclude_from_future_candidate_pool_historical_chembl31_activity",
    "no_activity_found_in_validated_chembl31_entity_pair": "retain_pending_next_evidence_audit_no_chembl31_activity_found",
    "entity_pair_not_sqlite_validated": "exclude_until_entity_mapping_is_resolved",
}


def expand_mappings(pairs: DataFrame, entity_ids: str, target_ids: str, sep: str = ";") -> DataFrame:
    """Every combination of a pair's listed identifiers, once."""
    ids = lambda c: F.array_distinct(F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), sep), lambda x: F.trim(x)), lambda x: x != ""))
    return pairs.withColumn("entity_id", F.explode(ids(entity_ids))).withColumn("target_id", F.explode(ids(target_ids))).select("pair_key", "entity_id", "target_id").dropDuplicates()


def pair_audit(pairs: DataFrame, mappings: DataFrame, activities: DataFrame) -> DataFrame:
    """Counts and status of each pair. mappings: pair_key, validated; activities: pair_key, activity_id."""
    m = mappings.groupBy("pair_key").agg(F.count("*").alias("mapping_count"), F.count_if("validated").alias("validated_count"))
    a = activities.groupBy("pair_key").agg(F.count("*").alias("activity_rows"), F.count_distinct(F.nullif(F.col("activity_id").cast("string"), F.lit(""))).alias("activity_ids"))
    out = pairs.join(m, "pair_key", "left").join(a, "pair_key", "left").fillna(0, ["mapping_count", "validated_count", "activity_rows", "activity_ids"])
    hit, none, open_ = STATUSES
    return out.withColumn("status", F.when(F.col("activity_rows") > 0, hit).when(F.col("validated_count") > 0, none).otherwise(open_))


def gate(audit: DataFrame) -> DataFrame:
    """The action of each status."""
    return audit.withColumn("action", F.create_map(*(F.lit(x) for pair in STATUSES.items() for x in pair))[F.col("status")])


def gate_faults(audit: DataFrame) -> DataFrame:
    """Rows whose counts contradict their status."""
    hit, none, open_ = STATUSES
    n, v = F.col("activity_rows"), F.col("validated_count")
    right = F.when(F.col("status") == hit, (n > 0) & (v > 0)).when(F.col("status") == none, (n == 0) & (v > 0)).when(F.col("status") == open_, (n == 0) & (v == 0)).otherwise(False)
    return audit.where(~right)


def entity_status(compound_ok: str, target_ok: str):
    """Ordered reasons why no combination of a pair's identifiers is valid; an aggregate over its combinations."""
    any_c, any_t, both = F.bool_or(compound_ok), F.bool_or(target_ok), F.bool_or(F.col(compound_ok) & F.col(target_ok))
    return F.when(both, "validated").when(~any_c & ~any_t, "sqlite_compound_and_target_validation_failed").when(~any_c, "sqlite_compound_validation_failed").when(~any_t, "sqlite_target_validation_failed").otherwise("sqlite_no_joint_valid_mapping")
