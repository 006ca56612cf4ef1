"""Dates of partial precision, cutoffs and policies over rows and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.functions import scalars as S


def is_numeric_reference(kind: Column, ref: Column) -> Column:
    return (F.upper(F.trim(F.coalesce(kind, F.lit("")))) == "PMID") & F.coalesce(F.trim(ref), F.lit("")).rlike("^[0-9]+$")


def row_status(kind: Column, ref: Column, found: Column, precision: Column, published: Column, cutoff: Column) -> Column:
    """Of a row at a cutoff, in this order: form of the reference, lookup, precision, date."""
    return (
        F.when(~is_numeric_reference(kind, ref), "excluded_not_numeric_pmid")
        .when(~F.coalesce(found, F.lit(False)), "excluded_pubmed_not_found")
        .when((F.coalesce(precision, F.lit("missing")) != "day") | published.isNull(), "excluded_non_day_precision")
        .when(published <= cutoff, "eligible_pre_cutoff")
        .otherwise("excluded_after_cutoff")
    )


def pre_cutoff_status(kind: Column, ref: Column, precision: Column, published: Column, cutoff: Column) -> Column:
    return F.when(~is_numeric_reference(kind, ref), "v2_primary_reference_not_pmid").when((F.coalesce(precision, F.lit("missing")) != "day") | published.isNull(), "v2_primary_pmid_missing_or_not_day_precise").when(published <= cutoff, "pre_cutoff").otherwise("v2_primary_pmid_after_cutoff")


def pair_screen(rows: DataFrame, cutoff: Column, key: str = "pair_key") -> DataFrame:
    """Five ordered outcomes of a pair over its rows. rows: ref_kind, ref, precision, published."""
    return rows.groupBy(key).agg(*screen_sums(F.lit(True))).withColumn("temporal_screen_status", screen_status(cutoff))


def screen_sums(when: Column) -> list[Column]:
    """Aggregates of the rows where ``when`` holds that a pair's outcome reads."""
    numeric = when & is_numeric_reference(F.col("ref_kind"), F.col("ref"))
    exact = numeric & (F.col("precision") == "day") & F.col("published").isNotNull()
    day = F.when(exact, F.col("published"))
    return [F.count_if(when).alias("records"), F.count_if(numeric).alias("numeric_records"), F.count_distinct(F.when(numeric, F.col("ref"))).alias("references"), F.count_if(numeric & ~exact).alias("unresolved"), F.min(day).alias("earliest"), F.max(day).alias("latest")]


def screen_status(cutoff: Column) -> Column:
    return F.when(F.col("numeric_records") == 0, "no_pmid_reference").when(F.col("records") > F.col("numeric_records"), "non_pmid_reference_present").when(F.col("unresolved") > 0, "pmid_date_not_day_precise").when(F.col("earliest") <= cutoff, "pre_cutoff_or_same_day").otherwise("future_candidate_pmid_only")


def dated(rows: DataFrame, value: str, precision: str, cutoff: Column) -> DataFrame:
    """Adds lo, hi, interval_status and one boolean for each policy."""
    out = rows.withColumn("_b", S.bounds(F.col(value), F.col(precision))).withColumns({"lo": F.col("_b.lo"), "hi": F.col("_b.hi")}).drop("_b")
    return out.withColumn("interval_status", S.interval_status(F.col("lo"), F.col("hi"), cutoff)).withColumns(S.policies(F.col(precision), F.col("lo"), F.col("hi"), cutoff))


def by_policy(rows: DataFrame, names: tuple[str, ...] = ("day_precise_only", "interval_certain", "interval_earliest_bound")) -> DataFrame:
    """The rows that each policy admits, with a column policy: one pass over the rows for all policies."""
    admitted = F.filter(F.array(*(F.when(F.col(n), F.lit(n)) for n in names)), lambda x: x.isNotNull())
    return rows.withColumn("policy", F.explode(admitted)).drop(*names)
