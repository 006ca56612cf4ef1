"""Structures and alignments through plug-ins: the libraries are optional, their results are plain tables.

A plug-in is a function from texts to results that runs on Arrow batches; without one, a precomputed table is read.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.shipping import ship


def applied(df: DataFrame, column: str, name: str, f: Callable[[list[str]], list], kind: str) -> DataFrame:
    """Adds what a plug-in makes of a text column, batch by batch."""

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(f(texts.tolist()))

    ship(df.sparkSession)
    return df.withColumn(name, run(F.col(column)))


def scaffold_rows(df: DataFrame, key: str, structure: str, scaffold: Callable[[str], str | None]) -> DataFrame:
    """key, scaffold, scaffold_status. scaffold: text to key, empty for an acyclic structure, None for an invalid one."""

    def states(texts: list[str]) -> list[str]:
        found = [scaffold(t or "") for t in texts]
        return ["invalid_smiles|" if x is None else f"ok|{x}" if x else "acyclic_or_empty_bemis_murcko|" for x in found]

    out = applied(df.select(key, structure), structure, "_s", states, "string")
    return out.select(key, F.substring_index("_s", "|", 1).alias("scaffold_status"), F.expr("substring(_s, instr(_s, '|') + 1)").alias("scaffold"))


def on_bits(df: DataFrame, key: str, structure: str, fingerprint: Callable[[str], list[int]]) -> DataFrame:
    """key and bit, one row per on-bit, for similarity.tanimoto_join. A structure that can't be read fails the query."""
    out = applied(df.select(key, structure), structure, "_b", lambda texts: [fingerprint(t) for t in texts], "array<int>")
    return out.select(key, F.explode(F.array_distinct("_b")).alias("bit"))


def standardised(df: DataFrame, structure: str, policies: dict[str, Callable[[str], str]], name: str = "form") -> DataFrame:
    """One row per row and policy with the form that the policy's plug-in gives; all policies see a batch at once. A structure that can't be read fails the query."""
    made = applied(df, structure, "_f", lambda texts: [[f(t or "") for f in policies.values()] for t in texts], "array<string>")
    cells = F.arrays_zip(F.array(*map(F.lit, policies)).alias("policy"), F.col("_f").alias("form"))
    return made.withColumn("_c", F.explode(cells)).withColumns({"policy": F.col("_c")["policy"], name: F.col("_c")["form"]}).drop("_f", "_c")


def repaired(rows: DataFrame, alternatives: DataFrame, key: str, structure: str) -> DataFrame:
    """Structures of keys that have exactly one alternative. alternatives: key, structure, round_trip (its key equals)."""
    one = alternatives.where("round_trip").groupBy(key).agg(F.array_sort(F.collect_set(structure)).alias("_a")).where(F.size("_a") == 1)
    return rows.join(one, key, "left").withColumn(structure, F.coalesce(F.col("_a")[0], F.col(structure))).drop("_a")


def policy_changes(policies: DataFrame, reference: str) -> DataFrame:
    """Per policy and role: rows, those that differ from the reference policy, and keys that several entities share. policies: policy, role, entity, form."""
    ref = policies.where(F.col("policy") == reference).select("role", "entity", F.col("form").alias("_ref"))
    base = policies.join(ref, ["role", "entity"]).groupBy("policy", "role").agg(F.count("*").alias("rows"), F.count_if(~F.col("form").eqNullSafe(F.col("_ref"))).alias("changed"))
    groups = policies.groupBy("policy", "role", "form").agg(F.count("*").alias("_n")).groupBy("policy", "role").agg(F.count_if(F.col("_n") > 1).alias("shared_forms"), F.sum(F.col("_n") - 1).alias("excess"))
    return base.join(groups, ["policy", "role"])


def alignment_hits(hits: DataFrame, identity: float, coverage: float = 0.8) -> DataFrame:
    """Hits of an external aligner within bounds: query, target, pident (percent), qcov, tcov; identity comes out as a fraction."""
    return hits.withColumn("identity", F.col("pident") / 100).where((F.col("identity") >= identity) & (F.col("qcov") >= coverage) & (F.col("tcov") >= coverage))
