"""Joins over chains of dimension tables: two hops, left chains that collect children, driven joins and checked catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.operators import contracts


def two_hops(facts: DataFrame, first: DataFrame, second: DataFrame, keys: tuple[str, str]) -> DataFrame:
    """facts with the attributes of a dimension and of that dimension's own dimension; both have one row of each key."""
    return contracts.many_to_one(contracts.many_to_one(facts, first, [keys[0]]), second, [keys[1]])


def collected(parents: DataFrame, children: DataFrame, grandchildren: DataFrame, keys: tuple[str, str], sets: dict[str, str]) -> DataFrame:
    """One row per parent with the sorted sets of columns of its children and theirs; parents without any have empty sets.

    Sets are combined where rows lie, before the shuffle by parent.
    """
    chain = parents.join(children, keys[0], "left").join(grandchildren, keys[1], "left")
    return chain.groupBy(parents.columns).agg(*(F.array_sort(F.collect_set(c)).alias(n) for n, c in sets.items()))


def driven(wanted: DataFrame, facts: DataFrame, chain: list[tuple[DataFrame, list[str], str]], columns: list[str], once: list[str]) -> DataFrame:
    """Rows of facts that a list of wanted keys asks for, through a chain of tables (with keys and join kind), one for each combination of ``once``.

    The planner broadcasts what is wanted if its size allows. Of rows that share a combination the least stays.
    """
    out = facts.join(wanted, [c for c in wanted.columns if c in facts.columns])
    for table, keys, how in chain:
        out = out.join(table, keys, how)
    out = out.fillna("")  # texts of an optional table
    rest = [c for c in columns if c not in once]
    return out.groupBy(*once).agg(F.min(F.struct(*rest)).alias("_row")).select(*once, *(F.col("_row")[c].alias(c) for c in rest))


def catalogue(rows: DataFrame, keep: Column, key: str, columns: list[str]) -> DataFrame:
    """The rows that are kept, in the order of their key; a key with several fails the query."""
    return contracts.unique_rows(rows.where(keep).select(key, *columns), [key]).orderBy(key)
