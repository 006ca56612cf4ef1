"""Tables for reports: long forms, assemblies and their closures. Rendering is left to others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.operators import contracts


def unpivot(df: DataFrame, dimensions: list[str], section: str) -> DataFrame:
    """One row per dimensions and item, with section, item, value and status; nulls are not estimable."""
    items = [c for c in df.columns if c not in dimensions]
    cells = F.array(*(F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in items))
    out = df.select(F.lit(section).alias("section"), *dimensions, F.explode(cells).alias("c")).select("section", *dimensions, "c.*")
    return out.withColumn("status", F.when(F.col("value").isNull(), "not_estimable").otherwise("estimated"))


def key_values(df: DataFrame, name: str) -> DataFrame:
    """Items and values of a one-row table of figures."""
    m = F.create_map(*(x for c in df.columns for x in (F.lit(c), F.col(c).cast("double"))))
    return df.select(F.lit(name).alias("section"), F.explode(m).alias("item", "value"))


def stacked(parts: list[DataFrame]) -> DataFrame:
    """Sections of one long table; a column that a section lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def matrix(df: DataFrame, rows: list[str], column: str, values: list, value: str) -> DataFrame:
    return df.groupBy(*rows).pivot(column, values).agg(F.first(value))


def tie_class(identifiable: Column, operable: Column) -> Column:
    return F.when(~operable, "non_operational").when(identifiable, "score_identifiable").otherwise("tie_dependent")


def unique_row(df: DataFrame, **criteria) -> DataFrame:
    """The one row that meets the criteria; any other number of them raises."""
    found = df.where(reduce(lambda a, b: a & b, (F.col(k) == v for k, v in criteria.items())))
    if (n := len(found.limit(2).collect())) != 1:
        raise contracts.ContractError(f"{criteria}: {'several' if n else 'no'} rows")
    return found


def closure_gap(total: int, removed: list[int], left: int) -> int:
    """What a flow of counts loses; 0 when it closes."""
    return total - sum(removed) - left


def disagreeing(a: DataFrame, b: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Keys of which two tables give different denominators, or that one of them lacks: keys, item, left, right. Nulls agree with nulls."""
    side = lambda df, x: df.select(*keys, *(F.col(n).cast("double").alias(f"_{x}_{n}") for n in names), F.lit(True).alias(f"_{x}"))
    both = side(a, "l").join(side(b, "r"), keys, "full_outer")
    cells = F.array(*(F.struct(F.lit(n).alias("item"), F.col(f"_l_{n}").alias("left"), F.col(f"_r_{n}").alias("right")) for n in names))
    out = both.select(*keys, (F.col("_l").isNull() | F.col("_r").isNull()).alias("_alone"), F.explode(cells).alias("_c")).select(*keys, "_alone", "_c.*")
    return out.where(F.col("_alone") | ~F.col("left").eqNullSafe(F.col("right"))).drop("_alone")
