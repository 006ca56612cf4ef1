"""Contracts as data: each check returns the rows that break it, and ``require`` raises on any. Nothing runs until asked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """Rows break a contract; the message shows a few."""


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if gone := [c for c in columns if c not in df.columns]:
        raise ContractError(f"missing columns {gone} among {df.columns}")
    return df


def require(violations: DataFrame, what: str, show: int = 5) -> None:
    if found := violations.limit(show).collect():
        raise ContractError(f"{what}: {[tuple(r) for r in found]}")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are blank or occur more than once."""
    blank = reduce(lambda a, b: a | b, (F.coalesce(F.trim(F.col(k).cast("string")), F.lit("")) == "" for k in keys))
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > 1) | blank)


def unique_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, or a failed query where a key has several rows: the check is part of the plan, so nothing runs before the result is asked for."""
    rest = [c for c in df.columns if c not in keys]
    once = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("_row") if rest else F.lit(None).alias("_row"))
    what = F.concat(F.lit("several rows of key "), F.to_json(F.struct(*keys)))
    checked = once.withColumn("_ok", F.when(F.col("_n") == 1, True).otherwise(F.raise_error(what).cast("boolean"))).where("_ok")
    return checked.select(*keys, *(F.col("_row")[c].alias(c) for c in rest)).select(df.columns)


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", fill: str | None = None) -> DataFrame:
    """Joins facts to a dimension that has one row of each key, or fails; with fill, texts that a left join doesn't find are that."""
    out = left.join(unique_rows(right, keys), keys, how)
    return out if fill is None else out.fillna(fill, [c for c in right.columns if c not in keys])


def keyset_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that one side alone has."""
    sides = left.select(*keys).distinct().withColumn("_l", F.lit(True)).join(right.select(*keys).distinct().withColumn("_r", F.lit(True)), keys, "full_outer")
    return sides.where(F.col("_l").isNull() | F.col("_r").isNull()).select(*keys, F.when(F.col("_r").isNull(), "left_only").otherwise("right_only").alias("side"))


def uncovered(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of left that right lacks; right may have more."""
    return left.select(*keys).distinct().join(right.select(*keys), keys, "left_anti")


def overlap(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that both have, where none may be."""
    return left.select(*keys).intersect(right.select(*keys))


def disagreements(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of a key whose shared attributes differ between the two sides."""
    r = right.select(*keys, *(F.col(c).alias(f"_r_{c}") for c in columns))
    differs = reduce(lambda a, b: a | b, (~F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in columns))
    return left.join(r, keys).where(differs).select(*keys, *columns, *(f"_r_{c}" for c in columns))


def conflicting(df: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Keys with more than one payload; nulls are a value."""
    return df.groupBy(*keys).agg(F.count_distinct(F.to_json(F.struct(*payload))).alias("variants")).where("variants > 1")


def grid_gaps(df: DataFrame, dimensions: dict[str, DataFrame]) -> DataFrame:
    """Cells of the product of small dimension tables that df lacks."""
    grid = reduce(lambda a, b: a.crossJoin(b), (d.select(k).distinct() for k, d in dimensions.items()))
    return grid.join(df.select(*dimensions), list(dimensions), "left_anti")


def partition_gap(df: DataFrame, stratum: Column, total: int | Column) -> DataFrame:
    """One row with the sum of strata and the total, if they differ."""
    sums = df.groupBy(stratum.alias("stratum")).agg(F.count("*").alias("n")).agg(F.sum("n").alias("covered"))
    return sums.withColumn("total", F.lit(total).cast("long")).where("covered <> total")


def rank_faults(ledger: DataFrame, block: list[str], rank: str = "rank") -> DataFrame:
    """Blocks whose ranks are no permutation of 1..n, told by count, sum, sum of squares, least and largest."""
    r, wide = F.col(rank).cast("long"), F.col(rank).cast("decimal(38,0)")
    exact = (r >= -(1 << 31)) & (r < 1 << 31)  # squares in two halves of 32 bits, whose sums stay exact without a decimal for each row
    dec = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,0)")
    n = F.col("n").cast("decimal(38,0)")
    squares = dec(F.when(exact, F.shiftright(r * r, 32))) * F.lit(1 << 32) + dec(F.when(exact, (r * r).bitwiseAND(F.lit((1 << 32) - 1)))) + dec(F.when(~exact, wide * wide))
    total = (dec(F.when(exact, r)) + dec(F.when(~exact, wide))).cast("decimal(38,0)")
    some = F.count(rank) > 0
    sums = ledger.groupBy(*block).agg(F.count("*").alias("n"), F.when(some, total).alias("s1"), F.when(some, squares.cast("decimal(38,0)")).alias("s2"), F.min(rank).alias("low"), F.max(rank).alias("high"))
    right = (2 * F.col("s1") == n * (n + 1)) & (6 * F.col("s2") == n * (n + 1) * (2 * n + 1)) & (F.col("low") == 1) & (F.col("high") == F.col("n"))
    return sums.where(~right)


def membership_hash(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """SHA-256 of the sorted lines, each ended by a line feed; one line per row, columns joined by tabs.

    A hash of a whole sorted set needs it in one place: meant for states and memberships, not for fact tables.
    """
    line = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    lines = F.array_sort(F.collect_list(line))
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.sha2(F.concat(F.array_join(lines, "\n"), F.lit("\n")), 256).alias("sha256"))


def identifying(df: DataFrame, forbidden: tuple[str, ...], pattern: str) -> DataFrame:
    """For tables that may hold aggregates only: forbidden columns raise, text values that look like ids are returned."""
    inner = lambda t: [n for f in getattr(t, "fields", []) for n in (f.name, *inner(f.dataType))] + [n for k in ("elementType", "keyType", "valueType") if hasattr(t, k) for n in inner(getattr(t, k))]
    if named := [n for n in inner(df.schema) if n.lower() in forbidden or n.lower().endswith("_ids")]:
        raise ContractError(f"columns identify rows: {named}")
    # nested values are searched as JSON
    texts = [c for c, t in df.dtypes if "string" in t]
    text = lambda c: F.col(c) if dict(df.dtypes)[c] == "string" else F.to_json(F.struct(c))
    found = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), text(c).alias("value")) for c in texts))) if texts else None
    rows = df.select(found.alias("x")).select("x.*") if texts else df.sparkSession.createDataFrame([], "column string, value string")
    return rows.where(F.col("value").rlike(pattern))
