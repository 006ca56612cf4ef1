"""Bootstrap intervals: by numpy's generator in one task per scope over per-query metrics, or by replicates as weights, from hashed draws that any SQL engine repeats."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from quillrank.functions.scalars import derived_seed
from quillrank.shipping import ship

LEVELS = (0.025, 0.975)


def status(n: Column) -> Column:
    return F.when(n == 0, "not_estimable").when(n == 1, "n=1_descriptive_only").otherwise("estimated")


def query_intervals(metrics: DataFrame, names: list[str], replicates: int = 10_000, seed: int = 20260719) -> DataFrame:
    """Percentile intervals of macro means per scope and baseline; in a scope all baselines share the draws.

    metrics: scope, baseline, query and the named columns, some thousand rows a scope: each scope is one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = {b: g.sort_values("query") for b, g in pdf.groupby("baseline", sort=True)}
        n = len(next(iter(wide.values())))
        draw = np.random.Generator(np.random.PCG64(derived_seed(seed, pdf["scope"].iloc[0])))
        values = {b: g[names].to_numpy(float) for b, g in wide.items()}
        sums = {b: [] for b in values}
        for at in range(0, replicates, 500):
            index = draw.integers(0, n, size=(min(500, replicates - at), n))
            for b, v in values.items():
                sums[b].append(v[index].mean(axis=1))
        rows = []
        for b, v in values.items():
            low, high = np.quantile(np.concatenate(sums[b]), LEVELS, axis=0) if n > 1 else (v[0], v[0])
            rows += [(pdf["scope"].iloc[0], b, name, n, v[:, k].mean(), low[k], high[k], "estimated" if n > 1 else "n=1_descriptive_only") for k, name in enumerate(names)]
        return pd.DataFrame(rows, columns=["scope", "baseline", "metric", "n", "mean", "low", "high", "status"])

    ship(metrics.sparkSession)
    kept = metrics.select("scope", "baseline", F.col("query").cast("string").alias("query"), *(F.col(n).cast("double").alias(n) for n in names))
    return kept.groupBy("scope").applyInPandas(run, "scope string, baseline string, metric string, n long, mean double, low double, high double, status string")


#: Units and replicates whose weights a task holds at once.
UNITS, PART = 1 << 14, 250


def _weights(n: int, block: int, part: int, held: tuple[int, int], replicates: int, seed: int) -> np.ndarray:
    """How often each replicate of a part draws each unit of a block of 0..n-1; in part 0 a row of ones goes first.

    A draw depends on replicate, slot and n alone, so all groups of one size share it.
    """
    units, some = held
    first, width = block * units, min(units, n - block * units)
    rows = [np.ones(width)] if part == 0 else []
    for r in range(part * some + 1, min((part + 1) * some, replicates) + 1):
        times = np.zeros(width)
        for at in range(1, n + 1, 1 << 16):
            slots = range(at, min(at + (1 << 16), n + 1))
            hashed = np.frombuffer(b"".join(md5(b"%d|%d|%d" % (seed, r, k)).digest()[:4] for k in slots), ">u4")
            pick = hashed.astype(np.int64) % n - first
            times += np.bincount(pick[(pick >= 0) & (pick < width)], minlength=width)
        rows.append(times)
    return np.array(rows).reshape(len(rows), width)


def weighted_sums(units: DataFrame, by: list[str], order: str, values: list[str], replicates: int = 10_000, seed: int = 20260719) -> DataFrame:
    """For each group by, n (its units) and each value's sums as an array: the plain sum, then that of each replicate.

    Replicates are weights: a unit meets how often each draws it, in the task where it lies, and only sums of UNITS units
    over PART replicates leave the task. Units are numbered by order in their group; those that tie take any order. A null
    counts as 0. All values and all groups of one size share the draws. No units give no rows.
    """
    held = UNITS, PART
    parts = max(1, -(-replicates // PART))
    kept = units.select(*by, F.col(order).alias("_order"), *(F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(f"_v{k}") for k, v in enumerate(values)))
    w = Window.partitionBy(*by)
    numbered = kept.withColumns({"_pick": (F.row_number().over(w.orderBy("_order")) - 1).cast("long"), "_n": F.count("*").over(w)}).drop("_order")
    placed = numbered.withColumns({"_block": F.floor(F.col("_pick") / UNITS).cast("long"), "_part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lain = placed.repartitionByRange(tasks, "_n", "_block", "_part", *by).sortWithinPartitions("_n", "_block", "_part", *by, "_pick")

    def summed(batches):
        key, weights = None, None
        for batch in batches:
            columns = {c: batch.column(c).to_numpy() for c in ("_n", "_block", "_part", "_pick")}
            cells = np.column_stack([batch.column(f"_v{k}").to_numpy() for k in range(len(values))])
            keys = np.column_stack([columns[c] for c in ("_n", "_block", "_part")])
            # Groups of one block have the same places in ascending order, so a place that doesn't ascend begins a group.
            begins = np.r_[True, (np.diff(columns["_pick"]) <= 0) | (np.diff(keys, axis=0) != 0).any(axis=1)] if len(keys) else np.zeros(0, bool)
            starts = np.flatnonzero(begins)
            sums = [[] for _ in values]
            for a, b in zip(starts, [*starts[1:], len(keys)]):
                if key != (at := tuple(map(int, keys[a]))):
                    key, weights = at, _weights(*at, held, replicates, seed)
                total = weights[:, columns["_pick"][a:b] - key[1] * held[0]] @ cells[a:b]
                for k in range(len(values)):
                    sums[k].append(total[:, k])
            took = batch.take(pa.array(starts))
            yield pa.RecordBatch.from_arrays([*(took.column(c) for c in (*by, "_n", "_part")), *(pa.array(x, pa.list_(pa.float64())) for x in sums)], names=[*by, "_n", "_part", *(f"_s{k}" for k in range(len(values)))])

    ship(units.sparkSession)
    out = StructType([*(lain.schema[c] for c in (*by, "_n", "_part")), *(StructField(f"_s{k}", ArrayType(DoubleType())) for k in range(len(values)))])
    partial = lain.mapInArrow(summed, out)
    whole = partial.groupBy(*by, "_n", "_part").agg(*(F.collect_list(f"_s{k}").alias(f"_s{k}") for k in range(len(values))))
    plus = lambda c: F.aggregate(F.slice(c, 2, 1 << 30), F.get(c, F.lit(0)), lambda x, y: F.zip_with(x, y, lambda a, b: a + b))
    whole = whole.select(*by, "_n", F.struct("_part", *(plus(F.col(f"_s{k}")).alias(f"_s{k}") for k in range(len(values)))).alias("_p"))
    rows = whole.groupBy(*by, "_n").agg(F.array_sort(F.collect_list("_p")).alias("_p"))
    return rows.select(*by, F.col("_n").alias("n"), *(F.flatten(F.col(f"_p._s{k}")).alias(v) for k, v in enumerate(values)))


def _ends(drawn: Column) -> list[Column]:
    """The interval's ends among the replicates' values, interpolated; nulls don't count."""
    found = F.array_sort(F.filter(drawn, lambda x: x.isNotNull()))

    def end(p: float) -> Column:
        at = (F.size(found) - 1) * F.lit(p)
        low, part = F.floor(at).cast("int"), at - F.floor(at)
        return F.get(found, low) * (1 - part) + F.coalesce(F.get(found, low + 1), F.get(found, low)) * part

    return [F.when(F.size(found) > 0, end(p)).alias(x) for p, x in zip(LEVELS, ("low", "high"))]


def _drawn(sums: Column) -> Column:
    return F.slice(sums, 2, 1 << 30)


def metric_intervals(metrics: DataFrame, names: list[str], by: list[str], order: str, replicates: int = 10_000, seed: int = 20260719) -> DataFrame:
    """Percentile intervals of the means of several metrics per group, in one pass: by, metric, n, mean, low, high, status. A null counts as 0."""
    sums = weighted_sums(metrics, by, order, names, replicates, seed)
    long = sums.select(*by, "n", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("_s")) for m in names))).alias("_m")).select(*by, "_m.metric", "n", "_m._s")
    means = long.withColumn("_s", F.transform("_s", lambda x: x / F.col("n")))
    return means.select(*by, "metric", "n", F.get("_s", F.lit(0)).alias("mean"), *_ends(_drawn(F.col("_s"))), status(F.col("n")).alias("status"))


def hashed_intervals(metrics: DataFrame, value: Column, by: list[str], order: str, replicates: int = 10_000, seed: int = 20260719) -> DataFrame:
    """Percentile intervals of a mean per group, by hashed draws that any SQL engine repeats. A null counts as 0."""
    return metric_intervals(metrics.select(*by, order, value.alias("_v")), ["_v"], by, order, replicates, seed).drop("metric")


def paired_contrasts(metrics: DataFrame, name: str, order: dict[str, int]) -> DataFrame:
    """Differences of a metric between each two baselines on the same query of a scope; the baseline of the larger order comes first."""
    rank = F.create_map(*(F.lit(x) for pair in order.items() for x in pair))
    side = lambda x: metrics.select("scope", "query", F.col("baseline").alias(x), F.col(name).alias(f"_{x}"), rank[F.col("baseline")].alias(f"_o{x}"))
    both = side("left").join(side("right"), ["scope", "query"]).where("_oleft > _oright")
    return both.select("scope", "query", "left", "right", (F.col("_left") - F.col("_right")).alias("difference"))


def cluster_intervals(sums: DataFrame, by: list[str], unit: str, top: str, bottom: str, replicates: int = 10_000, seed: int = 20260719) -> DataFrame:
    """Intervals of a ratio of sums when whole clusters are drawn: the drawn clusters' own count is below the line. Fewer than two clusters are not estimable.

    sums: one row per cluster. Replicates whose count is 0 have no ratio and don't count.
    """
    drawn = weighted_sums(sums.select(*by, unit, F.col(top).alias("_t"), F.col(bottom).alias("_b")), by, unit, ["_t", "_b"], replicates, seed)
    ratios = drawn.withColumn("_r", F.zip_with("_t", "_b", lambda t, b: F.try_divide(t, b)))
    sure = F.col("n") >= 2
    low, high = _ends(_drawn(F.col("_r")))
    return ratios.select(*by, F.col("n").alias("clusters"), F.get("_r", F.lit(0)).alias("mean"), F.when(sure, low).alias("low"), F.when(sure, high).alias("high"), F.when(sure, "estimated").otherwise("not_estimable").alias("status"))


def width_comparison(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Widths of two intervals and their ratio, with a status where one is missing or empty."""
    side = lambda df, x: df.select(*keys, (F.col("high") - F.col("low")).alias(f"width_{x}"))
    out = side(a, "a").join(side(b, "b"), keys, "full_outer")
    return out.withColumns({"ratio": F.when(F.col("width_a") > 0, F.col("width_b") / F.col("width_a")), "status": F.when(F.col("width_a").isNull() | F.col("width_b").isNull(), "not_estimable").when(F.col("width_a") == 0, "zero_width_reference").otherwise("estimated")})


