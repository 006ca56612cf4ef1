"""Exact rolling medians and median absolute deviations, by wavelet matrices over chunks of time.

A point is a series, a time and a value; points equal in all three count as one with a weight. Each point enters the
window at its time and leaves it 60 minutes later. These events, put in order by ranges of (series, time), are cut into
chunks of about ``EVENTS`` of them, however many points a window holds. A chunk gets, besides its own events, its halo:
of the points that were in the window before and stay in it throughout, the counts by value (running sums of what the
chunks before changed), so a crowded window costs a task no more than its distinct values.

In a task the chunk's points, in the order of time, become ranks of values and a wavelet matrix in numpy. For all times
of the chunk together, descents through the matrix give the medians, and counts of ranges bisect the radius around each
median that holds half of the window.

Hot keys: points, not rows, are shuffled by time, so a moment that a third of all clicks share is one point for each
distinct value; clicks meet their window's result in a join that adaptive execution may split.

Edge cases: a repeated click_id counts once (of rows that differ, one with a time comes first, then the earliest, then
the smallest kind and value, nulls first); null click_ids are one click; clicks without a time go; a null kind is a
series; values that are null, not finite or of 2^59 cents or more give no cents; a window of fewer than two cents has n
alone; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillrank.llm.common import release, written
from quillrank.shipping import ship

#: Events of a chunk, about; the window's length.
EVENTS, SPAN = 50_000, 60 * 60 * 1_000_000
#: Cents from this size on aren't counted.
LIMIT = 1 << 59


class Matrix:
    """A wavelet matrix over weighted ranks in the order of time, with counts by rank of points that every window holds."""

    def __init__(self, ranks: np.ndarray, weights: np.ndarray, held: np.ndarray):
        """held: for each rank the weight that lies in all windows."""
        self.levels = max(1, int(len(held) - 1).bit_length())
        whole = np.zeros(1 << self.levels, np.int64)
        whole[: len(held)] = held
        self.below = np.concatenate([[0], np.cumsum(whole)])
        self.width, self.total = len(ranks) + 1, np.concatenate([[0], np.cumsum(weights)])
        #: For each level, by a bit and a place: the place that it becomes on the next level; the weight of zeros before it, for a bit of 1 alone.
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []
        for level in range(self.levels - 1, -1, -1):
            one = (ranks >> level & 1).astype(bool)
            zeros = np.concatenate([[0], np.cumsum(~one)])
            sums = np.concatenate([[0], np.cumsum(np.where(one, 0, weights))])
            self.steps.append((np.concatenate([zeros, zeros[-1] + np.arange(self.width) - zeros]), np.concatenate([np.zeros(self.width, np.int64), sums])))
            order = np.argsort(one, kind="stable")
            ranks, weights = ranks[order], weights[order]

    def count_below(self, start: np.ndarray, end: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Weight of ranks below the given ones among the points from start to end and those that all windows hold."""
        out = self.below[rank]
        full = rank >> self.levels > 0
        first, last = start, end
        for level, (place, sums) in zip(range(self.levels - 1, -1, -1), self.steps, strict=True):
            bit = (rank >> level & 1) * self.width
            first, last = first + bit, last + bit
            out += sums[last]
            out -= sums[first]
            first, last = place[first], place[last]
        if full.any():
            out[full] = self.below[-1] + (self.total[end] - self.total[start])[full]
        return out

    def kth(self, start: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The rank of the k-th smallest (from 0), by weight."""
        rank, k = np.zeros(len(k), np.int64), k.copy()
        for level, (place, sums) in zip(range(self.levels - 1, -1, -1), self.steps, strict=True):
            left = sums[end + self.width] - sums[start + self.width] + self.below[rank + (1 << level)] - self.below[rank]
            one = (k >= left).astype(np.int64)
            k -= one * left
            rank += one << level
            bit = one * self.width
            start, end = place[start + bit], place[end + bit]
        return rank


def spreads(matrix: Matrix, values: np.ndarray, start: np.ndarray, end: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The doubled median of each window, and the doubled median of the doubled distances from it. Every window has two values or more."""
    low, high = (n - 1) // 2, n // 2
    twice = values[matrix.kth(start, end, low)] + values[matrix.kth(start, end, high)]

    def within(radius: np.ndarray, some: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """How many values lie below and up to the range of this doubled radius, in some of the windows."""
        first = np.searchsorted(values, -((radius - twice[some]) // 2), side="left")
        last = np.searchsorted(values, (twice[some] + radius) // 2, side="right")
        return matrix.count_below(start[some], end[some], first), matrix.count_below(start[some], end[some], last)

    # the smallest radius that holds the lower middle one of the distances
    # n - 2 * (n // 4) values lie from one quartile to the other, which is half of them or more
    quarter = n // 4
    least, most = np.full(len(n), -1), np.maximum(twice - 2 * values[matrix.kth(start, end, quarter)], 2 * values[matrix.kth(start, end, n - 1 - quarter)] - twice)
    open_ = np.flatnonzero(most - least > 1)
    while len(open_):
        middle = least[open_] + (most[open_] - least[open_]) // 2
        below, up_to = within(middle, open_)
        enough = up_to - below > low[open_]
        most[open_[enough]] = middle[enough]
        least[open_[~enough]] = middle[~enough]
        open_ = open_[most[open_] - least[open_] > 1]
    # the upper middle one is the same, or the nearest value outside on either side
    below, up_to = within(most, slice(None))
    none = np.int64(1) << 62
    right = np.where(up_to < n, 2 * values[matrix.kth(start, end, np.minimum(up_to, n - 1))] - twice, none)
    left = np.where(below > 0, twice - 2 * values[matrix.kth(start, end, np.maximum(below - 1, 0))], none)
    other = np.where(up_to - below > high, most, np.minimum(left, right))
    return twice, most + other


def chunk_results(times: np.ndarray, cents: np.ndarray, change: np.ndarray, asked: np.ndarray, held_cents: np.ndarray, held: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One series' chunk: its times with clicks, and n, doubled median and doubled deviation of their windows (0 where n < 2).

    Events: time, cents, change (weight that enters, or less than 0: leaves), asked (whether clicks lie there). held: weights by value in the window before the first event.
    """
    when = np.unique(times[asked])
    first = times.min()
    came, went = change > 0, change < 0
    # points of the chunk by the time they entered: those that leave in it but came before, and those that come
    before = went & (times - span - 1 < first)
    at = np.concatenate([times[before] - span - 1, times[came]])
    value, weight = np.concatenate([cents[before], cents[came]]), np.concatenate([-change[before], change[came]])
    order = np.argsort(at, kind="stable")
    at, value, weight = at[order], value[order], weight[order]
    values = np.unique(np.concatenate([value, held_cents]))
    if not len(values):
        none = np.zeros(len(when), np.int64)
        return when, none, none, none
    stays = np.zeros(len(values), np.int64)
    np.add.at(stays, np.searchsorted(values, held_cents), held)
    np.subtract.at(stays, np.searchsorted(values, cents[before]), -change[before])
    matrix = Matrix(np.searchsorted(values, value), weight, stays)
    start, end = np.searchsorted(at, when - span, side="left"), np.searchsorted(at, when, side="right")
    n = matrix.total[end] - matrix.total[start] + stays.sum()
    median, spread = np.zeros((2, len(when)), np.int64)
    some = n >= 2
    if some.any():
        median[some], spread[some] = spreads(matrix, values, start[some], end[some], n[some])
    return when, n, median, spread


def _results(pdf: pd.DataFrame) -> pd.DataFrame:
    """All chunks of one group: a chunk's events and, with no time, its halo."""
    halo = pdf["time"].isna()
    own, out = pdf[~halo], []
    held = {s: g for s, g in pdf[halo].groupby("series")}
    for series, g in own.groupby("series"):
        h = held.get(series)
        none = np.zeros(0, np.int64)
        when, n, median, spread = chunk_results(g["time"].to_numpy(np.int64), g["cents"].to_numpy(np.int64), g["change"].to_numpy(np.int64), g["asked"].to_numpy(bool), none if h is None else h["cents"].to_numpy(np.int64), none if h is None else h["change"].to_numpy(np.int64))
        out.append(pd.DataFrame({"series": series, "time": when, "n": n, "median2": median, "mad4": spread}))
    return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="object" if c == "series" else "int64") for c in ("series", "time", "n", "median2", "mad4")})


def windows(points: DataFrame, events: int = EVENTS) -> DataFrame:
    """points: series (text, not null), time (microseconds), cents or null. For each series and time: n, median2 and mad4 of the cents in the 60 minutes up to it; 0 where n < 2."""
    spark: SparkSession = points.sparkSession
    summed = written(points.groupBy("series", "time", "cents").agg(F.count("*").alias("w")), "rolling-points")
    zero = F.lit(0).cast("long")
    known = F.col("cents").isNotNull()
    come = F.struct(F.col("time"), F.coalesce("cents", zero).alias("cents"), F.when(known, F.col("w")).otherwise(zero).alias("change"), F.lit(True).alias("asked"))
    go = F.when(known, F.struct((F.col("time") + SPAN + 1).alias("time"), F.col("cents"), (-F.col("w")).alias("change"), F.lit(False).alias("asked")))
    event = summed.select("series", F.explode(F.array_compact(F.array(come, go))).alias("e")).select("series", "e.*")
    # ranges of Spark's own, as many as shuffles have partitions: what it samples for them doesn't grow with the input. A time of a series lies in one.
    row = F.monotonically_increasing_id()
    ranged = event.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "series", "time").sortWithinPartitions("series", "time").withColumn("row", row)
    first = F.min("row").over(Window.partitionBy("series", "time"))
    cut = ranged.withColumn("first", first).select("series", "time", "cents", "change", "asked", F.shiftright("first", 33).alias("part"), F.floor(F.col("first").bitwiseAND((1 << 33) - 1) / events).alias("k"))
    cut = written(cut, "rolling-events")
    release(summed)
    sizes = cut.groupBy("part").agg((F.max("k") + 1).alias("chunks"))  # a row for each range
    offsets = sizes.select("part", (F.sum("chunks").over(Window.orderBy("part")) - F.col("chunks")).alias("offset"))
    dealt = cut.join(F.broadcast(offsets), "part").select("series", "time", "cents", "change", "asked", (F.col("offset") + F.col("k")).alias("chunk"))
    change = dealt.where("change != 0").groupBy("series", "cents", "chunk").agg(F.sum("change").alias("d"))
    w = Window.partitionBy("series", "cents").orderBy("chunk")
    running = change.select("series", "cents", "chunk", F.sum("d").over(w).alias("held"), F.lead("chunk").over(w).alias("next"))
    halo = running.where("held > 0").select("series", F.explode(F.sequence(F.col("chunk") + 1, F.col("next"))).alias("chunk"), F.lit(None).cast("long").alias("time"), "cents", F.col("held").alias("change"), F.lit(False).alias("asked"))
    ship(spark)
    whole = dealt.unionByName(halo)
    return whole.groupBy("chunk").applyInPandas(_results, "series string, time long, n long, median2 long, mad4 long")


def cents_of(value: Column) -> Column:
    x = F.floor(100 * value.cast("double") + 0.5)
    finite = ~F.isnan(value) & (F.abs(100 * value.cast("double")) < float(LIMIT))
    return F.when(finite, x.cast("long"))


def micros(clicks: DataFrame, ts: str) -> Column:
    """Microseconds of a column of times; of times without a zone as they stand, whatever the session's zone."""
    c = F.col(ts)
    if clicks.schema[ts].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(c.cast("timestamp"))
    of_day = F.hour(c) * 3600 + F.minute(c) * 60
    return F.unix_date(c.cast("date")).cast("long") * 86_400_000_000 + of_day.cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def outliers(clicks: DataFrame) -> DataFrame:
    """click_id, kind, n, median2, mad4 and far of every click with a time."""
    row = clicks.select(F.col("click_id").cast("long").alias("click_id"), micros(clicks, "ts").alias("time"), "kind", F.col("value").cast("double").alias("value"))
    once = row.groupBy("click_id").agg(F.min(F.struct(F.col("time").isNull(), "time", "kind", "value")).alias("r")).select("click_id", "r.time", "r.kind", cents_of(F.col("r.value")).alias("cents"))
    series = F.coalesce(F.concat(F.lit("k"), "kind"), F.lit("-"))
    base = written(once.where(F.col("time").isNotNull()).withColumn("series", series), "rolling-clicks")
    found = windows(base.select("series", "time", "cents"))
    some = F.col("n") >= 2
    far = 2 * F.abs(2 * F.col("cents") - F.col("median2")) > 3 * F.col("mad4")
    return base.join(found, ["series", "time"]).select("click_id", "kind", "n", F.when(some, F.col("median2")).alias("median2"), F.when(some, F.col("mad4")).alias("mad4"), F.when(some, far).alias("far"))


#: DuckDB SQL of the contract's rows.
SQL = """
WITH once AS (SELECT click_id, ts, kind, value FROM clicks QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY ts IS NULL, ts, kind NULLS FIRST, value NULLS FIRST) = 1),
base AS (SELECT click_id, ts, kind, CASE WHEN NOT isnan(value) AND abs(100 * value) < 576460752303423488 THEN CAST(floor(100 * value + 0.5) AS BIGINT) END AS c FROM once WHERE ts IS NOT NULL),
held AS (SELECT *, coalesce(list_sort(list(c) FILTER (c IS NOT NULL) OVER (PARTITION BY kind ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTES PRECEDING AND CURRENT ROW)), []) AS w FROM base),
mid AS (SELECT *, len(w) AS n, CASE WHEN len(w) >= 2 THEN w[(len(w) + 1) // 2] + w[len(w) // 2 + 1] END AS median2 FROM held),
dev AS (SELECT *, list_sort(list_transform(w, lambda x: abs(2 * x - median2))) AS d FROM mid),
judged AS (SELECT *, CASE WHEN n >= 2 THEN d[(n + 1) // 2] + d[n // 2 + 1] END AS mad4 FROM dev)
SELECT click_id, kind, CAST(n AS BIGINT) AS n, median2, mad4, CASE WHEN n >= 2 THEN 2 * abs(2 * c - median2) > 3 * mad4 END AS far FROM judged
"""
