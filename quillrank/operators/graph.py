"""Components of bipartite graphs, and coldness of targets and scaffolds."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.operators import contracts


def shared(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage by a table in the folder that driver and executors share (spark.checkpoint.dir; a temporary one on a single machine where that is unset)."""
    spark: SparkSession = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        top = tempfile.mkdtemp(prefix="quillrank-")
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, left: str, right: str, limit: int = 50) -> DataFrame:
    """node and component (its smallest node) of a bipartite graph; nodes are texts with a side in front.

    Each round takes the smallest label around, then that label's own; rounds grow with the logarithm of the longest path.
    """
    pairs = edges.select(F.concat(F.lit("L|"), F.col(left).cast("string")).alias("a"), F.concat(F.lit("R|"), F.col(right).cast("string")).alias("b")).distinct()
    both = shared(pairs.union(pairs.select("b", "a")), "graph-edges")
    labels = shared(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")), "graph-labels")
    for _ in range(limit):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_m"))
        low = labels.join(near, "node").select("node", F.least("component", "_m").alias("_low"), F.col("component").alias("_was"))
        far = labels.select(F.col("node").alias("_low"), F.col("component").alias("_far"))
        new = shared(low.join(far, "_low").select("node", F.least("_low", "_far").alias("component"), (F.least("_low", "_far") != F.col("_was")).alias("moved")), "graph-labels")
        labels = new.select("node", "component")
        if not new.where("moved").take(1):
            return labels
    raise RuntimeError(f"components did not settle in {limit} rounds")


def contracted_components(edges: DataFrame, left: str, right: str, limit: int = 200) -> DataFrame:
    """The same labels by contraction, for hubs and long paths.

    Two steps take turns: a node hands the smallest of its neighbours to its larger ones (large star), then to its smaller
    ones (small star), until every edge leads to the smallest node of its component. Edges are never more than before, a
    hub's minimum is taken before the shuffle, and its edges meet it in a join whose large side may be split.
    """
    pairs = edges.select(F.concat(F.lit("L|"), F.col(left).cast("string")).alias("a"), F.concat(F.lit("R|"), F.col(right).cast("string")).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    held = shared(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "graph-stars")
    seen = None
    for _ in range(limit):
        both = held.union(held.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        large = held.select(F.col("b").alias("a"), F.col("a").alias("_v")).join(least, "a").select(F.col("_v").alias("a"), F.col("_m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("_m"))
        met = large.join(low, "a")
        small = met.select(F.explode(F.array(F.struct("a", F.col("_m").alias("b")), F.struct(F.col("b").alias("a"), F.col("_m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        held = shared(small, "graph-stars")
        now = held.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"), F.count_distinct("a").alias("nodes")).first()
        if seen == (now["n"], now["h"]) and now["n"] == now["nodes"]:
            return held.select(F.col("a").alias("node"), F.col("b").alias("component")).union(held.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = (now["n"], now["h"])
    raise RuntimeError(f"components did not settle in {limit} rounds")


def component_sizes(labels: DataFrame) -> DataFrame:
    is_left = F.col("node").startswith("L|")
    return labels.groupBy("component").agg(F.count_if(is_left).alias("left_nodes"), F.count_if(~is_left).alias("right_nodes"), F.count("*").alias("nodes"))


def component_summary(sizes: DataFrame) -> DataFrame:
    """Count of components, those with one left node, and the largest by each side and in total, with shares."""
    out = sizes.agg(F.count("*").alias("components"), F.count_if(F.col("left_nodes") == 1).alias("single_left"), *(x for c in ("left_nodes", "right_nodes", "nodes") for x in (F.max(c).alias(f"largest_{c}"), F.sum(c).alias(f"total_{c}"))))
    return out.withColumns({f"largest_share_{c}": F.col(f"largest_{c}") / F.col(f"total_{c}") for c in ("left_nodes", "right_nodes", "nodes")})


def cluster_faults(members: DataFrame, member: str, cluster: str) -> DataFrame:
    """Members of more than one cluster; every representative is a member of its own."""
    whole = members.select(member, cluster).union(members.select(F.col(cluster).alias(member), cluster)).distinct()
    return contracts.duplicates(whole, [member])


def cluster_stats(members: DataFrame, cluster: str, historical: Column, future: Column) -> DataFrame:
    return members.groupBy(cluster).agg(F.count("*").alias("size"), F.count_if(historical).alias("historical_members"), F.count_if(future).alias("future_members"))


def best_hit(hits: DataFrame, key: str, other: str, identity: str) -> DataFrame:
    """The hit of the largest identity, the first other by text on a tie."""
    best = F.min_by(F.struct(other, identity), F.struct(-F.col(identity), F.col(other)))
    return hits.groupBy(key).agg(best.alias("_h")).select(key, f"_h.{other}", f"_h.{identity}")


def target_coldness(targets: DataFrame, key: str, historical: DataFrame, hits: DataFrame, clusters: DataFrame) -> DataFrame:
    """Ordered: seen in history, hit by alignment, in one cluster with history, cold. hits: key; clusters: key, cluster (of all targets)."""
    flag = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    old = clusters.join(historical.select(key).distinct(), key, "left_semi").select("cluster").distinct().withColumn("_c", F.lit(True))
    out = targets.select(key).distinct().join(flag(historical, "_h"), key, "left").join(flag(hits, "_d"), key, "left").join(clusters, key, "left").join(old, "cluster", "left")
    status = F.when(F.col("_h"), "future_target_accession_seen_in_historical_membership").when(F.col("_d"), "future_target_direct_historical_alignment_detected").when(F.col("_c"), "future_target_cluster_shares_historical_membership").otherwise("future_target_homology_cold_candidate")
    return out.select(key, status.alias("status"))


def scaffold_category(status: Column, key: Column, present: Column) -> Column:
    """An empty key is never a group."""
    s, k = F.lower(F.trim(F.coalesce(status, F.lit("")))), F.trim(F.coalesce(key, F.lit("")))
    return F.when(~present, "missing_scaffold_row").when((s == "ok") & (k != ""), "eligible_nonempty_scaffold").when(s.isin("invalid_smiles", "acyclic_or_empty_bemis_murcko"), s).when(s == "ok", "ok_status_but_empty_scaffold_key").when(s == "", "missing_scaffold_status").otherwise("unsupported_scaffold_status")


def scaffold_coldness(future: DataFrame, history: DataFrame, scaffolds: DataFrame, strict: bool = True) -> DataFrame:
    """Outcome of each future pair, ordered: pair in history, category, scaffold seen, coverage, cold.

    future, history: pair_key, entity; scaffolds: entity, scaffold, scaffold_status (one row each).
    """
    known = scaffolds.withColumn("_in", F.lit(True))
    tagged = lambda df: df.join(known, "entity", "left").withColumn("category", scaffold_category(F.col("scaffold_status"), F.col("scaffold"), F.coalesce("_in", F.lit(False)))).drop("_in")
    old = tagged(history)
    eligible = old.where("category = 'eligible_nonempty_scaffold'")
    seen = eligible.select("scaffold").distinct().withColumn("_seen", F.lit(True))
    full = old.agg((F.count_if(~F.col("category").isin("eligible_nonempty_scaffold", "acyclic_or_empty_bemis_murcko")) == 0).alias("_full"))
    pairs = history.select("pair_key").distinct().withColumn("_pair", F.lit(True))
    out = tagged(future).join(pairs, "pair_key", "left").join(seen, "scaffold", "left").crossJoin(F.broadcast(full))
    outcome = F.when(F.col("_pair"), "excluded_future_pair_also_observed_in_historical_table").when(F.col("category") != "eligible_nonempty_scaffold", F.concat(F.lit("excluded_future_"), F.col("category"))).when(F.col("_seen"), "not_scaffold_cold__scaffold_seen_in_eligible_historical_compounds").when(F.lit(strict) & ~F.col("_full"), "coldness_unresolved__historical_scaffold_coverage_incomplete").otherwise("eligible_scaffold_cold__scaffold_absent_from_historical_nonempty_groups")
    return out.select("pair_key", "entity", "category", outcome.alias("outcome"))


def scaffold_groups(history: DataFrame, future: DataFrame) -> DataFrame:
    """Entities and pairs of each scaffold on both sides. Both: scaffold, entity, pair_key."""
    side = lambda df, x: df.groupBy("scaffold").agg(F.count_distinct("entity").alias(f"{x}_entities"), F.count_distinct("pair_key").alias(f"{x}_pairs"))
    out = side(history, "historical").join(side(future, "future"), "scaffold", "full_outer").fillna(0)
    return out.withColumn("seen_in_history", F.col("historical_pairs") > 0)


def joint_coldness(rows: DataFrame, thresholds: list[str]) -> DataFrame:
    """Per threshold, whether a pair is cold in time, scaffold and target, or which of these failed, in this order.

    rows: pair_key, temporal_ok, temporal_reason, scaffold_ok, scaffold_reason, and homology_ok_<t>, homology_reason_<t>; a null flag is a missing row.
    """
    part = lambda ok, label, reason: F.when(~F.coalesce(ok, F.lit(False)), F.concat(F.lit(f"{label}:"), reason))
    cells = []
    for t in thresholds:
        homology = F.col(f"homology_ok_{t}")
        failed = F.array_compact(F.array(part(F.col("temporal_ok"), "temporal", F.col("temporal_reason")), part(F.col("scaffold_ok"), "scaffold", F.coalesce("scaffold_reason", F.lit("missing_scaffold_ledger_row"))), part(homology, f"homology_{t}", F.coalesce(f"homology_reason_{t}", F.lit("missing_mmseqs_target_audit_row")))))
        cells.append(F.struct(F.lit(t).alias("threshold"), (F.size(failed) == 0).alias("eligible"), F.coalesce(homology, F.lit(False)).alias("homology_cold"), F.when(F.size(failed) > 0, F.array_join(failed, "; ")).otherwise("eligible_observed_P1_candidate_only__temporal_future_plus_scaffold_cold_plus_homology_cold").alias("reason")))
    return rows.select("pair_key", F.explode(F.array(*cells)).alias("c")).select("pair_key", "c.*")
