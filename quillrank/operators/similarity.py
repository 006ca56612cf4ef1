"""Similarity joins through inverted indexes: only pairs with something in common are ever made, and with a threshold only those that can reach it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions import scalars as S


def gram_weights(texts: DataFrame, key: str, text: str, size: int = 3) -> DataFrame:
    """key, gram, weight: term counts by smoothed inverse document frequency, each key's weights of length 1."""
    c = F.col(text)
    grams = F.when(F.length(c) >= size, F.transform(F.sequence(F.lit(1), F.length(c) - size + 1), lambda i: F.substring(c, i, F.lit(size))))
    tf = texts.select(key, F.explode(grams).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("tf"))
    df = tf.groupBy("gram").agg(F.count("*").alias("df"))
    n = texts.agg(F.count("*").alias("n"))
    raw = tf.join(df, "gram").crossJoin(F.broadcast(n)).select(key, "gram", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("raw"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, key).select(key, "gram", (F.col("raw") / F.col("norm")).alias("weight"))


def cosine_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Pairs with a gram in common and their cosine, from unit weights."""
    l, r = left.select(left_key, "gram", F.col("weight").alias("_l")), right.select(right_key, "gram", F.col("weight").alias("_r"))
    return l.join(r, "gram").groupBy(left_key, right_key).agg(F.sum(F.col("_l") * F.col("_r")).alias("similarity"))


def tanimoto_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, bit: str = "bit") -> DataFrame:
    """Pairs with an on-bit in common and intersection over union of their bits (distinct rows of key and bit)."""
    l, r = left.select(left_key, bit), right.select(right_key, bit)
    na, nb = l.groupBy(left_key).agg(F.count("*").alias("_a")), r.groupBy(right_key).agg(F.count("*").alias("_b"))
    common = l.join(r, bit).groupBy(left_key, right_key).agg(F.count("*").alias("_i"))
    return common.join(na, left_key).join(nb, right_key).select(left_key, right_key, (F.col("_i") / (F.col("_a") + F.col("_b") - F.col("_i"))).alias("similarity"))


def word_tanimoto(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """For given pairs with bit sets in 64-bit words."""
    return pairs.withColumn("similarity", S.bit_overlap(F.col(a), F.col(b)))


def _ordered(rows: DataFrame, key: str, gram: str, weight: str, frequency: DataFrame) -> DataFrame:
    """Rows with _rest, the square of the length of what follows a gram, rare grams first: what a vector has from there on."""
    w = Window.partitionBy(key).orderBy(F.desc("_df"), F.desc(gram))
    return rows.join(frequency, gram).withColumn("_rest", F.sum(F.col(weight) * F.col(weight)).over(w))


def cosine_join_above(left: DataFrame, right: DataFrame, left_key: str, right_key: str, least: float) -> DataFrame:
    """Pairs with a cosine of ``least`` or more, from unit weights (key, gram, weight); the same as cosine_join cut at it.

    Grams are ordered by how many vectors hold them. The rest of a vector behind some gram, as long as it is shorter
    than ``least``, can't reach it with any vector of length 1; so a pair's first common gram lies before both rests, and
    only the grams there are joined. Frequent grams stand last: a gram that all names share is joined only where a
    name has little else. Equal vectors are joined as one and expanded last, so that copies make no pairs of candidates.
    """
    if not 0 < least <= 1:
        raise ValueError("a threshold in (0, 1] is needed")
    slim = lambda df, k: df.select(F.col(k).cast("string").alias("key"), "gram", "weight")
    same = F.to_json(F.transform("v", lambda x: F.struct(x["gram"], F.round(x["w"], 12))))  # equal up to the order of a sum
    group = lambda df: df.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("gram", F.col("weight").alias("w")))).alias("v")).select("key", "v", F.sha2(same, 256).alias("id"))
    sides = {}
    for name, df, k in (("l", left, left_key), ("r", right, right_key)):
        keyed = group(slim(df, k))
        sides[name] = (keyed.select(F.col("key").alias(f"_{name}k"), F.col("id").alias(f"_{name}")), keyed.dropDuplicates(["id"]).select("id", "v"))
    every = sides["l"][1].union(sides["r"][1]).dropDuplicates(["id"])
    frequency = every.select(F.explode("v.gram").alias("gram")).groupBy("gram").agg(F.count("*").alias("_df"))

    def prefix(name: str) -> DataFrame:
        rows = sides[name][1].select("id", F.explode("v").alias("e")).select("id", "e.gram", F.col("e.w").alias("weight"))
        # a little below the threshold: sums of rounded squares
        return _ordered(rows, "id", "gram", "weight", frequency).where(F.sqrt("_rest") >= least - 1e-6).select(F.col("id").alias(f"_{name}"), "gram")

    pairs = prefix("l").join(prefix("r"), "gram").select("_l", "_r").distinct()
    vectors = lambda name: sides[name][1].select(F.col("id").alias(f"_{name}"), F.col("v").alias(f"_v{name}"))
    met = pairs.join(vectors("l"), "_l").join(vectors("r"), "_r")
    held = F.map_from_arrays(F.col("_vr.gram"), F.col("_vr.w"))
    dot = F.aggregate(F.transform("_vl", lambda x: x["w"] * F.coalesce(F.try_element_at(held, x["gram"]), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    near = met.select("_l", "_r", dot.alias("similarity")).where(F.col("similarity") >= least - 1e-9)
    out = near.join(sides["l"][0], "_l").join(sides["r"][0], "_r")
    back = lambda c, df, k: F.col(c).cast(df.schema[k].dataType).alias(k)
    return out.select(back("_lk", left, left_key), back("_rk", right, right_key), "similarity")


def nearest(left: DataFrame, right: DataFrame, left_key: str, right_key: str, k: int, levels: Sequence[float] = (0.7, 0.4, 0.2), digits: int = 9) -> DataFrame:
    """The k nearest right keys of each left one by cosine (rounded; then by key), with place; the same as the first k of cosine_join.

    A left key that has k neighbours above a level is done: whatever lies below can't be among them. The others go on to
    the next level, and those that no level settles meet all vectors they share a gram with.
    """
    from quillrank.operators.graph import shared

    todo, found = left, []
    first = Window.partitionBy(left_key).orderBy(F.desc("similarity"), F.col(right_key))
    best = lambda pairs: pairs.withColumn("similarity", F.round("similarity", digits)).withColumn("place", F.row_number().over(first)).where(F.col("place") <= k)
    for level in levels:
        top = shared(best(cosine_join_above(todo, right, left_key, right_key, level)), "nearest")
        # a pair at the level itself may be one of more that rounding left out
        full = top.where((F.col("place") == k) & (F.col("similarity") > level + 10.0**-digits)).select(left_key)
        found.append(top.join(full, left_key, "left_semi"))
        todo = shared(todo.join(full, left_key, "left_anti"), "nearest-todo")
        if not todo.take(1):
            break
    else:
        found.append(best(cosine_join(todo, right, left_key, right_key)))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out.select(left_key, right_key, "similarity", "place")


def tanimoto_join_above(left: DataFrame, right: DataFrame, left_key: str, right_key: str, least: float, bit: str = "bit") -> DataFrame:
    """Pairs with a Tanimoto similarity of ``least`` or more; the same as tanimoto_join cut at it. Only the rarest n - ceil(least * n) + 1 bits of a set of n are joined, one of which two such sets share, and only sets of sizes that can reach it."""
    if not 0 < least <= 1:
        raise ValueError("a threshold in (0, 1] is needed")
    frequency = left.select(bit).union(right.select(bit)).groupBy(bit).agg(F.count("*").alias("_df"))

    def prefix(df: DataFrame, key: str, size: str) -> DataFrame:
        rows = df.select(key, bit).join(frequency, bit)
        w = Window.partitionBy(key)
        rows = rows.withColumns({size: F.count("*").over(w), "_place": F.row_number().over(w.orderBy("_df", bit))})
        return rows.where(F.col("_place") <= F.col(size) - F.ceil(F.col(size) * least - 1e-9) + 1).select(key, bit, size)

    fits = (F.col("_a") >= F.col("_b") * least - 1e-9) & (F.col("_b") >= F.col("_a") * least - 1e-9)
    pairs = prefix(left, left_key, "_a").join(prefix(right, right_key, "_b"), bit).where(fits).select(left_key, right_key, "_a", "_b").distinct()
    sets = lambda df, k, name: df.select(k, bit).groupBy(k).agg(F.collect_set(bit).alias(name))
    both = F.size(F.array_intersect("_x", "_y"))
    met = pairs.join(sets(left, left_key, "_x"), left_key).join(sets(right, right_key, "_y"), right_key)
    return met.select(left_key, right_key, (both / (F.col("_a") + F.col("_b") - both)).alias("similarity")).where(F.col("similarity") >= least)
