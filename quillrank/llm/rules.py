"""Quality rules as a bitmask ledger, by DataFrame functions alone.

Every rule is evaluated once for each document; the ledger keeps the measurements and one bit for each rule that
fails. A policy is a mask of rules, by version: applying one, or telling what a rule alone removes, reads only bits.

Edge cases: a null or empty text has no words and fails the length rule; a text may have any length; lines without a
word are no duplicates; repeated rows get equal rows; an empty table gives an empty ledger and an ablation of zeros;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import WS

#: Name and SQL condition of failure, by bit; the first two are the contract's.
RULES = (
    ("short", "n_words < 50"),
    ("repetitive", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 4 * n_lines AND n_lines >= 5"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    ("exclaiming", "4 * n_exclamations > n_words"),
)
BASE = 0b11
#: Versions of the policy: the rules that count.
POLICIES = {"base": BASE, "v1": 0b111111}
CURRENT = "v1"


def words(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, f"{WS}+"))


def repeated_places(hashes: str) -> str:
    """SQL: the places, in order, of array elements that occur twice or more; n log n and without a shuffle."""
    ordered = f"sort_array(transform({hashes}, (h, i) -> struct(h, i)))"
    places = "sort_array(transform(filter(whole, (x, k) -> x.h = get(whole, k - 1).h OR x.h = get(whole, k + 1).h), x -> x.i))"
    # the array is bound by a lambda over a singleton, so that it is made once
    return f"element_at(transform(array({ordered}), whole -> {places}), 1)"


def ledger(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the measurements, failed (bits)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.select(F.col("doc_id"), text.alias("text"), words(F.col("text")).alias("w"), F.split(text, "\n", -1).alias("lines"))
    measured = counted.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit("")))).cast("long").alias("n_exclamations"),
        F.filter("lines", lambda x: x.rlike(f"[^{WS[1:]}")).alias("full"),
        F.when(F.size("w") < 4, F.array().cast("array<bigint>")).otherwise(F.expr("slice(transform(w, (x, i) -> xxhash64(x, get(w, i + 1), get(w, i + 2))), 1, greatest(size(w) - 2, 0))")).alias("windows"),
    )
    # most work ends here for texts without a repeated window
    told = measured.withColumn("places", F.expr(f"IF(size(array_distinct(windows)) = size(windows), CAST(array() AS ARRAY<INT>), {repeated_places('windows')})"))
    covered = F.expr("aggregate(transform(places, (p, k) -> least(3, coalesce(get(places, k + 1) - p, 3))), 0L, (a, x) -> a + x)")
    rows = told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_exclamations", F.size("full").cast("long").alias("n_lines"), (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"), covered.alias("n_repeat_words"))
    bits = " | ".join(f"IF({condition}, {1 << k}, 0)" for k, (_, condition) in enumerate(RULES))
    return rows.withColumn("failed", F.expr(bits).cast("int"))


def kept(mask: int) -> Column:
    """Whether a document passes all rules of a policy."""
    return F.col("failed").bitwiseAND(mask) == 0


def decide(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The contract's rows and the failure bits."""
    out = ledger(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("failed").bitwiseAND(BASE) != 0).alias("base_failed"), kept(POLICIES[policy] | BASE).alias("kept"), "failed")
    return out


def ablation(rows: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """One row per policy and rule of it: documents, kept by the policy, failing the rule, and removed by this rule alone.

    One pass over the bits, pre-aggregated by bit pattern: at most 2 to the number of rules rows are shuffled by task.
    """
    patterns = rows.groupBy("failed").agg(F.count("*").alias("n"))
    cells = F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(mask).alias("mask"), F.lit(RULES[k][0]).alias("rule"), F.lit(1 << k).alias("bit")) for p, mask in (policies or POLICIES).items() for k in range(len(RULES)) if mask >> k & 1))
    each = patterns.select("failed", "n", F.explode(cells).alias("c")).select("failed", "n", "c.*").withColumn("hit", F.col("failed").bitwiseAND(F.col("mask")))
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).alias
    return each.groupBy("policy", "rule", "bit").agg(F.sum("n").alias("documents"), total(F.col("hit") == 0)("kept"), total(F.col("hit").bitwiseAND(F.col("bit")) != 0)("failing"), total(F.col("hit") == F.col("bit"))("removed_alone"))


#: DuckDB SQL of the contract's rows.
SQL = r"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM base WHERE len(w) >= 3)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest([i, i + 1, i + 2]) AS i FROM twice) GROUP BY r),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM base) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
measured AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, length(text) - length(replace(text, '!', '')) AS n_exclamations,
    CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM base LEFT JOIN lines USING (r) LEFT JOIN covered c USING (r)),
judged AS (SELECT *, CAST(""" + " + ".join(f"CASE WHEN {c} THEN {1 << k} ELSE 0 END" for k, (_, c) in enumerate(RULES)) + r""" AS INTEGER) AS failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & """ + str(BASE) + " <> 0 AS base_failed, failed & " + str(POLICIES[CURRENT] | BASE) + " = 0 AS kept, failed FROM judged"
