"""Line dedup over levelled sorted runs, by DataFrame functions alone.

``LineRuns`` keeps what earlier batches held as sorted runs of line hashes, bucketed alike, so that a batch and a run
meet in a merge join without a new exchange. Each new batch is anti-joined with the runs: lines met for the first time
become a run of level 0, lines met again go to the repeats with their counts. When a level has ``FANOUT`` runs they are
merged into one run of the next level, so that there are logarithmically many. Keys are unique over all runs.

A line's key is its text without white space at both ends, A-Z in lower case; two hashes (64 and 32 bits) stand for it.

``repeated`` feeds documents to the runs in batches by a hash of doc_id and returns the keys that enough documents
hold; ``without`` drops their lines except in the largest doc_id. Counting comes first over single documents, so a
line that a third of all documents hold is never gathered in one task.

Edge cases: a text of many lines takes work in proportion to them; a null or empty text is one empty line; keys shorter than ``LEAST`` code points are never dropped; rows
that share a doc_id count as one document; null doc_ids count as one document that is smaller than any other; an empty
table gives an empty result; other columns are kept by ``without`` and may not begin with ``_line_``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm.common import discard, shared_dir, written

#: Code points of a key that counts, documents that must hold it.
LEAST, DOCUMENTS = 40, 5
#: Batches that a table is fed in, runs of a level that are merged.
BATCHES, FANOUT = 4, 2
#: A key is broadcast from so small a share of all rows on.
HOT = 4096
#: A document with more keys to drop than this is worked off line by line.
FEW = 32
WHOLE = "array<struct<id: string, n: int, text: string>>"
KEY = ["h1", "h2"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = -(2**63)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), _UPPER, _LOWER)


def hashes_of(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.hash(key).alias("h2"))


def hashed(line: Column) -> Column:
    """The hashes of a line's key, null where it is too short to count."""
    key = key_of(line)
    return F.when(F.length(key) >= LEAST, hashes_of(key))


class LineRuns:
    """The runs and repeats, as bucketed tables in the shared folder; state is kept by table names alone."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.fanout, self.name = spark, fanout, f"line_runs_{uuid.uuid4().hex}"
        self.buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.levels: list[list[str]] = []
        self.repeats: list[str] = []
        self.made = 0

    def _save(self, rows: DataFrame) -> str:
        """One sorted file per bucket: rows come hashed by the key into as many partitions."""
        self.made += 1
        table = f"{self.name}_{self.made}"
        rows.repartition(self.buckets, *KEY).write.option("path", self._path(table)).bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(table)
        return table

    def _path(self, table: str) -> str:
        return f"{shared_dir(self.spark).rstrip('/')}/{table}"

    def _drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE {table}")
        discard(self.spark, self._path(table))

    def close(self) -> None:
        """Drops all tables; what counts gave must have been written."""
        for table in [t for level in self.levels for t in level] + self.repeats:
            self._drop(table)
        self.levels, self.repeats = [], []

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def add(self, batch: DataFrame) -> None:
        """batch: doc, h1, h2 without repeated rows; no document may come in two batches."""
        sums = batch.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("doc").alias("top"))
        entry = self._save(sums)
        fresh = self.spark.table(entry)
        again = None
        for run in self.runs():
            run = run.select(*KEY)
            met = fresh.join(run, KEY, "left_semi")
            again = met if again is None else again.unionByName(met)
            fresh = fresh.join(run, KEY, "left_anti")
        if again is None:
            self._level(0, entry)
            return
        self.repeats.append(self._save(again))
        self._level(0, self._save(fresh))
        self._drop(entry)

    def _level(self, k: int, table: str) -> None:
        if len(self.levels) == k:
            self.levels.append([])
        self.levels[k].append(table)
        if len(self.levels[k]) >= self.fanout:
            old, self.levels[k] = self.levels[k], []
            merged = self.spark.table(old[0])
            for t in old[1:]:
                merged = merged.unionByName(self.spark.table(t))
            self._level(k + 1, self._save(merged))
            for t in old:
                self._drop(t)

    def counts(self, least: int) -> DataFrame:
        """h1, h2, n, top of the keys that at least so many documents hold."""
        parts = [r.where(F.col("n") >= least) for r in self.runs()]
        if self.repeats:
            # keys met again need their first sighting too, wherever it lies
            again = self.spark.table(self.repeats[0])
            for t in self.repeats[1:]:
                again = again.unionByName(self.spark.table(t))
            again = again.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("top").alias("top"))
            parts = [again] + [r.where(F.col("n") >= least).unionByName(r.where(F.col("n") < least).join(again.select(*KEY), KEY, "left_semi")) for r in self.runs()]
        if not parts:
            return self.spark.createDataFrame([], "h1 long, h2 int, n long, top long")
        total = parts[0]
        for p in parts[1:]:
            total = total.unionByName(p)
        return total.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("top").alias("top")).where(F.col("n") >= least)


def repeated(docs: DataFrame, batches: int = BATCHES, least: int = DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """The keys that at least ``least`` documents hold (h1, h2, n, top), and the table of all (doc, h1, h2) long enough to count."""
    spark = docs.sparkSession
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    # distinct as texts, which Spark hashes; structs it compares each with each
    keys = F.array_distinct(F.filter(F.transform(lines_of(F.col("text")), key_of), lambda x: F.length(x) >= LEAST))
    held = docs.select(doc.alias("doc"), F.explode(F.transform(keys, hashes_of)).alias("k"))
    slim = written(held.select("doc", "k.h1", "k.h2", F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int").alias("batch")), "line-keys")
    runs = LineRuns(spark)
    for b in range(batches):
        runs.add(slim.where(F.col("batch") == b).select("doc", *KEY).distinct())
    common = written(runs.counts(least), "line-repeated")
    runs.close()
    return common, slim.select("doc", *KEY)


def without(docs: DataFrame) -> DataFrame:
    """docs with text cut to the lines that stay, _line_n (lines before) and _line_dropped."""
    common, slim = repeated(docs)
    # keys that a HOT-th part of all rows holds are HOT at most, so they are broadcast; no other key makes a large task
    frequent = F.col("n") * HOT >= slim.count()
    hot = F.broadcast(common.where(frequent).select(*KEY, "top"))
    held = slim.join(hot, KEY).unionByName(slim.join(hot.select(*KEY), KEY, "left_anti").join(common.where(~frequent).select(*KEY, "top"), KEY))
    marks = written(held.where(F.col("doc") < F.col("top")).groupBy("doc").agg(F.collect_set(F.struct(*KEY)).alias("_line_drop")), "line-marks")
    few = marks.where(F.size("_line_drop") <= FEW).withColumn("_line_whole", F.lit(None).cast(WHOLE))
    many = written(marks.where(F.size("_line_drop") > FEW), "line-many")  # a table of its own, so that its size is known
    if many.take(1):
        few = few.unionByName(_by_lines(docs, many).withColumn("_line_drop", F.lit(None).cast(marks.schema["_line_drop"].dataType)))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    # marks grow with the documents: one plan at every size
    joined = docs.withColumn("_line_doc", doc).join(few.withColumnRenamed("doc", "_line_doc").hint("merge"), "_line_doc", "left")
    lines = lines_of(F.col("text"))
    stay = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("_line_drop"), hashed(x)), F.lit(False)))
    own = F.filter("_line_whole", lambda x: x["id"] == text_id(F.col("text")))[0]
    split = joined.withColumns({"_line_n": F.size(lines).cast("long"), "_line_own": own, "_line_stay": F.when(F.col("_line_drop").isNull(), lines).otherwise(stay)})
    whole = F.col("_line_own").isNotNull()
    dropped = F.col("_line_n") - F.when(whole, F.col("_line_own.n")).otherwise(F.size("_line_stay"))
    out = split.withColumns({"_line_dropped": dropped, "text": F.when(whole, F.col("_line_own.text")).otherwise(F.array_join("_line_stay", "\n"))})
    return out.select(*docs.columns, "_line_n", "_line_dropped")


def text_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _by_lines(docs: DataFrame, many: DataFrame) -> DataFrame:
    """For documents with many keys to drop: doc and _line_whole, for each of its texts id, lines that stay and these joined. Lines are rows here and are anti-joined, so work is in proportion to lines."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc")
    texts = docs.select(doc, "text").join(many.select("doc"), "doc", "left_semi").withColumn("id", text_id(F.col("text"))).dropDuplicates(["doc", "id"])
    rows = texts.select("doc", "id", F.posexplode(lines_of(F.col("text"))).alias("at", "line")).withColumn("k", hashed(F.col("line")))
    gone = many.select("doc", F.explode("_line_drop").alias("d")).select("doc", F.col("d.h1").alias("_d1"), F.col("d.h2").alias("_d2"))
    left = rows.join(gone, (rows["doc"] == gone["doc"]) & (F.col("k.h1") == F.col("_d1")) & (F.col("k.h2") == F.col("_d2")), "left_anti")
    kept = left.groupBy("doc", "id").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("stay"))
    whole = texts.select("doc", "id").join(kept, ["doc", "id"], "left").select("doc", F.struct("id", F.coalesce(F.size("stay"), F.lit(0)).alias("n"), F.coalesce(F.array_join(F.col("stay.line"), "\n"), F.lit("")).alias("text")).alias("w"))
    return whole.groupBy("doc").agg(F.collect_list("w").alias("_line_whole"))


def dedup(docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    out = without(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("_line_n").alias("n_lines"), F.col("_line_dropped").cast("long").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents without their repeated lines: text and n_chars are of the lines that stay; no document goes."""
    out = without(docs)
    counted = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return out.withColumns(counted).select(docs.columns)


#: DuckDB SQL of the contract's rows.
SQL = rf"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM base),
keyed AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), '{_UPPER}', '{_LOWER}') AS key FROM each),
common AS (SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= {LEAST} GROUP BY key HAVING count(DISTINCT doc_id) >= {DOCUMENTS}),
judged AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id < c.top AS goes FROM keyed k LEFT JOIN common c USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT goes), '')) AS kept_sha256
FROM judged GROUP BY r
"""
