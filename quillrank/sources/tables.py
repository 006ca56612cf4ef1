"""Readers: delimited text, sequences, databases, JSON responses. All go through Spark's readers; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank.operators.contracts import ContractError, require_columns
from quillrank.operators.graph import shared


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """Tab or comma, whichever the first line has more of; tab on a tie."""
    line = (spark.read.text(path).first() or [""])[0]
    return "," if line.count(",") > line.count("\t") else "\t"


def delimited(spark: SparkSession, path: str, required: list[str] | None = None, sep: str | None = None) -> DataFrame:
    """A table with a header, plain or gzip, as text; blanks are empty texts and "NA" stays as it is."""
    sep = sep or sniff_delimiter(spark, path)
    df = spark.read.options(sep=sep, header=True, inferSchema=False, nullValue="\u0000", emptyValue="", quote='"', escape='"').csv(path)
    return require_columns(df.na.fill(""), required or [])


def headerless(spark: SparkSession, path: str, schema: T.StructType, sep: str = "\t", comment: str = "#") -> DataFrame:
    return spark.read.options(sep=sep, header=False, comment=comment).schema(schema).csv(path)


def choose_column(df: DataFrame, names: list[str], role: str) -> str:
    """The first of several names that the table has."""
    for n in names:
        if n in df.columns:
            return n
    raise ContractError(f"no column for {role} among {df.columns}; tried {names}")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """accession and sequence of each record; headers ``sp|ACC|..``, ``ACC|..`` or a bare token. Blank sequences and repeated accessions raise on use of contracts.duplicates."""
    # a record begins where a line does; a file's first has its sign still
    raw = spark.read.option("lineSep", "\n>").text(path)
    records = raw.select(F.regexp_replace("value", r"^\s*>", "").alias("value")).where(F.trim("value") != "")
    head = F.trim(F.substring_index("value", "\n", 1))
    token = F.split(head, r"\s+")[0]
    parts = F.split(token, r"\|")
    accession = F.when(F.lower(parts[0]).isin("sp", "tr") & (F.size(parts) > 1), F.get(parts, F.lit(1))).otherwise(parts[0])
    body = F.expr("substring(value, instr(value, '\n') + 1)")
    return records.select(accession.alias("accession"), F.upper(F.regexp_replace(F.when(F.col("value").contains("\n"), body).otherwise(""), r"\s+", "")).alias("sequence"))


def database(spark: SparkSession, url: str, table: str, columns: list[str], **options: str) -> DataFrame:
    """Columns of a database table through JDBC; filters on the result reach the database. Partition large tables by the reader's options."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().select(*columns)


def matching(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose key is wanted; the planner picks the join by the keys' size."""
    return df.join(keys.select(column).distinct(), column, "left_semi")


def with_source_rows(df: DataFrame, order: list[str], name: str = "source_row") -> DataFrame:
    """Numbers rows from 2 (a header is row 1) in a total order of columns, by ranges: counts of earlier ranges plus the place in one.

    Spark keeps no line numbers, so the order must be told.
    """
    # written once, so that counts and rows see the same ranges
    ranged = shared(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "source-rows")
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    ahead = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.withColumn("_i", place).join(F.broadcast(ahead), "_p").withColumn(name, F.col("_before") + F.col("_i") + 1).drop("_p", "_i", "_before")


def json_records(requested: DataFrame, payloads: DataFrame, key: str, column: str, schema: str) -> DataFrame:
    """One row per requested key with the fields of its JSON answer; fields and answers that are missing are blank."""
    parsed = payloads.select(key, F.from_json(column, schema).alias("_j"))
    out = requested.select(key).distinct().join(parsed, key, "left")
    names = [f.name for f in T._parse_datatype_string(schema).fields] if isinstance(schema, str) else schema.fieldNames()
    return out.select(key, F.col("_j").isNotNull().alias("found"), *(F.coalesce(F.col(f"_j.{n}").cast("string"), F.lit("")).alias(n) for n in names))


