"""Writers that never overwrite, and checks of what may be written."""

from __future__ import annotations

import hashlib
import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.operators import contracts

# Columns that identify a row (as does any that ends in _ids), and texts that hold an identifier.
FORBIDDEN = ("canonical_pair_key", "inchikey_full", "pair_key", "pmid", "query_compound_inchikey_full", "query_id", "rank_vector", "ref_id", "score_vector", "smiles", "source_document_id", "target_uniprot_accession", "uniprot_canonical_accession")
IDENTIFIER = r"\b[A-Z]{14}-[A-Z]{10}-[A-Z]\b"


def write_table(df: DataFrame, path: str, keys: list[str], columns: list[str] | None = None, kind: str = "parquet") -> None:
    """Creates a table sorted by key; an existing one is an error. Columns must be exactly those named."""
    if columns is not None and sorted(df.columns) != sorted(columns):
        raise contracts.ContractError(f"columns {df.columns}, expected {columns}")
    out = df.orderBy(*keys).write.mode("errorifexists")
    if kind == "tsv":
        text = {c: F.coalesce(F.format_string("%.17g", c) if t in ("double", "float") else F.col(c).cast("string"), F.lit("")) for c, t in df.dtypes}
        df.orderBy(*keys).select(*(text[c].alias(c) for c in (columns or df.columns))).write.mode("errorifexists").options(sep="\t", header=True, compression="gzip", emptyValue="").csv(path)
    else:
        out.format(kind).save(path)


def _hadoop(spark: SparkSession, path: str) -> tuple:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def create_once(df: DataFrame, path: str, keys: list[str], kind: str = "parquet", rows: int | None = None) -> None:
    """Creates a sorted table that is seen whole or not at all: written beside its place, read back and counted, then renamed. An existing path is an error; what a failed write left is deleted.

    rows: how many there must be. Works on any file system that Hadoop knows.
    """
    spark = df.sparkSession
    place, fs = _hadoop(spark, path)
    if fs.exists(place):
        raise FileExistsError(path)
    beside, _ = _hadoop(spark, f"{path.rstrip('/')}.unfinished-{uuid.uuid4().hex}")
    try:
        df.orderBy(*keys).write.format(kind).mode("errorifexists").save(beside.toString())
        back = spark.read.format(kind).schema(df.schema).load(beside.toString())
        if rows is not None and (found := back.count()) != rows:
            raise contracts.ContractError(f"{found} rows written, {rows} expected")
        if fs.exists(place) or not fs.rename(beside, place):
            raise FileExistsError(path)
    finally:
        fs.delete(beside, True)


def digests(spark: SparkSession, files: dict[str, str]) -> dict[str, dict]:
    """Role to SHA-256 and bytes of files on any file system that Hadoop knows, streamed through a digest of constant memory in the JVM."""
    jvm, out = spark.sparkContext._jvm, {}
    for role, path in files.items():
        place, fs = _hadoop(spark, path)
        digest = jvm.java.security.MessageDigest.getInstance("SHA-256")
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(fs.open(place), jvm.java.security.DigestOutputStream(jvm.java.io.OutputStream.nullOutputStream(), digest), 1 << 16, True)
        out[role] = {"sha256": bytes(b & 255 for b in digest.digest()).hex(), "bytes": fs.getFileStatus(place).getLen()}
    return out


def write_aggregates(df: DataFrame, path: str, keys: list[str], kind: str = "parquet") -> None:
    """The same, for tables that may tell nothing of single rows."""
    contracts.require(contracts.identifying(df, FORBIDDEN, IDENTIFIER), "identifiers in an aggregate table")
    write_table(df, path, keys, kind=kind)


def write_summary(values: dict, path: str) -> None:
    """A JSON object with sorted keys, created once, on the driver."""
    with open(path, "x", encoding="utf-8") as f:
        json.dump(values, f, sort_keys=True, indent=2, ensure_ascii=False)
        f.write("\n")


def manifest(files: dict[str, str]) -> dict[str, dict]:
    """Role to SHA-256 and bytes of local input files, read in chunks."""
    out = {}
    for role, path in files.items():
        digest = hashlib.sha256()
        with open(path, "rb") as f:
            while chunk := f.read(1 << 20):
                digest.update(chunk)
        out[role] = {"sha256": digest.hexdigest(), "bytes": Path(path).stat().st_size}
    return out


def require_manifest(files: dict[str, str], expected: dict[str, dict]) -> None:
    if (found := manifest(files)) != expected:
        raise contracts.ContractError(f"inputs differ from the manifest: {sorted(k for k in found.keys() | expected.keys() if found.get(k) != expected.get(k))}")


def content_hash(df: DataFrame) -> str:
    """A hash of a table's rows that order and files don't change: sums of two 64-bit row hashes, and the count."""
    row = F.struct(*sorted(df.columns))
    sums = df.agg(F.count("*").alias("n"), *(F.sum(F.xxhash64(F.lit(k), row).cast("decimal(38,0)")).alias(f"h{k}") for k in (1, 2))).first()
    return hashlib.sha256(json.dumps([str(x) for x in sums]).encode()).hexdigest()
