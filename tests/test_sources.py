import gzip

import pytest
from pyspark.sql import functions as F

from quillrank.operators.contracts import ContractError
from quillrank.sources import sinks, tables


def test_delimited_keeps_na_and_blanks(spark, tmp_path):
    path = tmp_path / "t.tsv.gz"
    with gzip.open(path, "wt") as f:
        f.write("k\tv\na\tNA\nb\t\n")
    df = tables.delimited(spark, str(path), ["k", "v"])
    assert [tuple(r) for r in df.orderBy("k").collect()] == [("a", "NA"), ("b", "")]
    with pytest.raises(ContractError):
        tables.delimited(spark, str(path), ["absent"])
    assert tables.choose_column(df, ["x", "v"], "value") == "v"


def test_fasta_dialects(spark, tmp_path):
    (tmp_path / "s.fa").write_text(">sp|P1|NAME x\nac\ngt\n>P2|y\nAA\n>P3 z\nCC\n")
    assert {tuple(r) for r in tables.fasta(spark, str(tmp_path / "s.fa")).collect()} == {("P1", "ACGT"), ("P2", "AA"), ("P3", "CC")}


def test_source_rows_and_json(spark):
    df = spark.range(100).select((99 - F.col("id")).alias("k"))
    assert [(r.k, r.source_row) for r in tables.with_source_rows(df, ["k"]).orderBy("k").collect()] == [(k, k + 2) for k in range(100)]
    req, got = spark.createDataFrame([("1",), ("2",)], "id string"), spark.createDataFrame([("1", '{"a": "x"}')], "id string, j string")
    assert {tuple(r) for r in tables.json_records(req, got, "id", "j", "a string, b string").collect()} == {("1", True, "x", ""), ("2", False, "", "")}


def test_sinks_refuse(spark, tmp_path):
    df = spark.createDataFrame([("b", 0.1), ("a", None)], "k string, v double")
    sinks.write_table(df, str(tmp_path / "o"), ["k"], ["k", "v"], kind="tsv")
    with pytest.raises(Exception):
        sinks.write_table(df, str(tmp_path / "o"), ["k"], ["k", "v"], kind="tsv")
    with pytest.raises(ContractError):
        sinks.write_aggregates(df.withColumn("smiles", F.lit("C")), str(tmp_path / "p"), ["k"])
    assert sinks.content_hash(df) == sinks.content_hash(df.orderBy("k")) != sinks.content_hash(df.limit(1))
    sinks.write_summary({"b": 1, "a": 2}, str(tmp_path / "s.json"))
    with pytest.raises(FileExistsError):
        sinks.write_summary({}, str(tmp_path / "s.json"))


def test_fasta_signs_inside_lines(spark, tmp_path):
    (tmp_path / "s.fa").write_text("\n>sp|P1|X foo->bar\r\nac>\r\ngt\r\n>P2|y>z\n>P3 > q\nCC\n")
    assert {tuple(r) for r in tables.fasta(spark, str(tmp_path / "s.fa")).collect()} == {("P1", "AC>GT"), ("P2", ""), ("P3", "CC")}


def test_tables_are_created_once_or_not_at_all(spark, tmp_path):
    df = spark.range(50).select(F.col("id").alias("k"))
    sinks.create_once(df, str(tmp_path / "whole"), ["k"], rows=50)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "whole")).collect()) == list(range(50))
    with pytest.raises(FileExistsError):
        sinks.create_once(df, str(tmp_path / "whole"), ["k"])
    with pytest.raises(ContractError):
        sinks.create_once(df, str(tmp_path / "short"), ["k"], rows=51)
    broken = df.select(F.when(F.col("k") == 30, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("k")).alias("k"))
    with pytest.raises(Exception):
        sinks.create_once(broken, str(tmp_path / "broken"), ["k"])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["whole"]


def test_digests_are_streamed(spark, tmp_path):
    import hashlib

    (tmp_path / "a").write_bytes(b"x" * 300_001)
    (tmp_path / "b").write_bytes(b"")
    files = {n: str(tmp_path / n) for n in "ab"}
    want = {n: {"sha256": hashlib.sha256((tmp_path / n).read_bytes()).hexdigest(), "bytes": (tmp_path / n).stat().st_size} for n in "ab"}
    assert sinks.digests(spark, files) == sinks.manifest(files) == want
