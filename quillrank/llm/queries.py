"""The query opN_<name> of each operator: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillrank.llm import ngramjoin

    return ngramjoin.similar(_documents(spark, sf_dir))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillrank.llm import media

    return media.digest(media.decode(media.encode(_documents(spark, sf_dir))))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillrank.llm import linededup

    return linededup.dedup(_documents(spark, sf_dir))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillrank.llm import pii

    return pii.find(_documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quillrank.llm import packing

    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillrank.llm import toxicity

    return toxicity.score(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillrank.llm import rules

    return rules.decide(_documents(spark, sf_dir))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillrank.llm import quality

    return quality.score(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillrank.llm import langid

    return langid.identify(_documents(spark, sf_dir))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillrank.llm import mixing

    return mixing.mix(_documents(spark, sf_dir))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillrank.llm import spelling

    return spelling.forms(spelling.word_counts(_documents(spark, sf_dir)))


def op12_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quillrank.llm import subwords

    return subwords.digest(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op13_rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillrank.llm import rolling

    return rolling.outliers(spark.read.parquet(f"{sf_dir}/clicks.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from quillrank.llm import linededup, mixing, rolling, rules, spelling

    return {"op4_line_dedup": linededup.SQL, "op7_quality_rules": rules.SQL, "op10_source_mixing": mixing.SQL, "op11_spelling_variants": spelling.SQL, "op13_rolling_median": rolling.SQL}
