"""Queries over the whole test tables, one for each operator here, and their DuckDB SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.llm import bpe, chat, decontam, hnsw, html_extract, langid, license_scan, line_dedup, warc
from lathework.llm.minhash import MinHashConfig, near_duplicates

#: The tokenizer file of the queries; the operator takes any path.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.license_scan(table(spark, sf_dir, "documents")))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.summary(bpe.bpe_encode(table(spark, sf_dir, "documents"), tokenizer_path()))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), MinHashConfig(shingle=2, percent=80))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.summary(line_dedup.line_dedup(table(spark, sf_dir, "documents")))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.embedding_near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(chat.PLANTED).alias("text"))
    return chat.read_back(chat.chat_windows(turns.unionByName(planted)))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.summary(decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_license_scan, op2_bpe, op3_html_extract, op4_minhash_near_dedup, op5_line_dedup, op6_embedding_near_dedup, op7_chat_format, op8_decontaminate, op9_warc, op10_language_id)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_scan.summary_sql(),
        "op5_line_dedup": line_dedup.summary_sql(),
        "op7_chat_format": chat.read_back_sql(),
        "op8_decontaminate": decontam.summary_sql(),
        "op9_warc": warc.round_trip_sql(),
    }
