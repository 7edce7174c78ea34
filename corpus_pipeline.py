"""The corpus pipeline: language ID, near-dedup, line dedup, decontamination, tokenization.

STAGES lists the stages in order. Each takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the
last return the columns of documents. Each stage's rows are written to the shared folder and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.llm import bpe, decontam, langid, line_dedup
from lathework.llm.common import new_path, passing_tables
from lathework.llm.minhash import MinHashConfig, near_duplicates
from lathework.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts, those without a letter or any known n-gram (score 0). The prediction becomes lang.

    Each row is judged by its own text, whatever its doc_id, so repeated rows stay or go alike; null labels teach nothing;
    whole texts are read; an empty table stays empty.
    """
    model = langid.train(docs.filter(~F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False))))
    found = langid.labelled(docs, model).filter((F.col("__lang") != "und") & (F.col("__score") > 0))
    return found.withColumn("lang", F.col("__lang")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id (five-word shingles, 0.8).

    Rows are judged by id and text. Rows that repeat both (null ids are equal here) are one document, of which one row stays;
    other rows without an id stay. A row goes for its own text only, not because another with its id does. Null and empty
    texts are near to nothing; an empty table stays empty.
    """
    marked = docs.withColumn("__mark", F.xxhash64("text"))
    found = near_duplicates(marked, MinHashConfig(shingle=5, percent=80), carry=("__mark",))
    gone = found.filter("not kept").select("doc_id", "__mark").distinct()
    # The ids outgrow a broadcast with the corpus, so they are hashed partition by partition at every size.
    kept = marked.join(gone.hint("shuffle_hash"), ["doc_id", "__mark"], "left_anti")
    return kept.dropDuplicates(["doc_id", "__mark"]).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stretches of whole lines or sentences of 20 words at least that stand earlier go from the text; n_chars follows.

    No row goes. Null and empty texts stay as they are; rows with a null or repeated doc_id are defined by the operator.
    """
    clean = line_dedup.line_dedup(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words (or the whole) of a benchmark item go.

    Each row is judged by its own text, whatever its doc_id; null and empty texts hold nothing; an empty table stays empty.
    """
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and their decoding, for every row left; a null text is an empty one, and whole texts are read."""
    coded = bpe.bpe_encode(docs, tokenizer_path())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("language_id", language_id), ("minhash_near_dedup", near_dedup), ("line_dedup", dedup_lines), ("decontaminate", decontaminate), ("bpe", tokenize)]
#: SQL can express neither the learned language filter nor BPE; tests/llm holds the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written for itself goes once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        with passing_tables(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
