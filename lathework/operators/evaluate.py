"""Scores of predictions and logged metrics (O-A1 to O-A11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathework.functions import scalars as X


def is_correct(answer: Column | str, pred: Column | str, option: Column | str) -> Column:
    """Yes/no answers: the prediction starts with it, in any case. Others: it starts with the option's letter (in its case) or with the answer (in any case)."""
    a, p = F.lower(X.col(answer)), F.lower(X.col(pred))
    by_answer = p.startswith(a)
    return F.when(a.isin("yes", "no"), by_answer).otherwise(X.col(pred).startswith(X.col(option)) | by_answer)


def accuracy(rows: DataFrame, answer: str = "answer", pred: str = "pred", option: str = "correct_option") -> DataFrame:
    return rows.agg(F.coalesce(F.avg(is_correct(answer, pred, option).cast("double")), F.lit(0.0)).alias("accuracy"), F.count("*").alias("n"))


def judge_mean(rows: DataFrame, score: str = "gpt_score") -> DataFrame:
    """Mean in per cent and count of the judged rows; scores other than 0 and 1 are failures, and null is the mean of none."""
    good = F.when(F.col(score).isin(0, 1), F.col(score))
    return rows.agg((F.avg(good) * 100).alias("score"), F.count(good).alias("n"))


def duration_stats(rows: DataFrame, start: str, end: str) -> DataFrame:
    d = F.col(end) - F.col(start)
    return rows.agg(F.count("*").alias("n"), (F.sum(d) / 3600).alias("hours"), F.avg(d).alias("mean_seconds"))


def histogram(rows: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """bucket (from 1), n of equal widths between least and greatest; the last is closed on the right. One value: all in its middle bucket."""
    v = F.col(value).cast("double")
    bounds = rows.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    bucket = F.when(F.col("lo") == F.col("hi"), F.lit(bins // 2 + 1)).otherwise(F.least(F.floor((v - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))) + 1, F.lit(bins)))
    # The bounds are one row.
    return rows.filter(v.isNotNull()).join(F.broadcast(bounds)).groupBy(bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def mean_metrics(log: DataFrame) -> DataFrame:
    return log.groupBy("phase", "key").agg(F.avg("value").alias("mean"))


def mean_of_means(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The mean over groups of each group's mean."""
    return rows.groupBy(group).agg(F.avg(value).alias("m")).agg(F.avg("m").alias("mean_of_means"), F.count("*").alias("n_groups"))


def log_sum_exp(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, lse, by the greatest value first and then the scaled sum; partial results merge in any order."""
    top = rows.groupBy(*keys).agg(F.max(value).alias("top"))
    scaled = rows.join(top, keys).groupBy(*keys).agg(F.first("top").alias("top"), F.sum(F.exp(F.col(value) - F.col("top"))).alias("s"))
    return scaled.select(*keys, (F.col("top") + F.log("s")).alias("lse"))


def mask_lengths(rows: DataFrame, mask: str) -> DataFrame:
    """The greatest number of set places of a row's mask, and that of all rows. Running sums of a batch: scalars.starts_from_masks."""
    n = F.size(F.filter(F.col(mask), lambda x: x.cast("boolean")))
    return rows.agg(F.max(n).alias("max_seqlen"), F.sum(n).alias("total"))


def run_counts(wanted: DataFrame, done: DataFrame, keys: list[str], good: Column | str | None = None) -> DataFrame:
    """One row: total, processed (wanted keys that are done), remaining and successes (done rows that are good) of a run (O-A9)."""
    marked = done.select(*keys, (X.col(good).cast("boolean") if good is not None else F.lit(True)).alias("__good")).groupBy(*keys).agg(F.max("__good").alias("__good"))
    there = wanted.select(*keys).distinct().join(marked.withColumn("__done", F.lit(True)), keys, "left")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return there.agg(F.count("*").alias("total"), count(F.col("__done")).alias("processed"), (F.count("*") - count(F.col("__done"))).alias("remaining"), count(F.col("__good")).alias("successes"))
