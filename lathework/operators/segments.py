"""Segments of a score series, and transcripts joined to them by time (O-W1, O-J1 to O-J7, O-A6, O-F3, O-F10, O-P9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lathework.functions import scalars as X


def positive(score: Column | str, threshold: float) -> Column:
    """Strictly over the threshold; NaN, which Spark orders above all numbers, is not."""
    s = X.col(score)
    return F.coalesce((s > threshold) & ~F.isnan(s.cast("double")), F.lit(False))


def gap_tolerant_segments(frames: DataFrame, keys: list[str], time: str, score: str, threshold: float = 0.64, max_gap: int = 10, buffer: float = 0.0, order: list[str] | None = None) -> DataFrame:
    """keys, segment, start, end, n_positive: runs of positive frames with at most max_gap others between neighbours.

    One shuffle on the keys. Frames are numbered in time order; positives i < j share a run while j - i - 1 <= max_gap.
    Ends are widened by buffer and held within 0 and the last time.
    """
    w = Window.partitionBy(*keys).orderBy(*(order or [time]))
    numbered = frames.select(*keys, F.col(time).alias("t"), *[c for c in (order or []) if c not in keys and c != time], positive(score, threshold).alias("hit"), F.row_number().over(w).alias("n"))
    numbered = numbered.withColumn("last_t", F.max("t").over(Window.partitionBy(*keys)))
    along = Window.partitionBy(*keys).orderBy("n")
    hits = numbered.filter("hit").withColumn("opens", F.coalesce((F.col("n") - F.lag("n").over(along) - 1 > max_gap).cast("int"), F.lit(1)))
    hits = hits.withColumn("segment", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    runs = hits.groupBy(*keys, "segment").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n_positive"), F.first("last_t").alias("last_t"))
    if buffer:
        runs = runs.withColumn("start", F.greatest(F.col("start") - buffer, F.lit(0.0))).withColumn("end", F.least(F.col("end") + buffer, F.col("last_t")))
    return runs.drop("last_t")


def fill_word_times(words: DataFrame, start: str = "ws", end: str = "we", width: float = 0.01) -> DataFrame:
    """Words with neither time go; a missing one is set `width` beside the other."""
    known = words.filter(F.col(start).isNotNull() | F.col(end).isNotNull())
    return known.withColumns({start: F.coalesce(F.col(start), F.col(end) - width), end: F.coalesce(F.col(end), F.col(start) + width)})


def words_in_segments(segments: DataFrame, words: DataFrame, keys: list[str], seg: tuple[str, str] = ("start", "end"), word: tuple[str, str] = ("ws", "we"), contained: bool = False, bucket: float | None = 60.0) -> DataFrame:
    """Inner join of words to segments of the same keys: a word's start or end lies in the segment (start inclusive and end
    exclusive for starts, the other way for ends), or with `contained` both ends lie in it, both inclusive.

    Series are cut into time buckets of `bucket` seconds that join the equi key, so a long series is no hot key; a bucket of
    about a segment's length is best. None joins on the keys alone, for short series.
    """
    (s, e), (ws, we) = (map(F.col, seg)), (map(F.col, word))
    inside = ((ws >= s) & (ws <= e) & (we >= s) & (we <= e)) if contained else (((ws >= s) & (ws < e)) | ((we > s) & (we <= e)))
    if bucket is None:
        return segments.join(words, keys).filter(inside)
    cell = lambda x: F.floor(x / bucket).cast("long")
    spread = segments.withColumn("__cell", F.explode(F.sequence(cell(s), cell(e))))
    # A word goes to its start's cell, and to its end's if that is another one and the start lies in no cell of the segment.
    cells = words.withColumn("__cell", F.explode(F.array_distinct(F.array(cell(ws), cell(we)))))
    once = F.when(cell(ws) >= cell(s), F.col("__cell") == cell(ws)).otherwise(F.col("__cell") == cell(we))
    return spread.join(cells, [*keys, "__cell"]).filter(inside & once).drop("__cell")


def caption_segments(matched: DataFrame, by: list[str], text: str = "text", position: str = "pos", carry: list[str] | None = None, count: str | None = None) -> DataFrame:
    """by, caption: the words of each segment in order, joined by one space and stripped; count names a column of how many they are."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(text).alias("t")))), lambda x: x["t"]), " ")
    return matched.groupBy(*by).agg(X.strip(joined).alias("caption"), *(F.first(c).alias(c) for c in carry or []), *([F.count("*").alias(count)] if count else []))


def pending(videos: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What isn't done yet."""
    return videos.join(done.select(*keys).distinct(), keys, "left_anti")


def scored_not_transcribed(videos: DataFrame, scored: DataFrame, transcribed: DataFrame, keys: list[str]) -> DataFrame:
    return pending(videos.join(scored.select(*keys).distinct(), keys, "left_semi"), transcribed, keys)


def match_sources(examples: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """Each example with a status: Success, or Warning where its source file is missing (O-J7, O-K5)."""
    there = listing.select(key).distinct().withColumn("__there", F.lit(True))
    status = F.when(F.col("__there"), F.lit("Success")).otherwise(F.concat(F.lit("Warning: no source for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return examples.join(there, key, "left").withColumn("status", status).drop("__there")
