"""Structured Streaming forms: sessions of positive frames, and incremental runs over new files (survey §2.14)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lathework.operators.segments import positive

#: On a complete grid of half-second frames, a gap of 10 frames between positives is this pause; sessions merge at equality.
GAP = "5500 milliseconds"


def stream_segments(frames: DataFrame, key: str, time: str, score: str, threshold: float = 0.64, gap: str = GAP, late: str = "1 minute") -> DataFrame:
    """key, start, end, n_positive of gap-tolerant segments, each given once its session can't grow any more."""
    hits = frames.filter(positive(score, threshold)).withWatermark(time, late)
    runs = hits.groupBy(key, F.session_window(time, gap).alias("s")).agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n_positive"))
    return runs.select(key, "start", "end", "n_positive")


def stream_segments_by_frames(frames: DataFrame, key: str, time: str, score: str, threshold: float = 0.64, max_gap: int = 10, late: str = "1 minute", idle: str = "10 minutes") -> DataFrame:
    """key, start, end, n_positive of gap-tolerant segments as in the batch form, on any grid: gaps are counted in frames, in state.

    A segment is given once more than max_gap frames without a hit have followed, or once its series has been idle for so
    long by the watermark. Frames of a series must arrive in time order from batch to batch; one that comes before a frame
    already taken is left out. The state of a series is five numbers.
    """
    rows = frames.select(F.col(key).alias("k"), F.col(time).alias("t"), positive(score, threshold).alias("hit")).withWatermark("t", late)
    rest = int(pd.Timedelta(idle).total_seconds() * 1000)
    names = ["k", "start", "end", "n_positive"]

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        none = pd.Timestamp(0)
        start, end, n, misses, last = state.get if state.exists else (none, none, 0, 0, none)
        done = []
        if state.hasTimedOut:
            done = [(*group, start, end, n)] if n else []
            state.remove()
            yield pd.DataFrame(done, columns=names)
            return
        for t, hit in sorted(x for part in parts for x in zip(part["t"], part["hit"])):
            if t <= last:
                continue
            last = t
            if hit:
                start, end, n, misses = (start, t, n + 1, 0) if n else (t, t, 1, 0)
            elif n:
                misses += 1
                if misses > max_gap:
                    done.append((*group, start, end, n))
                    n = 0
        state.update((start, end, n, misses, last))
        state.setTimeoutTimestamp(max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs()) + rest)
        yield pd.DataFrame(done, columns=names)

    kind = rows.schema["k"].dataType.simpleString()
    found = rows.groupBy("k").applyInPandasWithState(step, f"k {kind}, start timestamp, end timestamp, n_positive long", "start timestamp, end timestamp, n long, misses long, last timestamp", "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumnRenamed("k", key)


def run_incrementally(spark: SparkSession, source: str, schema: str, checkpoint: str, out: str, process: Callable[[DataFrame], DataFrame], key: str, file_format: str = "json") -> StreamingQuery:
    """Process the files that came since the last run and append the results, leaving out keys that are there already."""

    def batch(df: DataFrame, _: int) -> None:
        fresh = process(df)
        try:
            done = spark.read.parquet(out).select(key).distinct()
        except Exception as error:  # no result yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            done = None
        (fresh if done is None else fresh.join(done, key, "left_anti")).write.mode("append").parquet(out)

    stream = spark.readStream.schema(schema).format(file_format).load(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
