"""Pieces shared by the training-data operators: the shared work folder and byte-level text helpers."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.sources.store import shared_folder

#: A-Z to a-z and nothing else, for `bytes.translate`.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
UPPER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Texts are handled in slices of about this many bytes, so a worker's memory follows the slice and not the Arrow batch.
SLICE_BYTES = 2 << 20


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _kept:
        paths.append(path)
    return path


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_kept: list[list[str]] = []


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables and files written inside go at the end; what is to stay must be written outside by then."""
    paths: list[str] = []
    _kept.append(paths)
    try:
        yield
    finally:
        _kept.remove(paths)
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Shared:
    """A broadcast of any object, with its class by value, as workers need not have this package. Callers bound its size."""

    def __init__(self, spark: SparkSession, value: object):
        self.data = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get(self):
        return pickle.loads(self.data.value)


def lowered(text) -> object:
    """A-Z to lower case, other letters as they are."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER_AZ, UPPER_AZ.lower())


def text_runs(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(index of the first text, texts) in runs of about `limit` bytes, so that what a batch becomes in Python follows the run and not the batch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(column):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield start, column.slice(start, stop - start)
        start = stop


def slices(texts: pa.Array | list[str | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, lower-cased UTF-8 texts) in runs of about `limit` bytes; null reads as empty."""
    if isinstance(texts, list):
        texts = pa.array([None if t is None else t.encode("utf-8", "surrogatepass") for t in texts], pa.large_binary())
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else pa.binary()
    for start, run in text_runs(texts, limit):
        yield start, [b"" if t is None else t.translate(LOWER) for t in run.cast(kind).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor, shift, multiply), in place of a weak low-order hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def hashed_words(texts: list[bytes], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words (runs of the bytes marked in `letters`) of the texts, and where each text's words begin (and the last end)."""
    data = np.frombuffer(b" ".join([*texts, b""]) or b" ", np.uint8)
    inside = letters[data]
    starts = np.flatnonzero(inside & np.r_[True, ~inside[:-1]])
    stops = np.flatnonzero(~inside & np.r_[False, inside[:-1]])
    firsts = np.searchsorted(starts, np.r_[0, np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)])
    if not len(starts):
        return np.empty(0, np.uint64), firsts
    at = np.arange(len(data)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(data)]))
    weights = mix64(np.arange(1, int(at.max()) + 2, dtype=np.uint64)) | np.uint64(1)
    values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    sums = np.r_[np.uint64(0), np.cumsum(values[data] * weights[at])]
    return mix64(sums[stops] - sums[starts] + (stops - starts).astype(np.uint64)), firsts


def rolled(words: np.ndarray, k: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit fingerprint of every k consecutive words."""
    n = len(words) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    powers = np.cumprod(np.r_[np.uint64(1), np.full(len(words) - 1, factor, np.uint64)])
    back = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, pow(factor, -1, 1 << 64), np.uint64)])
    sums = np.r_[np.uint64(0), np.cumsum(words * powers)]
    return mix64((sums[k:] - sums[:-k]) * back)
