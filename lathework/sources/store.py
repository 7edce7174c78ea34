"""Reading and writing datasets (survey §2.1, §2.2)."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StringType, StructField, StructType

from lathework.functions import scalars as X
from lathework.operators.annotate import retried


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one only where that is unset in local mode."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lathework-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: it fixes the rows, cuts the lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- sources ---


def list_files(spark: SparkSession, folder: str, pattern: str = "*.mp4") -> DataFrame:
    """category, video_id, path, length of files below a folder that aren't empty; contents aren't read (O-S1, O-S2)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "length").filter("length > 0")
    return files.select(X.path_category("path").alias("category"), X.path_id("path", first_dot=not pattern.endswith(".mp4")).alias("video_id"), "path", "length")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines under a schema. Strict: a bad line fails the job. Else bad and `null` lines are skipped (O-S3, O-S4)."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return _parsed(spark, path, schema).filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def count_bad_lines(spark: SparkSession, path: str, schema: StructType | str) -> int:
    return _parsed(spark, path, schema).filter(F.col("_corrupt_record").isNotNull()).count()


def _parsed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    fields = schema.simpleString()[7:-1] if isinstance(schema, StructType) else schema
    # Lines are parsed as text, so that a filter on the bad ones needs no cache.
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    kind = StructType.fromDDL(fields).add("_corrupt_record", "string")
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    return lines.select(F.from_json("value", kind, options).alias("r"), "value").select("r.*", F.col("value")).withColumn("_corrupt_record", F.when(F.trim("value") == "null", F.col("value")).otherwise(F.col("_corrupt_record"))).drop("value")


def load_dataset(spark: SparkSession, path: str, split: str = "train", subset: str | None = None, schema: StructType | str | None = None, registry: dict[str, str] | None = None) -> DataFrame:
    """By suffix: JSON lines, CSV, Parquet; a saved dataset folder (with one folder for each split); or a registered name (O-S5 to O-S7)."""
    if registry and path in registry:
        return spark.table(registry[path])
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if path.endswith((".json", ".jsonl")):
        return reader.json(path)
    if path.endswith(".csv"):
        return reader.option("header", True).option("inferSchema", schema is None).csv(path)
    if path.endswith(".parquet"):
        return reader.parquet(path)
    folder = "/".join(x for x in (path.rstrip("/"), subset, split) if x)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return reader.parquet(folder)
    raise ValueError(f"{path} is no file, no saved dataset with a split {split}, and no registered name; hubs can't be reached")


def read_scores(spark: SparkSession, folder: str) -> DataFrame:
    """category, video_id, frame_idx, t, p from arrays of (time, score); empty and broken files give no rows (O-S8)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(folder).select(X.path_category("path").alias("category"), X.path_id("path", first_dot=True).alias("video_id"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for category, video, content in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    scores = np.load(io.BytesIO(content), allow_pickle=False)
                except (ValueError, OSError, EOFError):
                    continue
                if scores.ndim == 2 and scores.shape[1] == 2:
                    n = len(scores)
                    yield pa.RecordBatch.from_arrays([pa.array([category] * n, pa.string()), pa.array([video] * n, pa.string()), pa.array(np.arange(n, dtype="int32")), pa.array(scores[:, 0].astype("float32")), pa.array(scores[:, 1].astype("float32"))], names=["category", "video_id", "frame_idx", "t", "p"])

    return files.mapInArrow(run, "category string, video_id string, frame_idx int, t float, p float")


TRANSCRIPT = "chunks array<struct<text:string,timestamp:array<double>>>"


def read_words(spark: SparkSession, folder: str) -> DataFrame:
    """category, video_id, pos, text, ws, we from word transcripts, one JSON file a video (O-S9)."""
    files = spark.read.schema(TRANSCRIPT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    words = files.select(X.path_category(F.input_file_name()).alias("category"), X.path_id(F.input_file_name(), first_dot=True).alias("video_id"), F.posexplode("chunks").alias("pos", "w"))
    return words.select("category", "video_id", "pos", F.col("w.text").alias("text"), F.get("w.timestamp", F.lit(0)).alias("ws"), F.get("w.timestamp", F.lit(1)).alias("we"))


def media_exists(paths: DataFrame, listing: DataFrame, key: str = "path") -> DataFrame:
    """Rows whose file is in the listing (O-S11)."""
    return paths.join(listing.select(key).distinct(), key, "left_semi")


MEDIA_PATH = r"^(s3a?://[^/]+/.+|[a-z]+:/.*|/.*)$"


def open_uri(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it; a bare path is a local file, s3a and s3 are one."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", path))


def _read(path: str) -> bytes:
    store, name = open_uri(path)
    with store.open_input_file(name) as source:
        return source.read()


def media_bytes(paths: DataFrame, key: str = "path", tries: int = 3, wait: tuple[float, float] = (1.0, 4.0), missing: str = "error") -> DataFrame:
    """The rows with the content of their files (O-S10). Only files named are opened, each by its path, and failed reads are tried again.

    A path that is no URI of a file fails the job; so does a file that can't be read, unless missing is `null`.
    """
    checked = paths.withColumn(key, F.when(F.col(key).rlike(MEDIA_PATH), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("not a media path: "), F.coalesce(F.col(key), F.lit("null"))))))

    def content(path: str) -> bytes | None:
        try:
            return retried(lambda: _read(path), tries, wait)
        except OSError:
            if missing == "null":
                return None
            raise

    return _mapped(checked, key, "", "content", BinaryType(), pa.binary(), content, alone=True)


def _mapped(rows: DataFrame, of: str, drop: str, name: str, kind: Any, arrow: pa.DataType, call: Callable[[Any], Any], alone: bool = False) -> DataFrame:
    """rows without the column `drop` and with call(column `of`) by the given name; alone: a batch for each row, for large values."""
    kept = [f for f in rows.schema.fields if f.name not in (drop, name)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1) for i in range(len(batch))) if alone else (batch,):
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array([call(x) for x in part.column(of).to_pylist()], arrow)], names=[*(f.name for f in kept), name])

    return rows.mapInArrow(run, StructType([*kept, StructField(name, kind)]))


NOTES = "struct<n_frames:bigint,fps:double,width:bigint,height:bigint>"


def decode_media(files: DataFrame, decoder: Callable[[bytes], tuple[int, float, int, int]], tries: int = 3, wait: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """n_frames, fps, width, height of each file's content by a decoder, which is tried again; null where it fails (O-S12, O-S13, O-U4)."""
    names = ("n_frames", "fps", "width", "height")

    def notes(content: bytes) -> dict | None:
        try:
            return dict(zip(names, retried(lambda: decoder(content), tries, wait, (Exception,))))
        except Exception:  # noqa: BLE001  a decoder fails in its own ways
            return None

    kind = pa.struct([("n_frames", pa.int64()), ("fps", pa.float64()), ("width", pa.int64()), ("height", pa.int64())])
    out = _mapped(files, "content", "content", "__notes", StructType.fromDDL(f"x {NOTES}")[0].dataType, kind, notes)
    return out.withColumns({n: F.col("__notes")[n] for n in names}).drop("__notes")


def probe_durations(files: DataFrame, probe: Callable[[str], float], key: str = "path") -> DataFrame:
    """files with duration, by an external probe of each path; null where it fails (O-S13)."""

    def seconds(path: str) -> float | None:
        try:
            return float(probe(path))
        except Exception:  # noqa: BLE001  a probe fails in its own ways
            return None

    return _mapped(files, key, "", "duration", DoubleType(), pa.float64(), seconds)


def extract_frames(frames: DataFrame, extractor: Callable[[str, float], bytes], cache: str, tries: int = 5) -> DataFrame:
    """frames (path, t) with image, the path of the frame at t, made by an extractor where the cache hasn't it yet (O-S14).

    The cache keeps category/name_t.jpg. A failed try leaves no file; after the last one the job fails. A file is written
    beside its place and then moved there, so a lost executor leaves no half image.
    """

    def image(row: dict) -> str:
        path, t = row["path"], float(row["t"])
        store, folder = open_uri(cache)
        parts = path.rstrip("/").split("/")
        place = f"{folder}/{parts[-2] if len(parts) > 1 else ''}/{parts[-1].split('.mp4')[0]}_{t}.jpg"
        if store.get_file_info(place).type != fs.FileType.File:
            data = retried(lambda: extractor(path, t), tries, (0.0, 0.0), (Exception,))
            store.create_dir(place.rpartition("/")[0], recursive=True)
            draft = f"{place}.{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as out:
                out.write(data)
            store.move(draft, place)
        return place

    whole = frames.withColumn("__row", F.struct("path", "t"))
    return _mapped(whole, "__row", "__row", "image", StringType(), pa.string(), image)


def extract_audio(files: DataFrame, extractor: Callable[[str], bytes | None]) -> DataFrame:
    """files with content, the sound track by an extractor; files without one, and those it fails on, go (O-S15)."""

    def sound(path: str) -> bytes | None:
        try:
            return extractor(path)
        except Exception:  # noqa: BLE001  an extractor fails in its own ways; its file has no sound then
            return None

    return _mapped(files, "path", "", "content", BinaryType(), pa.binary(), sound, alone=True).filter(F.col("content").isNotNull())


# --- sinks ---


def append_jsonl(df: DataFrame, path: str) -> None:
    """Rows added as JSON lines, null fields written (O-K1)."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def overwrite_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def save_dataset(df: DataFrame, path: str, overwrite: bool = False, rows_per_file: int = 1_000_000) -> None:
    """Parquet shards of so many rows at most (about 200 MB for usual examples); an error if the dataset is there and may not be overwritten (O-K3)."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("maxRecordsPerFile", rows_per_file).parquet(path)


def save_score_arrays(frames: DataFrame, folder: str, keys: tuple[str, str] = ("category", "video_id"), time: str = "t", score: str = "p") -> DataFrame:
    """One .npy of float32 (time, score) in time order for each video at folder/category/video_id.npy: keys, path, n (O-K9)."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(time, kind="stable")
        store, base = open_uri(folder)
        category, video = pdf[keys[0]].iloc[0], pdf[keys[1]].iloc[0]
        place = f"{base}/{category}/{video}.npy"
        store.create_dir(f"{base}/{category}", recursive=True)
        data = io.BytesIO()
        np.save(data, pdf[[time, score]].to_numpy("float32"))
        with store.open_output_stream(place) as out:
            out.write(data.getvalue())
        return pd.DataFrame({keys[0]: [category], keys[1]: [video], "path": [place], "n": [len(pdf)]})

    rows = frames.select(*(F.col(k).cast("string").alias(k) for k in keys), F.col(time).cast("double").alias(time), F.col(score).cast("double").alias(score))
    return rows.groupBy(*keys).applyInPandas(run, f"`{keys[0]}` string, `{keys[1]}` string, path string, n long")


def save_scores(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("category").parquet(path)


def save_metric(df: DataFrame, path: str) -> None:
    """A one-row table as one JSON document (O-K6)."""
    df.limit(1).coalesce(1).write.mode("overwrite").json(path)


def run_side_effect(df: DataFrame, action: Callable[[dict], Any], key: str) -> DataFrame:
    """key, status of an action on each row: Success, or Error with its message (O-K4, O-K5)."""

    def said(row: dict) -> str:
        try:
            action(row)
        except Exception as error:  # noqa: BLE001  the status says what went wrong
            return f"Error: {error}"
        return "Success"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([said(row) for row in batch.to_pylist()], pa.string())], names=[key, "status"])

    return df.mapInArrow(run, StructType([df.schema[key], StructField("status", StringType())]))


def save_clips(clips: DataFrame, cutter: Callable[[str, float, float], bytes], folder: str) -> DataFrame:
    """clip, status of cutting clips (path, clip, start, end) out of their sources into folder/category/clip (O-K4, O-K5).

    A cutter makes the bytes of a clip. Warning: the source isn't there; Error: the cutter failed; else Success. A clip is
    written beside its place and then moved there.
    """

    def save(row: dict) -> str:
        if row["path"] is None or open_uri(row["path"])[0].get_file_info(open_uri(row["path"])[1]).type != fs.FileType.File:
            return f"Warning: no source for {row['clip']}"
        try:
            data = cutter(row["path"], row["start"], row["end"])
        except Exception as error:  # noqa: BLE001  the status says what went wrong
            return f"Error: {error}"
        store, root = open_uri(folder)
        parts = row["path"].split("/")
        place = f"{root}/{parts[-2] if len(parts) > 1 else ''}/{row['clip']}"
        store.create_dir(place.rpartition("/")[0], recursive=True)
        draft = f"{place}.{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as out:
            out.write(data)
        store.move(draft, place)
        return "Success"

    rows = clips.select("clip", F.struct("path", "clip", "start", "end").alias("__row"))
    return _mapped(rows, "__row", "__row", "status", StringType(), pa.string(), save)


def copy_new(files: DataFrame, folder: str) -> DataFrame:
    """path, status of copying files (path) to folder/category/name; what is there already isn't copied again (O-K7).

    Which files are there is known from one listing of the folder. A copy is written beside its place and then moved there.
    """
    spark = files.sparkSession
    name = F.concat_ws("/", X.path_category("path"), F.substring_index("path", "/", -1))
    store, base = open_uri(folder)
    store.create_dir(base, recursive=True)
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    there = there.select(F.concat_ws("/", X.path_category("path"), F.substring_index("path", "/", -1)).alias("name"), F.lit(True).alias("there"))

    def copy(row: dict) -> None:
        target, root = open_uri(folder)
        place = f"{root}/{row['name']}"
        target.create_dir(place.rpartition("/")[0], recursive=True)
        draft = f"{place}.{uuid.uuid4().hex}"
        with target.open_output_stream(draft) as out:
            out.write(retried(lambda: _read(row["path"])))
        target.move(draft, place)

    known = write_table(files.select("path", name.alias("name")).join(there, "name", "left"), "copies-known")
    done = known.filter("there").select("path", F.lit("Skipped").alias("status"))
    return run_side_effect(known.filter("there is null").select("path", "name"), copy, "path").unionByName(done)
