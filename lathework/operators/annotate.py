"""Model-backed annotation with a fixed schema, an error policy and bounded retries (O-U3 to O-U8, O-F2, O-F6).

Rows reach models as Arrow batches; columns that are carried along stay Arrow arrays, so no value of theirs changes.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lathework.functions import scalars as X

# The classes that metadata may name.
MODALITIES = (
    "Echocardiography", "Ultrasound", "CT Imaging", "MRI", "Angiography", "X-ray", "Fluoroscopy", "Endoscopy and Laparoscopic Surgery", "Surgical and Procedural",
    "Anatomy and Biological Processes", "Microscopy", "Other",
)
REGIONS = (
    "Cardiac", "Vascular System", "Musculoskeletal System", "Cranial and Nervous System", "Thoracic and Respiratory System", "Gastrointestinal System", "Genitourinary System",
    "Head and Neck", "Endocrine System", "Skin and Integumentary System", "Other",
)
#: Words by which the offline classifier knows a class, in the classes' order.
MODALITY_WORDS = dict(zip(MODALITIES, (("echocardio",), ("ultraso", "sonogra"), ("ct", "tomogra"), ("mri", "magnetic"), ("angio",), ("x-ray", "radiogra"), ("fluoro",), ("endosco", "laparo"), ("surg", "incision"), ("anatom", "biolog"), ("microsco", "histolog"))))
REGION_WORDS = dict(zip(REGIONS, (("heart", "cardi"), ("vascul", "arter", "vein"), ("bone", "muscle", "joint"), ("brain", "nerv", "crani"), ("chest", "lung", "thora"), ("bowel", "stomach", "liver"), ("kidney", "bladder", "uter"), ("neck", "head", "eye"), ("thyroid", "adrenal"), ("skin", "derm"))))


def retried(call: Callable[[], Any], tries: int = 3, wait: tuple[float, float] = (1.0, 4.0), on: tuple[type[Exception], ...] = (OSError,)) -> Any:
    """The call's result; errors of the kinds named are tried again after a wait that doubles from its first value to its last (O-U4)."""
    pause = wait[0]
    for n in range(tries):
        try:
            return call()
        except on:
            if n + 1 == tries:
                raise
            time.sleep(pause)
            pause = min(pause * 2, wait[1])
    raise ValueError("no try is allowed")


@dataclass(frozen=True)
class Annotator:
    """A function of a row (dict) to a dict of the schema's fields, or an error.

    on_error: `default` fills in `fallback`, `passthrough` copies fields named in `passthrough` from the row, `drop` drops it,
    `raise` fails the job.
    `load` makes the function once in each worker, so a model is loaded once for many rows. `wait` is that of `retried`.
    """

    schema: str
    load: Callable[[], Callable[[dict], dict]]
    on_error: str = "drop"
    fallback: dict[str, Any] = field(default_factory=dict)
    passthrough: dict[str, str] = field(default_factory=dict)
    tries: int = 3
    wait: tuple[float, float] = (0.0, 0.0)
    allowed: dict[str, tuple[str, ...]] = field(default_factory=dict)


def annotate(rows: DataFrame, annotator: Annotator) -> DataFrame:
    """rows with the annotator's columns added (replacing those of the same names)."""
    if annotator.on_error not in ("default", "passthrough", "drop", "raise"):
        raise ValueError(f"no error policy {annotator.on_error!r}")
    new = [x.strip().split(" ")[0] for x in re.split(r",(?![^<(]*[>)])", annotator.schema)]
    kept = [f.name for f in rows.schema.fields if f.name not in new]
    added = StructType.fromDDL(annotator.schema)
    kinds = to_arrow_schema(added)
    out = StructType([*(f for f in rows.schema.fields if f.name not in new), *added.fields])

    def one(call: Callable[[dict], dict], row: dict) -> dict | None:
        def attempt() -> dict:
            got = call(row)
            if any(got.get(k) not in v for k, v in annotator.allowed.items()):
                raise ValueError("an answer is outside its classes")
            return {n: got.get(n) for n in new}

        try:
            return retried(attempt, annotator.tries, annotator.wait, (Exception,))
        except Exception:  # noqa: BLE001  models fail in their own ways; the policy decides
            if annotator.on_error == "default":
                return {n: annotator.fallback.get(n) for n in new}
            if annotator.on_error == "passthrough":
                return {n: row.get(annotator.passthrough.get(n, n)) for n in new}
            if annotator.on_error == "raise":
                raise
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = annotator.load()
        for batch in batches:
            found = [one(call, row) for row in batch.to_pylist()]
            good = pa.array([x is not None for x in found], pa.bool_())
            columns = [batch.column(n).filter(good) for n in kept]
            columns += [pa.array([x[f.name] for x in found if x is not None], f.type) for f in kinds]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *new])

    return rows.mapInArrow(run, out)


def map_rows(rows: DataFrame, call: Callable[[dict], dict], schema: str) -> DataFrame:
    """rows with the fields of the schema that a function of each row gives, for what no expression can say; an error fails the job (O-U1)."""
    return annotate(rows, Annotator(schema, lambda: call, "raise", tries=1))


def filter_batches(rows: DataFrame, keep: Callable[[pa.RecordBatch], list[bool]]) -> DataFrame:
    """The rows for which a function of a batch says so, for what no expression can say; a filter by place needs a column of it, as batches have no order (O-U1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch), pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def keyword_flag(text: Column | str, words: tuple[str, ...]) -> Column:
    """Whether any of the words stands in the text, in any case; false for null."""
    low = F.lower(X.col(text))
    return F.coalesce(F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w)), F.lit(False))


def squeezed(text: Column | str) -> Column:
    """The text with one space for each run of white space, and none at its ends."""
    return F.array_join(F.filter(F.split(X.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != ""), " ")


def keyword_relevance(words: tuple[str, ...], text: str = "caption") -> Annotator:
    """Offline stand-in for a relevance model; a failed row is false."""

    def load() -> Callable[[dict], dict]:
        return lambda row: {"is_biomedical": any(w in row[text].lower() for w in words)}

    return Annotator("is_biomedical boolean", load, "default", {"is_biomedical": False})


def whitespace_cleaner(text: str = "caption") -> Annotator:
    """Offline stand-in for a caption rewriter; a failed row keeps its caption."""

    def load() -> Callable[[dict], dict]:
        return lambda row: {"cleaned_caption": " ".join(row[text].split())}

    return Annotator("cleaned_caption string", load, "passthrough", passthrough={"cleaned_caption": text})


def cloze_questions(text: str = "cleaned_caption") -> Annotator:
    """Offline stand-in for a question writer: the longest word of the caption is asked for; a failed row goes."""

    def load() -> Callable[[dict], dict]:
        def call(row: dict) -> dict:
            words = row[text].split()
            longest = max(words, key=len)
            options = [longest, longest[::-1], longest[:-1] + "x", longest + "s"]
            pair = {"question": " ".join("___" if w == longest else w for w in words), **{f"option_{k}": o for k, o in zip("ABCD", options)}, "correct_option": "A", "correct_answer": longest}
            return {"qa_pairs": [pair]}

        return call

    return Annotator("qa_pairs array<struct<question:string,option_A:string,option_B:string,option_C:string,option_D:string,correct_option:string,correct_answer:string>>", load)


def keyword_metadata(text: str = "caption") -> Annotator:
    """Offline stand-in for a classifier: the first class of which a word stands in the text, else Other; answers outside the classes fail."""

    def load() -> Callable[[dict], dict]:
        def first(row: dict, words: dict[str, tuple[str, ...]]) -> str:
            said = row[text].lower()
            return next((name for name, own in words.items() if any(w in said for w in own)), "Other")

        return lambda row: {"modality": first(row, MODALITY_WORDS), "anatomical_region": first(row, REGION_WORDS)}

    return Annotator("modality string, anatomical_region string", load, allowed={"modality": MODALITIES, "anatomical_region": REGIONS})


def _with(rows: DataFrame, drop: str, name: str, kind: pa.DataType, ddl: str, load: Callable, values: Callable[[Any, pa.RecordBatch], list]) -> DataFrame:
    """rows without a column and with another, from a function of the loaded model and a batch."""
    kept = [f for f in rows.schema.fields if f.name not in (drop, name)]
    out = StructType([*kept, *StructType.fromDDL(f"`{name}` {ddl}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(values(model, batch), kind)], names=[*(f.name for f in kept), name])

    return rows.mapInArrow(run, out)


def score_frames(frames: DataFrame, load: Callable[[], Callable[[list[bytes]], list[float]]], batch: int = 256) -> DataFrame:
    """frames (with content) scored in batches by a model loaded once a worker: its columns but content, and p."""

    def values(model: Callable, rows: pa.RecordBatch) -> list:
        content = rows.column("content").to_pylist()
        return [s for i in range(0, len(content), batch) for s in model(content[i : i + batch])]

    return _with(frames, "content", "p", pa.float64(), "double", load, values)


def generate_answers(rows: DataFrame, prompt: str, load: Callable[[], Callable[[list[str]], list[str]]], model_id: str, batch: int = 8) -> DataFrame:
    """rows with prompt, pred (cleaned) and model_id from a model loaded once a worker; columns of rows win where names clash (O-U7, O-P5)."""

    def values(model: Callable, part: pa.RecordBatch) -> list:
        asked = part.column("__prompt").to_pylist()
        return [s for i in range(0, len(asked), batch) for s in model(asked[i : i + batch])]

    said = _with(rows.withColumn("__prompt", F.col(prompt)), "", "__said", pa.string(), "string", load, values)
    computed = {"prompt": F.col("__prompt"), "pred": X.clean_generation("__said"), "model_id": F.lit(model_id)}
    return said.withColumns({k: v for k, v in computed.items() if k not in rows.columns}).drop("__prompt", "__said", "image")


def transcribe(audio: DataFrame, load: Callable[[], Callable[[list[bytes]], list[list[tuple]]]], key: str = "video_id", batch: int = 2) -> DataFrame:
    """key, pos, text, ws, we; a batch that fails is done one by one, and what fails then has no words. Null audio goes first."""

    def heard(model: Callable, content: list[bytes]) -> list[list[tuple]]:
        try:
            return model(content)
        except Exception:  # noqa: BLE001  models fail in their own ways
            return [x for c in content for x in heard(model, [c])] if len(content) > 1 else [[]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for part in batches:
            content = part.column("content").to_pylist()
            found = [words for i in range(0, len(content), batch) for words in heard(model, content[i : i + batch])]
            rows = [(i, j, *w) for i, words in enumerate(found) for j, w in enumerate(words)]
            at, pos, text, ws, we = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), pa.array(text, pa.string()), pa.array(ws, pa.float64()), pa.array(we, pa.float64())], names=[key, "pos", "text", "ws", "we"])

    sound = audio.filter(F.col("content").isNotNull()).select(key, "content")
    return sound.mapInArrow(run, StructType([audio.schema[key], *StructType.fromDDL("pos int, text string, ws double, we double").fields]))
