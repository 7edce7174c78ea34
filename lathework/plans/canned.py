"""Whole preprocessing runs: load a mix, render chats, tokenize with media, mask labels, save (O-U10)."""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.functions import scalars as X
from lathework.operators import examples, mix, packing
from lathework.plans.config import Pipeline, Processor, load_settings
from lathework.sources import store


@dataclass(frozen=True)
class Settings:
    #: Each with path, and as wanted ratio, split, subset.
    datasets: list[dict]
    output_path: str
    dedup_key: str | None = None
    columns_to_keep: list[str] = field(default_factory=list)
    seed: int = 42
    #: The column that holds each row's number; added where there is none.
    row: str = "row_idx"
    template: str = "im"
    system_message: str = examples.DEFAULT_SYSTEM
    insert_system: bool = True
    placeholder: str = "<video>"
    model_token: str = "<|video_pad|>"
    media_id: int = 151656
    #: Marks of the turns whose text is a target; without any, all ids are labels.
    bos: list[int] = field(default_factory=list)
    eos: list[int] = field(default_factory=list)
    unmasked_share: float = 0.0
    overwrite: bool = False
    #: Whether rows have media notes.
    media: bool = True


def load_mix(spark: SparkSession, s: Settings) -> DataFrame:
    """The rows of all datasets, deduplicated and taken by their ratios; an empty mix errs."""
    parts = []
    for d in s.datasets:
        df = store.load_dataset(spark, d["path"], d.get("split", "train"), d.get("subset"))
        df = mix.keep_columns(df, [*s.columns_to_keep, s.row]) if s.columns_to_keep else df
        if s.row not in df.columns:
            df = mix.ranked(df, sorted(df.columns), s.row)
        parts.append(mix.MixPart(df, float(d.get("ratio", 1.0)), d["path"]))
    return mix.not_empty(mix.ratio_mix(parts, s.row, s.seed, s.dedup_key), "mix of datasets")


def render_chats(df: DataFrame, s: Settings) -> DataFrame:
    """text from messages, given as a list or as JSON."""
    messages = examples.messages_of("messages", df.schema["messages"].dataType.typeName() == "string")
    return df.withColumn("text", examples.render(examples.with_system(messages, s.system_message, s.insert_system), s.template))


def mask(df: DataFrame, s: Settings) -> DataFrame:
    """labels, and only rows that have a target."""
    if not s.bos:
        return df.withColumn("labels", F.col("input_ids"))
    labels = packing.maybe_unmasked(X.mask_labels("input_ids", s.bos, s.eos), F.col("input_ids"), F.col(s.row), s.unmasked_share)
    return df.withColumn("labels", labels).filter(X.any_target("labels"))


def media_pipeline(s: Settings, metas: str = "video_metas") -> Pipeline:
    """Chats with media notes (JSON) to token ids and labels; for images, metas holds their sizes as one-frame notes."""
    tokenize = lambda df: packing.tokenize_media(df, "text", metas, s.placeholder, s.model_token, s.media_id)
    return Pipeline((
        Processor("chat", lambda df: render_chats(df, s), ("messages",), ("text",)),
        Processor("tokenize", tokenize, ("text", metas), ("input_ids",)),
        Processor("labels", lambda df: mask(df, s), ("input_ids",), ("labels",)),
    ))


def text_pipeline(s: Settings) -> Pipeline:
    """Chats without media to token ids and labels."""
    return Pipeline((
        Processor("chat", lambda df: render_chats(df, s), ("messages",), ("text",)),
        Processor("tokenize", lambda df: packing.tokenize(df, "text"), ("text",), ("input_ids",)),
        Processor("labels", lambda df: mask(df, s), ("input_ids",), ("labels",)),
    ))


def run(spark: SparkSession, s: Settings) -> DataFrame:
    """Load, chat, tokenize, mask, save; the saved dataset."""
    out = (media_pipeline(s) if s.media else text_pipeline(s))(load_mix(spark, s))
    store.save_dataset(out, f"{s.output_path}/train", s.overwrite)
    return store.load_dataset(spark, s.output_path)


def main(arguments: list[str]) -> None:
    """config.yaml [--name value ...]"""
    spark = SparkSession.builder.getOrCreate()
    path, *rest = arguments
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    run(spark, load_settings(Settings, text, rest))


if __name__ == "__main__":
    main(sys.argv[1:])
