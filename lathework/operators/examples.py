"""Chat rendering and training examples (O-X11 to O-X18, O-P7, O-P10, O-P12, O-U2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathework.functions import scalars as X

MESSAGES = "array<struct<role:string,content:string>>"
DEFAULT_SYSTEM = "You are a helpful assistant."
VIDEO = "<video>"
#: What a caption may be asked with.
CAPTION_PROMPTS = (
    "Describe what this video shows.", "What is happening in this clip?", "Give an account of the scenes in this video.", "Summarise the clip in your own words.",
    "Explain what can be seen here.", "What does this recording present?", "Write a caption for this video.", "Tell me what takes place in the clip.",
    "Which procedure or finding does the clip show?", "Walk through this recording step by step.", "What would a clinician note in these scenes?", "Put the content of this video into words.",
    "What is the subject of this recording?", "Name and describe what the camera records.", "Report what you see from start to end.", "How would you describe this clip to a colleague?",
    "State the main content of the footage.", "What does the viewer learn from this clip?", "Narrate the events of this video.", "Give a short description of the footage.",
)


def messages_of(value: Column | str, is_json: bool) -> Column:
    """Messages given as a list, or as a JSON string."""
    return F.from_json(X.col(value), MESSAGES) if is_json else X.col(value)


def with_system(messages: Column | str, text: str = DEFAULT_SYSTEM, insert: bool = True) -> Column:
    """A system message in front unless there is one."""
    m = X.col(messages)
    if not insert:
        return m
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(text).alias("content")))
    return F.when(F.coalesce(F.get(m, F.lit(0))["role"] == "system", F.lit(False)), m).otherwise(F.concat(first, m))


def render(messages: Column | str, template: str = "im", eos: str = "</s>", generation_prompt: bool = False) -> Column:
    """`im`: <|im_start|>role, text, <|im_end|>; `role`: <|role|>, text and the end token."""
    m = X.col(messages)
    if template == "im":
        one, ask = (lambda x: F.concat(F.lit("<|im_start|>"), x["role"], F.lit("\n"), x["content"], F.lit("<|im_end|>\n"))), "<|im_start|>assistant\n"
    elif template == "role":
        one, ask = (lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["content"], F.lit(f"{eos}\n"))), "<|assistant|>\n"
    else:
        raise ValueError(f"no template {template!r}")
    text = F.array_join(F.transform(m, one), "")
    return F.concat(text, F.lit(ask)) if generation_prompt else text


def gather_messages(turns: DataFrame, key: str, order: str, role: str = "role", content: str = "text") -> DataFrame:
    """key, messages: one row per conversation, turns in order."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.col(content).alias("content"))))
    return turns.groupBy(key).agg(F.transform(packed, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def caption_messages(caption: Column | str, key: Column | str, prompts: tuple[str, ...] = CAPTION_PROMPTS) -> Column:
    return F.array(_message("user", F.concat(F.lit(f"{VIDEO}\n"), X.pick(list(prompts), key))), _message("assistant", X.col(caption)))


def qa_messages(pairs: Column | str) -> Column:
    """The placeholder, then question and answer of each pair; the answer may be named correct_answer."""
    turns = F.flatten(F.transform(X.col(pairs), lambda q: F.array(_message("user", q["question"]), _message("assistant", F.coalesce(q["answer"], q["correct_answer"])))))
    return F.concat(F.array(_message("user", F.lit(VIDEO))), turns)


def training_examples(items: DataFrame, base: str = "") -> DataFrame:
    """One caption row for each captioned item and a Q/A row where it has pairs, in one scan.

    items: video, caption, qa_pairs(question, answer, correct_answer) and num_frames, width, height, fps of the video.
    """
    common = (X.first_part("video").alias("source"), F.array(F.concat_ws("/", *([F.lit(base)] if base else []), F.col("video"))).alias("videos"), X.media_metas_json("num_frames", "width", "height", "fps").alias("video_metas"))
    kinds = F.array(
        F.struct(F.lit("caption").alias("kind"), caption_messages("caption", "video").alias("messages")),
        F.when(F.size("qa_pairs") > 0, F.struct(F.lit("qa").alias("kind"), qa_messages("qa_pairs").alias("messages"))),
    )
    rows = items.filter(F.col("caption").isNotNull()).select(*common, "video", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k"))
    return rows.select("source", X.stable_id("video", "k.kind").alias("message_id"), "k.kind", "k.messages", "videos", "video_metas", F.array(F.lit(VIDEO)).alias("special_tokens"))
