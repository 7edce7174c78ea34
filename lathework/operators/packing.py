"""Packing token sequences into bins, and laying bins out as padded rows (O-T1, O-T4 to O-T11, O-W2 to O-W5, O-J8).

Packing is sequential within a group, and only (row index, length) pairs reach it. A group is a range of `group_rows` row
indices, by the same rule at every size, so no task packs the whole table and order is kept; each group costs at most one
partly filled bin more.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathework.functions import scalars as X

GROUP_ROWS = 1 << 18


class FirstFit:
    """Bins of equal capacity in a max tree over free space; finds the leftmost bin that an item fits in."""

    def __init__(self, n_items: int, capacity: int):
        self.leaves = 1
        while self.leaves < max(1, n_items):
            self.leaves *= 2
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        i = 1
        while i < self.leaves:
            i *= 2
            if self.free[i] < size:
                i += 1
        at, left = i - self.leaves, self.free[i] - size
        self.free[i] = left
        while i > 1:
            i //= 2
            self.free[i] = max(self.free[2 * i], self.free[2 * i + 1])
        return at


def first_fit_decreasing(sizes: list[int], capacity: int, seed: int | None = None) -> list[list[int]]:
    """Item indices of each bin: longest items first (ties in order), each into the leftmost bin with room; a seed shuffles a bin's items."""
    tree, bins = FirstFit(len(sizes), capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = tree.place(sizes[i])
        while at >= len(bins):
            bins.append([])
        bins[at].append(i)
    if seed is not None:
        rng = random.Random(seed)
        for b in bins:
            rng.shuffle(b)
    return bins


def next_fit(sizes: list[int], capacity: int, seed: int | None = None) -> list[list[int]]:
    """Items in (shuffled) order; a bin closes when the next item has no room."""
    order = list(range(len(sizes)))
    if seed is not None:
        random.Random(seed).shuffle(order)
    bins, left = [], -1
    for i in order:
        if sizes[i] > left:
            bins.append([])
            left = capacity
        bins[-1].append(i)
        left -= sizes[i]
    return bins


METHODS: dict[str, Callable] = {"ffd": first_fit_decreasing, "next_fit": next_fit}


def pack(rows: DataFrame, index: str, length: str, capacity: int, method: str = "ffd", seed: int | None = None, group_rows: int = GROUP_ROWS, start: str | None = None) -> DataFrame:
    """bin_id, index_bins: one row per bin. A length over the capacity, or none, fails the job.

    Rows whose indices lie in the same range of group_rows are packed together; bin_id is the range's number times 2^40, plus
    the bin's number in it. start: the column that tells the chunks of a row apart (see `chunks`); start_bins then holds it
    beside index_bins.
    """
    if method not in METHODS:
        raise ValueError(f"no packing method {method!r}; there are {', '.join(METHODS)}")
    fit = METHODS[method]
    size = F.when((F.col(length) <= capacity) & (F.col(length) >= 0), F.col(length)).otherwise(F.raise_error(F.lit(f"a length is over {capacity} or missing")).cast("long"))
    part = F.col(start).cast("long") if start else F.lit(None).cast("long")
    dealt = rows.select(F.col(index).cast("long").alias("row_idx"), part.alias("start"), size.cast("long").alias("n")).withColumn("grp", F.floor(F.col("row_idx") / group_rows).cast("long"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row_idx", "start"] if start else "row_idx")
        ids, grp = pdf["row_idx"].tolist(), int(pdf["grp"].iloc[0])
        bins = fit(pdf["n"].tolist(), capacity, seed)
        out = pd.DataFrame({"bin_id": [(grp << 40) + i for i in range(len(bins))], "index_bins": [[ids[i] for i in b] for b in bins]})
        if start:
            starts = [None if pd.isna(s) else int(s) for s in pdf["start"]]
            out["start_bins"] = [[starts[i] for i in b] for b in bins]
        return out

    return dealt.groupBy("grp").applyInPandas(run, "bin_id long, index_bins array<long>" + ", start_bins array<long>" * bool(start))


def chunks(rows: DataFrame, length: str, capacity: int) -> DataFrame:
    """rows with start: one over the capacity becomes whole chunks of at most that, in order; start is null for others."""
    starts = F.when(F.col(length) > capacity, F.sequence(F.lit(0).cast("long"), F.col(length).cast("long") - 1, F.lit(capacity).cast("long"))).otherwise(F.array(F.lit(None).cast("long")))
    cut = rows.withColumn("start", F.explode(starts))
    return cut.withColumn(length, F.when(F.col("start").isNull(), F.col(length)).otherwise(F.least(F.col(length) - F.col("start"), F.lit(capacity))))


def bin_rows(bins: DataFrame, rows: DataFrame, index: str) -> DataFrame:
    """Each bin's rows with their place in it."""
    at = bins.select("bin_id", F.posexplode("index_bins").alias("pos", index))
    return at.join(rows, index)


def collate(members: DataFrame, pad_id: int = 0, ignore: int = X.IGNORE, multiple: int = 128) -> DataFrame:
    """One padded row per bin: input_ids, attention_mask, position_ids, labels, cu_seqlens, videos.

    members: bin_id, pos, input_ids, labels, videos (array, may be null). A row is padded to a multiple; videos are null
    where the first member has none.
    """
    parts = F.array_sort(F.collect_list(F.struct("pos", "input_ids", "labels", "videos")))
    whole = members.groupBy("bin_id").agg(parts.alias("m"))
    lengths = F.transform("m", lambda x: F.size(x["input_ids"]))
    flat = whole.select(
        "bin_id", F.flatten(F.transform("m", lambda x: x["input_ids"])).alias("ids"), F.flatten(F.transform("m", lambda x: x["labels"])).alias("lab"), lengths.alias("lengths"),
        F.when(F.get("m", F.lit(0))["videos"].isNotNull(), F.flatten(F.transform("m", lambda x: F.coalesce(x["videos"], F.array().cast("array<string>"))))).alias("videos"),
    )
    n = F.size("ids")
    to = n + X.pad_length(n, multiple).cast("int")
    return flat.select(
        "bin_id", X.pad_right("ids", to, pad_id).alias("input_ids"), X.pad_right(F.transform("ids", lambda _: F.lit(True)), to, F.lit(False)).alias("attention_mask"),
        X.pad_right(X.position_ids("lengths"), to, 0).alias("position_ids"), X.pad_right("lab", to, ignore).alias("labels"), X.starts_from_lengths("lengths").alias("cu_seqlens"), "videos",
    )


def hashed_ids(text: Column | str, vocabulary: int = 32000) -> Column:
    """A tokenizer without a model: white-space pieces to ids by md5, the same in any engine."""
    pieces = F.filter(F.split(X.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(pieces, lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % vocabulary).cast("int"))


def tokenize(rows: DataFrame, text: str, encode: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """rows with input_ids: by a function on series of texts (a model's tokenizer), or by hashed pieces."""
    if encode is None:
        return rows.withColumn("input_ids", hashed_ids(text))
    return rows.withColumn("input_ids", F.pandas_udf(lambda s: encode(s), "array<int>")(text))  # noqa: PLW0108


def maybe_unmasked(labels: Column, ids: Column, key: Column, probability: float) -> Column:
    """Labels left unmasked for a share of the rows, drawn by the md5 of the key."""
    if not probability:
        return labels
    drawn = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")
    return F.when(drawn < int(probability * (1 << 32)), ids).otherwise(labels)




def tokenize_media(rows: DataFrame, text: str, metas: Column | str, placeholder: str, model_token: str, media_id: int, encode: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """rows with text (placeholders as model tokens) and input_ids, in which the i-th model token is one media_id for each token of the i-th medium (O-T1, O-X8, O-X9).

    metas: struct(num_frames, width, height) of each medium, or their JSON. As many placeholders as media are needed, else the
    job fails. A medium has tokens_per_frame(width, height) tokens for each frame. The text between is tokenized by itself.
    """
    notes = F.col(metas) if isinstance(metas, str) else metas
    if isinstance(metas, str) and rows.schema[metas].dataType.typeName() == "string":
        notes = X.media_metas(metas)
    said = F.replace(F.col(text), F.lit(placeholder), F.lit(model_token))
    counts = F.transform(notes, lambda m: (X.tokens_per_frame(m["width"], m["height"]) * m["num_frames"]).cast("int"))
    marked = rows.withColumn(text, said).withColumn("__counts", counts).withColumn(text, X.equal_counts(F.col(text), text, model_token, F.size("__counts")))
    parts = F.split(F.col(text), rf"\Q{model_token}\E", -1)
    if encode is None:
        ids = F.transform(parts, lambda part: hashed_ids(part))  # noqa: PLW0108  transform would pass a place as the vocabulary
    else:

        def encode_parts(lists: pd.Series) -> pd.Series:
            flat = pd.Series([x for parts_ in lists for x in parts_], dtype=object)
            found, at, out = encode(flat).tolist(), 0, []
            for parts_ in lists:
                out.append([list(x) for x in found[at : at + len(parts_)]])
                at += len(parts_)
            return pd.Series(out)

        ids = F.pandas_udf(encode_parts, "array<array<int>>")(parts)
    # The text's parts and the media take turns.
    media = F.transform("__counts", lambda n: F.array_repeat(F.lit(media_id), n))
    turns = F.zip_with(ids, media, lambda a, b: F.concat(a, F.coalesce(b, F.array().cast("array<int>"))))
    return marked.withColumn("input_ids", F.flatten(turns)).drop("__counts")
