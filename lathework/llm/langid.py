"""Language ID by n-gram filters: one bit-sliced Bloom filter whose slots are language bitmasks.

A slot holds one bit for each language, so looking an n-gram up in its slots and taking the AND of their masks returns
all languages that contain it. For each language the n-grams of a text that it contains are counted; a share of these hits
is chance, known from how full the language's slice of the filter is, and is taken off. The language with the highest
corrected count is the answer, and its share of the corrected evidence the score.

N-grams are runs of letters of the lower-cased text (code points), with every run of other characters as one gap.

Training reads labelled documents only: of each language about `sample_rows` documents, chosen by a hash of the id, and the
n-grams that `least_docs` of them hold. The filter's size is a parameter, so what is collected and broadcast is bounded; the
languages are as many as the labels have, 64 to a mask word.

Edge cases: a text that is null or has no letter is `und` with score 0; so is every text if nothing was learned; ties go to
the language that sorts first; null labels teach nothing; repeated rows count each time; rows with a null id are predicted
like others and teach nothing; an empty table gives an empty result; extra columns are ignored. Whole texts are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lathework.llm.common import Shared, mix64, text_runs, write_table

U = np.uint64
SLICE_BYTES = 1 << 19
#: An n-gram has two slots, from different bits of its hash.
HASHES, HASH_BITS = 2, 24


@dataclass(frozen=True)
class LangConfig:
    sizes: tuple[int, ...] = (3, 5)
    slots_log2: int = 21
    sample_rows: int = 1500
    least_docs: int = 2
    #: More labels than this are taken for an error, as a row for each reaches the driver and every mask holds a bit for it.
    most_languages: int = 4096


def _letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts with gaps squeezed to one 32 each, and where each text starts; every text has a gap around it."""
    whole = " ".join(["", *(("" if t is None else t).lower() for t in texts), ""])
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    top = int(points.max()) + 1
    present = np.flatnonzero(np.bincount(points, minlength=top)) if top < 1 << 17 else np.unique(points)
    is_letter = np.zeros(top, bool)
    is_letter[[p for p in present.tolist() if chr(p).isalpha()]] = True
    letter = is_letter[points]
    lengths = np.array([len("" if t is None else t.lower()) + 1 for t in texts])
    bounds = np.r_[0, np.cumsum(lengths)]
    keep = letter | np.r_[True, letter[:-1]]
    # A text's end is its last gap: one that opens before it in the same run of other characters goes.
    gaps, places = np.flatnonzero(keep & ~letter), np.flatnonzero(letter)
    follows = np.r_[places, len(points)][np.searchsorted(places, gaps)]
    keep[gaps[np.searchsorted(bounds, follows) > np.searchsorted(bounds, gaps)]] = False
    keep[bounds] = True
    at = np.r_[0, np.cumsum(keep)]
    return np.where(letter, points, 32)[keep].astype(U), at[bounds]


def grams(texts: list[str | None], sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: hashes of the n-grams of all texts one after another, and how many each text has."""
    points, bounds = _letters(texts)
    for n in sizes:
        if len(points) < n:
            yield np.empty(0, U), np.zeros(len(texts), np.int64)
            continue
        h = np.full(len(points) - n + 1, U(n))
        for j in range(n):
            h = (h ^ points[j : j + len(h)]) * U(0x100000001B3)
        # A text's n-grams start at its leading gap and end at its closing one, which is the next text's leading gap.
        counts = np.maximum(0, bounds[1:] - n + 2 - bounds[:-1])
        starts = np.repeat(bounds[:-1] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
        yield mix64(h)[starts], counts


def _slot(h: np.ndarray, k: int, log2: int) -> np.ndarray:
    return ((h >> U(k * HASH_BITS)) & U((1 << log2) - 1)).astype(np.int64)


@dataclass(frozen=True)
class LangModel:
    languages: list[str]
    #: (slots, words of 64 languages)
    masks: np.ndarray
    #: Chance that a language's slice answers yes to an n-gram that isn't in it.
    chance: np.ndarray


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def train(labelled: DataFrame, cfg: LangConfig = LangConfig()) -> LangModel:
    """labelled: doc_id, text, lang."""
    rows = labelled.filter("lang is not null and text is not null and doc_id is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(cfg.most_languages + 1).collect()}
    if len(sizes) > cfg.most_languages:
        raise ValueError(f"more than {cfg.most_languages} languages are named")
    languages = sorted(sizes)
    if not languages:
        return LangModel([], np.zeros((1, 1), U), np.zeros(0))
    # About sample_rows of each language: the ids whose hash falls under the language's share.
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, cfg.sample_rows / n))) for k, n in sizes.items()))
    sample = rows.filter(F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    number = F.coalesce(*(F.when(F.col("lang") == k, F.lit(i)) for i, k in enumerate(languages)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags = batch.column("number").to_numpy()
            for start, run_ in text_runs(batch.column("text"), SLICE_BYTES):
                texts = run_.to_pylist()
                for h, counts in grams(texts, cfg.sizes):
                    ends = np.r_[0, np.cumsum(counts)]
                    own = defaultdict(list)
                    for i, tag in enumerate(tags[start : start + len(texts)].tolist()):
                        own[tag].append(np.unique(h[ends[i] : ends[i + 1]]))
                    for tag, found in own.items():  # documents of a slice are counted here already
                        gram, n = np.unique(np.concatenate(found), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), tag, np.int64)), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], names=["number", "gram", "n"])

    counted = sample.select(number.alias("number"), "text").mapInArrow(run, "number long, gram long, n long").groupBy("number", "gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= cfg.least_docs)
    counted = write_table(counted, "langid-grams")
    low = F.lit((1 << cfg.slots_log2) - 1)
    slots = [F.shiftrightunsigned("gram", k * HASH_BITS).bitwiseAND(low) for k in range(HASHES)]
    spread = counted.select(F.explode(F.array(*slots)).alias("slot"), "number")
    bits = spread.groupBy("slot", F.floor(F.col("number") / 64).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(number, 64) AS int)))").alias("mask"))
    masks = np.zeros((1 << cfg.slots_log2, -(-len(languages) // 64)), U)
    got = bits.toPandas()  # at most a row for each slot and mask word
    masks[got["slot"].to_numpy(), got["word"].to_numpy()] = got["mask"].to_numpy().view(U)
    filled = np.array([np.count_nonzero(masks[:, i // 64] & (U(1) << U(i % 64))) for i in range(len(languages))]) / len(masks)
    return LangModel(languages, masks, filled**HASHES)


def predict(docs: DataFrame, model: LangModel, cfg: LangConfig = LangConfig(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return labelled(rows, model, cfg, "text", ("doc_id",)).withColumnsRenamed({"__lang": "lang_pred", "__score": "score"})


def labelled(docs: DataFrame, model: LangModel, cfg: LangConfig = LangConfig(), text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns to keep (all, if not given), __lang and __score of every row; a text is sent to Python once."""
    keep = tuple(docs.columns) if keep is None else keep
    shared = Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.get()
        names = np.array([*m.languages, "und"], object)
        for batch in batches:
            for start, run_ in text_runs(batch.column(text), SLICE_BYTES):
                texts = run_.to_pylist()
                evidence = np.zeros((len(texts), len(m.languages)))
                for h, counts in grams(texts, cfg.sizes) if m.languages else ():
                    ends = np.r_[0, np.cumsum(counts)]
                    for w in range(m.masks.shape[1]):
                        masks = m.masks[_slot(h, 0, cfg.slots_log2), w]
                        for k in range(1, HASHES):
                            masks = masks & m.masks[_slot(h, k, cfg.slots_log2), w]
                        own = range(w * 64, min(len(m.languages), w * 64 + 64))
                        for i in own:
                            sums = np.r_[0, np.cumsum(((masks >> U(i - w * 64)) & U(1)).astype(np.int32))]
                            evidence[:, i] += _corrected(sums[ends[1:]] - sums[ends[:-1]], counts, m.chance[i])
                letters = np.array([any(map(str.isalpha, t or "")) for t in texts], bool)
                known = letters & bool(m.languages)
                best = np.where(known, evidence.argmax(axis=1) if m.languages else 0, len(m.languages))
                total = evidence.sum(axis=1)
                score = np.where(known & (total > 0), evidence.max(axis=1, initial=0.0) / np.where(total > 0, total, 1), 0.0)
                own = [batch.column(c).slice(start, len(texts)) for c in keep]
                yield pa.RecordBatch.from_arrays([*own, pa.array(names[best].tolist(), pa.string()), pa.array(score)], names=[*keep, "__lang", "__score"])

    rows = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])))
    return rows.mapInArrow(run, StructType([*(docs.schema[c] for c in keep), StructField("__lang", StringType()), StructField("__score", DoubleType())]))


def _corrected(hits: np.ndarray, n: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """How many n-grams a language contains, from how many its slice says it does."""
    return np.maximum(0.0, (hits.astype(float) - n * chance) / np.maximum(1e-9, 1.0 - chance))


def language_id(docs: DataFrame, cfg: LangConfig = LangConfig()) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the labelled rows that aren't held out."""
    own = docs.select("doc_id", "text", "lang")
    model = train(own.filter(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))), cfg)
    return predict(own, model, cfg).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
