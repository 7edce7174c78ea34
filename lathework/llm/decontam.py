"""Benchmark decontamination over suffix arrays of the training texts.

The training documents are taken in shards (slices of a partition). A shard's words are hashed, and the places where its
windows begin are sorted by the fingerprint of what follows: its suffix array, in the order of those fingerprints. Every test
suffix is looked up in it by binary search; where the test has more suffixes than the shard, the shard's are looked up in
the test's array, which is sorted alike. What is found is compared word by word and joined to the longest verbatim matches
with their places in the document and in the item. Words are compared by 64-bit hashes.

A test window is `window` consecutive words of an item; an item with fewer words, but not none, is one window itself. A
document's word inside any occurrence of a window is hit.

The test's arrays are made on the driver and given to all executors in blocks of at most `block_bytes` of text (about three
times that as arrays), so what is broadcast is bounded whatever the benchmark's size. Each block is a pass over the texts.

Edge cases: null texts have no words; empty items match nothing; items with equal texts are both reported; rows with a
null or repeated doc_id are judged row by row; an empty table gives an empty result, and an empty benchmark leaves all
documents clean; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from lathework.llm.common import Shared, hashed_words, rolled, slices, write_table

U = np.uint64
#: Bytes of words: digits, lower-case letters, all of a non-ASCII letter.
WORD_BYTES = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


@dataclass(frozen=True)
class DecontamConfig:
    window: int = 10
    block_bytes: int = 8 << 20


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of the given lengths: the run of each element, and its place in the run."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


class TestSuffixes:
    """The windows of one block of items, for each window length sorted by fingerprint."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.names = [name for name, _ in items]
        self.words, self.firsts = hashed_words([d for _, run in slices([text for _, text in items]) for d in run], WORD_BYTES)
        sizes = np.diff(self.firsts)
        lengths = np.minimum(sizes, window)
        self.groups = []
        for n in np.unique(lengths[lengths > 0]).tolist():
            which = np.flatnonzero(lengths == n)
            owner, at = _spread(sizes[which] - n + 1)
            item, at = which[owner].astype(np.int32), at.astype(np.int32)
            prints = rolled(self.words, n)[self.firsts[item] + at]
            order = np.argsort(prints, kind="stable")
            self.groups.append((n, prints[order], item[order], at[order]))

    def matches(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words of each text of a shard; rows (text, word, item, word in the item, length) of all longest matches, in order."""
        words, firsts = hashed_words(texts, WORD_BYTES)
        ends = np.repeat(firsts[1:], np.diff(firsts))
        found = [np.empty((0, 4), np.int64)]
        for n, prints, item, at in self.groups:
            suffixes = np.flatnonzero(np.arange(len(words)) + n <= ends)
            if not len(suffixes):
                continue
            own = rolled(words, n)[suffixes]
            order = np.argsort(own, kind="stable")
            suffixes, own = suffixes[order], own[order]
            if len(prints) <= len(own):  # each test suffix in the shard's array
                low, high = np.searchsorted(own, prints, "left"), np.searchsorted(own, prints, "right")
                test, k = _spread(high - low)
                place = suffixes[low[test] + k]
            else:
                low, high = np.searchsorted(prints, own, "left"), np.searchsorted(prints, own, "right")
                shard, k = _spread(high - low)
                place, test = suffixes[shard], low[shard] + k
            same = np.ones(len(place), bool)
            for j in range(n):
                same &= words[place + j] == self.words[self.firsts[item[test]] + at[test] + j]
            found.append(np.stack([place, item[test], at[test], np.full(len(test), n)], axis=1)[same].astype(np.int64))
        rows = np.concatenate(found)
        if len(rows):  # windows that follow one another in a text and an item are one match
            rows = rows[np.lexsort((rows[:, 0], rows[:, 0] - rows[:, 2], rows[:, 1]))]
            step = np.diff(rows, axis=0)
            new = np.r_[True, (step[:, 1] != 0) | (step[:, 0] != 1) | (step[:, 2] != 1)]
            heads = np.flatnonzero(new)
            rows[heads, 3] += np.diff(np.r_[heads, len(rows)]) - 1
            rows = rows[heads]
        text = np.searchsorted(firsts, rows[:, 0], "right") - 1
        rows = np.column_stack([text, rows[:, 0] - firsts[text], rows[:, 1:]])
        return np.diff(firsts), rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]


MATCH = StructType([StructField("start", LongType()), StructField("item_id", StringType()), StructField("item_start", LongType()), StructField("length", LongType())])


def _block(rows: DataFrame, items: list[tuple[str, str | None]], cfg: DecontamConfig, text: str, keep: list[str], hits_only: bool = False) -> DataFrame:
    """The columns to keep, with __n_words and __matches of the text against one block of items."""
    shared = Shared(rows.sparkSession, TestSuffixes(items, cfg.window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = shared.get()
        names = pa.array(test.names, pa.string())
        for batch in batches:
            for start, own in slices(batch.column(text)):
                sizes, found = test.matches(own)
                structs = pa.StructArray.from_arrays([pa.array(found[:, 1]), names.take(pa.array(found[:, 2])), pa.array(found[:, 3]), pa.array(found[:, 4])], names=["start", "item_id", "item_start", "length"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(found[:, 0], np.arange(len(own) + 1)).astype(np.int32)), structs)
                out = pa.RecordBatch.from_arrays([*(batch.column(c).slice(start, len(own)) for c in keep), pa.array(sizes), lists], names=[*keep, "__n_words", "__matches"])
                yield out.take(pa.array(np.unique(found[:, 0]))) if hits_only else out

    return rows.mapInArrow(run, StructType([*(rows.schema[c] for c in keep), StructField("__n_words", LongType()), StructField("__matches", ArrayType(MATCH))]))


def _blocks(benchmark: DataFrame, cfg: DecontamConfig) -> tuple[int, Callable[[int], list[tuple[str, str | None]]]]:
    """How many blocks, and the items of block b; an item is never cut, and one block at a time is on the driver."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // cfg.block_bytes) or 1
    return n, lambda b: [tuple(r) for r in (items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) if n > 1 else items).collect()]


def matches(docs: DataFrame, benchmark: DataFrame, cfg: DecontamConfig = DecontamConfig(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words and the longest verbatim matches (start, item_id, item_start, length) of every document."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    blocks, items = _blocks(benchmark, cfg)
    if blocks > 1:
        rows = write_table(rows.select(F.monotonically_increasing_id().alias("seq"), "doc_id", "text"), "decontam-rows")
    whole = _block(rows, items(0), cfg, "text", [c for c in rows.columns if c != "text"]).withColumnsRenamed({"__n_words": "n_words", "__matches": "matches"})
    if blocks == 1:
        return whole
    whole, rest = write_table(whole, "decontam-block"), None
    for b in range(1, blocks):
        part = write_table(_block(rows, items(b), cfg, "text", ["seq"], hits_only=True).select("seq", "__matches"), "decontam-block")
        rest = part if rest is None else rest.unionByName(part)
    rest = rest.groupBy("seq").agg(F.flatten(F.collect_list("__matches")).alias("more"))
    return whole.join(rest, "seq", "left").select("doc_id", "n_words", F.when(F.col("more").isNull(), F.col("matches")).otherwise(F.concat("matches", "more")).alias("matches"))


def summary(found: DataFrame) -> DataFrame:
    """One flat row per document from `matches`: hit words are the union of the matches' spans."""
    spans = F.sort_array(F.transform("matches", lambda m: F.struct(m["start"].alias("a"), (m["start"] + m["length"]).alias("b"))))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    n_hit = F.aggregate(spans, start, lambda s, x: F.struct((s["n"] + F.greatest(x["b"] - F.greatest(x["a"], s["end"]), F.lit(0))).alias("n"), F.greatest(s["end"], x["b"]).alias("end")), lambda s: s["n"])
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.size("matches") > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, cfg: DecontamConfig = DecontamConfig()) -> DataFrame:
    """The rows without a match, all columns kept; each row goes by its own matches, whatever its doc_id. Nothing is shuffled."""
    blocks, items = _blocks(benchmark, cfg)
    for b in range(blocks):
        docs = _block(docs, items(b), cfg, "text", docs.columns).filter(F.size("__matches") == 0).drop("__n_words", "__matches")
        if b + 1 < blocks:
            docs = write_table(docs, "decontam-clean")
    return docs


def summary_sql(window: int = 10) -> str:
    """DuckDB: windows as lists of words, joined by equality."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {words} AS w FROM benchmark),
d AS (SELECT doc_id, {words} AS w FROM documents),
t AS (SELECT item_id, least({window}, len(w)) AS k, unnest(list_transform(range(len(w) - least({window}, len(w)) + 1), lambda i: array_to_string(w[i + 1 : i + least({window}, len(w))], ' '))) AS g FROM b WHERE len(w) > 0),
k AS (SELECT DISTINCT k FROM t),
g AS (SELECT doc_id, k, unnest(range(len(w) - k + 1)) AS s, unnest(list_transform(range(len(w) - k + 1), lambda i: array_to_string(w[i + 1 : i + k], ' '))) AS g FROM d, k WHERE len(w) >= k),
h AS (SELECT g.doc_id, g.s, g.k, t.item_id FROM g JOIN t USING (k, g)),
n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS place FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)"""
