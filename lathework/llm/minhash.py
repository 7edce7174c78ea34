"""MinHash near-duplicates with odd sketches.

Each document's word shingles give a MinHash sample. Bands of the sample propose candidates; an odd sketch (every sample
value flips one bit of a small bitmap) lets the population count of an XOR estimate a high similarity closely, which
drops poor candidates; what is left is confirmed on the full shingle sets.

Hot groups: exact copies fall together by set digest first. A bucket never emits all its pairs: its members are compared
with one hub, and only where the members of a hub's buckets are then still in several components (an open hub) are those
outside its largest component compared with all others across components, in blocks: a hub with n members of which r are
outside it costs about n * r / block rows, not the square of n. No member, bucket or candidate is capped.

Edge cases: a null or blank text has no shingle, links with nothing and is its own component; a text shorter than the
shingle is one shingle; rows with a null doc_id are kept, unlinked, with a null component_id and kept = true; repeated
rows are copies of each other; an empty table gives an empty result; columns other than the id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from lathework.llm.common import mix64, slices, write_table
from lathework.llm.components import connected_components

U = np.uint64


@dataclass(frozen=True)
class MinHashConfig:
    shingle: int = 5
    #: A link needs 100 * intersection >= percent * union.
    percent: int = 80
    bands: int = 32
    rows: int = 4
    sketch_bits: int = 512
    #: Candidates whose sketch estimate is under percent/100 less this go unconfirmed: about five standard errors of the estimate.
    slack: float = 0.22
    seed: int = 20240607
    #: Side of the blocks in which documents under an open hub are compared.
    block: int = 256


def _constants(cfg: MinHashConfig) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(cfg.seed)
    letters = rng.integers(1, 2**63, 256, dtype=np.uint64)
    factors = rng.integers(1, 2**63, cfg.bands * cfg.rows, dtype=np.uint64) * U(2) + U(1)
    return letters, factors


def shingle_sets(texts: list[bytes], k: int, letters: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text (lower-cased bytes; words are split at ASCII white space)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    space = (data == 32) | ((data >= 9) & (data <= 13))
    word = ~space
    starts = np.flatnonzero(word & np.r_[True, space[:-1]])
    stops = np.flatnonzero(space & np.r_[False, word[:-1]])
    if not len(starts):
        return [np.empty(0, U) for _ in texts]
    # Two rolling sums of a word's letters, weighted by position in the word through a running product.
    at = np.arange(len(data)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(data)]))
    weights = mix64(np.arange(1, int(at.max()) + 2, dtype=np.uint64)) | U(1)
    sums = np.r_[U(0), np.cumsum(letters[data] * weights[at])]
    words = mix64(sums[stops] - sums[starts] + (stops - starts).astype(np.uint64))
    first = np.searchsorted(starts, np.r_[0, ends[:-1]])
    last = np.searchsorted(starts, ends)
    n = max(0, len(words) - k + 1)
    rolled = np.full(n, U(k))
    for j in range(k):
        rolled = mix64(rolled * U(0x9E3779B97F4A7C15) + words[j : j + n])
    out = []
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            whole = np.full(1, U(b - a))
            for j in range(a, b):
                whole = mix64(whole * U(0x9E3779B97F4A7C15) + words[j : j + 1])
            out.append(whole)
        else:
            out.append(np.empty(0, U))
    return out


def _sample(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    low = np.full(len(factors), U(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(hashes), 1024):
        np.minimum(low, (hashes[i : i + 1024, None] * factors).min(axis=0), out=low)
    return low


FEATURES = StructType([StructField("n_shingles", LongType()), StructField("digest", BinaryType()), StructField("bands", ArrayType(LongType())), StructField("sketch", ArrayType(LongType()))])


def features(docs: DataFrame, cfg: MinHashConfig, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: the id and columns carried along, set size and digest, band keys and odd sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, factors = _constants(cfg)
        salt = mix64(np.arange(1, len(factors) + 1, dtype=np.uint64))
        for batch in batches:
            *own, texts = batch.columns
            for start, run_ in slices(texts):
                rows = []
                for s in shingle_sets(run_, cfg.shingle, letters):
                    if not len(s):
                        rows.append((0, None, None, None))
                        continue
                    low = mix64(_sample(s, factors) ^ salt)
                    keys = np.zeros(cfg.bands, U)
                    for j in range(cfg.rows):
                        keys = mix64(keys + low[j :: cfg.rows])
                    flips = np.bincount((low % U(cfg.sketch_bits)).astype(np.int64), minlength=cfg.sketch_bits) & 1
                    bits = np.packbits(flips.astype(np.uint8)).view(np.int64)
                    rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), keys.view(np.int64), bits))
                n, digest, bands, sketch = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(start, len(rows)) for c in own), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))],
                    names=["doc_id", *carry, *FEATURES.names],
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *carry, F.col(text).cast("string").alias("__text"))
    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], *FEATURES.fields]))


def _estimate(left: str, right: str, cfg: MinHashConfig):
    """Similarity from the XOR of two odd sketches."""
    odd = F.aggregate(F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    n, k = float(cfg.sketch_bits), float(cfg.bands * cfg.rows)
    return F.lit(1.0) + F.log(F.greatest(F.lit(1.0) - odd * (2.0 / n), F.lit(1e-9))) * (n / (4.0 * k))


def _confirmed(pairs: DataFrame, texts: DataFrame, cfg: MinHashConfig) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, _ = _constants(cfg)
        for batch in batches:
            a, b = batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()
            good = []
            for i in range(0, len(a), 64):
                own = {}
                need = [t for t in dict.fromkeys([*a[i : i + 64], *b[i : i + 64]])]
                for start, run_ in slices(need):
                    for j, s in enumerate(shingle_sets(run_, cfg.shingle, letters)):
                        own[need[start + j]] = s
                for x, y in zip(a[i : i + 64], b[i : i + 64]):
                    p, q = own[x], own[y]
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    good.append(100 * both >= cfg.percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _likely(pairs: DataFrame, reps: DataFrame, cfg: MinHashConfig) -> DataFrame:
    """Pairs (a, b) that the set sizes and the odd sketches don't rule out."""
    side = lambda c: reps.select(F.col("rep").alias(c), F.col("sketch").alias(f"s_{c}"), F.col("n_shingles").alias(f"n_{c}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * cfg.percent)
    return sized.filter(_estimate("s_a", "s_b", cfg) >= cfg.percent / 100.0 - cfg.slack).select("a", "b")


def _sets(texts: DataFrame, cfg: MinHashConfig) -> DataFrame:
    """(rep, hashes): each text's shingle set as sorted 32-bit hashes, for a close count before the exact one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, _ = _constants(cfg)
        for batch in batches:
            for start, run_ in slices(batch.column(1)):
                small = [np.unique((s >> U(32)).astype(np.uint32)).tobytes() for s in shingle_sets(run_, cfg.shingle, letters)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(small)), pa.array(small, pa.binary())], names=["rep", "hashes"])

    return texts.select("doc_id", "text").mapInArrow(run, "rep long, hashes binary")


def _cross_pairs(members: DataFrame, cfg: MinHashConfig) -> DataFrame:
    """Pairs of documents under one open hub that are in different components and look alike.

    members: hub, main, n_main, n_rest, rep, component, sketch, hashes. Those outside the hub's largest component (main) are
    compared with all others, those inside it with these only. Either part is cut into blocks by a hash; a task holds two.
    """
    floor, near = cfg.percent / 100.0 - cfg.slack, cfg.percent / 100.0 - 0.005
    # Where all fit one block, they are compared there: there is no main part then.
    members = members.withColumn("whole", F.col("n_main") + F.col("n_rest") <= cfg.block)
    inside = (F.col("component") == F.col("main")) & ~F.col("whole")
    cuts = [F.greatest(F.ceil(F.col(c) / cfg.block), F.lit(1)).cast("int") for c in ("n_main", "n_rest")]
    cells = members.withColumn("cut_main", F.when(F.col("whole"), 0).otherwise(cuts[0])).withColumn("cut_rest", cuts[1]).withColumn("inside", inside)
    cells = cells.withColumn("own", F.pmod(F.xxhash64("rep"), F.when(inside, F.col("cut_main")).otherwise(F.col("cut_rest"))).cast("int"))
    # Blocks of the main part have numbers from cut_rest on.
    own = F.when(F.col("inside"), F.col("own") + F.col("cut_rest")).otherwise(F.col("own"))
    last = F.when(F.col("inside"), F.col("cut_rest")).otherwise(F.col("cut_rest") + F.col("cut_main")) - 1
    cells = cells.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last))).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))

    def run(pdf):
        import pandas as pd

        m, k = cfg.sketch_bits, cfg.bands * cfg.rows
        ids, comp, own = (pdf[c].to_numpy() for c in ("rep", "component", "own"))
        bits = np.stack(pdf["sketch"].to_numpy()).view(np.uint64)
        sets = [np.frombuffer(x, np.uint32) for x in pdf["hashes"]]
        n = np.array([len(x) for x in sets])
        lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        found = []
        for i in left:
            j = right[(comp[right] != comp[i]) & (ids[right] > ids[i])] if lo == hi else right[comp[right] != comp[i]]
            j = j[np.minimum(n[j], n[i]) * 100 >= np.maximum(n[j], n[i]) * cfg.percent]
            odd = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1)
            j = j[1 + np.log(np.maximum(1 - odd * (2.0 / m), 1e-9)) * (m / (4.0 * k)) >= floor]
            if not len(j):
                continue
            every = np.concatenate([sets[x] for x in j])
            at = np.minimum(np.searchsorted(sets[i], every), n[i] - 1)
            both = np.add.reduceat((sets[i][at] == every).astype(np.int64), np.r_[0, np.cumsum(n[j])[:-1]])
            j = j[both >= near * (n[j] + n[i] - both)]
            found.append(np.stack([np.minimum(ids[j], ids[i]), np.maximum(ids[j], ids[i])], axis=1))
        pairs = np.concatenate(found) if found else np.empty((0, 2), np.int64)
        return pd.DataFrame(pairs, columns=["a", "b"])

    cells = cells.select("hub", "lo", "hi", "own", "rep", "component", "sketch", "hashes")
    return cells.groupBy("hub", "lo", "hi").applyInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, cfg: MinHashConfig = MinHashConfig(), doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept and the columns carried along, for every row of docs."""
    rows = write_table(features(docs, cfg, doc_id, text, carry), "minhash-rows")
    known = rows.filter("digest is not null and doc_id is not null")
    reps = write_table(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "minhash-reps")
    keyed = reps.select("rep", F.explode("bands").alias("key"))
    hubs = write_table(keyed.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).filter("n > 1"), "minhash-hubs")
    tried = write_table(keyed.join(hubs, "key").filter("hub <> rep").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "minhash-tried")
    likely = write_table(_likely(tried, reps, cfg), "minhash-likely")
    # All texts are dealt out once, to those that share a bucket; later steps narrow this table.
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    plain = _narrowed(plain, _ends(tried), "minhash-bucketed")
    links = _linked(likely, plain, cfg)
    comps = connected_components(links)

    # Buckets with one hub are looked at together: a document is in many buckets but under few hubs.
    wide = keyed.join(hubs.filter("n > 2"), "key").select("hub", "rep").distinct().join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    wide = write_table(wide.select("hub", "rep", F.coalesce("component", "rep").alias("component")), "minhash-wide")
    parts = wide.groupBy("hub", "component").agg(F.count("*").alias("k"))
    still = parts.groupBy("hub").agg(F.max(F.struct("k", "component")).alias("top"), F.sum("k").alias("n")).filter("n > top.k")
    still = write_table(still.select("hub", F.col("top.component").alias("main"), F.col("top.k").alias("n_main"), (F.col("n") - F.col("top.k")).alias("n_rest")), "minhash-open")
    if still.limit(1).count():
        members = write_table(wide.join(still, "hub"), "minhash-members")
        texts = _narrowed(plain, members.select(F.col("rep").alias("doc_id")).distinct(), "minhash-under").dropDuplicates(["doc_id"])
        members = members.join(reps.select("rep", "sketch"), "rep").join(_sets(texts, cfg), "rep")
        more = write_table(_cross_pairs(members, cfg).join(tried, ["a", "b"], "left_anti"), "minhash-cross")
        if more.limit(1).count():
            links = links.unionByName(_linked(more, plain, cfg))
            comps = connected_components(links)

    named = reps.select("digest", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    named = write_table(named, "minhash-named")
    plain = rows.select("doc_id", "n_shingles", "digest", *carry)
    out = plain.filter("digest is not null").join(named, "digest", "left")
    # Texts without a shingle link with nothing; they don't meet in one task by their null digest.
    out = out.unionByName(plain.filter("digest is null").withColumn("component", F.lit(None).cast("long")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), *carry)


def _narrowed(texts: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The rows of texts whose doc_id is among ids (distinct). The ids are hashed partition by partition at every size, so no text is sorted."""
    return write_table(texts.join(ids.hint("shuffle_hash"), "doc_id", "left_semi"), name)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()


def _linked(pairs: DataFrame, texts: DataFrame, cfg: MinHashConfig) -> DataFrame:
    """Confirmed pairs, reading the texts of the documents concerned only."""
    return write_table(_confirmed(pairs, _narrowed(texts, _ends(pairs), "minhash-texts"), cfg), "minhash-links")
