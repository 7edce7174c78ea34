"""Embedding near-duplicates by hierarchical navigable small-world graphs, one for each shard.

Equal vectors of a label fall together first. The vectors of a label are dealt by hash into shards of about `shard_rows`;
each shard gets a graph, in a file of the shared folder. Every vector is then searched in every shard of its label: a task
takes a pair of shards, reads both graphs and searches each one's vectors in the other. A search is audited as it goes: a
beam that holds nothing but links is doubled, and so is one that misses the searched vector in its own shard; for each pair
of shards, a sample of vectors that have near ones is compared with brute force and the beam is doubled for all until the
recall asked for is reached. Where a beam would hold more than an eighth of the shard, that search is done by brute force, and
vectors that no links lead to are compared with every search. What is found is confirmed by cosine in double precision.

A task returns, of the links it found, how many each vector has and a spanning forest, so a dense group of m vectors gives
m rows and not its pairs. Components are united over the forests. Of each label, the share of the audited links that was
found is in the result (`recall`).

Bounds: a task holds two shards and a flag for each pair of their vectors. Searching every shard costs n * n / shard_rows
searches of a label, as the method says.

Edge cases: vectors that are null, zero or hold null or non-finite components, those without a label and those without an
id link with nothing: n_links 0, component_id their own id, kept. Vectors of different lengths aren't compared. Repeated
rows are other vectors at cosine 1; different vectors whose smallest vec_id is the same are one node, whose links add up (ids
are meant to be unique); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathework.llm.common import new_path, write_table
from lathework.llm.components import connected_components


@dataclass(frozen=True)
class HnswConfig:
    threshold: float = 0.98
    neighbours: int = 12
    build_beam: int = 48
    beam: int = 48
    shard_rows: int = 8192
    #: Audited searches for each pair of shards, and how far under the threshold their neighbours may lie.
    audit: int = 48
    audit_margin: float = 0.05
    recall: float = 0.995
    #: Searching tasks are no more than this, so that the scheduler holds them; beyond it a task searches several pairs of shards.
    most_tasks: int = 100_000


class Graph:
    """A small-world graph over unit vectors (float32); similarity is the inner product."""

    def __init__(self, vectors: np.ndarray, neighbours: int, build_beam: int, layers: list[np.ndarray] | None = None, heights: np.ndarray | None = None, entry: int = 0):
        self.v, self.m, self.build_beam = vectors, neighbours, build_beam
        self.seen, self.tick = np.zeros(len(vectors), np.int64), 0
        if layers is not None:
            self.layers, self.heights, self.entry = layers, heights, entry
            return
        n = len(vectors)
        rng = np.random.default_rng(n)
        self.heights = np.minimum(np.floor(-np.log(1 - rng.random(n)) / np.log(neighbours)), 6).astype(np.int64)
        self.layers = [np.full((n, self._width(h)), -1, np.int32) for h in range(int(self.heights.max(initial=0)) + 1)]
        self.entry = 0
        for i in range(1, n):
            self._insert(i)

    def _width(self, height: int) -> int:
        return self.m * 2 if height == 0 else self.m

    def beam(self, q: np.ndarray, starts: list[tuple[float, int]], width: int, height: int) -> list[tuple[float, int]]:
        """(similarity, node), best first."""
        self.tick += 1
        seen, tick, links, v = self.seen, self.tick, self.layers[height], self.v
        todo, best = [], []
        for s, i in starts:
            seen[i] = tick
            todo.append((-s, i))
            best.append((s, i))
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            s, i = heapq.heappop(todo)
            if len(best) >= width and -s < best[0][0]:
                break
            near = links[i]
            near = near[near >= 0]
            near = near[seen[near] != tick]
            if not len(near):
                continue
            seen[near] = tick
            sims = v[near] @ q
            for s, j in zip(sims.tolist(), near.tolist()):
                if len(best) < width:
                    heapq.heappush(best, (s, j))
                    heapq.heappush(todo, (-s, j))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, j))
                    heapq.heappush(todo, (-s, j))
        return sorted(best, reverse=True)

    def _choose(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Near neighbours that lie in different directions, filled up with the nearest others."""
        ids = [i for _, i in found]
        if len(ids) <= most:
            return ids
        block = self.v[ids]
        among = block @ block.T
        taken: list[int] = []
        for k, (s, _) in enumerate(found):
            if not taken or among[k, taken].max() < s:
                taken.append(k)
                if len(taken) == most:
                    break
        rest = [k for k in range(len(ids)) if k not in set(taken)]
        return [ids[k] for k in taken + rest[: most - len(taken)]]

    def _insert(self, i: int) -> None:
        q, top, own = self.v[i], int(self.heights[self.entry]), int(self.heights[i])
        now = [(float(self.v[self.entry] @ q), self.entry)]
        for h in range(top, own, -1):
            now = self.beam(q, now[:1], 1, h)
        for h in range(min(top, own), -1, -1):
            now = self.beam(q, now, self.build_beam, h)
            chosen = self._choose(now, self.m)
            links = self.layers[h]
            links[i, : len(chosen)] = chosen
            for j in chosen:
                row = links[j]
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = i
                else:
                    others = np.append(row, i)
                    sims = self.v[others] @ self.v[j]
                    ranked = sorted(zip(sims.tolist(), others.tolist()), reverse=True)
                    kept = self._choose(ranked, len(row))
                    row[:] = kept
        if own > top:
            self.entry = i

    def search(self, q: np.ndarray, width: int) -> list[tuple[float, int]]:
        now = [(float(self.v[self.entry] @ q), self.entry)]
        for h in range(int(self.heights[self.entry]), 0, -1):
            now = self.beam(q, now[:1], 1, h)
        return self.beam(q, now, width, 0)

    def cut_off(self) -> np.ndarray:
        """Nodes that the lowest layer's links don't reach from the entry."""
        reached = np.zeros(len(self.v), bool)
        at = np.array([self.entry])
        while len(at):
            reached[at] = True
            at = np.unique(self.layers[0][at])
            at = at[at >= 0]
            at = at[~reached[at]]
        return np.flatnonzero(~reached)

    def near(self, q: np.ndarray, floor: float, width: int, own: int = -1) -> list[int]:
        """Nodes of similarity `floor` at least; the beam widens while it holds nothing else, or misses `own`."""
        while width * 8 < len(self.v) or width <= 48:
            found = self.search(q, width)
            if found[-1][0] < floor and (own < 0 or any(i == own for _, i in found)):
                return [i for s, i in found if s >= floor]
            width *= 2
        return np.flatnonzero(self.v @ q >= floor).tolist()


def _pack(ids: np.ndarray, copies: np.ndarray, raw: np.ndarray, g: Graph) -> bytes:
    out = io.BytesIO()
    np.savez(out, ids=ids, copies=copies, raw=raw, heights=g.heights, entry=g.entry, **{f"layer{h}": x for h, x in enumerate(g.layers)})
    return out.getvalue()


def _unit(raw: np.ndarray) -> np.ndarray:
    wide = raw.astype(np.float64)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


@dataclass
class Shard:
    ids: np.ndarray
    #: How many rows hold each vector.
    copies: np.ndarray
    v: np.ndarray
    graph: Graph

    @staticmethod
    def read(data: bytes, cfg: HnswConfig) -> Shard:
        with np.load(io.BytesIO(data)) as x:
            v = _unit(x["raw"])
            layers = [x[f"layer{h}"] for h in range(sum(k.startswith("layer") for k in x.files))]
            return Shard(x["ids"], x["copies"], v, Graph(v.astype(np.float32), cfg.neighbours, cfg.build_beam, layers, x["heights"], int(x["entry"])))


@dataclass
class Audit:
    hit: int = 0
    total: int = 0
    beam: int = 0


def search_all(one: Shard, other: Shard, cfg: HnswConfig) -> tuple[np.ndarray, Audit]:
    """Whether each vector of `one` links with each of `other`, by searching the first in the graph of the second."""
    graph, same = other.graph, one is other
    queries = one.v.astype(np.float32)
    cut = graph.cut_off()
    apart = set(cut.tolist())

    def near(i: int, floor: float, width: int) -> set[int]:
        found = set(graph.near(queries[i], floor, width, i if same and i not in apart else -1))
        return found.union(cut[graph.v[cut] @ queries[i] >= floor].tolist()) if len(cut) else found

    floor = cfg.threshold - cfg.audit_margin
    tried = np.random.default_rng(len(one.ids)).permutation(len(one.ids))[: 32 * cfg.audit]
    close = one.v[tried] @ other.v.T >= floor
    if same:
        close[np.arange(len(tried)), tried] = False
    sample = np.flatnonzero(close.any(axis=1))[: cfg.audit]
    audit = Audit(beam=cfg.beam)
    while True:
        audit.hit = audit.total = 0
        for k in sample.tolist():
            want = set(np.flatnonzero(close[k]).tolist())
            audit.hit += len(want & near(int(tried[k]), floor, audit.beam))
            audit.total += len(want)
        if audit.hit >= cfg.recall * audit.total or audit.beam >= len(other.ids):
            break
        audit.beam *= 2
    links = np.zeros((len(one.ids), len(other.ids)), bool)
    for i in range(len(one.ids)):
        found = np.fromiter(near(i, cfg.threshold - 1e-4, audit.beam), np.int64)
        links[i, found[other.v[found] @ one.v[i] >= cfg.threshold]] = True
    return links, audit


def links_between(one: Shard, other: Shard, cfg: HnswConfig) -> tuple[np.ndarray, Audit]:
    """The links of two shards, searched both ways; of one shard with itself if both are the same."""
    links, audit = search_all(one, other, cfg)
    if one is other:
        np.fill_diagonal(links, False)
        return links | links.T, audit
    back, more = search_all(other, one, cfg)
    return links | back.T, Audit(audit.hit + more.hit, audit.total + more.total, max(audit.beam, more.beam))


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, column) that connect all that the links do; a row or column is looked at once."""
    out, rows, columns = [], links.any(axis=1), links.any(axis=0)
    for first in np.flatnonzero(rows).tolist():
        if not rows[first]:
            continue
        rows[first], todo = False, [(first, True)]
        while todo:
            at, is_row = todo.pop()
            new = np.flatnonzero((links[at] & columns) if is_row else (links[:, at] & rows)).tolist()
            (columns if is_row else rows)[new] = False
            out += [(at, j) if is_row else (j, at) for j in new]
            todo += [(j, not is_row) for j in new]
    return out


#: What a row of a pair of shards says: links of vector a (b of them); vectors a and b are linked; audited links found (a) of all (b).
DEGREE, LINK, AUDIT = 0, 1, 2


def embedding_near_duplicates(vectors: DataFrame, cfg: HnswConfig = HnswConfig()) -> DataFrame:
    """vec_id, n_links, component_id, kept and recall (of its label's audits; null without any) for every row of vectors (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    usable = F.coalesce(finite, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = write_table(rows.select("vec_id", F.when(usable, F.col("label")).alias("label"), F.when(usable, F.col("e")).alias("e")), "hnsw-rows")
    reps = rows.filter("e is not null").groupBy("label", "e").agg(F.min("vec_id").cast("long").alias("rep"), F.count("*").alias("copies")).withColumn("dim", F.size("e"))
    reps = write_table(reps, "hnsw-reps")
    counts = write_table(reps.groupBy("label", "dim").agg(F.ceil(F.count("*") / cfg.shard_rows).cast("int").alias("shards")), "hnsw-counts")
    dealt = reps.join(counts, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))
    kind = rows.schema["label"].dataType.simpleString()
    uri = new_path(spark, "hnsw-graphs")
    uri = uri if "://" in uri else "file://" + uri.removeprefix("file:")

    def build(pdf):
        import pandas as pd

        pdf = pdf.sort_values("rep")
        raw = np.stack(pdf["e"].to_numpy())
        graph = Graph(_unit(raw).astype(np.float32), cfg.neighbours, cfg.build_beam)
        store, folder = fs.FileSystem.from_uri(uri)
        store.create_dir(folder, recursive=True)
        name = f"{uuid.uuid4().hex}.npz"  # a repeated task leaves at most a file that no row names
        with store.open_output_stream(f"{folder}/{name}") as out:
            out.write(_pack(pdf["rep"].to_numpy(), pdf["copies"].to_numpy(), raw, graph))
        return pd.DataFrame({"label": pdf["label"].iloc[:1], "dim": pdf["dim"].iloc[:1], "shard": pdf["shard"].iloc[:1], "graph": [name]})

    graphs = dealt.select("label", "dim", "shard", "rep", "copies", "e").groupBy("label", "dim", "shard").applyInPandas(build, f"label {kind}, dim int, shard int, graph string")
    graphs = write_table(graphs, "hnsw-shards")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(uri)

        def read(name: str) -> Shard:
            with store.open_input_file(f"{folder}/{name}") as source:
                return Shard.read(source.read(), cfg)

        for batch in batches:
            for label, first, second in zip(batch.column("label"), *(batch.column(c).to_pylist() for c in ("one", "other"))):
                one = read(first)
                other = one if first == second else read(second)
                links, audit = links_between(one, other, cfg)
                out = [(AUDIT, audit.hit, audit.total, audit.beam)]
                out += [(LINK, int(one.ids[i]), int(other.ids[j]), None) for i, j in forest(links)]
                for ids, degree in ((one.ids, links @ other.copies),) + (() if one is other else ((other.ids, one.copies @ links),)):
                    out += [(DEGREE, int(ids[i]), int(degree[i]), None) for i in np.flatnonzero(degree).tolist()]
                what, a, b, beam = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array([label.as_py()] * len(out), label.type), pa.array(what, pa.int8()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(beam, pa.int64())], names=["label", "what", "a", "b", "beam"])

    # A shard is paired with those up to it, then meets the other's file name by its number: a label of many shards is no hot key.
    names = lambda shard, graph: graphs.select("label", "dim", F.col("shard").alias(shard), F.col("graph").alias(graph))
    pairs = names("i", "one").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("i")))).join(names("j", "other"), ["label", "dim", "j"]).select("label", "one", "other")
    total = counts.agg(F.sum(F.expr("bigint(shards) * (shards + 1) / 2"))).first()[0] or 0
    found = write_table(pairs.repartition(int(max(1, min(total, cfg.most_tasks)))).mapInArrow(search, f"label {kind}, what byte, a long, b long, beam long"), "hnsw-found")
    comps = connected_components(found.filter(F.col("what") == LINK).select("a", "b"))
    degree = found.filter(F.col("what") == DEGREE).groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("others"))
    audits = found.filter(F.col("what") == AUDIT).groupBy("label").agg(F.sum("a").alias("hit"), F.sum("b").alias("total"))
    named = reps.join(degree, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left").join(audits.select("label", (F.col("hit") / F.nullif("total", F.lit(0))).alias("recall")), "label", "left")
    named = write_table(named.select("label", "e", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("component"), "recall"), "hnsw-named")
    # Rows that take no part don't meet in one task by their null keys.
    out = rows.filter("e is not null").join(named, ["label", "e"], "left").select("vec_id", "n", "component", "recall")
    alone = rows.filter("e is null").select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").cast("long").alias("component"), F.lit(None).cast("double").alias("recall"))
    out = out.unionByName(alone)
    return out.select("vec_id", F.col("n").cast("long").alias("n_links"), F.col("component").cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"), "recall")
