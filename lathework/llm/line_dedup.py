"""Substring dedup by hashing lines, paragraphs and sentences.

Texts are cut into units: lines, paragraphs (between blank lines) or sentences. A sentence begins behind a word that ends
in . ! or ? and before an upper-case letter, wherever lines break, so a passage set into the middle of another text or
wrapped anew begins and ends at units too. Of each kind of unit, the shortest runs of adjacent units with `min_words` words
at least are taken, one from each unit on and one up to each unit; a unit of so many words is such a run itself. A run is
normalised (A-Z lowered, words joined by one space), hashed to 128 bits and grouped over the whole corpus. Of equal runs
the one with the earliest rank (doc_id, then place in the text) stays, the others are removed, and the spans removed from
the original text are kept beside the new one. So every stretch of whole units that stands earlier goes if it has
`min_words` words, be it a line, a part of one or several; a shorter one stays, as do the ragged ends of a repeat that
begins or ends inside a sentence.

Equal runs of one slice of texts fall together before anything is shuffled, so a line that stands in a third of all
documents is one row for each slice. What is shuffled is the digests, once, and the texts, once.

Edge cases: null and empty texts stay as they are; a text all of whose units go becomes empty and its row stays; rows with a
null doc_id rank last, by a hash of the text; rows with the same doc_id, or without one and of equal text, share a rank, so
neither loses what only they share; an empty table gives an empty result; other columns pass through, but for
`removed_spans`, which this operator owns.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegralType, LongType, StringType, StructField, StructType

from lathework.llm.common import mix64, text_runs, write_table

U = np.uint64
#: Odd factors of the two digests.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SLICE_BYTES = 1 << 20


@dataclass(frozen=True)
class LineConfig:
    #: Words of the shortest run that goes.
    min_words: int = 20
    #: Of "line", "paragraph" and "sentence".
    units: tuple[str, ...] = ("line", "sentence")


SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))


@dataclass
class Words:
    """The words of several texts, one after another. Places are code points from the start of the first text."""

    starts: np.ndarray
    stops: np.ndarray
    hashes: np.ndarray
    #: Where each text's words begin (and the last one's end), and where the texts do.
    firsts: np.ndarray
    texts: np.ndarray
    #: For each kind of unit, whether a word begins one.
    begins: dict[str, np.ndarray]


def _members(points: np.ndarray, good) -> np.ndarray:
    """Whether good(character) holds, for each code point."""
    every = np.unique(points)
    return np.array([good(chr(p)) for p in every.tolist()], bool)[np.searchsorted(every, points)]


def read_words(texts: list[str], units: tuple[str, ...]) -> Words:
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    stops = np.flatnonzero(blank & np.r_[False, ~blank[:-1]])
    firsts = np.searchsorted(starts, bounds)
    if not len(starts):
        return Words(starts, stops, np.empty(0, U), firsts, bounds, {u: np.empty(0, bool) for u in units})
    low = np.where((points >= 65) & (points <= 90), points + 32, points).astype(U)
    at = np.arange(len(points)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(points)]))
    weights = mix64(np.arange(1, int(at.max()) + 2, dtype=U)) | U(1)
    sums = np.r_[U(0), np.cumsum(mix64((low + U(1)) * U(FACTORS[0])) * weights[at])]
    hashes = mix64(sums[stops] - sums[starts] + (stops - starts).astype(U))
    new = np.zeros(len(starts), bool)
    new[firsts[:-1][firsts[:-1] < firsts[1:]]] = True
    breaks = np.r_[0, np.cumsum(points == 10)]
    before = breaks[starts] - np.r_[0, breaks[stops[:-1]]]  # line breaks before each word
    upper, end = _members(points[starts], lambda c: unicodedata.category(c) == "Lu"), np.isin(points[stops - 1], [33, 46, 63])
    kinds = {"line": before > 0, "paragraph": before > 1, "sentence": upper | np.r_[True, end[:-1]]}
    return Words(starts, stops, hashes, firsts, bounds, {u: new | kinds[u] for u in units})


def runs_of(words: Words, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Words a to b (not included) of every run, in order: from each unit on, and up to each unit, the shortest of min_words words."""
    n, last = len(words.starts), len(words.firsts) - 1
    found = [np.empty(0, np.int64)]
    for flags in words.begins.values():
        begin = np.flatnonzero(flags)
        stop = np.r_[begin[1:], n]  # a text's last unit ends where the next text's first begins
        owner = np.searchsorted(words.firsts, begin, "right") - 1
        floor, roof = words.firsts[owner], words.firsts[np.minimum(owner + 1, last)]
        k = np.searchsorted(stop, begin + min_words)
        b = np.r_[stop, n + 1][k]
        found.append((begin * (n + 2) + b)[b <= roof])
        k = np.searchsorted(begin, stop - min_words, "right") - 1
        a = np.where(k >= 0, begin[np.maximum(k, 0)], -1)
        found.append((a * (n + 2) + stop)[a >= floor])
    return np.divmod(np.unique(np.concatenate(found)), n + 2)


def digests(words: Words, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    out, n = [], len(words.hashes)
    for k, factor in enumerate(FACTORS):
        powers = np.cumprod(np.r_[U(1), np.full(n, factor, U)])
        back = np.cumprod(np.r_[U(1), np.full(n, pow(factor, -1, 1 << 64), U)])
        sums = np.r_[U(0), np.cumsum((mix64(words.hashes ^ U(factor)) if k else words.hashes) * powers[:n])]
        out.append(mix64((sums[b] - sums[a]) * back[a] + (b - a).astype(U)).view(np.int64))
    return out


#: What is known of a run within its slice: it is the earliest there; an earlier document has it; its own document has it twice.
FIRST, GONE, AGAIN = 0, 1, 2


def slice_runs(texts: list[str], rank: np.ndarray, cfg: LineConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, d1, d2 and state of the runs of a slice: one FIRST for each digest, a GONE for each later rank, an AGAIN for each text that repeats it."""
    words = read_words(texts, cfg.units)
    a, b = runs_of(words, cfg.min_words)
    d1, d2 = digests(words, a, b)
    text = np.searchsorted(words.firsts, a, "right") - 1
    order = np.lexsort((a, text, rank[text], d2, d1))
    a, b, d1, d2, text = (x[order] for x in (a, b, d1, d2, text))
    n = len(a)
    if not n:
        return text, d1, d2, np.empty(0, np.int8)
    new = np.r_[True, (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])]
    own = new | np.r_[True, text[1:] != text[:-1]]  # first of its digest in its text
    leader, mine = np.maximum.accumulate(np.where(new, np.arange(n), 0)), np.maximum.accumulate(np.where(own, np.arange(n), 0))
    later = rank[text] > rank[text[leader]]
    twice = ~own & ~later & (a >= b[mine])
    twice &= np.r_[True, (mine[1:] != mine[:-1]) | ~twice[:-1]]
    keep = new | (own & later) | twice
    state = np.where(new, FIRST, np.where(own & later, GONE, AGAIN)).astype(np.int8)
    return text[keep], d1[keep], d2[keep], state[keep]


def covered(words: Words, cfg: LineConfig, gone: list[set[int]], again: list[set[int]]) -> np.ndarray:
    """Which words go, from the (first) digests of each text's runs that go altogether or from their second place on."""
    a, b = runs_of(words, cfg.min_words)
    d1 = digests(words, a, b)[0]
    text = np.searchsorted(words.firsts, a, "right") - 1
    change = np.zeros(len(words.starts) + 1, np.int64)
    ends = np.searchsorted(text, np.arange(len(gone) + 1))
    for i, (all_, later) in enumerate(zip(gone, again)):
        s = slice(ends[i], ends[i + 1])
        out = np.isin(d1[s], np.array(list(all_), np.int64))
        twice = np.flatnonzero(np.isin(d1[s], np.array(list(later - all_), np.int64)))
        twice = twice[np.argsort(d1[s][twice], kind="stable")]  # runs of a digest together, in their order
        if len(twice):
            new = np.r_[True, d1[s][twice][1:] != d1[s][twice][:-1]]
            first = twice[np.maximum.accumulate(np.where(new, np.arange(len(twice)), 0))]
            out[twice[a[s][twice] >= b[s][first]]] = True
        np.add.at(change, a[s][out], 1)
        np.add.at(change, b[s][out], -1)
    return np.cumsum(change[:-1]) > 0


def cut(words: Words, out: np.ndarray, i: int, text: str) -> tuple[str, list[tuple[int, int]]]:
    """Text i without the words that go, and their spans: with the blanks behind, at the end of the text with those before."""
    first, last = words.firsts[i], words.firsts[i + 1]
    edges = np.flatnonzero(np.diff(np.r_[False, out[first:last], False])) + first
    spans = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        start = 0 if a == first else int((words.stops[a - 1] if b == last else words.starts[a]) - words.texts[i])
        spans.append((start, len(text) if b == last else int(words.starts[b] - words.texts[i])))
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:start])
        at = end
    return "".join([*kept, text[at:]]), spans


def line_dedup(docs: DataFrame, cfg: LineConfig = LineConfig(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of docs with repeated units taken out of the text, and removed_spans (code points of the original text)."""
    kind = LongType() if isinstance(docs.schema[doc_id].dataType, IntegralType) else StringType()
    key = F.col(doc_id).cast(kind)
    mark = F.when(key.isNull(), F.xxhash64(F.col(text))).otherwise(F.lit(0).cast("long"))  # tells rows without an id

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, run in text_runs(batch.column(2), SLICE_BYTES):
                own = ["" if t is None else t for t in run.to_pylist()]
                ids, marks = (batch.column(c).slice(start, len(own)) for c in (0, 1))
                rank = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="min").to_numpy().astype(np.int64)
                rank = np.unique(np.stack([rank, marks.to_numpy()]), axis=1, return_inverse=True)[1].reshape(-1)
                which, d1, d2, state = slice_runs(own, rank, cfg)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(which)), marks.take(pa.array(which)), pa.array(d1), pa.array(d2), pa.array(state)], names=["doc", "mark", "d1", "d2", "state"])

    texts = docs.select(key.alias("doc"), mark.alias("mark"), F.col(text).cast("string").alias("text"))
    found = write_table(texts.mapInArrow(runs, f"doc {kind.simpleString()}, mark long, d1 long, d2 long, state byte"), "line-runs")
    # A digest has a row for each slice at most.
    rank = F.struct(F.col("doc").isNull().alias("unknown"), "doc", "mark")
    first = F.min(rank).over(Window.partitionBy("d1", "d2"))
    lost = found.filter(F.col("state") == FIRST).withColumn("first", first).filter(F.col("first") != rank)
    lost = lost.select("doc", "mark", "d1", F.lit(GONE).cast("byte").alias("state")).unionByName(found.filter(F.col("state") != FIRST).select("doc", "mark", "d1", "state"))
    digest = lambda state, name: F.collect_set(F.when(F.col("state") == state, F.col("d1"))).alias(name)
    gone = lost.groupBy(F.col("doc").alias("__doc"), F.col("mark").alias("__mark")).agg(digest(GONE, "__gone"), digest(AGAIN, "__again"))

    plain = docs.drop("removed_spans")
    # The digests are hashed partition by partition at every size, so no text is sorted.
    rows = plain.join(gone.hint("shuffle_hash"), key.eqNullSafe(F.col("__doc")) & (mark == F.col("__mark")), "left").select(*(plain[c] for c in plain.columns), F.col("__gone"), F.col("__again"))
    names = plain.columns
    place = names.index(text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            *own, gone_, again_ = batch.columns
            whole = own[place].cast(pa.string())
            known = pc.and_(gone_.is_valid(), whole.is_valid())
            hit = np.flatnonzero(known.to_numpy(zero_copy_only=False))
            spans, cleaned = [[] for _ in range(len(batch))], []
            for start, run in text_runs(whole.take(pa.array(hit)), SLICE_BYTES):
                some, texts = hit[start : start + len(run)].tolist(), run.to_pylist()
                words = read_words(texts, cfg.units)
                out = covered(words, cfg, [set(gone_[i].as_py()) for i in some], [set(again_[i].as_py()) for i in some])
                for k, i in enumerate(some):
                    left, found_ = cut(words, out, k, texts[k])
                    cleaned.append(left)
                    spans[i] = [{"start": a, "end": b} for a, b in found_]
            own[place] = pc.replace_with_mask(whole, known, pa.array(cleaned, pa.string()))
            yield pa.RecordBatch.from_arrays([*own, pa.array(spans, shape)], names=[*names, "removed_spans"])

    return rows.mapInArrow(clean, StructType([*plain.schema.fields, StructField("removed_spans", SPANS)]))


def summary(cleaned: DataFrame) -> DataFrame:
    spans = F.array_join(F.transform("removed_spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return cleaned.select("doc_id", "text", F.size("removed_spans").cast("long").alias("n_removed"), spans.alias("removed"))


def summary_sql(cfg: LineConfig = LineConfig()) -> str:
    """DuckDB: words with the units they begin, runs by nearest joins, equal runs numbered by rank, and the words that stay."""
    blank, n = r"[\x20\x09-\x0D]", cfg.min_words
    begins = {"line": "contains(before, chr(10))", "paragraph": rf"regexp_matches(before, '\n{blank}*\n')", "sentence": rf"(regexp_matches(before, '[.!?]{blank}*$') OR regexp_matches(token, '^\p{{Lu}}'))"}
    units = "\nUNION ALL ".join(f"SELECT doc_id, '{u}' AS kind, i AS a, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), total) AS b FROM w WHERE before IS NULL OR {begins[u]}" for u in cfg.units)
    return rf"""
WITH d AS (SELECT doc_id, text, length(text) AS size, regexp_extract_all(text, '[^\x20\x09-\x0D]+{blank}*') AS tokens FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, size, len(tokens) AS total, unnest(tokens) AS token, unnest(range(len(tokens))) AS i FROM d),
w AS (SELECT *, lag(token) OVER o AS before, size - sum(length(token)) OVER (PARTITION BY doc_id ORDER BY i DESC) AS start,
  translate(regexp_replace(token, '{blank}+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
l AS (SELECT doc_id, list(word ORDER BY i) AS words FROM w GROUP BY doc_id),
u AS ({units}),
r AS (SELECT s.doc_id, s.a, e.b FROM u s ASOF JOIN u e ON s.doc_id = e.doc_id AND s.kind = e.kind AND s.a + {n} <= e.b
  UNION SELECT e.doc_id, s.a, e.b FROM u e ASOF JOIN u s ON s.doc_id = e.doc_id AND s.kind = e.kind AND e.b - {n} >= s.a),
g AS (SELECT r.doc_id, a, b, array_to_string(words[a + 1 : b], ' ') AS run FROM r JOIN l USING (doc_id)),
k AS (SELECT doc_id, a, b, doc_id > min(doc_id) OVER (PARTITION BY run) OR a >= min(b) OVER (PARTITION BY run, doc_id) AS gone FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(a, b)) AS i FROM k WHERE gone),
m AS (SELECT w.*, c.i IS NOT NULL AS gone FROM w LEFT JOIN c USING (doc_id, i)),
p AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER o, false) AS opens, i - row_number() OVER (PARTITION BY doc_id, gone ORDER BY i) AS island FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 1 AS b, any_value(total) AS total, any_value(size) AS size FROM p WHERE gone GROUP BY doc_id, island),
t AS (SELECT s.doc_id, s.a, CASE WHEN s.a = 0 THEN 0 WHEN s.b = s.total THEN f.start - length(q.token) + length(q.word) ELSE f.start END AS start, coalesce(z.start, s.size) AS stop, s.b = s.total AS last
  FROM s JOIN w f ON f.doc_id = s.doc_id AND f.i = s.a LEFT JOIN w q ON q.doc_id = s.doc_id AND q.i = s.a - 1 LEFT JOIN w z ON z.doc_id = s.doc_id AND z.i = s.b),
o AS (SELECT doc_id, count(*) AS n_removed, bool_or(last) AS last, string_agg(CAST(start AS BIGINT) || '-' || CAST(stop AS BIGINT), ',' ORDER BY a) AS removed FROM t GROUP BY doc_id),
h AS (SELECT doc_id, string_agg(token, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept, any_value(size) - sum(length(token)) AS lead, bool_or(gone AND i = 0) AS opens FROM m GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN n_removed IS NULL THEN d.text ELSE regexp_replace((CASE WHEN opens THEN '' ELSE substr(d.text, 1, CAST(lead AS BIGINT)) END) || coalesce(kept, ''), CASE WHEN last THEN '{blank}+$' ELSE '$^x' END, '') END AS text,
  CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN o USING (doc_id) LEFT JOIN h USING (doc_id)"""
