"""Queries over the test tables for the curation operators, and their DuckDB SQL.

The tables hold no videos, so each operator runs on a column of like shape: events are score series (a user is a video, value
the score), documents captions, conversations chats, part and documents sizes and durations, lineitem answers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lathework.functions import scalars as X
from lathework.operators import annotate, evaluate, examples, mix, packing, segments
from lathework.plans import canned, config
from lathework.sources import store
from lathework.streaming import segments as streaming

THRESHOLD, MAX_GAP = 100.0, 10
#: Events are days apart, and so are their segments' ends.
DAY = 86400.0
KEYS = ["user_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events as frames: seconds as a double, the score, and the event's number to break ties."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, d, "events").select("user_id", "event_id", seconds.alias("t"), "value", "event_type")


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return segments.gap_tolerant_segments(_events(spark, d), KEYS, "t", "value", THRESHOLD, MAX_GAP, order=["t", "event_id"])


ISLANDS = f"""
n AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
h AS (SELECT *, CASE WHEN n - lag(n) OVER (PARTITION BY user_id ORDER BY n) - 1 <= {MAX_GAP} THEN 0 ELSE 1 END AS opens FROM n WHERE value > {THRESHOLD}),
g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS segment FROM h),
s AS (SELECT user_id, CAST(segment AS BIGINT) AS segment, min(t) AS "start", max(t) AS "end", count(*) AS n_positive FROM g GROUP BY ALL)"""
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def digest(array: Column | str) -> Column:
    """md5 of an array's elements, comma-joined."""
    array = F.col(array) if isinstance(array, str) else array
    return F.md5(F.array_join(array.cast("array<string>"), ","))


def joined(array: str) -> str:
    return f"md5(array_to_string({array}, ','))"


def register(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- segments, words, names ---


@register(f"WITH {ISLANDS} SELECT * FROM s")
def segment_islands(spark, d):
    return _segments(spark, d)


@register(f"""WITH {ISLANDS}, l AS (SELECT user_id, max(t) AS last_t FROM n GROUP BY user_id)
SELECT user_id, segment, greatest("start" - 1.5, 0.0) AS "start", least("end" + 1.5, last_t) AS "end", n_positive FROM s JOIN l USING (user_id)""")
def segment_islands_buffered(spark, d):
    return segments.gap_tolerant_segments(_events(spark, d), KEYS, "t", "value", THRESHOLD, MAX_GAP, buffer=1.5, order=["t", "event_id"])


WORDS = "w AS (SELECT user_id, event_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE t END AS ws, CASE WHEN event_id % 11 = 0 THEN NULL ELSE t + 1 END AS we FROM n), f AS (SELECT user_id, event_id, event_type, coalesce(ws, we - 0.01) AS ws, coalesce(we, ws + 0.01) AS we FROM w WHERE ws IS NOT NULL OR we IS NOT NULL)"


def _words(spark, d):
    e = _events(spark, d)
    w = e.select("user_id", "event_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.col("t")).alias("ws"), F.when(F.col("event_id") % 11 != 0, F.col("t") + 1).alias("we"))
    return segments.fill_word_times(w)


@register(f"""WITH {ISLANDS}, {WORDS} SELECT user_id, segment, string_agg(event_type, ' ' ORDER BY event_id) AS caption, count(*) AS n_words
FROM s JOIN f USING (user_id) WHERE (ws >= "start" AND ws < "end") OR (we > "start" AND we <= "end") GROUP BY ALL""")
def segment_words(spark, d):
    found = segments.words_in_segments(_segments(spark, d), _words(spark, d), KEYS, bucket=DAY)
    return segments.caption_segments(found, ["user_id", "segment"], "event_type", "event_id", count="n_words")


@register(f"""WITH {ISLANDS}, {WORDS} SELECT user_id, segment, count(*) AS n_words FROM s JOIN f USING (user_id) WHERE ws BETWEEN "start" AND "end" AND we BETWEEN "start" AND "end" GROUP BY ALL""")
def segment_words_contained(spark, d):
    found = segments.words_in_segments(_segments(spark, d), _words(spark, d), KEYS, contained=True, bucket=DAY)
    return found.groupBy("user_id", "segment").agg(F.count("*").alias("n_words"))


@register(f"""WITH {ISLANDS} SELECT user_id, segment, user_id || '_' || CAST(round_even("start" / 2, 0) AS BIGINT) || '_' || CAST(round_even("end" / 2, 0) AS BIGINT) || '.mp4' AS clip FROM s""")
def segment_names(spark, d):
    return _segments(spark, d).select("user_id", "segment", X.clip_name("user_id", F.col("start") / 2, F.col("end") / 2).alias("clip"))


@register(f"""WITH {ISLANDS}, c AS (SELECT user_id || '_' || CAST(round_even("start", 0) AS BIGINT) || '_' || CAST(round_even("end", 0) AS BIGINT) AS clip FROM s)
SELECT clip || '.mp4' AS clip, regexp_extract(clip, '^(.*)_([0-9]+)_([0-9]+)$', 1) AS video_id, CAST(regexp_extract(clip, '^(.*)_([0-9]+)_([0-9]+)$', 3) AS BIGINT) - CAST(regexp_extract(clip, '^(.*)_([0-9]+)_([0-9]+)$', 2) AS BIGINT) AS seconds FROM c""")
def clip_info(spark, d):
    clip = X.clip_name("user_id", F.col("start"), F.col("end"))
    parts = F.regexp_extract(clip, r"^(.*)_([0-9]+)_([0-9]+)[.]mp4$", 3).cast("long") - F.regexp_extract(clip, r"^(.*)_([0-9]+)_([0-9]+)[.]mp4$", 2).cast("long")
    return _segments(spark, d).select(clip.alias("clip"), X.clip_parts(clip)["video_id"].alias("video_id"), parts.alias("seconds"))


@register(f"""WITH {ISLANDS} SELECT count(*) AS n, round(sum("end" - "start") / 3600, 4) AS hours, round(avg("end" - "start"), 4) AS mean_seconds FROM s""")
def length_stats(spark, d):
    out = evaluate.duration_stats(_segments(spark, d), "start", "end")
    return out.select("n", F.round("hours", 4).alias("hours"), F.round("mean_seconds", 4).alias("mean_seconds"))


# --- filters, joins, dedup ---


@register("SELECT doc_id FROM documents WHERE len(string_split(text, ' ')) >= 10")
def caption_min_words(spark, d):
    return mix.min_words(table(spark, d, "documents"), "text").select("doc_id")


@register("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.quality = 1, false)")
def relevance_filter(spark, d):
    judged = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").withColumn("is_relevant", F.col("quality") == 1)
    return mix.flagged(judged, "is_relevant").select("doc_id")


@register("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark, d):
    return segments.pending(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@register("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def has_scores_semi(spark, d):
    labels = table(spark, d, "labels")
    return segments.scored_not_transcribed(table(spark, d, "documents").select("doc_id"), labels, labels.filter("toxic = 1"), ["doc_id"])


@register("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'Warning: no source for ' || d.doc_id ELSE 'Success' END AS status FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def match_sources(spark, d):
    return segments.match_sources(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@register("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_first(spark, d):
    return mix.first_by_key(table(spark, d, "documents"), "text", ["doc_id"]).select("doc_id")


@register("SELECT max(doc_id) AS doc_id, min(doc_id) AS first_place FROM documents GROUP BY text")
def dedup_last(spark, d):
    return mix.last_by_key(table(spark, d, "documents"), "text", "doc_id").select("doc_id", "first_place")


@register("SELECT round(1 - count(DISTINCT text) / count(*), 9) AS duplicate_ratio, count(*) AS n_rows, count(DISTINCT text) AS n_kept FROM documents")
def dup_ratio(spark, d):
    out = mix.duplicate_ratio(table(spark, d, "documents"), "text")
    return out.select(F.round("duplicate_ratio", 9).alias("duplicate_ratio"), "n_rows", "n_kept")


MIX = (("en", 2.5), ("de", 0.29), ("fr", 1.0), ("es", 0.0))


@register(
    "WITH k AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY text ORDER BY CASE lang "
    + " ".join(f"WHEN '{k}' THEN {i}" for i, (k, _) in enumerate(MIX))
    + " END, doc_id) AS r FROM documents WHERE lang IN ('en', 'de', 'fr', 'es')), d AS (SELECT doc_id, lang FROM k WHERE r = 1), "
    + "n AS (SELECT lang, count(*) AS n FROM d GROUP BY lang) "
    + " UNION ALL ".join(
        f"SELECT doc_id, '{k}' AS dataset_mix_source, unnest(range(1, {int(r)} + 1)) AS copy FROM d WHERE lang = '{k}' UNION ALL SELECT doc_id, '{k}', 0 FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:{i}:' || doc_id), doc_id) AS r FROM d WHERE lang = '{k}') WHERE r <= (SELECT CAST(floor(CAST({r % 1!r} AS DOUBLE) * n) AS BIGINT) FROM n WHERE lang = '{k}')"
        for i, (k, r) in enumerate(MIX)
    )
)
def ratio_mix(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    parts = [mix.MixPart(docs.filter(F.col("lang") == k), r, k) for k, r in MIX]
    return mix.ratio_mix(parts, "doc_id", 42, dedup_key="text").select("doc_id", "dataset_mix_source", F.col("copy").cast("long").alias("copy"))


# --- shards and order ---

ROWS = "WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) "


def _numbered(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey")
    return mix.ranked(orders, ["o_orderkey"], "r").withColumn("i", F.col("r") - 1), orders.count()


@register(ROWS + "SELECT o_orderkey, CASE WHEN n // 7 = 0 THEN 6 ELSE least(i // greatest(n // 7, 1), 6) END AS shard FROM o")
def shard_ranges(spark, d):
    rows, n = _numbered(spark, d)
    return rows.select("o_orderkey", mix.contiguous_shard(F.col("i"), n, 7).cast("long").alias("shard"))


@register(ROWS + "SELECT o_orderkey, CASE WHEN n // 3 = 0 THEN 2 ELSE least(i // greatest(n // 3, 1), 2) END AS third FROM o")
def split_thirds(spark, d):
    rows, n = _numbered(spark, d)
    return rows.select("o_orderkey", mix.contiguous_shard(F.col("i"), n, 3).cast("long").alias("third"))


@register("SELECT o_orderkey, ntile(7) OVER (ORDER BY o_orderkey) - 1 AS part FROM orders")
def array_split(spark, d):
    rows, n = _numbered(spark, d)
    return rows.select("o_orderkey", mix.even_shard(F.col("i"), n, 7).cast("long").alias("part"))


@register("SELECT o_orderkey, row_number() OVER (ORDER BY md5('7:' || o_orderkey), o_orderkey) AS place FROM orders")
def seeded_shuffle(spark, d):
    return mix.ranked(table(spark, d, "orders").select("o_orderkey"), [mix.shuffle_key(7, "o_orderkey"), F.col("o_orderkey")], "place")


@register("SELECT doc_id, row_number() OVER (ORDER BY length(text) DESC, doc_id) AS place FROM documents")
def sort_by_length(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.length("text").alias("n"))
    return mix.ranked(rows, [F.col("n").desc(), F.col("doc_id")], "place").select("doc_id", "place")


@register("SELECT p_partkey AS original_index, p_name FROM part")
def merge_shards(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("original_index"), "p_name")
    shards = [part.filter(F.col("original_index") % 3 == k).withColumn("key", F.col("original_index")) for k in range(3)]
    return mix.merge_shards(shards, "key")


# --- media geometry ---


@register(f"SELECT p_partkey, {joined('list_transform(range(CAST(ceil(p_size / 0.5) AS BIGINT)), lambda i: CAST(i AS DOUBLE) * 0.5)')} AS times FROM part")
def frame_times(spark, d):
    return table(spark, d, "part").select("p_partkey", digest(X.frame_times("p_size")).alias("times"))


SIZES = "SELECT p_partkey, CAST(200 + (p_partkey * 37) % 1800 AS INT) AS w, CAST(120 + (p_partkey * 53) % 1400 AS INT) AS h, 1 + p_size * 20 AS frames, 24.0 + p_partkey % 7 AS fps, CAST(p_size AS BIGINT) * 700 AS n_frames FROM part"


def _sizes(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    return p.select("p_partkey", (200 + (k * 37) % 1800).cast("int").alias("w"), (120 + (k * 53) % 1400).cast("int").alias("h"), (1 + F.col("p_size") * 20).alias("frames"), (F.lit(24.0) + k % 7).alias("fps"), (F.col("p_size").cast("long") * 700).alias("n_frames"))


INDICES = "CASE WHEN n_frames / fps <= 420 THEN list_transform(range(CAST(ceil(n_frames / CAST(fps AS DOUBLE)) AS BIGINT)), lambda i: CAST(trunc(i * CAST(fps AS DOUBLE)) AS BIGINT)) ELSE list_transform(range(420), lambda i: CASE WHEN i = 419 THEN n_frames - 1 ELSE CAST(trunc(i * (CAST(n_frames - 1 AS DOUBLE) / 419)) AS BIGINT) END) END"


@register(f"SELECT p_partkey, {joined(INDICES)} AS indices FROM ({SIZES})")
def frame_indices(spark, d):
    return _sizes(spark, d).select("p_partkey", digest(X.frame_indices("n_frames", "fps")).alias("indices"))


@register(f"""WITH z AS (SELECT *, n_frames / fps AS duration FROM ({SIZES})), t AS (SELECT *, CAST(CASE WHEN duration <= 420 THEN ceil(n_frames / CAST(fps AS DOUBLE)) ELSE 420 END AS BIGINT) AS taken, 28 * (2 + w % 9) AS nw, 28 * (2 + h % 7) AS nh FROM z)
SELECT p_partkey, round(duration, 6) AS duration, fps, {'{before}'} AS tokens_before, taken, round(CASE WHEN duration <= 420 THEN 1.0 ELSE 420 / duration END, 9) AS frequency, CASE WHEN duration <= 420 THEN '1fps' ELSE 'uniform' END AS mode, nw AS width, nh AS height, {'{after}'} * taken AS total_tokens FROM t""".format(before="(CAST(ceil(w / 28.0) * ceil(h / 28.0) AS BIGINT) // 2)", after="(CAST(ceil(nw / 28.0) * ceil(nh / 28.0) AS BIGINT) // 2)"))
def video_metadata(spark, d):
    rows = _sizes(spark, d).withColumns({"nw": 28 * (2 + F.col("w") % 9), "nh": 28 * (2 + F.col("h") % 7)})
    m = rows.select("p_partkey", X.video_metadata("n_frames", "fps", "w", "h", "nw", "nh").alias("m")).select("p_partkey", "m.original", "m.processed")
    return m.select(
        "p_partkey", F.round("original.duration", 6).alias("duration"), "original.fps", F.col("original.tokens_per_frame").alias("tokens_before"), F.col("processed.frame_count").alias("taken"),
        F.round("processed.sampling_frequency", 9).alias("frequency"), F.col("processed.sampling_mode").alias("mode"), "processed.resolution.width", "processed.resolution.height", "processed.total_tokens",
    )


@register(f"""WITH z AS ({SIZES}), t AS (SELECT *, CAST(ceil(w / 28.0) * ceil(h / 28.0) AS BIGINT) // 2 AS per_frame FROM z)
SELECT p_partkey, per_frame, per_frame * frames AS total, CASE WHEN per_frame * frames > 16384 THEN 16384 // frames ELSE per_frame END AS budget FROM t""")
def token_budget(spark, d):
    rows = _sizes(spark, d).withColumn("per_frame", X.tokens_per_frame("w", "h")).withColumn("total", F.col("per_frame") * F.col("frames"))
    return rows.select("p_partkey", "per_frame", F.col("total").cast("long").alias("total"), X.budget_tokens(F.col("total"), F.col("frames"), F.col("per_frame"), 16384).alias("budget"))


def _tok(w: str, h: str) -> str:
    return f"(CAST(ceil({w} / 28.0) * ceil({h} / 28.0) AS BIGINT) // 2)"


def _snap(x: str) -> str:
    return f"greatest(round_even({x} / 28.0, 0) * 28, 56)"


@register(f"""WITH RECURSIVE z AS (SELECT p_partkey, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h, CAST(w AS DOUBLE) / h AS a, 10 + p_partkey % 200 AS target FROM ({SIZES})),
r AS (SELECT p_partkey, w, h, a, target, 0 AS i FROM z UNION ALL
 SELECT p_partkey, CASE WHEN h * 0.95 < 56 THEN nw WHEN w * 0.95 < 56 THEN greatest(round_even(nh * a, 0), 56) ELSE round_even(w * 0.95::DOUBLE, 0) END,
  CASE WHEN h * 0.95 < 56 THEN greatest(round_even(nw / a, 0), 56) WHEN w * 0.95 < 56 THEN nh ELSE round_even(h * 0.95::DOUBLE, 0) END, a, target, i + 1
 FROM (SELECT *, greatest(round_even(w * 0.95::DOUBLE, 0), round_even(56 * a, 0)) AS nw, greatest(round_even(h * 0.95::DOUBLE, 0), round_even(56 / a, 0)) AS nh FROM r WHERE {_tok('w', 'h')} > target AND i < 200)),
e AS (SELECT p_partkey, arg_max(w, i) AS w, arg_max(h, i) AS h, any_value(a) AS a, any_value(target) AS target FROM r GROUP BY p_partkey),
s AS (SELECT *, {_snap('w')} AS sw, {_snap('h')} AS sh FROM e),
k AS (SELECT *, CASE WHEN abs(sw / w - 1) > abs(sh / h - 1) THEN sw ELSE {_snap('(sh * a)')} END AS kw, CASE WHEN abs(sw / w - 1) > abs(sh / h - 1) THEN {_snap('(sw / a)')} ELSE sh END AS kh FROM s)
SELECT p_partkey, CAST(CASE WHEN {_tok('kw', 'kh')} <= target THEN kw WHEN kw > kh THEN kw - 28 ELSE {_snap('((kh - 28) * a)')} END AS INT) AS width,
 CAST(CASE WHEN {_tok('kw', 'kh')} <= target THEN kh WHEN kw > kh THEN {_snap('((kw - 28) / a)')} ELSE kh - 28 END AS INT) AS height FROM k""")
def fit_resolution(spark, d):
    rows = _sizes(spark, d).withColumn("target", (10 + F.col("p_partkey") % 200))
    return rows.withColumn("s", X.fit_resolution("w", "h", "target")).select("p_partkey", "s.width", "s.height")


# --- chat and text ---

PLAIN_CHAT = "m AS (SELECT conv_id, turn, role, text AS content FROM conversations UNION ALL SELECT conv_id, -1, 'system', 'You are a helpful assistant.' FROM conversations GROUP BY conv_id HAVING arg_min(role, turn) <> 'system')"


def _messages(spark, d):
    return examples.gather_messages(table(spark, d, "conversations"), "conv_id", "turn").withColumn("messages", examples.with_system("messages"))


@register(f"WITH {PLAIN_CHAT} SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10), '' ORDER BY turn) AS text FROM m GROUP BY conv_id")
def chat_render(spark, d):
    return _messages(spark, d).select("conv_id", examples.render("messages").alias("text"))


@register(f"WITH {PLAIN_CHAT} SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || content || '</s>' || chr(10), '' ORDER BY turn) || '<|assistant|>' || chr(10) AS text FROM m GROUP BY conv_id")
def template_alt(spark, d):
    return _messages(spark, d).select("conv_id", examples.render("messages", "role", generation_prompt=True).alias("text"))


@register("SELECT conv_id, md5(string_agg(role || ':' || text, '|' ORDER BY turn)) AS said FROM conversations GROUP BY conv_id")
def messages_from_json(spark, d):
    packed = examples.gather_messages(table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", F.to_json("messages").alias("j"))
    read = packed.select("conv_id", examples.messages_of("j", True).alias("m"))
    return read.select("conv_id", F.md5(F.array_join(F.transform("m", lambda m: F.concat_ws(":", m["role"], m["content"])), "|")).alias("said"))


@register("SELECT doc_id, md5(replace(replace(replace(text, 'th', 'TH'), 'THe', '<the>'), 'e', 'é')) AS replaced FROM documents")
def text_replace(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.replace_all("text", {"th": "TH", "THe": "<the>", "e": "é"})).alias("replaced"))


@register("SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) AS n FROM documents")
def placeholder_count(spark, d):
    return table(spark, d, "documents").select("doc_id", X.count_of("text", "the").alias("n"))


@register("SELECT page_id, string_split(regexp_replace(url, '^https?://', ''), '/')[1] AS source, string_split(url, '/')[-2] AS category FROM pages")
def url_source(spark, d):
    return table(spark, d, "pages").select("page_id", X.first_part(F.regexp_replace("url", "^https?://", "")).alias("source"), X.path_category("url").alias("category"))


@register("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def props_json(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@register("SELECT p_partkey, CAST(p_size AS BIGINT) AS num_frames, 28 * p_size AS width, 56 AS height, CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 2.5 END AS fps FROM part")
def media_notes(spark, d):
    listed = F.concat(F.lit('[{"num_frames":'), "p_size", F.lit(',"resolution":['), F.col("p_size") * 28, F.lit(",56]}]"))
    named = F.concat(F.lit('[{"num_frames":'), "p_size", F.lit(',"resolution":{"width":'), F.col("p_size") * 28, F.lit(',"height":56},"fps":2.5}]'))
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, listed).otherwise(named).alias("j"))
    return rows.select("p_partkey", F.inline(X.media_metas("j")))


PROMPT_SQL = "list_extract([" + ", ".join("'" + p.replace("'", "''") + "'" for p in examples.CAPTION_PROMPTS) + "], CAST(('0x' || substr(md5('clip/' || doc_id), 1, 8))::BIGINT % " + str(len(examples.CAPTION_PROMPTS)) + " AS INT) + 1)"


METAS_SQL = """'[{"num_frames":8,"resolution":{"width":280,"height":140},"fps":1.0}]'"""
CAPTION_SQL = f"'/videos/clip/' || doc_id AS video, {METAS_SQL} AS video_metas, '<video>' AS special FROM documents WHERE doc_id % 5 <> 0"


@register(f"""SELECT 'clip' AS source, md5('clip/' || doc_id || ':caption') AS message_id, 'caption' AS kind, 'user,assistant' AS roles, '<video>' || chr(10) || {PROMPT_SQL} || '|' || text AS said, {CAPTION_SQL}
UNION ALL SELECT 'clip', md5('clip/' || doc_id || ':qa'), 'qa', 'user,user,assistant', '<video>|' || 'Which language?|' || lang, {CAPTION_SQL} AND doc_id % 2 = 0""")
def caption_examples(spark, d):
    pair = F.struct(F.lit("Which language?").alias("question"), F.lit(None).cast("string").alias("answer"), F.col("lang").alias("correct_answer"))
    items = table(spark, d, "documents").select(
        F.concat(F.lit("clip/"), "doc_id").alias("video"), F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("caption"),
        F.when(F.col("doc_id") % 2 == 0, F.array(pair)).otherwise(F.array().cast("array<struct<question:string,answer:string,correct_answer:string>>")).alias("qa_pairs"),
        F.lit(8).alias("num_frames"), F.lit(280).alias("width"), F.lit(140).alias("height"), F.lit(1.0).alias("fps"),
    )
    rows = examples.training_examples(items, "/videos")
    return rows.select("source", "message_id", "kind", F.array_join("messages.role", ",").alias("roles"), F.array_join("messages.content", "|").alias("said"), F.array_join("videos", ",").alias("video"), "video_metas", F.array_join("special_tokens", ",").alias("special"))


@register("""SELECT doc_id, CASE WHEN lower(CASE WHEN doc_id % 3 = 0 THEN 'Yes' ELSE lang END) IN ('yes', 'no') THEN 'Question: ' || source || chr(10) || 'Choose Yes or No.'
ELSE 'Question: ' || source || chr(10) || 'Options: A: en' || chr(10) || 'B: de' || chr(10) || 'C: fr' || chr(10) || 'D: es' || chr(10) || 'Choose A, B, C, or D.' END AS prompt FROM documents""")
def question_prompts(spark, d):
    answer = F.when(F.col("doc_id") % 3 == 0, F.lit("Yes")).otherwise(F.col("lang"))
    return table(spark, d, "documents").select("doc_id", X.question_prompt("source", answer, [F.lit(x) for x in ("en", "de", "fr", "es")]).alias("prompt"))


@register("SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS pred FROM conversations")
def clean_generations(spark, d):
    raw = F.concat(F.lit("user\nhi\nassistant\n "), "text", F.lit("<|im_end|>\n</s> rest"))
    return table(spark, d, "conversations").select("conv_id", "turn", X.clean_generation(raw).alias("pred"))


# --- tokens, labels, packing ---

IDS = "list_transform(list_filter(regexp_split_to_array({0}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''), lambda w: CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % 32000 AS INT))"


@register(f"SELECT conv_id, turn, {joined(IDS.format('text'))} AS ids FROM conversations")
def tokenize(spark, d):
    return packing.tokenize(table(spark, d, "conversations"), "text").select("conv_id", "turn", digest("input_ids").alias("ids"))


MEDIA = "list_transform(range((1 + p_size % 5) * ((p_partkey + {0}) % 3)), lambda i: CAST(151656 AS INT))"


@register(f"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '<|pad|>' || p_name || ' <|pad|> end' ELSE '<|pad|>' || p_name END AS text, {joined(f"CASE WHEN p_partkey % 3 = 0 THEN {MEDIA.format(0)} || {IDS.format('p_name')} || {MEDIA.format(1)} || {IDS.format("'end'")} ELSE {MEDIA.format(0)} || {IDS.format('p_name')} END")} AS ids FROM part""")
def media_tokens(spark, d):
    two = F.col("p_partkey") % 3 == 0
    note = lambda k: F.concat(F.lit('{"num_frames":'), (F.col("p_partkey") + k) % 3, F.lit(',"resolution":['), 28 * (1 + F.col("p_size") % 5), F.lit(",56]}"))
    rows = table(spark, d, "part").select(
        "p_partkey", F.when(two, F.concat(F.lit("<video>"), "p_name", F.lit(" <video> end"))).otherwise(F.concat(F.lit("<video>"), "p_name")).alias("text"),
        F.concat(F.lit("["), F.when(two, F.concat(note(0), F.lit(","), note(1))).otherwise(note(0)), F.lit("]")).alias("metas"),
    )
    return packing.tokenize_media(rows, "text", "metas", "<video>", "<|pad|>", 151656).select("p_partkey", "text", digest("input_ids").alias("ids"))


@register(f"SELECT conv_id, turn FROM conversations WHERE len({IDS.format('text')}) <= 64")
def long_filter(spark, d):
    return packing.tokenize(table(spark, d, "conversations"), "text").filter(F.size("input_ids") <= 64).select("conv_id", "turn")


BOS, EOS = [40001, 40002], [40003]
MASKED = f"""t AS (SELECT conv_id, turn, role, {IDS.format('text')} AS x FROM conversations),
u AS (SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN [40001, 40002] ELSE [40000] END || x || [40003] AS ids, CASE WHEN role = 'assistant' THEN [-100, -100] || x || [40003] ELSE list_transform(range(len(x) + 2), lambda i: CAST(-100 AS INT)) END AS labels FROM t),
c AS (SELECT conv_id, flatten(list(ids ORDER BY turn)) AS ids, flatten(list(labels ORDER BY turn)) AS labels FROM u GROUP BY conv_id)"""


def _labelled(spark, d):
    turns = packing.tokenize(table(spark, d, "conversations"), "text")
    opens = F.when(F.col("role") == "assistant", F.array(*map(F.lit, BOS))).otherwise(F.array(F.lit(40000)))
    turns = turns.select("conv_id", "turn", F.concat(opens, "input_ids", F.array(*map(F.lit, EOS))).alias("ids"))
    whole = turns.groupBy("conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "ids"))), lambda x: x["ids"])).alias("input_ids"))
    return whole.withColumn("labels", X.mask_labels("input_ids", BOS, EOS))


@register(f"WITH {MASKED} SELECT conv_id, {joined('ids')} AS ids, {joined('labels')} AS labels FROM c")
def label_mask(spark, d):
    return _labelled(spark, d).select("conv_id", digest("input_ids").alias("ids"), digest("labels").alias("labels"))


@register(f"WITH {MASKED} SELECT conv_id, {joined("CASE WHEN ('0x' || substr(md5(CAST(conv_id AS VARCHAR)), 1, 8))::BIGINT < CAST(floor(0.3 * 4294967296) AS BIGINT) THEN ids ELSE labels END")} AS labels FROM c")
def unmasked_share(spark, d):
    rows = _labelled(spark, d)
    return rows.select("conv_id", digest(packing.maybe_unmasked(F.col("labels"), F.col("input_ids"), F.col("conv_id"), 0.3)).alias("labels"))


@register(f"WITH {MASKED} SELECT max(n) AS max_seqlen, CAST(sum(n) AS BIGINT) AS total FROM (SELECT CAST(len(list_filter(labels, lambda x: x <> -100)) AS INT) AS n FROM c)")
def mask_lengths(spark, d):
    return evaluate.mask_lengths(_labelled(spark, d).withColumn("mask", F.transform("labels", lambda x: x != X.IGNORE)), "mask")


@register("SELECT DISTINCT conv_id FROM conversations WHERE role = 'assistant'")
def all_masked_drop(spark, d):
    return _labelled(spark, d).filter(X.any_target("labels")).select("conv_id")


@register(f"WITH {MASKED} SELECT conv_id, {joined('list_filter(labels[2:], lambda x: x <> -100)')} AS targets FROM c")
def shifted_labels(spark, d):
    return _labelled(spark, d).select("conv_id", digest(X.shifted_targets("labels")).alias("targets"))


CAPACITY = 16384
LENGTHS = "SELECT doc_id, CAST(coalesce(len(string_split(text, ' ')), 0) AS BIGINT) AS n FROM documents"
#: Texts over CAPACITY as whole chunks; idx is the row's number, part the chunk's start.
ITEMS = f"""SELECT doc_id AS idx, part, CASE WHEN part IS NULL THEN CAST(doc_id AS VARCHAR) ELSE doc_id || ':' || part END AS name, CASE WHEN part IS NULL THEN n ELSE least(n - part, {CAPACITY}) END AS n
FROM (SELECT doc_id, n, unnest(CASE WHEN n > {CAPACITY} THEN range(0, n, {CAPACITY}) ELSE [NULL] END) AS part FROM ({LENGTHS}))"""


def ffd_sql(items: str, capacity: int) -> str:
    """CTE r(grp, i, name, bin_id) of first-fit decreasing: items (idx, part, name, n) in their order, with the free space of all bins carried along."""
    return f"""l AS (SELECT idx // {packing.GROUP_ROWS} AS grp, name, n, row_number() OVER (ORDER BY idx // {packing.GROUP_ROWS}, n DESC, idx, part) AS i FROM ({items})),
b AS (SELECT i, grp, name, CAST(1 AS BIGINT) AS place, [{capacity} - n] AS free FROM l WHERE i = 1 UNION ALL
 SELECT i, grp, name, place, CASE WHEN place > len(free) THEN free || [{capacity} - n] ELSE free[1 : place - 1] || [free[place] - n] || free[place + 1 :] END
 FROM (SELECT l.i, l.grp, l.name, l.n, CASE WHEN l.grp = b.grp THEN b.free ELSE [] END AS free,
  CASE WHEN l.grp = b.grp THEN coalesce(nullif(list_position(list_transform(b.free, lambda f: f >= l.n), true), 0), len(b.free) + 1) ELSE 1 END AS place FROM b JOIN l ON l.i = b.i + 1)),
r AS (SELECT grp, i, name, CAST(grp * 1099511627776 + place - 1 AS BIGINT) AS bin_id FROM b)"""


def _lengths(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.size(F.split("text", " ", -1)), F.lit(0)).cast("long").alias("n"))


def _packed(spark, d, method):
    """members: doc_id, or doc_id:start for each chunk of a text over CAPACITY."""
    bins = packing.pack(packing.chunks(_lengths(spark, d), "n", CAPACITY), "doc_id", "n", CAPACITY, method, start="start")
    names = F.zip_with("index_bins", "start_bins", lambda i, s: F.concat_ws(":", i.cast("string"), s.cast("string")))
    return bins.select("bin_id", F.array_join(names, ",").alias("members"))


@register(f"WITH RECURSIVE {ffd_sql(ITEMS, CAPACITY)} SELECT bin_id, string_agg(name, ',' ORDER BY i) AS members FROM r GROUP BY bin_id")
def pack_ffd(spark, d):
    return _packed(spark, d, "ffd")


@register(f"""WITH RECURSIVE l AS (SELECT idx // {packing.GROUP_ROWS} AS grp, name, n, row_number() OVER (ORDER BY idx, part) AS i FROM ({ITEMS})),
r AS (SELECT i, grp, name, n AS used, CAST(grp * 1099511627776 AS BIGINT) AS bin_id FROM l WHERE i = 1 UNION ALL
SELECT l.i, l.grp, l.name, CASE WHEN l.grp <> r.grp OR r.used + l.n > {CAPACITY} THEN l.n ELSE r.used + l.n END, CAST(CASE WHEN l.grp <> r.grp THEN l.grp * 1099511627776 WHEN r.used + l.n > {CAPACITY} THEN r.bin_id + 1 ELSE r.bin_id END AS BIGINT) FROM r JOIN l ON l.i = r.i + 1)
SELECT bin_id, string_agg(name, ',' ORDER BY i) AS members FROM r GROUP BY bin_id""")
def pack_next_fit(spark, d):
    return _packed(spark, d, "next_fit")


@register(f"WITH {PLAIN_CHAT}, l AS (SELECT conv_id, list(length(content) ORDER BY turn) AS l FROM m GROUP BY conv_id) SELECT conv_id, CAST(list_sum(l) AS BIGINT) AS total, CAST(len(l) + 1 AS BIGINT) AS n_starts, CAST(list_sum(list_transform(l, lambda x: x * (x - 1) // 2)) AS BIGINT) AS positions FROM l")
def cu_seqlens(spark, d):
    rows = _messages(spark, d).select("conv_id", F.transform("messages", lambda m: F.length(m["content"])).alias("l"))
    starts, positions = X.starts_from_lengths("l"), X.position_ids("l")
    rows = rows.select("conv_id", starts.alias("s"), positions.alias("p"))
    same = F.transform(X.starts_from_positions("p"), lambda x: x.cast("long")) == F.col("s")
    return rows.select("conv_id", F.when(same, F.element_at("s", -1)).alias("total"), F.size("s").cast("long").alias("n_starts"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x).alias("positions"))


PAD = "{0} || list_transform(range((128 - len({0}) % 128) % 128), lambda i: CAST({1} AS INT))"


@register(f"SELECT doc_id, n, (128 - n % 128) % 128 AS pads, {joined(PAD.format('l', 0))} AS ids FROM (SELECT doc_id, n, list_transform(range(n), lambda i: CAST(i % 9 + 1 AS INT)) AS l FROM ({LENGTHS}))")
def pad128(spark, d):
    rows = _lengths(spark, d).withColumn("pads", X.pad_length("n"))
    own = F.transform(F.array_repeat(F.lit(1), F.col("n").cast("int")), lambda _, i: i % 9 + 1)
    return rows.select("doc_id", "n", F.col("pads").cast("long").alias("pads"), digest(X.pad_right(own, (F.col("n") + F.col("pads")).cast("int"), 0)).alias("ids"))


@register(f"""WITH RECURSIVE {MASKED}, {ffd_sql('SELECT conv_id AS idx, 0 AS part, conv_id AS name, CAST(len(ids) AS BIGINT) AS n FROM c', 4096)},
m AS (SELECT r.bin_id, r.i, c.ids, c.labels, c.conv_id, sum(len(c.ids)) OVER (PARTITION BY r.bin_id ORDER BY r.i) AS stop, first_value(c.conv_id) OVER (PARTITION BY r.bin_id ORDER BY r.i) AS head FROM r JOIN c ON c.conv_id = r.name),
f AS (SELECT bin_id, flatten(list(ids ORDER BY i)) AS ids, flatten(list(labels ORDER BY i)) AS labels, flatten(list(range(len(ids)) ORDER BY i)) AS positions, [0] || list(CAST(stop AS BIGINT) ORDER BY i) AS starts,
 CASE WHEN any_value(head) % 2 = 0 THEN coalesce(string_agg('v' || conv_id, ',' ORDER BY i) FILTER (WHERE conv_id % 2 = 0), '') END AS videos FROM m GROUP BY bin_id)
SELECT bin_id, {joined(PAD.format('ids', 0))} AS input_ids, {joined(PAD.format('list_transform(ids, lambda i: CAST(1 AS INT))', 0))} AS attention_mask, {joined(PAD.format('positions', 0))} AS position_ids, {joined(PAD.format('labels', -100))} AS labels, array_to_string(starts, ',') AS cu_seqlens, videos FROM f""")
def collate_bins(spark, d):
    rows = _labelled(spark, d).withColumns({"n": F.size("input_ids"), "videos": F.when(F.col("conv_id") % 2 == 0, F.array(F.concat(F.lit("v"), "conv_id")))})
    rows = store.write_table(rows, "labelled")  # packed, and then joined to its bins
    bins = packing.pack(rows.select("conv_id", "n"), "conv_id", "n", 4096)
    out = packing.collate(packing.bin_rows(bins, rows, "conv_id"))
    flags = F.transform("attention_mask", lambda x: x.cast("int"))
    return out.select("bin_id", digest("input_ids").alias("input_ids"), digest(flags).alias("attention_mask"), digest("position_ids").alias("position_ids"), digest("labels").alias("labels"), F.array_join(F.col("cu_seqlens").cast("array<string>"), ",").alias("cu_seqlens"), F.array_join("videos", ",").alias("videos"))


@register(f"""WITH {PLAIN_CHAT}, l AS (SELECT conv_id, turn, CAST(length(content) AS BIGINT) AS n, sum(length(content)) OVER (PARTITION BY conv_id ORDER BY turn) AS stop FROM m),
s AS (SELECT conv_id, [0] || list(CAST(stop AS BIGINT) ORDER BY turn) AS s, list(n ORDER BY turn) AS l FROM l GROUP BY conv_id)
SELECT conv_id, array_to_string(s, ',') AS from_masks, array_to_string(s || list_transform(s[2:], lambda x: x + s[-1]), ',') AS combined,
 {joined("flatten(list_transform(range(1, len(s)), lambda i: range(s[i], (s[i] + s[i + 1]) // 2)))")} AS front, {joined("flatten(list_transform(range(1, len(s)), lambda i: range((s[i] + s[i + 1]) // 2, s[i + 1])))")} AS back FROM s""")
def packed_offsets(spark, d):
    lengths = F.transform("messages", lambda m: F.length(m["content"]))
    masks = F.transform(lengths, lambda n: F.concat(F.array_repeat(F.lit(True), n), F.array(F.lit(False))))
    rows = _messages(spark, d).select("conv_id", X.starts_from_masks(masks).alias("m"), X.starts_from_lengths(lengths).alias("s"))
    rows = rows.withColumn("two", X.combine_starts(F.array("s", "s")))
    return rows.select("conv_id", F.array_join(F.col("m").cast("array<string>"), ",").alias("from_masks"), F.array_join(F.col("two").cast("array<string>"), ",").alias("combined"), digest(X.half_index("s", True)).alias("front"), digest(X.half_index("s", False)).alias("back"))


# --- evaluation, metrics, vectors ---

JUDGED = "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'Yes' ELSE l_linestatus || 'pen' END AS answer, CASE WHEN l_linenumber % 3 = 0 THEN 'yes, it is' WHEN l_linenumber % 3 = 1 THEN 'Open' ELSE 'B: fpen' END AS pred, CASE WHEN l_linestatus = 'F' THEN 'B' ELSE 'A' END AS correct_option FROM lineitem"


def _judged(spark, d):
    status, line = F.col("l_linestatus"), F.col("l_linenumber")
    return table(spark, d, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", "Yes").otherwise(F.concat(status, F.lit("pen"))).alias("answer"),
        F.when(line % 3 == 0, "yes, it is").when(line % 3 == 1, "Open").otherwise("B: fpen").alias("pred"), F.when(status == "F", "B").otherwise("A").alias("correct_option"), (line % 3).alias("gpt_score"),
    )


@register(f"SELECT round(coalesce(avg(CASE WHEN CASE WHEN lower(answer) IN ('yes', 'no') THEN starts_with(lower(pred), lower(answer)) ELSE starts_with(pred, correct_option) OR starts_with(lower(pred), lower(answer)) END THEN 1.0 ELSE 0.0 END), 0), 9) AS accuracy, count(*) AS n FROM ({JUDGED})")
def eval_accuracy(spark, d):
    return evaluate.accuracy(_judged(spark, d)).select(F.round("accuracy", 9).alias("accuracy"), "n")


@register("SELECT round(avg(l_linenumber % 3) * 100, 6) AS score, count(*) AS n FROM lineitem WHERE l_linenumber % 3 IN (0, 1)")
def judge_mean(spark, d):
    return evaluate.judge_mean(_judged(spark, d)).select(F.round("score", 6).alias("score"), "n")


@register("WITH b AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents) SELECT CAST(least(floor(CAST(n_chars - lo AS DOUBLE) * 50 / (hi - lo)) + 1, 50) AS INT) AS bucket, count(*) AS n FROM documents, b GROUP BY 1")
def histogram50(spark, d):
    return evaluate.histogram(table(spark, d, "documents"), "n_chars", 50)


@register("SELECT CASE WHEN user_id % 2 = 0 THEN 'train' ELSE 'eval' END AS phase, event_type AS key, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def mean_metrics(spark, d):
    log = table(spark, d, "events").select(F.when(F.col("user_id") % 2 == 0, "train").otherwise("eval").alias("phase"), F.col("event_type").alias("key"), "value")
    return evaluate.mean_metrics(log).select("phase", "key", F.round("mean", 6).alias("mean"))


@register("SELECT round(avg(m), 6) AS mean_of_means, count(*) AS n_groups FROM (SELECT avg(value) AS m FROM events GROUP BY user_id)")
def mean_of_means(spark, d):
    return evaluate.mean_of_means(table(spark, d, "events"), "user_id", "value").select(F.round("mean_of_means", 6).alias("mean_of_means"), "n_groups")


@register("WITH t AS (SELECT user_id, max(value) AS top FROM events GROUP BY user_id) SELECT user_id, round(any_value(top) + ln(sum(exp(value - top))), 6) AS lse FROM events JOIN t USING (user_id) GROUP BY user_id")
def log_sum_exp(spark, d):
    return evaluate.log_sum_exp(table(spark, d, "events"), ["user_id"], "value").select("user_id", F.round("lse", 6).alias("lse"))


PAIRS = "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) / {t})) AS e FROM embeddings), s AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM v), k AS (SELECT a.vec_id, a.p, b.p AS q FROM s a JOIN s b ON b.vec_id = a.vec_id + 1) "


def _pairs(spark, d, temperature):
    p = table(spark, d, "embeddings").select("vec_id", X.softmax(F.transform("embedding", lambda x: x.cast("double")), temperature).alias("p"))
    return p.join(p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q")), "vec_id")


@register(PAIRS.format(t="0.5") + "SELECT vec_id, round(1 - list_sum(list_transform(range(1, len(p) + 1), lambda i: abs(p[i] - q[i]))) / 2, 6) AS rate FROM k")
def acceptance_rate(spark, d):
    return _pairs(spark, d, 0.5).select("vec_id", F.round(X.acceptance_rate("p", "q"), 6).alias("rate"))


@register("""WITH v AS (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
w AS (SELECT vec_id, i, CASE WHEN i IN (3, 5, vec_id % 64) THEN CASE WHEN e < 0 THEN CAST(e AS DOUBLE) * 1.3 ELSE CAST(e AS DOUBLE) / 1.3 END ELSE CAST(e AS DOUBLE) END AS x FROM v),
q AS (SELECT *, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS q FROM w),
c AS (SELECT *, sum(q) OVER (PARTITION BY vec_id ORDER BY x, i ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i DESC) AS place FROM q),
k AS (SELECT vec_id, i, CASE WHEN upto <= 1 - 0.9 AND place > 1 THEN 0 ELSE exp(x / 0.7) END AS y FROM c),
p AS (SELECT vec_id, i, y / sum(y) OVER (PARTITION BY vec_id) AS p, y > 0 AS kept FROM k)
SELECT a.vec_id, round(1 - sum(abs(a.p - b.p)) / 2, 6) AS rate, count(*) FILTER (WHERE a.kept) AS n_kept FROM p a JOIN p b ON b.vec_id = a.vec_id + 1 AND b.i = a.i GROUP BY a.vec_id""")
def acceptance_rate_top_p(spark, d):
    logits = F.transform("embedding", lambda x: x.cast("double"))
    seen = F.array(F.lit(3), F.lit(5), (F.col("vec_id") % 64).cast("int"))
    p = table(spark, d, "embeddings").select("vec_id", X.next_token(logits, 0.7, 0.9, 1.3, seen).alias("p"))
    both = p.join(p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q")), "vec_id")
    return both.select("vec_id", F.round(X.acceptance_rate("p", "q"), 6).alias("rate"), F.size(F.filter("p", lambda x: x > 0)).cast("long").alias("n_kept"))


@register("SELECT l_orderkey, l_linenumber, round(l_quantity * l_linenumber * 8 / l_extendedprice, 9) AS tps FROM lineitem")
def throughput(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", F.round(X.throughput("l_quantity", "l_linenumber", 8, "l_extendedprice"), 9).alias("tps"))


@register(PAIRS.format(t="1.0") + ", l AS (SELECT vec_id, list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i] * ln(p[i] / q[i]))) AS kl FROM k) SELECT vec_id, round(kl, 6) AS kl, round(0.7 * 2 + 0.3 * kl, 6) AS loss FROM l")
def kl_loss(spark, d):
    rows = _pairs(spark, d, 1.0).withColumn("kl", X.kl_divergence("p", "q"))
    return rows.select("vec_id", F.round("kl", 6).alias("kl"), F.round(X.mixed_loss(F.lit(2.0), "kl", 0.3), 6).alias("loss"))


@register("""WITH r AS (SELECT vec_id, unnest(range(4)) AS k FROM embeddings)
SELECT vec_id, k, array_to_string(range(8 * k, 8 * k + 8) || range(56 - 8 * k, 64 - 8 * k), ',') AS zigzag, array_to_string(range(16 * k, 16 * k + 16), ',') AS local, array_to_string(range(k, 64, 4), ',') AS stripe FROM r""")
def zigzag_split(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda _, i: i).alias("at"))
    text = lambda a: F.array_join(a.cast("array<string>"), ",")
    ranks = F.array(*(F.struct(F.lit(k).cast("long").alias("k"), text(X.zigzag("at", k, 4)).alias("zigzag"), text(X.local_part("at", k, 4)).alias("local"), text(X.stripe("at", k, 4)).alias("stripe")) for k in range(4)))
    return rows.select("vec_id", F.inline(ranks))


@register("SELECT vec_id, round(1 / (1 + exp(CAST(embedding[1] AS DOUBLE) - CAST(embedding[2] AS DOUBLE))), 9) AS p FROM embeddings")
def softmax_score(spark, d):
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return table(spark, d, "embeddings").select("vec_id", F.round(X.softmax_second(e(0), e(1)), 9).alias("p"))


# --- projections, validation, run counts ---


@register("SELECT doc_id, source, upper(lang) AS pred FROM documents")
def computed_columns(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", F.col("lang").alias("image"))
    return mix.add_computed(rows, {"source": F.lit("computed"), "pred": F.upper("image")})


@register("SELECT doc_id, lang FROM documents")
def kept_columns(spark, d):
    return mix.keep_columns(table(spark, d, "documents"), ["lang", "doc_id", "no such column"])


@register("SELECT doc_id, 'clip.' || doc_id AS id, 'clip' AS stem, 'cat' || doc_id % 3 AS category FROM documents")
def path_parts(spark, d):
    path = F.concat(F.lit("/data/cat"), (F.col("doc_id") % 3).cast("string"), F.lit("/clip."), F.col("doc_id").cast("string"), F.lit(".mp4"))
    return table(spark, d, "documents").select("doc_id", X.path_id(path).alias("id"), X.path_id(path, first_dot=True).alias("stem"), X.path_category(path).alias("category"))


@register("SELECT doc_id, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def required_fields(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return mix.complete(rows, ["quality", "toxic"]).select("doc_id", "quality")


@register("SELECT doc_id, n_chars FROM documents WHERE n_chars >= 0")
def length_guard(spark, d):
    return mix.guard(table(spark, d, "documents").select("doc_id", "n_chars"), F.col("n_chars") < 10**9, "a text is too long", "n_chars")


@register("SELECT count(*) AS total, count(quality) AS processed, count(*) - count(quality) AS remaining, count(*) FILTER (WHERE quality = 1) AS successes FROM documents LEFT JOIN labels USING (doc_id)")
def run_counts(spark, d):
    return evaluate.run_counts(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"], F.col("quality") == 1)


@register("SELECT o_orderkey FROM orders")
def balanced(spark, d):
    return mix.balanced(table(spark, d, "orders").select("o_orderkey"), 16)


# --- annotation ---

WORDS_OF = "list_filter(regexp_split_to_array({0}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


@register(f"SELECT doc_id, lower(text) LIKE '%ing%' AS is_biomedical, array_to_string({WORDS_OF.format('text')}, ' ') AS cleaned_caption, lower(text) LIKE '%ing%' AS flag, array_to_string({WORDS_OF.format('text')}, ' ') AS squeezed FROM documents")
def annotate_captions(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("text").alias("caption"))
    rows = annotate.annotate(annotate.annotate(rows, annotate.keyword_relevance(("ing",))), annotate.whitespace_cleaner())
    return rows.select("doc_id", "is_biomedical", "cleaned_caption", annotate.keyword_flag("caption", ("ing",)).alias("flag"), annotate.squeezed("caption").alias("squeezed"))


PHRASES = (
    ("An echocardiogram of the heart", "Echocardiography", "Cardiac"), ("CT of the chest", "CT Imaging", "Thoracic and Respiratory System"), ("A brain MRI", "MRI", "Cranial and Nervous System"),
    ("Laparoscopic view of the liver", "Endoscopy and Laparoscopic Surgery", "Gastrointestinal System"), ("Nothing known", "Other", "Other"), ("Skin under the microscope", "Microscopy", "Skin and Integumentary System"),
)


@register("SELECT doc_id, CASE " + " ".join(f"WHEN doc_id % 7 = {i} THEN '{m}'" for i, (_, m, _) in enumerate(PHRASES)) + " END AS modality, CASE " + " ".join(f"WHEN doc_id % 7 = {i} THEN '{r}'" for i, (_, _, r) in enumerate(PHRASES)) + " END AS anatomical_region FROM documents WHERE doc_id % 7 < 6")
def annotate_metadata(spark, d):
    """The seventh caption is null, so its row fails and goes."""
    captions = F.array(*(F.lit(x) for x, _, _ in PHRASES), F.lit(None).cast("string"))
    rows = table(spark, d, "documents").select("doc_id", F.get(captions, (F.col("doc_id") % 7).cast("int")).alias("caption"))
    return annotate.annotate(rows, annotate.keyword_metadata()).select("doc_id", "modality", "anatomical_region")


@register(f"""WITH w AS (SELECT doc_id, {WORDS_OF.format('text')} AS w FROM documents), l AS (SELECT doc_id, w, w[list_position(list_transform(w, lambda x: length(x)), list_max(list_transform(w, lambda x: length(x))))] AS longest FROM w WHERE len(w) > 0)
SELECT doc_id, md5(array_to_string(list_transform(w, lambda x: CASE WHEN x = longest THEN '___' ELSE x END), ' ')) AS question, 'A' AS correct_option, longest AS correct_answer FROM l""")
def annotate_questions(spark, d):
    rows = annotate.annotate(table(spark, d, "documents").select("doc_id", "text"), annotate.cloze_questions("text"))
    return rows.select("doc_id", F.inline("qa_pairs")).select("doc_id", F.md5("question").alias("question"), "correct_option", "correct_answer")


@register("SELECT doc_id, source AS prompt, upper(source) AS pred, 'own' AS model_id FROM documents")
def generated_answers(spark, d):
    """The row's own model_id wins over the computed one."""
    rows = table(spark, d, "documents").select("doc_id", "source", F.lit("own").alias("model_id"))
    out = annotate.generate_answers(rows, "source", lambda: lambda asked: [f"user\n{x}\nassistant\n {x.upper()} <|im_end|>\n" for x in asked], "stub")
    return out.select("doc_id", "prompt", "pred", "model_id")


@register("SELECT conv_id, turn, octet_length(encode(text)) / 1000 AS p FROM conversations")
def scored_frames(spark, d):
    frames = table(spark, d, "conversations").select("conv_id", "turn", F.encode("text", "UTF-8").alias("content"))
    return annotate.score_frames(frames, lambda: lambda batch: [len(x) / 1000 for x in batch], 5)


@register("SELECT doc_id, lang || '-' || source AS tag, CAST(length(text) % 10 AS BIGINT) AS digit FROM documents WHERE length(text) % 10 < 7")
def mapped_rows(spark, d):
    rows = annotate.map_rows(table(spark, d, "documents").select("doc_id", "lang", "source", "text"), lambda r: {"tag": f"{r['lang']}-{r['source']}", "digit": len(r["text"]) % 10}, "tag string, digit long")
    return annotate.filter_batches(rows.select("doc_id", "tag", "digit"), lambda batch: [x < 7 for x in batch.column("digit").to_pylist()])


@register("SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN doc_id / 2 END AS duration FROM documents")
def probed_durations(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "lost").otherwise(F.col("doc_id").cast("string")).alias("path"))
    return store.probe_durations(rows, lambda path: int(path) / 2).select("doc_id", "duration")


@register(f"""WITH c AS (SELECT conv_id * 1000 + turn AS video_id, {WORDS_OF.format('text')} AS w FROM conversations WHERE octet_length(encode(text)) % 7 <> 0)
SELECT video_id, CAST(unnest(range(len(w))) AS INT) AS pos, unnest(w) AS text, unnest(list_transform(range(len(w)), lambda i: i / 2)) AS ws, unnest(list_transform(range(len(w)), lambda i: CASE WHEN i % 3 = 0 THEN NULL ELSE i / 2 + 0.25 END)) AS we FROM c""")
def transcripts(spark, d):
    """A batch with a text of a length that 7 divides fails; alone, such a text has no words."""

    def load():
        def model(batch):
            if any(len(x) % 7 == 0 for x in batch):
                raise ValueError("can't hear this")
            return [[(w, i / 2, None if i % 3 == 0 else i / 2 + 0.25) for i, w in enumerate(bytes(x).decode().split())] for x in batch]

        return model

    audio = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("video_id"), F.encode("text", "UTF-8").alias("content"))
    return annotate.transcribe(audio, load)


# --- sources and sinks, by way of the shared folder ---


def _folder(spark, name: str) -> str:
    return f"{store.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@register("SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey FROM customer")
def jsonl_round_trip(spark, d):
    rows, path = table(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("c_nationkey")), _folder(spark, "jsonl")
    store.overwrite_jsonl(rows.limit(3), path)
    store.overwrite_jsonl(rows.filter("c_custkey % 2 = 0"), path)
    store.append_jsonl(rows.filter("c_custkey % 2 = 1"), path)
    return store.read_jsonl(spark, path, rows.schema)


@register("SELECT c_custkey, (SELECT count(*) FROM customer WHERE c_custkey % 5 IN (1, 2)) AS n_bad FROM customer WHERE c_custkey % 5 NOT IN (1, 2)")
def jsonl_tolerant(spark, d):
    key, path = F.col("c_custkey"), _folder(spark, "lines")
    line = F.when(key % 5 == 1, "null").when(key % 5 == 2, '{"c_custkey": ').otherwise(F.concat(F.lit('{"c_custkey": '), key.cast("string"), F.lit("}")))
    table(spark, d, "customer").select(line.alias("value")).write.text(path)
    bad = store.count_bad_lines(spark, path, "c_custkey long")
    return store.read_jsonl(spark, path, "c_custkey long", strict=False).withColumn("n_bad", F.lit(bad).cast("long"))


@register("SELECT s_suppkey, s_name, 'parquet' AS kind FROM supplier UNION ALL SELECT s_suppkey, s_name, 'csv' FROM supplier UNION ALL SELECT s_suppkey, s_name, 'json' FROM supplier UNION ALL SELECT s_suppkey, s_name, 'name' FROM supplier")
def datasets_by_kind(spark, d):
    rows, path = table(spark, d, "supplier").select("s_suppkey", "s_name"), _folder(spark, "dataset")
    store.save_dataset(rows, f"{path}/train", rows_per_file=50)
    rows.write.option("header", True).csv(f"{path}.csv")
    rows.write.json(f"{path}.jsonl")
    rows.createOrReplaceTempView("lathework_suppliers")
    schema = "s_suppkey long, s_name string"
    found = {"parquet": store.load_dataset(spark, path), "csv": store.load_dataset(spark, f"{path}.csv", schema=schema), "json": store.load_dataset(spark, f"{path}.jsonl", schema=schema), "name": store.load_dataset(spark, "hub/suppliers", registry={"hub/suppliers": "lathework_suppliers"})}
    return reduce(DataFrame.unionByName, [df.select("s_suppkey", "s_name", F.lit(k).alias("kind")) for k, df in found.items()])


def _score_files(spark, d) -> str:
    """Score arrays in a folder: the events of each user, half a second apart."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")) - 1
    rows = _events(spark, d).select(F.concat(F.lit("cat"), (F.col("user_id") % 3).cast("string")).alias("category"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("video_id"), (place / 2).alias("t"), F.col("value").alias("p"))
    path = _folder(spark, "scores")
    store.save_score_arrays(rows, path).collect()  # a row for each file written
    return path


SCORES = "SELECT 'cat' || user_id % 3 AS category, 'u' || user_id AS video_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS frame_idx, value FROM events"


@register(f"SELECT category, video_id, frame_idx, CAST(frame_idx / 2 AS FLOAT) AS t, CAST(value AS FLOAT) AS p FROM ({SCORES})")
def score_arrays(spark, d):
    return store.read_scores(spark, _score_files(spark, d))


@register("SELECT 'cat' || user_id % 3 AS category, 'u' || user_id AS video_id, CASE WHEN user_id % 4 <> 0 THEN count(*) END AS n_frames, CASE WHEN user_id % 4 <> 0 THEN CAST(2.0 AS DOUBLE) END AS fps FROM events WHERE user_id % 5 <> 0 GROUP BY user_id")
def media_of_files(spark, d):
    """Files listed, looked for, read by their paths and decoded; the decoder fails on every fourth."""
    listing = store.write_table(store.list_files(spark, _score_files(spark, d), "*.npy"), "listing")  # listed once
    user = F.substring("video_id", 2, 20).cast("long")
    wanted = listing.filter(user % 5 != 0).select("category", "video_id", "path").unionByName(listing.limit(1).select("category", "video_id", F.lit("/no/such/file.npy").alias("path")))

    def decode(content):
        import io

        import numpy as np

        scores = np.load(io.BytesIO(content))
        return len(scores), 2.0, 0, 0

    files = store.media_bytes(store.media_exists(wanted, listing))
    files = files.withColumn("content", F.when(user % 4 == 0, F.encode(F.lit("no media"), "UTF-8")).otherwise(F.col("content")))
    return store.decode_media(files, decode).select("category", "video_id", "n_frames", "fps")


@register("SELECT 'u' || user_id AS video_id, CASE WHEN user_id % 2 = 0 THEN 'Skipped' ELSE 'Success' END AS status FROM events GROUP BY user_id")
def copied_files(spark, d):
    listing, target = store.write_table(store.list_files(spark, _score_files(spark, d), "*.npy"), "listing"), _folder(spark, "copies")
    even = F.substring("video_id", 2, 20).cast("long") % 2 == 0
    store.copy_new(listing.filter(even), target).collect()  # a status for each file
    done = store.write_table(store.copy_new(listing, target), "copied")
    return done.select(X.path_id("path", first_dot=True).alias("video_id"), "status")


@register("SELECT 'u' || user_id || '_0_' || user_id % 5 || '.mp4' AS clip, CASE WHEN user_id % 7 = 0 THEN 'Warning: no source for u' || user_id || '_0_' || user_id % 5 || '.mp4' WHEN user_id % 5 = 0 THEN 'Error: an empty clip' ELSE 'Success' END AS status FROM events GROUP BY user_id")
def saved_clips(spark, d):
    listing = store.write_table(store.list_files(spark, _score_files(spark, d), "*.npy"), "listing")
    user = F.substring("video_id", 2, 20).cast("long")
    clips = listing.select(F.when(user % 7 != 0, F.col("path")).alias("path"), X.clip_name("video_id", F.lit(0.0), user % 5).alias("clip"), F.lit(0.0).alias("start"), (user % 5).cast("double").alias("end"))

    def cut(path, start, end):
        if end <= start:
            raise ValueError("an empty clip")
        return b"x" * int(end - start)

    return store.save_clips(clips, cut, _folder(spark, "clips"))


@register("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'Error: no clip ' || s_suppkey ELSE 'Success' END AS status FROM supplier")
def action_status(spark, d):
    def act(row):
        if row["s_suppkey"] % 3 == 0:
            raise ValueError(f"no clip {row['s_suppkey']}")

    return store.run_side_effect(table(spark, d, "supplier"), act, "s_suppkey")


@register("SELECT c_custkey, c_name FROM customer")
def incremental_run(spark, d):
    """Files come in two lots, the second with keys of the first once more; two runs leave each key once."""
    rows, source, out, state = table(spark, d, "customer").select("c_custkey", "c_name"), _folder(spark, "feed"), _folder(spark, "fed"), _folder(spark, "feed-state")
    for lot in ("c_custkey % 3 < 2", "c_custkey % 3 > 0"):
        rows.filter(lot).write.mode("append").json(source)
        streaming.run_incrementally(spark, source, "c_custkey long, c_name string", state, out, lambda df: df, "c_custkey").awaitTermination()
    return spark.read.parquet(out)


CHAT = "'<|im_start|>user' || chr(10)", "' what is ' || p_name || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || p_name || '<|im_end|>' || chr(10)"


@register(f"""SELECT p_partkey AS row_idx, md5({CHAT[0]} || '<|pad|>' || {CHAT[1]}) AS text, {joined(f"{IDS.format(CHAT[0])} || {MEDIA.format(0)} || {IDS.format(CHAT[1])}")} AS ids, '1' AS copies FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, md5({CHAT[0]} || '<|pad|>' || {CHAT[1]}), {joined(f"{IDS.format(CHAT[0])} || {MEDIA.format(0)} || {IDS.format(CHAT[1])}")}, '1,2' FROM part WHERE p_partkey % 2 = 1""")
def canned_run(spark, d):
    """Two datasets by their ratios, settings from YAML and arguments, chats with a medium each, saved and read."""
    folder, out = _folder(spark, "canned"), _folder(spark, "canned-out")
    said = F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("<video> what is "), "p_name").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("p_name").alias("content"))))
    notes = F.concat(F.lit('[{"num_frames":'), F.col("p_partkey") % 3, F.lit(',"resolution":['), 28 * (1 + F.col("p_size") % 5), F.lit(",56]}]"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("row_idx"), said.alias("messages"), notes.alias("video_metas"))
    rows.filter("row_idx % 2 = 0").write.json(f"{folder}/even.jsonl")
    store.save_dataset(rows.filter("row_idx % 2 = 1"), f"{folder}/odd/train")
    text = f"output_path: {out}\ndatasets:\n  - path: {folder}/even.jsonl\n    ratio: 1\n  - path: {folder}/odd\n    ratio: 2.0\n"
    saved = canned.run(spark, config.load_settings(canned.Settings, text, ["--model_token", "<|pad|>", "--insert_system=false", "--overwrite"]))
    return saved.groupBy("row_idx").agg(F.md5(F.first("text")).alias("text"), digest(F.first("input_ids")).alias("ids"), F.array_join(F.array_sort(F.collect_list(F.col("copy").cast("string"))), ",").alias("copies"))


@register("SELECT count(*) AS n, round(avg(c_acctbal), 6) AS mean FROM customer")
def metric_document(spark, d):
    path = _folder(spark, "metric")
    store.save_metric(table(spark, d, "customer").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 6).alias("mean")), path)
    return store.read_jsonl(spark, path, "n long, mean double")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
