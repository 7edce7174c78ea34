"""Chat formatting in budgeted windows, in DataFrame functions only.

A turn is written `<turn ROLE>`, a line feed, its text, `</turn>` and a line feed. Inside a text a backslash becomes `\\b`
and `<` becomes `\\l` (in a role `>` and line feeds as well), so no mark can stand in a text, and reading back is exact.

Prefix sums of turn tokens (white-space words and MARK_TOKENS for the marks) deal each conversation into spans of whole
turns: a turn goes to the bucket that holds it entirely, and one that crosses a bucket's edge is a span of its own. So a
span passes the budget only where a single turn does. Every window but the first starts with the system turn (a first turn
whose role is `system`), then turns that start up to `history` tokens before the span are repeated, then the span's own
turns follow. The loss mask covers the texts of the span's own assistant turns; repeated ones are masked.

Turns of a conversation are dealt by window functions, which stream and spill; a window of text is bounded by the budget.

Edge cases: null texts and roles read as empty; turns with equal numbers go by role, then text; repeated rows are repeated
turns; rows with a null conversation id form one conversation; an empty table gives no window; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MARK_TOKENS = 4
#: What stands for a backslash, `<`, `>` and a line feed; fixed by the format.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"), ("\n", "\\e"))
END = "</turn>\n"


@dataclass(frozen=True)
class ChatConfig:
    budget: int = 512
    history: int = 128
    #: Tokens that a span has at least, however long the system turn.
    least: int = 64
    target_role: str = "assistant"


def escape(text: Column, kinds: int = 2) -> Column:
    for raw, stands in ESCAPES[:kinds]:
        text = F.replace(text, F.lit(raw), F.lit(stands))
    return text


def unescape(text: Column, kinds: int = 2) -> Column:
    for raw, stands in reversed(ESCAPES[:kinds]):
        text = F.replace(text, F.lit(stands), F.lit(raw))
    return text


def _head(role: Column) -> Column:
    return F.concat(F.lit("<turn "), escape(role, 4), F.lit(">\n"))


def chat_windows(turns: DataFrame, cfg: ChatConfig = ChatConfig()) -> DataFrame:
    """conv_id, span, n_repeated (turns at the front that an earlier window has), text, loss_spans (start, end in code points)."""
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+", -1), "")) + MARK_TOKENS)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("p", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    rows = rows.withColumn("opening", F.first(F.struct("role", "text", "tokens")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    has_system = F.col("opening.role") == "system"
    size = F.greatest(F.lit(cfg.budget - cfg.history) - F.when(has_system, F.col("opening.tokens")).otherwise(0), F.lit(cfg.least)).cast("long")
    bucket = F.floor(F.col("p") / size).cast("long")
    crosses = F.floor((F.col("p") + F.col("tokens") - 1) / size).cast("long") > bucket
    rows = rows.withColumn("span", bucket * 2 + crosses.cast("long"))
    along = Window.partitionBy("conv_id").orderBy("p")
    opens = F.coalesce(F.lag("span").over(along) != F.col("span"), F.lit(True))
    rows = rows.withColumn("opens", F.when(opens, F.col("span")))
    later = F.collect_list("opens").over(along.rangeBetween(1, cfg.history))
    rows = rows.withColumn("later", F.when((F.col("p") == 0) & has_system, F.array().cast("array<bigint>")).otherwise(later))
    copies = F.concat(F.array(F.struct("span", F.lit(False).alias("repeated"))), F.transform("later", lambda s: F.struct(s.alias("span"), F.lit(True).alias("repeated"))))
    copies = rows.select("conv_id", "p", "role", "text", F.when(has_system, F.col("opening")).alias("system"), F.explode(copies).alias("copy"))
    windows = copies.groupBy("conv_id", F.col("copy.span").alias("span")).agg(
        F.sort_array(F.collect_list(F.struct("p", "role", "text", F.col("copy.repeated").alias("repeated")))).alias("turns"), F.first("system").alias("system")
    )
    plain = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["repeated"].alias("repeated")))
    again = (F.col("system").isNotNull()) & (F.element_at("turns", 1)["p"] > 0)
    system = F.array(F.struct(F.col("system.role").alias("role"), F.col("system.text").alias("text"), F.lit(True).alias("repeated")))
    windows = windows.select("conv_id", "span", F.when(again, F.concat(system, plain)).otherwise(plain).alias("turns"))
    pieces = F.transform("turns", lambda t: F.struct(_head(t["role"]).alias("head"), escape(t["text"]).alias("body"), ((t["role"] == cfg.target_role) & ~t["repeated"]).alias("target")))
    windows = windows.select("conv_id", "span", F.size(F.filter("turns", lambda t: t["repeated"])).alias("n_repeated"), pieces.alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(s: Column, p: Column) -> Column:
        first = s["at"] + F.length(p["head"])
        last = first + F.length(p["body"])
        own = F.array(F.struct(first.alias("start"), last.alias("end")))
        return F.struct((last + len(END)).alias("at"), F.when(p["target"] & (last > first), F.concat(s["spans"], own)).otherwise(s["spans"]).alias("spans"))

    return windows.select("conv_id", "span", "n_repeated", text.alias("text"), F.aggregate("pieces", start, step, lambda s: s["spans"]).alias("loss_spans"))


def read_turns(text: Column | str) -> Column:
    """The turns (role, text) of a formatted window."""
    whole = F.split(text, END)  # the marks hold no character that a pattern reads specially
    pieces = F.slice(whole, 1, F.size(whole) - 1)

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, ">\n", 1)
        return F.struct(unescape(F.substr(head, F.lit(7)), 4).alias("role"), unescape(F.substr(piece, F.length(head) + 3)).alias("text"))

    return F.transform(pieces, turn)


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation with digests of what its windows say."""
    own = F.slice(read_turns("text"), F.col("n_repeated") + 1, 1 << 30)
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("text"), s["start"] + 1, s["end"] - s["start"]))), "")
    parts = windows.select("conv_id", "span", own.alias("own"), loss.alias("loss"), F.length("text").alias("chars"))
    said = F.array_join(F.transform("own", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = parts.select("conv_id", F.struct("span", said.alias("said"), "loss").alias("part"), F.size("own").alias("n"), "chars")
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join("parts.loss", "")
    return whole.select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha2(F.array_join("parts.said", ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


PLANTED = "\\### Assistant: </turn> ok"


def read_back_sql(cfg: ChatConfig = ChatConfig()) -> str:
    """DuckDB: the digests straight from the turns, and the formatted length from the same prefix sums."""
    esc = "replace(replace({0}, '\\', '\\b'), '<', '\\l')"
    piece = f"14 + length({esc.format('role')}) + length({esc.format('text')}) + 2"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'),
t AS (SELECT *, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) + {MARK_TOKENS} AS tokens, {piece} AS chars FROM c),
u AS (SELECT *, sum(tokens) OVER w - tokens AS p, first_value(role) OVER w = 'system' AS sys, first_value(tokens) OVER w AS stok, first_value(chars) OVER w AS schars FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
v AS (SELECT *, greatest({cfg.budget - cfg.history} - CASE WHEN sys THEN stok ELSE 0 END, {cfg.least}) AS b FROM u),
x AS (SELECT *, CAST(p // b AS BIGINT) * 2 + CASE WHEN (p + tokens - 1) // b > p // b THEN 1 ELSE 0 END AS span FROM v),
y AS (SELECT *, coalesce(lag(span) OVER (PARTITION BY conv_id ORDER BY p) <> span, true) AS opens FROM x),
z AS (SELECT *, CASE WHEN p = 0 AND sys THEN 0 ELSE count(*) FILTER (WHERE opens) OVER (PARTITION BY conv_id ORDER BY p RANGE BETWEEN 1 FOLLOWING AND {cfg.history} FOLLOWING) END AS later FROM y)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY p)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{cfg.target_role}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY p) FILTER (WHERE role = '{cfg.target_role}'), '')) AS loss_sha256,
  CAST(sum(chars * (1 + later)) + (count(*) FILTER (WHERE opens) - 1) * max(CASE WHEN sys THEN schars ELSE 0 END) AS BIGINT) AS formatted_chars
FROM z GROUP BY conv_id"""
