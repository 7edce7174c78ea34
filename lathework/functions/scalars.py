"""Scalar and array expressions (survey §2.10, §2.11, §2.13): Column in, Column out, all JVM-side."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PATCH, LEAST_SIDE = 28, 56
IGNORE = -100
#: Texts that end a generated answer, in the order in which they cut it; fixed by the chat formats.
END_MARKS = ("<|im_end|>", "</s>", "<|eot_id|>")
#: A shrink step takes a twentieth off a side; 200 of them bring any size to the floor.
SHRINK_STEPS = 200
#: What a step leaves of an area at least, rounding of small sides included, and how much whole patches exceed an area at most.
SHRINK_RATE, PATCH_EXCESS = 0.965, 2.25


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text: Column | str) -> Column:
    """White space of any kind off both ends (trim() takes spaces only)."""
    return F.regexp_replace(col(text), r"^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$", "")


def half_even(x: Column) -> Column:
    """Rounding to an integer with ties to the even one."""
    return F.bround(x, 0)


# --- media geometry (O-X1 to O-X6) ---


def frame_times(duration: Column | str, step: float = 0.5) -> Column:
    """0, step, 2*step, ... below the duration."""
    n = F.ceil(col(duration) / step).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * F.lit(step))).otherwise(F.array().cast("array<double>"))


def tokens_per_frame(width: Column | str, height: Column | str) -> Column:
    patches = F.ceil(col(width) / PATCH) * F.ceil(col(height) / PATCH)
    return F.floor(patches / 2).cast("long")


def snap(side: Column | str) -> Column:
    """The nearest multiple of the patch (ties to the even multiple), at least LEAST_SIDE."""
    return F.greatest(half_even(col(side) / PATCH) * PATCH, F.lit(float(LEAST_SIDE)))


def fit_resolution(width: Column | str, height: Column | str, target: Column | str) -> Column:
    """struct(width, height): the size shrunk until a frame has `target` tokens at most, then snapped to patches."""
    w0, h0, target = col(width).cast("double"), col(height).cast("double"), col(target)
    aspect = w0 / h0
    size = lambda w, h: F.struct(w.alias("w"), h.alias("h"))
    floor = F.lit(float(LEAST_SIDE))

    def shrink(s: Column, _: Column) -> Column:
        w, h = s["w"], s["h"]
        narrow_w = F.greatest(half_even(w * 0.95), half_even(floor * aspect))
        flat = size(narrow_w, F.greatest(half_even(narrow_w / aspect), floor))
        narrow_h = F.greatest(half_even(h * 0.95), half_even(floor / aspect))
        thin = size(F.greatest(half_even(narrow_h * aspect), floor), narrow_h)
        both = size(half_even(w * 0.95), half_even(h * 0.95))
        smaller = F.when(h * 0.95 < LEAST_SIDE, flat).when(w * 0.95 < LEAST_SIDE, thin).otherwise(both)
        return F.when(tokens_per_frame(w, h) > target, smaller).otherwise(s)

    def settle(s: Column) -> Column:
        w, h = s["w"], s["h"]
        sw, sh = snap(w), snap(h)
        by_width = F.abs(sw / w - 1) > F.abs(sh / h - 1)
        kept = F.when(by_width, size(sw, snap(sw / aspect))).otherwise(size(snap(sh * aspect), sh))
        less_w, less_h = kept["w"] - PATCH, kept["h"] - PATCH
        smaller = F.when(kept["w"] > kept["h"], size(less_w, snap(less_w / aspect))).otherwise(size(snap(less_h * aspect), less_h))
        return F.when(tokens_per_frame(kept["w"], kept["h"]) > target, smaller).otherwise(kept)

    # As many steps as the area can need to come down to the target, and some to spare; none where the size is small already.
    ratio = w0 * h0 * (PATCH_EXCESS / 2 / PATCH**2) / F.greatest(target, F.lit(0.5))
    steps = F.ceil(F.log(F.greatest(ratio, F.lit(1.0))) / -math.log(SHRINK_RATE)) + 8
    steps = F.when(tokens_per_frame(w0, h0) > target, F.least(steps, F.lit(SHRINK_STEPS))).otherwise(0).cast("int")
    none = F.array().cast("array<int>")
    found = F.aggregate(F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(none), size(w0, h0), shrink, settle)
    return F.struct(found["w"].cast("int").alias("width"), found["h"].cast("int").alias("height"))


def frame_indices(n_frames: Column | str, fps: Column | str, max_duration: float = 420, max_frames: int = 420) -> Column:
    """Every fps-th frame of a video of at most max_duration seconds, else max_frames evenly spaced ones; all cut to integers."""
    n, fps = col(n_frames), col(fps)
    count = F.ceil(n / fps).cast("int")
    every = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: (i * fps).cast("int"))).otherwise(F.array().cast("array<int>"))
    if max_frames > 1:
        even = F.transform(F.sequence(F.lit(0), F.lit(max_frames - 1)), lambda i: F.when(i == max_frames - 1, (n - 1).cast("int")).otherwise((i * ((n - 1).cast("double") / (max_frames - 1))).cast("int")))
    else:
        even = F.array(F.lit(0))
    return F.when(n / fps <= max_duration, every).otherwise(even)


def budget_tokens(total: Column, frames: Column, per_frame: Column, max_tokens: int) -> Column:
    """Tokens that a frame may have: as many as it has while the video is within its budget, else an equal share of it."""
    return F.when(total > max_tokens, F.floor(F.lit(max_tokens) / frames)).otherwise(per_frame).cast("long")


def video_metadata(n_frames: Column | str, fps: Column | str, width: Column | str, height: Column | str, new_width: Column | str, new_height: Column | str, max_duration: float = 420, max_frames: int = 420) -> Column:
    """struct(original, processed) of a video's length, rate, size and tokens, before and after its frames are picked and shrunk (O-P11)."""
    n, fps = col(n_frames), col(fps).cast("double")
    duration = n / fps
    short = duration <= max_duration
    taken = F.when(short, F.ceil(n / fps)).otherwise(max_frames).cast("long")
    size = lambda w, h: F.struct(col(w).cast("int").alias("width"), col(h).cast("int").alias("height"))
    before, after = tokens_per_frame(width, height), tokens_per_frame(new_width, new_height)
    original = F.struct(duration.alias("duration"), n.cast("long").alias("frame_count"), fps.alias("fps"), size(width, height).alias("resolution"), before.alias("tokens_per_frame"))
    processed = F.struct(
        taken.alias("frame_count"), F.when(short, F.lit(1.0)).otherwise(max_frames / duration).alias("sampling_frequency"), F.when(short, "1fps").otherwise("uniform").alias("sampling_mode"),
        size(new_width, new_height).alias("resolution"), after.alias("tokens_per_frame"), (after * taken).alias("total_tokens"),
    )
    return F.struct(original.alias("original"), processed.alias("processed"))


# --- text (O-X7 to O-X17, O-P6 to O-P10) ---


def replace_all(text: Column | str, pairs: dict[str, str]) -> Column:
    """Literal replacements, one after another in the order given."""
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs.items(), col(text))


def count_of(text: Column | str, token: str) -> Column:
    """Occurrences of a literal, not overlapping."""
    return ((F.length(col(text)) - F.length(F.replace(col(text), F.lit(token), F.lit("")))) / len(token)).cast("long")


def equal_counts(value: Column, text: Column | str, token: str, media: Column) -> Column:
    """The value, or an error where the text holds another number of tokens than there are media (O-X9)."""
    said = F.concat(F.lit(f"number of {token} ("), count_of(text, token).cast("string"), F.lit(") differs from the number of media ("), media.cast("string"), F.lit(")"))
    return F.when(F.coalesce(count_of(text, token) == media, F.lit(False)), value).otherwise(F.raise_error(F.coalesce(said, F.lit(f"no text or no media to compare {token} with"))))


def media_metas(text: Column | str) -> Column:
    """Media notes from JSON: resolution as [w, h] or {width, height}, fps 1 where missing."""
    listed = F.from_json(col(text), "array<struct<num_frames:bigint,resolution:array<int>,fps:double>>")
    named = F.from_json(col(text), "array<struct<num_frames:bigint,resolution:struct<width:int,height:int>,fps:double>>")

    def note(i: Column) -> Column:
        a, b = F.get(listed, i), F.get(named, i)
        width = F.coalesce(F.get(a["resolution"], F.lit(0)), b["resolution"]["width"])
        height = F.coalesce(F.get(a["resolution"], F.lit(1)), b["resolution"]["height"])
        return F.struct(F.coalesce(a["num_frames"], b["num_frames"]).alias("num_frames"), width.alias("width"), height.alias("height"), F.coalesce(a["fps"], b["fps"], F.lit(1.0)).alias("fps"))

    n = F.greatest(F.size(listed), F.size(named))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), note)).otherwise(F.array().cast("array<struct<num_frames:bigint,width:int,height:int,fps:double>>"))


def media_metas_json(num_frames: Column | str, width: Column | str, height: Column | str, fps: Column | str) -> Column:
    return F.to_json(F.array(F.struct(col(num_frames).alias("num_frames"), F.struct(col(width).alias("width"), col(height).alias("height")).alias("resolution"), col(fps).alias("fps"))), {"ignoreNullFields": "false"})


def clean_generation(text: Column | str) -> Column:
    """What follows the last `assistant`, stripped and cut at the end marks."""
    tail = F.regexp_replace(F.substring_index(col(text), "assistant", -1), r"^ +| +$", "")
    tail = F.regexp_replace(tail, r"^\n+|\n+$", "")
    return strip(reduce(lambda t, mark: F.substring_index(t, mark, 1), END_MARKS, tail))


def question_prompt(question: Column | str, answer: Column | str, options: list[Column | str]) -> Column:
    """A yes/no question or one with four options, told apart by the answer."""
    named = [x for letter, o in zip("ABCD", options) for x in (F.lit(f"{letter}: " if letter == "A" else f"\n{letter}: "), F.coalesce(col(o).cast("string"), F.lit("None")))]
    four = F.concat(F.lit("Question: "), col(question), F.lit("\nOptions: "), *named, F.lit("\nChoose A, B, C, or D."))
    return F.when(F.lower(col(answer)).isin("yes", "no"), F.concat(F.lit("Question: "), col(question), F.lit("\nChoose Yes or No."))).otherwise(four)


def pick(options: list[str], key: Column | str) -> Column:
    """One of the options by the key's md5, the same on every run."""
    number = F.conv(F.substring(F.md5(col(key).cast("string")), 1, 8), 16, 10).cast("long")
    return F.element_at(F.array(*map(F.lit, options)), (number % len(options)).cast("int") + 1)


def stable_id(*keys: Column | str) -> Column:
    return F.md5(F.concat_ws(":", *(col(k).cast("string") for k in keys)))


def path_category(path: Column | str) -> Column:
    return F.get(F.reverse(F.split(col(path), "/")), F.lit(1))


def path_id(path: Column | str, first_dot: bool = False) -> Column:
    """The file name without its suffix, or up to its first dot."""
    name = F.substring_index(col(path), "/", -1)
    return F.substring_index(name, ".", 1) if first_dot else F.regexp_replace(name, r"\.mp4$", "")


def first_part(path: Column | str) -> Column:
    return F.get(F.split(col(path), "/"), F.lit(0))


def clip_parts(path: Column | str) -> Column:
    """struct(video_id, start, end) of a clip's name, read from the right."""
    name, pattern = F.substring_index(col(path), "/", -1), r"^(.*)_([0-9]+)_([0-9]+)[.]mp4$"
    part = lambda i: F.regexp_extract(name, pattern, i)
    return F.when(F.regexp_like(name, F.lit(pattern)), F.struct(part(1).alias("video_id"), part(2).cast("int").alias("start"), part(3).cast("int").alias("end")))


def clip_name(video_id: Column | str, start: Column | str, end: Column | str) -> Column:
    whole = lambda x: half_even(col(x).cast("double")).cast("long").cast("string")
    return F.concat(col(video_id).cast("string"), F.lit("_"), whole(start), F.lit("_"), whole(end), F.lit(".mp4"))


# --- numbers (O-X19, O-X20, O-N1 to O-N3, O-A10) ---


def softmax_second(first: Column | str, second: Column | str) -> Column:
    return 1 / (1 + F.exp(col(first) - col(second)))


def pad_length(n: Column | str, multiple: int = 128) -> Column:
    return F.pmod(F.lit(multiple) - F.pmod(col(n), F.lit(multiple)), F.lit(multiple))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once and not at each place it stands in."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _raised(x: Column) -> Column:
    """exp of each element less the greatest."""
    return _let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))


def softmax(logits: Column | str, temperature: float = 1.0) -> Column:
    scaled = F.transform(col(logits), lambda x: x / temperature) if temperature != 1.0 else col(logits)
    shares = lambda e: _let(F.aggregate(e, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(e, lambda x: x / total))
    return _let(scaled, lambda x: _let(_raised(x), shares))


def repetition_penalty(logits: Column | str, seen: Column | str, penalty: float) -> Column:
    """Logits of the ids seen before, divided by the penalty, or multiplied where they are negative."""
    return F.transform(col(logits), lambda x, i: F.when(F.array_contains(col(seen), i), F.when(x < 0, x * penalty).otherwise(x / penalty)).otherwise(x))


def top_p(logits: Column | str, p: float) -> Column:
    """Logits of the likeliest entries that hold p of the probability, others at minus infinity; the greatest stays, and so do all that equal the least that stays."""
    start = lambda: F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

    def least(x: Column, total: Column) -> Column:
        """The first of the ascending x up to which more than 1 - p of the weight lies."""
        step = lambda s, w: F.struct((s["sum"] + w).alias("sum"), (s["n"] + (s["sum"] + w <= total * (1 - p)).cast("int")).alias("n"))
        return F.get(x, F.least(F.aggregate(_raised(x), start(), step, lambda s: s["n"]), F.size(x) - 1))

    cut = lambda x: _let(F.aggregate(_raised(x), F.lit(0.0), lambda s, w: s + w), lambda total: least(x, total))
    return _let(col(logits), lambda x: _let(_let(F.array_sort(x), cut), lambda v: F.transform(x, lambda y: F.when(y >= v, y).otherwise(F.lit(float("-inf"))))))


def next_token(logits: Column | str, temperature: float = 1.0, p: float = 1.0, penalty: float = 1.0, seen: Column | str | None = None) -> Column:
    """Probabilities of the next token: penalty, then top-p, then temperature (O-N1)."""
    out = col(logits)
    if penalty != 1.0 and seen is not None:
        out = repetition_penalty(out, seen, penalty)
    if p != 1.0:
        out = top_p(out, p)
    return softmax(out, temperature)


def acceptance_rate(p: Column | str, q: Column | str) -> Column:
    """One less half the distance of two distributions."""
    return 1 - F.aggregate(F.zip_with(col(p), col(q), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / 2


def kl_divergence(p: Column | str, q: Column | str) -> Column:
    """Of p from q, over the entries where p isn't 0."""
    return F.aggregate(F.zip_with(col(p), col(q), lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)


def mixed_loss(draft: Column | str, kl: Column | str, weight: float) -> Column:
    return col(draft) * (1 - weight) + col(kl) * weight


def throughput(batch: Column | str, length: Column | str, world: int, seconds: Column | str) -> Column:
    return col(batch) * col(length) * world / col(seconds)


# --- token arrays (O-T2 to O-T12, O-W3, O-W4, O-L11 to O-L13) ---


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def find_all(ids: Column | str, needle: list[int]) -> Column:
    """Positions just after each occurrence of the needle."""
    ids, k = col(ids), len(needle)
    wanted = F.array(*map(F.lit, needle))
    first = F.filter(_upto(F.size(ids) - (k - 1)), lambda i: F.get(ids, i) == needle[0])
    return F.transform(F.filter(first, lambda i: F.slice(ids, i + 1, k) == wanted), lambda i: i + k)


def mask_labels(ids: Column | str, bos: list[int], eos: list[int], ignore: int = IGNORE) -> Column:
    """Labels: the ids between an opening mark and the closing mark that is the very next mark, all others ignored."""
    ids = col(ids)
    # A mark is its place and whether it closes; opening marks come first at equal places.
    marks = F.array_sort(F.concat(F.transform(find_all(ids, bos), lambda i: F.struct(i.alias("at"), F.lit(0).alias("closes"))), F.transform(find_all(ids, eos), lambda i: F.struct(i.alias("at"), F.lit(1).alias("closes")))))
    spans = F.filter(
        F.zip_with(marks, F.slice(marks, 2, 1 << 30), lambda a, b: F.struct(a["at"].alias("start"), a["closes"].alias("x"), b["at"].alias("end"), b["closes"].alias("y"))),
        lambda s: (s["x"] == 0) & (s["y"] == 1),
    )
    # Spans are disjoint and in order, so the labels are gaps and spans laid end to end: linear in the ids.
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("parts"))
    ids32 = ids.cast("array<int>")

    def lay(s: Column, span: Column) -> Column:
        gap = F.array_repeat(F.lit(ignore), F.greatest(span["start"] - s["at"], F.lit(0)))
        own = F.slice(ids32, span["start"] + 1, span["end"] - span["start"])
        return F.struct(span["end"].alias("at"), F.concat(s["parts"], F.array(gap, own)).alias("parts"))

    return F.aggregate(spans, start, lay, lambda s: F.concat(F.flatten(s["parts"]), F.array_repeat(F.lit(ignore), F.size(ids) - s["at"])))


def any_target(labels: Column | str, ignore: int = IGNORE) -> Column:
    return F.exists(col(labels), lambda x: x != ignore)


def shifted_targets(labels: Column | str, ignore: int = IGNORE) -> Column:
    return F.filter(F.slice(col(labels), 2, 1 << 30), lambda x: x != ignore)


def position_ids(lengths: Column | str) -> Column:
    """0, 1, ... of each sequence, one after another."""
    return F.flatten(F.transform(col(lengths), lambda n: _upto(n)))


def starts_from_positions(positions: Column | str) -> Column:
    """Where positions restart at 0, then the total length."""
    p = col(positions)
    return F.concat(F.filter(_upto(F.size(p)), lambda i: F.get(p, i) == 0), F.array(F.size(p)))


def starts_from_lengths(lengths: Column | str) -> Column:
    """0, then the running sums of the lengths."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.array(F.lit(0).cast("long")).alias("out"))
    return F.aggregate(col(lengths), zero, lambda s, x: F.struct((s["n"] + x).alias("n"), F.concat(s["out"], F.array(s["n"] + x)).alias("out")), lambda s: s["out"])


def starts_from_masks(masks: Column | str) -> Column:
    """0, then the running sums of how many places each mask sets (O-W5)."""
    return starts_from_lengths(F.transform(col(masks), lambda m: F.size(F.filter(m, lambda x: x.cast("boolean"))).cast("long")))


def combine_starts(lists: Column | str) -> Column:
    """Running offsets of several sequences' own offsets, laid one after another."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.array(F.lit(0).cast("long")).alias("out"))

    def add(s: Column, x: Column) -> Column:
        return F.struct((s["n"] + F.element_at(x, -1)).alias("n"), F.concat(s["out"], F.transform(F.slice(x, 2, 1 << 30), lambda y: y + s["n"])).alias("out"))

    return F.aggregate(col(lists), zero, add, lambda s: s["out"])


def pad_right(ids: Column | str, to: Column | int, value: Column | int) -> Column:
    value = value if isinstance(value, Column) else F.lit(value)
    to = to if isinstance(to, Column) else F.lit(to)
    return F.concat(col(ids), F.array_repeat(value, F.greatest(to - F.size(col(ids)), F.lit(0))))


def zigzag(ids: Column | str, rank: int, world: int) -> Column:
    """The rank-th chunk from the front and from the back of 2 * world chunks."""
    ids = col(ids)
    size = F.ceil(F.size(ids) / (2 * world)).cast("int")
    chunk = lambda i: F.when(size > 0, F.slice(ids, size * i + 1, F.greatest(size, F.lit(1)))).otherwise(ids)
    return F.concat(chunk(rank), chunk(2 * world - rank - 1))


def local_part(ids: Column | str, rank: int, world: int) -> Column:
    """The rank-th of `world` equal runs."""
    size = F.floor(F.size(col(ids)) / world).cast("int")
    return F.slice(col(ids), size * rank + 1, size)


def stripe(ids: Column | str, rank: int, world: int) -> Column:
    return F.filter(col(ids), lambda x, i: i % world == rank)


def half_index(starts: Column | str, front: bool) -> Column:
    """Places of the first or second half of every packed sequence, from running offsets."""
    s = col(starts)
    pairs = F.zip_with(s, F.slice(s, 2, 1 << 30), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    whole = F.filter(pairs, lambda p: p["b"].isNotNull() & (p["b"] > p["a"]))
    middle = lambda p: F.floor((p["a"] + p["b"]) / 2).cast("long")
    run = (lambda p: F.when(middle(p) > p["a"], F.sequence(p["a"], middle(p) - 1)).otherwise(F.array().cast("array<bigint>"))) if front else (lambda p: F.sequence(middle(p), p["b"] - 1))
    return F.flatten(F.transform(whole, run))


def expand_placeholder(pieces: Column | str, placeholder: str, media_token: str, counts: Column | str) -> Column:
    """The i-th placeholder among the pieces becomes counts[i] media tokens."""
    zero = F.struct(F.lit(0).alias("i"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        media = F.array_repeat(F.lit(media_token), F.coalesce(F.get(col(counts), s["i"]), F.lit(0)).cast("int"))
        return F.when(x == placeholder, F.struct((s["i"] + 1).alias("i"), F.concat(s["out"], media).alias("out"))).otherwise(F.struct(s["i"].alias("i"), F.concat(s["out"], F.array(x)).alias("out")))

    return F.aggregate(col(pieces), zero, step, lambda s: s["out"])
