"""Filters, dedup, mixing, sharding and shuffles of datasets (O-F*, O-D*, O-L*, O-P1 to O-P5)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*(c for c in df.columns if c in names))


def add_computed(df: DataFrame, computed: dict[str, Column], drop: tuple[str, ...] = ("image",)) -> DataFrame:
    """Computed columns beside the row's own, which win where names clash."""
    return df.withColumns({k: v for k, v in computed.items() if k not in df.columns}).drop(*drop)


def min_words(df: DataFrame, text: str, least: int = 10) -> DataFrame:
    """Texts with at least so many pieces between single spaces; empty pieces count."""
    return df.filter(F.size(F.split(F.col(text), " ", -1)) >= least)


def flagged(df: DataFrame, flag: str) -> DataFrame:
    """Rows whose flag is true; a failed (null) one is false."""
    return df.filter(F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))


def require(df: DataFrame, names: list[str]) -> DataFrame:
    """The table if it has the columns, else an error that names what is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def complete(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows that have a value in each of the fields (O-F7); a field that isn't a column is missing in all rows."""
    return df.dropna(subset=names) if all(n in df.columns for n in names) else df.filter(F.lit(False))


def not_empty(df: DataFrame, what: str = "dataset") -> DataFrame:
    """The table, or an error if it has no row (O-F12); it reads one row."""
    if not df.limit(1).count():
        raise ValueError(f"the {what} is empty")
    return df


def guard(df: DataFrame, good: Column, message: str, on: str) -> DataFrame:
    """Fails the job at a row that breaks the rule; `on` is the column that carries the check."""
    return df.withColumn(on, F.when(F.coalesce(good, F.lit(False)), F.col(on)).otherwise(F.raise_error(F.lit(message)).cast(df.schema[on].dataType)))


def first_by_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key (as a string) in the given order; a null key is a key like others."""
    w = Window.partitionBy(F.col(key).cast("string")).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, with the key's first place as `first_place`."""
    w = Window.partitionBy(key)
    return df.withColumn("first_place", F.min(order).over(w)).withColumn("__n", F.row_number().over(w.orderBy(F.col(order).desc()))).filter("__n = 1").drop("__n")


def duplicate_ratio(df: DataFrame, key: str) -> DataFrame:
    """One less the share of rows that dedup keeps; 0 for an empty table."""
    per_key = df.groupBy(F.col(key).cast("string").alias("k")).agg(F.count("*").alias("n"))
    return per_key.agg(F.coalesce(1 - F.count("*") / F.sum("n"), F.lit(0.0)).alias("duplicate_ratio"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_kept"))


def shuffle_key(seed: int | str, row: Column | str) -> Column:
    """A reproducible random order."""
    row = F.col(row) if isinstance(row, str) else row
    return F.md5(F.concat(F.lit(f"{seed}:"), row.cast("string")))


def balanced(df: DataFrame, parts: int) -> DataFrame:
    """The rows dealt out evenly in no order, to balance work (O-L7)."""
    return df.repartition(parts)


def ranked(df: DataFrame, order: list[Column | str], name: str, buckets: int | None = None) -> DataFrame:
    """The row number over the whole table, from 1, without sorting it in one task.

    Range partitions (buckets; the session's shuffle partitions if not given) are sorted apart; a partition's rows are then
    shifted by the rows of those before it, a table of one row a partition.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = df.repartitionByRange(buckets, *order).withColumn("__part", F.spark_partition_id())
    # The split points are drawn anew if the plan runs twice, so the numbered parts are fixed by a checkpoint or a write.
    parts = parts.transform(_fixed)
    counts = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).select("__part", F.coalesce("__before", F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parts.withColumn("__own", own).join(F.broadcast(before), "__part").withColumn(name, (F.col("__own") + F.col("__before")).cast("long")).drop("__part", "__own", "__before")


def _fixed(df: DataFrame) -> DataFrame:
    from lathework.sources.store import write_table

    return write_table(df, "ranked")


@dataclass(frozen=True)
class MixPart:
    df: DataFrame
    ratio: float = 1.0
    name: str = ""
    transform: Callable[[DataFrame], DataFrame] | None = None


def ratio_mix(parts: list[MixPart], row: str, seed: int = 42, dedup_key: str | None = None) -> DataFrame:
    """int(ratio) whole copies of each part, then the first int(ratio % 1 * n) rows of its shuffled order.

    With dedup_key the first occurrence over the whole mix, in the parts' order, stays before transforms and ratios apply.
    Columns added: dataset_mix_source, mix_idx, copy (from 1; 0 for the fractional rows).

    The mix is written once; its parts are counted in one pass, and rows are numbered by ranges of (part, shuffle key), so
    no part is sorted in one task.
    """
    if any(p.ratio < 0 for p in parts):
        raise ValueError("a mix ratio is negative")
    if not any(p.ratio for p in parts):
        raise ValueError("the mix is empty")
    named = [p.df.withColumns({"dataset_mix_source": F.lit(p.name), "mix_idx": F.lit(i)}) for i, p in enumerate(parts)]
    if dedup_key:
        whole = reduce(DataFrame.unionByName, [require(d, [dedup_key]) for d in named])
        whole = first_by_key(whole, dedup_key, ["mix_idx", row])
        if any(p.transform for p in parts):
            whole = _fixed(whole)
        named = [whole.filter(F.col("mix_idx") == i) for i in range(len(parts))] if any(p.transform for p in parts) else [whole]
    if any(p.transform for p in parts):
        named = [p.transform(d) if p.transform else d for p, d in zip(parts, named)]
    mix = _fixed(reduce(DataFrame.unionByName, named).filter(F.col("mix_idx").isin([i for i, p in enumerate(parts) if p.ratio])))

    by_part = lambda values: F.coalesce(*(F.when(F.col("mix_idx") == i, F.lit(v)) for i, v in values.items()))
    copies = {i: int(p.ratio) for i, p in enumerate(parts) if int(p.ratio)}
    out = []
    if copies:
        out.append(mix.filter(F.col("mix_idx").isin(list(copies))).withColumn("copy", F.explode(F.sequence(F.lit(1), by_part(copies)))))
    sizes = {r["mix_idx"]: r["count"] for r in mix.groupBy("mix_idx").count().collect()}  # a row for each part
    heads = {i: int(p.ratio % 1 * sizes.get(i, 0)) for i, p in enumerate(parts)}
    heads = {i: n for i, n in heads.items() if n}
    if heads:
        before, at = {}, 0
        for i in heads:
            before[i], at = at, at + sizes[i]
        shuffled = F.md5(F.concat(F.lit(f"{seed}:"), F.col("mix_idx").cast("string"), F.lit(":"), F.col(row).cast("string")))
        numbered = ranked(mix.filter(F.col("mix_idx").isin(list(heads))), [F.col("mix_idx"), shuffled, F.col(row)], "__place")
        out.append(numbered.filter(F.col("__place") - by_part(before) <= by_part(heads)).drop("__place").withColumn("copy", F.lit(0)))
    return reduce(DataFrame.unionByName, out) if out else mix.withColumn("copy", F.lit(0)).limit(0)


def contiguous_shard(row_index: Column, n: Column | int, k: int) -> Column:
    """Runs of n // k rows, the remainder in the last shard; all rows in the last if n < k. row_index counts from 0."""
    n = n if isinstance(n, Column) else F.lit(n)
    size = F.floor(n / k)
    return F.when(size == 0, F.lit(k - 1)).otherwise(F.least(F.floor(row_index / F.greatest(size, F.lit(1))), F.lit(k - 1))).cast("int")


def even_shard(row_index: Column, n: Column | int, k: int) -> Column:
    """k runs whose sizes differ by one at most, the longer first."""
    n = n if isinstance(n, Column) else F.lit(n)
    size, more = F.floor(n / k), n % k
    edge = more * (size + 1)
    return F.when(row_index < edge, F.floor(row_index / (size + 1))).otherwise(more + F.floor((row_index - edge) / F.greatest(size, F.lit(1)))).cast("int")


def merge_shards(shards: list[DataFrame], index: str = "original_index") -> DataFrame:
    """Rows of all shards in their original order, without the index."""
    return reduce(DataFrame.unionByName, shards).orderBy(index).drop(index)
