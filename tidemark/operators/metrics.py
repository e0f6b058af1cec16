"""The null-aware metrics of any grouping.

All of them are sums, counts and extremes, once threads and turns are told apart by grouping: events are first combined by the
keys with thread and turn, then with thread, then by the keys alone. So distinct counts cost no copies of the
rows, the first shuffle carries partial sums, and a hot group is spread over its threads and turns.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..schema import TOKENS

_SUMS = (
    *TOKENS, "events", "sound", "uncached", "whole", "ordinary", "write_missing", "incomplete_events", "paired_cached", "paired_input",
    "missing_usage", "invalid_usage", "legacy_events",
)


def parts() -> list[Column]:
    """What each event adds to every sum."""
    given, cached, write = (F.col(c) for c in TOKENS[:3])
    sound = (given >= cached) & (cached >= 0)
    whole = (given >= cached + write) & (cached >= 0) & (write >= 0)
    one = lambda c: F.when(c, 1).otherwise(0)
    paired = cached <= given
    return [
        *(F.col(t) for t in TOKENS),
        F.lit(1).alias("events"),
        one(sound).alias("sound"),
        (given - cached).alias("uncached"),
        one(whole).alias("whole"),
        (given - cached - write).alias("ordinary"),
        one(write.isNull()).alias("write_missing"),
        F.col("incomplete").alias("incomplete_events"),
        F.when(paired, cached).alias("paired_cached"),
        F.when(paired, given).alias("paired_input"),
        one(given.isNull() | cached.isNull() | F.col("output_tokens").isNull()).alias("missing_usage"),
        one(given < cached + F.coalesce(write, F.lit(0))).alias("invalid_usage"),
        one(F.col("kind") != "record").alias("legacy_events"),
        F.col("event_at").alias("first_at"),
        F.col("event_at").alias("last_at"),
        F.col("project").alias("project_min"),
    ]


def merged(extra: Sequence[Column] = ()) -> list[Column]:
    """The sums of parts(), or of sums of them."""
    return [*(F.sum(c).alias(c) for c in _SUMS), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.min("project_min").alias("project_min"), *extra]


def combined(events: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The keys with all partial sums, thread_count and turn_count. events may be rolled up (see rollup.py)."""
    own = [F.col(c) for c in (*_SUMS, "first_at", "last_at", "project_min")] if "paired_input" in events.columns else parts()
    names = [f"k_{n}" for n in keys]
    rows = events.select(*(c.alias(n) for n, c in zip(names, keys.values(), strict=True)), F.col("thread_id").alias("_thread"), F.col("turn_id").alias("_turn"), *own)
    by_turn = rows.groupBy(*names, "_thread", "_turn").agg(*merged())
    by_thread = by_turn.groupBy(*names, "_thread").agg(*merged([F.count("_turn").alias("turn_count")]))
    out = by_thread.groupBy(*names).agg(*merged([F.sum("turn_count").alias("turn_count"), F.count(F.lit(1)).alias("thread_count")]))
    return out.withColumnsRenamed(dict(zip(names, keys, strict=True)))


def finished() -> list[Column]:
    """The metric columns over combined rows. Sums over no events are 0; sums over events that report nothing are null."""
    none = F.coalesce(F.col("events"), F.lit(0)) == 0
    zero = F.lit(0).cast("bigint")
    total = lambda c: F.when(none, zero).otherwise(F.col(c)).cast("bigint")
    count = lambda c: F.coalesce(F.col(c), zero).cast("bigint")
    return [
        *(total(t).alias(t) for t in TOKENS),
        F.when(none, zero).when(F.col("sound") == F.col("events"), F.col("uncached")).cast("bigint").alias("uncached_input_tokens"),
        F.when(none, zero).when(F.col("whole") == F.col("events"), F.col("ordinary")).cast("bigint").alias("ordinary_input_tokens"),
        count("write_missing").alias("cache_write_missing_events"),
        count("events").alias("event_count"),
        count("thread_count").alias("thread_count"),
        count("turn_count").alias("turn_count"),
        ratio(F.col("paired_cached"), F.col("paired_input")).alias("cache_ratio"),
        count("incomplete_events").alias("incomplete_events"),
    ]


METRICS = (*TOKENS, "uncached_input_tokens", "ordinary_input_tokens", "cache_write_missing_events", "event_count", "thread_count", "turn_count", "cache_ratio", "incomplete_events")


def grouped(events: DataFrame, keys: dict[str, Column], *more: str) -> DataFrame:
    """The keys, the metrics, and of first_at, last_at and project_min those named."""
    return combined(events, keys).select(*(F.col(k) for k in keys), *finished(), *more)
