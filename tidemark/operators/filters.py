"""One declarative filter for all queries, as column predicates that reach the scan."""

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import found_in
from ..schema import DIMENSIONS
from .search import TextIndex

#: Longer id lists become a semi-join.
MOST_INLINE = 200
ANY = object()


@dataclass(frozen=True)
class Filter:
    """start <= event_at < end (UTC); equality on dimensions; unknown: names of dimensions that must be null.

    turn: ANY, a turn id, or None for events without one. threads: ids, of which an empty list lets nothing pass. q: a
    literal search in thread ids, projects and titles, and turn ids if search_turns.
    """

    start: dt.datetime | None = None
    end: dt.datetime | None = None
    project: str | None = None
    model: str | None = None
    effort: str | None = None
    thread: str | None = None
    unknown: frozenset[str] = frozenset()
    turn: object = ANY
    threads: tuple[str, ...] | None = None
    q: str | None = None
    search_turns: bool = False

    def __post_init__(self):
        object.__setattr__(self, "unknown", frozenset(self.unknown))
        if self.start and self.end and self.start >= self.end:
            raise ValueError("start must be before end")
        for name in self.unknown:
            if name not in DIMENSIONS:
                raise ValueError(f"no dimension {name}")
            if getattr(self, name) is not None:
                raise ValueError(f"{name} can't be both unknown and {getattr(self, name)!r}")

    def but(self, **changes) -> "Filter":
        return replace(self, **changes)

    def drill(self, dimension: str, key: str | None) -> "Filter":
        """Down into one group of a breakdown; its null group becomes a condition on unknown values."""
        return self.but(**{dimension: key}) if key is not None else self.but(unknown=self.unknown | {dimension})

    def condition(self) -> Column:
        out = F.lit(True)
        if self.start is not None:
            out &= F.col("event_at") >= F.lit(self.start).cast("timestamp_ntz")
        if self.end is not None:
            out &= F.col("event_at") < F.lit(self.end).cast("timestamp_ntz")
        for name, column in DIMENSIONS.items():
            if getattr(self, name) is not None:
                out &= F.col(column) == getattr(self, name)
            if name in self.unknown:
                out &= F.col(column).isNull()
        if self.turn is not ANY:
            out &= F.col("turn_id").eqNullSafe(F.lit(self.turn))
        if self.threads is not None and len(self.threads) <= MOST_INLINE:
            out &= F.col("thread_id").isin(*self.threads) if self.threads else F.lit(False)
        return out

    def apply(self, events: DataFrame, threads: DataFrame | None = None, index: TextIndex | None = None) -> DataFrame:
        """threads: for searches in titles; index: to search in instead, which finds the same."""
        rows = events.where(self.condition())
        if self.threads is not None and len(self.threads) > MOST_INLINE:
            wanted = rows.sparkSession.createDataFrame([(t,) for t in self.threads], "thread_id string")
            rows = rows.join(wanted.distinct(), "thread_id", "left_semi")
        needle = (self.q or "").strip()
        if not needle:
            return rows
        if index is not None:
            return index.rows(rows, needle, self.search_turns)
        hit = found_in(F.col("thread_id"), needle) | found_in(F.col("project"), needle)
        if self.search_turns:
            hit |= found_in(F.col("turn_id"), needle)
        if threads is None:
            return rows.where(hit)
        titled = threads.where(found_in(F.col("title"), needle)).select(F.col("id").alias("thread_id")).distinct().withColumn("titled", F.lit(True))
        return rows.join(titled, "thread_id", "left").where(hit | F.col("titled").isNotNull()).drop("titled")
