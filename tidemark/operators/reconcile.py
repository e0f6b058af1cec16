"""From all parsed events to the effective facts: one row for each thing that happened."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without_mirrors(events: DataFrame) -> DataFrame:
    """Drops legacy rows of a turn that has an explicit record in any file; a legacy row without a turn stays."""
    explicit = events.where((F.col("kind") == "record") & F.col("turn_id").isNotNull()).select(F.col("thread_id").alias("t"), F.col("turn_id").alias("u")).distinct()
    mirrored = (F.col("thread_id") == F.col("t")) & (F.col("turn_id") == F.col("u")) & (F.col("kind") == "legacy")
    return events.join(explicit, mirrored, "left_anti")


def one_per_key(events: DataFrame) -> DataFrame:
    """Of the copies of an event key over files, a complete one, and of those the first file's.

    A minimum of structs is combined before the shuffle, so copies of a hot key never meet in one task as rows.
    """
    rest = [c for c in events.columns if c not in ("event_key", "incomplete", "file")]
    first = events.groupBy("event_key").agg(F.min(F.struct("incomplete", "file", *rest)).alias("row"))
    return first.select("event_key", "row.*").select(*events.columns)


def effective(events: DataFrame) -> DataFrame:
    """The rule is global: a key is counted once, whatever threads its copies are under."""
    return one_per_key(without_mirrors(events.where("excluded = 0")))
