"""Events rolled up by the quarter hour, for metrics that read no events.

A row of the roll-up holds what the events of a quarter hour, thread, turn, project, model and effort add to every sum of metrics.py. These sums compose, and threads and turns stay
apart, so metrics by any local day or hour and any dimension, distinct counts and all-or-nothing sums among them, are the same from it as from events. (Bitmaps of numbered threads
and turns would do without their ids; but a quarter hour of one project and model has a few threads, for which a bitmap of four kilobytes is larger than the ids.)

Local days and hours of most zones begin on a quarter hour, since 1970 at least; aligned() tells. A range that doesn't is filled up with the events of its first and last quarter hour.
"""

import datetime as dt
import functools
import zoneinfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import merged, parts

TICK = dt.timedelta(minutes=15)
#: event_at is the time at which the quarter hour begins.
KEYS = ("event_at", "project", "model", "effort", "thread_id", "turn_id")


def roll_up(events: DataFrame) -> DataFrame:
    """KEYS and all sums of metrics.py, with first_at, last_at and project_min."""
    at, zero = F.col("event_at"), F.lit(0)
    tick = at - F.make_dt_interval(zero, zero, F.minute(at) % 15, F.extract(F.lit("SECOND"), at))
    rows = events.select(tick.alias("_at"), *(F.col(k).alias(f"_{k}") for k in KEYS[1:]), *parts())
    out = rows.groupBy("_at", *(f"_{k}" for k in KEYS[1:])).agg(*merged())
    return out.withColumnsRenamed({"_at": "event_at"} | {f"_{k}": k for k in KEYS[1:]})


def floor(at: dt.datetime) -> dt.datetime:
    return at - (at - dt.datetime(1, 1, 1)) % TICK


def ceil(at: dt.datetime) -> dt.datetime:
    return floor(at + TICK - dt.timedelta(microseconds=1))


@functools.lru_cache(64)
def aligned(zone: str, since: int = 1902) -> bool:
    """Whether all local days and hours of a zone from a year on, up to 2100, begin on a quarter hour: its offsets are whole ones, and clocks change on one."""
    where, day = zoneinfo.ZoneInfo(zone), dt.timedelta(days=1)
    offset = lambda at: at.replace(tzinfo=dt.UTC).astimezone(where).utcoffset()
    at, last = dt.datetime(since, 1, 1), None
    while at < dt.datetime(2100, 1, 1):
        now = offset(at)
        if now % TICK:
            return False
        if last is not None and now != last:
            a, b = at - day, at
            while b - a > dt.timedelta(seconds=1):
                middle = a + (b - a) // 2
                a, b = (middle, b) if offset(middle) == last else (a, middle)
            change = b.replace(microsecond=0)
            if (change - dt.datetime(1, 1, 1)) % TICK:
                return False
        at, last = at + day, now
    return True
