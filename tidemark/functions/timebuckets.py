"""Local days and hours of UTC times, calendar ranges and gap-filling spines.

A bucket is named by local time: a day by its date, an hour with its offset, so that the hour that comes twice in autumn is two
buckets. Filters stay on the raw UTC column, where they reach the scan.
"""

import datetime as dt
import zoneinfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BUCKETS = 2000


def local(at: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), at)


def offset_minutes(at: Column, zone: str) -> Column:
    """Of the zone from UTC at that time."""
    gap = local(at, zone) - at
    return F.extract(F.lit("DAY"), gap) * 1440 + F.extract(F.lit("HOUR"), gap) * 60 + F.extract(F.lit("MINUTE"), gap)


def _utc_offset(minutes: Column) -> Column:
    size = F.abs(minutes)
    return F.concat(F.when(minutes < 0, "-").otherwise("+"), F.lpad(F.floor(size / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((size % 60).cast("int").cast("string"), 2, "0"))


def bucket(at: Column, zone: str, size: str) -> Column:
    """The name of the local day or hour."""
    there = local(at, zone)
    if size == "day":
        return F.date_format(there, "yyyy-MM-dd")
    return F.concat(F.date_format(there, "yyyy-MM-dd'T'HH"), F.lit(":00:00.000"), _utc_offset(offset_minutes(at, zone)))


def bucket_start(at: Column, zone: str, size: str) -> Column:
    """The UTC time at which the local bucket begins."""
    there = local(at, zone)
    if size == "day":
        return F.convert_timezone(F.lit(zone), F.lit("UTC"), F.to_date(there).cast("timestamp_ntz"))
    return at - (there - _hour(there))


def _hour(there: Column) -> Column:
    zero = F.lit(0)
    return F.make_timestamp_ntz(F.year(there), F.month(there), F.day(there), F.hour(there), zero, zero.cast("decimal(16,6)"))


def _utc(moment: dt.datetime) -> dt.datetime:
    return moment.astimezone(dt.UTC).replace(tzinfo=None)


def calendar_range(days: int, zone: str, now: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
    """From the local midnight `days` - 1 days ago to now, in UTC without a zone. now: aware."""
    if not 1 <= days <= 3660:
        raise ValueError("days must be between 1 and 3660")
    where = zoneinfo.ZoneInfo(zone)
    first = now.astimezone(where).date() - dt.timedelta(days=days - 1)
    return _utc(dt.datetime.combine(first, dt.time(), where)), _utc(now)


def pick_bucket(kind: str, start: dt.datetime | None, end: dt.datetime | None, zone: str, explicit: str | None = None) -> str:
    """Hours for today, for custom ranges of a day or less and within one local day; else days, unless named."""
    if explicit:
        return explicit
    if kind == "today":
        return "hour"
    if kind != "custom" or not start or not end or end <= start:
        return "day"
    where = zoneinfo.ZoneInfo(zone)
    first, last = (x.replace(tzinfo=dt.UTC).astimezone(where).date() for x in (start, end - dt.timedelta(milliseconds=1)))
    return "hour" if end - start <= dt.timedelta(hours=24) or first == last else "day"


def bucket_range(name: str, size: str, zone: str, start: dt.datetime | None = None, end: dt.datetime | None = None) -> tuple[dt.datetime, dt.datetime] | None:
    """The UTC range of a bucket within [start, end), or None if nothing is left. A local day may have 23 or 25 hours."""
    if size == "day":
        where, day = zoneinfo.ZoneInfo(zone), dt.date.fromisoformat(name)
        a, b = (_utc(dt.datetime.combine(x, dt.time(), where)) for x in (day, day + dt.timedelta(days=1)))
    else:
        a = _utc(dt.datetime.fromisoformat(name))
        b = a + dt.timedelta(hours=1)
    a, b = max(a, start or a), min(b, end or b)
    return (a, b) if a < b else None


def spine(spark: SparkSession, start: dt.datetime, end: dt.datetime, zone: str, size: str, most: int | None = MOST_BUCKETS) -> DataFrame | None:
    """time and bucket_start_utc of every bucket that meets [start, end); None for more than `most`, if that isn't None."""
    hours = (end - start).total_seconds() / 3600
    if most is not None and (hours if size == "hour" else hours / 24) > most:
        return None
    one = spark.range(1).select(F.lit(start).cast("timestamp_ntz").alias("a"), (F.lit(end).cast("timestamp_ntz") - F.expr("INTERVAL '0.001' SECOND")).alias("z"))
    a, z = F.col("a"), F.col("z")
    if size == "hour":
        # offsets can be half hours, so the first local hour is found before counting on
        first = a - (local(a, zone) - _hour(local(a, zone)))
        ticks = one.select(F.explode(F.sequence(first, z, F.expr("INTERVAL 1 HOUR"))).alias("at"))
    else:
        days = F.sequence(local(a, zone).cast("date"), local(z, zone).cast("date"))
        noon = lambda d: F.convert_timezone(F.lit(zone), F.lit("UTC"), d.cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS"))
        ticks = one.select(F.explode(F.transform(days, noon)).alias("at"))
    return ticks.select(bucket(F.col("at"), zone, size).alias("time"), bucket_start(F.col("at"), zone, size).alias("bucket_start_utc")).distinct()
