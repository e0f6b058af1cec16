import datetime as dt
import random

from tidemark.operators.filters import Filter
from tidemark.operators.rollup import aligned, ceil, floor, roll_up
from tidemark.plans.queries import RolledUsage, Usage
from tidemark.schema import USAGE_EVENTS


def events(spark, seed=3, n=400):
    """Around the days on which clocks change, some at whole quarter hours, with counts that are missing, excessive and large."""
    r = random.Random(seed)
    rows = []
    for k in range(n):
        day = r.choice([dt.datetime(2031, 3, 8, 22), dt.datetime(2031, 11, 1, 22), dt.datetime(2031, 7, 1)])
        at = day + r.choice([dt.timedelta(minutes=15 * r.randint(0, 200)), dt.timedelta(microseconds=r.randint(0, 180_000_000_000))])
        counts = [r.choice([None, 0, 7, 100, (1 << 53) + 3]) for _ in range(6)]
        dims = (r.choice([None, "/a/b", "/c"]), r.choice([None, "m"]), r.choice(["low", "high"]))
        rows.append(("f", f"k{k}", f"t{r.randint(0, 5)}", r.choice([None, "u1", "u2"]), None, at, *dims, r.choice(["record", "legacy"]), None, *counts, r.randint(0, 1), 0))
        if k % 3 == 0:  # another one of its quarter hour, turn and dimensions
            rows.append((*rows[-1][:1], f"l{k}", *rows[-1][2:9], "record", None, *counts[::-1], 0, 0))
    return spark.createDataFrame(rows, USAGE_EVENTS)


def told(df):
    return sorted((tuple(sorted(r.asDict(True).items())) for r in df.collect()), key=repr)


def test_rolled_metrics_are_those_of_events(spark):
    rows = events(spark).cache()
    threads = spark.createDataFrame([("t1", "Title")], "id string, title string")
    rolled = roll_up(rows).cache()
    assert rolled.count() < rows.count()
    ranges = [Filter(), Filter(start=dt.datetime(2031, 3, 9, 3, 7, 1), end=dt.datetime(2031, 11, 2, 9, 59)), Filter(start=dt.datetime(2031, 3, 9, 3, 1), end=dt.datetime(2031, 3, 9, 3, 20)), Filter(start=dt.datetime(2031, 11, 2, 5, 45), effort="low", unknown={"model"})]
    for zone in ("America/New_York", "Asia/Kathmandu"):
        one, two = Usage(rows, threads, None, zone), RolledUsage(rows, threads, None, zone, rolled)
        for f in ranges if zone != "Asia/Kathmandu" else ranges[1:2]:
            assert told(two.summary(f)) == told(one.summary(f))
            assert told(two.trend(f, "hour")) == told(one.trend(f, "hour"))
    f = ranges[1]
    assert told(two.trend(f)) == told(one.trend(f)) and told(two.breakdown(f)) == told(one.breakdown(f))
    assert told(two.threads_page(f, cache_below=0.9, q="tit")) == told(one.threads_page(f, cache_below=0.9, q="tit"))
    assert told(two.turns(f)) == told(one.turns(f)) and told(two.filter_values(f)) == told(one.filter_values(f))


def test_zones_without_whole_quarters_use_events(spark):
    assert all(aligned(z, 1970) for z in ("UTC", "America/New_York", "Asia/Shanghai", "Asia/Kathmandu", "Australia/Lord_Howe")) and not aligned("Africa/Monrovia", 1970)
    assert aligned("America/New_York") and not aligned("Asia/Kathmandu")
    # its clocks changed at a minute past midnight
    assert not aligned("America/St_Johns", 1970)
    rows = events(spark)
    two = RolledUsage(rows, None, None, "America/St_Johns", roll_up(rows))
    assert told(two.trend(size="hour")) == told(Usage(rows, None, None, "America/St_Johns").trend(size="hour"))


def test_quarter_hours():
    at = dt.datetime(2031, 5, 20, 10, 7, 30)
    assert (floor(at), ceil(at)) == (dt.datetime(2031, 5, 20, 10), dt.datetime(2031, 5, 20, 10, 15))
    assert floor(floor(at)) == ceil(floor(at)) == floor(at)


def test_long_ranges_are_filled_if_asked(spark):
    rows = events(spark, n=30)
    f = Filter(start=dt.datetime(2031, 1, 1), end=dt.datetime(2031, 12, 31))
    two = RolledUsage(rows, None, None, "America/New_York", roll_up(rows))
    some, all_ = two.trend_filled(f, "hour").collect(), two.trend_filled(f, "hour", most=None).collect()
    assert all(r.has_records for r in some) and len(all_) == 364 * 24 and len({r.time for r in all_}) == len(all_)
    assert [r.time for r in all_ if r.has_records] == [r.time for r in some]
