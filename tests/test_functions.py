import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars, timebuckets
from tidemark.operators.cost import costs, preset_prices, price_table
from tidemark.operators.filters import Filter
from tidemark.operators.hierarchy import related, subtree
from tidemark.operators.metrics import grouped


def one(spark, column, **values):
    row = [tuple(values.values())]
    kinds = ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame(row, kinds).select(column.alias("x")).first().x


PATHS = [
    ("C:\\Work\\Demo\\", "c:\\work\\demo"), ("C:/Work/../Demo", "c:\\demo"), ("\\\\?\\C:\\Work", "c:\\work"), ("\\\\?\\UNC\\Server\\Share\\Demo", "\\\\server\\share\\demo"),
    ("\\\\Server\\Share\\Demo\\", "\\\\server\\share\\demo"), ("C:\\", "c:\\"), ("//Server/Share/Demo", "\\\\server\\share\\demo"), ("\\\\Server\\Share\\", "\\\\server\\share\\"), ("/", "/"),
    ("/Users/中文 空格/Project/../Demo/", "/Users/中文 空格/Demo"), ("/Users/A/file\\name", "/Users/A/file\\name"), ("", None), (None, None), ("a/./b/../../..", ".."), ("/../x", "/x"),
]


def test_paths(spark):
    rows = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PATHS)], "i int, p string").select("i", scalars.project_path(F.col("p")).alias("x")).orderBy("i").collect()
    assert [r.x for r in rows] == [want for _, want in PATHS]


def test_scalars(spark):
    big = 9223372036854775807
    rows = spark.createDataFrame([(1, 3), (2, 0), (-1, 3), (big, big), (big, 7), (5, None)], "a long, b long")
    assert [r.x for r in rows.select(scalars.ratio(F.col("a"), F.col("b")).alias("x")).collect()] == [0.333333, None, -0.333333, 1.0, pytest.approx((big * 10**6 // 7) / 10**6, rel=1e-15), None]
    labels = spark.createDataFrame([(x,) for x in ("/a/b/", "c:\\x\\y", "/", None, "", "plain")], "v string").select(scalars.label(F.col("v")).alias("x")).collect()
    assert [r.x for r in labels] == ["b", "y", "/", "unknown", "unknown", "plain"]
    assert one(spark, scalars.money(F.col("n").cast("decimal(38,0)")), n=16325000000) == "0.016325000000"
    assert one(spark, scalars.money(F.col("n").cast("decimal(38,0)")), n=-1) == "-0.000000000001"
    numbers = spark.createDataFrame([(x,) for x in ("7", "1.5", "true", "-1", "9223372036854775807", "9223372036854775808", None)], "v string").select(scalars.whole_number(F.col("v")).alias("x")).collect()
    assert [r.x for r in numbers] == [7, None, None, None, big, None, None]
    times = spark.createDataFrame([(x,) for x in ("2026-09-08T04:00:00.123Z", "2026-09-08T04:00:00.1239+02:00", "never", "2026-09-08", None, "1969-12-31T23:59:59.999Z")], "v string").select(scalars.instant(F.col("v")).alias("x")).collect()
    assert [r.x for r in times] == [dt.datetime(2026, 9, 8, 4, 0, 0, 123000), dt.datetime(2026, 9, 8, 2, 0, 0, 123000), None, dt.datetime(2026, 9, 8), None, dt.datetime(1969, 12, 31, 23, 59, 59, 999000)]
    assert [one(spark, scalars.compact(F.col("n")), n=n) for n in (999, 1234, 1_200_000, 2_345_678_901, -1500)] == ["999", "1.23K", "1.2M", "2.34B", "-1.5K"]
    assert one(spark, scalars.found_in(F.col("s"), "ÉaB"), s="xÉAb") and not one(spark, scalars.found_in(F.col("s"), "éab"), s="xÉAb")
    assert one(spark, scalars.title_of(F.col("t"), F.col("p"), F.col("i")), t=None, p="/w/demo", i="0123456789") == "demo · 01234567"


NEW_YORK = "America/New_York"


@pytest.mark.parametrize(("day", "hours"), [(dt.date(2026, 3, 8), 23), (dt.date(2026, 11, 1), 25)])
def test_days_of_changing_clocks(spark, day, hours):
    start, end = timebuckets.bucket_range(day.isoformat(), "day", NEW_YORK)
    assert end - start == dt.timedelta(hours=hours)
    rows = timebuckets.spine(spark, start, end, NEW_YORK, "hour").collect()
    assert len(rows) == hours == len({r.time for r in rows})
    days = timebuckets.spine(spark, start, end, NEW_YORK, "day").collect()
    assert [(r.time, r.bucket_start_utc) for r in days] == [(day.isoformat(), start)]
    assert timebuckets.spine(spark, start, start + dt.timedelta(days=100), NEW_YORK, "hour") is None
    for r in rows:
        assert timebuckets.bucket_range(r.time, "hour", NEW_YORK)[0] == r.bucket_start_utc


def test_ranges():
    now = dt.datetime(2026, 11, 2, 12, tzinfo=dt.UTC)
    assert timebuckets.calendar_range(2, NEW_YORK, now) == (dt.datetime(2026, 11, 1, 4), dt.datetime(2026, 11, 2, 12))
    for days in (0, 3661):
        with pytest.raises(ValueError):
            timebuckets.calendar_range(days, NEW_YORK, now)
    a = dt.datetime(2026, 11, 1, 4)
    pick = lambda kind, hours, **k: timebuckets.pick_bucket(kind, a, a + dt.timedelta(hours=hours), NEW_YORK, **k)
    assert [pick("today", 5), pick("week", 168), pick("custom", 24), pick("custom", 25), pick("custom", 26), pick("custom", -1), pick("week", 1, explicit="hour")] == ["hour", "day", "hour", "hour", "day", "day", "hour"]
    assert timebuckets.bucket_range("2026-11-01", "day", NEW_YORK, a + dt.timedelta(days=3)) is None


EVENT = "thread_id string, turn_id string, event_at timestamp_ntz, project string, model string, kind string, input_tokens long, cached_input_tokens long, cache_write_input_tokens long, output_tokens long, reasoning_output_tokens long, total_tokens long, incomplete int"


def events(spark, *rows):
    return spark.createDataFrame([("t", turn, dt.datetime(2026, 9, 8), None, model, "record", *tokens, None, sum(x or 0 for x in tokens), 0) for turn, model, *tokens in rows], EVENT)


def test_cost_goldens(spark):
    luna = events(spark, ("1", "gpt-5.6-luna", 1_000_000, 0, 0, 10_000))
    sol = events(spark, ("1", "gpt-5.6-sol", 1200, 200, 100, 100), ("2", "gpt-5.6-sol", 300_000, 100_000, 0, 1000))
    prices = preset_prices(spark)
    exact = lambda rows, p=prices: costs(rows, p, {}).first()
    # 1,000,000 tokens over the threshold, so the long prices
    assert exact(luna).amount == "0.418000000000"
    # 1000 * 4 + 200 * 0.4 + 100 * (5 - 4) + 100 * 20, and 200000 * 8 + 100000 * 0.8 + 1000 * 30, per million
    assert exact(sol).amount == "1.716180000000" and exact(sol).complete
    missing = exact(events(spark, ("1", "gpt-5.6-sol", 1000, 0, None, 0)))
    assert missing.amount == "0.004000000000" and not missing.complete
    other = exact(events(spark, ("1", "other", 1000, 0, 0, 0)))
    assert other.amount is None and other.notes == ["no price for other"]
    assert exact(sol.limit(0)).amount == "0.000000000000" and exact(sol.limit(0)).complete
    for bad in ([("m", "1.1234567", *[None] * 8)], [("m", *["1"] * 4, None, *[None] * 4)] * 2):
        with pytest.raises(ValueError):
            price_table(spark, bad)


def test_null_aware_metrics(spark):
    rows = events(spark, ("1", "m", 100, 40, 10, 5), (None, "m", 50, None, None, 5), ("1", "n", 10, 20, 0, 5))
    r = grouped(rows, {"model": F.col("model")}).orderBy("model").collect()
    assert (r[0].input_tokens, r[0].uncached_input_tokens, r[0].cache_ratio, r[0].turn_count, r[0].thread_count, r[0].cache_write_missing_events) == (150, None, 0.4, 1, 1, 1)
    assert (r[1].uncached_input_tokens, r[1].cache_ratio) == (None, None)
    empty = grouped(rows.limit(0), {}).first()
    assert (empty.input_tokens, empty.uncached_input_tokens, empty.event_count, empty.cache_ratio) == (0, 0, 0, None)
    nothing = grouped(rows.where("cached_input_tokens is null"), {}).first()
    assert nothing.cached_input_tokens is None


def test_filters(spark):
    rows = events(spark, ("1", "m", 1, 0, 0, 0), (None, None, 2, 0, 0, 0))
    assert [r.input_tokens for r in Filter().drill("model", None).apply(rows).collect()] == [2]
    assert [r.input_tokens for r in Filter(turn=None).apply(rows).collect()] == [2]
    assert Filter(threads=()).apply(rows).count() == 0 and Filter(threads=tuple(map(str, range(500))) + ("t",)).apply(rows).count() == 2
    for bad in ({"unknown": {"model"}, "model": "m"}, {"unknown": {"x"}}, {"start": dt.datetime(2026, 1, 2), "end": dt.datetime(2026, 1, 1)}):
        with pytest.raises(ValueError):
            Filter(**bad)


def test_trees(spark):
    rows = [("root", None, None), ("child", "root", None), ("nested", "child", None), ("sibling", "root", None), ("fork", None, "root"), ("forkchild", "fork", None), ("a", "b", None), ("b", "a", None), ("dual", "root", "root")]
    threads = spark.createDataFrame([(i, up, fork, fork or up, None) for i, up, fork in rows] + [("old", None, None, "root", None)], "id string, subagent_parent_id string, forked_from_id string, parent_id string, title string")
    assert [(r.id, r.depth) for r in subtree(threads, "root").orderBy("path").collect()] == [("root", 0), ("child", 1), ("nested", 2), ("dual", 1), ("sibling", 1)]
    assert {r.id for r in subtree(threads, "a").collect()} == {"a", "b"} and subtree(threads, "none").count() == 0
    assert {(r.id, r.relation) for r in related(threads, "root").collect()} == {("child", "subagent"), ("sibling", "subagent"), ("fork", "fork"), ("dual", "fork"), ("dual", "subagent"), ("old", "unknown")}
    assert {(r.id, r.relation) for r in related(threads, "dual").collect()} == {("root", "subagent_parent"), ("root", "fork_parent")}
