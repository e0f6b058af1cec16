"""The example history: through logs, store and queries, against its totals and against plain Python."""

import datetime as dt
import zoneinfo
from collections import defaultdict

import pytest

from tidemark.operators.filters import Filter
from tidemark.plans.queries import Usage
from tidemark.sources import history
from tidemark.sources.logs import read_titles
from tidemark.streaming.refresh import Store

ZONES = ("America/New_York", "Asia/Shanghai", "UTC")
DAY = dt.datetime(2026, 9, 8)
FILTERS = {
    "all": Filter(),
    "one day": Filter(start=DAY, end=DAY + dt.timedelta(days=1)),
    "dimensions": Filter(project="/work/desk", model="large", effort="high"),
    "unknown model": Filter(unknown={"model"}),
    "future": Filter(start=dt.datetime(2030, 1, 1)),
    "one thread": Filter(thread="session-01"),
}


@pytest.fixture(scope="module")
def usage(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("history")
    history.write_logs(spark, str(folder / "logs"))
    store = Store(spark, str(folder / "store"))
    assert store.refresh([str(folder / "logs")], 1, chunk=20_000, pattern="*.txt") > 0
    return store.usage(titles=read_titles(spark, str(folder / "logs-titles"))[0])


def test_totals_of_the_example(usage):
    s = usage.summary().first()
    assert (s.total_tokens, s.thread_count, s.turn_count, s.incomplete_events) == (119_210_000, 28, 92, 0)
    assert [(r.time, r.total_tokens) for r in usage.trend().collect()] == [(f"2026-09-{2 + k:02d}", n) for k, n in enumerate(history.EXAMPLE.days)]
    assert {r.key: r.total_tokens for r in usage.breakdown().collect()} == {"/work/desk": 48_600_000, "/work/api": 35_200_000, "/work/notes": 21_410_000, "/work/play": 14_000_000}
    one = usage.summary(Filter(thread="session-01")).first()
    assert (one.input_tokens, one.output_tokens) == (17_800_000, 400_000)
    assert {r.part: r.total_tokens for r in usage.team("session-01").collect()} == {"self": 18_200_000, "subagents": 30_400_000, "team": 48_600_000}
    assert [(r.id, r.depth, r.title) for r in usage.agents("session-01").collect()] == [("session-01", 0, "Session 1"), ("session-02", 1, "Session 2"), ("session-04", 2, "Session 4"), ("session-03", 1, "Session 3")]
    shared = [r for r in usage.turns(Filter(thread="session-01"), sort="oldest").collect() if len(r.composition) > 1]
    assert [(r.turn_id, [(c.model, c.total_tokens) for c in r.composition]) for r in shared] == [("turn-03", [("large", 3_200_000), ("small", 1_000_000)])]


def test_copies_are_histories_of_their_own(spark):
    e = history.events(spark, copies=5)
    rows = e.selectExpr("count(distinct thread) n", "count(distinct response) = count(*) own", "sum(usage.total_tokens) total").first()
    assert (rows.n, rows.own, rows.total) == (5 * 28, True, 5 * 119_210_000)
    with pytest.raises(ValueError):
        history.events(spark, history.History((5,), (("p", (6,)),)))


def passes(f, r):
    return (
        (f.start is None or r.event_at >= f.start) and (f.end is None or r.event_at < f.end) and all(getattr(f, n) is None or getattr(r, c) == getattr(f, n) for n, c in (("project", "project"), ("model", "model"), ("effort", "effort"), ("thread", "thread_id")))
        and not ("model" in f.unknown and r.model is not None)
    )


def add(rows):
    """What a few metrics are, by hand."""
    return (sum(r.total_tokens for r in rows), sum(r.input_tokens - r.cached_input_tokens for r in rows), len(rows), len({r.thread_id for r in rows}), len({(r.thread_id, r.turn_id) for r in rows}))


def got(r):
    return (r.total_tokens, r.uncached_input_tokens, r.event_count, r.thread_count, r.turn_count)


@pytest.mark.parametrize("name", sorted(FILTERS))
def test_filters_and_zones_by_hand(usage, name):
    f = FILTERS[name]
    rows = [r for r in usage.events.collect() if passes(f, r)]
    assert got(usage.summary(f).first()) == add(rows)
    groups = defaultdict(list)
    for r in rows:
        groups[r.model].append(r)
    assert {r.key: got(r) for r in usage.breakdown(f, "model").collect()} == {k: add(v) for k, v in groups.items()}
    for zone in ZONES:
        days = defaultdict(list)
        for r in rows:
            days[r.event_at.replace(tzinfo=dt.UTC).astimezone(zoneinfo.ZoneInfo(zone)).strftime("%Y-%m-%d")].append(r)
        own = type(usage)(usage.events, usage.threads, None, zone, usage.rolled)
        assert {r.time: got(r) for r in own.trend(f).collect()} == {k: add(v) for k, v in days.items()}
    if name == "all":
        plain = Usage(usage.events, usage.threads)
        assert plain.summary(f).first() == usage.summary(f).first()
