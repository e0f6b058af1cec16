import datetime as dt
import json

from tidemark.sources import account


def payloads(spark, *rows):
    return spark.createDataFrame([("a", json.dumps(r) if not isinstance(r, str) else r) for r in rows], "account_id string, data string")


def test_limits_over_http(spark):
    data = {
        "rate_limit": {"primary_window": {"used_percent": 101, "limit_window_seconds": 18000, "reset_at": 1_700_000_000}, "secondary_window": None},
        "additional_rate_limits": [{"limit_name": "More", "metered_feature": "f", "rate_limit": {"primary_window": {"used_percent": None, "limit_window_seconds": 0}}}, {"rate_limit": None}],
    }
    rows = {r.id: r for r in account.limits(payloads(spark, data), "http").collect()}
    assert list(rows) == ["main", "additional:f:0", "additional:1:1"]
    first = rows["main"].primary
    assert (first.used_percent, first.remaining_percent, first.window_minutes, first.resets_at) == (101, 0, 300, dt.datetime(2023, 11, 14, 22, 13, 20))
    assert rows["main"].secondary is None and rows["additional:1:1"].primary is None and rows["additional:1:1"].name == "Additional 2"
    more = rows["additional:f:0"]
    assert more.name == "More" and (more.primary.used_percent, more.primary.remaining_percent, more.primary.window_minutes, more.primary.resets_at) == (None, None, None, None)


def test_limits_over_rpc_prefer_the_map(spark):
    window = {"primary": {"usedPercent": 25.5, "windowDurationMins": 300, "resetsAt": None}}
    both = {"rateLimits": {}, "rateLimitsByLimitId": {"x": window | {"limitName": "X"}, "y": window}}
    rows = {r.id: r for r in account.limits(payloads(spark, both), "rpc").collect()}
    assert {k: r.name for k, r in rows.items()} == {"x": "X", "y": "y"} and rows["x"].primary.remaining_percent == 74.5
    assert [r.id for r in account.limits(payloads(spark, {"rateLimits": window, "rateLimitsByLimitId": {}}), "rpc").collect()] == ["main"]


def test_malformed(spark):
    rows = payloads(spark, {"other": 1}, "no json", {"rateLimits": None})
    assert account.malformed(rows, "rpc").count() == 2 and account.limits(rows, "rpc").count() == 1


def test_usage(spark):
    data = {"summary": {"lifetimeTokens": "9007199254740993", "peakDailyTokens": -1, "currentStreakDays": 2}, "dailyUsageBuckets": [{"startDate": "2026-09-01", "tokens": 5}, {"startDate": "2026-9-2", "tokens": 5}, {"startDate": "2026-09-03", "tokens": 1.5}, {"startDate": "2026-09-04", "tokens": "6"}]}
    rows = payloads(spark, data)
    r = account.usage_counters(rows).first()
    assert (r.lifetimeTokens, r.peakDailyTokens, r.longestRunningTurnSec, r.currentStreakDays) == (9007199254740993, None, None, 2)
    assert [(r.start_date, r.tokens) for r in account.daily_usage(rows).collect()] == [("2026-09-01", 5), ("2026-09-04", 6)]
    assert [r.tokens for r in account.daily_usage(rows, "2026-09-01", "2026-09-04").collect()] == [5]


def test_snapshots(spark):
    at = dt.datetime(2026, 9, 8)
    rows = spark.createDataFrame([(1, "a", "limits", at, "old", "i"), (3, "a", "limits", at, "new", "i"), (2, "b", "limits", at, "other", "j"), (4, "a", "usage", at, "u", "i")], "id long, account_id string, kind string, at timestamp_ntz, data string, identity_key string")
    latest = account.latest_snapshots(rows)
    assert {(r.id, r.data) for r in latest.collect()} == {(3, "new"), (2, "other"), (4, "u")}
    marked = account.with_state(latest, "i", account.F.lit(at + dt.timedelta(hours=1)).cast("timestamp_ntz"))
    assert {(r.id, r.confirmed, r.stale) for r in marked.collect()} == {(3, True, True), (2, False, True), (4, True, True)}


def test_combined_status(spark):
    kind = "part string, running boolean, updated_at timestamp_ntz, error string"
    a, b = dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 2)
    r = account.combined_status(spark.createDataFrame([("x", False, b, None), ("y", True, a, "e")], kind)).first()
    assert (r.running, r.updated_at, r.error) == (True, a, "e")
    assert account.combined_status(spark.createDataFrame([("x", False, b, None), ("y", False, None, None)], kind)).first().updated_at is None


def test_payloads_are_spread_and_their_buckets_made_once(spark):
    rows = spark.createDataFrame([("a", json.dumps({"rate_limit": None, "additional_rate_limits": []})), ("b", "{}"), (None, None)], "account_id string, data string").coalesce(1)
    found = account.limits(rows, "http")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RebalancePartitions" in plan and plan.count("$.additional_rate_limits") == 1
    assert [(r.account_id, r.id, r.primary) for r in found.collect()] == [("a", "main", None)]
    one = spark.createDataFrame([('{"used_percent": "7", "limit_window_seconds": 60, "reset_at": "x"}',)], "j string").select(account.window(account.F.col("j"), "http").alias("w")).first().w
    assert (one.used_percent, one.remaining_percent, one.window_minutes, one.resets_at) == (7, 93, 1, None)
