import datetime as dt

import pytest

from tests.logbook import Log
from tidemark.sources import account
from tidemark.streaming.answers import account_answer, local_answer
from tidemark.streaming.refresh import Store


def told(answer):
    return sorted(r.caveat for r in answer.caveats.collect())


def test_local_answers_carry_caveats_and_counters(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    none = local_answer(spark.createDataFrame([], "event_count long"), store)
    assert told(none) == ["retained_logs_only"] and none.updated_at is None
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.jsonl").write_text(Log().session("a").spent("1", 5).raw("{").spent("2", 7).text())
    store.refresh([str(tmp_path / "logs")], 1)
    answer = local_answer(store.usage().breakdown(by="model"), store, running=True)
    assert told(answer) == ["import_running", "retained_logs_only", "unattributed_lines"]
    assert [r.total_tokens for r in answer.rows.collect()] == [12]
    assert answer.counters == {"rows": 1, "events": 2} and answer.source == "local" and answer.updated_at is not None


def test_account_answers(spark):
    at = dt.datetime(2031, 5, 1)
    latest = spark.createDataFrame([(1, "a", "limits", at, "{}", "me", "http", None)], "id long, account_id string, kind string, at timestamp_ntz, data string, identity_key string, provider string, error string")
    rows = spark.range(3)
    sound = account_answer(rows, "limits", account.with_state(latest.withColumn("provider", account.F.lit("rpc")), "me"))
    assert told(sound) == ["limits_are_snapshots"] and sound.updated_at == at
    assert sound.rows.count() == 3 and sound.counters == {"rows": 3}
    later = account.F.lit(at + dt.timedelta(days=1)).cast("timestamp_ntz")
    bad = account_answer(rows, "usage", account.with_state(latest.withColumn("error", account.F.lit("no answer")), "other", later))
    assert told(bad) == ["identity_unconfirmed", "missing_days_are_not_zero", "read_over_http", "refresh_failed", "stale"]
    assert told(account_answer(rows, "usage", latest.limit(0))) == ["identity_unconfirmed", "missing_days_are_not_zero"]
    with pytest.raises(ValueError):
        account_answer(rows, "other", latest)
