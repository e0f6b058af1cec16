import datetime as dt

import pytest

from tests.logbook import Log
from tidemark.operators.parse import judged
from tidemark.operators.reconcile import effective
from tidemark.streaming.refresh import Store, caveats, follow


def facts(df):
    return sorted((r.event_key, r.file, r.thread_id, r.total_tokens, r.incomplete, r.kind) for r in df.collect())


def total(store):
    """By task; and the stored facts are those of judging everything anew."""
    found = store.effective()
    assert facts(found) == facts(effective(judged(store.events(), store.threads())))
    return {r.thread_id: r.n for r in found.groupBy("thread_id").agg({"total_tokens": "sum"}).toDF("thread_id", "n").collect()}


@pytest.fixture()
def place(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    store = Store(spark, str(tmp_path / "store"))
    batches = iter(range(1, 100))

    def refresh(**files):
        for name, log in files.items():
            path = tmp_path / "logs" / f"{name}.jsonl"
            path.write_text(log.text()) if log else path.unlink()
        return store.refresh([str(tmp_path / "logs")], next(batches))

    return store, refresh


def test_late_parents_records_and_vanished_files(place):
    store, refresh = place
    parent = Log().session("p").turn("t").totals(33, 33)
    child = Log(hour=11).fork("c", "p").turn("t")
    child.lines.append(parent.lines[-1])
    child.totals(45, 12)
    assert refresh(c=child) == 1 and total(store) == {}
    # the parent comes later, and ends the doubt about its child
    assert refresh(p=parent) == 1 and total(store) == {"p": 33, "c": 12}
    assert store.effective().where("incomplete = 1").count() == 0
    assert refresh() == 0
    # the record replaces the child's mirrored totals of the same turn; a vanished file keeps its events
    child.spent("r", 14)
    assert refresh(c=child, p=None) == 1 and total(store) == {"p": 33, "c": 14}


def test_copies_of_a_key_over_days_and_files(place, spark):
    store, refresh = place
    first = Log().session("a").turn("t").spent("k", 5, at="2031-03-01T10:00:00Z").spent("m", 6, at="2031-03-02T10:00:00Z").spent("n", 7, at="2031-03-03T10:00:00Z")
    refresh(b=first)
    assert total(store) == {"a": 18}
    # a copy in a file that comes first wins, with another day and task
    refresh(a=Log().session("z").spent("k", 50, at="2031-03-04T10:00:00Z"))
    assert total(store) == {"a": 13, "z": 50}
    # only the days of the key were written anew
    assert {d.day: v for d, v in store._days().items()} == {2: 1, 3: 1, 4: 2}
    # a rewritten file gives back what it took
    refresh(a=Log().session("z").spent("q", 1, at="2031-03-04T11:00:00Z"))
    assert total(store) == {"a": 18, "z": 1}
    plan = store.effective(dt.datetime(2031, 3, 2, 9), dt.datetime(2031, 3, 3))
    assert [r.total_tokens for r in plan.collect()] == [6] and len(plan.inputFiles()) == 1 and "date=2031-03-02" in plan.inputFiles()[0]
    assert store.effective(dt.datetime(2031, 4, 1)).count() == 0


def test_grown_and_rewritten_files(spark, tmp_path):
    """What was read isn't read again: lines in the middle that change unseen keep what they gave, until the file's beginning or end tells that it is another."""
    logs = tmp_path / "logs"
    logs.mkdir()
    store, path = Store(spark, str(tmp_path / "store")), logs / "a.jsonl"
    log = Log().session("a").turn("t")
    for k in range(200):
        log.spent(f"r{k}", 1)
    log.totals(50, 50)
    half = '{"type": "token_usage_record", "payl'
    path.write_text(log.text(half))
    assert store.refresh([str(logs)], 1, chunk=9000) == 1 and total(store) == {"a": 200}
    size = path.stat().st_size
    assert size > 3 * 8192
    lines = log.text().encode()
    middle = lines.index(b'"r100"')
    path.write_bytes(lines[:middle] + b'"r1xx"' + lines[middle + 6 :] + Log(hour=20).turn("u").totals(57, limit="x").spent("last", 3).raw("{").text().encode())
    # the half line was replaced, so the end tells; the file is read anew
    assert store.refresh([str(logs)], 2, chunk=9000) == 1 and total(store) == {"a": 203}
    text = path.read_bytes()
    path.write_bytes(text[:middle] + b'"r1yy"' + text[middle + 6 :] + Log(hour=21).turn("v").totals(61).spent("more", 4).raw("{").text().encode())
    assert store.refresh([str(logs)], 3, chunk=9000) == 1
    read = {r.batch: r["size"] - r.start for r in store._read("files").collect()}
    assert read[2] == len(text) and read[3] < 1000
    keys = {r.event_key for r in store.effective().collect()}
    assert "response:r1xx" in keys and "response:r1yy" not in keys and "response:more" in keys
    # line numbers count on; the total goes on from the maximum of the lines before
    assert sorted((r.line_no, r.issue) for r in store.issues().collect()) == [(206, "json"), (210, "json")]
    assert {r.total_tokens for r in store.events().where("kind = 'legacy' and turn_id = 'v'").collect()} == {4}
    path.write_bytes(b" " + path.read_bytes())
    assert store.refresh([str(logs)], 4, chunk=9000) == 1 and "response:r1yy" in {r.event_key for r in store.effective().collect()}
    assert facts(store.effective()) == facts(effective(judged(store.events(), store.threads())))


def test_a_batch_that_failed_is_tried_again(place, spark, monkeypatch):
    store, refresh = place
    refresh(a=Log().session("a").spent("1", 5))
    write = Store._write

    def failing(self, df, name, batch):
        if name == "files":
            raise OSError("no more disk")
        write(self, df, name, batch)

    monkeypatch.setattr(Store, "_write", failing)
    with pytest.raises(OSError):
        refresh(b=Log().session("b").spent("2", 6))
    monkeypatch.setattr(Store, "_write", write)
    assert total(store) == {"a": 5}
    assert store.refresh([str(store.path).replace("store", "logs")], 2) == 1 and total(store) == {"a": 5, "b": 6}


def test_status_and_caveats(place):
    store, refresh = place
    assert tuple(store.status().first()) == (None, 0, 0, 0, 0)
    refresh(a=Log().session("a").spent("1", 5).raw("{"), b=Log().fork("b", "nobody").totals(4, 4))
    refresh(a=Log().session("a").spent("1", 5).raw("{").spent("2", {"input_tokens": 1}))
    assert tuple(store.status().first()) == (2, 2, 1, 1, 3)
    assert sorted((r.line_no, r.issue) for r in store.issues().collect()) == [(1, "orphan"), (2, "json"), (3, "total")]
    assert {r.caveat for r in caveats(store.status()).collect()} == {"retained_logs_only", "unattributed_lines"}


def test_new_files_as_a_stream(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    store = Store(spark, str(tmp_path / "store"))
    for k, name in enumerate(("a", "b")):
        (logs / f"{name}.jsonl").write_text(Log().session(name).turn("t").spent(name, 11 + k).text())
        follow(store, str(logs), str(tmp_path / "checkpoint")).awaitTermination()
    assert total(store) == {"a": 11, "b": 12}
    assert store.files().count() == 2
