import math
import os

import pytest

from tests.logbook import Log
from tidemark.operators.parse import judged
from tidemark.operators.reconcile import effective
from tidemark.streaming import runs as module
from tidemark.streaming.refresh import Store
from tidemark.streaming.runs import Runs, parts_of


def pairs(df):
    return sorted((r.k or "", r.n, r.batch) for r in df.collect())


def put(spark, table, batch, keys, size=0):
    table.append(spark.createDataFrame([(k, batch * 100 + n) for n, k in enumerate(keys)], "k string, n int"), batch, size)
    return [(k, batch * 100 + n, batch) for n, k in enumerate(keys)]


def test_parts():
    assert [parts_of(n << 20) for n in (0, 64, 65, 128, 129, 1 << 20)] == [1, 1, 2, 2, 4, 1 << 14]


def test_few_runs_however_many_batches(spark, tmp_path):
    """Runs grow with the logarithm of the batches, and no row is lost or doubled."""
    table, rows = Runs(spark, str(tmp_path / "t"), "k", fan=3), []
    assert table.read() is None and table.batch(1) is None and table.merge() == 0
    for batch in range(1, 21):
        # a batch without rows, numbers that are left out, null and repeated keys
        rows += put(spark, table, batch * 2, [] if batch == 4 else [None, "a", "a", f"b{batch}"])
        table.merge()
        assert len(table.runs()) <= 2 * (math.log(batch, 3) + 1)
    assert pairs(table.read()) == sorted((k or "", n, b) for k, n, b in rows)
    assert len(table.read().inputFiles()) <= len(table.runs())
    assert sorted(r.n for r in table.batch(10).collect()) == [1000, 1001, 1002, 1003] and table.batch(8).count() == 0
    before = set(os.listdir(tmp_path / "t"))
    table.clean()
    left = {n for n in os.listdir(tmp_path / "t") if n.startswith("run-")}
    assert left == {r.name for r in table.runs()} < before and table.read().count() == len(rows)


def test_only_the_parts_of_wanted_keys_are_opened(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "PART_BYTES", 1 << 10)
    table = Runs(spark, str(tmp_path / "t"), "k", fan=4)
    rows = put(spark, table, 1, [f"k{n}" for n in range(2000)] + ["hot"] * 1000, size=60_000)
    rows += put(spark, table, 2, ["k7", "other"], size=10)
    assert [r.parts for r in table.runs()] == [64, 1]
    wanted = spark.createDataFrame([("k7",), ("hot",), ("nowhere",)], "x string")
    found = table.read(wanted)
    assert len(found.inputFiles()) <= 4 < len(table.read().inputFiles())
    assert sorted((r.k, r.n) for r in found.where("k in ('k7', 'hot')").collect()) == sorted(r[:2] for r in rows if r[0] in ("k7", "hot"))
    assert table.read(wanted.limit(0)).count() <= 2
    # a merged run is split by what it holds
    rows += put(spark, table, 3, ["k7"]) + put(spark, table, 4, ["k8"])
    assert table.merge() == 1 and len(table.runs()) == 1 and table.runs()[0].parts > 1
    assert pairs(table.read()) == sorted(rows)


def test_a_run_that_is_not_complete_is_not_seen(spark, tmp_path):
    table = Runs(spark, str(tmp_path / "t"), "k", fan=2)
    rows = put(spark, table, 1, ["a"])
    rows += put(spark, table, 2, ["b"])
    table.merge()
    (whole,) = table.runs()
    (tmp_path / "t" / whole.name / "_SUCCESS").unlink()
    assert [r.name for r in table.runs()] == ["run-1-1-0-1", "run-2-2-0-1"] and pairs(table.read()) == rows
    # the next trial of a batch replaces what the one before left, whatever its parts
    put(spark, table, 2, ["x"] * 5, size=1 << 30)
    put(spark, table, 2, ["b"])
    assert pairs(table.read()) == rows


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(module, "PART_BYTES", 1 << 8)


def test_a_store_of_joined_batches(spark, tmp_path, small):
    logs = tmp_path / "logs"
    logs.mkdir()
    store = Store(spark, str(tmp_path / "store"), fan=2)
    parent = Log().session("p").turn("t").totals(33, 33)
    child = Log(hour=11).fork("c", "p").turn("t")
    child.lines.append(parent.lines[-1])
    child.totals(45, 12)
    others = "".join(Log().session(f"o{k}").turn("t").spent(f"r{k}", 1).text() for k in range(40))
    for batch, files in enumerate(({"o": others, "c": child.text()}, {"p": parent.text()}, {"c": child.spent("r", 14).text("\n")}, {"o": " " + others}), 1):
        for name, text in files.items():
            (logs / f"{name}.jsonl").write_text(text)
        assert store.refresh([str(logs)], batch) == len(files)
        store.tidy()
    # four batches are one run, without the rows of the file that was read anew
    assert {name: len(t.runs()) for name, t in store.tables.items()} == dict.fromkeys(store.tables, 1)
    assert store._read("events").where("file like '%/o.jsonl'").select("batch").distinct().collect()[0].batch == 4
    found = {r.thread_id: r.n for r in store.effective().groupBy("thread_id").agg({"total_tokens": "sum"}).toDF("thread_id", "n").collect()}
    assert found == {"p": 33, "c": 14} | {f"o{k}": 1 for k in range(40)}
    facts = lambda df: sorted((r.event_key, r.file, r.total_tokens) for r in df.collect())
    assert facts(store.effective()) == facts(effective(judged(store.events(), store.threads())))
    one = store._events_of(spark.createDataFrame([("p",)], "id string"))
    assert [r.total_tokens for r in one.collect()] == [33]
    events = [f for f in one.inputFiles() if "/events/" in f]
    assert 1 <= len(events) < len(store._read("events").inputFiles())
