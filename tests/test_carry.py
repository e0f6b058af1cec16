"""Logs cut into chunks, and logs that grow, give what whole files give."""

import random

import pytest
from pyspark.sql import functions as F

from tests.logbook import Log
from tidemark.functions.stored import discard, materialise
from tidemark.operators import carry, parse
from tidemark.sources import logs, ranges


def scribble(seed, lines=70):
    """A log with all that lines carry and forget: sessions of a few threads, contexts, records, totals of several limits, and lines of no use."""
    r = random.Random(seed)
    log = Log()
    for k in range(lines):
        what = r.random()
        if what < 0.08:
            log.session(r.choice("abc"), cwd=r.choice(["/srv/x", None]), **({"forked_from_id": r.choice("pq")} if r.random() < 0.3 else {}))
        elif what < 0.12:
            log.put("session_meta", {"cwd": "/srv/none"})
        elif what < 0.24:
            log.turn(r.choice(["t1", "t2", None]), r.choice(["big", None]), r.choice(["low", "high"]), **({"cwd": "/srv/y"} if r.random() < 0.4 else {}))
        elif what < 0.4:
            log.spent(f"{seed}-{k}" if r.random() < 0.8 else None, r.choice([1, 5, {"input_tokens": 3}]), at=r.choice(["now", "now", "never"]))
        elif what < 0.85:
            total = r.choice([None, r.randint(0, 60), 40])
            log.totals(total, r.randint(0, 9) if total is None or r.random() < 0.4 else None, r.choice([None, "weekly", "daily"]), at="now" if r.random() < 0.95 else None)
        elif what < 0.92:
            log.raw(r.choice(["", "  ", "{", '{"type": "other"}', "[1]", '{"type":"event_msg","payload":7}', "ünï\r"]))
        else:
            log.lines.append(log.lines[-1] if log.lines else "x")
    return log.text()


def written(folder, texts):
    for name, text in texts.items():
        (folder / f"{name}.jsonl").write_bytes(text.encode() if isinstance(text, str) else text)


def told(read):
    """All that is made of lines."""
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    events = parse.read_events(read)
    return rows(events.select(sorted(events.columns))), rows(parse.threads_of(read)), rows(parse.issues_of(read))


def listing(spark, folder):
    return logs.manifest(spark, [str(folder)], 1).select("file", F.lit(0).cast("long").alias("start"), "size")


def split(lines, kept=None):
    rows = materialise(parse.decode(lines))
    begins = carry.states(rows, kept)
    return carry.read_split(rows, begins), begins, rows


def test_random_cuts(spark, tmp_path):
    written(tmp_path, {f"f{seed}": scribble(seed) for seed in range(6)} | {"empty": "", "tail": "no end", "6f3c2d10-11aa-4b5e-8c77-90ab12cd34ef": scribble(9, 12)})
    want = told(parse.read_lines(logs.read_logs(spark, [str(tmp_path)])))
    assert len(want[0]) > 50 and len(want[2]) > 20
    for chunk in (90, 1500):
        read, begins, rows = split(ranges.read_ranges(listing(spark, tmp_path), chunk))
        assert begins.count() > (100 if chunk == 90 else 8)
        assert told(read) == want
        discard(begins, rows)


def test_grown_files(spark, tmp_path):
    """Each file is read in three steps from where it ended; a step may end within a line, and within a character."""
    r = random.Random(8)
    texts = {f"f{seed}": scribble(seed, 50).encode() for seed in range(5)}
    kept, events, threads, issues, had = None, [], [], [], dict.fromkeys(texts, 0)
    for step in range(3):
        now = {n: t if step == 2 else t[: r.randint(had[n], len(t))] for n, t in texts.items()}
        written(tmp_path, now)
        files = listing(spark, tmp_path)
        starts = spark.createDataFrame([(n, s) for n, s in had.items()], "name string, start long")
        files = files.drop("start").withColumn("name", F.regexp_extract("file", "(f[0-9])[.]", 1)).join(starts, "name").select("file", "start", "size")
        read, begins, _ = split(ranges.read_ranges(files, 700), kept)
        e, t, i = told(read)
        events, issues, threads = events + e, issues + i, t
        ends = begins.where(F.col("chunk") == carry.END).select("file", "s")
        # a file without new lines keeps its state
        kept = materialise(ends if kept is None else ends.unionByName(kept.join(ends, "file", "left_anti")))
        had = {n: len(t) for n, t in now.items()}
    want = told(parse.read_lines(logs.read_logs(spark, [str(tmp_path)])))
    assert (sorted(events, key=repr), sorted(issues, key=repr)) == (want[0], want[2])


@pytest.mark.parametrize("text", [b"", b"\n", b"a\nbb\n\nccc", b"a" * 40 + b"\nb\n", "ünï\ncödé\r\n\n".encode() * 5, b"\n" * 9, b"\xff\n\xfe\n"])
def test_ranges_share_no_line_and_lose_none(tmp_path, text):
    path = tmp_path / "x.jsonl"
    path.write_bytes(text)
    want = text.split(b"\n")[:-1]
    for size in range(1, len(text) + 2):
        found = []
        for start in range(0, len(text), size):
            batches = list(ranges.read_range(str(path), start, min(len(text), start + size)))
            lines = [x for b in batches for x in b.column("doc").cast("binary").to_pylist()]
            assert lines[-1] is None and batches[-1].column("line_no")[0].as_py() == len(lines) - 1
            assert [n for b in batches for n in b.column("line_no").to_pylist()] == list(range(len(lines)))
            found += lines[:-1]
        assert found == want


def test_long_lines_and_small_batches(tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "STEP", 3)
    monkeypatch.setattr(ranges, "BYTES", 5)
    monkeypatch.setattr(ranges, "ROWS", 2)
    r = random.Random(1)
    want = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in range(60)]
    path = tmp_path / "x.jsonl"
    path.write_bytes(b"".join(x + b"\n" for x in want))
    size = path.stat().st_size
    found = [x for s in range(0, size, 17) for b in ranges.read_range(str(path), s, min(size, s + 17)) for x in b.column("doc").to_pylist() if x is not None]
    assert [x.encode() for x in found] == want


def test_source_of_lines_as_batch_and_stream(spark, tmp_path):
    ranges.register(spark)
    (tmp_path / "logs").mkdir()
    texts = {f"f{seed}": scribble(seed, 20) for seed in range(3)}
    written(tmp_path / "logs", texts)
    lines = lambda df: sorted((r.file.rpartition("/")[2], r.doc) for r in df.where("doc is not null").collect())
    want = lambda: sorted((f"{n}.jsonl", x) for n, t in texts.items() for x in t.split("\n")[:-1])
    assert lines(spark.read.format("jsonl_tail").option("chunk", 300).load(str(tmp_path / "logs"))) == want()

    def follow():
        stream = spark.readStream.format("jsonl_tail").option("chunk", 300).load(str(tmp_path / "logs"))
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
        return lines(spark.read.parquet(str(tmp_path / "out")))

    assert follow() == want()
    texts |= {"f1": texts["f1"] + "one more\nand half", "new": "a\n"}
    written(tmp_path / "logs", texts)
    assert follow() == want()
    texts["f1"] += " a line\n"
    written(tmp_path / "logs", texts)
    assert follow() == want()


def test_chunks_are_dealt_apart_and_sorted_once(spark):
    rows = parse.decode(spark.createDataFrame([("f", c, 0, '{"type":"session_meta","timestamp":"2026-01-01T00:00:00Z","payload":{"id":"a","cwd":"/x"}}') for c in range(8)], "file string, chunk long, line_no long, doc string"))
    begins = spark.createDataFrame([], f"file string, chunk long, s {carry.STATE}")
    read = carry.read_split(rows, begins, 32)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "REPARTITION_BY_NUM" in plan and plan.count("Exchange hashpartitioning") == 1
