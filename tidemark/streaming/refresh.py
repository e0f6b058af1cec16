"""Keeping effective facts fresh as log files arrive and grow.

Every refresh adds a batch with the events of new and changed files; files that vanish keep theirs. A file that grew is read from where it ended, with the state that its lines had left
there (see operators/carry.py); one that no longer begins and ends as it did up to there is read again from its start, and its batches before no longer count. Files are read in
chunks, a task each.

Effective facts are stored by day. A late parent, copy or record changes the verdict on rows of other files, however old, so a batch is judged with all that it can touch, and
with nothing else:

* its tasks, those of its files before, and their children (a parent may have come);
* the event keys of these tasks, and all tasks that have one of the keys.

Events are split by task, and the tasks of keys by key, so only parts that hold one of them are read (see runs.py). Batches are joined to larger runs as they come, without the
rows of files that were read anew since, so the folders that a refresh opens don't grow with the number of batches. tidy() deletes what no longer counts.

Days on which such a key was or is effective are written anew, as the batch's version of them; the listing of versions, written last, makes them count. So a query
over a range reads its days only, and no verdict is taken twice. Each version of a day is rolled up with it, so metrics read no events.

Logs grow in place, which Spark's file source doesn't follow, so a refresh compares listings; for logs that are only ever added, new_files()
is a stream of listings, and each micro-batch is stored in the same way.
"""

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stored import discard, folder, materialise
from ..operators.carry import END, read_split, states
from ..operators.parse import STATE, TASK_ROWS, VERSION, decode, issues_of, judged, orphans, read_events, threads_of
from ..operators.reconcile import effective
from ..operators.rollup import roll_up
from ..plans.queries import RolledUsage
from ..schema import USAGE_EVENTS
from ..sources.logs import manifest, with_titles
from ..sources.ranges import CHUNK, fingerprints, read_ranges
from .runs import Runs

#: About how many bytes of a log become one of stored events; it decides how finely a batch is split, never what it holds.
LOG_TO_PARQUET = 8
#: Tasks for each chunk's worth of log: chunks are dealt by hash, so with so many a task gets a few at most, whatever the size of a batch.
SPREAD = 4


class Store:
    """events, keys (with their tasks), threads, issues, files, effective facts and their versions as Parquet below a folder that all executors see.

    A batch that failed half-way has no listing of files, so nothing of it is seen, and trying it again overwrites what it left. fan: how many batches are joined at once. One
    refresh at a time; any number of readers.
    """

    def __init__(self, spark: SparkSession, path: str, fan: int = 16):
        self.spark, self.path = spark, path.rstrip("/")
        keys = {"events": "thread_id", "keys": "event_key", "threads": None, "issues": None, "files": None, "versions": None}
        self.tables = {name: Runs(spark, f"{self.path}/{name}", key, fan) for name, key in keys.items()}

    def _read(self, name: str, of: DataFrame | None = None) -> DataFrame | None:
        return self.tables[name].read(of)

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        self.tables[name].append(df, batch)

    def _put(self, df: DataFrame, name: str, batch: int) -> DataFrame:
        """What only its batch reads."""
        path = f"{self.path}/{name}/batch={batch}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _listed(self, name: str) -> DataFrame | None:
        """All rows of a table, of batches that have a listing."""
        rows, files = self._read(name), self._read("files")
        return None if rows is None or files is None else rows.join(F.broadcast(files.select("batch").distinct()), "batch", "left_semi")

    def files(self, *more: str) -> DataFrame | None:
        """The latest listing of each file. since: the batch that read it from its start; more: print (its fingerprint), s (the state at its end)."""
        rows = self._read("files")
        kept = ("size", "modified", "version", "since", "batch", *more)
        return None if rows is None else rows.groupBy("file").agg(F.max_by(F.struct(*kept), "batch").alias("r")).select("file", "r.*")

    def _counting(self, rows: DataFrame) -> DataFrame:
        """Rows of the batches of each file since it was last read from its start."""
        counts = self._read("files").select("file", "batch").join(self.files().select("file", "since"), "file").where("batch >= since").select("file", "batch")
        return rows.join(counts, ["file", "batch"], "left_semi").select(*rows.columns)

    def _latest(self, name: str, of: DataFrame | None = None) -> DataFrame | None:
        rows = self._read(name, of)
        return None if rows is None or self._read("files") is None else self._counting(rows)

    def events(self) -> DataFrame | None:
        rows = self._latest("events")
        return None if rows is None else rows.drop("batch")

    def threads(self) -> DataFrame | None:
        rows = self._listed("threads")
        if rows is None:
            return None
        known = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("batch"))).alias(c)
        edge = lambda c: F.max_by(F.struct(F.col(c).alias("v")), "batch")["v"].alias(c)
        return rows.groupBy("id").agg(known("project"), known("source"), *(edge(c) for c in ("parent_id", "subagent_parent_id", "forked_from_id")))

    def issues(self) -> DataFrame | None:
        """file, line_no and issue of all lines that couldn't be used as they are."""
        rows = self._latest("issues")
        return None if rows is None else rows.drop("batch").unionByName(orphans(self.events(), self.threads()))

    def refresh(self, roots: Sequence[str], batch: int, chunk: int = CHUNK, pattern: str = "*.jsonl") -> int:
        """Reads what is new in the files that are new or changed since the last refresh; the number of them. Batches must rise."""
        now, had = manifest(self.spark, roots, VERSION, pattern), self.files()
        return self.store(now if had is None else now.join(had, ["file", "size", "modified", "version"], "left_anti"), batch, chunk)

    def _found(self, files: DataFrame) -> DataFrame:
        """files with start, from where they are to be read, print, since (null if from the start) and s (the state at start)."""
        had = self.files("print", "s")
        if had is None:
            had = self.spark.createDataFrame([], f"file string, size long, version int, since int, print string, s {STATE}")
        had = materialise(had.select("file", F.col("size").alias("had_size"), F.col("print").alias("had_print"), F.col("version").alias("had_version"), "since", "s"))
        known = files.join(had.drop("since", "s"), "file", "left").withColumn("had_size", F.when(F.col("had_version") == F.col("version"), F.col("had_size")))
        printed = fingerprints(known.select("file", "size", "modified", "version", "had_size", "had_print"))
        found = materialise(printed.select("file", "size", "modified", "version", "start", "print").join(had.select("file", "since", "s"), "file", "left"))
        discard(had)
        return found

    def store(self, files: DataFrame, batch: int, chunk: int = CHUNK) -> int:
        """Reads files (file, size, modified, version) and stores the batch; how many they are. The listing goes last but for the verdicts, which a reader of versions doesn't see before theirs."""
        found = self._found(files)
        n = found.count()
        if not n:
            discard(found)
            return 0
        on = (F.col("start") > 0) & F.col("s").isNotNull()
        found = materialise(found.withColumns({"start": F.when(on, F.col("start")).otherwise(0), "since": F.when(on, F.col("since")).otherwise(batch), "s": F.when(on, F.col("s"))}), found)
        # judged with the rows that the batch replaces, which no reader sees after the listing
        had, anew = self._latest("keys"), found.where("start = 0").select("file")
        again = had is not None and not anew.join(self.files().select("file"), "file", "left_semi").isEmpty()
        before = had.join(anew, "file", "left_semi").select("thread_id", "event_key").distinct() if again else self.spark.createDataFrame([], "thread_id string, event_key string")
        self._put(before, "replaced", batch)
        rows = materialise(decode(read_ranges(found, chunk)))
        kept = found.where("start > 0").select("file", "s")
        unread = found.agg(F.coalesce(F.sum(F.col("size") - F.col("start")), F.lit(0)).alias("n")).first().n
        size, tasks = unread // LOG_TO_PARQUET, 1 + SPREAD * unread // chunk
        begins = states(rows, None if kept.isEmpty() else kept, tasks)
        read = materialise(read_split(rows, begins, tasks), rows)
        self.tables["events"].append(read_events(read), batch, size)
        mine = self.tables["events"].batch(batch)
        self.tables["keys"].append(mine.select("event_key", "thread_id", "file").distinct(), batch, size)
        self._write(threads_of(read), "threads", batch)
        self._write(issues_of(read), "issues", batch)
        ends = begins.where(F.col("chunk") == END).select("file", "s")
        self._write(found.drop("s").join(ends, "file", "left"), "files", batch)
        discard(read, begins, found)
        self.judge(batch)
        self.compact()
        return n

    def _events_of(self, ids: DataFrame) -> DataFrame:
        """Events of the tasks in the column `id`; only their parts are read."""
        return self._latest("events", ids).drop("batch").join(ids.withColumnRenamed("id", "thread_id"), "thread_id", "left_semi")

    def _touched(self, batch: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """What a batch can touch: its event keys, the tasks that have one of them, and these with their parents."""
        threads = self.threads()
        mine = self.tables["keys"].batch(batch).select("thread_id", "event_key").unionByName(self.spark.read.parquet(f"{self.path}/replaced/batch={batch}"))
        own = mine.select(F.col("thread_id").alias("id")).unionByName(self.tables["threads"].batch(batch).select("id")).distinct()
        children = threads.join(own.withColumnRenamed("id", "parent_id"), "parent_id", "left_semi").select("id")
        tasks = self._put(own.unionByName(children).distinct(), "tasks", batch)
        keys = self._put(mine.select("event_key").unionByName(self._events_of(tasks).select("event_key")).distinct(), "touched", batch)
        wide = self._put(self._latest("keys", keys).join(keys, "event_key", "left_semi").select(F.col("thread_id").alias("id")).distinct(), "wide", batch)
        parents = self._events_of(wide).where("parent is not null").select(F.col("parent").alias("id"))
        return keys, wide, self._put(wide.unionByName(parents).distinct(), "judged", batch)

    def judge(self, batch: int) -> None:
        """Writes the verdicts that a stored batch can change. If a run failed before this, calling it again completes the batch."""
        keys, wide, ids = self._touched(batch)
        mine = self._events_of(ids)
        rows = judged(mine, self.threads(), 1 + mine.count() // TASK_ROWS).join(wide.withColumnRenamed("id", "thread_id"), "thread_id", "left_semi").select(*USAGE_EVENTS.fieldNames())
        new = effective(rows).join(keys, "event_key", "left_semi").withColumn("date", F.to_date("event_at"))
        new, had = self._put(new, "verdicts", batch), self._days()
        days, old = new.select("date").distinct(), None
        if had:
            old = self._of_days(had)
            days = days.unionByName(old.join(keys, "event_key", "left_semi").select("date")).distinct()
        # one row for each day that changes: a few thousand in ten years
        changed = sorted(r.date for r in days.collect())
        if old is not None and (kept := {d: had[d] for d in changed if d in had}):
            new = new.unionByName(self._of_days(kept).join(keys, "event_key", "left_anti").select(*new.columns))
        dealt = ("date", F.pmod(F.xxhash64("thread_id"), F.lit(16)))
        new.repartition(*dealt).write.mode("overwrite").partitionBy("date").parquet(f"{self.path}/effective/version={batch}")
        if changed:
            # a quarter hour is within one day
            # dealt before they are summed: a partial sum sorts all that its task has
            whole = self.spark.read.schema(new.schema).parquet(f"{self.path}/effective/version={batch}").hint("rebalance")
            rolled = roll_up(whole).withColumn("date", F.to_date("event_at"))
            rolled.repartition(*dealt).write.mode("overwrite").partitionBy("date").parquet(f"{self.path}/rolled/version={batch}")
        found = {r.date for r in self.spark.read.parquet(f"{self.path}/effective/version={batch}").select("date").distinct().collect()} if changed and not new.isEmpty() else set()
        self._write(self.spark.createDataFrame([(d, d in found) for d in changed], "date date, rows boolean"), "versions", batch)

    def compact(self) -> None:
        """Joins batches to runs. Rows that no reader sees are left out."""
        for name in ("events", "keys", "issues"):
            self.tables[name].merge(self._counting)
        for name in ("threads", "versions", "files"):
            self.tables[name].merge()

    def tidy(self) -> None:
        """Deletes runs and versions of days that no longer count, and what only its batch read; for when no reader is at work that began before the last refresh."""
        days = {(v, d.isoformat()) for d, v in self._days().items()}
        for table in self.tables.values():
            table.clean()
        for name in ("replaced", "tasks", "touched", "wide", "judged", "verdicts"):
            fs, at = folder(self.spark, f"{self.path}/{name}")
            fs.delete(at, True)
        for name in ("effective", "rolled"):
            fs, at = folder(self.spark, f"{self.path}/{name}")
            for version in fs.listStatus(at) if fs.exists(at) else ():
                number = int(version.getPath().getName().removeprefix("version="))
                for day in fs.listStatus(version.getPath()):
                    if (number, day.getPath().getName().removeprefix("date=")) not in days:
                        fs.delete(day.getPath(), True)
                if not any(v == number for v, _ in days):
                    fs.delete(version.getPath(), True)

    def _days(self) -> dict[dt.date, int]:
        """The version that counts of each day that has effective facts."""
        rows = self._read("versions")
        if rows is None:
            return {}
        last = rows.groupBy("date").agg(F.max_by(F.struct("batch", "rows"), "batch").alias("r"))
        return {r.date: r.batch for r in last.select("date", "r.*").collect() if r.rows}

    def _of_days(self, days: dict[dt.date, int], name: str = "effective") -> DataFrame:
        paths = [f"{self.path}/{name}/version={v}/date={d}" for d, v in sorted(days.items())]
        rows = self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*paths)
        rows = rows.withColumn("date", F.col("date").cast("date"))
        return rows.select(*USAGE_EVENTS.fieldNames(), "date") if name == "effective" else rows.drop("version")

    def _within(self, name: str, none: DataFrame, start: dt.datetime | None, end: dt.datetime | None) -> DataFrame:
        days = {d: v for d, v in self._days().items() if (start is None or d >= start.date()) and (end is None or dt.datetime.combine(d, dt.time()) < end)}
        return self._of_days(days, name).drop("date") if days else none

    def effective(self, start: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame:
        """The stored effective facts of [start, end), of which only its days are read."""
        rows = self._within("effective", self.spark.createDataFrame([], USAGE_EVENTS), start, end)
        at = F.col("event_at")
        within = [at >= F.lit(start).cast("timestamp_ntz")] * (start is not None) + [at < F.lit(end).cast("timestamp_ntz")] * (end is not None)
        for condition in within:
            rows = rows.where(condition)
        return rows

    def rolled(self, start: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame:
        """The roll-up of the days that [start, end) meets."""
        return self._within("rolled", roll_up(self.spark.createDataFrame([], USAGE_EVENTS)), start, end)

    def usage(self, start: dt.datetime | None = None, end: dt.datetime | None = None, prices: DataFrame | None = None, zone: str = "UTC", titles: DataFrame | None = None) -> RolledUsage:
        """The queries over what is stored of [start, end): metrics from roll-ups, and events of these days only where they are needed. titles: of read_titles()."""
        threads = self.threads()
        if threads is not None:
            threads = with_titles(threads, titles) if titles is not None else threads.withColumn("title", F.lit(None).cast("string"))
        return RolledUsage(self.effective(start, end), threads, prices, zone, self.rolled(start, end))

    def status(self) -> DataFrame:
        """One row: the last batch, files that are known and that it changed, effective events and issues."""
        files, none = self.files(), self.spark.createDataFrame([(0,)], "n long")
        if files is None:
            return none.select(F.lit(None).cast("int").alias("batch"), *(F.lit(0).cast("long").alias(c) for c in ("files", "files_changed", "events", "issues")))
        last = F.max("batch").alias("batch")
        counts = files.agg(last, F.count(F.lit(1)).alias("files"), F.count_if(F.col("batch") == files.agg(last).scalar()).alias("files_changed"))
        number = lambda df: df.agg(F.count(F.lit(1))).scalar()
        return counts.withColumns({"events": number(self.effective()), "issues": number(self.issues())})


#: What an answer from local logs has to be read with, by the condition on status() under which it holds.
CAVEATS = (("retained_logs_only", "true"), ("unattributed_lines", "issues > 0"), ("import_running", "running"))


def caveats(status: DataFrame, running: bool = False) -> DataFrame:
    """caveat: what holds for answers from a store in this status."""
    told = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(name)) for name, c in CAVEATS]))
    return status.withColumn("running", F.lit(running)).select(F.explode(told).alias("caveat"))


def new_files(spark: SparkSession, root: str) -> DataFrame:
    """A stream of new log files: file, size and modified."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", True).load(root)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def follow(store: Store, root: str, checkpoint: str):
    """Stores all files that have come since the last call, once each, and ends: a scheduled, exactly-once refresh."""

    def put(batch: DataFrame, number: int) -> None:
        store.store(batch.withColumn("version", F.lit(VERSION)), number)

    return new_files(store.spark, root).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
