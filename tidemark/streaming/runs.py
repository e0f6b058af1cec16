"""Tables that grow batch by batch, in few folders however many batches there are.

A batch is a run: a Parquet folder named by its first and last batch, its level and its number of parts. When `fan` runs of one level are the last ones, they become one
run of the next level, so n batches are at most (fan - 1) runs a level and log(n) levels, and each row is written once a level. A run with a key is split into parts by the key's
hash, a power of two of them and one for each 64 MiB, so the rows of some keys are found in their parts alone.

A run counts once it is complete, and then instead of those within it. These stay until clean() is called, for readers that have begun.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stored import folder

PART_BYTES = 64 << 20


def parts_of(size: int) -> int:
    """A power of two."""
    return 1 << (max(0, size - 1) // PART_BYTES).bit_length()


def _hash(key: str) -> Column:
    return F.xxhash64(key)


@dataclass(frozen=True, order=True)
class Run:
    first: int
    last: int
    level: int
    parts: int

    @property
    def name(self) -> str:
        return f"run-{self.first}-{self.last}-{self.level}-{self.parts}"

    def holds(self, other: "Run") -> bool:
        return self.first <= other.first and other.last <= self.last


class Runs:
    """key: the column by which runs are split; fan: how many runs become one. Rows have a column `batch`."""

    def __init__(self, spark: SparkSession, path: str, key: str | None = None, fan: int = 16):
        self.spark, self.path, self.key, self.fan = spark, path, key, fan

    def _complete(self) -> list[Run]:
        fs, at = folder(self.spark, self.path)
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        runs = [Run(*map(int, n.split("-")[1:])) for n in names if n.startswith("run-")]
        return [r for r in runs if fs.exists(folder(self.spark, f"{self.path}/{r.name}/_SUCCESS")[1])]

    def runs(self) -> list[Run]:
        """Those that count, by batch."""
        found: list[Run] = []
        for run in sorted(self._complete(), key=lambda r: (r.first, -r.last, -r.level)):
            if not any(f.holds(run) for f in found):
                found.append(run)
        return found

    def _folders(self, run: Run, hashes: set[int] | None) -> list[str]:
        """The run's parts that have rows, and may have rows of these hashes."""
        fs, at = folder(self.spark, f"{self.path}/{run.name}")
        wanted = None if hashes is None else {h % run.parts for h in hashes}
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return [f"{self.path}/{run.name}/{n}" for n in names if n.startswith("part=") and (wanted is None or int(n[5:]) in wanted)]

    def _schema(self) -> T.StructType:
        # a run without rows has no file that tells its columns
        return self.spark.read.parquet(f"{self.path}/columns").schema

    def _load(self, runs: list[Run], hashes: set[int] | None = None) -> DataFrame | None:
        if not runs:
            return None
        folders, columns = [f for r in runs for f in self._folders(r, hashes)], self._schema()
        return self.spark.read.schema(columns).parquet(*folders) if folders else self.spark.createDataFrame([], columns)

    def read(self, of: DataFrame | None = None) -> DataFrame | None:
        """All rows; or those of parts that hold the keys in the one column of `of`, which may have others beside."""
        runs = self.runs()
        most = max((r.parts for r in runs), default=1)
        if of is None or most == 1:
            return self._load(runs)
        # at most as many numbers as the largest run has parts
        hashes = {r.h for r in of.select(F.pmod(_hash(of.columns[0]), F.lit(most)).alias("h")).distinct().collect()}
        return self._load(runs, hashes)

    def batch(self, number: int) -> DataFrame | None:
        rows = self._load([r for r in self.runs() if r.first <= number <= r.last])
        return None if rows is None else rows.where(F.col("batch") == number)

    def _write(self, df: DataFrame, run: Run) -> None:
        part = F.pmod(_hash(self.key), F.lit(run.parts)) if self.key else F.lit(0)
        # small parts share a task, and one that a hot key makes large is written by many
        df.withColumn("part", part).hint("rebalance", F.col("part")).write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/{run.name}")

    def append(self, df: DataFrame, batch: int, size: int = 0) -> None:
        """size: about the bytes that df takes. What an earlier trial of the batch left goes."""
        fs, at = folder(self.spark, self.path)
        for left in (s.getPath() for s in fs.listStatus(at)) if fs.exists(at) else ():
            if left.getName().startswith(f"run-{batch}-{batch}-"):
                fs.delete(left, True)
        df = df.withColumn("batch", F.lit(batch))
        if not fs.exists(folder(self.spark, f"{self.path}/columns/_SUCCESS")[1]) or self._schema().simpleString() != df.schema.simpleString():
            df.limit(0).write.mode("overwrite").parquet(f"{self.path}/columns")
        self._write(df, Run(batch, batch, 0, parts_of(size) if self.key else 1))

    def merge(self, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> int:
        """Joins runs as long as the last `fan` are of one level; how often. keep: what is left of their rows."""
        for times in range(64):
            last = self.runs()[-self.fan :]
            if len(last) < self.fan or len({r.level for r in last}) > 1:
                return times
            rows = self._load(last)
            size = sum(fs.getContentSummary(at).getLength() for fs, at in (folder(self.spark, f"{self.path}/{r.name}") for r in last))
            whole = Run(last[0].first, last[-1].last, last[0].level + 1, parts_of(size) if self.key else 1)
            self._write(keep(rows), whole)
        return 64

    def clean(self) -> None:
        """Deletes runs that no longer count; for when no reader is at work that began before they did not."""
        counts = {r.name for r in self.runs()}
        fs, at = folder(self.spark, self.path)
        for one in fs.listStatus(at) if fs.exists(at) else ():
            if one.getPath().getName().startswith("run-") and one.getPath().getName() not in counts:
                fs.delete(one.getPath(), True)
