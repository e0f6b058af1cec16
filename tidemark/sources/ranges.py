"""Logs by ranges of bytes: a large file is read by many tasks, and one that grew only from where it ended.

A line belongs to the range that holds its line feed. So ranges that follow one another share no line and lose none, wherever they are cut, and what follows
a file's last line feed waits for the range that ends it. A task looks back from its range for the beginning of its first line.

Files are opened by the executors through the Arrow file system of their address (local or mounted folders, HDFS, S3, GCS).
"""

import hashlib
import posixpath
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: line_no counts from 0 in each chunk; a row without doc ends a chunk and has the number of its lines.
SPLIT_LINES = "file string, chunk long, line_no long, doc string"
#: Bytes of a range that is read at once; of the ends of a file that are compared; of steps back.
CHUNK, ENDS, STEP = 32 << 20, 4096, 1 << 16
#: Lines and bytes of a batch.
ROWS, BYTES = 10_000, 8 << 20

_KIND = pa.schema([("file", pa.string()), ("chunk", pa.int64()), ("line_no", pa.int64()), ("doc", pa.string())])


def _open(file: str):
    system, path = fs.FileSystem.from_uri(file) if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", file) else (fs.LocalFileSystem(), file)
    return system.open_input_file(path)


def _beginning(source, at: int) -> int:
    """Where the line begins that holds the byte before `at`, if that is no line feed."""
    while at:
        step = min(at, STEP)
        found = source.read_at(step, at - step).rfind(b"\n")
        if found >= 0:
            return at - step + found + 1
        at -= step
    return 0


def read_range(file: str, start: int, end: int) -> Iterator[pa.RecordBatch]:
    """SPLIT_LINES of the lines whose line feed lies in [start, end); chunk is start."""
    lines = 0
    with _open(file) as source:
        first = _beginning(source, start)
        data = np.frombuffer(source.read_at(end - first, first), np.uint8)
    feeds = np.flatnonzero(data == 10)
    feeds = feeds[feeds >= start - first]
    if len(feeds):
        text = data[: feeds[-1] + 1]
        ends = feeds - np.arange(len(feeds))  # without the line feeds before
        begins = np.concatenate(([0], ends[:-1]))
        text = text[text != 10]
        while lines < len(feeds):
            stop = min(len(feeds), lines + ROWS, max(lines + 1, int(np.searchsorted(ends, begins[lines] + BYTES, "right"))))
            offsets = np.concatenate(([begins[lines]], ends[lines:stop])) - begins[lines]
            part = np.ascontiguousarray(text[begins[lines] : ends[stop - 1]])
            docs = pa.StringArray.from_buffers(stop - lines, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(part))
            n = stop - lines
            yield pa.record_batch([pa.array([file] * n), pa.array(np.full(n, start)), pa.array(np.arange(lines, stop)), docs], schema=_KIND)
            lines = stop
    yield pa.record_batch([pa.array([file]), pa.array([start]), pa.array([lines]), pa.array([None], pa.string())], schema=_KIND)


def read_ranges(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """SPLIT_LINES of files: file, start and size; what lies before start, and after size, isn't read but for the beginning of the first line."""
    ranges = files.where("size > start").select("file", "size", F.explode(F.sequence(F.col("start"), F.col("size") - 1, F.lit(chunk).cast("long"))).alias("chunk"))
    ranges = ranges.select("file", "chunk", F.least(F.col("chunk") + chunk, "size").alias("end"))
    cores = files.sparkSession.sparkContext.defaultParallelism
    n = files.agg(F.sum(F.ceil((F.col("size") - F.col("start")) / chunk))).first()[0] or 0

    def run(batches):
        for batch in batches:
            for file, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from read_range(file, start, end)

    return ranges.repartition(int(max(1, min(n, 16 * cores)))).mapInArrow(run, SPLIT_LINES)


def fingerprint(file: str, size: int) -> str:
    """A digest of the first and the last bytes up to a size."""
    with _open(file) as source:
        some = source.read_at(min(size, ENDS), 0) + source.read_at(min(size, ENDS), max(0, size - ENDS))
    return hashlib.sha256(some).hexdigest()


def fingerprints(files: DataFrame) -> DataFrame:
    """files (with file, size, had_size and had_print) and start: had_size where the file still begins with what it had, else 0; print: the fingerprint of size."""
    columns = [*files.columns, "start", "print"]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + ", start long, print string"

    def run(batches):
        for batch in batches:
            rows = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("file", "size", "had_size", "had_print")]
            start, prints = [], []
            for file, size, had, before in zip(*rows, strict=True):
                start.append(had if had is not None and had <= size and fingerprint(file, had) == before else 0)
                prints.append(fingerprint(file, size))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(start, pa.int64()), pa.array(prints, pa.string())], names=columns)

    return files.mapInArrow(run, kind)


class _Range(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


def _listing(roots: Sequence[str], suffix: str) -> dict[str, int]:
    """Sizes of the files below the roots."""
    out = {}
    for root in roots:
        system, path = fs.FileSystem.from_uri(root) if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", root) else (fs.LocalFileSystem(), root)
        begin = root[: len(root) - len(path)] if root.endswith(path) else ""
        for info in system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)):
            if info.type == fs.FileType.File and info.path.endswith(suffix) and not posixpath.basename(info.path).startswith((".", "_")):
                out[begin + info.path] = info.size
    return out


def _ranges(had: dict[str, int], now: dict[str, int], chunk: int) -> list[_Range]:
    return [_Range(file, at, min(size, at + chunk)) for file, size in sorted(now.items()) for at in range(had.get(file, 0), size, chunk)]


class _Whole(DataSourceReader):
    def __init__(self, source: "TailSource"):
        self.source = source

    def partitions(self):
        return _ranges({}, _listing(self.source.roots, self.source.suffix), self.source.chunk) or [_Range("", 0, 0)]

    def read(self, partition):
        return read_range(partition.file, partition.start, partition.end) if partition.file else iter(())


class _Growing(DataSourceStreamReader):
    """Offsets are the sizes of all files. A file that became smaller is read again from its start."""

    def __init__(self, source: "TailSource"):
        self.source = source

    def initialOffset(self):
        return {}

    def latestOffset(self):
        return _listing(self.source.roots, self.source.suffix)

    def partitions(self, start, end):
        return _ranges({f: n for f, n in start.items() if n <= end.get(f, 0)}, end, self.source.chunk)

    def read(self, partition):
        return read_range(partition.file, partition.start, partition.end)


class TailSource(DataSource):
    """spark.read or spark.readStream .format("jsonl_tail").option("chunk", bytes).load(folder): SPLIT_LINES of all logs below a folder; as a stream, of what is appended and added.

    For logs of one producer: the driver holds a size for each file. Store.refresh() lists in Spark.
    """

    @classmethod
    def name(cls):
        return "jsonl_tail"

    def __init__(self, options):
        super().__init__(options)
        self.roots, self.suffix, self.chunk = [options["path"]], options.get("suffix", ".jsonl"), int(options.get("chunk", CHUNK))

    def schema(self):
        return SPLIT_LINES

    def reader(self, schema):
        return _Whole(self)

    def streamReader(self, schema):
        return _Growing(self)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TailSource)
