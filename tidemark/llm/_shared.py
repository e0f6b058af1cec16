"""What the operators share about Spark itself."""

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.stored import materialise, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches, size: int = 2 << 20):
    """Slices of whole rows with about `size` bytes of text each: what a task computes on is small, whatever the session's Arrow batches are. batches: with a column text, or arrays of texts."""
    for batch in batches:
        texts = batch if isinstance(batch, pa.Array) else batch.column("text")
        row, rows = 0, len(texts)
        sizes = pc.cumulative_sum(pc.fill_null(pc.binary_length(texts), 0).cast("int64")).to_numpy() if rows else ()
        while row < rows:
            stop = max(row + 1, int(np.searchsorted(sizes, (sizes[row - 1] if row else 0) + size, "right")))
            yield batch.slice(row, stop - row)
            row = stop


def release() -> None:
    """Gives memory that this Python worker has freed back to the system: idle workers live on, beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: In a Python worker: what clears the caches that operators keep there for their next task, and the operator that ran last.
_caches: list[Callable[[], None]] = []
_last: list[str] = []


def kept(clear: Callable[[], None]) -> None:
    """Registers what clears a cache of this worker."""
    _caches.append(clear)


def begin(operator: str) -> None:
    """A worker serves one operator after another: what one keeps for its next task goes as another one's begins, so that no stage holds the tables of those before."""
    if _last != [operator]:
        if _last:
            for clear in _caches:
                clear()
            release()
        _last[:] = [operator]


def released(run):
    """The function for mapInArrow, with begin() before and release() after each partition."""
    operator = run.__module__

    def runs(batches):
        begin(operator)
        try:
            yield from run(batches)
        finally:
            release()

    return runs


def answered(docs: DataFrame, answers, schema: str, row: bool = False, *more: Column) -> DataFrame:
    """For every row of docs its doc_id, or if row a struct `row` of all its columns, whatever their names; more; and what `answers` finds in its text.

    answers: from an Arrow array of texts, arrays by the names of schema. Only texts go to Python; a row's other columns stay where they are.
    """
    kind, operator = T._parse_datatype_string(schema), answers.__module__

    def run(texts: pa.Array) -> pa.Array:
        begin(operator)
        found = [answers(part) for part in sliced([texts])]
        release()
        columns = [pa.concat_arrays([f[c] for f in found]) if found else pa.array([], to_arrow_type(t.dataType)) for c, t in zip(kind.names, kind, strict=True)]
        return pa.StructArray.from_arrays(columns, names=kind.names)

    # taken for nondeterministic, so that no filter on the result has it computed twice
    find = F.arrow_udf(run, kind).asNondeterministic()
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row") if row else F.col("doc_id").cast("long").alias("doc_id")
    out = docs.select(own, *more, find(F.col("text").cast("string")).alias("found"))
    return out.select(*out.columns[:-1], "found.*")


def let(value: Column, body) -> Column:
    """body of the value, which is computed once and not wherever body names it."""
    return F.transform(F.array(value), body)[0]


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text modulo folds; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def within(rows: list, most_bytes: int) -> list:
    """Those of some rows with a size that are within most_bytes together, in order: one that would pass it is left out, and the ones after it are tried."""
    total, out = 0, []
    for r in rows:
        if total + r["size"] <= most_bytes:
            total += r["size"]
            out.append(r)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
