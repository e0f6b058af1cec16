"""Append-only JSONL logs as tables of lines, and the feed of titles.

A file is read whole by one task, since a line's number is its place in the file; logs are split into many files. Only lines that end in a line
feed count: what follows the last one is still being written.
"""

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import instant

LINES = "file string, line_no int, doc string"


def _files(spark: SparkSession, roots: Sequence[str]) -> DataFrame | None:
    """Those of the roots that exist, with all *.jsonl files below them."""
    found = None
    for root in roots:
        try:
            rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.jsonl")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                continue
            raise
        rows = rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"))
        found = rows if found is None else found.unionByName(rows)
    return found


def _lines(value: Column) -> Column:
    parts = F.split(value, "\n", -1)
    return F.slice(parts, 1, F.size(parts) - 1)


def read_logs(spark: SparkSession, roots: Sequence[str], known: DataFrame | None = None) -> DataFrame:
    """LINES of all files below the roots; known: a manifest whose files are left out."""
    files = _files(spark, roots)
    if files is None:
        return spark.createDataFrame([], LINES)
    if known is not None:
        files = files.join(known.select("file", "size", "modified"), ["file", "size", "modified"], "left_anti")
    return files.select("file", F.posexplode(_lines(F.col("value"))).alias("line_no", "doc"))


def manifest(spark: SparkSession, roots: Sequence[str], version: int, pattern: str = "*.jsonl") -> DataFrame:
    """file, size, modified and parser version of every file; file contents are not read."""
    found = spark.createDataFrame([], "file string, size long, modified timestamp, version int")
    for root in roots:
        try:
            rows = spark.read.format("binaryFile").load(root, recursiveFileLookup=True, pathGlobFilter=pattern)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                continue
            raise
        found = found.unionByName(rows.select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.lit(version).alias("version")))
    return found


def object_text(doc: Column) -> Column:
    """The text of a JSON document if it is an object, else null."""
    return F.when(F.schema_of_variant(F.try_parse_json(doc)).startswith("OBJECT"), doc)


def unusable(doc: Column) -> Column:
    """Whether a line is no JSON; false for a null or blank line."""
    return F.coalesce(F.try_parse_json(doc).isNull() & (F.trim(doc) != ""), F.lit(False))


def issues(lines: DataFrame) -> DataFrame:
    """Lines that are no JSON."""
    return lines.where(unusable(F.col("doc")))


def read_titles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The latest title of each thread (id, title, at), of two of one time the later line's; and the feed's unusable lines."""
    try:
        rows = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            none = spark.createDataFrame([], "id string, title string, at timestamp_ntz")
            return none, spark.createDataFrame([], "doc string")
        raise
    lines = rows.select(F.posexplode(F.split("value", "\n")).alias("line_no", "doc")).where(F.trim("doc") != "")
    row = F.from_json("doc", "id string, thread_name string, updated_at string")
    read = lines.select("doc", "line_no", row["id"].alias("id"), F.trim(row["thread_name"]).alias("title"), instant(row["updated_at"]).alias("at"))
    sound = F.coalesce((F.col("id") != "") & (F.col("title") != "") & F.col("at").isNotNull(), F.lit(False))
    last = Window.partitionBy("id").orderBy(F.desc("at"), F.desc("line_no"))
    latest = read.where(sound).withColumn("n", F.row_number().over(last)).where("n = 1").select("id", "title", "at")
    return latest, read.where(~sound).select("doc")


def with_titles(threads: DataFrame, titles: DataFrame) -> DataFrame:
    """Known threads with the newer of the title they have and that of the feed."""
    new = titles.select("id", F.col("title").alias("_title"), F.col("at").alias("_at"))
    out = threads.join(new, "id", "left")
    if "title" not in threads.columns:
        return out.withColumnsRenamed({"_title": "title", "_at": "title_updated_at"})
    newer = F.col("_at").isNotNull() & (F.col("title_updated_at").isNull() | (F.col("_at") >= F.col("title_updated_at")))
    columns = {"title": F.when(newer, F.col("_title")).otherwise(F.col("title")), "title_updated_at": F.when(newer, F.col("_at")).otherwise(F.col("title_updated_at"))}
    return out.withColumns(columns).select(*threads.columns)
