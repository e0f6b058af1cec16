"""Search by an inverted index of pieces of texts, with the results of a scan.

Texts are those of threads, projects, titles and, if asked for, turns, each once. A text is posted under its pieces of one, two and three code points, so a needle
of any length finds its candidates: those that have all its pieces of three, or the needle itself if it is shorter. Each candidate is then searched for the needle. Postings are rows,
so a piece that most texts have is no long value; they lie in buckets by the piece's hash, of which a search opens one for each piece of its needle.

Case is folded for A-Z only. Null texts are never found, empty ones neither; an empty needle is no search. What came after the index was written isn't in it.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import ascii_lower, found_in, let

LONGEST = 3
BUCKETS = 64
FIELDS = {"thread": "thread_id", "title": "thread_id", "project": "project", "turn": "turn_id"}


def pieces(text: Column) -> Column:
    """The distinct runs of up to three code points; in time that is linear in the text."""
    letters = F.regexp_extract_all(ascii_lower(text), F.lit("(?s)."), F.lit(0))

    def runs_of(a: Column, n: int) -> Column:
        # past the end there is no letter, so no run
        return F.transform(a, lambda x, i: F.concat(x, *(F.get(a, i + k) for k in range(1, n))))

    def runs(a: Column) -> Column:
        return F.array_distinct(F.array_compact(F.flatten(F.array(*(runs_of(a, n) for n in range(1, LONGEST + 1))))))

    return let(letters, runs)


def pieces_of(needle: str) -> list[str]:
    """What a text that contains the needle must have."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in needle)
    return sorted({low[i : i + LONGEST] for i in range(max(1, len(low) - LONGEST + 1))})


def _bucket(piece: Column) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(BUCKETS)).cast("int")


class TextIndex:
    """Below a folder that all executors see: texts (field, key, text, id) and postings (piece, id)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def write(cls, path: str, events: DataFrame, threads: DataFrame | None = None) -> "TextIndex":
        """Of the threads, projects and turns of events and the titles of threads."""
        index = cls(events.sparkSession, path)
        own = [F.struct(F.lit(f).alias("field"), F.col(c).alias("key"), F.col(c).alias("text")) for f, c in FIELDS.items() if f != "title"]
        texts = events.select(F.explode(F.array(*own)).alias("t")).select("t.*")
        if threads is not None:
            texts = texts.unionByName(threads.select(F.lit("title").alias("field"), F.col("id").alias("key"), F.col("title").alias("text")))
        texts.where("key is not null and text is not null").distinct().withColumn("id", F.xxhash64("text")).write.mode("overwrite").parquet(f"{index.path}/texts")
        posted = index.texts().select("id", "text").distinct().select("id", F.explode(pieces(F.col("text"))).alias("piece"))
        dealt = posted.withColumn("bucket", _bucket(F.col("piece"))).hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "piece")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{index.path}/postings")
        return index

    def texts(self) -> DataFrame:
        return self.spark.read.schema("field string, key string, text string, id long").parquet(f"{self.path}/texts")

    def postings(self, needle: str) -> DataFrame:
        """Those of the needle's pieces."""
        rows, wanted = self.spark.read.schema("id long, piece string, bucket int").parquet(f"{self.path}/postings"), pieces_of(needle)
        return rows.where(F.col("bucket").isin(*(_bucket(F.lit(p)) for p in wanted)) & F.col("piece").isin(*wanted)).select("id", "piece")

    def hits(self, needle: str) -> DataFrame:
        """field and key of the texts that contain the needle."""
        # texts of one hash count together; the search parts them
        likely = self.postings(needle).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= len(pieces_of(needle)))
        return self.texts().join(likely, "id", "left_semi").where(found_in(F.col("text"), needle)).select("field", "key").distinct()

    def rows(self, events: DataFrame, needle: str, turns: bool = False) -> DataFrame:
        """The events with a hit."""
        hits, out, marks = self.hits(needle), events, []
        for column in dict.fromkeys(FIELDS.values()):
            fields = [f for f, c in FIELDS.items() if c == column and (turns or f != "turn")]
            if fields:
                mark = f"_hit_{column}"
                found = hits.where(F.col("field").isin(*fields)).select(F.col("key").alias(column)).distinct().withColumn(mark, F.lit(True))
                out, marks = out.join(found, column, "left"), [*marks, mark]
        return out.where(F.coalesce(*marks, F.lit(False))).select(*events.columns)
