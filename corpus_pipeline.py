"""The training-data pipeline: five operators over the documents, each over all that the one before kept.

toxicity -> MinHash near-dedup -> benchmark decontamination -> PII -> packing. The first four return the columns of documents.

Defined results of all stages: a null or empty text is clean, kept and packed as its end mark; very long texts are treated whole; repeated rows, several texts of one
doc_id and rows without a doc_id are rows like others: none is dropped but by a stage's own decision, and near-dedup keeps one row of each group, whatever the ids in it; among rows that
tie for it any one; an empty table gives no rows; columns besides those of documents are carried along.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, minhash, packing, pii, toxicity
from tidemark.llm._shared import materialise, table

#: SQL can express neither a trained classifier nor a trained field; tests hold run() against the stages' brute-force versions.
ORACLE_SQL = None
#: Of near copies, by word shingles.
SHINGLE, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for toxic go. Every label but those of the held-out fold teaches it."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), lambda i: toxicity.fold(i) != 0)
    return toxicity.score(docs, model, row=True).where("score < 0.5").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that with the smallest id; rows without words stay."""
    return minhash.first_rows(docs, SHINGLE, PERCENT)


def _replaced(row: Column, text: Column, docs: DataFrame) -> Column:
    """The row with the new text, where there is one, and n_chars after it."""
    out = row.withField("text", F.coalesce(text, row["text"]))
    if "n_chars" in docs.columns:
        size = F.char_length(text).cast(docs.schema["n_chars"].dataType)
        out = out.withField("n_chars", F.coalesce(size, row["n_chars"]))
    return out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the benchmark covers a twentieth or more go; from the others, spans of thirteen benchmark words or more are cut out."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), row=True, cut=decontaminate.WINDOW)
    return found.where(~F.col("contaminated")).select(_replaced(F.col("row"), F.col("cleaned"), docs).alias("row")).select("row.*")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; personal data and secrets in its text become their kinds in angle brackets."""
    found = pii.find(docs, row=True)
    return found.select(_replaced(F.col("row"), F.col("redacted"), docs).alias("row")).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4,096 tokens, with their ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again before the next."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), *before)
        before = [docs]
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run() with a digest for each piece's ids."""
    return run(spark, sf_dir).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
