"""Documents that every operator is tested on besides the given tables."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, start long, label string"


def frame(spark, texts):
    """A documents table with two columns whose names clash with those that operators use."""
    rows = [(i, t, "en", "s", len(t or ""), 1, "x") for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids."""
    rows = [
        (1, None, None, None, None, None, None),
        (2, "", "en", "a", 0, 1, "x"),
        (None, "some text without an id 4111 1111 1111 1111", "en", "a", 3, 1, "x"),
        (3, "word " * 30_000, "de", "a", 3, 1, "x"),
        (4, " \n\t ", "de", "b", 3, 1, "x"),
        (5, "the same row twice " * 12, "de", "b", 3, 1, "x"),
        (5, "the same row twice " * 12, "de", "b", 3, 1, "x"),
        (6, "Ünï \U0001f600 \x00 x", None, "b", 3, 1, "x"),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
