"""Spelling variants: words that differ by one code point, each led to the most frequent of its neighbours.

No pair of words is ever made of two that only share a group:

* Replacements: a word of m code points is in m groups, one for each (position, prefix, suffix), written as the word with that position left open. A group's size tells each
  of its members how many neighbours it has there; its two most frequent words tell the best one (the second for the first itself). A group has at most one word for each
  letter of the alphabet, some ninety, however large the vocabulary is.
* Insertions and deletions: a word's different deletions of one code point are looked up in the vocabulary. What is found is a neighbour of the word, and the word one of it.

All of it grows in proportion to the letters of the vocabulary. Words are counted before they are shuffled. Forms lead to roots by pointer doubling: a form is `ratio` times as frequent as
its word, so the number of rounds follows from the largest count.

Only DataFrame functions are used. Defined results: a null or empty text has no words; a row without doc_id has an empty id in its noise hash; equally frequent neighbours: the smallest in code-point order; repeated rows count each;
a very long text is one row's array of words; an empty table gives no rows; columns besides doc_id and text are not read.
"""

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import let, materialise, table

#: Code points of a word and its occurrences, at least; how much more frequent a form is.
LEAST, OCCURS, RATIO = 7, 2, 10
#: One in so many (document, run) loses a code point.
NOISE = 31

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _without(word: Column, at: Column, instead: str = "") -> Column:
    """The word with another text in the place of one code point, counted from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.lit(instead), F.substring(word, at + 2, F.char_length(word)))


def _places(word: Column) -> Column:
    return F.sequence(F.lit(0), F.char_length(word) - 1)


def vocabulary(docs: DataFrame, noise: int = NOISE) -> DataFrame:
    """word, n: words of `LEAST` code points and `OCCURS` occurrences, after the noise."""
    # a run that is shorter than a word gives none, with noise or without
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{LEAST},}}+"), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", _UPPER, _UPPER.lower()).alias("run"))
    mark = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    word = let(mark, lambda h: F.when(h % noise == 0, _without(F.col("run"), (h % F.char_length("run")).cast("int"))).otherwise(F.col("run")))
    return runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") >= OCCURS) & (F.char_length("word") >= LEAST))


def _replaced(words: DataFrame) -> DataFrame:
    """word, count, near_n, near: of each group of a word with others, how many these are and the best of them."""
    open_ = words.select("word", "n", F.explode(F.transform(_places(F.col("word")), lambda i: _without(F.col("word"), i, "*"))).alias("place"))
    by = Window.partitionBy("place")
    whole = by.orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top = F.struct("n", "word")
    groups = open_.select("word", F.count("*").over(whole).alias("size"), F.first(top).over(whole).alias("one"), F.nth_value(top, 2).over(whole).alias("two")).where("size > 1")
    best = F.when(F.col("one.word") == F.col("word"), F.col("two")).otherwise(F.col("one"))
    return groups.select("word", (F.col("size") - 1).alias("count"), best["n"].alias("near_n"), best["word"].alias("near"))


def _shifted(words: DataFrame) -> DataFrame:
    """The same of words that another one becomes by a deletion."""
    shorter = F.array_distinct(F.transform(_places(F.col("word")), lambda i: _without(F.col("word"), i)))
    longer = words.where(F.char_length("word") > LEAST).select(F.col("word").alias("long"), F.col("n").alias("long_n"), F.explode(shorter).alias("word"))
    found = longer.join(words, "word")
    both = F.array(
        F.struct(F.col("long").alias("word"), F.lit(1).cast("long").alias("count"), F.col("n").alias("near_n"), F.col("word").alias("near")),
        F.struct(F.col("word").alias("word"), F.lit(1).cast("long").alias("count"), F.col("long_n").alias("near_n"), F.col("long").alias("near")),
    )
    return found.select(F.inline(both))


def neighbours(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form and form_n for every row of words (word, n), which are different words of `LEAST` code points at least."""
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = _replaced(words).unionByName(_shifted(words)).groupBy("word").agg(F.sum("count").alias("n_near"), best.alias("best"))
    form = lambda c: F.when(-F.col("best.less") >= ratio * F.col("n"), c)
    return words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form(F.col("best.near")).alias("form"), form(-F.col("best.less")).alias("form_n")
    )


def roots(found: DataFrame, ratio: int = RATIO) -> DataFrame:
    """found with root, where the forms of a word lead; found is materialised."""
    links = found.where("form is not null").select("word", F.col("form").alias("root"))
    most, least = found.agg(F.max("n"), F.min("n")).first()
    steps = int(math.log(most / least, ratio) + 1e-9) if most else 0  # forms one behind another, at most
    last = ()
    for _ in range(max(0, steps - 1).bit_length()):
        links = materialise(links.join(links.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select("word", F.coalesce("next", "root").alias("root")), *last)
        last = (links,)
    return found.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, ratio: int = RATIO, noise: int = NOISE) -> DataFrame:
    words = materialise(vocabulary(docs, noise))
    return roots(materialise(neighbours(words, ratio), words), ratio)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def _crc_table() -> str:
    """SQL of the list of CRC-32 of all single bytes."""
    x = "i"
    ctes = []
    for k in range(8):
        ctes.append(f"b{k} AS (SELECT i, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END AS x FROM {f'b{k - 1}' if k else f'(SELECT {x}, {x} AS x FROM range(256) t({x}))'})")
    return ", ".join(ctes) + ", crc AS (SELECT list(x::BIGINT ORDER BY i) AS t FROM b7)"


ORACLE = f"""
WITH RECURSIVE {_crc_table()},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), '{_UPPER}', '{_UPPER.lower()}') AS run FROM documents),
long AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= {LEAST} GROUP BY ALL),
bytes AS (SELECT run, k, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c:
  CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c)::BIGINT >> 6), 128 + (unicode(c)::BIGINT & 63)] END)) AS bs FROM long),
marks AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, bs), lambda h, b: xor(h >> 8, t[1 + (xor(h, b) & 255)])), 4294967295) AS h FROM bytes, crc),
kept AS (SELECT CASE WHEN h % {NOISE} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM marks),
words AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM kept WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(k) >= {OCCURS}),
open AS (SELECT word, substr(word, 1, i::INT) || '*' || substr(word, i::INT + 2) AS place FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
less AS (SELECT DISTINCT word, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS shorter FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS near FROM open a JOIN open b USING (place) WHERE a.word <> b.word
  UNION ALL SELECT l.word, w.word FROM less l JOIN words w ON l.shorter = w.word
  UNION ALL SELECT w.word, l.word FROM less l JOIN words w ON l.shorter = w.word),
ranked AS (SELECT p.word, p.near, w.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, p.near) AS place FROM pairs p JOIN words w ON p.near = w.word),
found AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= {RATIO} * n THEN near END AS form, CASE WHEN near_n >= {RATIO} * n THEN near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.place = 1),
led AS (SELECT word, word AS root FROM found UNION ALL SELECT l.word, f.form FROM led l JOIN found f ON l.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n::BIGINT AS form_n FROM found f JOIN led l ON f.word = l.word JOIN found e ON l.root = e.word WHERE e.form IS NULL
"""
