"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Every rule is a measure of a text and a chain of cutoffs from loose to tight. On a labelled holdout, a cutoff is certified for a stratum
(a language) if the good documents that it rejects there are so few that a false rejection rate over the limit is
refuted: P(Binomial(n, limit) <= rejected) <= level, the exact one-sided binomial bound.

* A stratum's limit `FALSE_REJECTIONS` is divided among the rules, so what they reject together stays within it.
* The level `ERROR` is divided among all chains (strata times rules: Bonferroni). Within a chain cutoffs are tested in order until the
  first failure, which needs no further correction.

So with a probability of 1 - `ERROR` at least, in no stratum the rules reject more than `FALSE_REJECTIONS` of its good documents that pass the base rule, where documents of
one text count once: the bound takes draws to be independent, and copies aren't. What the base rule rejects is not bounded. A stratum for which no cutoff of a rule is certified, and one without
labels, loses nothing to that rule.

Text is measured once, each row in its own task; only a document's counts are joined with labels. Certified cutoffs are a table with a row for each stratum, however many
there are, which Spark broadcasts if it is small and else joins by sorting.

Defined results: a null or empty text has no words, which fails the base rule; a very long text is measured whole in one row; repeated rows are each answered; a row without doc_id has no label; rows whose lang
is null or empty are one stratum; a document that any label row calls bad is no good document; a value equal to a cutoff is not over it; an empty table gives no rows; columns
besides doc_id, text, lang and doc_id, quality are not read.
"""

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import let, materialise, table

WINDOW = 8
FALSE_REJECTIONS, ERROR = 0.05, 0.05
#: By rule, the measure and its cutoffs from loose to tight; a text is rejected if the measure is over the cutoff.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / n_words", (5.0, 3.0, 2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1)),
    "dup_lines": ("n_dup_lines / n_lines", (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
    "repeats": ("n_repeat_words / n_words", (0.28, 0.25, 0.22, 0.2, 0.17, 0.15, 0.12, 0.1)),
    "long_words": ("word_chars / n_words", (60.0, 40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0)),
    "short_words": ("n_words / word_chars", (0.95, 0.8, 0.67, 0.5, 0.4, 0.36, 0.33)),
}


def without(text: Column, characters: str) -> Column:
    return functools.reduce(lambda x, c: F.replace(x, F.lit(c), F.lit("")), characters, text)


def _repeats(words: Column, size: int) -> Column:
    """How many words lie in a window of `size` (a power of two) words that occurs twice or more."""
    long = F.lit(0).cast("long")

    def joined(step):
        return lambda a: F.zip_with(a, F.slice(a, step + 1, F.greatest(F.size(a), F.lit(1))), lambda x, y: F.xxhash64(x, y))

    h = F.transform(words, lambda w: F.xxhash64(w))
    step = 1
    while step < size:
        h = let(h, joined(step))
        step *= 2
    h = let(h, lambda a: F.slice(a, 1, F.greatest(F.size(a) - (size - 1), F.lit(0))))

    def positions(a):
        ordered = F.sort_array(F.transform(a, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        alike = let(
            ordered,
            lambda s: F.filter(s, lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"])),
        )
        return F.array_sort(F.transform(alike, lambda e: e["i"].cast("long")))

    def covered(at):
        start = F.struct(long.alias("n"), long.alias("end"))
        return F.aggregate(at, start, lambda s, p: F.struct((s["n"] + p + size - F.greatest(p, s["end"])).alias("n"), (p + size).alias("end")), lambda s: s["n"])

    return let(h, lambda a: F.when(F.size(F.array_distinct(a)) == F.size(a), long).otherwise(covered(positions(a))))


def measures(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    long = lambda c, name: c.cast("long").alias(name)
    from_words = let(words, lambda w: F.struct(long(F.size(w), "n_words"), long(_repeats(w, WINDOW), "n_repeat_words")))
    from_lines = let(lines, lambda x: F.struct(long(F.size(x), "n_lines"), long(F.size(x) - F.size(F.array_distinct(x)), "n_dup_lines")))
    return let(
        F.struct(from_words.alias("w"), from_lines.alias("x")),
        lambda m: F.struct(
            m["w"]["n_words"].alias("n_words"),
            long(F.char_length(without(text, " \t\n\x0b\x0c\r")), "word_chars"),
            long(F.char_length(text) - F.char_length(without(text, "#*$%&|<>")), "n_symbols"),
            m["x"]["n_lines"].alias("n_lines"),
            m["x"]["n_dup_lines"].alias("n_dup_lines"),
            m["w"]["n_repeat_words"].alias("n_repeat_words"),
        ),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))


def first_rejected(rule: str) -> Column:
    """The place in the rule's chain of the loosest cutoff that rejects the row; null if none does."""
    measure, cutoffs = RULES[rule]
    over, under = (F.col(x).cast("double") for x in measure.split(" / "))
    value = F.when(under > 0, over / under)
    return functools.reduce(lambda rest, k: F.when(value > cutoffs[k], k).otherwise(rest), reversed(range(len(cutoffs))), F.lit(None).cast("int"))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k) by summing its terms in logarithms; 1 where k is over the mean, where nothing can be refuted."""
    start = F.log(F.lit(1 - p)) * n
    odds = F.log(F.lit(p / (1 - p)))

    def add(a, i):
        term = a["term"] + F.log((n - i + 1) / i) + odds
        top = F.greatest(term, a["sum"])
        return F.struct(term.alias("term"), (top + F.log(F.exp(term - top) + F.exp(a["sum"] - top))).alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    whole = F.exp(F.aggregate(steps, F.struct(start.alias("term"), start.alias("sum")), add, lambda a: a["sum"]))
    return F.when(k > n * p, 1.0).otherwise(whole)


def certified(measured: DataFrame, good: DataFrame, limit: float = FALSE_REJECTIONS, error: float = ERROR) -> DataFrame:
    """stratum and, in a column for each rule, the place of its tightest certified cutoff. measured: doc_id, lang, text_key and the counts; good: doc_id of good documents."""
    held = measured.where(~base_failed()).join(good.select("doc_id").distinct(), "doc_id", "left_semi")
    held = held.withColumn("stratum", F.coalesce("lang", F.lit(""))).dropDuplicates(["stratum", "text_key"])
    n_strata = held.agg(F.count_distinct("stratum")).first()[0]
    chains = F.array(*[F.struct(F.lit(rule).alias("rule"), first_rejected(rule).alias("place")) for rule in RULES])
    counts = held.select("stratum", F.explode(chains).alias("c")).groupBy("stratum", "c.rule", "c.place").agg(F.count(F.lit(1)).alias("n"))
    chain = Window.partitionBy("stratum", "rule")
    n = F.sum("n").over(chain).alias("total")
    level = error / max(1, n_strata * len(RULES))
    # a cutoff rejects what it or a looser one rejects first
    places = counts.select("stratum", "rule", "place", "n", n).groupBy("stratum", "rule").agg(F.first("total").alias("total"), F.map_from_entries(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "n")))).alias("by_place"))
    cuts = F.create_map(*[x for rule, (_, c) in RULES.items() for x in (F.lit(rule), F.lit(len(c)))])
    steps = places.withColumn("cutoff", F.explode(F.sequence(F.lit(0), cuts[F.col("rule")] - 1)))
    rejected = F.sum(F.coalesce(F.try_element_at("by_place", "cutoff"), F.lit(0))).over(chain.orderBy("cutoff"))
    steps = steps.withColumn("rejected", rejected).withColumn("p", binomial_tail(F.col("total"), F.col("rejected"), limit / len(RULES)))
    failed = F.max((F.col("p") > level).cast("int")).over(chain.orderBy("cutoff"))
    passed = steps.withColumn("failed", failed).where("failed = 0")
    return passed.groupBy("stratum").pivot("rule", list(RULES)).agg(F.max("cutoff"))


def apply_rules(docs: DataFrame, labels: DataFrame, limit: float = FALSE_REJECTIONS, error: float = ERROR) -> DataFrame:
    """doc_id, lang, the counts, base_failed and kept of every row."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.xxhash64(text).alias("text_key"), measures(text).alias("m"))
    measured = materialise(rows.select("doc_id", "lang", "text_key", "m.*"))
    quality = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    good = quality.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    # written, so that its size is known when the join is planned
    cutoffs = materialise(certified(measured, good, limit, error))
    out = measured.drop("text_key").withColumn("stratum", F.coalesce("lang", F.lit(""))).join(cutoffs, "stratum", "left")
    rejected = functools.reduce(lambda x, rule: x | F.coalesce(first_rejected(rule) <= F.col(rule), F.lit(False)), RULES, F.lit(False))
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected).drop("stratum", *RULES)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    cuts = ", ".join(f"('{rule}', {k}, {cut})" for rule, (_, cutoffs) in RULES.items() for k, cut in enumerate(cutoffs))
    values = " UNION ALL ".join(
        f"SELECT doc_id, lang, h, base_failed, '{rule}' AS rule, CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} END AS value FROM b" for rule, (a, b) in ((r, m.split(" / ")) for r, (m, _) in RULES.items())
    )
    p = FALSE_REJECTIONS / len(RULES)
    return rf"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS ls FROM documents
), keys AS (SELECT doc_id, list_transform(range(1, len(ws) - 6), lambda i: md5(array_to_string(ws[i : i + 7], ' '))) AS ks FROM w WHERE len(ws) >= 8),
starts AS (SELECT doc_id, unnest(ks) AS k, generate_subscripts(ks, 1) AS i FROM keys),
again AS (SELECT doc_id, i FROM starts QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
inside AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, unnest(range(8)) AS t(k) GROUP BY doc_id),
m AS (
  SELECT doc_id, lang, md5(t) AS h, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN inside USING (doc_id)
), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
v AS ({values}),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
held AS (SELECT DISTINCT lang, h, rule, value FROM v SEMI JOIN good USING (doc_id) WHERE NOT base_failed),
cuts (rule, k, cut) AS (VALUES {cuts}),
tried AS (SELECT lang, rule, k, cut, count(*) AS n, count(*) FILTER (WHERE value > cut) AS r FROM held JOIN cuts USING (rule) GROUP BY ALL),
bound AS (SELECT *, CASE WHEN r > n * {p} THEN 1.0 ELSE list_sum(list_transform(range(0, r + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln({1 - p})))) END AS tail FROM tried),
passed AS (SELECT * FROM bound QUALIFY max(tail) OVER (PARTITION BY lang, rule ORDER BY k) <= {ERROR} / ((SELECT count(DISTINCT lang) FROM held) * {len(RULES)})),
tightest AS (SELECT lang, rule, arg_max(cut, k) AS cut FROM passed GROUP BY lang, rule),
rejected AS (SELECT DISTINCT doc_id FROM v JOIN tightest USING (lang, rule) WHERE value > tightest.cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (doc_id IN (SELECT doc_id FROM rejected)) AS kept FROM b
"""


#: The whole procedure.
ORACLE = _oracle()
