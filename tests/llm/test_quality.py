import math
import re
from collections import Counter

import pytest

from tidemark.llm import quality
from tidemark.llm._shared import table

from tests import oracle

from .fixtures import empty, frame, odd

SPACE = "\x20\t\n\x0b\x0c\r"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(windows)
    inside = {k for i, w in enumerate(windows) if many[w] > 1 for k in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside))


def counts(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)


def test_measures(spark):
    texts = [
        "", " \n ", None, "a b c d e f g", "a b c d e f g h", "a b c d e f g h " * 3, "x " * 40, "\x0b1 2\x0c3\r\n3\n3 \n3\n", "é é   x\U0001f600#<|>*",
        "p q r s t u v w x p q r s t u v w y p q r s t u v w z", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9 1 2 3", "\x00 \x00 $$ %%\x1cq",
    ]
    rows = frame(spark, texts).select("doc_id", quality.measures(quality.F.col("text")).alias("m")).select("doc_id", "m.*")
    got = {r.doc_id: counts(r) for r in rows.collect()}
    assert [got[i] for i in range(len(texts))] == [brute(t) for t in texts]


def tail(n, k, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_binomial_tail(spark):
    cases = [(10, 0), (10, 1), (300, 2), (500, 5), (0, 0), (5000, 31), (5000, 51)]
    rows = spark.createDataFrame([(i, n, k) for i, (n, k) in enumerate(cases)], "i int, n long, k long").withColumn("p", quality.binomial_tail(quality.F.col("n"), quality.F.col("k"), 0.01)).collect()
    for r in rows:
        assert r.p == (1.0 if r.k > r.n * 0.01 else pytest.approx(tail(r.n, r.k, 0.01), rel=1e-9))


def brute_cutoffs(rows, texts, good, limit, error):
    """By rule and language, as quality.certified()."""
    held = list({(r.lang or "", texts[r.doc_id]): r for r in rows if not r.base_failed and r.doc_id in good}.values())
    names = {r.lang or "" for r in held}
    level = error / max(1, len(names) * len(quality.RULES))
    out = {rule: {} for rule in quality.RULES}
    for name in names:
        own = [r for r in held if (r.lang or "") == name]
        for rule, (measure, cutoffs) in quality.RULES.items():
            a, b = measure.split(" / ")
            for k, cut in enumerate(cutoffs):
                n = sum(r[b] > 0 and r[a] / r[b] > cut for r in own)
                p = limit / len(quality.RULES)
                if n > len(own) * p or tail(len(own), n, p) > level:
                    break
                out[rule][name] = k
    return out


def test_query_on_the_table(spark):
    """On the tables of a tenth of the scale, whose holdout certifies something."""
    sf_dir = "/root/testdata/sf0.1"
    docs = {d.doc_id: d for d in table(spark, sf_dir, "documents").collect()}
    good = {r.doc_id for r in table(spark, sf_dir, "labels").collect() if r.quality == 1}
    found = quality.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).collect()
    cutoffs = brute_cutoffs(found, {i: d.text for i, d in docs.items()}, good, quality.FALSE_REJECTIONS, quality.ERROR)
    assert any(cutoffs.values()) and len(found) == len(docs)
    lost = Counter()
    for r in found:
        n = brute(docs[r.doc_id].text) if r.doc_id % 20 == 0 else counts(r)
        assert counts(r) == n
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        rejected = False
        for rule, (measure, cuts) in quality.RULES.items():
            a, b = measure.split(" / ")
            k = cutoffs[rule].get(r.lang)
            rejected |= k is not None and r[b] > 0 and r[a] / r[b] > cuts[k]
        assert r.kept == (not r.base_failed and not rejected)
        lost[r.lang] += r.doc_id in good and rejected and not r.base_failed
    for lang, n in lost.items():
        assert n <= quality.FALSE_REJECTIONS * sum(d.lang == lang and i in good for i, d in docs.items())


def test_strata_stand_for_themselves(spark):
    """A hundred languages; one whose good documents are like its bad ones, one of copies, one without labels."""
    plain = lambda n: " ".join(f"word{n}a{j} on line" for j in range(10))
    loud = lambda n: " ".join(f"word{n}a{j} # $ line" for j in range(10))
    rows = [(lang * 1000 + k, (loud if lang == 98 and k % 2 else plain)(1000 * lang + k), f"l{lang}") for lang in range(99) for k in range(95)]
    rows += [(99_000 + k, plain(0), "l99") for k in range(200)]
    rows += [(500_000 + lang, loud(500_000 + lang), f"l{lang}") for lang in range(101)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, _, _ in rows if i < 500_000], "doc_id long, quality int")
    kept = {r.lang: r.kept for r in quality.apply_rules(docs, labels, limit=0.5).where("doc_id >= 500000").collect()}
    found = quality.apply_rules(docs, labels, limit=0.5)
    assert not found.where("base_failed").count()
    assert [kept[f"l{lang}"] for lang in range(101)] == [False] * 98 + [True, True, True]


def test_odd_rows(spark):
    labels = spark.createDataFrame([(3, 1), (3, 0), (5, 1), (None, 1), (6, None)], "doc_id long, quality int")
    rows = quality.apply_rules(odd(spark), labels).collect()
    assert len(rows) == 8 and all(r.base_failed for r in rows if r.doc_id in (1, 2, 4, 6))
    assert quality.apply_rules(empty(spark), labels).count() == 0
    assert quality.apply_rules(odd(spark), labels.limit(0)).where("kept").count() == 0


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.1"])
def test_query_against_sql(spark, scale):
    """At the larger scale the holdout certifies cutoffs."""
    sf_dir = f"/root/testdata/{scale}"
    assert oracle.rows(quality.op5(spark, sf_dir)) == oracle.run(quality.ORACLE, sf_dir)
