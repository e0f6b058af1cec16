import hashlib
import random
import re
from collections import Counter

from tidemark.llm import substrings
from tidemark.llm._shared import table

from tests import oracle

from .fixtures import empty, frame, odd


def brute(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    starts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if starts[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_against_brute_force(spark):
    r = random.Random(3)
    for window in (1, 2, 5, 8):
        texts = [" ".join(r.choice("abcd") for _ in range(r.randint(0, 60))) for _ in range(20)]
        texts += [texts[0], texts[3] + " x " + texts[4], "q w e r t y u i o p " * 3, ""]
        got = {x.doc_id: (x.n_words, x.n_removed, x.kept) for x in substrings.remove_repeats(frame(spark, texts), window).collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts, window)


def test_query_on_the_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").collect()
    want = brute([d.text for d in docs], 35)
    got = {r.doc_id: r for r in substrings.op10(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    assert sum(n for _, n, _ in want) > 0
    for d, (n, gone, kept) in zip(docs, want, strict=True):
        assert (got[d.doc_id].n_words, got[d.doc_id].n_removed) == (n, gone)
        assert got[d.doc_id].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_odd_rows(spark):
    rows = substrings.remove_repeats(odd(spark)).collect()
    assert len(rows) == 8
    assert {(r.doc_id, r.n_words, r.n_removed) for r in rows} == {(1, 0, 0), (2, 0, 0), (None, 9, 0), (3, 30_000, 30_000), (4, 0, 0), (5, 48, 48), (6, 4, 0)}
    assert substrings.remove_repeats(empty(spark)).count() == 0


def test_query_against_sql(spark, sf_dir):
    assert oracle.rows(substrings.op10(spark, sf_dir)) == oracle.run(substrings.ORACLE, sf_dir)
