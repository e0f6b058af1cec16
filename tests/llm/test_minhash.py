import random
import re

import pytest

from tidemark.llm import minhash
from tidemark.llm._shared import table

from tests import oracle

from .fixtures import empty, frame, odd


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(texts, n, percent):
    """By id: the size of the set and the smallest id reachable."""
    sets = {i: shingles(t, n) for i, t in texts.items()}
    label = {i: i for i in texts}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                label[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in texts}


def near_copies(r, base, n, edits):
    out = []
    for _ in range(n):
        w = base.copy()
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "STRAYS", 4)
    monkeypatch.setattr(minhash, "MEMBERS", 8)
    r = random.Random(7)
    texts = []
    for size, copies, edits in ((100, 60, 9), (200, 30, 12), (40, 40, 3)):
        texts += near_copies(r, [f"w{r.randrange(10**5)}" for _ in range(size)], copies, edits)
    texts += ["a b", "A  b", "a b c", "", "x", "X"] + texts[5:15]
    r.shuffle(texts)
    texts = dict(enumerate(texts))
    for percent in (85, 70):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(frame(spark, texts), 3, percent).collect()}
        want = brute(texts, 3, percent)
        assert got == want and len({c for _, c in want.values()}) < len(texts)


def test_query_on_the_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rows = minhash.op6(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(texts, 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_posterior_bounds():
    least = minhash.least_matches(0.85)
    assert least == sorted(least) and len(least) == minhash.HASHES // minhash.BATCH and least[-1] < 0.85 * minhash.HASHES
    assert minhash.least_matches(0.85, 0.5)[-1] > least[-1]


def test_odd_rows(spark):
    rows = minhash.near_duplicates(odd(spark)).collect()
    assert len(rows) == 8
    assert {(r.doc_id, r.component_id) for r in rows} == {(i, i) for i in (1, 2, 3, 4, 5, 6, None)}
    assert minhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("shingle", [1, 5])
def test_other_shingles(spark, shingle):
    texts = dict(enumerate(near_copies(random.Random(shingle), [f"w{i}" for i in range(120)], 30, 6)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(frame(spark, texts), shingle, 80).collect()}
    assert got == brute(texts, shingle, 80)


def test_query_against_sql(spark, sf_dir):
    assert oracle.rows(minhash.op6(spark, sf_dir)) == oracle.run(minhash.ORACLE, sf_dir)
