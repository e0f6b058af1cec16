import hashlib
import random
import zlib

import numpy as np
import pytest
from tidemark.llm import periodic
from tidemark.llm._shared import table

from .fixtures import empty, frame, odd


def runs(words, exponent, least):
    """Maximal stretches of each period, the longest periods first, so that a stretch keeps its smallest."""
    n, out = len(words), {}
    for p in range(n // exponent, 0, -1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(least, exponent * p) and j > i:
                out[i, j - i + p] = p
            i = j + 1
    return sorted(((a, size, p) for (a, size), p in out.items()), key=lambda r: (r[0], r[2]))


def brute(words, exponent=4, least=6):
    found = runs(words, exponent, least)
    gone = set()
    for a, size, p in found:
        gone.update(range(a + p, a + size))
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    return (len(found), *best, 1000 * best[1] // best[2] if found else None, "".join(f"{a},{n},{p}\n" for a, n, p in found), " ".join(w for i, w in enumerate(words) if i not in gone))


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def texts(seed):
    """Random words of few letters, powers, powers of powers, and stretches that come again."""
    r = random.Random(seed)
    word = lambda n, letters: [r.choice(letters) for _ in range(n)]
    out = [[], ["a"], ["a"] * 6, ["a"] * 5, ["b"] + ["a"] * 40 + ["b"]]
    for letters in ("a", "ab", "abc", "abcdefgh"):
        for _ in range(12):
            parts = []
            for _ in range(r.randint(1, 5)):
                base = word(r.randint(1, 7), letters)
                base = base * r.randint(1, 7)
                if r.random() < 0.4:
                    base = (base + word(r.randint(0, 2), letters)) * r.randint(1, 5)
                parts.append(base[: r.randint(1, 160)] + word(r.randint(0, 4), letters + "xyz"))
            out.append(sum(parts, []) + (parts[0] + ["q"] + parts[0] if r.random() < 0.6 else []))
    return out


@pytest.mark.parametrize("exponent, least", [(4, 6), (2, 2), (3, 1), (5, 9)])
def test_against_brute_force(exponent, least):
    for seed in range(6):
        docs = texts(seed)
        got = periodic.periodic([" ".join(d).encode() for d in docs], None, exponent, least)
        for d, g in zip(docs, got, strict=True):
            assert (*g[:-1], g[-1].decode()) == brute(d, exponent, least), " ".join(d)


def test_suffix_array_lcp_and_lpf():
    for seed in range(4):
        docs = texts(seed)
        numbers = {w: i for i, w in enumerate(sorted({w for d in docs for w in d}))}
        words = [w for d in docs for w in d]
        owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        s = periodic.Suffixes(np.array([numbers[w] for w in words]), owner)
        assert s.order.tolist() == sorted(range(len(words)), key=lambda i: (owner[i], words[i : s.ends[i]]))
        length, where = periodic.longest_previous(s)
        common = lambda i, j: next((k for k in range(s.ends[i] - i) if words[i + k] != words[j + k]), s.ends[i] - i)  # noqa: E731  j < i
        for i in range(len(words)):
            before = [common(i, j) for j in range(s.ends[i] - len(docs[owner[i]]), i)]
            assert length[i] == max(before, default=0)
            if length[i]:
                assert where[i] < i and common(i, where[i]) == length[i]


def test_query_on_the_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").collect()
    got = {r.doc_id: r for r in periodic.op13(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        words = [w.decode() for w in (d.text or "").encode().split()]
        n, a, size, p, milli, lines, kept = brute(planted(d.doc_id, words))
        r = got[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (n, a, size, p, milli)
        assert (r.runs_sha256, r.collapsed_sha256) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept))
        some += n > 0
    assert some > 5


def test_odd_rows(spark):
    rows = [tuple(r) for r in periodic.collapse(odd(spark)).collect()]
    none = (0, None, None, None, None, "")
    again = (1, 0, 48, 4, 12_000, "0,48,4\n", "the same row twice")
    want = [(1, *none, ""), (2, *none, ""), (None, *none, "some text without an id 4111 1111 1111 1111"), (3, 1, 0, 30_000, 1, 30_000_000, "0,30000,1\n", "word"), (4, *none, ""), (5, *again), (5, *again), (6, *none, "Ünï \U0001f600 \x00 x")]
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert len(periodic.collapse(odd(spark), rework=True).collect()) == 8
    assert periodic.collapse(empty(spark)).count() == 0
    assert {r.collapsed for r in periodic.collapse(frame(spark, ["a b a b a b a b c"] * 3)).collect()} == {"a b c"}


def test_long_texts_are_nearly_linear():
    import time

    r = random.Random(5)
    fib, last = ["a"], ["a", "b"]
    while len(last) < 300_000:
        fib, last = last, last + fib
    for words in (["a"] * 300_000, ["a", "b", "c"] * 100_000, last, [r.choice("ab") for _ in range(300_000)], [str(r.random()) for _ in range(300_000)]):
        began = time.perf_counter()
        periodic.periodic([" ".join(words).encode()])
        assert time.perf_counter() - began < 20
