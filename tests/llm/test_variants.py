import random
import re
import zlib
from collections import Counter

from tidemark.llm import variants
from tidemark.llm._shared import materialise

from tests import oracle

from .fixtures import empty, frame, odd

LOWER = str.maketrans(variants._UPPER, variants._UPPER.lower())


def vocabulary(texts, noise=31):
    words = Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1  # noqa: B905
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, ratio=10):
    out = {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        out[w] = [best if best and words[best] >= ratio * n else None, n, len(others)]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].append(root)
    return {w: (form, root, n, k, words[form] if form else None) for w, (form, n, k, root) in out.items()}


def rows(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def texts(seed):
    r = random.Random(seed)
    out = []
    for _ in range(60):
        out.append(" ".join("".join(r.choice("abÀéB") for _ in range(r.randint(6, 9))) for _ in range(40)))
    for word, n in (("aaaaaaa", 3), ("aaaaaaab", 30), ("aaaaaaac", 30), ("aaaaaabb", 400), ("aaaaabbb", 5000), ("×÷ÿÀÖzzz", 25), ("×÷ÿàÖzzz", 2)):
        out.append(f"{word}," * n)
    return list(enumerate(out))


def test_against_brute_force(spark):
    for seed, noise in ((1, 31), (2, 3)):
        docs = texts(seed)
        want = brute(vocabulary(docs, noise))
        assert max(len(x) for x in want) > 7 and any(form and root != form for form, root, *_ in want.values())
        assert rows(variants.spelling_variants(frame(spark, dict(docs)), noise=noise)) == want


def test_long_chains_reach_their_root(spark):
    """Forms one behind another, each ten times as frequent as its word."""
    chain = [("q" * (7 + i), 2 * 10**i) for i in range(9)]
    found = materialise(variants.neighbours(spark.createDataFrame(chain, "word string, n long")))
    got = {r.word: r.root for r in variants.roots(found).collect()}
    assert got == {w: chain[-1][0] for w, _ in chain}


def test_group_with_every_letter(spark):
    letters = [chr(c) for c in [*range(0x61, 0x7B), *range(0xC0, 0x100)]]
    words = {f"prefix{x}suffix": 2 + i for i, x in enumerate(letters)} | {"prefixsuffix": 50_000}
    got = rows(variants.roots(materialise(variants.neighbours(spark.createDataFrame(list(words.items()), "word string, n long")))))
    assert got == brute(words)
    assert got["prefixasuffix"][3] == len(letters)


def test_odd_rows(spark):
    want = brute(vocabulary([(None, "some text without an id 4111 1111 1111 1111"), (1, None), (6, "Ünï"), (2, ""), (3, "abcdefg " * 9), (3, "ABCDEFG× " * 9)]))
    more = frame(spark, {3: "abcdefg " * 9}).unionByName(frame(spark, {3: "ABCDEFG× " * 9}))
    assert rows(variants.spelling_variants(odd(spark).unionByName(more))) == want
    assert variants.spelling_variants(empty(spark)).count() == 0


def test_query_against_sql(spark, sf_dir):
    assert oracle.rows(variants.op12(spark, sf_dir)) == oracle.run(variants.ORACLE, sf_dir)
