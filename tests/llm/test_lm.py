import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tidemark.llm import lm
from tidemark.llm._shared import table

from .fixtures import empty, frame, odd


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(texts, held, order):
    """Word scores and PPM, symbol by symbol."""
    words = [[*re.findall(r"[^\x20\x09-\x0D]+", fold(t)), None] for t in texts]
    counts = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    seen = defaultdict(Counter)
    marked = [[0xFF] * order + list(fold(t).encode()) + [0xFF] for t in texts]
    for m, h in zip(marked, held, strict=True):
        for i in range(order, len(m)):
            for k in range(order + 1):
                if not h:
                    seen[tuple(m[i - k : i])][m[i]] += 1
    out = []
    for ws, m in zip(words, marked, strict=True):
        total = 0.0
        for i in range(order, len(m)):
            gone, p = set(), 1.0
            for k in range(order, -1, -1):
                left = {b: c for b, c in seen[tuple(m[i - k : i])].items() if b not in gone}
                if not left:
                    continue
                whole = sum(left.values()) + len(left)
                if m[i] in left:
                    p *= left[m[i]] / whole
                    break
                p *= len(left) / whole
                gone |= left.keys()
            else:
                p /= 256 - len(gone)
            total += math.log10(p)
        out.append((len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), total))
    return out


def same(rows, want):
    for r, w in zip(rows, want, strict=True):
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert r.base_score == pytest.approx(w[3], rel=1e-9)
        assert r.score == pytest.approx(w[4], rel=1e-5)


@pytest.mark.parametrize("order", [2, 3, 5])
def test_against_brute_force(spark, order):
    r = random.Random(order)
    texts = ["".join(r.choice("abAé \n") for _ in range(r.randint(0, 40))) for _ in range(60)] + ["", "zzz q", "Ab aB"]
    held = [i % 3 == 1 for i in range(len(texts))]
    docs = frame(spark, texts)
    rows = lm.score(docs, lm.F.col("doc_id") % 3 == 1, order).orderBy("doc_id").collect()
    same(rows, brute(texts, held, order))


def test_query_on_the_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").orderBy("doc_id").limit(10_000).collect()
    held = [zlib.crc32(str(d.doc_id).encode()) % 5 == 1 for d in docs]
    rows = lm.op9(spark, sf_dir).orderBy("doc_id").collect()
    assert [r.held_out for r in rows] == held
    same(rows, brute([d.text for d in docs], held, lm.ORDER))


def test_odd_rows(spark):
    rows = lm.score(odd(spark), lm.fold(lm.F.col("doc_id")) == 1).collect()
    assert len(rows) == 8 and all(r.held_out for r in rows if r.doc_id is None)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 4)} == {1}
    assert all(r.score < 0 for r in rows)
    assert lm.score(empty(spark), lm.F.lit(False)).count() == 0
    rows = lm.score(odd(spark), lm.F.lit(True)).collect()
    assert all(r.n_known == r.train_tokens == 0 for r in rows)
    assert [r.score for r in rows if r.doc_id == 2] == [pytest.approx(-math.log10(256), rel=1e-6)]
