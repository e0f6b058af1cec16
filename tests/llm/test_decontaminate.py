import hashlib
import random
import re

import pytest

from tidemark.llm import decontaminate
from tidemark.llm._shared import table

from tests import oracle

from .fixtures import empty, frame, odd


def words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def brute(texts, items, window):
    found = []
    split = {name: words(t) for name, t in items}
    for text in texts:
        w, hit, by = words(text), set(), set()
        for name, item in split.items():
            size = min(window, len(item))
            wanted = {tuple(item[i : i + size]) for i in range(len(item) - size + 1)} if size else set()
            for i in range(len(w) - size + 1):
                if size and tuple(w[i : i + size]) in wanted:
                    hit.update(range(i, i + size))
                    by.add(str(name))
        found.append((len(w), len(hit), hashlib.sha256(",".join(sorted(by)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return found


def result(docs, items, **kinds):
    f = decontaminate.F
    out = decontaminate.decontaminate(docs, items, **kinds).select("doc_id", "n_words", "n_hit", f.sha2(f.array_join("items", ","), 256).alias("h"), "contaminated")
    return {r[0]: tuple(r[1:]) for r in out.collect()}


@pytest.mark.parametrize("block_bytes", [1 << 23, 300])
def test_against_brute_force(spark, monkeypatch, block_bytes):
    r = random.Random(11)
    vocabulary = ["ab", "Cd", "ef", "gh", "é", "7"]
    sentence = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", ",", "."]) for _ in range(n))
    items = [(i, sentence(r.randint(0, 12))) for i in range(25)] + [(99, None), (98, "..."), (97, "ab"), (96, "ab")]
    texts = [sentence(r.randint(0, 40)) for _ in range(60)] + ["", "Ab"] + [f"x {t} y" for _, t in items if t]
    full = decontaminate.find_overlaps
    monkeypatch.setattr(decontaminate, "find_overlaps", lambda d, b, w, row=False, cut=None: full(d, b, w, block_bytes, row, cut))
    got = result(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"), window=5)
    assert [got[i] for i in range(len(texts))] == brute(texts, items, 5)


def test_query_on_the_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").collect()
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    want = brute([d.text for d in docs], items, 13)
    rows = {r.doc_id: r for r in decontaminate.op7(spark, sf_dir).collect()}
    assert any(x[3] for x in want)
    assert [(rows[d.doc_id].n_words, rows[d.doc_id].n_hit, rows[d.doc_id].items_sha256, rows[d.doc_id].contaminated) for d in docs] == want


@pytest.mark.parametrize("block_bytes", [1 << 23, 60])
def test_span_removal(spark, block_bytes):
    texts = ["One two, THREE four; five six seven. eight nine", "nothing here", "three four five six", "é x. Three four five six three four five six, z", "three four five"]
    items = spark.createDataFrame([(1, "three four five six"), (None, "one two three"), (3, "q " * 20)], "item_id long, text string")
    found = decontaminate.find_overlaps(frame(spark, texts), items, 4, block_bytes, row=True, cut=4)
    out = {r.row.doc_id: r.cleaned for r in found.collect()}
    assert out == {0: " seven. eight nine", 1: None, 2: "", 3: "é x, z", 4: None}
    names = {r.row.doc_id: (r.items, r.longest_match) for r in found.collect()}
    # matches shorter than every window of a block of items are not looked for
    assert names.pop(4)[0] == [] and names == {0: (["1"], 4), 1: ([], 0), 2: (["1"], 4), 3: (["1"], 4)}


def test_removal_is_linear(spark):
    """A megabyte of text with thousands of spans."""
    item = "three four five six"
    docs = frame(spark, [f"word word {item} other " * 30_000])
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = decontaminate.find_overlaps(docs, items, 4, row=True, cut=4)
    assert found.first().cleaned == "word word other " * 29_999 + "word word other "


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, "the same row twice the same row twice the same row twice the same"), (2, None)], "item_id long, text string")
    rows = decontaminate.decontaminate(odd(spark), items).collect()
    assert len(rows) == 8 and {r.doc_id for r in rows if r.contaminated} == {5}
    assert decontaminate.decontaminate(empty(spark), items).count() == 0
    assert decontaminate.decontaminate(odd(spark), items.limit(0)).where("contaminated").count() == 0


def test_query_against_sql(spark, sf_dir):
    assert oracle.rows(decontaminate.op7(spark, sf_dir)) == oracle.run(decontaminate.ORACLE, sf_dir)
