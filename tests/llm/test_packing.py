import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from tidemark.llm import packing
from tidemark.llm._shared import table

from .fixtures import empty, odd


def padding(size, window):
    return 0 if size & (size - 1) == 0 else window - size


def test_cuts_are_the_cheapest():
    r = random.Random(1)
    for _ in range(200):
        window, each = r.choice([4, 5, 8, 11]), r.choice([0.0, 2.0])
        steps = [r.randint(1, window) for _ in range(r.randint(1, 8))]
        p = np.array([0, *itertools.accumulate(steps)])
        w = np.array([0.0, *[r.choice([0, 1.5, 3]) for _ in steps]])

        def cost(chosen, p=p, w=w, window=window, each=each):
            ends = [0, *chosen]
            sizes = [p[b] - p[a] for a, b in itertools.pairwise(ends)]
            return np.inf if max(sizes) > window else sum(padding(int(s), window) + each for s in sizes) + w[list(chosen)].sum()

        n = len(p) - 1
        all_ways = [(*c, n) for k in range(n) for c in itertools.combinations(range(1, n), k)]
        assert cost(packing.cuts(p, w, window, each)) == min(map(cost, all_ways))


def test_words_give_the_ids_of_the_whole_text(spark, sf_dir):
    ours = packing.tokenizer(packing.TOKENIZER)
    theirs = Tokenizer.from_file(packing.TOKENIZER)
    texts = [r.text for r in table(spark, sf_dir, "documents").collect()]
    texts += ["", "Ab,c. D...e  <|endoftext|>X <|ENDOFTEXT|> it's I'LL 12,5.a\u0085b c \x0b\x1cd\x00 İİ é,́ \U0001f600.x KK a.́b"]
    for text, ids in zip(texts, ours.encode(pa.array(texts)), strict=True):
        assert ids.tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_query_on_the_table(spark, sf_dir):
    theirs = Tokenizer.from_file(packing.TOKENIZER)
    docs = {r.doc_id: np.array([*theirs.encode(r.text, add_special_tokens=False).ids, 2], "<u4") for r in table(spark, sf_dir, "documents").collect()}
    by_doc, by_sequence = {}, {}
    for r in packing.op3(spark, sf_dir).collect():
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == docs.keys()
    for doc, rows in by_doc.items():
        rows.sort(key=lambda r: r.start)
        assert [r.start for r in rows] == [0, *itertools.accumulate(r.length for r in rows)][:-1]
        assert sum(r.length for r in rows) == len(docs[doc]) == rows[0].doc_tokens
        assert all(zlib.crc32(docs[doc][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in rows)
    total = used = 0
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r.offset)
        size = sum(r.length for r in rows)
        assert [r.offset for r in rows] == [0, *itertools.accumulate(r.length for r in rows)][:-1] and size <= 4096
        total += size
        used += size + padding(size, 4096)
    assert used <= 1.02 * total
    assert len(by_sequence) <= 1.05 * -(-total // 4096) + 12  # the end of a partition may be cut into powers of two


def test_batches_change_no_result(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").coalesce(1)
    found = {}
    for rows in ("7", "1000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        found[rows] = [tuple(r) for r in packing.pack(docs, block=20_000).collect()]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found["7"] == found["1000"]
    sizes = {}
    for _, _, n, _, _, sequence, _ in found["7"]:
        sizes[sequence] = sizes.get(sequence, 0) + n
    assert len(sizes) <= 1.05 * -(-sum(sizes.values()) // 4096) + 12


def test_words_that_share_a_slot(monkeypatch):
    monkeypatch.setattr(packing.WordMemory, "BITS", 2)
    ours, theirs = packing.WordTokenizer(packing.TOKENIZER), Tokenizer.from_file(packing.TOKENIZER)
    texts = [f"word{i} alpha beta gamma delta x{'ab' * i} épée" for i in range(40)] * 2
    for text, ids in zip(texts, ours.encode(pa.array(texts)), strict=True):
        assert ids.tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_odd_rows(spark):
    rows = packing.pack(odd(spark), window=64).collect()
    tokens = {}
    for r in rows:
        assert r.length * 4 == len(r.ids) and r.length <= 64
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert tokens[1] == tokens[2] == tokens[4] == 1 and tokens[3] == 30_001 and tokens[5] == 2 * (12 * 4 + 1)
    whole = packing.sequences(packing.pack(odd(spark), window=64)).collect()
    assert sum(r.length for r in whole) == sum(tokens.values()) and all(len(r.ids) == 4 * r.length for r in whole)
    assert packing.pack(empty(spark)).count() == 0
