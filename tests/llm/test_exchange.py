"""Trees of several levels give what one level gives."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exchange, lm, substrings

from .fixtures import frame
from .test_lm import brute as lm_brute
from .test_substrings import brute


@pytest.fixture
def deep(monkeypatch):
    """Three messages a block, one block's worth an owner: a tree of three levels over 20 blocks."""
    monkeypatch.setattr(exchange, "FAN", 3)
    monkeypatch.setattr(exchange, "OWNED", 1)
    for module in (lm, substrings):
        monkeypatch.setattr(module, "block_count", lambda docs: 20)
    assert exchange.levels(20) == [3, 9, 27]


def test_levels():
    assert exchange.levels(1) == exchange.levels(256) == [64] and exchange.levels(257) == [64, 4096]


def test_parts_are_nested():
    work = exchange.Work(None, {})
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    of = [{int(keys[i]): part for part, at in work.cut(0, keys, parts) for i in at} for parts in (7, 7 * 5)]
    assert all(of[1][k] // 5 == of[0][k] for k in of[0]) and len(of[0]) == len(of[1]) == 1000


def test_repeats_by_a_tree(spark, deep):
    r = random.Random(3)
    texts = [" ".join(r.choice("abcde") for _ in range(r.randint(0, 60))) for _ in range(40)]
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept) for x in substrings.remove_repeats(frame(spark, texts), 6).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 6)


def test_code_lengths_by_a_tree(spark, deep):
    r = random.Random(4)
    texts = [" ".join(r.choice(["ab", "abc", "b", "cé"]) for _ in range(r.randint(0, 30))) for _ in range(40)]
    held = [i % 4 == 0 for i in range(40)]
    docs = frame(spark, texts)
    got = {x.doc_id: x for x in lm.score(docs, lm.F.col("doc_id") % 4 == 0, order=3).collect()}
    want = lm_brute(texts, held, 3)
    for i in range(40):
        assert got[i].n_tokens == want[i][0] and got[i].n_known == want[i][1] and got[i].train_tokens == want[i][2]
        assert got[i].base_score == pytest.approx(want[i][3]) and got[i].score == pytest.approx(want[i][4], rel=1e-5)


def test_repeated_rows_are_dealt_out(spark, tmp_path):
    """Equal rows, without an id too, spread over all blocks, and the same way each time."""
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text").alias("text"), F.lit(1).alias("block"))
    rows.repartition(3).write.parquet(str(tmp_path / "rows"))
    for docs in (rows, spark.read.parquet(str(tmp_path / "rows"))):
        dealt = exchange.in_blocks(docs, 16)
        first = {r.block: r["count"] for r in dealt.groupBy("block").count().collect()}
        assert len(first) == 16 and max(first.values()) < 2 * 20_000 / 16
        assert first == {r.block: r["count"] for r in dealt.groupBy("block").count().collect()}
