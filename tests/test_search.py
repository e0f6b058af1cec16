import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalars import found_in
from tidemark.operators.filters import Filter
from tidemark.operators.search import TextIndex, pieces, pieces_of

LETTERS = "abAB \né😀%_ſ"


def test_pieces(spark):
    texts = spark.createDataFrame([("",), ("aB",), ("A😀b\nA😀b",), (None,)], "t string").select(pieces(F.col("t")).alias("p")).collect()
    assert [sorted(r.p) if r.p is not None else None for r in texts] == [[], ["a", "ab", "b"], sorted({"a", "😀", "b", "\n", "a😀", "😀b", "b\n", "\na", "a😀b", "😀b\n", "b\na", "\na😀"}), None]
    assert pieces_of("Aé") == ["aé"] and pieces_of("ABAba") == ["aba", "bab"] and pieces_of("É") == ["É"]


@pytest.fixture(scope="module")
def tables(spark):
    draw = random.Random(5)
    text = lambda: draw.choice([None, ""] + ["".join(draw.choices(LETTERS, k=draw.randint(1, 9))) for _ in range(6)])
    # ties, repeated rows, nulls and a column with a clashing name; a third of all events share a project
    events = [(n // 2, draw.choice(["t1", "T2", "xab", None, "b A"]), "hot project" if n % 3 == 0 else text(), text(), n % 7) for n in range(300)]
    threads = [("t1", "a Title"), ("T2", None), ("xab", "😀b%"), ("gone", "ab"), ("t1", "other é")]
    return spark.createDataFrame(events, "n int, thread_id string, project string, turn_id string, key int").cache(), spark.createDataFrame(threads, "id string, title string")


def test_the_index_finds_what_a_scan_finds(spark, tables, tmp_path):
    events, threads = tables
    index, draw = TextIndex.write(str(tmp_path / "i"), events, threads), random.Random(6)
    needles = ["a", "B", "t1", "HOT PROJECT", "title", "é", "É", "😀b", "%", "_", "no such text", "ab" * 30] + ["".join(draw.choices(LETTERS, k=k)) for k in (2, 3)]
    for needle in needles:
        for turns in (False, True):
            f = Filter(q=needle, search_turns=turns)
            found, scanned = (sorted(map(repr, f.apply(events, threads, i).select(events.columns).collect())) for i in (index, None))
            assert found == scanned, (needle, turns)
    assert index.hits("ab").where(~found_in(F.col("key"), "ab")).count() == 1  # by its title, which is none of its key


def test_empty_tables_and_no_titles(spark, tables, tmp_path):
    events, threads = tables
    index = TextIndex.write(str(tmp_path / "i"), events)
    assert index.hits("title").count() == 0 and index.hits("hot").count() == 1
    none = TextIndex.write(str(tmp_path / "n"), events.limit(0), threads.limit(0))
    assert none.hits("a").count() == 0 and none.rows(events.limit(0), "a").count() == 0


def test_only_the_buckets_of_the_needle_are_read(spark, tables, tmp_path):
    index = TextIndex.write(str(tmp_path / "i"), *tables)
    plan = index.postings("title")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "xxhash64" not in plan


def test_a_long_text_is_linear(spark, tmp_path):
    long = "".join(random.Random(1).choices("abcdef", k=1_000_000)) + "needle"
    events = spark.createDataFrame([("t", long, None)], "thread_id string, project string, turn_id string")
    index = TextIndex.write(str(tmp_path / "i"), events)
    assert index.hits("NEEDLE").count() == 1 and index.hits("needles").count() == 0
