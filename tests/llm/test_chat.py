import hashlib
import random
import time

from pyspark.sql import functions as F
from tidemark.llm import chat

from tests import oracle

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, turns string"


def test_round_trip_of_hostile_content(spark):
    r = random.Random(2)
    bits = ["### ", "</turn>", "\\", "\\h", "\\e", "\n", ": ", "*", "#", "<", "/turn>", "é", "user", "</turn", "###", " ", "\U0001f600", "\\\\"]
    data = []
    for conv in range(150):
        for turn in range(r.randint(1, 5)):
            role = r.choice(["user", "assistant", "a: b", "x*", "### ", "</turn>\n", "", "\\c:", "system\n"])
            data.append((conv, turn, role, "".join(r.choice(bits) for _ in range(r.randint(0, 9))), "x", "y"))
    found = chat.format_chats(spark.createDataFrame(data, SCHEMA))
    read = found.select("*", chat.parse(found.formatted).alias("turns"), chat.under_mask(found.formatted, found.loss_spans).alias("loss")).collect()
    assert len(read) == 150
    for row in read:
        own = [d for d in data if d[0] == row.conv_id]
        assert [(t.role, t.text) for t in row.turns] == [(d[2], d[3]) for d in own]
        assert row.loss == "".join(d[3] for d in own if d[2] == "assistant")


def test_only_conflicting_content_is_escaped(spark):
    data = [(1, 0, "user", "a \\ b # < </turn", "", ""), (1, 1, "assistant", "x</turn>y", "", "")]
    found = chat.format_chats(spark.createDataFrame(data, SCHEMA)).first()
    assert found.formatted == "### user: a \\ b # < </turn</turn>\n### assistant*: x\\ey</turn>\n"


def test_query_against_sql(spark, sf_dir):
    assert oracle.rows(chat.op4(spark, sf_dir)) == oracle.run(chat.ORACLE, sf_dir)


def test_odd_rows(spark):
    data = [(None, 0, "user", "a", "", ""), (None, None, None, None, "", ""), (2, 1, "assistant", "b", "", ""), (2, 1, "assistant", "b", "", ""), (3, 0, "user", "w " * 100_000, "", "")]
    found = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(data, SCHEMA)).collect()}
    assert found[None].formatted == "### : </turn>\n### user: a</turn>\n"
    assert found[2].formatted == "### assistant: b</turn>\n" * 2 and len(found[2].loss_spans) == 2
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_long_conversation_is_linear(spark):
    rows = spark.range(100_000).select(F.lit(5).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("### x "), F.repeat(F.lit("long "), 20), "id").alias("text"))
    began = time.perf_counter()
    found = chat.format_chats(rows)
    row = found.select(F.size(chat.parse(F.col("formatted"))).alias("n"), F.sha2(chat.under_mask(F.col("formatted"), F.col("loss_spans")), 256).alias("loss")).first()
    assert row.n == 100_000
    assert row.loss == hashlib.sha256("".join("### x " + "long " * 20 + str(i) for i in range(1, 100_000, 2)).encode()).hexdigest()
    assert time.perf_counter() - began < 60
