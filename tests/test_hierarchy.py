import random

from pyspark.sql import functions as F

from tidemark.operators import hierarchy
from tidemark.operators.cost import costs
from tidemark.operators.hierarchy import subtree
from tidemark.plans.queries import Usage
from tidemark.schema import MODEL_PRICES, USAGE_EVENTS


def threads(spark, edges):
    return spark.createDataFrame([(i, p, None, "p", f"title {i}") for i, p in edges], "id string, subagent_parent_id string, forked_from_id string, project string, title string")


def test_a_tree_deeper_than_a_hundred_levels(spark):
    chain = [("n000", None)] + [(f"n{k:03d}", f"n{k - 1:03d}") for k in range(1, 104)]
    found = {r.id: r.depth for r in subtree(threads(spark, [*chain, ("else", "other")]), "n000").collect()}
    assert found == {f"n{k:03d}": k for k in range(104)}


def test_a_chain_of_ten_thousand_takes_few_rounds(spark, monkeypatch):
    rounds = []
    kept = hierarchy.materialise
    monkeypatch.setattr(hierarchy, "materialise", lambda *a: rounds.append(1) or kept(*a))
    chain = spark.range(10_000).select(F.concat(F.lit("n"), "id").alias("id"), F.when(F.col("id") > 0, F.concat(F.lit("n"), F.col("id") - 1)).alias("subagent_parent_id"))
    found = subtree(chain, "n10", paths=False)
    assert found.agg(F.count("*"), F.max("depth"), F.sum("depth")).first() == (9990, 9989, 9989 * 9990 // 2)
    assert found.where("depth = 500").first().id == "n510" and len(rounds) < 20


def test_random_forests_with_cycles(spark):
    r = random.Random(6)
    for n in (1, 7, 60):
        up = {f"t{k}": r.choice([None, f"t{r.randrange(n)}", f"t{r.randrange(max(1, k))}", "lost"]) for k in range(n)}
        for root in ("t0", f"t{n // 2}"):
            want = {}
            for k in up:
                path, at = [k], k
                while at != root and up.get(at) in up and up[at] not in path:
                    at = up[at]
                    path.append(at)
                if at == root:
                    want[k] = path[::-1]
            found = subtree(threads(spark, list(up.items())), root).collect()
            assert {x.id: x.path for x in found} == want and all(x.depth == len(x.path) - 1 for x in found)


def test_cycles_end_and_unknown_roots_have_no_tree(spark):
    loop = threads(spark, [("a", "b"), ("b", "a"), ("c", "b"), ("s", "s")])
    assert {r.id: "/".join(r.path) for r in subtree(loop, "a").collect()} == {"a": "a", "b": "a/b", "c": "a/b/c"}
    assert [r.id for r in subtree(loop, "s").collect()] == ["s"]
    assert subtree(loop, "none").count() == 0


def test_agents_tell_their_models_and_costs(spark):
    rows = [("a", "x", 10), ("a", None, 5), ("b", "x", 1_000_000)]
    events = spark.createDataFrame([(t, m, n) for t, m, n in rows], "thread_id string, model string, total_tokens long")
    some = {"input_tokens": "total_tokens", "cached_input_tokens": "0L", "output_tokens": "0L", "incomplete": "0", "excluded": "0", "kind": "'record'", "event_at": "timestamp_ntz'2031-01-01'", "event_key": "uuid()"}
    events = events.select(*[F.expr(some[f.name]).cast(f.dataType).alias(f.name) if f.name in some else F.col(f.name) if f.name in events.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in USAGE_EVENTS])
    prices = spark.createDataFrame([("x", "2", "1", "2", "3", None, None, None, None, None)], MODEL_PRICES)
    found = Usage(events, threads(spark, [("a", None), ("b", "a"), ("c", "a")]), prices).agents("a").collect()
    assert [(r.id, r.parent_id, r.project, r.models, r.cost_amount) for r in found] == [
        ("a", None, "p", [None, "x"], "0.000020000000"), ("b", "a", "p", ["x"], "2.000000000000"), ("c", "a", "p", [], "0.000000000000"),
    ]
    assert [r.cost_complete for r in found] == [False, False, True]  # cache writes aren't reported


def test_all_prices_of_a_large_table_count(spark):
    prices = spark.createDataFrame([(f"m{k}", "1", "1", "1", "1", None, None, None, None, None) for k in range(150)], MODEL_PRICES)
    events = spark.range(150).select(
        F.concat(F.lit("m"), "id").alias("model"), F.lit("t").alias("thread_id"), F.lit("u").alias("turn_id"), F.lit(None).cast("string").alias("project"), F.lit("record").alias("kind"), F.lit(0).alias("incomplete"),
        F.current_timestamp().cast("timestamp_ntz").alias("event_at"), *[F.lit(1).cast("long").alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")], *[F.lit(0).cast("long").alias(c) for c in ("cached_input_tokens", "cache_write_input_tokens", "reasoning_output_tokens")],
    )
    row = costs(events, prices, {}).first()
    assert row.complete and row.amount == "0.000300000000"
