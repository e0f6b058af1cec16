import math
import random

import numpy as np
import pytest

from tidemark.llm import toxicity

from .fixtures import empty, frame, odd


@pytest.fixture(scope="module")
def planted(spark):
    """2,000 documents of which a tenth holds a word of a small list, with labels for half of them."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    bad = ["grimble", "grimbling", "snarfed"]
    texts, toxic = {}, {}
    for i in range(2000):
        toxic[i] = int(r.random() < 0.1)
        text = [r.choice(words) for _ in range(r.randint(5, 80))]
        if toxic[i]:
            text.insert(r.randint(0, len(text)), r.choice(bad))
        texts[i] = " ".join(text)
    labels = spark.createDataFrame([(i, 1, t) for i, t in toxic.items() if i % 2], "doc_id long, quality int, toxic int")
    return frame(spark, texts), labels, toxic


def test_held_out_accuracy(spark, planted):
    docs, labels, toxic = planted
    model = toxicity.train(docs, labels, lambda i: toxicity.fold(i) != 0)
    rows = toxicity.score(docs, model).where(toxicity.fold(toxicity.F.col("doc_id")) == 0).collect()
    flagged = {r.doc_id for r in rows if r.score >= 0.5}
    real = {r.doc_id for r in rows if toxic[r.doc_id]}
    assert len(flagged & real) >= 0.9 * len(real) and len(flagged - real) <= 0.02 * len(rows)


def test_labels_of_the_held_out_fold_teach_nothing(spark, planted):
    docs, labels, _ = planted
    usable = lambda i: toxicity.fold(i) != 0
    turned = labels.withColumn("toxic", toxicity.F.when(usable(toxicity.F.col("doc_id")), labels.toxic).otherwise(1 - labels.toxic))
    one, two = (toxicity.train(docs, x, usable) for x in (labels, turned))
    assert np.array_equal(one.weights, two.weights) and one.bias == two.bias


def test_risk_is_never_negative_for_few_unlabelled():
    """Memorising the only unlabelled documents gains nothing: weights stay bounded."""
    model = toxicity.fit([np.array([1])] * 20, [np.array([2])] * 20, 0.5)
    assert np.isfinite(model.weights).all() and abs(model.weights).max() < 50


def test_query_on_the_table(spark, sf_dir):
    rows = toxicity.op8(spark, sf_dir).collect()
    assert len({r.doc_id for r in rows}) == len(rows) == toxicity.table(spark, sf_dir, "documents").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_odd_rows(spark):
    labels = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (6, None), (99, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd(spark), labels, lambda i: toxicity.fold(i) != 0)
    assert toxicity.score(odd(spark), model).count() == 8
    none = toxicity.train(odd(spark), labels.limit(0), lambda i: toxicity.fold(i) != 0)
    assert {r.score < 0.01 for r in toxicity.score(odd(spark), none).collect()} == {True}
    assert toxicity.score(empty(spark), toxicity.train(empty(spark), labels, lambda i: toxicity.fold(i) != 0)).count() == 0


def brute_risk(p, u, prior):
    """Both parts of the risk, a loss at a time."""
    loss = lambda m, y: math.log(1 + math.exp(-y * m))
    return prior * sum(loss(m, 1) for m in p) / len(p), sum(loss(m, -1) for m in u) / len(u) - prior * sum(loss(m, -1) for m in p) / len(p)


def test_risk_and_slopes_against_brute_force():
    rng = np.random.default_rng(4)
    seen = set()
    for prior in (0.05, 0.4, 0.9):
        for shift in (-2.0, 0.0, 3.0):
            p, u = rng.normal(shift, 2, 7), rng.normal(-shift, 2, 11)
            plus, minus = brute_risk(p, u, prior)
            value, slope_p, slope_u = toxicity.risk(p, u, prior)
            assert abs(value - plus - max(0, minus)) < 1e-9
            seen.add(minus >= 0)
            goal = (lambda a, b: sum(brute_risk(a, b, prior))) if minus >= 0 else lambda a, b: -brute_risk(a, b, prior)[1]  # noqa: B023
            for slope, at, other in ((slope_p, p, lambda x: goal(x, u)), (slope_u, u, lambda x: goal(p, x))):  # noqa: B023
                for k in range(len(at)):
                    up, down = at.copy(), at.copy()
                    up[k] += 1e-6
                    down[k] -= 1e-6
                    assert abs((other(up) - other(down)) / 2e-6 - slope[k]) < 1e-6
    assert seen == {True, False}


def test_a_huge_text_is_no_end_of_the_sample(spark, planted):
    docs, labels, _ = planted
    usable = lambda i: toxicity.fold(i) != 0
    plain = toxicity.train(docs, labels, usable)
    for huge in (5001, 5002, 5003):
        more = docs.unionByName(frame(spark, {huge: "grimble w1 " * 100_000}))
        marked = labels.unionByName(spark.createDataFrame([(huge, 1, 0)], labels.schema))
        one = toxicity.train(more, labels, usable, most_bytes=1_000_000)
        assert np.array_equal(one.weights, plain.weights)
        assert np.count_nonzero(toxicity.train(more, marked, usable, most_bytes=1_000_000).weights) > 0


def copied(rng, positive, size, share=0.1):
    """Feature rows: 0 to 9 tell, three to thirty of them in a toxic row; 40 to 400 others of 6,000. A third of the rows are near copies of a few texts, toxic ones or not."""
    rows = []
    toxic = np.ones(size, bool) if positive else rng.permutation(size) < share * size
    fillers = np.random.default_rng(7)
    kinds = {x: [10 + fillers.choice(6000, 400, replace=False) for _ in range(6)] for x in (True, False)}
    for bad in toxic:
        copy = rng.random() < 0.35
        own = kinds[bool(bad)][rng.integers(6)][rng.random(400) < 0.98] if copy else 10 + rng.choice(6000, rng.integers(40, 400), replace=False)
        words = rng.integers(0, 10, 4 if copy else rng.integers(3, 30)) if bad else []
        rows.append(np.unique(np.concatenate([own, words])).astype(np.uint32))
    return rows, toxic


def test_copies_and_many_telling_words_hide_no_toxic_document():
    rng = np.random.default_rng(5)
    positive, unlabelled, (held, toxic) = copied(rng, True, 1500)[0], copied(rng, False, 6000)[0], copied(rng, False, 4000)
    model = toxicity.fit(positive, unlabelled, 0.1)
    flagged = model.margins(held) >= 0
    assert flagged[toxic].mean() >= 0.95 and flagged[~toxic].mean() <= 0.01
    assert set(np.flatnonzero(model.weights)) >= set(range(10)) and np.count_nonzero(model.weights) < 100


def test_near_copies_count_once():
    rng = np.random.default_rng(2)
    rows = [rng.choice(1 << 18, 300, replace=False).astype(np.uint32) for _ in range(40)]
    near = [np.append(r[:-5], r[-5:] + 1 & 0x3FFFF).astype(np.uint32) for r in rows]
    mixed = rows + near + rows
    first = toxicity.firsts(np.stack([toxicity.sketch(r) for r in mixed]))
    assert first[:40].all() and not first[80:].any() and first[40:80].sum() <= 2
    none = [np.zeros(0, np.uint32)] * 3
    assert toxicity.firsts(np.stack([toxicity.sketch(r) for r in none])).tolist() == [True, False, False]
    assert np.array_equal(toxicity.frequencies(rows * 10), np.bincount(np.concatenate(rows), minlength=1 << 18) * 10)


def test_slopes_of_bounded_margins():
    rng = np.random.default_rng(4)
    squash = lambda x: toxicity.BOUND * np.tanh(x / toxicity.BOUND)
    for shift in (0.0, 3.0, -2.0):
        p, u = rng.normal(shift, 4, 7), rng.normal(-shift, 4, 11)
        plus, minus = brute_risk(squash(p), squash(u), 0.4)
        slopes = toxicity.bounded(p, u, 0.4)
        goal = lambda a, b: (lambda r: r[0] + r[1] if minus >= 0 else -r[1])(brute_risk(squash(a), squash(b), 0.4))  # noqa: B023, E731
        for k, (at, slope) in enumerate(zip((p, u), slopes, strict=True)):
            for i in range(len(at)):
                up, down = at.copy(), at.copy()
                up[i] += 1e-6
                down[i] -= 1e-6
                pair = [(up, u), (down, u)] if k == 0 else [(p, up), (p, down)]
                assert abs((goal(*pair[0]) - goal(*pair[1])) / 2e-6 - slope[i]) < 1e-6
