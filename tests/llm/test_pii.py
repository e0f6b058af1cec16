import hashlib
import itertools
import re
import time

import numpy as np
import pytest

from tidemark.llm import pii
from tidemark.llm._shared import table

from .fixtures import empty, frame, odd


def brute(text):
    """The contract, as it is written."""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((0, *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and pii.luhn(d):
            found.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((3, *m.span()))
    return found


TEXTS = [
    "a@b.c@d.e f@g a.b@c-d.e.f. x%y+z@q.r_s@t.u @a.b a@@b.c a@b@c.d",
    "1.2.3.4.5.6.7.8 300.1.2.3 1.2.3 001.002.003.255 1..2.3.4 10.0.0.1.",
    "4111 1111 1111 1111 and 4111-1111-1111-1111 4111111111111112 4111  1111 1111 1111 5500005555555559 1",
    "+1 (988) 555-2485, +12345678 +4930123456789012345 ++49 30 1234567 +1)",
    "é 4111111111111111 ü@x.y \U0001f600 a@b.co",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans_follow_the_contract(text):
    assert pii.base_spans(text) == brute(text)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_query_on_the_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rows = pii.op1(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        want = brute(docs[r.doc_id])
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in want) for i in range(4)]
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


SAMPLE = [f"call me on +49 30 {1000000 + 7919 * i} or write to user{i}.name@mail{i}.example.com today" for i in range(60)]
SAMPLE += [f"nothing of note in line {i} of part {i * 3}" for i in range(60)]
CARD = "4111 1111 1111 1111"


def test_skip_edges_add_distant_repetitions(spark):
    far = " and more words" * 200
    texts = [
        *SAMPLE,
        "write to marwin.42@mail.example.com please" + far + " then ask MARWIN.42@MAIL or (marwin-42) today",
        f"pay with {CARD} now," + far + " or 4111.1111.1111.1111 or 4111111111111111 again",
        'token = "a3f09bc4e5d6718293a4b5c6"' + far + " use a3f09bc4e5d6718293a4b5c6 here",
        "the numbers 9870157079875996 and 9870157079875996 and 1234567 of 1234567 are none",
    ]
    rows = {r.doc_id: r for r in pii.find(frame(spark, texts)).collect()}

    def found(i, c):
        return [(s.kind, texts[i][s.start : s.end]) for s in rows[i][c]]

    assert found(120, "base") == [("email", "marwin.42@mail.example.com")]
    assert found(120, "spans") == [("email", "marwin.42@mail.example.com"), ("email", "MARWIN.42@MAIL"), ("email", "marwin-42")]
    assert found(121, "spans") == [("card", CARD), ("card", "4111.1111.1111.1111"), ("card", "4111111111111111")]
    assert found(122, "spans") == [] and [x for _, x in found(122, "secrets")] == ["a3f09bc4e5d6718293a4b5c6"] * 2
    assert found(123, "spans") == found(123, "secrets") == []
    assert all(not rows[i].spans for i in range(60, 120))
    assert rows[122].redacted == 'token = "<secret>"' + far + " use <secret> here" and rows[123].redacted is None


def documents(texts, evidence):
    return [pii.Document(t, pii.base_spans(t) + pii.secrets(t), evidence) for t in texts]


def test_the_gain_is_learned_from_hidden_labels():
    """Repeated tokens that agree raise the gain over a skip edge; those of the same digits but different kinds lower it."""
    alike = [f"mail x{i}abc@d.example and x{i}abc@d.example" for i in range(100)]
    unlike = [f"from 110.20.{30 + i}.40 call +11020{30 + i}40" for i in range(60)] * 3
    agreed, mixed = (pii.SkipChain().fit(documents([*SAMPLE, *more], True)) for more in (alike, unlike))
    assert agreed.skip > mixed.skip + 1 and agreed.skip > 2


def exact(model, d):
    """Marginals by enumeration of all labellings."""
    n = len(d.spans)
    unary = d.matrix(d.candidates()) @ model.node
    total = np.zeros((n, pii.LABELS))
    for y in itertools.product(range(pii.LABELS), repeat=n):
        if all(not g or g == a for g, a in zip(d.label, y, strict=True)):
            score = sum(unary[i, a] for i, a in enumerate(y) if not d.label[i])
            score += sum(model.chain[y[a], y[b]] for a, b in d.chain) + sum(model.skip for a, b in d.skip if y[a] == y[b])
            for i, a in enumerate(y):
                total[i, a] += np.exp(score)
    return total / total.sum(1, keepdims=True)


def test_marginals_against_enumeration():
    model = pii.SkipChain().fit(documents(SAMPLE, True))
    model.skip = 1.5
    tree = documents(["ask marwin.42@m.example.com x marwin.42 y"], False)[0]
    assert len(tree.skip) == 1 and np.allclose(model.marginals(tree), exact(model, tree), atol=1e-4)
    chained = documents(["ask marwin.42@m.example.com then marwin.42 7 yes MARWIN42 or so"], False)[0]
    assert len(chained.spans) == 4 and len(chained.skip) == 3 and len(chained.chain) == 1
    assert np.allclose(model.marginals(chained), exact(model, chained), atol=0.1)  # a loop: not exact, but near


def test_a_documents_answer_depends_on_it_alone(spark):
    texts = [*SAMPLE, "write to marwin.42@mail.example.com and MARWIN.42@MAIL " + "1234567 " * 50]
    model = pii.train(frame(spark, texts))
    alone = pii.find(frame(spark, {0: texts[-1]}), model).first().spans
    assert alone == next(r.spans for r in pii.find(frame(spark, texts), model).collect() if r.doc_id == 120) and len(alone) == 2


def test_long_texts_are_linear():
    for text in ("key" * 300_000, "1 " * 500_000, "a@b.co " * 100_000, "+1 2 " * 200_000, "token=" * 200_000, "1.1.1.1 " * 50_000 + "1.1.1.1"):
        began = time.process_time()
        base = pii.base_spans(text) + pii.secrets(text)
        pii.redacted(text, base)
        pii.SkipChain().added(pii.Document(text, base, False))
        assert time.process_time() - began < 20


def test_odd_rows(spark):
    rows = pii.find(odd(spark)).collect()
    assert len(rows) == 8
    assert [len(r.spans) for r in rows if r.doc_id is None] == [1]
    assert all(not r.spans for r in rows if r.doc_id is not None)
    assert pii.find(empty(spark)).count() == 0


def test_redaction(spark):
    docs = frame(spark, ["mail a@b.co or 10.0.0.1 now", "nothing"])
    assert {r.doc_id: r.redacted for r in pii.find(docs).collect()} == {0: "mail <email> or <ip> now", 1: None}
    assert pii.redacted("abcdef", [(0, 1, 4), (3, 2, 5), (1, 5, 6)]) == "a<email><ip>"


def test_many_different_numbers_are_linear():
    addresses = [f"{i % 200 + 1}.{i // 200 % 250}.{i // 50_000}.{i % 251}" for i in range(50_000)]
    for gap in (" ", ", ", " / "):
        text = gap.join(addresses)
        began = time.process_time()
        base = pii.base_spans(text)
        assert len(base) == 50_000
        pii.SkipChain().added(pii.Document(text, base, False))
        assert time.process_time() - began < 5


def test_numbers_are_found_wherever_they_come_again():
    text = f"pay {CARD} or 12 4111/1111/1111/1111 99 and 4111.1111.1111.1111"
    found = [text[a:b] for _, a, b in pii._places(text, {"4111111111111111"})]
    assert found == [CARD, "4111/1111/1111/1111", "4111.1111.1111.1111"]
    both = [d for d, _, _ in pii._places(text, {"4111111111111111", "1111"})]
    assert (both.count("4111111111111111"), both.count("1111")) == (3, 9)  # three in each of three runs, none over another


def test_a_huge_text_is_no_end_of_the_sample(spark):
    """Whatever its place in the order, it costs the sample itself only."""
    texts = {i: t for i, t in enumerate(SAMPLE)}
    for huge in (500, 501, 502):
        docs = frame(spark, texts | {huge: "call 1 " * 20_000})
        some, all_ = pii.train(docs, most_bytes=100_000), pii.train(frame(spark, texts))
        assert np.allclose(some.node, all_.node) and some.skip == all_.skip
