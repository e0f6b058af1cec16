import re

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import minhash, packing, pii, toxicity
from tidemark.llm._shared import table

from .fixtures import empty, frame, odd
from .test_decontaminate import brute as overlaps
from .test_decontaminate import words
from .test_minhash import brute as near


def cut_out(text, items, window=13):
    """The text without runs of `window` words or more under item windows, and what stands before each word of them."""
    spans = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)]
    w, hit = words(text), set()
    for item in items:
        size = min(window, len(item))
        wanted = {tuple(item[i : i + size]) for i in range(len(item) - size + 1)} if size else set()
        hit.update(p for i in range(len(w) - size + 1) if size and tuple(w[i : i + size]) in wanted for p in range(i, i + size))
    out, i = [], 0
    at = 0
    while i < len(w):
        j = i
        while j in hit:
            j += 1
        if j - i >= window:
            at = spans[j - 1][1]
        else:
            j = max(j, i + 1)
            out.append(text[at : spans[j - 1][1]])
            at = spans[j - 1][1]
        i = j
    return "".join(out) + text[at:]


def test_run_against_the_stages_one_by_one(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    texts = {r.doc_id: r.text for r in documents.collect()}
    model = toxicity.train(documents, labels, lambda i: toxicity.fold(i) != 0)
    clean = {r.doc_id for r in toxicity.score(documents, model).where("score < 0.5").collect()}
    texts = {i: t for i, t in texts.items() if i in clean}
    groups = near(texts, corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT)
    texts = {i: t for i, t in texts.items() if groups[i][1] == i}
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    split = [words(t) for _, t in items]
    texts = {i: cut_out(t, split) if x[1] else t for (i, t), x in zip(texts.items(), overlaps(texts.values(), items, 13), strict=True) if not x[3]}
    field = pii.train(frame(spark, texts))
    for i, t in texts.items():
        seen = pii.base_spans(t) + pii.secrets(t)
        texts[i] = pii.redacted(t, seen + (field.added(pii.Document(t, seen, False)) if seen else []))
    assert any("<email>" in t for t in texts.values())
    theirs = Tokenizer.from_file(packing.TOKENIZER)
    want = {i: [*theirs.encode(t, add_special_tokens=False).ids, packing.END] for i, t in texts.items()}
    got, places = {}, {}
    for r in sorted(corpus_pipeline.run(spark, sf_dir).collect(), key=lambda r: (r.doc_id, r.start)):
        own = got.setdefault(r.doc_id, [])
        assert r.start == len(own) and r.doc_tokens == len(want[r.doc_id]) and r.length * 4 == len(r.ids)
        own += np.frombuffer(r.ids, "<u4").tolist()
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want and 100 < len(want) < documents.count()
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.WINDOW


def test_near_duplicates_lose_no_text(spark, sf_dir):
    """Ids with several texts, repeated rows, copies without an id."""
    one, two, three = ("".join(f"{w}{i} " for i in range(40)) for w in "abc")
    rows = [(3, one), (7, one), (7, two), (9, two), (9, two), (9, three), (3, three), (None, one), (None, three + "more"), (4, None), (4, ""), (None, " "), (None, "only here and nowhere else")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()]
    assert sorted(kept, key=str) == sorted([(3, one), (7, two), (3, three), (4, None), (4, ""), (None, " "), (None, "only here and nowhere else")], key=str)
    found = minhash.near_duplicates(docs, 5, 80).collect()
    assert len(found) == len(rows) and sum(r.kept for r in found) == len(kept)
    assert {r.component_id for r in found if r.doc_id == 9} == {7, 3}


def test_stages_keep_the_columns(spark, sf_dir):
    docs = frame(spark, ["write to a.bc@d.example now " + "clean words of some length " * 5, "other text"])
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "start", "label"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (docs, odd(spark), empty(spark)):
            out = stage(spark, rows, sf_dir)
            assert out.columns == rows.columns
            if rows is docs:
                assert out.count() == 2
            elif stage is not corpus_pipeline.drop_near_duplicates:
                assert out.count() == rows.count()
    out = {r.doc_id: r for r in corpus_pipeline.redact_personal_data(spark, docs, sf_dir).collect()}
    assert out[0].text.startswith("write to <email> now") and out[0].n_chars == len(out[0].text)
    assert out[1].text == "other text"


def test_parameters():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "packing"]
    assert minhash.banding(0.85) == (20, 5) and minhash.banding(0.8) == (25, 4) and len(pii.KINDS) == 4
