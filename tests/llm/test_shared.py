import pyarrow as pa

from tidemark.llm import _shared, _text, packing


def test_a_worker_drops_what_another_operator_kept(monkeypatch):
    monkeypatch.setattr(_shared, "_last", [])
    _shared.begin("packing")
    list(packing.tokenizer(packing.TOKENIZER).encode(pa.array(["some words"])))
    _shared.begin("packing")
    assert packing.tokenizer.cache_info().currsize == 1 and _text._powers
    _shared.begin("minhash")
    assert packing.tokenizer.cache_info().currsize == 0 and not _text._powers


def test_functions_for_workers_begin_as_their_operator(monkeypatch):
    monkeypatch.setattr(_shared, "_last", ["another"])
    assert list(_shared.released(lambda batches: batches)([1, 2])) == [1, 2]
    assert _shared._last == [__name__]


def test_blocks_are_small():
    texts = pa.array(["word " * 20_000] * 12)
    assert max(len(data) for _, _, data, _ in _text.blocks(texts)) <= 1 << 18
