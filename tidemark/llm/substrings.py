"""Exact substring dedup over words by fixed-block anchors.

A repeat of `window` words holds, in each of its places, a whole block of (`window` + 1) // 2 words of that document's own
non-overlapping blocking, wherever it starts. So:

1. Index: the blocks at words 0, b, 2b, ... of every document are the reference blocks.
2. Probe: every rolling window of b words of every document is looked up in the index. Hashes go to the owners
   of their range in packed messages (see exchange.py), distinct values once per block of documents; owners
   answer which reference blocks also start somewhere else.
3. Extend: around every hit anchor, all windows of `window` words that contain it are looked up among the windows around the other
   anchors, in the same way; runs of confirmed windows are the maximal exact repeats.

So a group of copies of any size is never paired. Probes use the upper 48 bits of a hash, which can only add work to step 3; its
windows are compared by 64-bit hashes, of which two different ones are equal with a probability of 5e-20.

Defined results: a null or empty text has no words; a very long text is held by one task, some tens of bytes for each word; repeated rows repeat each other's windows, so both lose them (no copy is preferred, so ties need no rule); a row without doc_id
takes part; an empty table gives no rows; columns besides doc_id and text are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table
from ._text import Words, blocks, gram_starts, grams
from .exchange import SENT, Work, block_count, echoed, exchange, in_blocks, levels, runs, sums
from .exchange import table as table_of

WINDOW = 35
_TOP = np.uint64(0xFFFFFFFFFFFF0000)

KEPT = "doc_id long, n_words long, n_removed long, kept string"


def _is_in(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values: sorted."""
    if not len(values) or not len(x):
        return np.zeros(len(x), bool)
    sieve = np.zeros(1 << 16, bool)
    sieve[values >> np.uint64(48)] = True
    found = sieve[x >> np.uint64(48)]
    at = np.flatnonzero(found)
    found[at] = values[np.minimum(np.searchsorted(values, x[at]), len(values) - 1)] == x[at]
    return found


def _anchors(w: Words, size: int) -> np.ndarray:
    """First words of the reference blocks."""
    place = np.arange(len(w.hash)) - w.first[w.doc]
    whole = gram_starts(w, size)
    return np.flatnonzero((place[: len(whole)] % size == 0) & whole)


def _again(kind: int, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether a value occurs more than once, in whatever blocks."""
    return counts % ASKED > 1


def _union(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of several lists: two occurrences are as good as any number, and who asks is known at home."""
    values, n = sums(values, counts % ASKED)
    return values, np.minimum(n, 2)


#: Added to the count of a value of which a block wants to know.
ASKED = 4
WORK = Work(_again, {0: np.uint8}, merge=_union, echo=lambda counts, again: (counts >= ASKED) & (again > 0))


def _distinct(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values, and how often each occurs, or 2 for more."""
    values, n = runs(np.sort(np.concatenate([*parts, np.zeros(0, np.uint64)])))
    return values, np.minimum(n, 2)


def _probe(size: int, parts: int):
    """Of one block: all its rolling windows; it asks about those that are reference blocks."""

    def run(docs: pa.Table) -> pa.Table:
        every, own = [], []
        for _, _, data, offsets in blocks(docs.column("text")):
            w = Words(data, offsets)
            g = grams(w.hash, size) & _TOP
            every.append(g[gram_starts(w, size)])
            own.append(g[_anchors(w, size)])
        values, n = _distinct(every)
        return table_of(WORK.messages(0, values, n + ASKED * _is_in(values, _distinct(own)[0]), parts, docs.column("block")[0].as_py()), SENT)

    return run


def _around(w: Words, hits: np.ndarray, size: int, window: int) -> np.ndarray:
    """True at the starts of windows that hold one of the anchors."""
    whole = gram_starts(w, window)
    near = np.zeros(len(whole) + 1, np.int32)
    first = np.maximum(hits - (window - size), w.first[w.doc[hits]])
    np.add.at(near, np.minimum(first, len(whole)), 1)
    np.add.at(near, np.minimum(hits + 1, len(whole)), -1)
    return (np.cumsum(near[:-1]) > 0) & whole


def _windows(w: Words, hits: np.ndarray, size: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows around the anchors whose hashes are among the hits."""
    g = grams(w.hash, size) & _TOP
    at = _anchors(w, size)
    starts = np.flatnonzero(_around(w, at[_is_in(g[at], hits)], size, window)) if len(hits) else np.zeros(0, np.int64)
    return starts, grams(w.hash, window)[starts] if len(starts) else np.zeros(0, np.uint64)


def _extend(size: int, window: int, parts: int):
    """Of one block: the windows around its hit anchors."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        hits = echoed(found)
        if not docs.num_rows or not len(hits):
            return table_of([], SENT)
        values, n = _distinct([_windows(Words(data, offsets), hits, size, window)[1] for _, _, data, offsets in blocks(docs.column("text"))])
        return table_of(WORK.messages(0, values, n + ASKED, parts, docs.column("block")[0].as_py()), SENT)

    return run


def _remove(window: int):
    """Of one block: what is left of each text without the words under repeated windows."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        repeated = echoed(found)
        n_words, n_removed, kept = [], [], []
        for _, _, data, offsets in blocks(docs.column("text")):
            w = Words(data, offsets)
            cover = np.zeros(len(w.hash) + 1, np.int32)
            if len(repeated):
                g = grams(w.hash, window)
                at = np.flatnonzero(gram_starts(w, window) & _is_in(g, repeated))
                np.add.at(cover, at, 1)
                np.add.at(cover, at + window, -1)
            gone = np.cumsum(cover[:-1]) > 0
            total = np.concatenate(([0], np.cumsum(gone)))
            lost = total[w.first[1:]] - total[w.first[:-1]]
            raw = data.tobytes()
            for k, n in enumerate(w.count):
                text = raw[offsets[k] : offsets[k + 1]]
                words = text.split() if not lost[k] else [raw[a:b] for a, b, x in zip(*(c[w.first[k] : w.first[k + 1]].tolist() for c in (w.start, w.end, gone)), strict=True) if not x]
                assert lost[k] or len(words) == n
                kept.append(b" ".join(words))
            n_words.append(w.count)
            n_removed.append(lost)
        flat = lambda parts: pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64))
        return pa.table([docs.column("doc_id"), flat(n_words), flat(n_removed), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by single spaces) of every row."""
    size = (window + 1) // 2
    n = block_count(docs)
    parts = levels(n)[0]
    rows = in_blocks(docs, n)
    # the text is shuffled once: all three uses share the exchange
    hits, _ = exchange(rows.groupBy("block").applyInArrow(_probe(size, parts), SENT), n, WORK)
    windows = rows.groupBy("block").cogroup(hits.groupBy("source")).applyInArrow(_extend(size, window, parts), SENT)
    repeated, _ = exchange(windows, n, WORK)
    return rows.groupBy("block").cogroup(repeated.groupBy("source")).applyInArrow(_remove(window), KEPT)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents),
keys AS (SELECT doc_id, list_transform(range(1, len(ws) - 33), lambda i: md5(array_to_string(ws[i : i + 34], ' '))) AS ks FROM w WHERE len(ws) >= 35),
starts AS (SELECT doc_id, unnest(ks) AS k, generate_subscripts(ks, 1) AS i FROM keys),
repeated AS (SELECT doc_id, i FROM starts QUALIFY count(*) OVER (PARTITION BY k) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM repeated, unnest(range(35)) AS t(k)),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
marked AS (SELECT words.*, gone.p IS NOT NULL AS out FROM words LEFT JOIN gone USING (doc_id, p)),
sums AS (SELECT doc_id, count(*) FILTER (WHERE out) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT out) AS kept FROM marked GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN sums USING (doc_id)
"""
