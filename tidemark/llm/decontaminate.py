"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items become one generalised suffix automaton over words, which is sent to the executors;
training text streams past it and every position learns the longest suffix that occurs in some item. Where
that length reaches the window, the words are hit, and the item sets of the automaton's states say by whom.

The items go to the driver a block at a time, each block of about `block_bytes` of item text by a hash; every block is one automaton and one pass
of the text through it, and the next automaton is built when the hits of the last one are written. So one automaton is alive at a time, of a
size that doesn't grow with the number of items.

Most text never reaches the automaton: only runs of word pairs that all occur in some item can hold a match,
and those runs are found with numpy on word hashes. The automaton then compares the words themselves.

Defined results: a null or empty text has no words and no hits; a very long text is held by one task, about fifty bytes for each of its words; repeated rows
are each answered, each by itself, so ties need no rule; a null item text or one without words matches nothing; an item without an id hits words but is not named or counted; items of
equal text all count; an empty benchmark hits nothing; an empty table gives no rows; columns besides doc_id and text are not read.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import answered, materialise, sliced, table
from ._text import ALNUM, Words, blocks, gram_starts, grams

WINDOW = 13
BLOCK_BYTES = 1 << 20

FOUND = "n_words long, longest_match long, spans array<struct<start: long, end: long>>, items array<string>"


class SuffixAutomaton:
    """Of several word sequences. items_of: by state, the items in which its `window` words occur; short: by state, the whole items shorter than that."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.window = window
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.items_of: dict[int, set] = {}
        self.short: dict[int, list] = {}
        for name, words in items:
            state = 0
            for i, w in enumerate(words):
                state = self.next[state][w]
                if i + 1 >= window:
                    at = state = self._shorten(state, window)
                    self.items_of.setdefault(at, set()).add(name)
            if 0 < len(words) < window:
                self.short.setdefault(state, []).append((len(words), name))

    def _shorten(self, state: int, size: int) -> int:
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _clone(self, p: int, q: int, w: bytes) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: bytes) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, w)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
        return new

    def match(self, words: list[bytes]) -> tuple[np.ndarray, set, int]:
        """Which words are hit, by which items, and the longest matching length."""
        hit, items, longest = np.zeros(len(words), bool), set(), 0
        state = size = 0
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            to = self.next[state].get(w)
            if to is None:
                state = size = 0
                continue
            state, size = to, size + 1
            longest = max(longest, size)
            if size >= self.window:
                hit[i + 1 - self.window : i + 1] = True
                items |= self.items_of[self._shorten(state, self.window)]
            if self.short:
                at = state
                while at > 0:
                    for n, name in self.short.get(at, ()):
                        if n <= size:
                            hit[i + 1 - n : i + 1] = True
                            items.add(name)
                    at = self.link[at]
        return hit, items, longest


class Matcher:
    """The automaton and the hashes of the items' words and word pairs that tell where it has to look."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        split, single, pairs = [], [], []
        for _, _, data, offsets in blocks(pa.array([t for _, t in items], pa.string())):
            w = Words(data, offsets, ALNUM, lower=True)
            base = len(split)
            split += [(items[base + k][0], [w.word(i) for i in range(w.first[k], w.first[k + 1])]) for k in range(len(w.count))]
            single.append(w.hash)
            pairs.append(grams(w.hash, 2)[gram_starts(w, 2)])
        split = [x for x in split if x[1]]
        self.automaton = SuffixAutomaton(split, window)
        self.shortest = min((min(len(w), window) for _, w in split), default=0)
        none = [np.zeros(0, np.uint64)]
        self.single, self.pairs = np.unique(np.concatenate(single + none)), np.unique(np.concatenate(pairs + none))
        self.sieve = [self._sieve(x) for x in (self.single, self.pairs)]

    @staticmethod
    def _sieve(hashes):
        bits = np.zeros(1 << 20, bool)
        bits[hashes >> np.uint64(44)] = True
        return bits

    @staticmethod
    def _among(x, hashes, sieve):
        found = sieve[x >> np.uint64(44)]
        at = np.flatnonzero(found)
        if len(hashes):
            found[at] = hashes[np.minimum(np.searchsorted(hashes, x[at]), len(hashes) - 1)] == x[at]
        return found

    def runs(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """First and last word of every run that may hold a match."""
        n = len(w.hash)
        if not self.shortest or not n:
            return np.zeros(0, int), np.zeros(0, int)
        linked = np.zeros(n + 1, bool)  # word i - 1 with word i
        if n > 1:
            linked[1:n] = gram_starts(w, 2) & self._among(grams(w.hash, 2), self.pairs, self.sieve[1])
        if self.shortest == 1:
            known = self._among(w.hash, self.single, self.sieve[0])
        else:
            known = linked[:-1] | linked[1:]
        first = np.flatnonzero(known & ~linked[:-1])
        last = np.flatnonzero(known & ~linked[1:])
        keep = last - first + 1 >= self.shortest
        return first[keep], last[keep]


def _spans(hit: np.ndarray, first: int) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return [(int(a) + first, int(b) + first) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _without(data: np.ndarray, w: Words, doc: int, offsets: np.ndarray, spans: list[dict], longest: int) -> bytes | None:
    """The bytes of a document without the words under runs of at least `longest` hit words and what stands before each; None if there are none."""
    first, last = int(w.first[doc]), int(w.first[doc + 1])
    hit = np.zeros(last - first, bool)
    for s in spans:
        hit[s["start"] : s["end"]] = True
    runs = [(a, b) for a, b in _spans(hit, 0) if b - a >= longest]
    if not runs:
        return None
    out, at = [], int(offsets[doc])
    for a, b in runs:
        out.append(data[at : w.end[first + a - 1] if a else at].tobytes())
        at = int(w.end[first + b - 1])
    return b"".join([*out, data[at : offsets[doc + 1]].tobytes()])


def _cleaned(cut: int):
    """Column function of a text and its spans from several blocks of items: the text without them."""

    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        cleaned, spans = [], spans.to_pylist()
        for row, stop, data, offsets in blocks(texts):
            w = Words(data, offsets, ALNUM, lower=True) if any(spans[row:stop]) else None
            cleaned += [_without(data, w, k - row, offsets, spans[k], cut) if spans[k] else None for k in range(row, stop)]
        return pa.array(cleaned, pa.binary()).cast(pa.string())

    return F.arrow_udf(run, "string").asNondeterministic()


_SPANS, _NAMES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())


def _pass(matcher, cut: int | None = None):
    """From texts what one pass through one block's automaton finds; spans are of words, ends exclusive. cut: if given, also the text without spans of at least so many words, null if it has none."""

    def answers(texts):
        m = matcher.value
        n_words, spans, items, longest, cleaned = [], [], [], [], []
        for _, _, data, offsets in blocks(texts):
            w = Words(data, offsets, ALNUM, lower=True)
            found = {}
            for a, b in zip(*m.runs(w), strict=True):
                hit, by, size = m.automaton.match([w.word(i) for i in range(a, b + 1)])
                doc = int(w.doc[a])
                s, i, l = found.get(doc, ([], set(), 0))
                found[doc] = (s + _spans(hit, int(a - w.first[doc])), i | by, max(l, size))
            n_words.append(w.count)
            for doc in range(len(w.count)):
                s, i, l = found.get(doc, ((), (), 0))
                spans.append([{"start": a, "end": b} for a, b in s])
                items.append(sorted(x for x in i if x is not None))
                longest.append(l)
                if cut is not None:
                    cleaned.append(_without(data, w, doc, offsets, spans[-1], cut) if s else None)
        counts = np.concatenate([*n_words, np.zeros(0, np.int64)]).astype(np.int64)
        out = {"n_words": pa.array(counts), "longest_match": pa.array(longest, pa.int64()), "spans": pa.array(spans, _SPANS), "items": pa.array(items, _NAMES)}
        return out | ({} if cut is None else {"cleaned": pa.array(cleaned, pa.binary()).cast(pa.string())})

    return answers


def _hits(matcher):
    """The keys of texts and what one pass finds, of texts that it finds something in."""

    def run(batches):
        for batch in sliced(batches):
            rows = pa.RecordBatch.from_pydict({"t": batch.column("t"), "u": batch.column("u")} | _pass(matcher)(batch.column("text")))
            yield rows.filter(pc.greater(rows.column("longest_match"), 0))

    return run


def _key(text):
    """Two hashes of a text, 96 bits."""
    return F.xxhash64(text).alias("t"), F.hash(text).alias("u")


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, row: bool = False, cut: int | None = None) -> DataFrame:
    """doc_id, n_words, longest_match, spans of hit words and the items that hit, for every row of docs; if row, a struct of all its columns instead of doc_id.

    cut: with row, adds `cleaned`, the text without spans of at least so many hit words and what stands before each of them, null if it has none.

    The first block of items goes by in the pass that answers all rows. Each further one is a pass by itself, written before the next automaton is built: it keeps
    only what it has hit, by the hash of the text. longest_match is 0 where no run of words is as long as the shortest window of the items.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))

    def matcher(k):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        return spark.sparkContext.broadcast(Matcher([(r[0], r[1]) for r in block.orderBy("item_id", "text").collect()], window))

    text = F.col("text").cast("string")
    more = None
    for k in range(1, n):
        sent = matcher(k)
        hits = docs.select(*_key(text), text.alias("text")).mapInArrow(_hits(sent), f"t long, u int, {FOUND}").dropDuplicates(["t", "u"])
        hits = materialise(hits.drop("n_words"))
        more = hits if more is None else more.unionByName(hits)
        sent.destroy()
    if more is None:
        return answered(docs, _pass(matcher(0), cut), FOUND if cut is None else f"{FOUND}, cleaned string", row)
    names = ["row"] if row else ["doc_id"]
    first = answered(docs, _pass(matcher(0)), FOUND, row, *_key(text))
    of_text = more.groupBy("t", "u").agg(F.flatten(F.collect_list("spans")).alias("spans2"), F.flatten(F.collect_list("items")).alias("items2"), F.max("longest_match").alias("longest2"))
    both = first.join(of_text, ["t", "u"], "left")
    none = lambda c, like: F.coalesce(c, F.array().cast(both.schema[like].dataType))
    out = both.select(
        *names, "n_words", F.greatest("longest_match", F.coalesce("longest2", F.lit(0).cast("long"))).alias("longest_match"), F.concat("spans", none("spans2", "spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.concat("items", none("items2", "items")))).alias("items"),
    )
    return out if cut is None else out.withColumn("cleaned", _cleaned(cut)(F.col("row.text").cast("string"), F.col("spans")))


def merge_spans(spans):
    """Column: the number of words under the spans, which may overlap when they come from several blocks."""
    start = F.array_sort(spans)
    step = F.aggregate(
        start,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], a["to"]))).alias("n"), F.greatest(a["to"], s["end"]).alias("to")),
    )
    return step["n"]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_percent: int = 5, row: bool = False, cut: int | None = None) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items (sorted ids) and contaminated, true when hits cover max_percent of the words or more."""
    found = find_overlaps(docs, benchmark, window, row=row, cut=cut)
    n_hit = merge_spans(F.col("spans"))
    return (
        found.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(100) * F.col("n_hit") >= F.lit(max_percent) * F.col("n_words")))
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
sized AS (SELECT *, least(13, len(ws)) AS n FROM b WHERE len(ws) > 0),
item_windows AS (SELECT DISTINCT item_id, n, array_to_string(ws[i : i + n - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM sized)),
doc_windows AS (SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS k FROM (SELECT d.*, s.n, unnest(range(1, len(ws) - s.n + 2)) AS i FROM d, (SELECT DISTINCT n FROM sized) s WHERE len(ws) >= s.n)),
hits AS (SELECT doc_id, i, n, item_id FROM doc_windows JOIN item_windows USING (n, k)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), false) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
