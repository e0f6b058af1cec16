"""Code length of documents by prediction by partial matching over bytes, and by counted words.

The model is a byte-context trie of order `ORDER`, learned from all training documents. It gives a symbol b after a context
s the probability c(s, b) / (T + d) if b was seen there (T symbols, d different ones), else the escape probability d / (T + d)
times that of b after the next shorter context, where the symbols seen after s no longer count (symbol exclusion).
Under the empty context all symbols not seen at all are alike. A document begins after the end mark and ends with it, so probabilities
of texts sum to one.

The trie is never in one place. A context is a run of bytes read backwards, so sorted keys (context backwards, symbol) are the
trie, and all contexts that end in the same two bytes are one owner's, to whom each comes once, merged from many blocks. Blocks of documents send the owners their
distinct keys and counts, and get the log probability of every key back (see exchange.py). The owners share one small table, of pairs of
bytes, of at most 65,536 counts. Words are counted in the same way, by ranges of their hashes; two words share
a 64-bit hash with a probability of 5e-20.

Defined results: a null or empty text is the end alone; a very long text is held by one task, some tens of bytes for each of its bytes; repeated rows each count and are each answered; symbols of one count share alike, so ties need no rule; a row without doc_id is
held out; without training documents all symbols are alike; an empty table gives no rows; columns besides doc_id and text are
not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import fold, materialise, table
from ._text import LOWER, Words, blocks, mix
from .exchange import SENT, Work, answers_of, block_count, exchange, in_blocks, levels, runs, sums
from .exchange import table as table_of

ORDER = 5
END = 0xFF  # no byte of UTF-8
PAIRS = 1 << 16
_END_WORD = np.uint64(0x5851F42D4C957F2D)

WORDS, CONTEXTS = 0, 1
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_log double, score double"


def with_marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower-case bytes of a block with an end mark before the first and after every text, and the places of the marks."""
    ends = offsets[1:]
    n = len(data) + len(ends) + 1
    marks = np.concatenate(([0], ends + np.arange(1, len(ends) + 1)))
    out = np.full(n, END, np.uint8)
    keep = np.ones(n, bool)
    keep[marks] = False
    out[keep] = LOWER[data]
    return out, marks


def context_keys(data: np.ndarray, marks: np.ndarray, order: int) -> np.ndarray:
    """For every symbol after the first mark: the `order` bytes before it, the nearest one highest, and the symbol lowest.

    What lies before the mark that begins a text counts as marks.
    """
    n = len(data) - 1
    key = np.zeros(n, np.uint64)
    since = np.arange(n) - np.repeat(marks[:-1], np.diff(marks))  # bytes of the text before the symbol
    for k in range(order):
        byte = np.full(n, END, np.uint64)
        at = np.flatnonzero(since >= k)
        byte[at] = data[at - k]
        key |= byte << np.uint64(8 * (order - k))
    return key | data[1:].astype(np.uint64)


def pair_counts(docs: DataFrame) -> np.ndarray:
    """How often each symbol follows each byte in the documents; the row is the byte before. Summed by Spark."""

    def run(batches):
        for batch in batches:
            total = np.zeros(PAIRS, np.int64)
            for _, _, data, offsets in blocks(batch.column(0)):
                marked, _ = with_marks(data, offsets)
                if len(offsets) > 1:
                    total += np.bincount((marked[:-1].astype(np.int64) << 8) | marked[1:], minlength=PAIRS)
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["pair", "n"])

    out = np.zeros(PAIRS, np.int64)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    for pair, n in docs.select(text.alias("text")).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n")).collect():
        out[pair] = n
    return out.reshape(256, 256)


class Short:
    """Log10 probabilities after contexts of one byte and none, for symbols not seen after a longer one."""

    def __init__(self, pairs: np.ndarray):
        self.pairs = pairs
        self.single = pairs.sum(0)

    def root(self, unseen_after: np.ndarray) -> np.ndarray:
        """Of all symbols under the empty context where those of the mask no longer count."""
        left = np.where(unseen_after, self.single, 0)
        total, kinds = left.sum(), np.count_nonzero(left)
        out = np.full(256, -np.inf)
        seen = left > 0
        out[seen] = np.log10(left[seen] / (total + kinds))
        rest = self.single == 0
        if rest.any():
            out[rest] = (np.log10(kinds / (total + kinds)) if kinds else 0.0) - np.log10(rest.sum())
        return out

    def after(self, byte: int, seen_longer: np.ndarray) -> np.ndarray:
        """Of all symbols after this byte, without those of the mask, which were seen after the longer context."""
        left = np.where(seen_longer, 0, self.pairs[byte])
        total, kinds = left.sum(), np.count_nonzero(left)
        lower = self.root(self.pairs[byte] == 0) + (np.log10(kinds / (total + kinds)) if kinds else 0.0)
        out = lower.copy()
        seen = left > 0
        out[seen] = np.log10(left[seen] / (total + kinds))
        return out


def ppm(keys: np.ndarray, counts: np.ndarray, order: int, short: Short) -> np.ndarray:
    """Log10 probability of every key (sorted, distinct; all keys of their contexts' last two bytes are here); a count may be 0."""
    symbol = np.uint64(0xFF)
    out = np.zeros(len(keys))
    todo = np.arange(len(keys))  # keys whose symbol is yet to be found
    level_keys, level_counts = keys[counts > 0], counts[counts > 0]
    longer: np.ndarray | None = None  # keys of the level above
    for length in range(order, 1, -1):
        shift = np.uint64(8 * (order - length))
        if length < order:
            # one byte less of context: drop it from between the context and the symbol
            longer = level_keys
            level_keys, level_counts = sums(((level_keys >> np.uint64(16)) << np.uint64(8)) | (level_keys & symbol), level_counts)
        contexts = level_keys >> np.uint64(8)
        if len(contexts):
            first = np.flatnonzero(np.concatenate(([True], contexts[1:] != contexts[:-1])))
            totals, kinds = np.add.reduceat(level_counts, first), np.diff(np.append(first, len(contexts)))
            names = contexts[first]
        else:
            names, totals, kinds = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(todo):
            return out
        wanted = keys[todo]
        context = wanted >> (np.uint64(8) + shift)
        at = np.searchsorted(names, context)
        there = at < len(names)
        there[there] = names[at[there]] == context[there]
        total, kind = np.zeros(len(todo), np.int64), np.zeros(len(todo), np.int64)
        total[there], kind[there] = totals[at[there]], kinds[at[there]]
        if longer is not None and len(longer):
            # what was seen after the longer context counts no more
            up = longer >> np.uint64(8)
            head = np.flatnonzero(np.concatenate(([True], up[1:] != up[:-1])))
            same = ((longer >> np.uint64(16)) << np.uint64(8)) | (longer & symbol)
            gone = np.add.reduceat(level_counts[np.searchsorted(level_keys, same)], head)
            gone_kinds = np.diff(np.append(head, len(up)))
            mine = wanted >> shift  # context of the level above
            k = np.searchsorted(up[head], mine)
            ok = k < len(head)
            ok[ok] = up[head][k[ok]] == mine[ok]
            total[ok] -= gone[k[ok]]
            kind[ok] -= gone_kinds[k[ok]]
        full = (context << np.uint64(8)) | (wanted & symbol)
        k = np.searchsorted(level_keys, full)
        found = k < len(level_keys)
        found[found] = level_keys[k[found]] == full[found]
        out[todo[found]] += np.log10(level_counts[k[found]] / (total + kind)[found])
        escapes = ~found & (kind > 0)
        out[todo[escapes]] += np.log10((kind / np.maximum(1, total + kind))[escapes])
        todo = todo[~found]
    if len(todo):
        # by context of two bytes: the symbols seen after it are excluded from here on
        top = keys[todo] >> np.uint64(8 + 8 * (order - 2))
        for context in np.unique(top):
            a, b = np.searchsorted(level_keys >> np.uint64(8), [context, context + np.uint64(1)])
            seen = np.zeros(256, bool)
            seen[(level_keys[a:b] & symbol).astype(np.int64)] = True
            own = todo[top == context]
            out[own] += short.after(int(context >> np.uint64(8)), seen)[(keys[own] & symbol).astype(np.int64)]
    return out


def _work(order: int, short) -> Work:
    """Words are answered with their counts, keys of contexts with log probabilities. All contexts that end in the same two bytes have one owner."""

    def address(kind: int, keys: np.ndarray) -> np.ndarray:
        return mix(keys >> np.uint64(8 * (order - 1))) if kind == CONTEXTS else keys

    def reply(kind: int, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return ppm(keys, counts, order, short.value) if kind == CONTEXTS else counts

    return Work(reply, {WORDS: np.uint64, CONTEXTS: np.float32}, address)


class Block:
    """What a block of documents counts: sorted distinct words and context keys, and how often they occur in its training documents."""

    def __init__(self, docs: pa.Table, order: int, counted: bool):
        trained = ~np.array(docs.column("held_out").to_pylist(), bool)
        words, word_counts, keys, key_counts = [], [], [], []
        for a, b, data, offsets in blocks(docs.column("text")):
            w = Words(data, offsets, lower=True)
            marked, marks = with_marks(data, offsets)
            k = context_keys(marked, marks, order)
            for parts, numbers, values, own in (
                (words, word_counts, w.hash, trained[a:b][w.doc]),
                (keys, key_counts, k, np.repeat(trained[a:b], np.diff(marks))),
            ):
                every = runs(np.sort(values))
                parts.append(every[0])
                if counted:
                    mine = runs(np.sort(values[own]))
                    n = np.zeros(len(every[0]), np.int64)
                    n[np.searchsorted(every[0], mine[0])] = mine[1]
                    numbers.append(n)
                else:
                    numbers.append(every[1])
        n = docs.num_rows
        words.append(np.array([_END_WORD]))
        word_counts.append(np.array([trained.sum()]) if counted else np.array([n]))
        self.words, self.word_counts = sums(np.concatenate(words), np.concatenate(word_counts))
        self.keys, self.key_counts = sums(np.concatenate(keys), np.concatenate(key_counts)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _send(order: int, parts: int):
    work = _work(order, None)

    def run(docs: pa.Table) -> pa.Table:
        x, block = Block(docs, order, True), docs.column("block")[0].as_py()
        return table_of(work.messages(WORDS, x.words, x.word_counts, parts, block) + work.messages(CONTEXTS, x.keys, x.key_counts, parts, block), SENT)

    return run


class Lookup:
    """Values by key: most by one slot of a table, the others by search."""

    BITS = 20

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.held = np.zeros(1 << self.BITS, np.int64)
        self.held[self._slot(keys)] = np.arange(len(keys))

    def _slot(self, keys):
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.held[self._slot(keys)]
        wrong = np.flatnonzero(self.keys[at] != keys)
        at[wrong] = np.searchsorted(self.keys, keys[wrong])
        return self.values[at]


def _score(order: int, parts: int):
    names, work = [x.split()[0] for x in SCORED.split(", ")], _work(order, None)

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=names)
        x = Block(docs, order, False)
        counts, logs = (work.gathered(kind, keys, parts, answers_of(found, kind)) for kind, keys in ((WORDS, x.words), (CONTEXTS, x.keys)))
        of_word, of_key = Lookup(x.words, counts.astype(np.int64)), Lookup(x.keys, logs.astype(np.float64))
        end = int(of_word(np.array([_END_WORD]))[0])
        columns: list[list] = [[], [], [], []]
        for _, _, data, offsets in blocks(docs.column("text")):
            w = Words(data, offsets, lower=True)
            c = of_word(w.hash)
            marked, marks = with_marks(data, offsets)
            by_symbol = of_key(context_keys(marked, marks, order))
            columns[0].append(w.count + 1)
            for out, values, last in ((columns[1], (c > 0).astype(np.int64), int(end > 0)), (columns[2], np.log10(c + 0.5), np.log10(end + 0.5))):
                # a text without words has no run to add
                sums = np.zeros(len(w.count), values.dtype)
                some = np.flatnonzero(w.count)
                if len(some):
                    sums[some] = np.add.reduceat(values, w.first[some])
                out.append(sums + last)
            columns[3].append(np.add.reduceat(by_symbol, marks[:-1]))
        return pa.table([docs.column("doc_id"), docs.column("held_out"), *(pa.array(np.concatenate(c)) for c in columns)], names=names)

    return run


def score(docs: DataFrame, held_out, order: int = ORDER) -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score and score, both log10 probabilities.

    held_out: a boolean column of docs; where it is true (or null), a document teaches nothing.
    """
    spark = docs.sparkSession
    held_out = F.coalesce(held_out, F.lit(True))
    short = spark.sparkContext.broadcast(Short(pair_counts(docs.where(~held_out))))
    n = block_count(docs)
    parts = levels(n)[0]
    rows = in_blocks(docs, n, held_out.alias("held_out"))
    found, owned = exchange(rows.groupBy("block").applyInArrow(_send(order, parts), SENT), n, _work(order, short))
    if found is owned:
        found = owned = materialise(found)
    tokens, distinct = owned.where(F.col("kind") == WORDS).agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    scored = rows.groupBy("block").cogroup(found.select("kind", "part", "source", "answer").groupBy("source")).applyInArrow(_score(order, parts), SCORED)
    base = F.col("base_log") - F.col("n_tokens") * F.log10(F.lit(float(tokens) + 0.5 * (distinct + 1)))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), fold(F.col("doc_id")) == 1)
