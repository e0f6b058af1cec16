"""Order-preserving packing of token streams by dynamic programming.

The documents of a partition, in the order of the table, form one stream of tokens. The stream is cut into sequences of at most `window`
tokens. Cuts may lie at document ends (free), at sentence ends (`SENTENCE` tokens of penalty) and, so that every stream has a solution,
in every run of `STRIDE` tokens without such an end (`ANYWHERE`). With p the position and w the penalty of a boundary,

    cost[j] = w[j] + SEQUENCE + min over boundaries i with p[j] - p[i] <= window of cost[i] + padding(p[j] - p[i])

where padding(n) = window - n, and 0 where n is a power of two; SEQUENCE is what a sequence costs by itself, so the stream is not
chopped for the sake of padding alone. The first kind of transition has its minimum of cost[i] + p[i] in a sliding window, which a monotone
queue gives in constant time; the second kind looks up the boundaries that lie a power of two back.

The stream runs on over Arrow batches, whose size changes no result: as soon as `BLOCK` tokens wait, they are cut, all sequences but
those in the last two windows are given out, and the tokens of these wait for more. So memory is bounded by the block and the longest document, and only the end of
a partition can leave a short sequence. A sequence's id is (partition << 36) + a count, and offsets in it have no gaps.
Nothing is shuffled; a lost task is repeated over the same split and gives the same rows.

Defined results: a null or empty text is the end id alone; repeated rows are each packed; a row without doc_id is packed too;
a very long text is one document in as many pieces as it needs, and is held whole by its task with four bytes a token; of equally cheap cuttings the earliest
boundaries win; an empty table gives no rows; columns besides doc_id and text are not read. A document cut in n places gives n + 1 pieces.
"""

import functools
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import kept, released, sliced, table
from ._text import Words, blocks

WINDOW, END, BLOCK = 4096, 2, 1 << 18
SENTENCE, ANYWHERE, STRIDE, SEQUENCE = 8.0, 48.0, 32, 64.0
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LETTER, MARK = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(0x61, 0x7B), *range(0x41, 0x5B)]] = True
#: ASCII characters that never share a token with a letter; an apostrophe may.
MARK[[ord(c) for c in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]] = True
#: Letters under this code point are letters in every version of Unicode that is in use.
OLD_LETTERS = 0x500

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: its own where it is printable, else the next one over U+00FF."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b if b in shown else next(rest)) for b in range(256)}


class WordMemory:
    """Ids of words by their hashes, in arrays of a fixed size: a word takes the one slot that its hash names, from whatever word has it.

    2**BITS slots of 24 bytes. Words of over MOST ids are not remembered.
    """

    BITS, MOST = 20, 7

    def __init__(self):
        self.hash = np.zeros(1 << self.BITS, np.uint64)
        self.row = np.zeros((1 << self.BITS, 1 + self.MOST), np.uint16)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.BITS)).astype(np.int64)

    def put(self, hashes: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> None:
        first = np.cumsum(lengths) - lengths
        short = np.flatnonzero(lengths <= self.MOST)
        at = self.slots(hashes[short])
        # of several words with one slot the last one stays
        _, last = np.unique(at[::-1], return_index=True)
        short = short[len(short) - 1 - last]
        at = self.slots(hashes[short])
        rows = np.zeros((len(short), 1 + self.MOST), np.uint16)
        rows[:, 0] = lengths[short]
        for k in range(self.MOST):
            more = np.flatnonzero(lengths[short] > k)
            rows[more, 1 + k] = flat[first[short[more]] + k]
        self.row[at], self.hash[at] = rows, hashes[short]


def _spread(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (lengths[0] of them), first[1], ..."""
    begin = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(first - begin, lengths)


class WordTokenizer:
    """Ids of whole texts by ids of their words.

    The vocabulary's pre-tokenizer never joins characters over white space, and its normaliser works on each character but for composition, which white space
    stops too; so a text's ids are its words' ids in a row. A word of lower-case letters alone is one unit of the pre-tokenizer, so the vocabulary's merges give
    its ids at once. A text that may hold a special token, which is matched before normalising, is encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.characters = self.tokenizer.model, _byte_characters()
        self.small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.memory = WordMemory()
        stops = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in (".", "!", "?")]
        self.stops = np.array(sorted({x[0] for x in stops if len(x) == 1}), np.uint32)

    def _new(self, w: Words, at: np.ndarray) -> list[list[int]]:
        """The ids of the words numbered at."""
        raw = w.data.tobytes()
        shown = raw.decode("latin-1")
        other = np.concatenate(([0], np.cumsum(~LETTER[w.data])))
        letters = (other[w.end[at]] == other[w.start[at]]).tolist()
        out, rest = [], []
        for a, b, plain in zip(w.start[at].tolist(), w.end[at].tolist(), letters, strict=True):
            if plain:
                out.append([t.id for t in self.model.tokenize(shown[a:b])])
                continue
            word = raw[a:b].decode("utf-8", "replace")
            if word.isalpha() and ord(max(word)) < OLD_LETTERS and word == word.lower() and unicodedata.is_normalized("NFC", word):
                out.append([t.id for t in self.model.tokenize(shown[a:b].translate(self.characters))])
            else:
                rest.append((len(out), word))
                out.append([])
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            for (k, _), e in zip(part, self.tokenizer.encode_batch_fast([x for _, x in part], add_special_tokens=False), strict=True):
                out[k] = e.ids
        return out

    @staticmethod
    def _spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes with a space between every letter and mark, which changes no id and lets more words be alike."""
        mark, letter = MARK[data], LETTER[data]
        between = np.zeros(len(data), bool)
        between[1:] = (mark[1:] & letter[:-1]) | (letter[1:] & mark[:-1])
        at = np.flatnonzero(between)
        if not len(at):
            return data, offsets
        out = np.full(len(data) + len(at), 0x20, np.uint8)
        keep = np.ones(len(out), bool)
        keep[at + np.arange(len(at))] = False
        out[keep] = data
        return out, offsets + np.searchsorted(at, offsets, "left")

    def encode(self, column):
        """The ids of each text of a string array."""
        for _, _, data, offsets in blocks(column):
            raw = data.tobytes()
            whole = {}
            if b"<|" in raw:
                for k in range(len(offsets) - 1):
                    text = raw[offsets[k] : offsets[k + 1]]
                    if b"<|" in text:
                        whole[k] = np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
            w = Words(*self._spaced(data, offsets), lower=True)
            ids, lengths = self._ids(w)
            total = np.concatenate(([0], np.cumsum(lengths)))[w.first]
            for k in range(len(offsets) - 1):
                yield whole[k] if k in whole else ids[total[k] : total[k + 1]]

    def _ids(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has."""
        slot = self.memory.slots(w.hash)
        known = self.memory.hash[slot] == w.hash
        if not self.small:
            known[:] = False
        new = np.flatnonzero(~known)
        lengths = np.empty(len(slot), np.int64)
        lengths[known] = self.memory.row[slot[known], 0]
        hashes, at, which = np.unique(w.hash[new], return_index=True, return_inverse=True)
        found = self._new(w, new[at])
        sizes = np.array([len(x) for x in found], np.int64)
        flat = np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum()))
        lengths[new] = sizes[which]
        out = np.empty(int(lengths.sum()), np.uint32)
        first = np.cumsum(lengths) - lengths
        old = np.flatnonzero(known)
        width = self.memory.row.shape[1]
        out[_spread(first[old], lengths[old])] = self.memory.row.ravel()[_spread(slot[old] * width + 1, lengths[old])]
        out[_spread(first[new], lengths[new])] = flat[_spread((np.cumsum(sizes) - sizes)[which], lengths[new])]
        if self.small and len(hashes):
            self.memory.put(hashes, sizes, flat)
        return out, lengths


@functools.lru_cache(1)
def tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker, as long as it packs: with its memory of words it takes some 60 MB, however much text has come."""
    return WordTokenizer(path)


kept(tokenizer.cache_clear)


def _powers_back(positions: np.ndarray, window: int) -> tuple[list[int], list[int]]:
    """Of each boundary, the boundaries that lie a power of two before it: those of j are the second list from first[j] to first[j + 1]."""
    found, by = [], []
    place = np.full(int(positions[-1]) + 1, -1, np.int32)
    place[positions] = np.arange(len(positions))
    for k in range(window.bit_length()):
        size = 1 << k
        if size <= window:
            later = int(np.searchsorted(positions, size))
            i = place[positions[later:] - size]
            j = np.flatnonzero(i >= 0)
            by.append(j + later)
            found.append(i[j])
    by, found = np.concatenate(by), np.concatenate(found)
    order = np.argsort(by, kind="stable")
    return np.searchsorted(by[order], np.arange(len(positions) + 1)).tolist(), found[order].tolist()


def cuts(positions: np.ndarray, penalties: np.ndarray, window: int, each: float = 0.0) -> list[int]:
    """Indices of the boundaries where the cheapest cutting cuts; positions[0] = 0, and the last one is always cut.

    each: what a sequence costs by itself. Neighbouring boundaries must lie within `window` of each other.
    """
    p, w = positions.tolist(), penalties.tolist()
    n = len(p)
    cost, back = [0.0] * n, [0] * n
    queue, head = [0], 0  # of indices, cost + position rising
    keys = [0.0] * n
    first, of = _powers_back(positions, window)
    for j in range(1, n):
        pos = p[j]
        while pos - p[queue[head]] > window:
            head += 1
        i = queue[head]
        best, by = keys[i] + window - pos, i
        for i in of[first[j] : first[j + 1]]:
            if cost[i] < best:
                best, by = cost[i], i
        best += w[j] + each
        cost[j], back[j] = best, by
        key = keys[j] = best + pos
        while len(queue) > head and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    out, j = [], n - 1
    while j:
        out.append(j)
        j = back[j]
    return out[::-1]


def boundaries(stream: np.ndarray, ends: np.ndarray, stops: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and penalties of the places where a stream may be cut. ends: of its documents."""
    stride = max(1, min(STRIDE, window // 2))
    penalty = np.full(len(stream) + 1, np.inf)
    penalty[1:][np.isin(stream, stops)] = SENTENCE
    penalty[ends] = 0
    penalty[[0, -1]] = 0
    natural = np.zeros(len(stream) // stride + 1, bool)
    natural[np.flatnonzero(np.isfinite(penalty)) // stride] = True
    penalty[np.flatnonzero(~natural) * stride] = ANYWHERE
    at = np.flatnonzero(np.isfinite(penalty))
    return at, penalty[at]


class Stream:
    """What waits to be cut: (doc_id, place of the first waiting token, tokens of the document, waiting ids) of each document."""

    def __init__(self, stops: np.ndarray, window: int, first: int):
        self.stops, self.window, self.sequence = stops, window, first
        self.waiting: list[tuple] = []
        self.size = 0

    def add(self, name, ids: np.ndarray) -> None:
        self.waiting.append((name, 0, len(ids), ids))
        self.size += len(ids)

    def cut(self, last: bool):
        """The rows of SCHEMA of all sequences but the last ones, which are only given out at the end of the stream."""
        if not self.waiting:
            return
        stream = np.concatenate([x[3] for x in self.waiting])
        own_ends = np.cumsum([len(x[3]) for x in self.waiting])
        at, penalty = boundaries(stream, own_ends, self.stops, self.window)
        ends = at[cuts(at, penalty, self.window, SEQUENCE)].tolist()
        if not last:
            # what the stream's present end has forced waits too
            ends = [e for e in ends[:-1] if e <= len(stream) - 2 * self.window]
        stop = ends[-1] if ends else 0
        position = k = begun = 0
        rest = []
        for name, start, total, ids in self.waiting:
            done = 0
            while done < len(ids) and position < stop:
                while ends[k] <= position:
                    begun = ends[k]
                    k += 1
                n = min(len(ids) - done, ends[k] - position)
                yield name, start + done, n, ids[done : done + n].tobytes(), total, self.sequence + k, position - begun
                position += n
                done += n
            if done < len(ids):
                rest.append((name, start + done, total, ids[done:].copy()))
        self.waiting, self.size, self.sequence = rest, len(stream) - stop, self.sequence + len(ends)


def pack(docs: DataFrame, window: int = WINDOW, tokenizer_path: str = TOKENIZER, end_id: int = END, block: int = BLOCK) -> DataFrame:
    """The pieces of all documents with their ids as little-endian unsigned 32-bit integers; see SCHEMA."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in names])

    def rows_of(rows):
        rows = list(rows)
        for i in range(0, len(rows), 4096):
            yield pa.record_batch([pa.array(c, k.type) for c, k in zip(zip(*rows[i : i + 4096], strict=True), kinds, strict=True)], schema=kinds)

    def run(batches):
        tok = tokenizer(tokenizer_path)
        stream = Stream(tok.stops, window, TaskContext.get().partitionId() << 36)
        for batch in sliced(batches):
            for doc, ids in zip(batch.column(0).to_pylist(), tok.encode(batch.column(1)), strict=True):
                stream.add(doc, np.append(ids, np.uint32(end_id)))
                if stream.size >= block:
                    yield from rows_of(stream.cut(last=False))
        yield from rows_of(stream.cut(last=True))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(released(run), SCHEMA)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length and ids of every sequence, put together from its pieces."""
    part = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), part.alias("parts")).select(
        "sequence_id", "length", F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids")
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
