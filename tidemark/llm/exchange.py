"""Blocks of documents, and packed messages between them and the owners of shares of all values.

Counting or matching something that occurs many times in every document (words, byte contexts, windows) as a row each would shuffle far more than the text. Here
documents are dealt by a hash of their place into blocks of a few megabytes; a block counts its distinct 64-bit values and sends them in packed messages, and gets an answer for each
of them, in the order in which it sent them. A block's messages follow from its rows alone, so both ends agree after any number of lost and repeated tasks.

A block sends `FAN` messages, one for each part of the values, whatever the number of blocks, so messages grow in proportion to the input. Parts hold a share of
addresses, by default of the values themselves, which are hashes. As long as a part is no more than `OWNED` blocks' worth it has one owner. Beyond, messages go up a
tree: those of FAN blocks for one part are merged into one list, in which each value is once, and that is cut into finer parts, until an owner's part is small enough; answers go
back down the same way. So no task holds more than a few blocks' worth, and a value that is hot in the corpus arrives FAN times at most.
"""

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialise, partitions
from ._text import pack, pack_sorted, unpack, unpack_sorted

BLOCK_BYTES = 8 << 20
FAN, OWNED = 64, 4

SENT = "kind int, part long, source long, keys binary, counts binary"
ANSWER = "kind int, part long, source long, answer binary, total long, distinct long"
_WIDTHS = {1: np.uint8, 4: np.uint32, 8: np.uint64}


def block_count(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """How many blocks of about block_bytes of text the documents make, and no fewer than the session's shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(partitions(docs.sparkSession), math.ceil(total / block_bytes))


def in_blocks(docs: DataFrame, n: int, *columns) -> DataFrame:
    """block, doc_id, text and the given columns, dealt by block. A null text is empty.

    Rows are dealt by their place in the files of their table, which repeated rows don't share and no lost task changes; rows of no files are written once.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *columns)
    place = ("_metadata.file_path", "_metadata.row_index")
    try:
        rows.select(*place)
    except AnalysisException:
        rows = materialise(rows)
    block = F.pmod(F.xxhash64(*place), F.lit(n)).cast("long")
    return rows.select(block.alias("block"), *rows.columns).repartition(n, "block")


def _own_address(kind: int, keys: np.ndarray) -> np.ndarray:
    return keys


def sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


@dataclass(frozen=True)
class Work:
    """reply: from kind, sorted distinct keys and counts, an answer for each key, of the kind's type in answers. address: from kind and keys, where keys go.

    merge: from keys and counts of several lists, the distinct keys and what their counts come to. echo: if given, a source gets back not its answers but those of its keys
    for which echo is true of its own counts and the answers.
    """

    reply: Callable
    answers: dict
    address: Callable = _own_address
    merge: Callable = sums
    echo: Callable | None = None

    def merged(self, inbox: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        return self.merge(np.concatenate([k for _, k, _ in inbox]), np.concatenate([c.astype(np.int64) for _, _, c in inbox]))

    def returned(self, inbox: list, keys: np.ndarray, reply: np.ndarray, first: bool) -> list[tuple[int, bytes]]:
        """(source, what it gets back). first: sources are blocks."""
        out = []
        for source, own, counts in inbox:
            answer = reply[np.searchsorted(keys, own)]
            out.append((source, pack_sorted(own[self.echo(counts, answer)]) if self.echo and first else pack(answer)))
        return out

    def cut(self, kind: int, keys: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
        """(part, places of its keys in rising order) of every part that has keys. A part of m times as many parts lies within one of these."""
        part = ((self.address(kind, keys) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
        part = part[order]
        if not len(part):
            return []
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        return [(int(part[a]), order[a:b]) for a, b in zip(first, [*first[1:], len(part)], strict=True)]

    def messages(self, kind: int, keys: np.ndarray, counts: np.ndarray, parts: int, source: int) -> list[tuple]:
        """Rows of SENT."""
        width = next(w for size, w in _WIDTHS.items() if size == 8 or not len(counts) or int(counts.max()) < 1 << (8 * size))
        return [(kind, part, source, pack_sorted(keys[at]), pack(counts[at].astype(width))) for part, at in self.cut(kind, keys, parts)]

    def gathered(self, kind: int, keys: np.ndarray, parts: int, found: dict) -> np.ndarray:
        """The answers for the keys, from those by part."""
        out = np.zeros(len(keys), self.answers[kind])
        for part, at in self.cut(kind, keys, parts):
            out[at] = unpack(found[part], self.answers[kind])
        return out


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array and how often each occurs."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[first], np.diff(np.append(first, len(values)))


def table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    columns = [x.split() for x in schema.split(", ")]
    data = zip(*rows, strict=True) if rows else [()] * len(columns)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(data, columns, strict=True)], names=[n for n, _ in columns])


def answers_of(found: pa.Table, kind: int) -> dict[int, bytes]:
    """By part, the answers of a kind that have come for one source."""
    if not found.num_rows:
        return {}
    return {p: a for k, p, a in zip(*(found.column(c).to_pylist() for c in ("kind", "part", "answer")), strict=True) if k == kind}


def echoed(found: pa.Table) -> np.ndarray:
    """All keys that have come back to one source, sorted."""
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *(unpack_sorted(x, np.uint64) for x in answers_of(found, 0).values())]))


def levels(n: int, fan: int | None = None, owned: int | None = None) -> list[int]:
    """The number of parts on each level of the tree over n blocks."""
    fan, owned = fan or FAN, owned or OWNED
    out = [fan]
    while out[-1] * owned < n:
        out.append(out[-1] * fan)
    return out


def _inbox(sent: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray]]:
    out = []
    for source, keys, counts in zip(*(sent.column(c).to_pylist() for c in ("source", "keys", "counts")), strict=True):
        k = unpack_sorted(keys, np.uint64)
        out.append((source, k, unpack(counts, _WIDTHS[len(counts) // len(k)])))
    return out


def _up(work: Work, parts: int):
    def run(sent: pa.Table) -> pa.Table:
        kind, parent = sent.column("kind")[0].as_py(), sent.column("parent")[0].as_py()
        return table(work.messages(kind, *work.merged(_inbox(sent)), parts, parent), SENT)

    return run


def _answer(work: Work, first: bool):
    def run(sent: pa.Table) -> pa.Table:
        kind, part = sent.column("kind")[0].as_py(), sent.column("part")[0].as_py()
        inbox = _inbox(sent)
        keys, counts = work.merged(inbox)
        reply = work.reply(kind, keys, counts).astype(work.answers[kind])
        total = [(int(counts.sum()), int(np.count_nonzero(counts)))] + [(0, 0)] * len(inbox)
        return table([(kind, part, *back, *t) for back, t in zip(work.returned(inbox, keys, reply, first), total, strict=False)], ANSWER)

    return run


def _down(work: Work, parts: int, first: bool):
    def run(sent: pa.Table, found: pa.Table) -> pa.Table:
        if not sent.num_rows:
            return table([], ANSWER)
        kind, part = sent.column("kind")[0].as_py(), sent.column("part")[0].as_py()
        inbox = _inbox(sent)
        keys, _ = work.merged(inbox)
        reply = work.gathered(kind, keys, parts, answers_of(found, kind))
        return table([(kind, part, *back, 0, 0) for back in work.returned(inbox, keys, reply, first)], ANSWER)

    return run


def exchange(sent: DataFrame, n: int, work: Work) -> tuple[DataFrame, DataFrame]:
    """ANSWER rows for every message (SENT) of n blocks, and those of the owners, whose sums of total and distinct are those of all blocks together."""
    parts = levels(n)
    parent = lambda df: df.withColumn("parent", F.expr(f"source div {FAN}")).groupBy("kind", "part", "parent")
    sent_at = [sent]
    for finer in parts[1:]:
        # read again on the way down
        sent_at[-1] = materialise(sent_at[-1])
        sent_at.append(parent(sent_at[-1]).applyInArrow(_up(work, finer), SENT))
    owned = found = sent_at[-1].groupBy("kind", "part").applyInArrow(_answer(work, len(parts) == 1), ANSWER)
    if len(parts) > 1:
        owned = found = materialise(found)
    for k in reversed(range(len(parts) - 1)):
        children, coarse, finer = sent_at[k], parts[k], parts[k + 1]
        upper = found.withColumn("upper", F.expr(f"part div {finer // coarse}")).groupBy("kind", "upper", "source")
        found = parent(children).cogroup(upper).applyInArrow(_down(work, finer, k == 0), ANSWER)
    return found, owned
