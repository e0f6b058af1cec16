"""Periodic runs of words: maximal stretches that repeat a period four times or more, and texts in which each is cut down to one period.

For a batch of documents at a time, all in numpy:

1. Suffix array by prefix doubling, which sorts again only what is still tied; no suffix is compared with one of another document. The ranks of each doubling tell
   the common length of any two places, forwards and backwards.
2. LCP of neighbours in the suffix array; with the nearest ones that stand earlier in the text, by doubling over minima, they give the longest previous factor (LPF) of every
   place and where it stands.
3. LZ blocks: each is the LPF of its first word, or a word that is new.
4. Main's extensions: a run that ends in a block and doesn't lie strictly within it has a boundary of the block in it or at one of its ends, and a period bounded by the
   lengths of this block and the one before (see `_reach`); from each boundary, every such period is extended to both sides.
5. Other runs lie strictly within a block, so they are copies of runs where its words stood before: taken over block by block from the sorted list of starts.

Steps 4 and 5 take time in proportion to the text and the runs. Words are compared as they are, through a dictionary for each batch.

Defined results: a null or empty text has no words and no runs; a row without doc_id is taken as it stands; equally long runs: the one that starts first, then the shortest period; repeated rows are answered one by one;
a very long text is held by one task, with some four bytes a word for each doubling of its longest repeat and its length; an empty table gives no rows; columns besides doc_id and text are not read.
"""

import hashlib
from bisect import bisect_right, insort
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import fold, release, sliced, table

#: A run's periods and its words, at least.
EXPONENT, LENGTH = 4, 6

FOUND = "n_runs long, start long, length long, period long, exponent_milli long, runs string, collapsed string"


class Suffixes:
    """Ranks of all places of several texts after each doubling, and the suffix array. codes: one number for each word; owner: of each word, the number of its text, which does not fall."""

    def __init__(self, codes: np.ndarray, owner: np.ndarray):
        n = self.n = len(codes)
        self.owner = owner
        self.ends = np.searchsorted(owner, owner, "right").astype(np.int32) if n else np.empty(0, np.int32)  # of the text of each place
        order = np.lexsort((codes, owner))
        new = np.ones(n, bool)
        new[1:] = (np.diff(codes[order]) != 0) | (np.diff(owner[order]) != 0)
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # where its group begins in the order
        self.ranks, size = [rank], 1
        tied = self._tied(order, new)
        while len(tied):
            rank = rank.copy()
            at = order[tied]
            after = np.where(at + size < self.ends[at], rank[np.minimum(at + size, n - 1)], -1)
            group = rank[at]
            by = np.lexsort((after, group))
            at, after, group = at[by], after[by], group[by]
            order[tied] = at
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(group) != 0) | (np.diff(after) != 0)
            rank[at] = tied[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            self.ranks.append(rank)
            size *= 2
            tied = tied[self._tied(np.arange(len(at)), new)]
        self.order = order.astype(np.int32)

    @staticmethod
    def _tied(order: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Places in the order whose group has others."""
        alone = new.copy()
        alone[:-1] &= new[1:]
        return np.flatnonzero(~alone)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on are those from j on; both in one text, and i != j."""
        i, j, n = i.astype(np.int64), j.astype(np.int64), self.n
        end, out = self.ends[i], np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            x, y = i + out, j + out
            inside = np.maximum(x, y) + (1 << k) <= end
            out += np.where(inside & (self.ranks[k][np.minimum(x, n - 1)] == self.ranks[k][np.minimum(y, n - 1)]), 1 << k, 0)
        return out

    def back(self, i: np.ndarray, j: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """How many words up to i, and i itself, are those up to j; begin: where their text begins, at most i + 1."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            x, y = i - out - (1 << k) + 1, j - out - (1 << k) + 1
            inside = np.minimum(x, y) >= begin
            out += np.where(inside & (self.ranks[k][np.maximum(x, 0)] == self.ranks[k][np.maximum(y, 0)]), 1 << k, 0)
        return out


def _earlier(order: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in the suffix array, the nearest ones before and after it whose suffixes start earlier in the same text; -1 if there is none."""
    n = len(order)
    most = int(np.bincount(owner).max()) if n else 0
    out = []
    for turned in (False, True):
        start = order[::-1] if turned else order
        text = owner[start]
        least = [start]  # of 2**k places up to each
        while (2 << len(least) - 1) <= most:
            last, size = least[-1], 1 << len(least) - 1
            least.append(np.minimum(last, np.concatenate([last[:size], last[:-size]])))
        at = np.arange(n)
        for k in range(len(least) - 1, -1, -1):  # over all that start later
            to = at - 1
            ok = to - (1 << k) >= -1
            ok &= least[k][np.maximum(to, 0)] > start
            at = np.where(ok, at - (1 << k), at)
        at -= 1
        at[(at >= 0) & (text[np.maximum(at, 0)] != text)] = -1
        out.append(np.where(at[::-1] >= 0, n - 1 - at[::-1], -1) if turned else at)
    return out[0], out[1]


def longest_previous(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """For each place the length of the longest stretch that also starts earlier in its text, and where it does."""
    n = s.n
    length, where = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    # a suffix of its own first word stands nowhere else
    lcp = np.zeros(n + 1, np.int64)
    if n:
        pairs = 1 + np.flatnonzero(s.ranks[0][s.order[1:]] == s.ranks[0][s.order[:-1]])
        lcp[pairs] = s.ahead(s.order[pairs], s.order[pairs - 1])
    for found in _earlier(s.order, s.owner):
        # neighbours in the suffix array have their LCP at hand; the others have their least on the way, which is their own common length
        at = np.flatnonzero(found >= 0)
        at = at[(lcp[at] > 0) | (lcp[at + 1] > 0)]
        to = found[at]
        near = np.abs(to - at) == 1
        common = np.where(near, lcp[np.maximum(to, at)], 0)
        far = np.flatnonzero(~near)
        common[far] = s.ahead(s.order[at[far]], s.order[to[far]])
        place = s.order[at]
        better = common > length[place]
        length[place[better]], where[place[better]] = common[better], s.order[to[better]]
    return length, where


def blocks(length: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Starts of the LZ blocks of one text, and its end."""
    out, at, lengths = [], begin, length[begin:end].tolist()
    while at < end:
        out.append(at)
        at += lengths[at - begin] or 1
    out.append(end)
    return np.array(out)


def _reach(before: np.ndarray, size: np.ndarray, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """The longest periods to try at a boundary between blocks of these sizes, for runs that have half of their periods at least to its right, and to its left.

    Let a run of period p end in a block of m words that begins at the boundary. To the right of it are at most m words. The block before, of l words, is the longest stretch that stood before:
    so the run begins after p words before it, has less than l + m + p words, and exponent * p of them. A run that ends at the boundary and begins within the block before it has l words at most.
    """
    return 2 * size // exponent, np.maximum((before + size) // (exponent - 1), before // exponent)


def _pairs(at: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place with the periods from 1 to its most."""
    which = np.repeat(np.arange(len(at)), most)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(most) - most, most) + 1


def all_runs(s: Suffixes, exponent: int = EXPONENT, least: int = LENGTH) -> dict[int, list[tuple[int, int, int]]]:
    """Start, length and period of all runs of each text that has any, by start and period; places count from the first text's first word."""
    if not s.n:
        return {}
    length, where = longest_previous(s)
    texts, first = np.unique(s.owner, return_index=True)
    ends = np.append(first[1:], s.n)
    repeated = np.unique(s.owner[length > 0])
    at, before, size, begins, owners, cuts = [], [], [], [], [], {}
    for k in np.flatnonzero(np.isin(texts, repeated)):
        cut = blocks(length, first[k], ends[k])
        cuts[int(texts[k])] = cut
        sizes = np.append(np.diff(cut), 0)
        at.append(cut)
        size.append(sizes)
        before.append(np.append(0, sizes[:-1]))
        begins.append(np.full(len(cut), first[k]))
        owners.append(np.full(len(cut), texts[k]))
    if not at:
        return {}
    at, before, size, begins, owners = map(np.concatenate, (at, before, size, begins, owners))
    end = ends[np.searchsorted(texts, owners)]
    right, left = _reach(before, size, exponent)
    found: dict[int, dict[tuple[int, int], int]] = defaultdict(dict)
    for most, shift in ((right, 0), (left, -1)):
        most = np.minimum(most, np.where(shift == 0, end - at, at - begins))
        for which, p in _parts(at, most):
            a = at[which] + shift * p  # the two places that a period keeps apart: a and a + p
            ahead = np.zeros(len(a), np.int64)
            ok = a + p < end[which]
            ahead[ok] = s.ahead(a[ok], (a + p)[ok])
            back = s.back(a - 1, a + p - 1, begins[which])
            total = back + ahead + p
            for i in np.flatnonzero((total >= exponent * p) & (total >= least)):
                key, own = (int(a[i] - back[i]), int(total[i])), found[int(owners[which[i]])]
                own[key] = min(own.get(key, s.n), int(p[i]))
    return {t: _copied(own, cuts[t], length, where, least) for t, own in found.items()}


def _parts(at: np.ndarray, most: np.ndarray, size: int = 1 << 18):
    """_pairs of some places at a time, so that what is computed on stays small."""
    some = np.flatnonzero(most > 0)
    sums = np.cumsum(most[some])
    begin = 0
    while begin < len(some):
        stop = max(begin + 1, int(np.searchsorted(sums, (sums[begin - 1] if begin else 0) + size, "right")))
        which, p = _pairs(at[some[begin:stop]], most[some[begin:stop]])
        yield some[begin:stop][which], p
        begin = stop


def _copied(own: dict, cut: np.ndarray, length: np.ndarray, where: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The runs with copies of those that lie strictly within an earlier place of a block."""
    runs = sorted((start, size, p) for (start, size), p in own.items())
    for begin, end in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if end - begin < least + 2 or not length[begin]:
            continue
        source = int(where[begin])
        shift, stop = begin - source, source + end - begin
        k = bisect_right(runs, (source, 1 << 62, 0))
        while k < len(runs) and runs[k][0] < stop:
            start, size, p = runs[k]
            if start + size < stop:
                insort(runs, (start + shift, size, p))  # behind this one; a block that overlaps its source copies it again
            k += 1
    return sorted(runs, key=lambda r: (r[0], r[2]))


def reworked(n: int, mark: int) -> np.ndarray | None:
    """Which word stands in each of n places of a document with this hash, by the contract's rule; None for the words as they are."""
    if mark % 10 or not n:
        return None
    g = mark // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def periodic(texts, marks=None, exponent: int = EXPONENT, least: int = LENGTH) -> list[tuple]:
    """For each text (bytes or None) the values of FOUND. marks: a hash for each text that is to be reworked by it first; None leaves a text as it is."""
    numbers = defaultdict(count().__next__)
    words, codes = [], []
    for i, text in enumerate(texts):
        own = (text or b"").split()  # at ASCII white space, as the contract has it
        at = reworked(len(own), marks[i]) if marks is not None and marks[i] is not None else None
        code = np.fromiter(map(numbers.__getitem__, own), np.int32, len(own))
        words.append([own[k] for k in at] if at is not None else own)
        codes.append(code[at] if at is not None else code)
    sizes = np.array([len(c) for c in codes], np.int64)
    first = np.cumsum(sizes) - sizes
    s = Suffixes(np.concatenate(codes) if codes else np.empty(0, np.int32), np.repeat(np.arange(len(codes), dtype=np.int32), sizes))
    runs, out = all_runs(s, exponent, least), []
    for i, own in enumerate(words):
        found = [(a - int(first[i]), size, p) for a, size, p in runs.get(i, ())]
        gone = np.zeros(len(own) + 1, np.int64)
        for a, size, p in found:
            gone[a + p] += 1
            gone[a + size] -= 1
        kept = own if not found else [w for w, g in zip(own, np.cumsum(gone), strict=False) if not g]
        a, size, p = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None,) * 3
        out.append((len(found), a, size, p, 1000 * size // p if found else None, "".join(f"{a},{n},{q}\n" for a, n, q in found), b" ".join(kept)))
    return out


def collapse(docs: DataFrame, exponent: int = EXPONENT, least: int = LENGTH, rework: bool = False) -> DataFrame:
    """doc_id, the runs of each row's text (FOUND: their number, the longest one, all of them a line each) and the text without what a run repeats.

    rework: first plant repeats by the hash of doc_id, as the query's contract asks.
    """

    def run(texts: pa.Array, marks: pa.Array) -> pa.Array:
        rows, at = [], 0
        for part in sliced([texts]):
            rows += periodic([t and t.encode("utf-8", "replace") for t in part.to_pylist()], marks[at : at + len(part)].to_pylist(), exponent, least)
            at += len(part)
        release()
        kinds = (*[pa.int64()] * 5, pa.string(), pa.binary())
        columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
        columns[-1] = columns[-1].cast(pa.string())
        return pa.StructArray.from_arrays(columns, names=[c.split()[0] for c in FOUND.split(", ")])

    mark = fold(F.col("doc_id"), 1 << 32) if rework else F.lit(None).cast("long")
    found = F.arrow_udf(run, FOUND).asNondeterministic()  # so that no filter on the result has it computed twice
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), found(F.col("text").cast("string"), mark).alias("found")).select("doc_id", "found.*")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return collapse(table(spark, sf_dir, "documents"), rework=True).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", digest("runs"), digest("collapsed"))
