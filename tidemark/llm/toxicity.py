"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and word beginnings is trained with numpy from confirmed toxic documents (positive) and documents taken as they come
(unlabelled, among which are toxic ones). With the class prior p, the positives' risk and both groups' risk of being
called negative, the risk is

    p R_p(+) + max(0, R_u(-) - p R_p(-))

where the second term estimates the negatives' risk; where a batch takes it below zero, the step goes against it
instead, so the classifier can't gain by fitting single unlabelled documents.

Which words tell is judged by documents that aren't near copies of each other, since the words of one text that was copied often would all seem to tell. Margins enter
the risk as BOUND * tanh(margin / BOUND): in both groups, documents with many telling words cancel out but for the noise of sampling, which would outweigh
documents with a few. Batches are large for the same reason: in small ones the negatives' risk is below zero by chance every other time.

The classifier is fitted on a bounded sample: the `POSITIVES` confirmed and `UNLABELLED` other rows with the smallest hashes of
their ids, as far as `SAMPLE_BYTES` of text in each group, whatever the length of a single text. The prior is the share of toxic rows among all labelled ones that may be used.
A model has 2**`BITS` weights, whatever the corpus, and is sent to all tasks; every whole text is scored by its
distinct words and word beginnings.

Defined results: a null or empty text gets the score of no words; a very long text has the score of all its words and is held by one task, a few bytes for each of its bytes; repeated rows are each answered; a score of 0.5 is predicted toxic; of sampled rows with one id hash, those with the smaller id and text hash come first; a row without doc_id is held
out and scored; without usable positives every score is the prior; several labels of a document count as toxic if one does; an empty table
gives no rows; columns besides doc_id and text, or doc_id and toxic, are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import answered, fold, released, sliced, table, within
from ._text import ALNUM, Words, blocks, mix

BITS = 18
POSITIVES, UNLABELLED, SAMPLE_BYTES = 3000, 9000, 64 << 20
#: Bytes of the word beginnings that are features.
HEADS = (4, 5, 6)
#: A feature counts if so many sampled documents have it, and if its shares in the two groups differ by so many standard errors.
LEAST_DOCS, TELLING = 4, 4.0
#: A text's sketch are the least of SKETCH hashes of its features. Texts with BAND of them alike in one place are near copies if ALIKE of all are.
SKETCH, BAND, ALIKE = 16, 4, 12
_SALTS = mix(np.arange(1, SKETCH + 1, dtype=np.uint64)) | np.uint64(1)
#: Margins further from 0 than this hardly count for more in the risk; unlabelled documents in a batch; steps of the descent.
BOUND, BATCH, STEPS = 6.0, 3000, 400


def features(column):
    """The distinct hashed words and word beginnings of each text; beginnings are what inflected words share."""
    for _, _, data, offsets in blocks(column):
        w = Words(data, offsets, ALNUM, lower=True)
        doc = w.doc.astype(np.int64) << BITS
        pair = np.sort(np.concatenate([doc | (h >> np.uint64(64 - BITS)).astype(np.int64) for h in (w.hash, *map(w.heads, HEADS))]))
        pair = pair[np.concatenate(([True], pair[1:] != pair[:-1]))] if len(pair) else pair
        first = np.searchsorted(pair, np.arange(len(w.count) + 1, dtype=np.int64) << BITS)
        for a, b in zip(first, first[1:], strict=False):
            yield pair[a:b] & ((1 << BITS) - 1)


def sketch(row: np.ndarray) -> np.ndarray:
    """The least of each of SKETCH hashes over a text's features."""
    h = mix(row.astype(np.uint64) + np.uint64(1))
    return np.array([(h * salt).min(initial=np.iinfo(np.uint64).max) for salt in _SALTS], np.uint64)


def firsts(sketches: np.ndarray) -> np.ndarray:
    """True where a row is no near copy of the first row of a band that it is in."""
    first = np.ones(len(sketches), bool)
    for b in range(0, SKETCH, BAND):
        _, at, group = np.unique(sketches[:, b : b + BAND], axis=0, return_index=True, return_inverse=True)
        other = at[group.ravel()]
        first &= (other == np.arange(len(sketches))) | ((sketches == sketches[other]).sum(axis=1) < ALIKE)
    return first


class Linear:
    """score = logistic(bias + the sum of the weights of a text's distinct words)."""

    def __init__(self, prior: float = 0.5):
        self.weights = np.zeros(1 << BITS, np.float32)
        prior = min(max(prior, 1e-6), 1 - 1e-6)
        self.bias = float(np.log(prior / (1 - prior)))

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[r].sum(dtype=np.float64) + self.bias for r in rows])

    def score(self, column) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(list(features(column))), -500, 500)))


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk of these margins with the logistic loss, and the slopes to go down by for both.

    It is prior * E_p[loss(+)] and, if not negative, E_u[loss(-)] - prior * E_p[loss(-)]. Where that difference is negative, the slopes lead it back up and leave the rest alone.
    """
    p, u = (np.clip(x, -50, 50) for x in (positive, unlabelled))
    sig_p, sig_u = 1 / (1 + np.exp(-p)), 1 / (1 + np.exp(-u))
    negative = np.log1p(np.exp(u)).mean() - prior * np.log1p(np.exp(p)).mean()
    value = prior * np.log1p(np.exp(-p)).mean() + max(0.0, negative)
    if negative >= 0:
        return value, (prior * (sig_p - 1) - prior * sig_p) / len(p), sig_u / len(u)
    return value, prior * sig_p / len(p), -sig_u / len(u)


def bounded(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """The slopes of the risk of BOUND * tanh(margin / BOUND)."""
    tanh = [np.tanh(x / BOUND) for x in (positive, unlabelled)]
    slopes = risk(*(BOUND * t for t in tanh), prior)[1:]
    return tuple(s * (1 - t * t) for s, t in zip(slopes, tanh, strict=True))


def frequencies(rows: list[np.ndarray]) -> np.ndarray:
    """In how many rows each feature is."""
    found = np.zeros(1 << BITS, np.int64)
    for i in range(0, len(rows), 256):
        found += np.bincount(np.concatenate(rows[i : i + 256]), minlength=1 << BITS)
    return found


def telling(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """True for the features that count; near copies in a group count once."""
    groups = [[r for r, one in zip(rows, firsts(np.stack([sketch(r) for r in rows])), strict=True) if one] for rows in (positive, unlabelled)]
    (own, other), (m, n) = map(frequencies, groups), map(len, groups)
    share = (own + other) / (m + n)
    spread = np.sqrt(share * (1 - share) * (1 / m + 1 / n)) + 1e-12
    return (own + other >= LEAST_DOCS) & (np.abs(own / m - other / n) >= TELLING * spread)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = STEPS, rate: float = 0.02, decay: float = 5e-5, seed: int = 0) -> Linear:
    """Minimises the non-negative risk with the logistic loss of bounded margins, by Adam over shuffled batches at a falling rate."""
    model = Linear(prior)
    if not positive or not unlabelled:
        return model
    common = telling(positive, unlabelled)
    place, size = np.cumsum(common) - 1, int(common.sum())
    groups = [[place[r[common[r]]] for r in rows] for rows in (positive, unlabelled)]
    w, bias = np.zeros(size), model.bias
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    rng = np.random.default_rng(seed)
    batches = max(1, len(unlabelled) // BATCH)
    rounds = -(-steps // batches)
    step = 0
    for _ in range(rounds):
        parts = [np.array_split(rng.permutation(len(rows)), batches) for rows in groups]
        for p_at, u_at in zip(*parts, strict=True):
            if not len(p_at) or not len(u_at):
                continue
            flat, margins = [], []
            for rows, at in zip(groups, (p_at, u_at), strict=True):
                lengths = np.array([len(rows[i]) for i in at])
                idx = np.concatenate([rows[i] for i in at])
                owner = np.repeat(np.arange(len(at)), lengths)
                flat.append((idx, owner))
                margins.append(np.bincount(owner, weights=w[idx], minlength=len(at)) + bias)
            slope = bounded(*margins, prior)
            g = np.zeros(size + 1)
            for (idx, owner), s in zip(flat, slope, strict=True):
                g[:size] += np.bincount(idx, weights=s[owner], minlength=size)
                g[size] += s.sum()
            g[:size] += decay * w
            now = rate * (1 - step / (rounds * batches))
            step += 1
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            move = now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w -= move[:size]
            bias -= move[size]
    model.weights[common], model.bias = w, float(bias)
    return model


def _sampled(rows: DataFrame, most: int, most_bytes: int) -> list[np.ndarray]:
    """The features of the first `most` rows by a hash of their ids, but for those that would bring their texts over `most_bytes`: these are skipped one by one."""
    kind = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("features", pa.binary())])

    def run(batches):
        for batch in sliced(batches):
            found = [f.astype(np.uint32).tobytes() for f in features(batch.column("text"))]
            yield pa.record_batch([batch.column("h"), batch.column("doc_id"), pa.array(found, pa.binary())], schema=kind)

    # of rows with one id those with the least text hash come first; hashes and sizes alone are ordered
    order = ["h", "doc_id", "t"]
    hashed = rows.withColumns({"h": F.xxhash64("doc_id"), "t": F.xxhash64("text")})
    first = hashed.select(*order, F.octet_length("text").alias("size")).orderBy(*order).limit(most).collect()
    keys = rows.sparkSession.createDataFrame([tuple(r[c] for c in order) for r in within(first, most_bytes)], "h long, doc_id long, t long").distinct()
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in order]
    chosen = hashed.alias("a").join(F.broadcast(keys.alias("b")), same, "left_semi")  # `most` keys at most
    # a row that is repeated teaches once
    chosen = chosen.dropDuplicates(order)
    return [np.frombuffer(r.features, np.uint32) for r in sorted(chosen.mapInArrow(released(run), "h long, doc_id long, features binary").collect())]


def train(docs: DataFrame, labels: DataFrame, usable, positives: int = POSITIVES, unlabelled: int = UNLABELLED, most_bytes: int = SAMPLE_BYTES) -> Linear:
    """usable: from a doc_id column, a column that is true where a document may be learned from."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(usable(F.col("doc_id")) & F.col("toxic").isNotNull())
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = marks.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where(usable(F.col("doc_id")) & text.isNotNull())
    # at most `positives` ids are broadcast
    confirmed = F.broadcast(marks.where("toxic = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives))
    toxic = _sampled(rows.join(confirmed, "doc_id", "left_semi"), positives, most_bytes)
    return fit(toxic, _sampled(rows, unlabelled, most_bytes), prior) if toxic else Linear(prior)


def score(docs: DataFrame, model: Linear, row: bool = False) -> DataFrame:
    """doc_id and score of every row; if row, a struct of all its columns and the score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return answered(docs, lambda texts: {"score": pa.array(shared.value.score(texts), pa.float64())}, "score double", row)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), lambda i: fold(i) != 0)
    found = score(docs, model).withColumn("held_out", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(True)))
    return found.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
