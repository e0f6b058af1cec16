"""Near-duplicate groups by MinHash with sequential Bayesian verification.

1. Every text becomes its set of word shingles, a digest of that set and `HASHES` minhashes (one scan).
2. Texts with equal sets form one class, with a number of its own; the row with its smallest doc_id stands for it from here on, so a group
   of copies of any size is one row.
3. Signatures are cut into bands; classes that agree on a band are candidates. A bucket first links its members to
   one centre, drawn by hash: its size, not its square, is what it emits.
4. Signatures of a candidate pair are compared batch by batch. With a uniform prior the similarity has a Beta
   posterior after each batch, and the pair goes as soon as P(similarity >= threshold) < `MISS`.
5. Survivors are verified exactly on their full shingle sets.
6. Verified links give connected components. Buckets whose members still lie in several of them are searched exhaustively, by the same two tests:
   every member outside the bucket's largest component meets all members of other components. No pair is written but for
   verified links, and a pair is looked at only in the first band that it shares.

Bands are as many rows wide as a miss of `UNSEEN` at the threshold allows: at 0.85, a pair shares none of 20 bands of 5 with probability (1 - 0.85**5)**20 = 8e-6.

Defined results: a null or empty text, or one without words, has an empty set, links with nothing and is kept; a text
of fewer words than a shingle is one shingle; a very long text is a set of as many shingles, held by one task; repeated rows, several texts of one doc_id and rows
without a doc_id are rows like others, of which each component keeps one: that with the smallest doc_id, of those any one, rows without an id last (their component has a null component_id
if none of its rows has one); an empty table gives no rows; columns besides doc_id and text are not read, but for first_rows(), which returns them.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialise, released, sliced, table
from ._text import Words, blocks, grams
from .components import connected_components

HASHES, BATCH = 100, 20
MISS = 1e-8
#: A pair at the threshold shares no band with this probability at most.
UNSEEN = 1e-5
#: Rounds of one centre per bucket before the exhaustive one, and the rows of its groups.
STAR_ROUNDS, STRAYS, MEMBERS = 2, 512, 1024
#: Shingles in such a group, about.
GROUP_SHINGLES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20))
_A = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingle_sets(column, shingle: int):
    """The sorted distinct shingle hashes of each text."""
    for _, _, data, offsets in blocks(column):
        w = Words(data, offsets, lower=True)
        whole = grams(w.hash, shingle)
        for k, n in enumerate(w.count):
            at = w.first[k]
            if n >= shingle:
                yield np.unique(whole[at : at + n - shingle + 1])
            else:
                yield grams(w.hash[at : at + n], n) if n else np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, np.uint32(0xFFFFFFFF))
    for i in range(0, len(shingles), 1024):
        part = (shingles[None, i : i + 1024] * _A[:, None] + _B[:, None]) >> np.uint64(32)
        np.minimum(low, part.min(1).astype(np.uint32), out=low)
    return low


def _digest(shingles: np.ndarray) -> bytes:
    """Of the set: equal for equal sets, else equal with a probability of about 2**-128."""
    x = shingles * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.array([shingles.sum(dtype=np.uint64), (x ^ (x >> np.uint64(29)) ^ np.uint64(len(shingles))).sum(dtype=np.uint64)]).tobytes()


def sketch(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, two hashes of the text, n_shingles, digest and signature (both null for an empty set)."""
    kind = pa.schema([("n_shingles", pa.int64()), ("digest", pa.binary()), ("signature", pa.binary())])

    def run(batches):
        for batch in sliced(batches):
            rows = [(len(s), _digest(s), signature(s).tobytes()) if len(s) else (0, None, None) for s in shingle_sets(batch.column("text"), shingle)]
            found = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in KEYS} | {f.name: pa.array(x, f.type) for f, x in zip(kind, found, strict=True)})

    return docs.select(*_keys(), F.col("text").cast("string").alias("text")).mapInArrow(released(run), "doc_id long, text_key long, text_key2 int, n_shingles long, digest binary, signature binary")


KEYS = ("doc_id", "text_key", "text_key2")


def _keys() -> list:
    """What tells the rows of a text: several may have one doc_id, or none."""
    text = F.col("text").cast("string")
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.hash(text).alias("text_key2")]


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """After 20, 40, ... compared hashes, the fewest matches with P(similarity >= threshold) >= miss, for a uniform prior."""
    out = []
    for m in range(BATCH, HASHES + 1, BATCH):
        # Beta(k + 1, m - k + 1) lies over t with the probability that a Binomial(m + 1, t) is at most k
        below, k = 0.0, -1
        while below < miss:
            k += 1
            below += math.comb(m + 1, k) * threshold**k * (1 - threshold) ** (m + 1 - k)
        out.append(k)
    return out


def banding(threshold: float) -> tuple[int, int]:
    """Bands and rows of a band, as selective as UNSEEN allows."""
    for rows in range(10, 0, -1):
        bands = HASHES // rows
        if (1 - threshold**rows) ** bands <= UNSEEN:
            return bands, rows
    return HASHES, 1


def alive(x: np.ndarray, y: np.ndarray, least: list[int]) -> np.ndarray:
    """Which rows of two arrays of signatures sequential comparison leaves; a batch is only compared for rows still left."""
    left, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
    for i, fewest in enumerate(least):
        part = slice(i * BATCH, (i + 1) * BATCH)
        matches[left] += (x[left, part] == y[left, part]).sum(1)
        left = left[matches[left] >= fewest]
    return left


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted distinct arrays."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    common = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _signatures(column) -> np.ndarray:
    return np.array([np.frombuffer(s, np.uint32) for s in column.to_pylist()]).reshape(-1, HASHES)


def member_sets(docs: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """node and shingles of the classes named, from a row that stands for each. members: node, doc_id, text_key, digest."""
    kind = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        for batch in sliced(batches):
            sets = list(shingle_sets(batch.column("text"), shingle))
            same = [_digest(s) == d for s, d in zip(sets, batch.column("digest").to_pylist(), strict=True)]
            yield pa.record_batch([batch.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], schema=kind).filter(pa.array(same, pa.bool_()))

    rows = docs.select(*_keys(), F.col("text").cast("string").alias("text"))
    own = members.select("node", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "digest")
    found = rows.join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).select("node", "digest", "text")
    return found.mapInArrow(released(run), "node long, shingles binary").dropDuplicates(["node"])


def verified(pairs: DataFrame, signs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b that pass sequential comparison and then the exact test; only survivors of the first meet their sets. signs: node, signature."""
    least = least_matches(percent / 100)

    def compared(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                x, y = (_signatures(part.column(c)) for c in ("sign_a", "sign_b"))
                yield pa.record_batch([part.column("a"), part.column("b")], names=["a", "b"]).take(pa.array(alive(x, y, least), pa.int64()))

    def exact(batches):
        for batch in batches:
            keep = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True)]
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def of_both(rows, values, name):
        return rows.join(values.toDF("b", f"{name}_b"), "b").join(values.toDF("a", f"{name}_a"), "a")

    # written, so that no task needs a Python worker for each of the two steps
    left = materialise(of_both(pairs.select("a", "b"), signs, "sign").mapInArrow(released(compared), "a long, b long"))
    return of_both(left, sets, "set").mapInArrow(released(exact), "a long, b long")


def _labelled(bands: DataFrame, components: DataFrame) -> DataFrame:
    return bands.join(components.toDF("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))


def _torn(bands: DataFrame, components: DataFrame) -> DataFrame:
    """The buckets whose members lie in several components, with the component most members are of, and how many are of it and of others."""
    inside = _labelled(bands, components)
    sizes = inside.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("m"))
    torn = sizes.groupBy("key").agg(F.max(F.struct("n", "component", "m")).alias("most"), F.sum("n").alias("size"), F.sum("m").alias("shingles"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    return inside.join(torn.select("key", F.col("most.component").alias("giant"), F.col("most.n").alias("own"), F.col("most.m").alias("own_shingles"), "size", "shingles"), "key")


def _stars(rows: DataFrame, salt: int) -> DataFrame:
    """a, b: in each bucket, one member drawn by hash with every other one. Minima are combined before they are shuffled; that a hot bucket's join is split is left to the engine."""
    drawn = F.struct(F.xxhash64("node", F.lit(salt), "key").alias("h"), F.col("node"))
    centres = rows.groupBy("key").agg(F.min(drawn).alias("c")).select("key", F.col("c.node").alias("centre"))
    pairs = rows.join(centres, "key").where("node <> centre")
    return pairs.groupBy(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).agg(F.lit(1).alias("one")).select("a", "b")


def _across(percent: int):
    """Of part of a torn bucket: links between strays and members of other components, one per pair of components."""
    least = least_matches(percent / 100)
    bands, rows = banding(percent / 100)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        band = table.column("band")[0].as_py()
        side = np.array(table.column("stray").to_pylist(), bool)
        ids, component = (np.array(table.column(c).to_pylist(), np.int64) for c in ("node", "component"))
        signs = _signatures(table.column("signature"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        size = np.array([len(s) for s in sets])
        strays, others = np.flatnonzero(side), np.flatnonzero(~side)
        join = {c: c for c in component.tolist()}

        def root(c):
            while join[c] != c:
                join[c] = join[join[c]]
                c = join[c]
            return c

        links = []
        for i in strays.tolist():
            near = others[(component[others] != component[i]) & (100 * np.minimum(size[others], size[i]) >= percent * np.maximum(size[others], size[i]))]
            if not len(near):
                continue
            near = near[alive(np.broadcast_to(signs[i], (len(near), HASHES)), signs[near], least)]
            # each pair is looked at in the first of the bands that it shares
            shared = (signs[near] == signs[i])[:, : bands * rows].reshape(-1, bands, rows).all(2)
            near = near[~shared[:, :band].any(1)]
            for j in near.tolist():
                a, b = root(int(component[i])), root(int(component[j]))
                if a != b and similar(sets[i], sets[j], percent):
                    join[max(a, b)] = min(a, b)
                    links.append((int(ids[i]), int(ids[j])))
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def across(torn: DataFrame, signs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: exact links between the components of torn buckets.

    Strays, which are outside a bucket's largest component, meet all its members, in groups of at most about STRAYS and MEMBERS
    rows: what a member of the largest component is copied for grows with the strays only.
    """
    stray = F.col("component") != F.col("giant")
    parts = lambda rows, limit, shingles: F.greatest(F.lit(1), F.ceil(rows / limit), F.ceil(shingles / GROUP_SHINGLES)).cast("int")
    n_strays, n_members = parts(F.col("size") - F.col("own"), STRAYS, F.col("shingles") - F.col("own_shingles")), parts(F.col("size"), MEMBERS, F.col("shingles"))
    rows = torn.withColumn("n_strays", n_strays).withColumn("n_members", n_members)
    rows = rows.withColumn("s", F.pmod(F.xxhash64("node", F.lit("s")), "n_strays").cast("int")).withColumn("m", F.pmod(F.xxhash64("node", F.lit("m")), "n_members").cast("int"))
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    as_member = rows.select("key", "band", "node", "component", to("n_strays").alias("s"), "m", F.lit(False).alias("stray"))
    as_stray = rows.where(stray).select("key", "band", "node", "component", "s", to("n_members").alias("m"), F.lit(True).alias("stray"))
    return as_member.unionByName(as_stray).join(signs, "node").join(sets, "node").groupBy("key", "s", "m").applyInArrow(_across(percent), "a long, b long")


def link_classes(docs: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """node, component of the classes (node, doc_id, text_key, n_shingles, signature, digest) that link with another."""
    n_bands, rows = banding(percent / 100)
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.xxhash64(F.lit(i), F.substring("signature", 1 + 4 * rows * i, 4 * rows)).alias("key")) for i in range(n_bands)])
    banded = classes.select(F.explode(keys).alias("k"), "node", "n_shingles").select("k.key", "k.band", "node", "n_shingles")
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    bands = materialise(banded.join(shared, "key"))
    members = classes.join(bands.select("node").distinct(), "node", "left_semi")
    sets, signs = materialise(member_sets(docs, members, shingle)), classes.select("node", "signature")

    links = materialise(verified(_stars(bands, 0), signs, sets, percent))
    components = connected_components(links)
    for salt in range(1, STAR_ROUNDS):
        torn = _torn(bands, components).select("key", "node", "component")
        more = _stars(torn, salt)
        other = lambda c: components.toDF(c, f"c{c}")
        apart = more.join(other("a"), "a", "left").join(other("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
        links = links.unionByName(materialise(verified(apart, signs, sets, percent)))
        components = connected_components(links)
    links = links.unionByName(materialise(across(_torn(bands, components), signs, sets, percent)))
    return connected_components(links)


def _linked(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sketches of all rows with a row_no; digest and component of the classes; and by component the smallest doc_id with the row_no and the keys of its first row."""
    sketches = materialise(sketch(docs, shingle).withColumn("row_no", F.monotonically_increasing_id()))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_no", "text_key", "text_key2", "signature"))
    first = sketches.where("digest is not null").groupBy("digest").agg(least.alias("r"), F.first("n_shingles").alias("n_shingles"))
    # written once, so a class has one number wherever it is read
    classes = materialise(first.select("digest", "n_shingles", "r.*", F.monotonically_increasing_id().alias("node")))
    components = link_classes(docs, classes, shingle, percent)
    of_class = classes.drop("signature").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = of_class.groupBy("component").agg(F.min(F.struct("unnamed", "doc_id", "row_no", "text_key", "text_key2")).alias("h")).select("component", "h.*")
    return sketches, of_class.select("digest", "component"), heads


def near_duplicates(docs: DataFrame, shingle: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs; of a component's rows exactly one is kept."""
    sketches, of_class, heads = _linked(docs, shingle, percent)
    # rows without words get keys of their own, which match nothing: as nulls they would meet in one task
    key = F.coalesce("digest", F.col("row_no").cast("string").cast("binary"))
    rows = sketches.select("doc_id", "n_shingles", "row_no", key.alias("digest"), F.col("digest").isNull().alias("empty"))
    of_row = of_class.join(heads.select("component", F.col("doc_id").alias("component_id"), F.col("row_no").alias("first_row")), "component")
    out = rows.join(of_row, "digest", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("empty"), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), (F.col("empty") | (F.col("first_row") == F.col("row_no"))).alias("kept"))


def first_rows(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, whole, that near_duplicates() keeps: one of each component, and all without words. Of repeated rows of one id and text any one."""
    _, _, heads = _linked(docs, shingle, percent)
    names = [f"_{k}" for k in ("unnamed", *KEYS)]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    # a null id is a number and a flag here, so that all of it is one hash join
    keyed = lambda keys, *more: [keys[0].isNull().alias(names[0]), F.coalesce(keys[0], F.lit(0)).alias(names[1]), keys[1].alias(names[2]), keys[2].alias(names[3]), *more]
    rows = docs.select(*keyed(_keys(), row, (~F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))).alias("_empty")))
    kept = rows.where(~F.col("_empty")).join(heads.select(*keyed([F.col(k) for k in KEYS])), names, "left_semi").dropDuplicates(names)
    return kept.select("row.*").unionByName(rows.where("_empty").select("row.*"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("kept")).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], ' ') AS k FROM (SELECT *, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) IN (1, 2)
), sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
smallest AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM smallest LEFT JOIN sizes USING (doc_id)
"""
