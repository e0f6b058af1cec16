"""What the lines of a log have set at the beginning of each of its chunks.

Parsing a log carries values from line to line. Here each chunk is folded into a few rows by itself: what it sets whatever came before, and what depends on it (whether its first
session line begins another thread). Those rows compose, so windows over them, a few for each chunk, give the state (STATE) at the beginning of every chunk and at the end of the
file; the chunks' lines are then finished side by side, each from its state.

A chunk has zones: 0 before its first line that names a thread, then a further one wherever the thread changes for certain. Totals, snapshots and turns of a life
are folded by zone: zone 0 goes on with the life that is there; the last zone is what the next chunk goes on with, and the same life if the thread is the one before.

A state that was kept is one more row, before all chunks, so a file that grew is read from where it ended.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stored import materialise
from ..schema import TOKENS
from .parse import STATE, carried, named, signature, what_lines_set, with_snapshots

#: Places of a kept state and of a file's end among its chunks.
KEPT, END = -1, (1 << 63) - 1
_CARRIED = ("project", "model", "effort", "edges")
_FOLD = (
    f"struct<turn: struct<at: bigint, v: struct<v: string>>, high: struct<{', '.join(f'{t}: bigint' for t in TOKENS)}>, started: boolean, last: struct<at: bigint, v: string>>"
)


def _latest(value: Column, at: str = "line_no") -> Column:
    """The last value that isn't null, with its place, as an aggregate that composes."""
    return F.max(F.when(value.isNotNull(), F.struct(F.col(at).alias("at"), value.alias("v"))))


def _highs(total: str) -> Column:
    return F.struct(*[F.max(f"{total}.{t}").alias(t) for t in TOKENS])


def fold_zones(rows: DataFrame) -> DataFrame:
    """rows of decode(), by zone and limit of each chunk: what they set."""
    sets = what_lines_set()
    whole = Window.partitionBy("file", "chunk").orderBy("line_no")
    so_far = whole.rowsBetween(Window.unboundedPreceding, 0)
    rows = with_snapshots(rows).withColumns({"own": sets["own"], "named": F.last(sets["own"], True).over(so_far)})
    before = F.lag("named").over(whole)
    rows = rows.withColumn("zone", F.sum(F.coalesce((F.col("named").isNotNull() & ~F.col("named").eqNullSafe(before)).cast("int"), F.lit(0))).over(so_far))
    snapshot, counted = F.col("total").isNotNull() | F.col("last").isNotNull(), F.col("total").isNotNull()
    rows = rows.withColumn("sign", F.when(snapshot, signature()))
    return rows.groupBy("file", "chunk", "zone", F.when(snapshot, F.col("limit")).alias("limit")).agg(
        F.max(F.when(F.col("type") == "end", F.col("line_no"))).alias("lines"), F.count_if(sets["meta"]).alias("metas"),
        F.min(F.when(F.col("own").isNotNull(), F.struct("line_no", "own"))).alias("first_own"), _latest(F.col("own")).alias("last_own"),
        *[_latest(sets[c]).alias(c) for c in _CARRIED],
        _latest(sets["turn"]).alias("turn"), _highs("total").alias("high"), F.coalesce(F.bool_or(counted), F.lit(False)).alias("started"), _latest(F.col("sign")).alias("last"),
        _latest(F.when(counted, F.col("sign"))).alias("counted"),
    )


def fold_chunks(zones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """fold_zones() by chunk: what it sets (a row each), and for each limit of its first and last zone the last counted snapshot."""
    zones = zones.withColumn("top", F.max("zone").over(Window.partitionBy("file", "chunk")))
    fold = lambda on: F.struct(F.max(F.when(on, F.col("turn"))).alias("turn"), F.struct(*[F.max(F.when(on, F.col(f"high.{t}"))).alias(t) for t in TOKENS]).alias("high"), F.bool_or(on & F.col("started")).alias("started"), F.max(F.when(on, F.col("last"))).alias("last")).cast(_FOLD)
    first, final = F.col("zone") == 0, (F.col("zone") > 0) & (F.col("zone") == F.col("top"))
    chunks = zones.groupBy("file", "chunk").agg(
        F.max("lines").alias("lines"), F.sum("metas").alias("metas"), F.min("first_own")["own"].alias("first_own"), F.max("last_own")["v"].alias("last_own"), *[F.max(c)["v"].alias(c) for c in _CARRIED],
        F.max("top").alias("top"), fold(first).alias("pre"), fold(final).alias("post"),
    )
    limits = zones.where(F.col("limit").isNotNull() & F.col("counted").isNotNull() & (first | final)).select("file", "chunk", (F.col("zone") > 0).alias("final"), "limit", F.col("counted.v").alias("sign"))
    return chunks, limits


def _kept(kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """States of (file, s) as if they were chunks."""
    s = kept.select("file", "s.*")
    none, at = F.lit(None).cast(_FOLD), F.lit(0).cast("long").alias("at")
    turn, last = (F.when(F.col(c).isNotNull(), F.struct(at, F.col(c).alias("v"))).alias(n) for c, n in (("turn", "turn"), ("signature", "last")))
    post = F.struct(turn, "high", "started", last).cast(_FOLD)
    chunks = s.select(
        "file", F.lit(KEPT).cast("long").alias("chunk"), "lines", F.col("segment").alias("metas"), F.col("thread").alias("first_own"), F.col("thread").alias("last_own"), *_CARRIED,
        F.lit(1).cast("long").alias("top"), none.alias("pre"), post.alias("post"), F.col("life").alias("lives"),
    )
    limits = s.select("file", F.lit(KEPT).cast("long").alias("chunk"), F.lit(True).alias("final"), F.explode("limits").alias("limit", "sign"))
    return chunks, limits


def states(rows: DataFrame, kept: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """file, chunk and s (STATE), materialised: what holds at the beginning of each chunk of rows (of decode()), and of chunk END at the end of each file.

    kept: states (file, s) with which files begin; others begin with nothing. tasks: see dealt().
    """
    zones = materialise(fold_zones(dealt(rows, tasks)))
    chunks, limits = fold_chunks(zones)
    chunks = chunks.withColumn("lives", F.lit(None).cast("long"))
    if kept is not None:
        more, some = _kept(kept)
        chunks, limits = chunks.unionByName(more), limits.unionByName(some)
    ends = chunks.select("file").distinct().withColumn("chunk", F.lit(END))
    chunks = chunks.unionByName(ends, allowMissingColumns=True)
    before = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    thread = F.coalesce(F.last("last_own", True).over(before), named(F.col("file")))
    chunks = chunks.withColumn("thread", thread)
    # a chunk's first thread begins another life if it isn't the one before
    lives = (F.col("first_own").isNotNull() & (F.col("first_own") != F.col("thread"))).cast("long") + F.greatest(F.col("top") - 1, F.lit(0))
    chunks = chunks.withColumn("lives", F.coalesce("lives", F.when(F.col("top").isNotNull(), F.coalesce(lives, F.lit(0))), F.lit(0)))
    sums = {n: F.coalesce(F.sum(c).over(before), F.lit(0)) for n, c in (("life", "lives"), ("segment", "metas"), ("lines_before", "lines"))}
    chunks = chunks.withColumns(sums | {f"{c}_before": F.last(c, True).over(before) for c in _CARRIED})
    # folds by life: of a chunk its first zone in the life that is there, its last one in the life it leaves, and a row that asks
    part = lambda n, life, fold: F.struct(F.lit(n).alias("part"), life.alias("of"), fold.alias("fold"))
    left = F.col("life") + F.col("lives")
    parts = chunks.select("file", "chunk", F.explode(F.array(part(0, F.col("life"), F.lit(None).cast(_FOLD)), part(1, F.col("life"), F.col("pre")), part(2, left, F.col("post")))).alias("x")).select("file", "chunk", "x.*")
    parts = parts.where("part = 0 or fold is not null")
    so_far = Window.partitionBy("file", "of").orderBy("chunk", "part").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.last(F.col(f"fold.{c}.v"), True).over(so_far)
    folded = parts.withColumns({
        "turn": last("turn"), "high": F.struct(*[F.max(f"fold.high.{t}").over(so_far).alias(t) for t in TOKENS]), "started": F.coalesce(F.max("fold.started").over(so_far), F.lit(False)), "signature": last("last"),
    }).where("part = 0")
    # the last counted snapshot of each limit of a life
    lived = chunks.select("file", "chunk", "life", left.alias("left"))
    entries = limits.join(lived, ["file", "chunk"]).select("file", F.when(F.col("final"), F.col("left")).otherwise(F.col("life")).alias("of"), "limit", "chunk", (1 + F.col("final").cast("int")).alias("part"), "sign")
    asked = lived.withColumnRenamed("life", "of").join(entries.select("file", "of", "limit").distinct(), ["file", "of"]).select("file", "of", "limit", "chunk", F.lit(0).alias("part"), F.lit(None).cast("string").alias("sign"))
    known = F.last("sign", True).over(Window.partitionBy("file", "of", "limit").orderBy("chunk", "part").rowsBetween(Window.unboundedPreceding, -1))
    of_limits = entries.unionByName(asked).withColumn("known", known).where("part = 0 and known is not null").groupBy("file", "chunk").agg(F.map_from_entries(F.collect_list(F.struct("limit", "known"))).alias("limits"))
    out = chunks.where(F.col("chunk") != KEPT).join(folded.drop("of", "fold", "part"), ["file", "chunk"]).join(of_limits, ["file", "chunk"], "left")
    limits_or_none = F.coalesce("limits", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    state = F.struct(
        F.col("lines_before").alias("lines"), "thread", "segment", "life", F.col("project_before").alias("project"), "turn", F.col("model_before").alias("model"), F.col("effort_before").alias("effort"), F.col("edges_before").alias("edges"),
        "high", "started", "signature", limits_or_none.alias("limits"),
    )
    return materialise(out.select("file", "chunk", state.cast(STATE).alias("s")), zones)


def dealt(rows: DataFrame, tasks: int | None) -> DataFrame:
    """Chunks dealt into so many tasks. Left alone, as many chunks share a task as compress to one partition, which are sorted uncompressed."""
    return rows if tasks is None else rows.repartition(tasks, "file", "chunk")


def seeded(rows: DataFrame, begins: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows of decode() with the state of each chunk in a row before its lines, for carried(); lines are numbered on from those before their chunk."""
    first = begins.where(F.col("chunk") != END).select("file", "chunk", F.lit(-1).cast("long").alias("line_no"), "s")
    return dealt(rows.unionByName(first, allowMissingColumns=True), tasks)


def numbered(read: DataFrame) -> DataFrame:
    """Rows of carried() with line numbers that count from the file's start."""
    base = F.first("s.lines", True).over(Window.partitionBy("file", "chunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    return read.withColumn("line_no", F.when(F.col("s").isNull(), F.col("line_no") + F.coalesce(base, F.lit(0))).otherwise(F.col("line_no")))


def read_split(rows: DataFrame, begins: DataFrame, tasks: int | None = None) -> DataFrame:
    """carried() of rows of decode() with chunks, from states() of them. rows are read several times: materialise them first. tasks: see dealt()."""
    return numbered(carried(seeded(rows, begins, tasks)))
