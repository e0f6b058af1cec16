"""From log lines to usage events and threads, as windows over each file's lines.

A log is read as a machine that carries its thread, project, turn and model from line to line. Here each of them is the last value that some
earlier line of the file set: carried values are wrapped in structs, so that a line that sets null is told from one that sets nothing.

* A session line begins a meta segment; one that names another thread also begins a thread segment, which forgets turns and snapshots.
* Cumulative snapshots become deltas against the running maximum of all earlier snapshots of the thread segment, those
  repeated included; repeated ones, and empty ones, are dropped after the windows.
* A child's snapshots that its parent has too, up to the time it was made, are inherited: they are marked excluded until the first
  one that the parent lacks.

A file may be cut into chunks of lines, each a partition of the windows. What the lines before a chunk have set is then a row at its beginning (see carry.py), so a large
file is parsed by many tasks, and a file that grew from where it ended.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import instant, project_path, whole_number
from ..schema import TOKENS, USAGE_EVENTS
from ..sources.logs import unusable

VERSION = 1
_UUID = r"([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})"
_ELSEWHERE = {
    "cached_input_tokens": ("input_tokens_details.cached_tokens",),
    "cache_write_input_tokens": ("input_tokens_details.cache_write_tokens", "cache_write_tokens"),
    "reasoning_output_tokens": ("output_tokens_details.reasoning_tokens",),
}
_PAYLOAD = (
    "id string, session_id string, cwd string, forked_from_id string, timestamp string, thread_source string, source string, turn_id string, model string, effort string, "
    "thread_id string, response_id string, usage string, type string, info struct<total_token_usage: string, last_token_usage: string>, rate_limits struct<limit_id: string>"
)


#: What the lines of a file have set up to some place. Structs tell null that is set from nothing set; high: the maximum of all totals of this life; limits: the last counted snapshot of each.
STATE = (
    "struct<lines: bigint, thread: string, segment: bigint, life: bigint, project: struct<v: string>, turn: struct<v: string>, model: struct<v: string>, effort: struct<v: string>, "
    "edges: struct<subagent_parent_id: string, forked_from_id: string, cutoff: timestamp_ntz, source: string>, "
    f"high: struct<{', '.join(f'{t}: bigint' for t in TOKENS)}>, started: boolean, signature: string, limits: map<string, string>>"
)


def tokens(usage: Column) -> Column:
    """A struct of the token counts of a usage object; what isn't reported is null."""
    at = lambda path: F.get_json_object(usage, f"$.{path}")
    return F.struct(*[whole_number(F.coalesce(*(at(p) for p in (t, *_ELSEWHERE.get(t, ()))))).alias(t) for t in TOKENS])


def _set(condition: Column, value: Column) -> Column:
    """What a line sets: a struct, so that null can be set too."""
    return F.when(condition, F.struct(value.alias("v")))


def _is_object(text: Column) -> Column:
    return F.startswith(F.ltrim(text), F.lit("{"))


def decode(lines: DataFrame) -> DataFrame:
    """The lines that matter of (file, line_no, doc) or (file, chunk, line_no, doc), taken apart: type, at and p (the payload).

    Lines that are no JSON have the type `bad`, and the row that ends a chunk `end`.
    """
    chunk = F.col("chunk") if "chunk" in lines.columns else F.lit(0).cast("long")
    doc = F.from_json("doc", "type string, timestamp string, payload string")
    rows = lines.select("file", chunk.alias("chunk"), F.col("line_no").cast("long").alias("line_no"), doc.alias("d"), F.col("doc").isNull().alias("last"), unusable(F.col("doc")).alias("bad"))
    payload = F.when(_is_object(F.col("d.payload")), F.from_json("d.payload", _PAYLOAD))
    kind = F.when(F.col("last"), "end").when(F.col("bad"), "bad").otherwise(F.col("d.type"))
    rows = rows.select("file", "chunk", "line_no", kind.alias("type"), instant(F.col("d.timestamp")).alias("at"), F.when(~F.col("last") & ~F.col("bad"), payload).alias("p"))
    token_event = (F.col("type") == "event_msg") & (F.col("p.type") == "token_count") & F.col("p.info").isNotNull()
    return rows.where(F.col("type").isin("end", "bad") | F.col("p").isNotNull() & (F.col("type").isin("session_meta", "turn_context", "token_usage_record") | token_event))


def named(file: Column) -> Column:
    """The thread of a file's lines before one that names it."""
    return F.coalesce(F.nullif(F.regexp_extract(file, _UUID, 1), F.lit("")), F.sha2(file, 256))


def what_lines_set() -> dict[str, Column]:
    """Of a line of decode(): is it a session's or a context's, and what it sets, in structs or null: thread, project, turn, model, effort and edges."""
    meta, context = F.col("type") == "session_meta", F.col("type") == "turn_context"
    path = project_path(F.col("p.cwd"))
    blank = lambda c: F.when(F.trim(c) != "", c)
    spawned = F.when(_is_object(F.col("p.source")), blank(F.get_json_object("p.source", "$.subagent.thread_spawn.parent_thread_id")))
    edges = F.struct(
        spawned.alias("subagent_parent_id"), blank(F.col("p.forked_from_id")).alias("forked_from_id"), F.coalesce(instant(F.coalesce(F.nullif("p.timestamp", F.lit("")), F.lit(None))), F.col("at")).alias("cutoff"),
        F.when(F.col("p.source").isNotNull() & ~_is_object(F.col("p.source")), F.col("p.source")).otherwise(F.col("p.thread_source")).alias("source"),
    )
    return {
        "meta": meta,
        "own": F.when(meta, F.coalesce(F.nullif("p.id", F.lit("")), "p.session_id")),
        "project": _set(meta | (context & path.isNotNull()), path),
        "turn": _set(context, F.col("p.turn_id")),
        "model": _set(context, F.col("p.model")),
        "effort": _set(context, F.col("p.effort")),
        "edges": F.when(meta, edges),
    }


def carried(rows: DataFrame) -> DataFrame:
    """Rows of decode() with the thread, project, turn, model and edges that hold there.

    rows may have a column s: the state at the beginning of a chunk (see carry.py), in a row before its lines.
    """
    if "s" not in rows.columns:
        rows = rows.withColumn("s", F.lit(None).cast(STATE))
    sets = what_lines_set()
    whole = Window.partitionBy("file", "chunk").orderBy("line_no")
    so_far = whole.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("thread", F.coalesce(F.last(F.coalesce("s.thread", sets["own"]), True).over(so_far), named(F.col("file"))))
    rows = rows.withColumn("segment", F.sum(F.coalesce("s.segment", F.when(sets["meta"], 1).otherwise(0))).over(so_far))
    rows = rows.withColumn("before", F.coalesce(F.lag("thread").over(whole), named(F.col("file"))))
    rows = rows.withColumn("life", F.sum(F.coalesce("s.life", (F.col("thread") != F.col("before")).cast("long"))).over(so_far))
    # a segment's first line sets its project and edges, and a life's first line no turn: so all are the last ones of one window, and a chunk is sorted once
    sets["turn"] = F.coalesce(sets["turn"], _set(F.col("thread") != F.col("before"), F.lit(None).cast("string")))
    last = lambda name: F.last(F.coalesce(f"s.{name}", sets[name]), True).over(so_far)
    rows = rows.withColumns({"project": last("project")["v"], "turn": last("turn")["v"], "model": last("model")["v"], "effort": last("effort")["v"], "edges": last("edges")})
    return rows.withColumn("parent", F.coalesce("edges.forked_from_id", "edges.subagent_parent_id"))


def read_lines(lines: DataFrame) -> DataFrame:
    """The lines that matter of whole files, with what holds there."""
    return carried(decode(lines))


def threads_of(read: DataFrame) -> DataFrame:
    """One row per thread: the last known project and source, and the edges of its last session line."""
    rows = read.where("type = 'session_meta'")
    at = F.struct("file", "line_no")
    known = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at))
    edge = lambda c: F.max_by(F.struct(F.col(f"edges.{c}").alias("v")), at)["v"]
    rows = rows.withColumn("source", F.col("edges.source"))
    return rows.groupBy(F.col("thread").alias("id")).agg(
        known("project").alias("project"), known("source").alias("source"), F.max_by(F.struct(F.col("parent").alias("v")), at)["v"].alias("parent_id"), edge("subagent_parent_id").alias("subagent_parent_id"), edge("forked_from_id").alias("forked_from_id")
    )


def explicit_events(read: DataFrame) -> DataFrame:
    """Events that logs record as such. Without a response id, a record is known by its content, and incomplete."""
    t = tokens(F.col("p.usage"))
    rows = read.where((F.col("type") == "token_usage_record") & F.col("at").isNotNull()).withColumn("t", t).where(F.col("t.total_tokens").isNotNull())
    thread, turn = F.coalesce("p.thread_id", "thread"), F.coalesce("p.turn_id", "turn")
    content = F.to_json(F.struct(thread.alias("a"), turn.alias("b"), F.col("at"), F.col("t")), {"ignoreNullFields": "false"})
    response = F.col("p.response_id")
    key = F.coalesce(F.concat(F.lit("response:"), response), F.concat(F.lit("record:"), F.sha2(content, 256)))
    return rows.select(
        "file", "line_no", key.alias("event_key"), thread.alias("thread_id"), turn.alias("turn_id"), response.alias("response_id"), F.col("at").alias("event_at"), "project", "model", "effort", F.lit("record").alias("kind"),
        F.lit(None).cast("string").alias("signature"), "t.*", response.isNull().cast("int").alias("incomplete"), F.lit(0).alias("excluded"),
    )


def signature() -> Column:
    """What tells a snapshot (total and last) from others."""
    return F.to_json(F.struct("total", "last"), {"ignoreNullFields": "false"})


def snapshot_deltas(rows: DataFrame, thread_segment: tuple[str, ...], order: str, seed: Column | None = None) -> DataFrame:
    """rows: total and last (structs of token counts, or null), limit and parent. Adds t (the delta), repeated and incomplete.

    seed: a state (STATE) or null; the row that has one stands for all snapshots before, and its total is their maximum.

    A row's own counts (last) are taken as they are; else each count of total is what it is over the running maximum, and zero and
    incomplete where it is under it.
    """
    line = Window.partitionBy(*thread_segment).orderBy(order)
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    counted = F.col("total").isNotNull()
    rows = rows.withColumn("signature", signature() if seed is None else F.when(seed.isNull(), signature()).otherwise(seed["signature"]))
    previous = F.lag("signature").over(line)
    of_limit = Window.partitionBy(*thread_segment, "limit").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last_of_limit = F.last(F.when(counted if seed is None else counted & seed.isNull(), F.col("signature")), True).over(of_limit)
    if seed is not None:
        last_of_limit = F.coalesce(last_of_limit, F.try_element_at(F.first(seed["limits"], True).over(before), F.col("limit")))
    repeated = counted & (F.coalesce(previous == F.col("signature"), F.lit(False)) | F.coalesce(last_of_limit == F.col("signature"), F.lit(False)))
    high = {t: F.coalesce(F.max(F.col(f"total.{t}")).over(before), F.lit(0).cast("bigint")) for t in TOKENS}
    rows = rows.withColumns({"repeated": repeated, "started": F.coalesce(F.max(counted.cast("int")).over(before), F.lit(0)) == 1, **{f"high_{t}": high[t] for t in TOKENS}})
    delta = F.struct(*[F.greatest(F.col(f"total.{t}") - F.col(f"high_{t}"), F.when(F.col(f"total.{t}").isNotNull(), F.lit(0).cast("bigint"))).alias(t) for t in TOKENS])
    fell = F.lit(False)
    for t in TOKENS:
        fell |= F.coalesce(F.col(f"total.{t}") < F.col(f"high_{t}"), F.lit(False))
    own = F.col("last").isNotNull()
    incomplete = ~own & (fell | (~F.col("started") & F.col("parent").isNotNull()))
    return rows.withColumns({"t": F.when(own, F.col("last")).otherwise(delta), "incomplete": incomplete.cast("int")}).drop("started", *(f"high_{t}" for t in TOKENS))


def mark_inherited(rows: DataFrame, known: DataFrame, meta_segment: tuple[str, ...], order: str) -> DataFrame:
    """Adds excluded, and orphan for rows whose parent isn't known. rows: legacy rows; known: ids of known threads.

    A row is inherited if its parent has its signature at or before the cutoff, and so have all rows of its segment before it. A
    child whose parent isn't known can't be told apart, so its rows are excluded and incomplete.
    """
    parents = rows.groupBy(F.col("thread_id").alias("_thread"), F.col("signature").alias("_signature")).agg(F.min("event_at").alias("_since"))
    found = rows.join(parents, (F.col("parent") == F.col("_thread")) & (F.col("signature") == F.col("_signature")), "left")
    found = found.join(known.select(F.col("id").alias("_id")).distinct(), F.col("parent") == F.col("_id"), "left")
    matched = F.coalesce(F.col("_since") <= F.coalesce("cutoff", "event_at"), F.lit(False))
    found = found.withColumn("_miss", (F.col("parent").isNotNull() & ~matched & F.col("_id").isNotNull()).cast("int"))
    so_far = Window.partitionBy(*meta_segment).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inherited = F.col("parent").isNotNull() & (F.max("_miss").over(so_far) == 0)
    lost = inherited & F.col("_id").isNull() & ~matched
    found = found.withColumn("excluded", inherited.cast("int")).withColumn("incomplete", F.greatest("incomplete", lost.cast("int"))).withColumn("orphan", lost.cast("int"))
    return found.drop("_thread", "_signature", "_since", "_id", "_miss")


def with_snapshots(rows: DataFrame) -> DataFrame:
    """Adds total and last, null on all lines but snapshots with a time, and limit."""
    usage = lambda name: F.when((F.col("type") == "event_msg") & F.col("at").isNotNull() & _is_object(F.col(f"p.info.{name}")), tokens(F.col(f"p.info.{name}")))
    return rows.withColumns({"total": usage("total_token_usage"), "last": usage("last_token_usage"), "limit": F.coalesce("p.rate_limits.limit_id", F.lit("default"))})


def _snapshot_rows(read: DataFrame) -> DataFrame:
    """Snapshots of running totals with their deltas; of repeated ones too."""
    rows = with_snapshots(read.where("type = 'event_msg' or s is not null")).withColumn("total", F.coalesce("total", F.when(F.col("s.started"), F.col("s.high"))))
    rows = rows.where("total is not null or last is not null or s is not null")
    return snapshot_deltas(rows, ("file", "chunk", "life"), "line_no", F.col("s")).where("s is null")


def legacy_events(read: DataFrame) -> DataFrame:
    """Events from snapshots of running totals, not yet judged for inheritance."""
    rows = _snapshot_rows(read).where(~F.col("repeated") & (F.col("t.total_tokens").isNull() | (F.col("t.total_tokens") != 0)))
    content = F.to_json(F.struct("thread", "turn", "at", "signature"), {"ignoreNullFields": "false"})
    return rows.select(
        "file", "line_no", F.concat(F.lit("legacy:"), F.sha2(content, 256)).alias("event_key"), F.col("thread").alias("thread_id"), F.col("turn").alias("turn_id"), F.lit(None).cast("string").alias("response_id"), F.col("at").alias("event_at"), "project", "model", "effort",
        F.lit("legacy").alias("kind"), "signature", "t.*", "incomplete", F.lit(0).alias("excluded"), "segment", "parent", F.col("edges.cutoff").alias("cutoff"),
    )


def issues_of(read: DataFrame) -> DataFrame:
    """file, line_no and issue of every line of carried() that can't be used as it is.

    json: no JSON; time: usage without a time; total: usage without a total; baseline: a running total that fell, or the first one of a task that has a parent.
    Snapshots whose parent isn't known are told by judging all files together: see orphans().
    """
    of = lambda rows, name: rows.select("file", "line_no", F.lit(name).alias("issue"))
    recorded = F.col("type") == "token_usage_record"
    timed = read.where(recorded | (F.col("type") == "event_msg"))
    explicit = timed.where(recorded & F.col("at").isNotNull() & tokens(F.col("p.usage"))["total_tokens"].isNull())
    snapshots = _snapshot_rows(read)
    found = of(read.where("type = 'bad'"), "json").unionByName(of(timed.where("at is null"), "time")).unionByName(of(explicit, "total"))
    return found.unionByName(of(snapshots.where("incomplete = 1"), "baseline")).unionByName(of(snapshots.where(~F.col("repeated") & F.col("t.total_tokens").isNull()), "total"))


def issues(lines: DataFrame) -> DataFrame:
    """issues_of() lines of whole files."""
    return issues_of(read_lines(lines))


def orphans(rows: DataFrame, threads: DataFrame) -> DataFrame:
    """file, line_no and issue of the snapshots of read_events() that can't be told from their parent's, which isn't known."""
    found = mark_inherited(rows.where("kind = 'legacy'"), threads, ("file", "segment"), "line_no")
    return found.where("orphan = 1").select("file", "line_no", F.lit("orphan").alias("issue"))


def read_events(read: DataFrame) -> DataFrame:
    """All events with what judging them needs: line_no, segment, parent and cutoff."""
    return explicit_events(read).unionByName(legacy_events(read), allowMissingColumns=True)


#: Events that a task sorts at once, about.
TASK_ROWS = 200_000


def judged(rows: DataFrame, threads: DataFrame, parts: int | None = None) -> DataFrame:
    """USAGE_EVENTS of read_events(): inherited rows excluded, and of a file's lines of one key the last. parts: into how many tasks they are dealt before they are sorted."""
    legacy = mark_inherited(rows.where("kind = 'legacy'"), threads, ("file", "segment"), "line_no")
    rows = rows.where("kind <> 'legacy'").unionByName(legacy.where("total_tokens is not null").select(*rows.columns))
    # else a task sorts all that it scans, or what compresses to a partition
    rows = rows.repartition("file", "event_key") if parts is None else rows.repartition(parts, "file", "event_key")
    last = Window.partitionBy("file", "event_key").orderBy(F.desc("line_no"))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").select(*USAGE_EVENTS.fieldNames())


def parse(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """USAGE_EVENTS and threads."""
    read = read_lines(lines)
    threads = threads_of(read)
    return judged(read_events(read), threads), threads
