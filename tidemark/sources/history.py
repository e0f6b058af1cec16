"""Histories made from parameters, whose totals are known before, as events and as logs.

Sessions spend tokens one after another, and days take so many each: on a line of all tokens a turn and a day are intervals, and every overlap of both is an event. So
a day's, a session's and a project's totals are what was asked for. Copies of a history have their own ids and are made side by side.
"""

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MILLION = 1_000_000


def split(total: int, parts: int) -> list[int]:
    """Equal parts, of which the last takes the rest."""
    return [total // parts] * (parts - 1) + [total // parts + total % parts]


@dataclass(frozen=True)
class History:
    """days: tokens of each day. projects: tokens of the sessions of each. opening: the first session's events, all on the last day: turn, model (0 or 1), tokens, output, minute.

    The first six sessions have four turns, others three, the first one its own; every fourth session takes the second model; parents: sessions that others were started by.
    """

    days: tuple[int, ...]
    projects: tuple[tuple[str, tuple[int, ...]], ...]
    opening: tuple[tuple[int, int, int, int, int], ...] = ()
    parents: tuple[tuple[int, int], ...] = ()
    first_day: dt.date = dt.date(2026, 9, 2)
    models: tuple[tuple[str, str], ...] = (("large", "high"), ("small", "medium"))


# What the example of the model's tests adds up to.
EXAMPLE = History(
    days=(8_200_000, 12_500_000, 18_400_000, 31_400_000, 16_200_000, 14_010_000, 18_500_000),
    projects=(
        ("/work/desk", (18_200_000, 12_600_000, 8_400_000, 9_400_000)),
        ("/work/api", tuple(split(35_200_000, 8))),
        ("/work/notes", tuple(split(21_410_000, 8))),
        ("/work/play", tuple(split(14_000_000, 8))),
    ),
    opening=(
        (1, 0, 3_600_000, 60_000, 0), (2, 0, 2_800_000, 60_000, 18), (3, 0, 3_200_000, 60_000, 36), (3, 1, 1_000_000, 20_000, 37), (4, 0, 3_100_000, 80_000, 54), (5, 1, 2_500_000, 60_000, 72), (6, 1, 2_000_000, 60_000, 90),
    ),
    parents=((2, 1), (3, 1), (4, 2)),
)


def events(spark: SparkSession, h: History = EXAMPLE, copies: int = 1) -> DataFrame:
    """copy, session, thread, parent, project, turn, model, effort, response, at and usage (input, cached, output, reasoning and total) of every event."""
    opened = sum(x[2] for x in h.opening)
    room = [*h.days[:-1], h.days[-1] - opened]
    sessions = [(p, total) for p, totals in h.projects for total in totals]
    if opened not in (0, sessions[0][1]) or sum(room) != sum(t for _, t in sessions) - opened:
        raise ValueError("days and sessions must have the same tokens")
    turns = [(s, p, t, tokens) for s, (p, total) in enumerate(sessions, 1) if s > 1 or not opened for t, tokens in enumerate(split(total, 4 if s <= 6 else 3), 1)]
    parents = F.create_map(*[F.lit(x) for pair in h.parents for x in pair]) if h.parents else F.create_map().cast("map<int, int>")
    base = spark.range(copies).withColumnRenamed("id", "copy")
    literal = lambda rows, names: F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows])
    # both lines of intervals begin with the first token after the opening
    ends = [sum(room[: k + 1]) for k in range(len(room))]
    days = literal([(k, end - size, end) for k, (size, end) in enumerate(zip(room, ends, strict=True)) if size], ("day", "low", "high"))
    spent, rows = 0, []
    for s, p, t, tokens in turns:
        rows.append((s, p, t, spent, spent + tokens))
        spent += tokens
    spends = base.select("copy", F.explode(literal(rows, ("session", "project", "turn", "from", "to"))).alias("x")).select("copy", "x.*", F.explode(days).alias("d")).where("d.low < `to` and d.high > `from`")
    total = F.least("to", "d.high") - F.greatest("from", "d.low")
    number = F.row_number().over(Window.partitionBy("copy").orderBy("session", "turn", "d.day")) + len(h.opening) - 1
    made = spends.select("copy", "session", "project", "turn", F.when(F.col("session") % 4 == 0, 1).otherwise(0).alias("m"), total.cast("long").alias("total"), F.floor(total / 150).alias("output"), F.col("d.day").alias("day"), ((number * 13) % 180).alias("minute"), number.alias("n"))
    if h.opening:
        first = [(1, sessions[0][0], t, m, tokens, output, len(h.days) - 1, minute, n) for n, (t, m, tokens, output, minute) in enumerate(h.opening)]
        made = made.unionByName(base.select("copy", F.explode(literal(first, ("session", "project", "turn", "m", "total", "output", "day", "minute", "n"))).alias("x")).select("copy", "x.*"))
    name = lambda s: F.concat(F.lit("session-"), F.when(F.col("copy") > 0, F.concat(F.col("copy").cast("string"), F.lit("-"))).otherwise(""), F.lpad(s.cast("string"), 2, "0"))
    model = lambda k: F.when(F.col("m") == 0, h.models[0][k]).otherwise(h.models[1][k])
    given = (F.col("total") - F.col("output")).cast("long")
    start = dt.datetime.combine(h.first_day, dt.time(5))
    at = F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(F.col("day"), F.lit(0), F.col("minute"))
    usage = F.struct(
        given.alias("input_tokens"), F.floor(given * 95 / 100).cast("long").alias("cached_input_tokens"), F.lit(0).cast("long").alias("cache_write_input_tokens"), F.col("output").cast("long").alias("output_tokens"),
        F.floor(F.col("output") / 5).cast("long").alias("reasoning_output_tokens"), F.col("total").cast("long").alias("total_tokens"),
    )
    parent = F.try_element_at(parents, F.col("session"))
    return made.select(
        "copy", "session", name(F.col("session")).alias("thread"), F.when(parent.isNotNull(), name(parent)).alias("parent"), "project", F.concat(F.lit("turn-"), F.lpad(F.col("turn").cast("string"), 2, "0")).alias("turn"),
        model(0).alias("model"), model(1).alias("effort"), F.concat_ws("-", F.lit("response"), "copy", "n").alias("response"), at.alias("at"), usage.alias("usage"),
    )


def event_lines(thread: Column, project: Column, turn: Column, model: Column, effort: Column, response: Column, at: Column, usage: Column, parent: Column | None = None) -> Column:
    """Of each event a session, a context and a record line, as one text: so logs may be cut and ordered in any way between events."""
    stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    line = lambda kind, **payload: F.to_json(F.struct(stamp.alias("timestamp"), F.lit(kind).alias("type"), F.struct(*[c.alias(n) for n, c in payload.items() if c is not None]).alias("payload")))
    spawned = None if parent is None else F.when(parent.isNotNull(), F.struct(F.struct(F.struct(parent.alias("parent_thread_id")).alias("thread_spawn")).alias("subagent")))
    return F.concat_ws("\n", line("session_meta", id=thread, cwd=project, source=spawned), line("turn_context", turn_id=turn, model=model, effort=effort), line("token_usage_record", response_id=response, usage=usage))


def write_logs(spark: SparkSession, path: str, h: History = EXAMPLE, copies: int = 1) -> None:
    """The history as log files (*.txt) below a folder, and its feed of titles below `path`-titles."""
    e = events(spark, h, copies)
    e.select(event_lines(*(F.col(c) for c in ("thread", "project", "turn", "model", "effort", "response", "at", "usage", "parent")))).write.text(path)
    title = F.to_json(F.struct(F.col("thread").alias("id"), F.concat(F.lit("Session "), F.col("session").cast("string")).alias("thread_name"), F.lit("2026-09-08T04:00:00Z").alias("updated_at")))
    e.select("thread", "session").distinct().select(title).write.text(f"{path}-titles")
