"""The queries by name, with the same results in SQL over the plain tables."""

import dataclasses
import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import plotted
from ..functions.stored import shared_dir
from ..functions.timebuckets import bucket
from ..operators.cost import price_table
from ..operators.filters import Filter
from ..operators.metrics import METRICS, combined, finished
from ..operators.parse import mark_inherited, snapshot_deltas
from ..operators.reconcile import effective, without_mirrors
from ..operators.rollup import roll_up
from ..operators.search import TextIndex
from ..schema import TOKENS
from ..sources import account, history
from ..sources.adapters import EVENT_COLUMNS, events_from_chats, events_from_lines, events_from_stream, threads_from_stream
from ..streaming.refresh import Store
from .queries import RolledUsage, Usage

NEW_YORK, SHANGHAI, BERLIN = "America/New_York", "Asia/Shanghai", "Europe/Berlin"
DAY = dt.datetime(2024, 1, 10)
WEEK = Filter(start=DAY, end=DAY + dt.timedelta(days=7))
#: Not made of whole quarter hours.
RAGGED = Filter(start=dt.datetime(2024, 1, 10, 10, 7, 30), end=dt.datetime(2024, 1, 16, 21, 52, 10))
#: Per million tokens; the threshold is low enough for both tiers to occur, and one model has no price.
PRICES = (
    ("click", "10", "1", "12.5", "50", 5000, "20", "2", "25", "75"),
    ("view", "4", "0.4", "5", "20", 5000, "8", "0.8", "10", "30"),
    ("purchase", "2", "0.2", None, "12", None, None, None, None, None),
)

_EFFECTIVE = f"""
usage_events AS (
  SELECT {EVENT_COLUMNS} FROM (SELECT *, cast(json_extract_string(props, '$.k') AS bigint) AS k, round(value * 100) AS v FROM events)
), unmirrored AS (
  SELECT * FROM usage_events e WHERE excluded = 0 AND NOT (kind = 'legacy' AND turn_id IS NOT NULL AND EXISTS (
    SELECT 1 FROM usage_events x WHERE x.excluded = 0 AND x.kind = 'record' AND x.thread_id = e.thread_id AND x.turn_id = e.turn_id))
), effective AS (
  SELECT * FROM unmirrored QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY incomplete, file) = 1
)"""
_LOGGED = """
logged AS (
  SELECT concat('t', user_id) AS thread_id, concat('u', day(ts)) AS turn_id, date_trunc('millisecond', ts) AS event_at, concat('/work/p', k % 6) AS project, event_type AS model,
    CASE WHEN k % 3 = 0 THEN 'low' ELSE 'high' END AS effort, 'record' AS kind, v AS input_tokens, v // 2 AS cached_input_tokens, cast(NULL AS bigint) AS cache_write_input_tokens, k * 10 AS output_tokens,
    cast(NULL AS bigint) AS reasoning_output_tokens, v + k * 10 AS total_tokens, 0 AS incomplete
  FROM (SELECT *, cast(json_extract_string(props, '$.k') AS bigint) AS k, cast(round(value * 100) AS bigint) AS v FROM events)
)"""
_THREADS = """
threads AS (
  SELECT concat('t', u) AS id, CASE WHEN u > 0 THEN concat('t', (u - 1) // 2) END AS subagent_parent_id,
    CASE WHEN u > 0 AND u % 10 = 0 THEN 't0' END AS forked_from_id, CASE WHEN u % 9 <> 0 THEN concat('Task ', u) END AS title
  FROM (SELECT DISTINCT user_id AS u FROM events)
)"""
_LINES = """
lines AS (
  SELECT cast(l_orderkey AS varchar) AS thread_id, cast(l_linenumber AS varchar) AS turn_id, l_shipdate + to_hours(l_orderkey % 24) AS event_at,
    p_brand AS project, l_returnflag AS model, l_linestatus AS effort, 'record' AS kind, cents AS input_tokens, cents // 2 AS cached_input_tokens,
    0 AS cache_write_input_tokens, cast(l_quantity AS bigint) AS output_tokens, 0 AS reasoning_output_tokens, cents + cast(l_quantity AS bigint) AS total_tokens, 0 AS incomplete
  FROM (SELECT *, cast(round(l_extendedprice * 100) AS bigint) AS cents FROM lineitem) JOIN part ON p_partkey = l_partkey
)"""
_CHATS = """
chats AS (
  SELECT concat('c', conv_id) AS thread_id, cast(turn AS varchar) AS turn_id, timestamp '2024-01-01' + to_days(cast(conv_id % 300 AS int)) AS event_at, length(text) AS total_tokens, text, role, turn
  FROM conversations
), titles AS (
  SELECT concat('c', conv_id) AS id, left(arg_min(text, turn), 40) AS title FROM conversations WHERE role = 'user' GROUP BY conv_id
)"""


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} <> 0 THEN cast(sign({a}) * (abs(cast({a} AS hugeint)) * 1000000 // abs({b})) AS double) / 1000000.0 END"


_PAIRED = "cached_input_tokens <= input_tokens"
_METRICS = f"""
  {', '.join(f'cast(CASE WHEN count(*) = 0 THEN 0 ELSE sum({t}) END AS bigint) AS {t}' for t in TOKENS)},
  cast(CASE WHEN count(*) = count(*) FILTER (WHERE input_tokens >= cached_input_tokens AND cached_input_tokens >= 0) THEN coalesce(sum(input_tokens - cached_input_tokens), 0) END AS bigint) AS uncached_input_tokens,
  cast(CASE WHEN count(*) = count(*) FILTER (WHERE input_tokens >= cached_input_tokens + cache_write_input_tokens AND cached_input_tokens >= 0 AND cache_write_input_tokens >= 0)
    THEN coalesce(sum(input_tokens - cached_input_tokens - cache_write_input_tokens), 0) END AS bigint) AS ordinary_input_tokens,
  count(*) FILTER (WHERE cache_write_input_tokens IS NULL) AS cache_write_missing_events,
  count(*) AS event_count, count(DISTINCT thread_id) AS thread_count,
  count(DISTINCT CASE WHEN turn_id IS NOT NULL THEN (thread_id, turn_id) END) AS turn_count,
  {_ratio(f'sum(cached_input_tokens) FILTER (WHERE {_PAIRED})', f'sum(input_tokens) FILTER (WHERE {_PAIRED})')} AS cache_ratio,
  cast(coalesce(sum(incomplete), 0) AS bigint) AS incomplete_events"""
_NAMES = ", ".join(METRICS)
_RAGGED = f"event_at >= timestamp '{RAGGED.start}' AND event_at < timestamp '{RAGGED.end}'"
_WEEK = f"event_at >= timestamp '{WEEK.start}' AND event_at < timestamp '{WEEK.end}'"


def _there(zone: str) -> str:
    return f"timezone('{zone}', timezone('UTC', event_at))"


def _day(zone: str) -> str:
    return f"strftime({_there(zone)}, '%Y-%m-%d')"


def _hour(zone: str) -> str:
    minutes = f"cast((epoch({_there(zone)}) - epoch(event_at)) / 60 AS bigint)"
    return f"strftime({_there(zone)}, '%Y-%m-%dT%H') || ':00:00.000' || CASE WHEN {minutes} < 0 THEN '-' ELSE '+' END || lpad(cast(abs({minutes}) // 60 AS varchar), 2, '0') || ':' || lpad(cast(abs({minutes}) % 60 AS varchar), 2, '0')"


def _day_start(zone: str) -> str:
    return f"timezone('UTC', timezone('{zone}', date_trunc('day', {_there(zone)})))"


def _hour_start(zone: str) -> str:
    return f"event_at - ({_there(zone)} - date_trunc('hour', {_there(zone)}))"


def _usage(spark: SparkSession, d: str, zone: str = "UTC", priced: bool = False) -> Usage:
    return Usage(effective(events_from_stream(spark, d)), threads_from_stream(spark, d), price_table(spark, PRICES) if priced else None, zone)


def _lines(spark: SparkSession, d: str, zone: str) -> Usage:
    return Usage(events_from_lines(spark, d), None, None, zone)


def _chats(spark: SparkSession, d: str) -> Usage:
    return Usage(*events_from_chats(spark, d))


def _composed(turns: DataFrame) -> DataFrame:
    """The composition as a text, for comparison."""
    one = lambda x: F.concat_ws(":", F.coalesce(x["model"], F.lit("-")), F.coalesce(x["effort"], F.lit("-")), F.coalesce(x["total_tokens"].cast("string"), F.lit("-")))
    return turns.select("thread_id", "turn_id", "total_tokens", "event_count", F.array_join(F.transform("composition", one), ",").alias("parts"))


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The stream as snapshots of running totals per user: every seventh falls, and own counts are missing in every third."""
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "ts", F.round(F.col("value") * 100).cast("bigint").alias("v"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = F.row_number().over(order)
    run = F.sum("v").over(order.rowsBetween(Window.unboundedPreceding, 0))
    total = F.when(n % 7 == 0, F.floor(run / 2)).otherwise(run).cast("bigint")
    counts = lambda c: F.struct(*[(c if t in ("input_tokens", "total_tokens") else F.lit(None).cast("bigint")).alias(t) for t in TOKENS])
    return rows.select("event_id", "user_id", "ts", n.alias("n"), counts(total).alias("total"), F.when(n % 3 != 0, counts(F.col("v"))).alias("last"), F.lit("default").alias("limit"), F.lit(None).cast("string").alias("parent"))


def legacy_high_water(spark: SparkSession, d: str) -> DataFrame:
    rows = snapshot_deltas(_snapshots(spark, d), ("user_id",), "n")
    return rows.select("event_id", "user_id", "n", "repeated", "incomplete", F.col("t.input_tokens").alias("input_tokens"), F.col("t.total_tokens").alias("total_tokens"))


def inherited_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Each user u > 0 as a child of user (u - 1) / 2, with the event's type and k as its signature; known are users under 100."""
    e = spark.read.parquet(f"{d}/events.parquet")
    u = F.col("user_id")
    rows = e.select(
        "event_id", F.col("user_id").alias("file"), F.concat(F.lit("t"), u.cast("string")).alias("thread_id"), F.concat_ws(":", "event_type", F.get_json_object("props", "$.k")).alias("signature"), F.col("ts").cast("timestamp_ntz").alias("event_at"),
        F.when(u > 0, F.concat(F.lit("t"), F.floor((u - 1) / 2).cast("string"))).alias("parent"), F.lit(dt.datetime(2024, 1, 20)).cast("timestamp_ntz").alias("cutoff"), F.lit(0).alias("incomplete"), F.struct("ts", "event_id").alias("at"),
    )
    known = e.where("user_id < 100").select(F.concat(F.lit("t"), u.cast("string")).alias("id"))
    return mark_inherited(rows, known, ("file",), "at").select("event_id", "thread_id", "excluded", "incomplete")


def _rolled(spark: SparkSession, d: str, zone: str = "UTC") -> RolledUsage:
    events = effective(events_from_stream(spark, d))
    return RolledUsage(events, threads_from_stream(spark, d), None, zone, roll_up(events))


def write_logs(spark: SparkSession, d: str, path: str) -> None:
    """The stream as logs: of each event a session, a context and a record line, as some producer might write them."""
    e = spark.read.parquet(f"{d}/events.parquet")
    k, v, u = F.get_json_object("props", "$.k").cast("bigint"), F.round(F.col("value") * 100).cast("bigint"), F.col("user_id").cast("string")
    text = lambda c: c.cast("string")
    usage = F.struct(v.alias("input_tokens"), F.floor(v / 2).alias("cached_input_tokens"), (k * 10).alias("output_tokens"), (v + k * 10).alias("total_tokens"))
    lines = history.event_lines(
        F.concat(F.lit("t"), u), F.concat(F.lit("/work/p"), text(k % 6)), F.concat(F.lit("u"), text(F.dayofmonth("ts"))), F.col("event_type"), F.when(k % 3 == 0, "low").otherwise("high"), text(F.col("event_id")),
        F.col("ts").cast("timestamp_ntz"), usage,
    )
    e.select(lines).write.text(path)


def _stored(spark: SparkSession, d: str, zone: str, start: dt.datetime, end: dt.datetime) -> RolledUsage:
    """Through logs and a store: written, read by ranges, judged, kept by day and rolled up."""
    place = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    write_logs(spark, d, f"{place}/logs")
    store = Store(spark, f"{place}/store")
    store.refresh([f"{place}/logs"], 1, pattern="*.txt")
    return store.usage(start, end, zone=zone)


def _indexed(usage: Usage) -> Usage:
    """With an index of its texts, written before."""
    return dataclasses.replace(usage, index=TextIndex.write(f"{shared_dir(usage.events.sparkSession)}/{uuid.uuid4().hex}", usage.events, usage.threads))


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """A quota payload per customer, with missing and excessive numbers."""
    c, k = spark.read.parquet(f"{d}/customer.parquet"), F.col("c_custkey")
    used = F.when(k % 5 != 0, (k * 7) % 130)
    one = lambda n: F.to_json(F.struct(F.struct(n.alias("used_percent"), ((k % 9) * 3600).alias("limit_window_seconds"), (k * 1000).alias("reset_at")).alias("primary_window")))
    more = F.when(k % 3 == 0, F.concat(F.lit(', "additional_rate_limits": [{"limit_name": "extra", "metered_feature": "f", "rate_limit": '), one(used / 2), F.lit("}]"))).otherwise("")
    return c.select(k.cast("string").alias("account_id"), F.concat(F.lit('{"rate_limit": '), one(used), more, F.lit("}")).alias("data"))


def quota_windows(spark: SparkSession, d: str) -> DataFrame:
    found = account.limits(_payloads(spark, d), "http")
    return found.select("account_id", "id", "name", *(F.col(f"primary.{c}").alias(c) for c in ("used_percent", "remaining_percent", "window_minutes", "resets_at")), F.col("secondary").isNull().alias("no_secondary"))


def latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    rows = e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("identity_key"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp_ntz").alias("at"), F.col("props").alias("data"))
    return account.latest_snapshots(rows)


def daily_trend_by_model(spark: SparkSession, d: str) -> DataFrame:
    rows = effective(events_from_stream(spark, d))
    return combined(rows, {"time": bucket(F.col("event_at"), NEW_YORK, "day"), "model": F.col("model")}).select("time", "model", *finished())


def _groups_sql(column: str, where: str = "true", label: str | None = None) -> str:
    name = label or f"coalesce(nullif({column}, ''), 'unknown')"
    return f"""WITH {_EFFECTIVE}, chosen AS (SELECT * FROM effective WHERE {where}), g AS (SELECT {column} AS key, {_METRICS} FROM chosen GROUP BY 1)
      SELECT key, {name.replace(column, 'key')} AS label, {_ratio('total_tokens', '(SELECT cast(sum(total_tokens) AS bigint) FROM chosen)')} AS share, {_NAMES} FROM g
      ORDER BY total_tokens DESC NULLS LAST, key ASC NULLS FIRST"""


_PATH_LABEL = "coalesce(regexp_extract(project, '([^/]+)/*$', 1), 'unknown')"


def _trend_sql(rows: str, name: str, start: str, where: str = "true") -> str:
    return f"SELECT {name} AS time, min({start}) AS bucket_start_utc, {_METRICS} FROM {rows} WHERE {where} GROUP BY 1"


def _threads_sql(where: str, having: str, order: str, limit: str) -> str:
    return f"""WITH {_EFFECTIVE}, {_THREADS}, g AS (
      SELECT thread_id, min(project) AS project, min(event_at) AS first_at, max(event_at) AS last_at, {_METRICS},
        sum(cached_input_tokens) FILTER (WHERE {_PAIRED}) AS pc, sum(input_tokens) FILTER (WHERE {_PAIRED}) AS pi FROM effective WHERE {where} GROUP BY thread_id)
      SELECT thread_id, project, first_at, last_at, {_NAMES}, title FROM g LEFT JOIN threads ON id = thread_id WHERE {having} ORDER BY {order} {limit}"""


def _turns_sql(where: str, order: str, limit: str) -> str:
    return f"""WITH {_EFFECTIVE}, {_THREADS}, g AS (
      SELECT thread_id, turn_id, min(event_at) AS first_at, max(event_at) AS last_at, min(project) AS project, {_METRICS} FROM effective WHERE {where} GROUP BY thread_id, turn_id)
      SELECT thread_id, turn_id, {_NAMES}, first_at, last_at, project, title FROM g LEFT JOIN threads ON id = thread_id ORDER BY {order} {limit}"""


def _compare_sql(column: str, label: str) -> str:
    return f"""WITH {_EFFECTIVE}, a AS (SELECT {column} AS key, sum(total_tokens) AS n FROM effective WHERE {_WEEK} GROUP BY 1),
      b AS (SELECT {column} AS key, sum(total_tokens) AS n FROM effective WHERE event_at >= timestamp '{WEEK.start - dt.timedelta(days=7)}' AND event_at < timestamp '{WEEK.start}' GROUP BY 1),
      j AS (SELECT coalesce(a.key, b.key) AS key, cast(coalesce(a.n, 0) AS bigint) AS current, cast(coalesce(b.n, 0) AS bigint) AS previous FROM a FULL JOIN b ON a.key IS NOT DISTINCT FROM b.key)
      SELECT key, {label} AS label, current, previous, current - previous AS delta, {_ratio('(current - previous)', 'previous')} AS change_ratio FROM j"""


_TREE = """tree AS (
  SELECT id, [id] AS path FROM threads WHERE id = 't2'
  UNION ALL SELECT e.id, list_append(t.path, e.id) FROM tree t JOIN threads e ON e.subagent_parent_id = t.id WHERE NOT list_contains(t.path, e.id))"""


def _micro(price: str | None) -> str:
    if price is None:
        return "NULL"
    whole, _, part = price.partition(".")
    return str(int(whole) * 10**6 + int(part.ljust(6, "0")))


_PRICES = ", ".join(f"('{r[0]}', {', '.join(_micro(x) for x in r[1:5])}, {r[5] or 'NULL'}, {', '.join(_micro(x) for x in r[6:])})" for r in PRICES)


def _cost_sql(key: str | None, select: str) -> str:
    """Per key: amount, complete and the number of notes."""
    k, group = (f"{key} AS k,", "k") if key else ("", "")
    comma = ", " if group else ""
    known = lambda tokens, rate: f"({tokens} = 0 OR ({tokens} IS NOT NULL AND {rate} IS NOT NULL))"
    gap = lambda tokens, rate, name: f"CASE WHEN coalesce({tokens} = 0, false) OR ({tokens} IS NOT NULL AND {rate} IS NOT NULL) THEN NULL ELSE model || '{name}' END"
    terms = (("uncached", "r_in"), ("cached", "r_cached"), ("output", "r_out"))
    value = " + ".join(f"coalesce(cast({t} AS hugeint) * {r}, 0)" for t, r in terms)
    notes = ", ".join(
        [
            *(gap(t, r, t) for t, r in terms),
            "CASE WHEN extra AND (r_write IS NULL OR r_in IS NULL) THEN model || 'write' END",
            "CASE WHEN missing_write > 0 THEN 'w' END", "CASE WHEN missing_usage > 0 THEN 'u' END", "CASE WHEN invalid > 0 THEN 'i' END", "CASE WHEN legacy > 0 THEN 'l' END",
        ]
    )
    return f"""WITH {_EFFECTIVE}, prices (pm, i0, c0, w0, o0, over_, i1, c1, w1, o1) AS (VALUES {_PRICES}),
      tiered AS (SELECT e.*, coalesce(input_tokens > over_, false) AS long FROM effective e LEFT JOIN prices ON pm = model),
      s AS (SELECT {k} model, long, CASE WHEN count(*) = count(*) FILTER (WHERE input_tokens >= cached_input_tokens AND cached_input_tokens >= 0) THEN sum(input_tokens - cached_input_tokens) END AS uncached,
        sum(cached_input_tokens) AS cached, sum(output_tokens) AS output, sum(cache_write_input_tokens) AS written, count(*) FILTER (WHERE cache_write_input_tokens IS NULL) AS missing_write,
        count(*) FILTER (WHERE input_tokens IS NULL OR cached_input_tokens IS NULL OR output_tokens IS NULL) AS missing_usage,
        count(*) FILTER (WHERE input_tokens < cached_input_tokens + coalesce(cache_write_input_tokens, 0)) AS invalid, count(*) FILTER (WHERE kind <> 'record') AS legacy
        FROM tiered GROUP BY {group}{comma}model, long),
      r AS (SELECT s.*, pm, CASE WHEN long THEN i1 ELSE i0 END AS r_in, CASE WHEN long THEN c1 ELSE c0 END AS r_cached, CASE WHEN long THEN w1 ELSE w0 END AS r_write, CASE WHEN long THEN o1 ELSE o0 END AS r_out,
        coalesce(uncached IS NOT NULL AND invalid = 0 AND written <> 0, false) AS extra FROM s LEFT JOIN prices ON pm = model),
      p AS (SELECT {group}{comma}CASE WHEN pm IS NULL THEN 0 ELSE {value} + CASE WHEN extra THEN coalesce(cast(written AS hugeint) * (r_write - r_in), 0) ELSE 0 END END AS value,
        pm IS NOT NULL AND (coalesce({' , false) OR coalesce('.join(known(t, r) for t, r in terms)}, false) OR (extra AND r_write IS NOT NULL AND r_in IS NOT NULL)) AS known,
        CASE WHEN pm IS NULL THEN ['none' || coalesce(model, '')] ELSE list_filter([{notes}], lambda x: x IS NOT NULL) END AS notes FROM r),
      f AS (SELECT {group}{comma}sum(value) AS value, bool_or(known) AS known, len(list_distinct(flatten(list(notes)))) AS n FROM p {'GROUP BY k' if key else ''})
      SELECT {select} CASE WHEN known THEN CASE WHEN value < 0 THEN '-' ELSE '' END || cast(abs(cast(value AS hugeint)) // 1000000000000 AS varchar) || '.' || lpad(cast(abs(cast(value AS hugeint)) % 1000000000000 AS varchar), 12, '0') END AS cost_amount,
        n = 0 AS cost_complete, cast(n AS int) AS cost_notes FROM f"""


def _costs_only(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, "cost_amount", "cost_complete", F.size("cost_notes").alias("cost_notes"))


def queries() -> dict:
    u = _usage
    return {
        "daily_trend_by_model": daily_trend_by_model,
        "effective_dedup": lambda s, d: effective(events_from_stream(s, d)).select("event_key", "file", "thread_id", "turn_id", "kind", "incomplete", "total_tokens"),
        "effective_precedence": lambda s, d: without_mirrors(events_from_stream(s, d).where("excluded = 0")).groupBy("file", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("total_tokens").alias("total_tokens")),
        "summary": lambda s, d: u(s, d).summary(),
        "summary_filtered": lambda s, d: u(s, d).summary(WEEK.but(model="click", effort="low")),
        "summary_unknown": lambda s, d: u(s, d).summary(Filter(unknown={"project", "model"})),
        "summary_empty": lambda s, d: u(s, d).summary(Filter(start=dt.datetime(2050, 1, 1))),
        "trend_day_ny": lambda s, d: u(s, d, NEW_YORK).trend(),
        "trend_day_shanghai": lambda s, d: u(s, d, SHANGHAI).trend(),
        "trend_hour_ny": lambda s, d: u(s, d, NEW_YORK).trend(WEEK, "hour"),
        "trend_day_ny_years": lambda s, d: _lines(s, d, NEW_YORK).trend(),
        "trend_hour_berlin_years": lambda s, d: _lines(s, d, BERLIN).trend(size="hour"),
        "trend_gapfill": lambda s, d: u(s, d, NEW_YORK).trend_filled(WEEK.but(thread="t3"), "hour"),
        "trend_gapfill_fold": lambda s, d: _lines(s, d, NEW_YORK).trend_filled(Filter(start=dt.datetime(1996, 10, 25), end=dt.datetime(1996, 10, 29), effort="F"), "hour"),
        "breakdown_project": lambda s, d: u(s, d).breakdown(by="project"),
        "breakdown_model": lambda s, d: u(s, d).breakdown(WEEK, by="model"),
        "breakdown_effort": lambda s, d: u(s, d).breakdown(by="effort"),
        "breakdown_thread": lambda s, d: u(s, d).breakdown(by="thread", limit=200),
        "breakdown_page": lambda s, d: u(s, d).breakdown(by="project", limit=3, offset=2),
        "threads_top": lambda s, d: u(s, d).threads_page(limit=20),
        "threads_recent": lambda s, d: u(s, d).threads_page(WEEK, limit=20, offset=5, sort="recent"),
        "threads_low_cache": lambda s, d: u(s, d).threads_page(Filter(effort="low"), limit=50, cache_below=0.5),
        "threads_search": lambda s, d: u(s, d).threads_page(q=" TASK 1", limit=100),
        "threads_search_titles": lambda s, d: _chats(s, d).threads_page(q="Ti", limit=100).select("thread_id", "title", "total_tokens", "turn_count"),
        "indexed_threads_search": lambda s, d: _indexed(u(s, d)).threads_page(q=" TASK 1", limit=100),
        "indexed_search_titles": lambda s, d: _indexed(_chats(s, d)).threads_page(q="Ti", limit=100).select("thread_id", "title", "total_tokens", "turn_count"),
        "threads_count": lambda s, d: u(s, d).count_threads(WEEK),
        "turns_global": lambda s, d: u(s, d).turns(limit=100).drop("composition"),
        "turns_oldest": lambda s, d: u(s, d).thread_turns("t5", limit=100).drop("composition"),
        "turns_missing": lambda s, d: u(s, d).turns(Filter(turn=None), limit=200, sort="recent").drop("composition"),
        "turn_composition": lambda s, d: _composed(u(s, d).turns(WEEK, limit=200)),
        "filter_values": lambda s, d: u(s, d).filter_values(),
        "compare_project": lambda s, d: u(s, d).compare(WEEK, "project"),
        "compare_thread": lambda s, d: u(s, d).compare(WEEK, "thread"),
        "threads_count_low_cache": lambda s, d: u(s, d).count_threads(Filter(effort="low"), cache_below=0.5),
        "turns_count": lambda s, d: u(s, d).count_turns(WEEK),
        "compare_summaries": lambda s, d: u(s, d).compare_summaries(WEEK),
        "agents_tree": lambda s, d: u(s, d).agents("t2", WEEK).withColumns({"path": F.array_join("path", "/"), "models": F.array_join("models", ",", "-")}),
        "agents_cost": lambda s, d: _costs_only(u(s, d, priced=True).agents("t2"), "id"),
        "thread_models": lambda s, d: u(s, d).models("t10"),
        "thread_detail_cost": lambda s, d: _costs_only(u(s, d, priced=True).detail("t10")),
        "threads_page_cost": lambda s, d: _costs_only(u(s, d, priced=True).threads_page(limit=30, offset=10), "thread_id"),
        "trend_plotted": lambda s, d: u(s, d).trend().select("time", plotted(F.col("total_tokens")).alias("millions")),
        "agents_team": lambda s, d: u(s, d).team("t2", Filter(model="view", thread="t99")),
        "thread_detail": lambda s, d: u(s, d).detail("t10").drop("source", "parent_id"),
        "thread_related": lambda s, d: u(s, d).related("t10"),
        "cost_summary": lambda s, d: _costs_only(u(s, d, priced=True).summary()),
        "cost_by_model": lambda s, d: _costs_only(u(s, d, priced=True).groups(Filter(), "model"), "key"),
        "cost_trend": lambda s, d: _costs_only(u(s, d, NEW_YORK, priced=True).trend(), "time"),
        "legacy_high_water": legacy_high_water,
        "inherited_prefix": inherited_prefix,
        "quota_windows": quota_windows,
        "latest_snapshot": latest_snapshot,
        "cost_by_thread": lambda s, d: _costs_only(u(s, d, priced=True).groups(Filter(), "thread"), "key"),
        "rolled_summary": lambda s, d: _rolled(s, d).summary(RAGGED.but(model="click")),
        "rolled_trend_hour_ny": lambda s, d: _rolled(s, d, NEW_YORK).trend(RAGGED, "hour"),
        "rolled_breakdown": lambda s, d: _rolled(s, d).breakdown(RAGGED, by="thread", limit=200),
        "rolled_turns": lambda s, d: _rolled(s, d).turns(RAGGED, limit=100).drop("composition"),
        "stored_trend_day_ny": lambda s, d: _stored(s, d, NEW_YORK, WEEK.start, WEEK.end).trend(WEEK),
        "stored_breakdown": lambda s, d: _stored(s, d, "UTC", WEEK.start, WEEK.end).breakdown(WEEK, by="project"),
    }


def oracle_sql() -> dict[str, str]:
    e = f"WITH {_EFFECTIVE} "
    summary = lambda where: f"{e} SELECT {_METRICS} FROM effective WHERE {where}"
    ny_hour = f"""WITH {_EFFECTIVE}, found AS ({_trend_sql('effective', _hour(NEW_YORK), _hour_start(NEW_YORK), _WEEK + " AND thread_id = 't3'")}),
      ticks AS (SELECT {_hour(NEW_YORK)} AS time, event_at AS bucket_start_utc FROM (SELECT unnest(generate_series(timestamp '{WEEK.start}', timestamp '{WEEK.end}' - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS event_at))"""
    fold = f"""WITH {_LINES}, found AS ({_trend_sql('lines', _hour(NEW_YORK), _hour_start(NEW_YORK), "event_at >= timestamp '1996-10-25' AND event_at < timestamp '1996-10-29' AND effort = 'F'")}),
      ticks AS (SELECT {_hour(NEW_YORK)} AS time, event_at AS bucket_start_utc FROM (SELECT unnest(generate_series(timestamp '1996-10-25', timestamp '1996-10-29' - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS event_at))"""
    searched = _threads_sql("contains(lower(thread_id), 'task 1') OR contains(lower(coalesce(project, '')), 'task 1') OR thread_id IN (SELECT id FROM threads WHERE contains(lower(title), 'task 1'))", "true", "total_tokens DESC NULLS LAST, thread_id", "LIMIT 100")
    searched_titles = f"""WITH {_CHATS} SELECT thread_id, any_value(title) AS title, cast(sum(total_tokens) AS bigint) AS total_tokens, count(DISTINCT turn_id) AS turn_count FROM chats LEFT JOIN titles ON id = thread_id
          WHERE contains(thread_id, 'ti') OR contains(translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'ti') GROUP BY thread_id ORDER BY total_tokens DESC, thread_id LIMIT 100"""
    filled = f" SELECT t.time, t.bucket_start_utc, {', '.join(f'CASE WHEN f.time IS NULL THEN 0 ELSE f.{m} END AS {m}' if m != 'cache_ratio' else 'f.cache_ratio' for m in METRICS)}, f.time IS NOT NULL AS has_records FROM ticks t LEFT JOIN found f USING (time)"
    return {
        "daily_trend_by_model": f"{e} SELECT {_day(NEW_YORK)} AS time, model, {_METRICS} FROM effective GROUP BY 1, 2",
        "effective_dedup": f"{e} SELECT event_key, file, thread_id, turn_id, kind, incomplete, total_tokens FROM effective",
        "effective_precedence": f"{e} SELECT file, kind, count(*) AS n, cast(sum(total_tokens) AS bigint) AS total_tokens FROM unmirrored GROUP BY 1, 2",
        "summary": summary("true"),
        "summary_filtered": summary(f"{_WEEK} AND model = 'click' AND effort = 'low'"),
        "summary_unknown": summary("project IS NULL AND model IS NULL"),
        "summary_empty": summary("event_at >= timestamp '2050-01-01'"),
        "trend_day_ny": e + _trend_sql("effective", _day(NEW_YORK), _day_start(NEW_YORK)),
        "trend_day_shanghai": e + _trend_sql("effective", _day(SHANGHAI), _day_start(SHANGHAI)),
        "trend_hour_ny": e + _trend_sql("effective", _hour(NEW_YORK), _hour_start(NEW_YORK), _WEEK),
        "trend_day_ny_years": f"WITH {_LINES} " + _trend_sql("lines", _day(NEW_YORK), _day_start(NEW_YORK)),
        "trend_hour_berlin_years": f"WITH {_LINES} " + _trend_sql("lines", _hour(BERLIN), _hour_start(BERLIN)),
        "trend_gapfill": ny_hour + filled,
        "trend_gapfill_fold": fold + filled,
        "breakdown_project": _groups_sql("project", label=_PATH_LABEL) + " LIMIT 50",
        "breakdown_model": _groups_sql("model", _WEEK) + " LIMIT 50",
        "breakdown_effort": _groups_sql("effort") + " LIMIT 50",
        "breakdown_thread": _groups_sql("thread_id") + " LIMIT 200",
        "breakdown_page": _groups_sql("project", label=_PATH_LABEL) + " LIMIT 3 OFFSET 2",
        "threads_top": _threads_sql("true", "true", "total_tokens DESC NULLS LAST, thread_id", "LIMIT 20"),
        "threads_recent": _threads_sql(_WEEK, "true", "last_at DESC, thread_id", "LIMIT 20 OFFSET 5"),
        "threads_low_cache": _threads_sql("effort = 'low'", "pi > 0 AND cast(pc AS double) / cast(pi AS double) < 0.5", "total_tokens DESC NULLS LAST, thread_id", "LIMIT 50"),
        **dict.fromkeys(("threads_search", "indexed_threads_search"), searched),
        **dict.fromkeys(("threads_search_titles", "indexed_search_titles"), searched_titles),
        "threads_count": f"{e} SELECT count(DISTINCT thread_id) AS total FROM effective WHERE {_WEEK}",
        "turns_global": _turns_sql("true", "total_tokens DESC NULLS LAST, thread_id, turn_id NULLS FIRST", "LIMIT 100"),
        "turns_oldest": _turns_sql("thread_id = 't5'", "first_at, thread_id, turn_id NULLS FIRST", "LIMIT 100"),
        "turns_missing": _turns_sql("turn_id IS NULL", "last_at DESC, thread_id", "LIMIT 200"),
        "turn_composition": f"""WITH {_EFFECTIVE}, each AS (SELECT thread_id, turn_id, model, effort, sum(total_tokens) AS t, count(*) AS n FROM effective WHERE {_WEEK} GROUP BY ALL)
          SELECT thread_id, turn_id, cast(sum(t) AS bigint) AS total_tokens, cast(sum(n) AS bigint) AS event_count,
          string_agg(coalesce(model, '-') || ':' || coalesce(effort, '-') || ':' || coalesce(cast(t AS varchar), '-'), ',' ORDER BY t DESC NULLS LAST, model NULLS FIRST, effort NULLS FIRST) AS parts
          FROM each GROUP BY thread_id, turn_id ORDER BY total_tokens DESC NULLS LAST, thread_id, turn_id NULLS FIRST LIMIT 200""",
        "filter_values": f"{e} SELECT DISTINCT dimension, value FROM (SELECT 'project' AS dimension, project AS value FROM effective UNION ALL SELECT 'model', model FROM effective UNION ALL SELECT 'effort', effort FROM effective) WHERE value IS NOT NULL",
        "compare_project": _compare_sql("project", _PATH_LABEL.replace("project", "key")),
        "compare_thread": _compare_sql("thread_id", "key"),
        "agents_tree": f"""WITH RECURSIVE {_EFFECTIVE}, {_THREADS}, {_TREE}, g AS (SELECT thread_id, {_METRICS} FROM effective WHERE {_WEEK} GROUP BY thread_id),
          m AS (SELECT thread_id AS mt, string_agg(coalesce(model, '-'), ',' ORDER BY model NULLS FIRST) AS models FROM (SELECT DISTINCT thread_id, model FROM effective WHERE {_WEEK}) GROUP BY thread_id)
          SELECT tree.id, cast(len(path) - 1 AS int) AS depth, array_to_string(path, '/') AS path, title, subagent_parent_id AS parent_id, cast(NULL AS varchar) AS project, coalesce(models, '') AS models, {', '.join(f'CASE WHEN thread_id IS NULL THEN 0 ELSE {m} END AS {m}' if m != 'cache_ratio' else m for m in METRICS)}
          FROM tree LEFT JOIN g ON thread_id = tree.id LEFT JOIN m ON mt = tree.id LEFT JOIN threads ON threads.id = tree.id""",
        "agents_cost": f"""WITH RECURSIVE {_THREADS}, {_TREE} SELECT id, coalesce(cost_amount, CASE WHEN c.id2 IS NULL THEN '0.000000000000' END) AS cost_amount, coalesce(cost_complete, true) AS cost_complete, coalesce(cost_notes, 0) AS cost_notes
          FROM tree LEFT JOIN ({_cost_sql("thread_id", "k AS id2,")}) c ON id2 = id""",
        "threads_count_low_cache": f"""{e} SELECT count(*) AS total FROM (SELECT thread_id FROM effective WHERE effort = 'low' GROUP BY thread_id
          HAVING sum(input_tokens) FILTER (WHERE {_PAIRED}) > 0 AND cast(sum(cached_input_tokens) FILTER (WHERE {_PAIRED}) AS double) / cast(sum(input_tokens) FILTER (WHERE {_PAIRED}) AS double) < 0.5)""",
        "turns_count": f"{e} SELECT count(*) AS total FROM (SELECT DISTINCT thread_id, turn_id FROM effective WHERE {_WEEK})",
        "compare_summaries": " UNION ALL ".join(f"({e} SELECT '{k}' AS period, timestamp '{a}' AS start, timestamp '{b}' AS \"end\", {_METRICS} FROM effective WHERE event_at >= timestamp '{a}' AND event_at < timestamp '{b}')" for k, (a, b) in Usage.compared(WEEK).items()),
        "thread_models": _groups_sql("model", "thread_id = 't10'"),
        "thread_detail_cost": _cost_sql(None, "").replace("FROM effective e LEFT JOIN", "FROM (SELECT * FROM effective WHERE thread_id = 't10') e LEFT JOIN"),
        "threads_page_cost": f"""WITH {_EFFECTIVE}, page AS (SELECT thread_id FROM effective GROUP BY 1 ORDER BY sum(total_tokens) DESC NULLS LAST, thread_id LIMIT 30 OFFSET 10)
          SELECT thread_id, cost_amount, cost_complete, cost_notes FROM page JOIN ({_cost_sql("thread_id", "k,")}) ON k = thread_id""",
        "trend_plotted": f"{e} SELECT {_day('UTC')} AS time, cast(sum(total_tokens) // 1000 AS double) / 1000 AS millions FROM effective GROUP BY 1",
        "agents_team": f"""WITH RECURSIVE {_EFFECTIVE}, {_THREADS}, {_TREE}, own AS (SELECT e.*, len(path) AS l FROM effective e JOIN tree ON id = thread_id WHERE model = 'view')
          SELECT 'team' AS part, {_METRICS} FROM own UNION ALL SELECT 'self', {_METRICS} FROM own WHERE l = 1 UNION ALL SELECT 'subagents', {_METRICS} FROM own WHERE l > 1""",
        "thread_detail": f"WITH {_EFFECTIVE}, {_THREADS}, g AS (SELECT {_METRICS}, min(event_at) AS first_at, max(event_at) AS last_at FROM effective WHERE thread_id = 't10') SELECT threads.*, g.* FROM threads, g WHERE id = 't10'",
        "thread_related": f"""WITH {_THREADS}, me AS (SELECT * FROM threads WHERE id = 't10'), pairs AS (
          SELECT t.id, t.title, 'subagent' AS relation FROM threads t, me WHERE t.subagent_parent_id = me.id UNION ALL SELECT t.id, t.title, 'fork' FROM threads t, me WHERE t.forked_from_id = me.id
          UNION ALL SELECT t.id, t.title, 'subagent_parent' FROM threads t, me WHERE t.id = me.subagent_parent_id UNION ALL SELECT t.id, t.title, 'fork_parent' FROM threads t, me WHERE t.id = me.forked_from_id) SELECT * FROM pairs""",
        "cost_summary": _cost_sql(None, ""),
        "cost_by_model": _cost_sql("model", "k AS key,"),
        "cost_trend": _cost_sql(_day(NEW_YORK), "k AS time,"),
        "legacy_high_water": """WITH v AS (SELECT *, cast(round(value * 100) AS bigint) AS v FROM events),
            r AS (SELECT *, row_number() OVER w AS n, sum(v) OVER w AS run FROM v WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
            s AS (SELECT *, cast(CASE WHEN n % 7 = 0 THEN run // 2 ELSE run END AS bigint) AS total, CASE WHEN n % 3 <> 0 THEN v END AS own FROM r),
            h AS (SELECT *, coalesce(max(total) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS high,
              lag(total) OVER x AS pt, lag(own) OVER x AS po FROM s WINDOW x AS (PARTITION BY user_id ORDER BY n))
            SELECT event_id, user_id, cast(n AS int) AS n, n > 1 AND pt = total AND po IS NOT DISTINCT FROM own AS repeated, cast(CASE WHEN own IS NULL AND total < high THEN 1 ELSE 0 END AS int) AS incomplete,
              coalesce(own, greatest(total - high, 0)) AS input_tokens, coalesce(own, greatest(total - high, 0)) AS total_tokens FROM h""",
        "inherited_prefix": """WITH e AS (SELECT *, event_type || ':' || json_extract_string(props, '$.k') AS sig FROM events),
            m AS (SELECT *, EXISTS (SELECT 1 FROM e p WHERE c.user_id > 0 AND p.user_id = (c.user_id - 1) // 2 AND p.sig = c.sig AND p.ts <= timestamp '2024-01-20') AS hit FROM e c),
            k AS (SELECT m.*, user_id > 0 AND (user_id - 1) // 2 < 100 AND EXISTS (SELECT 1 FROM events x WHERE x.user_id = (m.user_id - 1) // 2) AS parent_known FROM m),
            w AS (SELECT *, user_id > 0 AND NOT bool_or(parent_known AND NOT hit) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS inherited FROM k)
            SELECT event_id, 't' || user_id AS thread_id, cast(inherited AS int) AS excluded, cast(inherited AND NOT parent_known AND NOT hit AS int) AS incomplete FROM w""",
        "quota_windows": """WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey * 7) % 130 END AS used FROM customer),
            b AS (SELECT k, 'main' AS id, 'main' AS name, cast(used AS double) AS used FROM c UNION ALL SELECT k, 'additional:f:0', 'extra', used / 2 FROM c WHERE k % 3 = 0)
            SELECT cast(k AS varchar) AS account_id, id, name, used AS used_percent, CASE WHEN used IS NOT NULL THEN greatest(0.0, least(100.0, 100.0 - used)) END AS remaining_percent,
              CASE WHEN k % 9 > 0 THEN (k % 9) * 60.0 END AS window_minutes, make_timestamp(k * 1000 * 1000000) AS resets_at, true AS no_secondary FROM b""",
        "latest_snapshot": "SELECT event_id AS id, cast(user_id AS varchar) AS identity_key, event_type AS kind, ts AS at, props AS data FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
        "cost_by_thread": _cost_sql("thread_id", "k AS key,"),
        "rolled_summary": summary(f"{_RAGGED} AND model = 'click'"),
        "rolled_trend_hour_ny": e + _trend_sql("effective", _hour(NEW_YORK), _hour_start(NEW_YORK), _RAGGED),
        "rolled_breakdown": _groups_sql("thread_id", _RAGGED) + " LIMIT 200",
        "rolled_turns": _turns_sql(_RAGGED, "total_tokens DESC NULLS LAST, thread_id, turn_id NULLS FIRST", "LIMIT 100"),
        "stored_trend_day_ny": f"WITH {_LOGGED} " + _trend_sql("logged", _day(NEW_YORK), _day_start(NEW_YORK), _WEEK),
        "stored_breakdown": _groups_sql("project", _WEEK, label=_PATH_LABEL).replace(_EFFECTIVE, _LOGGED).replace("FROM effective", "FROM logged") + " LIMIT 50",
    }
