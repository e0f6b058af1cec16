"""The usage queries, each a DataFrame over effective events.

Rows come with their metrics and, where prices are given, with cost_amount, cost_complete and cost_notes. Order is part of a page, so
pages are sorted and cut in one top-k step.
"""

import datetime as dt
import functools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import UNKNOWN, label, ratio
from ..functions.timebuckets import MOST_BUCKETS, bucket, bucket_start, spine
from ..operators.cost import costs
from ..operators.filters import ANY, Filter
from ..operators.hierarchy import related, subtree
from ..operators.metrics import METRICS, combined, finished, grouped
from ..operators.rollup import aligned, ceil, floor, roll_up
from ..operators.search import TextIndex
from ..schema import DIMENSIONS

MOST_PER_PAGE = 200
#: Zones whose quarter hours were odd before have whole ones since.
SINCE = dt.datetime(1970, 1, 1)


def page(rows: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= MOST_PER_PAGE or offset < 0:
        raise ValueError("limit must be between 1 and 200, offset 0 or more")
    return rows.orderBy(*order).offset(offset).limit(limit)


@dataclass(frozen=True)
class Usage:
    """events: effective events; threads: the table of threads; prices: of cost.price_table(), or None for no costs; zone: of local buckets; index: of texts, for searches."""

    events: DataFrame
    threads: DataFrame | None = None
    prices: DataFrame | None = None
    zone: str = "UTC"
    index: TextIndex | None = field(default=None, kw_only=True)

    def rows(self, f: Filter) -> DataFrame:
        return f.apply(self.events, self.threads, self.index)

    def metric_rows(self, f: Filter) -> DataFrame:
        """What metrics are made of: events, or sums of them."""
        return self.rows(f)

    def _with_costs(self, out: DataFrame, rows: DataFrame, keys: dict[str, Column], page: DataFrame | None = None) -> DataFrame:
        """page: at most MOST_PER_PAGE rows, to whose keys costs are restricted before they are summed."""
        if self.prices is None:
            return out
        if page is not None:
            wanted = F.broadcast(page.select(*(F.col(k).alias(f"_{k}") for k in keys)))
            rows = rows.join(wanted, functools.reduce(lambda a, b: a & b, [c.eqNullSafe(F.col(f"_{k}")) for k, c in keys.items()]), "left_semi")
        found = costs(rows, self.prices, keys).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("amount").alias("cost_amount"), F.col("complete").alias("cost_complete"), F.col("notes").alias("cost_notes"))
        if not keys:
            one = found.select(F.struct("cost_amount", "cost_complete", "cost_notes")).scalar()
            return out.withColumn("_cost", one).select(*out.columns, "_cost.*")
        on = [out[k].eqNullSafe(found[f"_{k}"]) for k in keys]
        return out.join(found, on, "left").drop(*(f"_{k}" for k in keys))

    def _titled(self, rows: DataFrame, key: str = "thread_id") -> DataFrame:
        if self.threads is None:
            return rows.withColumn("title", F.lit(None).cast("string"))
        return rows.join(self.threads.select(F.col("id").alias(key), "title").dropDuplicates([key]), key, "left")

    def summary(self, f: Filter = Filter()) -> DataFrame:
        """One row, also for no events."""
        return self._with_costs(grouped(self.metric_rows(f), {}), self.rows(f), {})

    def trend(self, f: Filter = Filter(), size: str = "day") -> DataFrame:
        """time, bucket_start_utc and the metrics of every local day or hour that has events, by time.

        Rows are grouped by the time at which their bucket begins; names are made for the few groups.
        """
        rows = self.rows(f)
        keys = {"bucket_start_utc": bucket_start(F.col("event_at"), self.zone, size)}
        out = combined(self.metric_rows(f), keys).select(bucket(F.col("first_at"), self.zone, size).alias("time"), "bucket_start_utc", *finished())
        return self._with_costs(out, rows, keys).orderBy("time")

    def trend_filled(self, f: Filter, size: str = "day", most: int | None = MOST_BUCKETS) -> DataFrame:
        """The trend with every bucket of the filter's range; one without events has no records and totals of zero.

        A range of more than `most` buckets, as charts can't show them, has only those with events; None fills any range.
        """
        if f.start is None or f.end is None:
            raise ValueError("a filled trend needs start and end")
        found, ticks = self.trend(f, size), spine(self.events.sparkSession, f.start, f.end, self.zone, size, most)
        if ticks is None:
            return found.withColumn("has_records", F.lit(True))
        out = ticks.join(found.drop("bucket_start_utc").withColumn("has_records", F.lit(True)), "time", "left")
        zero = [c for c in METRICS if c != "cache_ratio"]
        blank = F.col("has_records").isNull()
        return out.withColumns({c: F.when(blank, 0).otherwise(F.col(c)).cast("bigint") for c in zero}).withColumn("has_records", ~blank).orderBy("time")

    def groups(self, f: Filter, by: str) -> DataFrame:
        """key, label, share of the total of all groups, and the metrics. Unknown values are a group."""
        rows, keys, own = self.rows(f), {"key": F.col(DIMENSIONS[by])}, self.metric_rows(f)
        out = grouped(own, keys)
        whole = own.agg(F.sum("total_tokens")).scalar()
        name = label(F.col("key")) if by == "project" else F.coalesce(F.nullif("key", F.lit("")), F.lit(UNKNOWN))
        out = out.select("key", name.alias("label"), ratio(F.col("total_tokens"), whole).alias("share"), *METRICS)
        return self._with_costs(out, rows, keys)

    def breakdown(self, f: Filter = Filter(), by: str = "project", limit: int = 50, offset: int = 0) -> DataFrame:
        return page(self.groups(f, by), [F.desc_nulls_last("total_tokens"), F.asc_nulls_first("key")], limit, offset)

    def threads_page(self, f: Filter = Filter(), limit: int = 50, offset: int = 0, sort: str = "tokens", cache_below: float | None = None, q: str | None = None) -> DataFrame:
        """Threads with title, project, first and last event; cache_below: only those whose cached share of input is lower."""
        f = f.but(q=q) if q else f
        rows, keys = self.rows(f), {"thread_id": F.col("thread_id")}
        both = combined(self.metric_rows(f), keys)
        if cache_below is not None:
            both = both.where(self._under(cache_below))
        out = both.select("thread_id", F.col("project_min").alias("project"), "first_at", "last_at", *finished())
        order = [F.desc("last_at") if sort == "recent" else F.desc_nulls_last("total_tokens"), F.asc("thread_id")]
        chosen = page(out, order, limit, offset)
        return self._with_costs(self._titled(chosen), rows, keys, chosen).orderBy(*order)

    def count_threads(self, f: Filter = Filter(), cache_below: float | None = None, q: str | None = None) -> DataFrame:
        """The number of rows of all pages of threads_page()."""
        by_thread = self.rows(f.but(q=q) if q else f).groupBy("thread_id").agg(*self._paired())
        return (by_thread if cache_below is None else by_thread.where(self._under(cache_below))).agg(F.count(F.lit(1)).alias("total"))

    def count_turns(self, f: Filter = Filter(), q: str | None = None) -> DataFrame:
        """The number of rows of all pages of turns(); a thread's events without a turn are one."""
        return self.rows(f.but(q=q, search_turns=True) if q else f).select("thread_id", "turn_id").distinct().agg(F.count(F.lit(1)).alias("total"))

    @staticmethod
    def _paired() -> list[Column]:
        given, cached = F.col("input_tokens"), F.col("cached_input_tokens")
        return [F.sum(F.when(cached <= given, c)).alias(n) for n, c in (("paired_input", given), ("paired_cached", cached))]

    @staticmethod
    def _under(share: float) -> Column:
        return (F.col("paired_input") > 0) & (F.col("paired_cached").cast("double") / F.col("paired_input").cast("double") < share)

    def turns(self, f: Filter = Filter(), limit: int = 50, offset: int = 0, sort: str = "tokens") -> DataFrame:
        """Turns with the tokens of each of their models and efforts (composition). A thread's events without a turn are one row."""
        rows, keys, sums = self.rows(f), {"thread_id": F.col("thread_id"), "turn_id": F.col("turn_id")}, self.metric_rows(f)
        out = grouped(sums, keys, "first_at", "last_at", "project_min").withColumnRenamed("project_min", "project")
        first = {"tokens": F.desc_nulls_last("total_tokens"), "recent": F.desc("last_at"), "oldest": F.asc("first_at")}[sort]
        order = [first, F.asc("thread_id"), F.asc_nulls_first("turn_id")]
        chosen = page(out, order, limit, offset)
        # only the page's turns are taken apart
        wanted = F.broadcast(chosen.select(F.col("thread_id").alias("_t"), F.col("turn_id").alias("_u")))
        own = sums.join(wanted, (F.col("thread_id") == F.col("_t")) & F.col("turn_id").eqNullSafe(F.col("_u")), "left_semi")
        each = grouped(own, keys | {"model": F.col("model"), "effort": F.col("effort")})
        tokens = F.struct(F.coalesce(-F.col("total_tokens"), F.lit(1)).alias("_o"), "model", "effort", "total_tokens", "event_count")
        parts = each.groupBy("thread_id", "turn_id").agg(F.array_sort(F.collect_list(tokens)).alias("_parts")).withColumnsRenamed({"thread_id": "_t", "turn_id": "_u"})
        composition = F.transform("_parts", lambda x: F.struct(x["model"].alias("model"), x["effort"].alias("effort"), x["total_tokens"].alias("total_tokens"), x["event_count"].alias("event_count")))
        out = chosen.join(parts, (F.col("thread_id") == F.col("_t")) & F.col("turn_id").eqNullSafe(F.col("_u")), "left").withColumn("composition", composition).drop("_t", "_u", "_parts")
        return self._with_costs(self._titled(out), rows, keys, chosen).orderBy(*order)

    def thread_turns(self, thread: str, f: Filter = Filter(), limit: int = 50, offset: int = 0, sort: str = "oldest", turn: object = ANY) -> DataFrame:
        return self.turns(f.but(thread=thread, turn=turn), limit, offset, sort)

    def filter_values(self, f: Filter = Filter()) -> DataFrame:
        """dimension and value of what can be filtered by, in order."""
        pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(DIMENSIONS[d]).alias("value")) for d in ("project", "model", "effort")])
        return self.metric_rows(f).select(F.explode(pairs).alias("p")).select("p.*").where("value is not null").distinct().orderBy("dimension", "value")

    @staticmethod
    def compared(f: Filter, base: tuple[dt.datetime, dt.datetime] | None = None, now: dt.datetime | None = None) -> dict[str, tuple[dt.datetime, dt.datetime]]:
        """The ranges that compare() takes: the filter's, or the last seven days; and the base range, by default as long and just before."""
        end = f.end or now or dt.datetime.now(dt.UTC).replace(tzinfo=None)
        start = f.start or end - dt.timedelta(days=7)
        return {"current": (start, end), "previous": base or (start - (end - start), start)}

    def _in(self, f: Filter, ranges: dict[str, tuple[dt.datetime, dt.datetime]]) -> tuple[DataFrame, dict[str, Column]]:
        """The rows of all ranges, and of each range the condition. Ranges may overlap."""
        at = {k: (F.col("event_at") >= F.lit(a).cast("timestamp_ntz")) & (F.col("event_at") < F.lit(b).cast("timestamp_ntz")) for k, (a, b) in ranges.items()}
        rows = self.rows(f.but(start=min(a for a, _ in ranges.values()), end=max(b for _, b in ranges.values())))
        return rows.where(functools.reduce(lambda x, y: x | y, at.values())), at

    def compare(self, f: Filter, by: str = "project", base: tuple[dt.datetime, dt.datetime] | None = None, now: dt.datetime | None = None) -> DataFrame:
        """Totals of each group in the filter's range and in a base range, with the change; see compared(). A group or total that a range lacks counts as 0."""
        # both ranges in one pass over the rows, as sums that each take only their own
        rows, at = self._in(f, self.compared(f, base, now))
        out = rows.groupBy(F.col(DIMENSIONS[by]).alias("key")).agg(*[F.sum(F.when(c, F.col("total_tokens"))).alias(k) for k, c in at.items()])
        zero = F.lit(0).cast("bigint")
        now_, then = F.coalesce("current", zero), F.coalesce("previous", zero)
        name = label(F.col("key")) if by == "project" else F.coalesce(F.nullif("key", F.lit("")), F.lit(UNKNOWN))
        out = out.select("key", name.alias("label"), now_.alias("current"), then.alias("previous"), (now_ - then).alias("delta"), ratio(now_ - then, then).alias("change_ratio"))
        # ties in the order of people, not of bytes
        return out.orderBy(F.desc("delta"), F.collate(F.coalesce("key", F.lit("")), "UNICODE"), "key")

    def compare_summaries(self, f: Filter, base: tuple[dt.datetime, dt.datetime] | None = None, now: dt.datetime | None = None) -> DataFrame:
        """period (current, previous), its start and end, and its metrics over all groups."""
        ranges = self.compared(f, base, now)
        rows, at = self._in(f, ranges)
        keys = {"period": F.col("_period")}
        rows = rows.withColumn("_period", F.explode(F.array_compact(F.array(*[F.when(c, k) for k, c in at.items()]))))
        both = self.events.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in ranges.items()], "period string, start timestamp_ntz, end timestamp_ntz")
        out = both.join(combined(rows, keys), "period", "left").select("period", "start", "end", *finished())
        return self._with_costs(out, rows, keys).orderBy("period")

    def agents(self, root: str, f: Filter = Filter()) -> DataFrame:
        """The tree of a task in pre-order, with each task's parent, project, models, own metrics and cost. Filters but for the thread hold for the events, not the tree."""
        tree = subtree(self.threads, root)
        known = [c if c in self.threads.columns else F.lit(None).cast("string").alias(c) for c in ("id", "title", "project", "subagent_parent_id")]
        about = self.threads.select(*known).withColumnRenamed("subagent_parent_id", "parent_id").dropDuplicates(["id"])
        rows, keys = self.rows(f.but(thread=None)).join(tree.select(F.col("id").alias("thread_id")), "thread_id", "left_semi"), {"id": F.col("thread_id")}
        models = rows.select(F.col("thread_id").alias("id"), "model").distinct().groupBy("id").agg(F.array_sort(F.collect_list("model")).alias("_m"), F.max(F.col("model").isNull()).alias("_null"))
        # an unknown model is one of the models, and the first
        named = models.select("id", F.when(F.col("_null"), F.concat(F.array(F.lit(None).cast("string")), F.col("_m"))).otherwise(F.col("_m")).alias("models"))
        out = tree.join(grouped(rows, keys), "id", "left").join(named, "id", "left").join(about, "id", "left").withColumn("models", F.coalesce("models", F.array().cast("array<string>")))
        zero = [c for c in METRICS if c != "cache_ratio"]
        blank = F.col("event_count").isNull()
        out = self._with_costs(out.withColumns({c: F.when(blank, 0).otherwise(F.col(c)).cast("bigint") for c in zero}), rows, keys)
        if self.prices is not None:
            # a task without events costs nothing, and that is known
            none = F.col("event_count") == 0
            nothing = {"cost_amount": F.lit("0.000000000000"), "cost_complete": F.lit(True), "cost_notes": F.array().cast("array<string>")}
            out = out.withColumns({c: F.when(none, v).otherwise(F.col(c)) for c, v in nothing.items()})
        return out.orderBy("path")

    def team(self, root: str, f: Filter = Filter()) -> DataFrame:
        """part (self, subagents, team) and its metrics."""
        tree = subtree(self.threads, root, paths=False).withColumnRenamed("id", "thread_id")
        rows = self.rows(f.but(thread=None)).join(tree, "thread_id")
        parts = F.explode(F.array(F.lit("team"), F.when(F.col("depth") == 0, "self").otherwise("subagents")))
        rows = rows.withColumn("_part", parts)
        found = combined(rows, {"part": F.col("_part")})
        out = self.events.sparkSession.createDataFrame([("self",), ("subagents",), ("team",)], "part string").join(found, "part", "left").select("part", *finished())
        return self._with_costs(out, rows, {"part": F.col("_part")}).orderBy("part")

    def detail(self, thread: str) -> DataFrame:
        """One row of a known thread: its edges, and its metrics and cost over all events. models() has them by model."""
        own = self.events.where(F.col("thread_id") == thread)
        metrics = self._with_costs(grouped(own, {}, "first_at", "last_at"), own, {})
        row = self.threads.where(F.col("id") == thread).limit(1)
        return row.withColumn("_own", metrics.select(F.struct("*")).scalar()).select(*row.columns, "_own.*")

    def models(self, thread: str) -> DataFrame:
        """The models of a thread with share, metrics and cost, the largest first."""
        return self.groups(Filter(thread=thread), "model").orderBy(F.desc_nulls_last("total_tokens"), F.asc_nulls_first("key"))

    def related(self, thread: str) -> DataFrame:
        return related(self.threads, thread).orderBy("id", "relation")


@dataclass(frozen=True)
class RolledUsage(Usage):
    """Usage whose summaries, trends, breakdowns, threads, turns and filter values are made of a roll-up of its events (rollup.roll_up()). Costs, which depend on each event, are made of events."""

    rolled: DataFrame | None = None

    def metric_rows(self, f: Filter) -> DataFrame:
        """Events only of the first and last quarter hour of a range that isn't made of whole ones, and wherever the zone's days and hours aren't."""
        if self.rolled is None or not aligned(self.zone, 1970):
            return self.rows(f)
        start, end, at = f.start and ceil(f.start), f.end and floor(f.end), lambda x: F.lit(x).cast("timestamp_ntz")
        if not aligned(self.zone):
            start = max(start or SINCE, SINCE)
        if start and end and start >= end:
            return self.rows(f)
        out = f.but(start=start, end=end).apply(self.rolled, self.threads, self.index)
        edges = [F.col("event_at") < at(start)] * (start != f.start) + [F.col("event_at") >= at(end)] * (end != f.end)
        return out.unionByName(roll_up(self.rows(f).where(functools.reduce(lambda a, b: a | b, edges)))) if edges else out
