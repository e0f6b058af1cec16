"""Quota and usage payloads of accounts, as JSON texts in a column, and snapshots of them."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import from_millis, whole_number

COUNTERS = ("lifetimeTokens", "peakDailyTokens", "longestRunningTurnSec", "currentStreakDays", "longestStreakDays")
#: Names of a window's fields in the two forms of the payload, and what makes minutes of its length.
FORMS = {
    "http": ("used_percent", "limit_window_seconds", "reset_at", 60.0, "primary_window", "secondary_window"),
    "rpc": ("usedPercent", "windowDurationMins", "resetsAt", 1.0, "primary", "secondary"),
}
MAIN = "main"


def _once(value: Column, body) -> Column:
    """body of the value, which is computed once and not wherever body names it."""
    return F.transform(F.array(value), body)[0]


def _number(json: Column, path: str) -> Column:
    return _once(F.get_json_object(json, path), lambda text: F.when(text.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), text.cast("double")))


def window(json: Column, form: str) -> Column:
    """A struct of one window: null for a missing window, null in it what isn't reported. What remains is held within 0 and 100."""
    used, length, reset, unit, _, _ = FORMS[form]

    def of(x: Column) -> Column:
        left = F.when(x["share"].isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - x["share"])))
        return F.struct(x["share"].alias("used_percent"), left.alias("remaining_percent"), F.when(x["size"] > 0, x["size"] / unit).alias("window_minutes"), from_millis((x["at"] * 1000).cast("bigint")).alias("resets_at"))

    read = lambda j: F.struct(_number(j, f"$.{used}").alias("share"), _number(j, f"$.{length}").alias("size"), _number(j, f"$.{reset}").alias("at"))
    return _once(json, lambda j: F.when(j.isNotNull(), _once(read(j), of)))


def _fields(json: Column) -> Column:
    return F.from_json(json, "map<string, string>")


def limits(payloads: DataFrame, form: str, main: str = MAIN) -> DataFrame:
    """account_id, id, name, primary and secondary window of every bucket. payloads: account_id, data.

    A map of buckets by id counts before the single one. A payload of neither form has no rows here; see malformed().
    """
    _, _, _, _, first, second = FORMS[form]
    if form == "http":
        more = F.from_json(F.get_json_object("data", "$.additional_rate_limits"), "array<string>")
        entry = lambda x, i: F.struct(
            F.concat_ws(":", F.lit("additional"), F.coalesce(F.get_json_object(x, "$.metered_feature"), i.cast("string")), i.cast("string")).alias("id"),
            F.coalesce(F.get_json_object(x, "$.limit_name"), F.concat(F.lit("Additional "), (i + 1).cast("string"))).alias("name"),
            F.get_json_object(x, "$.rate_limit").alias("rate"),
        )
        one = F.when(_has("rate_limit"), F.array(F.struct(F.lit(main).alias("id"), F.lit(main).alias("name"), F.get_json_object("data", "$.rate_limit").alias("rate"))))
        buckets = F.concat(F.coalesce(one, F.array().cast("array<struct<id: string, name: string, rate: string>>")), F.coalesce(F.transform(more, entry), F.array().cast("array<struct<id: string, name: string, rate: string>>")))
    else:
        by_id = F.map_entries(_fields(F.get_json_object("data", "$.rateLimitsByLimitId")))
        many = F.transform(by_id, lambda e: F.struct(e["key"].alias("id"), F.coalesce(F.get_json_object(e["value"], "$.limitName"), e["key"]).alias("name"), e["value"].alias("rate")))
        one = F.when(_has("rateLimits"), F.array(F.struct(F.lit(main).alias("id"), F.lit(main).alias("name"), F.get_json_object("data", "$.rateLimits").alias("rate"))))
        buckets = F.when(F.size(many) > 0, many).otherwise(one)
    # spread, since payloads may lie in few partitions; outer, since for an inner one all buckets are made once more to filter the payloads
    rows = payloads.hint("rebalance").select("account_id", F.explode_outer(buckets).alias("b")).where("b is not null").select("account_id", "b.id", "b.name", "b.rate")
    part = lambda name: window(F.get_json_object("rate", f"$.{name}"), form)
    return rows.select("account_id", "id", "name", part(first).alias("primary"), part(second).alias("secondary"))


def _has(key: str) -> Column:
    return F.coalesce(F.map_contains_key(_fields(F.col("data")), key), F.lit(False))


def malformed(payloads: DataFrame, form: str) -> DataFrame:
    """Payloads that hold no limits in this form."""
    known = {"http": ("rate_limit", "additional_rate_limits"), "rpc": ("rateLimits", "rateLimitsByLimitId")}[form]
    return payloads.where(~(_has(known[0]) | _has(known[1])))


def usage_counters(payloads: DataFrame) -> DataFrame:
    """account_id and the lifetime counters; null for what isn't a count."""
    return payloads.select("account_id", *(whole_number(F.get_json_object("data", f"$.summary.{c}")).alias(c) for c in COUNTERS))


def daily_usage(payloads: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """account_id, start_date and tokens of the sound daily buckets, in start <= start_date < end (texts of dates)."""
    days = F.from_json(F.get_json_object("data", "$.dailyUsageBuckets"), "array<struct<startDate: string, tokens: string>>")
    rows = payloads.select("account_id", F.explode(days).alias("d")).select("account_id", F.col("d.startDate").alias("start_date"), whole_number(F.col("d.tokens")).alias("tokens"))
    rows = rows.where(F.col("start_date").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.col("tokens").isNotNull())
    return rows.where((F.col("start_date") >= start if start else F.lit(True)) & (F.col("start_date") < end if end else F.lit(True)))


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """The last snapshot of each identity and kind. The maximum of a struct is combined before the shuffle."""
    rest = [c for c in snapshots.columns if c not in ("id", "identity_key", "kind")]
    last = snapshots.groupBy("identity_key", "kind").agg(F.max_by(F.struct("id", *rest), "id").alias("row"))
    return last.select("identity_key", "kind", "row.*").select(*snapshots.columns)


def with_state(latest: DataFrame, identity: str | None, failed_at: Column | None = None) -> DataFrame:
    """Adds confirmed (of the identity in use) and stale (a later refresh failed; the last good snapshot is kept)."""
    stale = F.lit(False) if failed_at is None else F.coalesce(F.col("at") < failed_at, F.lit(False))
    return latest.withColumn("confirmed", F.coalesce(F.col("identity_key") == F.lit(identity), F.lit(False))).withColumn("stale", stale)


def combined_status(parts: DataFrame) -> DataFrame:
    """One status of the local and account refreshes (part, running, updated_at, error): the older update, only if both have one."""
    both = F.count("updated_at") == F.count(F.lit(1))
    errors = F.array_join(F.array_sort(F.collect_set("error")), "; ")
    return parts.agg(F.bool_or("running").alias("running"), F.when(both, F.min("updated_at")).alias("updated_at"), F.nullif(errors, F.lit("")).alias("error"))


def row_number_of_latest(snapshots: DataFrame) -> DataFrame:
    """All snapshots with their age in their identity and kind, the latest first."""
    return snapshots.withColumn("age", F.row_number().over(Window.partitionBy("identity_key", "kind").orderBy(F.desc("id"))))
