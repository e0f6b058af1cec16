"""The usage model over other tables: an event stream, order lines and conversations."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_COLUMNS = """
 concat('f', cast(event_id % 7 as varchar(20))) AS file,
 concat('response:', cast(cast(floor(event_id / 2.0) as bigint) as varchar(20))) AS event_key,
 concat('t', cast(user_id as varchar(20))) AS thread_id,
 CASE WHEN event_id % 11 <> 0 THEN concat('u', cast(extract(day from ts) as varchar(20))) END AS turn_id,
 ts AS event_at,
 CASE WHEN k % 10 <> 0 THEN concat('/work/p', cast(k % 6 as varchar(20))) END AS project,
 CASE WHEN event_type <> 'error' THEN event_type END AS model,
 CASE WHEN k % 3 = 0 THEN 'low' WHEN k % 3 = 1 THEN 'high' END AS effort,
 CASE WHEN event_id % 4 = 0 THEN 'legacy' ELSE 'record' END AS kind,
 CASE WHEN event_id % 29 <> 0 THEN cast(v as bigint) END AS input_tokens,
 CASE WHEN event_id % 13 <> 0 THEN cast(floor(v * k / 100) as bigint) END AS cached_input_tokens,
 CASE WHEN event_id % 5 <> 0 THEN cast(floor(v / 20) as bigint) END AS cache_write_input_tokens,
 cast(k * 10 as bigint) AS output_tokens,
 CASE WHEN event_id % 3 <> 0 THEN k END AS reasoning_output_tokens,
 cast(v as bigint) + k * 10 AS total_tokens,
 CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS incomplete,
 CASE WHEN event_id % 19 = 0 THEN 1 ELSE 0 END AS excluded
"""


def events_from_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = rows.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.round(F.col("value") * 100).alias("v"))
    return rows.selectExpr(*[x.strip().rstrip(",") for x in EVENT_COLUMNS.strip().split("\n")])


def threads_from_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of users: task u was started by (u - 1) / 2; every tenth is a fork of the first one."""
    u = F.col("user_id")
    ids = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    name = lambda n: F.concat(F.lit("t"), n.cast("string"))
    up, fork = F.when(u > 0, name(F.floor((u - 1) / 2))), F.when((u % 10 == 0) & (u > 0), F.lit("t0"))
    return ids.select(
        name(u).alias("id"), F.lit("cli").alias("source"), F.coalesce(fork, up).alias("parent_id"), up.alias("subagent_parent_id"), fork.alias("forked_from_id"), F.when(u % 9 != 0, F.concat(F.lit("Task "), u.cast("string"))).alias("title")
    )


def events_from_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as effective events over years, at hours that cross daylight-saving changes."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    at = F.col("l_shipdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("l_orderkey") % 24).cast("int"))
    return lines.join(part, "l_partkey").select(
        F.col("l_orderkey").cast("string").alias("thread_id"), F.col("l_linenumber").cast("string").alias("turn_id"), at.alias("event_at"), F.col("p_brand").alias("project"),
        F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("effort"), F.lit("record").alias("kind"), cents.alias("input_tokens"), F.floor(cents / 2).alias("cached_input_tokens"),
        F.lit(0).cast("bigint").alias("cache_write_input_tokens"), F.col("l_quantity").cast("bigint").alias("output_tokens"), F.lit(0).cast("bigint").alias("reasoning_output_tokens"),
        (cents + F.col("l_quantity").cast("bigint")).alias("total_tokens"), F.lit(0).alias("incomplete"),
    )


def events_from_chats(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as events (a turn each) and as threads titled by their first question."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    size, null = F.char_length("text").cast("bigint"), F.lit(None).cast("bigint")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 300).cast("int")).cast("timestamp_ntz")
    events = rows.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("thread_id"), F.col("turn").cast("string").alias("turn_id"), day.alias("event_at"), F.lit(None).cast("string").alias("project"),
        F.col("role").alias("model"), F.lit(None).cast("string").alias("effort"), F.lit("record").alias("kind"), size.alias("input_tokens"), null.alias("cached_input_tokens"),
        null.alias("cache_write_input_tokens"), F.lit(0).cast("bigint").alias("output_tokens"), null.alias("reasoning_output_tokens"), size.alias("total_tokens"), F.lit(0).alias("incomplete"),
    )
    first = rows.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    threads = first.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id"), F.substring("text", 1, 40).alias("title"))
    return events, threads
