"""Exact reference costs from prices per million tokens.

Prices have up to six decimals, so tokens times price is a whole number of 1e-12 units; all of it is integer arithmetic in DECIMAL(38,0). An
event's tier depends on its own input, so it is chosen before anything is summed. Sums by the keys, model and tier are priced, then
added up by the keys.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import money
from ..schema import MODEL_PRICES
from .metrics import combined

MOST_PRICES = 100
LONG_CONTEXT = 272_000
# Published prices in USD per million tokens: input, cached input, cache write, output, and the same for long contexts.
PRESET = (
    ("gpt-6-astra", "10", "1", "12.5", "50", "20", "2", "25", "75"),
    ("gpt-5.6-sol", "4", "0.4", "5", "20", "8", "0.8", "10", "30"),
    ("gpt-5.6-terra", "2", "0.2", "2.5", "12", "4", "0.4", "5", "18"),
    ("gpt-5.6-luna", "0.2", "0.02", "0.25", "1.2", "0.4", "0.04", "0.5", "1.8"),
)
RATES = ("input", "cached_input", "cache_write", "output")


def price_table(spark: SparkSession, rows) -> DataFrame:
    """A table of MODEL_PRICES. Models must differ, and a table holds at most MOST_PRICES."""
    rows = list(rows)
    if len(rows) > MOST_PRICES:
        raise ValueError(f"more than {MOST_PRICES} prices")
    if len({r[0] for r in rows}) < len(rows):
        raise ValueError("a model has two prices")
    for row in rows:
        for price in (*row[1:5], *row[6:10]):
            whole, _, part = (price or "0").partition(".")
            if not (whole.isdigit() and len(whole) <= 8 and len(part) <= 6 and (not part or part.isdigit())):
                raise ValueError(f"{price!r} is no price")
    return spark.createDataFrame(rows, MODEL_PRICES)


def preset_prices(spark: SparkSession, threshold: int = LONG_CONTEXT) -> DataFrame:
    return price_table(spark, [(*r[:5], threshold, *r[5:]) for r in PRESET])


def _micro(price: str) -> Column:
    return (F.col(price).cast("decimal(14,6)") * 1_000_000).cast("decimal(16,0)")


def costs(events: DataFrame, prices: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The keys, amount (USD with twelve decimals; null if nothing could be priced), complete, and notes on what is missing.

    Prices are joined with all of their table; Spark broadcasts it if it is small, as that of price_table() always is.
    """
    rates = prices.select(
        F.col("model").alias("_model"), F.col("long_context_threshold").alias("_over"), *(_micro(r).alias(f"_{r}") for r in RATES), *(_micro(f"long_{r}").alias(f"_long_{r}") for r in RATES)
    )
    tiered = events.join(rates.select("_model", "_over"), F.col("model") == F.col("_model"), "left")
    tier = F.coalesce(F.col("input_tokens") > F.col("_over"), F.lit(False))
    sums = combined(tiered, {**keys, "model": F.col("model"), "long": tier}).join(rates, F.col("model") == F.col("_model"), "left")
    by = {r: F.when(F.col("long"), F.col(f"_long_{r}")).otherwise(F.col(f"_{r}")) for r in RATES}
    priced = F.col("_model").isNotNull()
    exact = lambda c: c.cast("decimal(20,0)")
    uncached = F.when(F.col("sound") == F.col("events"), F.col("uncached"))
    terms = [(uncached, by["input"], "uncached input"), (F.col("cached_input_tokens"), by["cached_input"], "cached input"), (F.col("output_tokens"), by["output"], "output")]
    value, known, notes = F.lit(0).cast("decimal(38,0)"), F.lit(False), []
    for tokens, rate, name in terms:
        useful = tokens.isNotNull() & rate.isNotNull() & (tokens != 0)
        value += F.when(useful, exact(tokens) * rate).otherwise(0).cast("decimal(38,0)")
        known |= useful | F.coalesce(tokens == 0, F.lit(False))
        notes.append(F.when(tokens.isNull() | (rate.isNull() & (tokens != 0)), F.concat("model", F.lit(f": no usage or price for {name}"))))
    # uncached input holds what was written to the cache, so only the difference of the prices is added
    written = F.col("cache_write_input_tokens")
    extra = uncached.isNotNull() & (F.col("invalid_usage") == 0) & written.isNotNull() & (written != 0)
    rated = by["cache_write"].isNotNull() & by["input"].isNotNull()
    value += F.when(extra & rated, exact(written) * (by["cache_write"] - by["input"])).otherwise(0).cast("decimal(38,0)")
    known |= extra & rated
    notes += [
        F.when(extra & ~rated, F.concat("model", F.lit(": no price for cache writes"))),
        F.when(F.col("write_missing") > 0, "cache writes not reported by all events"),
        F.when(F.col("missing_usage") > 0, "input, cached input or output not reported by all events"),
        F.when(F.col("invalid_usage") > 0, "cached parts over the input in some events"),
        F.when(F.col("legacy_events") > 0, "legacy events can't confirm the tier of a request"),
    ]
    unpriced = F.concat(F.lit("no price for "), F.coalesce(F.nullif(F.col("model"), F.lit("")), F.lit("unknown model")))
    found = sums.select(
        *(F.col(k) for k in keys),
        F.when(priced, value).otherwise(0).cast("decimal(38,0)").alias("value"),
        F.when(priced, known).otherwise(False).alias("known"),
        F.when(priced, F.array_compact(F.array(*notes))).otherwise(F.array(unpriced)).alias("notes"),
    )
    folded = found.groupBy(*keys).agg(F.sum("value").alias("value"), F.bool_or("known").alias("known"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("notes")))).alias("notes"))
    out = folded if keys else folded.select(F.coalesce("value", F.lit(0).cast("decimal(38,0)")).alias("value"), F.coalesce("known", F.lit(True)).alias("known"), "notes")
    return out.select(*keys, F.when(F.col("known"), money(F.col("value"))).alias("amount"), (F.size("notes") == 0).alias("complete"), "notes")
