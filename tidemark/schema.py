"""Tables of the usage model.

Times are UTC without a zone (TIMESTAMP_NTZ), so no result depends on the session's time zone. A null token count means that it wasn't
reported, which is not zero. Cached input is part of input, and reasoning output part of output.
"""

from pyspark.sql import types as T

TOKENS = ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")



def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


_TEXT, _LONG, _INT, _AT = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampNTZType()
USAGE_EVENTS = _table(
    file=_TEXT, event_key=_TEXT, thread_id=_TEXT, turn_id=_TEXT, response_id=_TEXT, event_at=_AT, project=_TEXT, model=_TEXT, effort=_TEXT, kind=_TEXT, signature=_TEXT,
    **dict.fromkeys(TOKENS, _LONG), incomplete=_INT, excluded=_INT,
)
THREADS = _table(id=_TEXT, project=_TEXT, source=_TEXT, parent_id=_TEXT, subagent_parent_id=_TEXT, forked_from_id=_TEXT, title=_TEXT)
MODEL_PRICES = _table(
    model=_TEXT, input=_TEXT, cached_input=_TEXT, cache_write=_TEXT, output=_TEXT, long_context_threshold=_LONG, long_input=_TEXT, long_cached_input=_TEXT, long_cache_write=_TEXT, long_output=_TEXT
)
SNAPSHOTS = _table(id=_LONG, account_id=_TEXT, kind=_TEXT, at=_AT, data=_TEXT, identity_key=_TEXT)
DIMENSIONS = {"project": "project", "model": "model", "effort": "effort", "thread": "thread_id"}
