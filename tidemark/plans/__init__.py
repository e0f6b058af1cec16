"""The queries that users ask, put together from operators."""
