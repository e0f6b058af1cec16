"""Answers with what they have to be read with: caveats of their source, and counters that are observed while the answer is computed."""

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .refresh import Store, caveats

#: Caveats of an account's answers by the condition under which they hold; kind: limits or usage; of the latest snapshot: error, stale, confirmed and provider.
ACCOUNT_CAVEATS = (
    ("missing_days_are_not_zero", "kind = 'usage'"),
    ("limits_are_snapshots", "kind = 'limits'"),
    ("refresh_failed", "error is not null"),
    ("stale", "stale"),
    ("identity_unconfirmed", "not confirmed"),
    ("read_over_http", "provider = 'http'"),
)


@dataclass(frozen=True)
class Answer:
    """rows: the answer, which is observed; caveats: a table of them; source: local or account; updated_at: of the last refresh."""

    rows: DataFrame
    caveats: DataFrame
    source: str
    updated_at: dt.datetime | None
    observed: Observation

    @property
    def counters(self) -> dict:
        """rows, and events if the answer counts them, of the first action on `rows`; waits for it."""
        return self.observed.get


def _observed(rows: DataFrame) -> tuple[DataFrame, Observation]:
    seen = Observation()
    more: list[Column] = [F.sum("event_count").alias("events")] if "event_count" in rows.columns else []
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *more), seen


def local_answer(rows: DataFrame, store: Store, running: bool = False) -> Answer:
    """An answer from a store; running: an import goes on."""
    out, seen = _observed(rows)
    files = store.files()
    at = files.agg(F.max("modified")).first()[0] if files is not None else None
    return Answer(out, caveats(store.status(), running), "local", at, seen)


def account_answer(rows: DataFrame, kind: str, state: DataFrame) -> Answer:
    """An answer from an account's snapshots. state: the snapshot's row of account.with_state(), with provider and error (text or null); no row: nothing was ever read, so no identity is confirmed."""
    if kind not in ("limits", "usage"):
        raise ValueError(f"no account answers of kind {kind!r}")
    out, seen = _observed(rows)
    columns = {"stale": "boolean", "confirmed": "boolean", "provider": "string", "error": "string", "at": "timestamp_ntz"}
    known = state.select(*[(F.col(c) if c in state.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()]).limit(1)
    # one row, also for no state
    one = known.agg(*[F.first(c).alias(c) for c in columns]).withColumns({"kind": F.lit(kind), "stale": F.coalesce("stale", F.lit(False)), "confirmed": F.coalesce("confirmed", F.lit(False))})
    told = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(name)) for name, c in ACCOUNT_CAVEATS]))
    return Answer(out, one.select(F.explode(told).alias("caveat")), "account", one.first().at, seen)
