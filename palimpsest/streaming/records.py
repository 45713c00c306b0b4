"""Incremental ingestion of record streams with Structured Streaming.

Rows arrive out of order: a delta may come before the text it builds on. State is kept per
file id, so all versions of one file meet in one group, and only keys and waiting rows are
held, never texts that were passed on.
"""

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "file_id string, rev string, basis string, payload string, state string"
_STATE = "known array<string>, revs array<string>, bases array<string>, payloads array<string>"


def _insert(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, wait: int | None = None) -> Iterator[pd.DataFrame]:
    known, revs, bases, payloads = state.get if state.exists else ([], [], [], [])
    seen = {*known}
    waiting: dict[str, dict[str, str]] = {}  # basis to the rows that wait for it, each once
    out: list[tuple] = []
    if state.hasTimedOut:
        out = [(key[0], r, b, p, "basis missing") for r, b, p in zip(revs, bases, payloads)]
        revs, bases, payloads = [], [], []
    for r, b, p in zip(revs, bases, payloads):
        waiting.setdefault(b, {})[r] = p
    for pdf in batches:
        for row in zip(pdf["rev"], pdf["basis"].where(pdf["basis"].notna(), None), pdf["payload"]):
            ready = [row]
            while ready:  # a row that is passed on frees those that wait for it: each row is looked at twice at most
                r, b, p = ready.pop()
                if r in seen:
                    continue
                if b is None or b in seen:
                    seen.add(r)
                    out.append((key[0], r, b, p, "inserted"))
                    ready.extend((w, r, q) for w, q in waiting.pop(r, {}).items())
                else:
                    waiting.setdefault(b, {}).setdefault(r, p)
    left = [(r, b, p) for b, rows in waiting.items() for r, p in rows.items() if r not in seen]
    state.update(([*seen], [x[0] for x in left], [x[1] for x in left], [x[2] for x in left]))
    if left and wait:
        state.setTimeoutDuration(wait)
    yield pd.DataFrame(out, columns=["file_id", "rev", "basis", "payload", "state"])


def insert_records(stream: DataFrame, wait_ms: int | None = None) -> DataFrame:
    """(file_id, rev, basis, payload) passed on once each, after the basis; repeats are dropped.

    Rows whose basis never comes stay in the state; with ``wait_ms``, for streams that keep
    running, they leave as ``basis missing`` after that time.
    """
    rows = stream.select("file_id", "rev", "basis", "payload")
    timeout = GroupStateTimeout.ProcessingTimeTimeout if wait_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy("file_id").applyInPandasWithState(partial(_insert, wait=wait_ms), _OUT, _STATE, "append", timeout)


def first_deliveries(stream: DataFrame, key: str, at: str, delay: str = "30 days") -> DataFrame:
    """Redelivered rows dropped while the watermark can still hold the first."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def arrivals(stream: DataFrame, at: str, window: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Rows per event-time window; late rows beyond the delay are not counted."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).groupBy(F.window(at, window).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def trusted(rows: DataFrame, modified: str, read_at: str, seconds: int = 3) -> DataFrame:
    """Rows old enough when read that a later change must have shown: younger ones are not to be cached."""
    return rows.where(F.col(modified) < F.col(read_at) - F.expr(f"INTERVAL {seconds} SECONDS"))
