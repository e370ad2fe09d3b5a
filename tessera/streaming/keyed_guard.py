"""The read guard as a keyed stateful stream: what a session remembers lives in Spark's state store and expires.

The state of a session is its latest windows, a bounded number of them; a micro-batch touches the sessions that it has
events of. A session that is idle for IDLE_MS times out and is forgotten, so that the number of sessions does not grow
without bound either. A query that stops goes on from its checkpoint.

A session's events of one micro-batch are put in order in its task: the source's limits on a micro-batch
(maxFilesPerTrigger, maxBytesPerTrigger) bound what that holds. Order across micro-batches is that of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.guard import MAX_WINDOWS, remembering

#: How long an idle session is remembered.
IDLE_MS = 24 * 3600 * 1000
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
STATE = "windows array<string>, stats array<string>, touched long"


def _missing(x):
    return None if x is None or x != x else x


def repeated_reads(events: DataFrame, order: list[str], most: int = MAX_WINDOWS, idle_ms: int = IDLE_MS) -> DataFrame:
    """Decisions (session, event, duplicate) on a stream of (session, event, window, stat, reset, ok) and the order
    columns: as operators.guard.repeated_reads decides, but that a session which is idle for idle_ms is forgotten."""

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known, step = remembering(most)
        now = state.getCurrentProcessingTimeMs()
        if state.exists:
            windows, stats, touched = state.get
            if now - touched < idle_ms:  # events may come after the time, but before the timeout is seen
                known.update(zip(windows, stats, strict=True))
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        told = [
            step(_missing(w), _missing(s), bool(r), bool(ok))
            for w, s, r, ok in zip(rows["window"], rows["stat"], rows["reset"], rows["ok"], strict=True)
        ]
        state.update((list(known), list(known.values()), now))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"session": [_missing(key[0])] * len(rows), "event": rows["event"].to_numpy(), "duplicate": told})

    kinds = [f"{c} {events.schema[c].dataType.simpleString()}" for c in ("session", "event")]
    return events.groupBy("session").applyInPandasWithState(
        decide, ", ".join([*kinds, "duplicate boolean"]), STATE, "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def run(events: DataFrame, order: list[str], at: str, out: str, most: int = MAX_WINDOWS, idle_ms: int = IDLE_MS) -> None:
    """Takes what the stream has now, from where the query at the checkpoint `at` stopped, and adds the decisions to the
    Parquet table `out`, each once."""
    conf = events.sparkSession.conf
    before = conf.get(EMPTY_BATCHES)
    # else a query with timeouts never runs out of batches
    conf.set(EMPTY_BATCHES, "false")
    try:
        found = repeated_reads(events, order, most, idle_ms)
        query = found.writeStream.format("parquet").option("checkpointLocation", at).trigger(availableNow=True).start(out)
        query.awaitTermination()
    finally:
        conf.set(EMPTY_BATCHES, before)


def of_events(stream: DataFrame, session: str, window: str, stat: str, reset: str, event: str, order: list[str]) -> DataFrame:
    """A stream of events in the columns that repeated_reads takes."""
    return stream.select(
        F.col(session).cast("string").alias("session"),
        F.col(event).alias("event"),
        F.col(window).cast("string").alias("window"),
        F.col(stat).cast("string").alias("stat"),
        F.expr(reset).alias("reset"),
        F.lit(True).alias("ok"),
        *[c for c in order if c != event],
    )
