"""The latest row per key of an endless stream, with state that is forgotten after a span.

For each key the state holds the time of its newest row and that row's tie-break, nothing else. A timer at that time plus
the span removes it once the watermark has passed, so the state follows the keys seen lately, not all there ever were."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.rows import keep_latest, row_hash

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Latest(StatefulProcessor):
    def __init__(self, span_ms: int):
        self.span_ms = span_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "ms bigint, tie bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.newest.get() if self.newest.exists() else None
        best = None if known is None else (known[0], -known[1])
        winner = None
        for part in rows:
            part = part.sort_values(["ms_", "tie_"], ascending=[False, True], kind="stable").head(1)
            if len(part) and (best is None or (int(part["ms_"].iloc[0]), -int(part["tie_"].iloc[0])) > best):
                best, winner = (int(part["ms_"].iloc[0]), -int(part["tie_"].iloc[0])), part
        if winner is not None:
            if known is not None:
                self.handle.deleteTimer(known[0] + self.span_ms)
            self.newest.update((best[0], -best[1]))
            self.handle.registerTimer(best[0] + self.span_ms)
            yield winner

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.newest.clear()
        yield from ()

    def close(self) -> None:
        pass


def latest_stream(df: DataFrame, key: Sequence[str], event_time: str, within: str) -> DataFrame:
    """A row of ``df`` whenever it is the newest of its key so far, with ``ms_`` and ``tie_``; write it in update mode.

    ``within`` (such as "7 days") is how late a row may come, and how long a key is remembered after its newest row. A
    repeated row, or one older than its key's newest, gives nothing; of rows at one time the lowest by row hash counts.
    A key that was forgotten and comes again is new. Rows without key or time are left out. Sets the session's state
    store to the one that timers need."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    span_ms = int(spark.sql(f"SELECT timestampdiff(MILLISECOND, timestamp'2000-01-01', timestamp'2000-01-01' + INTERVAL {within}) AS n").head()[0])
    present = F.col(event_time).isNotNull()
    for k in key:
        present = present & F.col(k).isNotNull()
    rows = df.filter(present).withColumns({"ms_": F.unix_millis(event_time), "tie_": row_hash(df)})
    marked = rows.withWatermark(event_time, within)
    return marked.groupBy(*key).transformWithStateInPandas(
        statefulProcessor=_Latest(span_ms), outputStructType=rows.schema, outputMode="Update", timeMode="EventTime")


def latest_rows(written: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per key of what a ``latest_stream`` has written."""
    return keep_latest(written, key, ["ms_"], ["tie_"]).drop("ms_", "tie_")
