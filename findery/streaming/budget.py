"""Admission within a budget on a stream: the open window of each caller is its state, which ends with the window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues

from findery.operators.budget import CALLER

#: State that lives in a store on disk, which state with a time to live needs.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # State that ends with time would ask for batches without rows for ever, and a run over what is available would not end.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: State outlives its window by this, so that a batch that comes late still finds it.
GRACE_SECONDS = 3600


class _Admission(StatefulProcessor):
    """One value a caller: when its window closes and how many events it has seen."""

    def __init__(self, width: int, n: int, ttl_seconds: int) -> None:
        self.width, self.n, self.ttl = width, n, ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "closes bigint, used bigint", ttlDurationMs=self.ttl * 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        """Each frame is put in time order, walked window by window and given out before the next."""
        closes, used = self.window.get() if self.window.exists() else (None, 0)
        for unordered in rows:
            frame = unordered.sort_values(["us", "event_id"])
            us, flags, at = frame["us"].dropna().to_numpy().astype(np.int64), np.zeros(len(frame), bool), 0
            while at < len(us):
                if closes is None or us[at] >= closes:
                    closes, used = int(us[at]) + self.width, 0
                end = int(np.searchsorted(us, closes))
                flags[at : at + max(0, min(end - at, self.n - used))] = True
                used, at = used + end - at, end
            yield frame[["event_id", *CALLER]].assign(is_admitted=flags)
        if closes is not None:
            self.window.update((closes, used))

    def close(self) -> None:
        pass


def stream_admit_budget(src: DataFrame, n: int, window_seconds: int = 60, keep_seconds: int | None = None) -> DataFrame:
    """(event_id, stage, caller, is_admitted) as events arrive, in order of their micro-batches.

    Each frame of a caller's rows is taken by itself, so a caller with very many events fills no task; an event that
    arrives behind later ones counts in the window that is open by then, and one without a time is not admitted. The state is one
    window, kept for ``keep_seconds`` after its last event (a window and an hour, if not said); a caller that stays away
    has no state. Sessions set ``STATE`` first.
    """
    kinds = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    key = f"stage {kinds['stage']}, caller {kinds['caller']}"
    timed = src.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).select("event_id", *CALLER, "us")
    keep = window_seconds + GRACE_SECONDS if keep_seconds is None else keep_seconds
    return timed.groupBy(*CALLER).transformWithStateInPandas(
        _Admission(window_seconds * 1_000_000, max(n, 0), max(1, keep)),
        f"event_id {kinds['event_id']}, {key}, is_admitted boolean", "append", "processingtime",
    )
