"""Scans as a stream of events: the state of each scan is kept between batches, and a scan that is silent for too long is aborted."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.catalogue import TRANSITIONS

_OUT = "scan_id bigint, event_id bigint, ts timestamp, event string, status string, accepted boolean"


class ScanStates(StatefulProcessor):
    """The status of a scan by TRANSITIONS. An event that its status does not allow changes nothing. patience is how long a running scan may be silent, in seconds of event time; None for ever."""

    def __init__(self, patience: float | None):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", "status string, timer bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.status.get() if self.status.exists() else ("Idle", None)
        status, timer = known[0], known[1]
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        out = []
        for event_id, ts, event in zip(events.event_id, events.ts, events.event, strict=True):
            accepted = event in TRANSITIONS.get(status, ())
            status = event if accepted else status
            out.append((key[0], event_id, ts, event, status, accepted))
        if self.patience is not None:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = None
            if status == "Running":
                timer = int(events.ts.max().value // 10**6 + 1000 * self.patience)
                self.handle.registerTimer(timer)
        self.status.update((status, timer))
        yield pd.DataFrame(out, columns=["scan_id", "event_id", "ts", "event", "status", "accepted"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        known = self.status.get()
        if known[0] == "Running" and known[1] == at:
            self.status.update(("Aborted", None))
            yield pd.DataFrame({"scan_id": [key[0]], "event_id": pd.array([None], "Int64"), "ts": [dt.datetime.fromtimestamp(at / 1000, dt.UTC).replace(tzinfo=None)], "event": ["Aborted"], "status": ["Aborted"], "accepted": [True]})

    def close(self) -> None:
        pass


def scan_states(events: DataFrame, patience: float | None = None, late: str = "10 minutes") -> DataFrame:
    """(scan_id, event_id, ts, event, status, accepted) of a stream of events (scan_id, event_id, ts, event), an event being the state that a scan is to enter: the status after each, and an event without an id where patience ran out.

    Events of a batch are taken in order of time and id. The state is one row a scan in Spark's state store, so a
    restart from the checkpoint goes on where the stream was, and memory does not grow with the events. A batch of the
    same events (catalogue.status_log) gives the same rows, but for timers, if events come in order. It needs
    spark.sql.streaming.stateStore.providerClass to be the RocksDB one.
    """
    rows = events.select("scan_id", "event_id", "ts", "event").withWatermark("ts", late)
    mode = "None" if patience is None else "EventTime"
    return rows.groupBy("scan_id").transformWithStateInPandas(ScanStates(patience), _OUT, "Append", mode)
