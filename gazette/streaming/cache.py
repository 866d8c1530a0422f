"""Caches of readers as a stream's state: the newest run of each reader, which ends when it is so many hours old."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

HOURS = 12
#: State with timers needs this store.
CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Newest(StatefulProcessor):
    """State of a reader: the newest run and when it was saved. Emits what is saved, superseded and expired."""

    def __init__(self, hours: int):
        self.life = hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.newest = handle, handle.getValueState("newest", "run long, saved_us long")

    def rows(self, key, run, us, status) -> pd.DataFrame:
        return pd.DataFrame({"reader": [key[0]] * len(run), "run": run, "saved_us": us, "status": status})

    def handleInputRows(self, key, rows, timerValues):
        """Of a batch the newest run stands against the state; the others of it, and older ones, are superseded. Rows are sorted as
        arrays, and each call of the state's server counts: nothing is asked that is known."""
        run, us = (np.concatenate(x) for x in zip(*((pdf["run"].astype("int64"), pdf["saved_us"].astype("int64")) for pdf in rows), strict=True))
        order = np.lexsort((us, run))
        run, us = run[order], us[order]
        once = np.append((run[1:] != run[:-1]) | (us[1:] != us[:-1]), True)
        run, us = run[once], us[once]
        held, last = self.newest.get(), (int(run[-1]), int(us[-1]))
        held = tuple(held) if held is not None else None
        if held is None or last > held:
            if held:
                self.handle.deleteTimer(held[1] // 1000 + self.life)
            self.newest.update(last)
            self.handle.registerTimer(last[1] // 1000 + self.life)
            held = last
        yield self.rows(key, run, us, np.where((run == held[0]) & (us == held[1]), "saved", "superseded"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        run, us = self.newest.get()
        self.newest.clear()
        yield self.rows(key, [run], [us], ["expired"])

    def close(self) -> None:
        pass


def kept(saved: DataFrame, hours: int = HOURS, late: str = "0 seconds") -> DataFrame:
    """reader, run, saved_at, status of a stream of saved caches (reader, run, saved_at): `saved` where it is its reader's newest run so
    far, else `superseded`; `expired` once the stream's time is so many hours past it. State holds one run a reader."""
    kind, zoned = saved.schema["saved_at"].dataType, F.col("saved_at").cast("timestamp")
    rows = saved.select("reader", "run", F.unix_micros(zoned).alias("saved_us"), zoned.alias("_at")).withWatermark("_at", late)
    reader = saved.schema["reader"].dataType.simpleString()
    out = rows.groupBy("reader").transformWithStateInPandas(Newest(hours), f"reader {reader}, run long, saved_us long, status string", "Append", "EventTime")
    return out.select("reader", "run", F.timestamp_micros("saved_us").cast(kind).alias("saved_at"), "status")
