"""Running values of a stream in order of event time, however its rows arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Waiting rows that a piece of a user's state holds, at most about.
PIECE = 10_000


class _Anomalies(StatefulProcessor):
    """Rows wait in pieces until the watermark passes their time; then they are folded into the user's running mean and spread.

    A user has one timer: at the earliest waiting row, or where none waits at the end of the idle time.
    """

    def __init__(self, event_kind: str, sigmas: float, idle_ms: int):
        self.event_kind, self.sigmas, self.idle_ms = event_kind, sigmas, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"at array<long>, event array<{self.event_kind}>, value array<double>")
        self.stats = handle.getValueState("stats", "n long, mean double, m2 double, last long, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pieces, first = [], None
        for pdf in rows:
            least = int(pdf["at"].min())
            first = least if first is None else min(first, least)
            kept = [r for r in zip(pdf["at"].tolist(), pdf["event"].tolist(), pdf["value"].tolist()) if r[2] is not None and r[2] == r[2]]
            if kept:
                pieces.append(tuple(map(list, zip(*kept))))
        if pieces:
            self.waiting.appendList(pieces)
        if first is None:
            return
        n, mean, m2, last, due = self.stats.get() or (0, 0.0, 0.0, 0, None)
        at = first // 1000 + 1
        if due is None or at < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(at)
            self.stats.update((n, mean, m2, last, at))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        n, mean, m2, last, _ = self.stats.get() or (0, 0.0, 0.0, 0, None)
        rows = [r for piece in self.waiting.get() for r in zip(*piece)]
        ready = sorted(r for r in rows if r[0] // 1000 < now)
        later = [r for r in rows if r[0] // 1000 >= now]
        if ready:
            if later:
                self.waiting.put([tuple(map(list, zip(*later[i:i + PIECE]))) for i in range(0, len(later), PIECE)])
            else:
                self.waiting.clear()
            last = ready[-1][0] // 1000
        out = []
        for at, event, x in ready:
            sd = (m2 / (n - 1)) ** 0.5 if n > 1 else 0.0
            z = (x - mean) / sd if sd > 1e-6 else None
            out.append((event, z, z is not None and abs(z) > self.sigmas))
            n += 1
            d = x - mean
            mean += d / n
            m2 += d * (x - mean)
        due = min(r[0] for r in later) // 1000 + 1 if later else last + self.idle_ms
        if not later and (not n or now >= due):  # nothing came for long
            self.stats.clear()
        else:
            self.handle.registerTimer(due)
            self.stats.update((n, mean, m2, last, due))
        if out:
            yield pd.DataFrame({"event": [r[0] for r in out], "z": pd.Series([r[1] for r in out], dtype="object"), "flag": [r[2] for r in out]})

    def close(self) -> None:
        pass


def ordered_anomalies(stream: DataFrame, user: str, ts: str, event: str, value: str, sigmas: float = 3.0, delay: str = "10 minutes", idle_days: int = 30) -> DataFrame:
    """(event, z, flag): z of each value against the earlier ones of its user by event time, ties by event.

    A row waits until the watermark (the latest time seen less `delay`) passes it, so rows that arrive out of order within the delay get the answer of
    a sorted table, however they are spread over micro-batches; later ones are dropped by the watermark. Rows are put out when the watermark passes them: those of
    the last `delay` of a stream that ends stay in state. A user's state is three numbers and the waiting rows, dropped after idle_days of event time
    without a row. Null values are left out. Needs the RocksDB state store, which is set on the session.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kind = stream.schema[event].dataType.simpleString()
    rows = stream.withWatermark(ts, delay).select(F.col(user), F.col(ts), F.unix_micros(ts).alias("at"), F.col(event).alias("event"), F.col(value).cast("double").alias("value"))
    out = rows.groupBy(user).transformWithStateInPandas(_Anomalies(kind, sigmas, idle_days * 86_400_000), f"event {kind}, z double, flag boolean", "Append", "EventTime")
    return out.withColumnRenamed("event", event)
