"""The signal monitor as a stream: keyed state and event-time timers.

Signals and quotes are one stream of events keyed by symbol. A symbol's state is its open signals and the quotes that a signal still on its way
could need, that is those not older than the watermark. A hit is told when the watermark has passed it, since an earlier quote may come until then; a
signal without a hit expires by timer when the watermark passes its horizon, whether or not its symbol was quoted again. Closed signals leave the
state, so it is bounded by the open signals and the delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OPEN = "direction string, target double, stop double, created bigint, expires bigint, hit bigint, kind int"
_CLOSED = "signal_id bigint, symbol string, status string, closed bigint"
_EVENT = ["symbol", "ts", "at", "price", "signal_id", "direction", "target", "stop", "expires"]
STOPPED, REACHED, NO_HIT = 0, 1, -1


def signal_events(signals: DataFrame, quotes: DataFrame) -> DataFrame:
    """One table or stream of events from open signals and quotes (symbol, ts, price)."""
    none = {"price": "double", "signal_id": "bigint", "direction": "string", "target": "double", "stop": "double", "expires": "bigint"}
    made = signals.where("status = 'open'").select(
        "symbol", F.col("created_at").alias("ts"), F.unix_micros("created_at").alias("at"), F.col("signal_id").cast("bigint").alias("signal_id"), "direction",
        F.col("target_price").cast("double").alias("target"), F.col("stop_loss").cast("double").alias("stop"), F.unix_micros("expires_at").alias("expires"))
    seen = quotes.select("symbol", "ts", F.unix_micros("ts").alias("at"), F.col("price").cast("double").alias("price"))
    rows = [df.withColumns({c: F.lit(None).cast(t) for c, t in none.items() if c not in df.columns}).select(*_EVENT) for df in (made, seen)]
    return rows[0].unionByName(rows[1])


def first_hit(signal: tuple, at: np.ndarray, price: np.ndarray) -> tuple[int, int]:
    """(time, kind) of the first quote in a signal's life that stops it or reaches its target; a stop wins at the same instant."""
    direction, target, stop, created, expires = signal[:5]
    alive = (at >= created) & (at <= expires)
    # A missing level is NaN and is never met.
    stop, target = (np.nan if x is None else x for x in (stop, target))
    if direction == "buy":
        stopped, reached = price <= stop, price >= target
    else:
        stopped, reached = price >= stop, price <= target
    hit = alive & (stopped | reached)
    if not hit.any():
        return NO_HIT, NO_HIT
    when = int(at[hit].min())
    return when, STOPPED if (stopped & hit & (at == when)).any() else REACHED


class SignalMonitor(StatefulProcessor):
    """State of one symbol; see the module's text."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "signal_id bigint", _OPEN)
        self.quotes = handle.getListState("quotes", "at bigint, price double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        late = timerValues.getCurrentWatermarkInMs() * 1000
        batch = pd.concat(list(rows))
        made = batch[batch.signal_id.notna()]
        seen = batch[batch.price.notna()]
        held = list(self.quotes.get())
        new_at, new_price = seen["at"].to_numpy(np.int64), seen.price.to_numpy(float)
        at = np.concatenate((np.array([q[0] for q in held], np.int64), new_at))
        price = np.concatenate((np.array([q[1] for q in held], float), new_price))
        # Known signals meet the new quotes, new signals all that are held.
        for (signal_id,), signal in list(self.open.iterator()):
            self._look(signal_id, tuple(signal), new_at, new_price)
        for s in made.itertuples():
            if not self.open.containsKey((int(s.signal_id),)):
                level = [None if pd.isna(x) else float(x) for x in (s.target, s.stop)]
                signal = (s.direction, *level, int(s.at), int(s.expires), NO_HIT, NO_HIT)
                self.open.updateValue((int(s.signal_id),), signal)
                self.handle.registerTimer(self._due(signal))
                self._look(int(s.signal_id), signal, at, price)
        keep = at >= late
        self._hold(at[keep], price[keep])
        yield from self._close(key[0], late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        late = timerValues.getCurrentWatermarkInMs() * 1000
        held = [q for q in self.quotes.get() if q[0] >= late]
        self._hold(np.array([q[0] for q in held], np.int64), np.array([q[1] for q in held], float))
        yield from self._close(key[0], late)

    def close(self) -> None:
        pass

    @staticmethod
    def _due(signal: tuple) -> int:
        """The first whole millisecond after the signal's hit or horizon."""
        return (signal[5] if signal[5] != NO_HIT else signal[4]) // 1000 + 1

    def _hold(self, at: np.ndarray, price: np.ndarray) -> None:
        if len(at):
            self.quotes.put([(int(a), float(p)) for a, p in zip(at, price, strict=True)])
        elif self.quotes.exists():
            self.quotes.clear()

    def _look(self, signal_id: int, signal: tuple, at: np.ndarray, price: np.ndarray) -> None:
        when, kind = first_hit(signal, at, price)
        if kind != NO_HIT and (signal[6] == NO_HIT or (when, kind) < (signal[5], signal[6])):
            signal = (*signal[:5], when, kind)
            self.open.updateValue((signal_id,), signal)
            self.handle.registerTimer(self._due(signal))

    def _close(self, symbol: str, late: int) -> Iterator[pd.DataFrame]:
        """Signals whose hit or horizon the watermark has passed."""
        out = []
        for (signal_id,), signal in list(self.open.iterator()):
            if self._due(tuple(signal)) * 1000 > late:
                continue
            kind = signal[6]
            out.append((signal_id, symbol, "expired" if kind == NO_HIT else "stopped_out" if kind == STOPPED else "target_hit", signal[4] if kind == NO_HIT else signal[5]))
            self.open.removeKey((signal_id,))
        if out:
            yield pd.DataFrame(out, columns=["signal_id", "symbol", "status", "closed"])


def stream_signal_monitor(signals: DataFrame, quotes: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Closings (signal_id, symbol, status, closed_at) of the signals of a stream, in append mode.

    One of the two may be a table that is read once at the start. Events older than the watermark are dropped. Equals ``resolve_signals`` with the
    watermark as ``now``. The session must keep its state in ``STATE_STORE`` (spark.sql.streaming.stateStore.providerClass).
    """
    events = signal_events(signals, quotes).withWatermark("ts", delay)
    closed = events.groupBy("symbol").transformWithStateInPandas(SignalMonitor(), _CLOSED, "append", "eventTime")
    return closed.select("signal_id", "symbol", "status", F.timestamp_micros("closed").alias("closed_at"))
