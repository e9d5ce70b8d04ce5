"""Keyed state that goes away by itself: refusals told once in a while, waits that grow.

Rows without a key or a time are nobody's and go.  Each key's state is one row, and an event-time timer is set for when it stops to matter; when the
watermark passes it, the state is gone.  The state store is RocksDB, which these operators ask for.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .streams import event_time

SECOND = 1_000_000
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Expiring(StatefulProcessor):
    """One value of state, `state`, of the fields in `fields`; rows come in the order of at_us."""

    fields = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("state", self.fields)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self._state.get() if self._state.exists() else None
        ordered = pd.concat(list(rows)).sort_values(["at_us", "tie"], kind="stable")
        told, state, ends = self.step(key, ordered, state)
        if state is not None:
            for timer in list(self._handle.listTimers()):
                self._handle.deleteTimer(timer)
            self._state.update(state)
            self._handle.registerTimer(ends // 1000 + 1)
        elif self._state.exists():
            self._state.clear()
        yield told

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._state.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Throttle(_Expiring):
    fields = "until long, held long"

    def __init__(self, names: list[str], quiet: int, keep: int) -> None:
        self._names, self._quiet, self._keep = names, quiet, keep

    def step(self, key, rows, state):
        until, held = state or (None, 0)
        out = []
        for t in rows["at_us"].tolist():
            if until is None or t >= until:
                out.append((key[0], t, held))
                until, held = t + self._quiet, 0
            else:
                held += 1
        return pd.DataFrame(out, columns=self._names), (until, held), until + (self._keep if held else 0)


class _Wait(_Expiring):
    fields = "wrong int, last long"

    def __init__(self, names: list[str], run: int, minutes: tuple[int, ...], quiet: int) -> None:
        self._names, self._run, self._minutes, self._quiet = names, run, minutes, quiet

    def step(self, key, rows, state):
        wrong, last = state or (0, None)
        out = []
        for t, ok in zip(rows["at_us"].tolist(), rows["ok"].tolist(), strict=True):
            if ok or last is not None and t - last > self._quiet:
                wrong = 0
            if not ok:
                wrong, last = wrong + 1, t
                if wrong % self._run == 0:
                    out.append((key[0], t, self._minutes[min(wrong // self._run, len(self._minutes)) - 1]))
        return pd.DataFrame(out, columns=self._names), (wrong, last) if wrong else None, (last or 0) + self._quiet


def _run(stream: DataFrame, key: str, at: str, late: str, ok, processor, fields: str) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    timed = event_time(stream, at, late)
    tie = F.xxhash64(*[F.col(c) for c in stream.columns])
    rows = timed.select(key, at, F.unix_micros(at).alias("at_us"), ok.alias("ok"), tie.alias("tie")).where(F.col(at).isNotNull() & F.col(key).isNotNull())
    kind = dict(stream.dtypes)[key]
    return rows.groupBy(key).transformWithStateInPandas(processor, f"{key} {kind}, at_us long, {fields}", "Append", "EventTime")


def throttled(stream: DataFrame, key: str, at: str, quiet: int = 60, keep: int = 86_400, late: str = "1 hour") -> DataFrame:
    """Refusals of a key: the first is told, then silence for `quiet` seconds while others are counted.

    (key, at, repeats): repeats says how many were held back before this one.  A key with none held
    back is forgotten when its silence ends; one with some, `keep` seconds later.
    """
    told = _run(stream, key, at, late, F.lit(False), _Throttle([key, "at_us", "repeats"], quiet * SECOND, keep * SECOND), "repeats long")
    return told.select(key, F.timestamp_micros("at_us").alias("at"), "repeats")


def waiting(stream: DataFrame, key: str, at: str, right: str, run: int = 5, minutes: tuple[int, ...] = (1, 5, 15), quiet_minutes: int = 15, late: str = "1 hour") -> DataFrame:
    """Escalating waits of a lock: every `run`-th wrong code in a row begins the next of the waits; a right
    code, or that many quiet minutes, begins anew.  (key, at, minutes).  A key is forgotten when its
    quiet minutes are over."""
    processor = _Wait([key, "at_us", "minutes"], run, minutes, quiet_minutes * 60 * SECOND)
    told = _run(stream, key, at, late, F.coalesce(F.col(right), F.lit(False)), processor, "minutes int")
    return told.select(key, F.timestamp_micros("at_us").alias("at"), "minutes")


def waits_of_log(log: DataFrame, key: str, at: str, right: str, run: int = 5, minutes: tuple[int, ...] = (1, 5, 15), quiet_minutes: int = 15) -> DataFrame:
    """waiting() over a whole log, by windows: runs of wrong codes are islands between right ones and gaps."""
    from pyspark.sql import Window

    ordered = Window.partitionBy(key).orderBy(at, "_tie")
    rows = log.where(F.col(at).isNotNull()).withColumn("_tie", F.xxhash64(*[F.col(c) for c in log.columns])).withColumn("_ok", F.coalesce(F.col(right), F.lit(False)))
    rows = rows.withColumn("_rights", F.sum(F.col("_ok").cast("long")).over(ordered)).where("not _ok")
    inside = Window.partitionBy(key, "_rights").orderBy(at, "_tie")
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    gap = micros - F.lag(micros).over(inside)
    rows = rows.withColumn("_begins", F.coalesce(gap > quiet_minutes * 60 * SECOND, F.lit(False)).cast("long"))
    rows = rows.withColumn("_island", F.sum("_begins").over(inside))
    nth = F.row_number().over(Window.partitionBy(key, "_rights", "_island").orderBy(at, "_tie"))
    rows = rows.withColumn("_nth", nth).where(F.col("_nth") % run == 0)
    step = F.least(F.floor(F.col("_nth") / run), F.lit(len(minutes))).cast("int")
    return rows.select(key, at, F.get(F.array(*map(F.lit, minutes)), step - 1).alias("minutes"))
