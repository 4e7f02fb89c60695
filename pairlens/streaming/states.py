"""Step logs and retry states as streams with state of their own.

State lives in Spark's store and goes on from a checkpoint.  Steps keep the
line that was written last; batches keep their calls until they are decided,
and a batch whose next call never comes expires by event time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What transformWithStateInPandas needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

DECIDED = "batch long, row int, temperature double, exhausted boolean, expired boolean"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set(*STATE_STORE)


def walk(calls: Sequence[tuple[float, bool]], rows: int, last: float) -> tuple[list[tuple[float, bool]], bool]:
    """Per row of a batch what the calls so far say (temperature, needs another),
    and whether all is decided.

    Calls come by level: one for each row, then one for each that needs a higher
    temperature, in order.  Mixed temperatures in a level, or calls after all is
    decided, are an error."""
    state, left, at = [(0.0, False)] * rows, list(range(rows)), 0
    while left and at < len(calls):
        level = calls[at : at + len(left)]
        if len({t for t, _ in level}) > 1:
            raise ValueError(f"a level of mixed temperatures: {calls}")
        if len(level) < len(left):
            break
        for r, (t, needs) in zip(left, level, strict=True):
            state[r] = float(t or 0.0), needs
        at += len(left)
        left = [r for r in left if state[r][1] and state[r][0] != last]
        over = any(state[r][1] and state[r][0] > last for r in range(rows))
        if over:
            raise ValueError(f"a temperature beyond the last: {calls}")
    if not left and at < len(calls):
        raise ValueError(f"calls after all rows are decided: {calls}")
    return state, not left


class Retries(StatefulProcessor):
    """Calls of a batch by place, until all rows are decided or time is up."""

    def __init__(self, last: float, wait_ms: int):
        self.last, self.wait_ms = last, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.calls = handle.getMapState("calls", "pos long", "temperature double, needs boolean")
        self.size = handle.getValueState("size", "rows int, timer long")

    def _known(self) -> tuple[list[tuple[float, bool]], int]:
        """The calls from the first without a gap, and how many there are at all."""
        held = {k[0]: (v[0], bool(v[1])) for k, v in self.calls.iterator()}
        n = 0
        while n in held:
            n += 1
        return [held[k] for k in range(n)], len(held)

    def _result(self, batch: int, state, expired: bool) -> pd.DataFrame:
        return pd.DataFrame({
            "batch": [batch] * len(state), "row": range(len(state)), "temperature": [t for t, _ in state],
            "exhausted": [n for _, n in state], "expired": [expired] * len(state)}).astype({"batch": "int64", "row": "int32"})

    def _clear(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.calls.clear()
        self.size.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        size, newest = None, 0
        for pdf in rows:
            for pos, n, t, needs, at in zip(pdf["pos"], pdf["rows"], pdf["temperature"], pdf["needs"], pdf["at"], strict=True):
                self.calls.updateValue((int(pos),), (float(t), bool(needs)))
                size, newest = int(n), max(newest, int(pd.Timestamp(at).timestamp() * 1000))
        known, count = self._known()
        state, done = walk(known, size, self.last)
        if done and count == len(known):
            self._clear()
            yield self._result(int(key[0]), state, False)
            return
        timer = max(newest, self.size.get()[1] - self.wait_ms if self.size.exists() else 0) + self.wait_ms
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timer)
        self.size.update((size, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.size.exists():
            state, _ = walk(self._known()[0], self.size.get()[0], self.last)
            self._clear()
            yield self._result(int(key[0]), state, True)

    def close(self) -> None:
        pass


def retry_stream(calls: DataFrame, temperatures: Sequence[float], wait_ms: int = 600_000, delay: str = "0 seconds") -> DataFrame:
    """A stream of calls (batch, pos, rows, temperature, needs, at) as decided
    batches: (batch, row, temperature, exhausted, expired), each batch once.

    Calls of a batch may come in any order and over any number of files, ``delay``
    behind the newest at most; what comes later still is dropped.  A batch
    that lacks a call ``wait_ms`` after its newest one, by event time, comes out
    ``expired`` with what its levels so far say, and its state goes."""
    use_state_store(calls.sparkSession)
    return calls.withWatermark("at", delay).groupBy("batch").transformWithStateInPandas(
        Retries(float(temperatures[-1]), wait_ms), DECIDED, "Append", "EventTime")


class LastLine(StatefulProcessor):
    """The line of a step that was written last."""

    def __init__(self, columns: str, names: list[str], ttl_ms: int | None):
        self.columns, self.names, self.ttl_ms = columns, names, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", self.columns, self.ttl_ms) if self.ttl_ms else handle.getValueState("best", self.columns)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.best.get() if self.best.exists() else None
        best = tuple(held) if held is not None else None
        for pdf in rows:
            top = pdf.loc[pdf["seen"].idxmax()]
            if best is None or top["seen"] >= best[0]:
                best = tuple(None if pd.isna(top[c]) else getattr(top[c], "item", lambda v=top[c]: v)() for c in ["seen", *self.names])
        if held is None or best != tuple(held):
            self.best.update(best)
            yield pd.DataFrame([[key[0], *best]], columns=["step", "seen", *self.names])

    def close(self) -> None:
        pass


def last_line_stream(steps: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A stream of log lines (step, seen, ...) as one of changes: a step's row
    whenever a later line of it has come.  ``seen`` (long) orders the lines.

    A step that isn't written for ``ttl_ms`` is forgotten; that goes by the
    clock, so such a stream has no end and isn't for ``drained``."""
    use_state_store(steps.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in steps.schema.fields}
    names = [c for c in steps.columns if c not in ("step", "seen")]
    columns = ", ".join(["seen long", *[f"{c} {kinds[c]}" for c in names]])
    return steps.select("step", "seen", *names).groupBy("step").transformWithStateInPandas(
        LastLine(columns, names, ttl_ms), f"step {kinds['step']}, {columns}", "Update", "ProcessingTime" if ttl_ms else "None")


def drained(stream: DataFrame, checkpoint: str, to: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is, from its checkpoint on, and gives what it
    has put out in all its runs.  Each run of a batch overwrites its own folder,
    so one that is done again leaves no row twice."""
    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{to}/run={number}")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{to}/run=*")
