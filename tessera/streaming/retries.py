"""Calls to a service from a stream: rows that fail wait as state and are called again by timers, no task sleeps.

State is kept by caller: its errors in a row, the key in use, and the rows that wait. It is as durable as the query's
checkpoint: a query that is started again goes on with what waited and makes no call of a finished batch again. A batch that
was cut off is run again as a whole, and so are its calls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.jobs import TERMINAL
from tessera.operators.service import STEP, Fatal
from tessera.runtime import ship

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"

#: A row a call, in order `n` of its caller, and a row for each that no call was made for (n null).
CALLS = "caller string, n long, id string, calls int, translation string, error string, last boolean"


def keep_timers(spark: SparkSession) -> None:
    """Timers need the state store that is kept on disk; a session that names none gets it."""
    if not spark.conf.get(_PROVIDER, None) or spark.conf.get(_PROVIDER).endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Retrying(StatefulProcessor):
    """Calls for the rows of a caller; those that fail wait 5, 10, 15 ... seconds for each further call."""

    def __init__(self, call: Callable[..., str], attempts: int, limit: int, step: float, keys: Sequence[str], exhausted: Sequence[str]) -> None:
        self.call, self.attempts, self.limit, self.step, self.keys, self.exhausted = call, attempts, limit, step, list(keys), list(exhausted)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.caller = handle.getValueState("caller", "n long, in_row int, key int, why string")
        self.waiting = handle.getMapState("waiting", "id string", "original string, calls int, errors int, due long")

    def _load(self) -> dict[str, Any]:
        n, in_row, key, why = self.caller.get() if self.caller.exists() else (0, 0, 0, "")
        return {"n": n, "in_row": in_row, "key": key, "why": why}

    def _ask(self, who: str, s: dict[str, Any], row: tuple, now: int, out: list[tuple]) -> None:
        """One row's turn: a call, or more if a key is used up; it is answered, given up or waits."""
        key_, original, calls, errors = row
        while not s["why"]:
            s["n"], calls = s["n"] + 1, calls + 1
            answer = error = None
            fatal = spent = False
            try:
                answer = self.call(original or "", key=self.keys[s["key"]]) if self.keys else self.call(original or "")
            except Fatal as e:
                error, fatal = str(e), True
            except Exception as e:  # noqa: BLE001  a service may fail in any way
                error = str(e)
                spent = any(x in error for x in self.exhausted) and s["key"] + 1 < len(self.keys)
            errors += error is not None and not spent
            if error is None:
                s["in_row"] = 0
            elif fatal:
                s["why"] = error
            elif spent:
                s["key"] += 1
            else:
                s["in_row"] += 1
                if self.limit and s["in_row"] >= self.limit:
                    s["why"] = "too many errors in a row"
            last = not spent and (error is None or fatal or bool(s["why"]) or errors > self.attempts)
            out.append((who, s["n"], key_, calls, answer, error, last))
            if last:
                return
            if not spent:
                due = now + int(1000 * self.step * errors)
                self.waiting.updateValue((key_,), (original, calls, errors, due))
                self.handle.registerTimer(due)
                return
        out.append((who, None, key_, calls, None, "stopped", True))

    def _done(self, s: dict[str, Any], out: list[tuple]) -> Iterator[pd.DataFrame]:
        self.caller.update((s["n"], s["in_row"], s["key"], s["why"]))
        frame = pd.DataFrame(out, columns=["caller", "n", "id", "calls", "translation", "error", "last"])
        yield frame.astype({"n": "Int64", "calls": "int32"})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        s, out, now = self._load(), [], timerValues.getCurrentProcessingTimeInMs()
        for frame in rows:
            for id_, original in zip(frame["id"], frame["original"], strict=True):
                self._ask(key[0], s, (id_, original, 0, 0), now, out)
        yield from self._done(s, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        s, out, now = self._load(), [], timerValues.getCurrentProcessingTimeInMs()
        due = sorted((v[3], k[0], v) for k, v in self.waiting.iterator() if v[3] <= expiredTimerInfo.getExpiryTimeInMs())
        for _, id_, v in due:
            self.waiting.removeKey((id_,))
            self._ask(key[0], s, (id_, v[0], v[1], v[2]), now, out)
        yield from self._done(s, out)

    def close(self) -> None:
        pass


def retried(
    requests: DataFrame, call: Callable[..., str], attempts: int = 3, most_errors: int = 10, step: float = STEP, keys: Sequence[str] = (), exhausted: Sequence[str] = ()
) -> DataFrame:
    """CALLS of a stream of requests (caller, id, original): a row for each call as it is made, `last` on a row's last one.

    An error is followed by `attempts` further calls, after 5, 10, 15 ... seconds of processing time, while others go on.
    A caller stops after most_errors errors in a row (0: never) or a Fatal answer; what it has then, and what comes later,
    has the error 'stopped'. An error that holds a string of `exhausted` changes the caller's key and is no error if there
    is another. Ids are unique to a caller. A null text is empty. What a caller is asked for at once is one task's work.
    """
    spark = requests.sparkSession
    ship(spark)
    keep_timers(spark)
    rows = requests.select(F.col("caller").cast("string").alias("caller"), F.col("id").cast("string").alias("id"), "original")
    return rows.groupBy("caller").transformWithStateInPandas(Retrying(call, attempts, most_errors, step, keys, exhausted), CALLS, "append", "processingTime")


class Polling(StatefulProcessor):
    """Asks for a batch's status until it is a last one."""

    def __init__(self, poll: Callable[[str], str], every: float) -> None:
        self.poll, self.every = poll, every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.seen = handle, handle.getValueState("batch", "batch_id string, polls int")

    def _look(self, job: str, batch_id: str, polls: int, now: int) -> Iterator[pd.DataFrame]:
        try:
            status = self.poll(batch_id)
        except Exception as e:  # noqa: BLE001  asked again with the next timer
            status = f"error: {e}"
        if status in TERMINAL:
            self.seen.clear()
            yield pd.DataFrame({"job": [job], "batch_id": [batch_id], "status": [status], "polls": [polls + 1]}).astype({"polls": "int32"})
        else:
            self.seen.update((batch_id, polls + 1))
            self.handle.registerTimer(now + int(1000 * self.every))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        ids = [x for frame in rows for x in frame["batch_id"]]
        for timer in list(self.handle.listTimers()):  # a job that has a new batch forgets the one before
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        yield from self._look(key[0], max(ids), 0, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            batch_id, polls = self.seen.get()
            yield from self._look(key[0], batch_id, polls, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def finished_batches(batches: DataFrame, poll: Callable[[str], str], every: float = 60.0) -> DataFrame:
    """job, batch_id, status and polls of a stream of batches (job, batch_id) once their status is a last one. poll takes a
    batch_id; it is asked at once and then every so many seconds. Of several batches of a job at once the largest id counts."""
    spark = batches.sparkSession
    ship(spark)
    keep_timers(spark)
    rows = batches.select(F.col("job").cast("string").alias("job"), F.col("batch_id").cast("string").alias("batch_id"))
    return rows.groupBy("job").transformWithStateInPandas(Polling(poll, every), "job string, batch_id string, status string, polls int", "append", "processingTime")
