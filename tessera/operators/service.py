"""Calls to a service from tasks: callers side by side in a task, and jobs that stop, go on and begin again as one.

A job's gate is asked before each call and told of each answer. Within a task it counts for that task alone. A job's gate
stands on the driver, which all tasks ask over the network: errors in a row are counted over all callers, one fatal answer
or a cancel stops all of them, and a used-up key is changed for all. Answers are written to the job's folder while its tasks
run, so those that came survive a stop, a lost executor and a killed driver, and a later run asks only for the rest.
"""

from __future__ import annotations

import collections
import hmac
import json
import secrets
import socket
import socketserver
import threading
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import shared_folder, ship

#: Seconds that the wait before a further call grows by, rows and seconds after which a task writes its answers.
STEP, PART_ROWS, PART_SECONDS = 5.0, 500, 5.0

_KINDS = pa.schema([("id", pa.string()), ("translation", pa.string()), ("calls", pa.int32()), ("error", pa.string())])
ANSWERS = "id string, translation string, calls int, error string"


class Fatal(Exception):
    """An answer after which no further call makes sense."""


class Gate:
    """May the next call be made? Errors in a row are counted up to `limit` (0: never), a success begins anew."""

    def __init__(self, limit: int, keys: int = 1) -> None:
        self.limit, self.keys, self.in_row, self.key, self.why = limit, keys, 0, 0, ""
        self.lock = threading.Lock()

    def ask(self, what: str, key: int = 0, why: str = "") -> tuple[str, int]:
        """(why no call may be made any more, or nothing; the key to use). what: may, good, bad, fatal, spent."""
        with self.lock:
            if what == "good":
                self.in_row = 0
            elif what == "bad":
                self.in_row += 1
                if self.limit and self.in_row >= self.limit:
                    self.why = self.why or "too many errors in a row"
            elif what == "fatal":
                self.why = self.why or why
            elif what == "spent" and key == self.key and self.key + 1 < self.keys:
                self.key += 1
            return self.why, self.key


class _Answering(socketserver.StreamRequestHandler):
    def handle(self) -> None:
        server: Any = self.server
        if not hmac.compare_digest(self.rfile.readline().strip(), server.token.encode()):
            return
        for line in self.rfile:
            what, key, why = json.loads(line)
            self.wfile.write(json.dumps(server.gate.ask(what, key, why)).encode() + b"\n")


class GateServer(socketserver.ThreadingTCPServer):
    """A gate on the driver that tasks ask; a new token for each."""

    daemon_threads = allow_reuse_address = True

    def __init__(self, gate: Gate, host: str) -> None:
        super().__init__((host, 0), _Answering)
        self.gate, self.token = gate, secrets.token_hex(16)
        threading.Thread(target=self.serve_forever, daemon=True).start()

    @property
    def place(self) -> tuple[str, int, str]:
        return *self.server_address[:2], self.token


class RemoteGate:
    """The gate of a job as its tasks see it: a connection for each thread. A driver that is gone stops the task."""

    def __init__(self, place: tuple[str, int, str]) -> None:
        self.place, self.own = place, threading.local()

    def ask(self, what: str, key: int = 0, why: str = "") -> tuple[str, int]:
        try:
            if not hasattr(self.own, "file"):
                host, port, token = self.place
                self.own.file = socket.create_connection((host, port), timeout=60).makefile("rw")
                self.own.file.write(token + "\n")
            self.own.file.write(json.dumps([what, key, why]) + "\n")
            self.own.file.flush()
            return tuple(json.loads(self.own.file.readline()))
        except (OSError, ValueError) as e:
            return f"the job's gate doesn't answer: {e}", key


def with_retries(
    call: Callable[..., str], text: str, attempts: int = 3, wait: Callable[[float], None] = lambda s: None, gate: Any = None, step: float = STEP,
    keys: Sequence[str] = (), exhausted: Sequence[str] = (),
) -> tuple[str | None, int, str | None]:
    """(answer, calls, error): at most `attempts` calls after the first, with 5, 10, 15 ... seconds before each.

    The gate is asked before each call. With keys, call takes the one in use as `key`; an error that holds a string of
    `exhausted` means that it is used up, and if there is another the call is made with that at once, which counts as no
    error. A row that no call was made for has the error 'stopped'.
    """
    gate, calls, errors = gate or Gate(0, max(1, len(keys))), 0, 0
    error = "stopped"
    while True:
        why, key = gate.ask("may")
        if why:
            return None, calls, error
        calls += 1
        try:
            answer = call(text, key=keys[key]) if keys else call(text)
        except Fatal as e:
            gate.ask("fatal", key, str(e))
            return None, calls, str(e)
        except Exception as e:  # noqa: BLE001  a service may fail in any way
            error = str(e)
            if any(x in error for x in exhausted) and gate.ask("spent", key)[1] != key:
                continue
            errors += 1
            if gate.ask("bad")[0] or errors > attempts:
                return None, calls, error
            wait(step * errors)
        else:
            gate.ask("good")
            return answer, calls, None


def ask_all(rows: Iterator[tuple[str, str]], ask: Callable[[str], tuple], callers: int) -> Iterator[tuple]:
    """(id, *ask(text)) of all rows in their order, by `callers` threads. Rows are drawn while fewer than twice as many are
    under way, so that what waits is bounded whatever the length of the input."""
    with ThreadPoolExecutor(callers) as pool:
        left: collections.deque[tuple[str, Future]] = collections.deque()
        for key, text in rows:
            left.append((key, pool.submit(ask, text)))
            if len(left) >= 2 * callers:
                key, future = left.popleft()
                yield key, *future.result()
        while left:
            key, future = left.popleft()
            yield key, *future.result()


def _asking(call: Callable[..., str], gate: Any, attempts: int, interval: float, step: float, keys: Sequence[str], exhausted: Sequence[str]) -> Callable[[str], tuple]:
    own = threading.local()

    def pause(seconds: float) -> None:
        end = time.monotonic() + seconds
        while (left := end - time.monotonic()) > 0 and not gate.ask("may")[0]:
            time.sleep(min(left, 1.0))

    def ask(text: str) -> tuple:
        if interval and hasattr(own, "asked"):
            pause(own.asked + interval - time.monotonic())
        row = with_retries(call, text or "", attempts, pause, gate, step, keys, exhausted)
        own.asked = time.monotonic()
        return row

    return ask


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
    for b in batches:
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS.types, strict=True)], schema=_KINDS)


def call_service(
    rows: DataFrame, call: Callable[..., str], attempts: int = 3, most_errors: int = 10, concurrency: int | None = None, interval: float = 0.0,
    callers: int = 1, step: float = STEP, keys: Sequence[str] = (), exhausted: Sequence[str] = (),
) -> DataFrame:
    """translation, calls and error for rows (id, original) by a function that calls a service.

    `concurrency` is the number of partitions, each of which has `callers` callers; a caller waits `interval` seconds after
    an answer. An error is followed by `attempts` further calls, with 5, 10, 15 ... seconds before them. A partition stops
    calling after most_errors errors in a row (0: never) or a Fatal one, and leaves the rest with the error 'stopped', to be
    asked for by a later run. run_job() does so for all partitions together. Null texts are empty; the order is kept.
    """
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate = Gate(most_errors, max(1, len(keys)))
        held: list[tuple] = []
        for row in ask_all(_pairs(batches), _asking(call, gate, attempts, interval, step, keys, exhausted), callers):
            held.append(row)
            if len(held) == PART_ROWS:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    rows = rows.select(F.col("id").cast("string"), "original")
    return (rows.repartition(concurrency) if concurrency else rows).mapInArrow(run, ANSWERS)


class Job:
    """A run of run_job() that goes on in the background: wait() for its end, cancel() it, answers() at any time."""

    def __init__(self, spark: SparkSession, folder: str, gate: Gate, rows: DataFrame) -> None:
        self.spark, self.folder, self.gate, self.rows, self.group = spark, folder, gate, rows, f"service-{uuid.uuid4().hex}"
        self.failed: Exception | None = None
        self.thread: threading.Thread | None = None

    def cancel(self, why: str = "cancelled", grace: float = 30.0) -> None:
        """No further call is made. Tasks whose calls don't return within `grace` seconds are ended by Spark."""
        self.gate.ask("fatal", why=why)
        self.thread.join(grace)
        if self.thread.is_alive():
            self.spark.sparkContext.cancelJobGroup(self.group)
            self.thread.join()

    def wait(self, seconds: float | None = None) -> Job:
        self.thread.join(seconds)
        if self.failed and not self.gate.why:
            raise self.failed
        return self

    @property
    def stopped(self) -> str:
        """Why no further call was made; empty if all were."""
        return self.gate.why

    def answers(self) -> DataFrame:
        """id, translation, calls and error of all rows: what has come so far, and 'stopped' for the rest."""
        found = read_answers(self.spark, self.folder)
        rest = self.rows.select("id").join(found.select("id"), "id", "left_anti")
        return found.unionByName(rest.select("id", F.lit(None).cast("string").alias("translation"), F.lit(0).alias("calls"), F.lit("stopped").alias("error")))


def read_answers(spark: SparkSession, folder: str) -> DataFrame:
    """The answers that a job's folder holds, one an id: a translation if there is one, and all calls made for it."""
    parts = spark.read.schema(ANSWERS).option("recursiveFileLookup", "true").parquet(folder)
    best = F.min_by(F.struct("translation", "error"), F.struct(F.col("error").isNotNull(), F.col("error")))
    return parts.groupBy("id").agg(best.alias("b"), F.sum("calls").cast("int").alias("calls")).select("id", "b.translation", "calls", "b.error")


def run_job(
    rows: DataFrame, call: Callable[..., str], folder: str | None = None, attempts: int = 3, most_errors: int = 10, concurrency: int | None = None,
    interval: float = 0.0, callers: int = 1, step: float = STEP, keys: Sequence[str] = (), exhausted: Sequence[str] = (),
) -> Job:
    """Start call_service() as a job whose callers share one gate, in the background. Ids are unique.

    A job stops for all its tasks: after most_errors errors in a row over all callers, after a Fatal answer, or by
    Job.cancel(). No more calls are made then than there were callers at that moment. Answers are written in parts to
    `folder` (in the cluster's shared scratch space if none is given) as they come. A job that is given the folder of an
    earlier one asks only for what has no translation there; a task that Spark runs again does likewise for its own rows.
    """
    spark = rows.sparkSession
    ship(spark)
    folder = folder or shared_folder(spark, "answers")
    files, path = _open(folder)
    files.create_dir(path, recursive=True)
    rows = rows.select(F.col("id").cast("string").alias("id"), "original")
    known = read_answers(spark, folder).filter("error IS NULL").select("id")
    left = rows.join(known, "id", "left_anti")
    left = left.repartition(concurrency, "id") if concurrency else left
    gate = Gate(most_errors, max(1, len(keys)))
    server = GateServer(gate, spark.conf.get("spark.driver.host"))
    place, job = server.place, Job(spark, folder, gate, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        files, path = _open(folder)
        own = f"{path}/run-{job_id}-{task.partitionId():06d}"
        files.create_dir(own, recursive=True)
        came = set()
        if task.attemptNumber():  # what an earlier attempt has written
            for f in files.get_file_info(fs.FileSelector(own)):
                if f.path.endswith(".parquet"):
                    t = pq.read_table(f.path, filesystem=files)
                    came |= {i for i, e in zip(t["id"].to_pylist(), t["error"].to_pylist(), strict=True) if e is None}
        held: list[tuple] = []
        n, since = 0, time.monotonic()

        def write() -> None:
            at = f"{own}/.{uuid.uuid4().hex}"  # hidden until it is whole
            pq.write_table(pa.Table.from_batches([_batch(held)]), at, filesystem=files)
            files.move(at, f"{own}/{at.rsplit('.', 1)[1]}.parquet")

        asked = (x for x in _pairs(batches) if x[0] not in came)
        for row in ask_all(asked, _asking(call, RemoteGate(place), attempts, interval, step, keys, exhausted), callers):
            if row[2]:  # rows that no call was made for have no answer
                held.append(row)
                n += 1
            if held and (len(held) >= PART_ROWS or time.monotonic() - since > PART_SECONDS):
                write()
                held, since = [], time.monotonic()
        if held:
            write()
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    job_id = job.group[-32:]

    def work() -> None:
        spark.sparkContext.setJobGroup(job.group, f"calls to a service, {folder}", interruptOnCancel=True)
        try:
            left.mapInArrow(run, "n long").agg(F.sum("n")).collect()
        except Exception as e:  # noqa: BLE001  told by wait()
            job.failed = e
        finally:
            server.shutdown()
            server.server_close()

    job.thread = InheritableThread(target=work, daemon=True, session=spark)
    job.thread.start()
    return job


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)
