"""What stands around a translation job: engines by name, prompts' languages, batches that are resumed."""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.service import STEP, Job, call_service, run_job
from tessera.operators.translate import Translator, reversing


@dataclasses.dataclass(frozen=True)
class Engine:
    """A service: its translator, and how it may be asked."""

    name: str
    translator: Translator
    free: bool = False
    custom: bool = False
    concurrency: int = 0
    interval: float = 0.0
    attempts: int = 3
    timeout: float = 10.0
    most_errors: int = 10
    keys: tuple[str, ...] = ()
    exhausted: tuple[str, ...] = ()


DEFAULT = Engine("swap", reversing, free=True)


def find_engine(name: str | None, builtin: Sequence[Engine] = (), custom: Mapping[str, Engine] | None = None, default: Engine = DEFAULT) -> Engine:
    """A built-in engine of that name, else a custom one, else the default."""
    return next((e for e in builtin if e.name == name), (custom or {}).get(name or "", default))


def call_engine(rows: DataFrame, engine: Engine, call: Callable[..., str], step: float = STEP) -> DataFrame:
    """call_service() as an engine may be asked: so many callers, so long between requests, so many tries and errors, and
    its keys one after another. call takes a text and timeout, in seconds, and key if the engine has any."""
    ask = functools.partial(call, timeout=engine.timeout)
    return call_service(rows, ask, engine.attempts, engine.most_errors, engine.concurrency or None, engine.interval, step=step, keys=engine.keys, exhausted=engine.exhausted)


def start_engine(rows: DataFrame, engine: Engine, call: Callable[..., str], folder: str | None = None, callers: int = 1, step: float = STEP) -> Job:
    """run_job() as an engine may be asked: `concurrency` callers in all, `callers` of them in each task."""
    ask = functools.partial(call, timeout=engine.timeout)
    tasks = -(-engine.concurrency // callers) if engine.concurrency else None
    return run_job(rows, ask, folder, engine.attempts, engine.most_errors, tasks, engine.interval, min(callers, engine.concurrency or callers), step, engine.keys, engine.exhausted)


def rotate_key(keys: Sequence[str], used: int, error: str, exhausted: Sequence[str]) -> int | None:
    """The index of the next key after an error that says that a key is used up; null when there is none, or for others."""
    return used + 1 if any(x in error for x in exhausted) and used + 1 < len(keys) else None


def multipart(parts: Mapping[str, tuple[str | None, str]], boundary: str) -> str:
    """The body of a form with fields (name: file name or none, content)."""
    out = []
    for name, (file, content) in parts.items():
        head = f'Content-Disposition: form-data; name="{name}"' + (f'; filename="{file}"\r\nContent-Type: application/json' if file else "")
        out.append(f"--{boundary}\r\n{head}\r\n\r\n{content}\r\n")
    return "".join(out) + f"--{boundary}--\r\n"


#: States of a batch after which nothing more happens to it (fixed values).
TERMINAL = ("completed", "failed", "expired", "cancelled")


def batch_action(status: Column, batch_id: Column) -> Column:
    """What to do about each job: create a batch, apply its results, wait for it, or begin anew."""
    return F.when(F.coalesce(batch_id, F.lit("")) == "", "create").when(status == "completed", "apply").when(status.isin(*TERMINAL), "create").otherwise("wait")


def jobs(info: DataFrame) -> DataFrame:
    """cache_id and action of every job from its info rows (cache_id, key, value)."""
    wide = info.groupBy("cache_id").pivot("key", ["batch_id", "batch_status"]).agg(F.max("value"))
    return wide.select("cache_id", batch_action(F.col("batch_status"), F.col("batch_id")).alias("action"))
