"""Callers in a task, and jobs that stop, go on and begin again as one."""

import os
import subprocess
import sys
import threading
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import jobs as J
from tessera.operators import service as S
from tessera.operators.translate import reversing

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows(spark, n, parts=4):
    return spark.range(0, n, 1, parts).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("t"), "id").alias("original"))


def lines(path):
    return path.read_text().split() if path.exists() else []


def counting(path, answer):
    """A service that notes each call in a file that all tasks share."""

    def call(text, **more):
        with open(path, "a") as f:
            f.write(text + "\n")
        return answer(text, **more)

    return call


def test_callers_share_a_task_and_keep_order(spark):
    def call(text):
        time.sleep(0.1)
        return text.upper()

    S.call_service(rows(spark, 2, 2), call).collect()  # starts workers
    began = time.time()
    got = [r.translation for r in S.call_service(rows(spark, 320, 2), call, callers=16).collect()]
    assert got == [f"T{k}" for k in range(320)] and time.time() - began < 320 * 0.1 / 8


def test_what_waits_in_a_task_is_bounded():
    drawn, lock = [], threading.Lock()

    def source():
        for k in range(1000):
            with lock:
                drawn.append(k)
            yield str(k), "x"

    found = S.ask_all(source(), lambda t: (t, 1, None), callers=4)
    assert [next(found)[0] for _ in range(3)] == ["0", "1", "2"] and len(drawn) <= 3 + 2 * 4
    assert [x[0] for x in found] == [str(k) for k in range(3, 1000)]


def test_retries_ask_the_gate_and_wait():
    waits, gate = [], S.Gate(3)

    def fail(text):
        raise OSError("down")

    assert S.with_retries(fail, "x", 5, waits.append, gate) == (None, 3, "down") and waits == [5, 10]
    assert S.with_retries(fail, "y", 5, waits.append, gate) == (None, 0, "stopped")


def test_a_used_up_key_is_changed_for_all():
    gate, used = S.Gate(2, keys=3), []

    def call(text, key):
        used.append(key)
        if key != "c":
            raise OSError("quota exceeded")
        return key

    assert S.with_retries(call, "x", 0, gate=gate, keys="abc", exhausted=["quota"]) == ("c", 3, None)
    assert S.with_retries(call, "y", 0, gate=gate, keys="abc", exhausted=["quota"]) == ("c", 1, None)
    assert gate.ask("spent", 0) == ("", 2) and gate.ask("spent", 2) == ("", 2)  # a late word of the first key, and no key left
    assert S.with_retries(lambda t, key: call(t, "a"), "z", 1, gate=gate, keys="abc", exhausted=["quota"])[1:] == (2, "quota exceeded")


def test_a_fatal_answer_stops_all_tasks_and_answers_survive(spark, tmp_path):
    log, folder = tmp_path / "calls", f"file://{tmp_path}/answers"

    def answer(text):
        time.sleep(0.05)
        if text == "t30":
            raise S.Fatal("the key is wrong")
        return text.upper()

    df = rows(spark, 400, 8)
    job = S.run_job(df, counting(log, answer), folder, callers=2).wait()
    calls = lines(log)
    found = {r.id: r for r in job.answers().collect()}
    assert job.stopped == "the key is wrong" and len(found) == 400
    assert calls.index("t30") + 1 + 16 + 8 >= len(calls) < 400  # those under way at that moment, and as many while the word goes round
    good = {i for i, r in found.items() if r.error is None}
    assert {f"t{i}" for i in good} == set(calls) - {"t30"} and found["30"].error == "the key is wrong"
    assert all(r.translation == f"T{i}" for i, r in found.items() if i in good) and all(r.error == "stopped" for i, r in found.items() if i not in good and i != "30")

    again = S.run_job(df, counting(log, lambda t: t.upper()), folder, callers=2).wait()
    assert again.stopped == "" and sorted(lines(log)[len(calls) :]) == sorted(f"t{k}" for k in range(400) if str(k) not in good)
    assert {r.id: (r.translation, r.error) for r in again.answers().collect()} == {str(k): (f"T{k}", None) for k in range(400)}


def test_errors_in_a_row_count_over_all_tasks(spark, tmp_path):
    log = tmp_path / "calls"

    def down(text):
        time.sleep(0.02)
        raise OSError("down")

    job = S.run_job(rows(spark, 200, 8), counting(log, down), attempts=2, most_errors=10, callers=2, step=0).wait()
    assert job.stopped == "too many errors in a row" and 10 <= len(lines(log)) <= 10 + 16
    assert job.answers().filter("error = 'stopped'").count() >= 174


def test_cancel_ends_calls_that_hang(spark, tmp_path):
    def answer(text):
        if text == "t3":
            time.sleep(600)
        return text

    job = S.run_job(rows(spark, 8, 8), counting(tmp_path / "calls", answer), attempts=0)
    while len(lines(tmp_path / "calls")) < 8:
        time.sleep(0.1)
    time.sleep(1)
    began = time.time()
    job.cancel("enough", grace=1.0)
    job.wait()
    assert time.time() - began < 60 and job.stopped == "enough"
    assert {r.id: r.error for r in job.answers().collect()} == {str(k): "stopped" if k == 3 else None for k in range(8)}


def test_a_failing_task_is_told_and_run_again_without_calls(spark, tmp_path):
    with pytest.raises(Exception, match="no such column|UNRESOLVED|cannot be resolved"):
        S.run_job(spark.range(3), str.upper)
    broken = rows(spark, 4, 1).select("id", F.raise_error(F.lit("gone")).cast("string").alias("original"))
    with pytest.raises(Exception, match="gone"):
        S.run_job(broken, str.upper).wait()


def test_an_engine_as_a_job(spark, tmp_path):
    def call(text, timeout, key):
        if key == "old":
            raise OSError("insufficient_quota")
        return f"{text}/{timeout}"

    engine = J.Engine("e", reversing, concurrency=4, timeout=2.5, keys=("old", "new"), exhausted=("insufficient_quota",))
    job = J.start_engine(rows(spark, 20), engine, counting(tmp_path / "calls", call), callers=2).wait()
    assert {r.id: r.translation for r in job.answers().collect()} == {str(k): f"t{k}/2.5" for k in range(20)}
    assert 20 < len(lines(tmp_path / "calls")) <= 24


SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "1g").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", "file://{shared}").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
from tessera.operators import service
rows = spark.range(0, 20, 1, 4).selectExpr("cast(id as string) id", "concat('t', id) original")
def call(text):
    if text == "t7":
        raise OSError("bad")
    return text.upper()
got = service.call_service(rows, call, attempts=1, step=0).collect()
job = service.run_job(rows, call, attempts=1, step=0, callers=2).wait()
more = job.answers().collect()
for found in (got, more):
    assert {{r.id: r.translation or r.error for r in found}} == {{str(k): "bad" if k == 7 else f"T{{k}}" for k in range(20)}}, found
print("fine")
spark.stop()
"""


def test_workers_without_the_repository(tmp_path):
    script = tmp_path / "job.py"
    (tmp_path / "shared").mkdir()
    script.write_text(SCRIPT.format(repo=REPO, shared=tmp_path / "shared"))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "fine" in done.stdout, done.stderr[-3000:]
