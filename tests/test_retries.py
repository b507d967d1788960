"""Calls from a stream: timers instead of sleep, state that a new start goes on with."""

import time

from pyspark.sql import functions as F

from tessera.operators.translate import error_runs
from tessera.streaming import retries as R


def noted(path, answer):
    def call(text, **more):
        with open(path, "a") as f:
            f.write(text + "\n")
        return answer(path, text, **more)

    return call


def feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def run(df, tmp_path, name, until, seconds=90):
    query = df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(processingTime="100 milliseconds").start()
    spark, end = df.sparkSession, time.time() + seconds
    try:
        while time.time() < end:
            time.sleep(0.5)
            assert query.exception() is None, query.exception()
            try:
                found = spark.read.parquet(str(tmp_path / name)).collect()
            except Exception:  # noqa: BLE001  nothing written yet
                continue
            if until(found):
                return found
        raise AssertionError("nothing came")
    finally:
        query.stop()


REQUESTS = "caller string, id string, original string"


def test_rows_wait_and_a_new_start_goes_on(spark, tmp_path):
    def flaky(path, text, key=None):
        """Fails the first two times, with a key that runs out."""
        if key == "old":
            raise OSError("quota exceeded")
        if text.startswith("bad") and open(path).read().split().count(text) < 4:  # one of these calls was with the old key
            raise OSError("down")
        if text == "never":
            raise OSError("down")
        return text.upper()

    log = tmp_path / "calls"
    feed(spark, tmp_path / "in", [("a", "1", "bad1"), ("a", "2", "x"), ("a", "3", "never")], REQUESTS)
    stream = spark.readStream.schema(REQUESTS).parquet(str(tmp_path / "in"))
    calls = R.retried(stream, noted(log, flaky), attempts=2, most_errors=0, step=0.3, keys=["old", "new"], exhausted=["quota"])
    found = run(calls, tmp_path, "out", lambda rows: sum(r.last for r in rows) == 3)
    last = {r.id: (r.translation, r.error, r.calls) for r in found if r.last}
    assert last == {"1": ("BAD1", None, 4), "2": ("X", None, 1), "3": (None, "down", 3)}
    assert sorted(log.read_text().split()) == sorted(["bad1"] * 4 + ["x"] + ["never"] * 3)
    assert sorted(r.n for r in found) == list(range(1, 9))

    feed(spark, tmp_path / "in", [("a", "4", "y")], REQUESTS)
    more = run(calls, tmp_path, "out", lambda rows: sum(r.last for r in rows) == 4)
    assert [(r.id, r.n, r.translation) for r in more if r.id == "4"] == [("4", 9, "Y")]  # the caller's count and key went on
    assert sorted(log.read_text().split()) == sorted(["bad1"] * 4 + ["x", "y"] + ["never"] * 3)


def test_a_caller_stops_where_runs_of_errors_say_so(spark, tmp_path):
    def answer(path, text):
        if text.startswith("bad"):
            raise OSError("down")
        return text

    rows = [("a", str(k), t) for k, t in enumerate(["bad0", "ok", "bad1", "bad2", "bad3", "ok", "ok"])] + [("b", "0", "bad"), ("b", "1", "ok"), ("b", "2", "bad")]
    feed(spark, tmp_path / "in", rows, REQUESTS)
    stream = spark.readStream.schema(REQUESTS).parquet(str(tmp_path / "in"))
    calls = R.retried(stream, noted(tmp_path / "calls", answer), attempts=0, most_errors=3, step=0.1)
    found = run(calls, tmp_path, "out", lambda rows: sum(r.last for r in rows) == 10)
    made = spark.createDataFrame(found).filter("n is not null")
    runs = error_runs(made, F.col("error").isNotNull(), ["caller"], ["n"], 3).collect()
    assert [(r.caller, r["first"], r["last"]) for r in runs] == [("a", 3, 5)]
    stopped = {(r.caller, r.id) for r in found if r.error == "stopped"}
    assert stopped == {("a", "5"), ("a", "6")}


def test_batches_are_asked_for_until_they_end(spark, tmp_path):
    def poll(path, batch_id):
        return "completed" if open(path).read().split().count(batch_id) >= 3 else "running"

    feed(spark, tmp_path / "in", [("j1", "b1"), ("j2", "b2")], "job string, batch_id string")
    stream = spark.readStream.schema("job string, batch_id string").parquet(str(tmp_path / "in"))
    done = R.finished_batches(stream, noted(tmp_path / "polls", poll), every=0.2)
    found = run(done, tmp_path, "out", lambda rows: len(rows) == 2)
    assert sorted((r.job, r.batch_id, r.status, r.polls) for r in found) == [("j1", "b1", "completed", 3), ("j2", "b2", "completed", 3)]
    assert sorted((tmp_path / "polls").read_text().split()) == ["b1"] * 3 + ["b2"] * 3
