from pyspark.sql import functions as F

from tessera.streaming import breaker as B


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    want = sorted(map(tuple, B.openings(B.requests(events), 2).collect()))
    assert want
    parts = events.withColumn("part", F.floor((F.row_number().over(B.Window.orderBy("ts", "event_id")) - 1) / 400))
    for k in range(parts.agg(F.max("part")).first()[0] + 1):
        parts.filter(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    B.run_to(B.openings(B.requests(stream), 2), str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("caller", "event_id").collect()))
    assert got == want


def test_windows(spark, sf):
    log = B.requests(spark.read.parquet(f"{sf}/events.parquet"))
    assert B.watched_errors(log).agg(F.sum("requests")).first()[0] == log.count()
