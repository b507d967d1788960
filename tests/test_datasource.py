"""Formats of files as data sources: round trips, filters that leave files out, and jobs that fail."""

import zipfile

import pytest
from pyspark.sql import functions as F
from test_epub import NCX, book

from tessera.operators import translate as TR
from tessera.sources import datasource as D

SRT = "1\n00:01 --> 00:02\nHello\nthere\n\n2\n00:03 --> 00:04\nÉcole\n\n3"
PGN = '[Event "x"]\n1. e4 {a fine move} e5 {12} 2. Nf3 {Réti} *\n'


@pytest.fixture(scope="module", autouse=True)
def sources(spark):
    D.register(spark)


def read(spark, kind, path, **options):
    return spark.read.format(kind).options(**options).load(f"file://{path}")


def test_subtitles(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(5):
        (tmp_path / "in" / f"{k}.srt").write_bytes(SRT.replace("\n", "\r\n").encode("latin-1"))
    (tmp_path / "in" / "_no.srt").write_text("x")
    (tmp_path / "in" / "no.txt").write_text("x")
    rows = read(spark, "srt", tmp_path / "in", encoding="latin-1")
    first = rows.filter(F.col("path") == f"{tmp_path}/in/0.srt")
    assert [tuple(r)[1:] for r in first.orderBy("seq").collect()] == [(0, "1", "00:01 --> 00:02", "Hello\nthere"), (1, "2", "00:03 --> 00:04", "École"), (2, "3", "", "")]
    assert rows.count() == 15
    new = rows.withColumn("text", TR.reversing(F.col("text")))
    new.repartition("path").write.format("srt").mode("append").save(f"file://{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.name != "_staging") == [f"{k}.srt" for k in range(5)]
    assert "hELLO\nTHERE" in (tmp_path / "out" / "3.srt").read_text()
    again = read(spark, "srt", tmp_path / "out").withColumn("text", TR.reversing(F.col("text")))
    assert again.count() == 15 and again.filter("text = 'Hello\nthere'").count() == 5
    new.filter("path like '%/4.srt'").repartition("path").write.format("srt").mode("overwrite").save(f"file://{tmp_path}/out")
    assert [p.name for p in (tmp_path / "out").glob("*.srt")] == ["4.srt"]


def test_files_are_left_out_by_name(spark, tmp_path):
    for name in ("a.srt", "b.srt", "c.srt"):
        (tmp_path / name).write_text(SRT)
    rows = read(spark, "srt", tmp_path, pathGlobFilter="[ab].srt")
    assert rows.filter(F.col("path").endswith("a.srt")).count() == 3 and rows.count() == 6
    assert D.SubtitleReader({"path": str(tmp_path), "pathglobfilter": "c*"}, ".srt").partitions()[0].paths == [f"{tmp_path}/c.srt"]


def test_games(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pgn").write_text(PGN)
    rows = read(spark, "pgn", tmp_path / "in")
    assert [r.text for r in rows.filter("kind = 'comment'").orderBy("seq").collect()] == ["{a fine move}", "{Réti}"]
    rows.repartition("path").write.format("pgn").mode("append").save(f"file://{tmp_path}/out")
    assert (tmp_path / "out" / "a.pgn").read_text() == PGN


def test_books(spark, tmp_path):
    (tmp_path / "in").mkdir()
    book(tmp_path / "in" / "a.epub", '<item id="t" href="toc.ncx" media-type="application/x-dtbncx+xml"/>', "toc.ncx", NCX)
    (tmp_path / "in" / "b.epub").write_bytes(b"none")
    rows = read(spark, "epub", tmp_path / "in")
    assert rows.filter("part = 'error'").count() == 1
    new = rows.filter("part in ('contents', 'page')").withColumn("text", F.replace("text", F.lit("One"), F.lit("Uno")))
    new.repartition("path").write.format("epub").mode("append").save(f"file://{tmp_path}/out")
    again = read(spark, "epub", tmp_path / "out")
    assert {r.text for r in again.filter("part = 'contents'").collect()} == {"Uno", "Uno A", "Two"}
    with zipfile.ZipFile(tmp_path / "out" / "a.epub") as z:
        assert z.testzip() is None


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    rows = spark.createDataFrame([("a.srt", 0, "1", "t", "x"), ("b.srt", 0, "1", "t", "y")], "path string, seq int, number string, time string, text string")
    broken = rows.withColumn("text", F.when(F.col("path") == "b.srt", F.raise_error(F.lit("gone"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="gone"):
        broken.repartition(2, "path").write.format("srt").mode("append").save(f"file://{tmp_path}/out")
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()]
    spread = rows.filter("path = 'a.srt'").unionByName(rows.filter("path = 'a.srt'").withColumn("seq", F.lit(1)))
    with pytest.raises(Exception, match="written twice"):
        spread.write.format("srt").mode("append").save(f"file://{tmp_path}/twice")  # two tasks have rows of one file
    assert not [p for p in (tmp_path / "twice").rglob("*") if p.is_file()]
