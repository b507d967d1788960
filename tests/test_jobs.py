from tessera.functions.languages import with_code, with_direction
from tessera.operators import jobs as J
from tessera.operators.translate import reversing
from tessera.sources import formats as FM


def test_engines():
    own = J.Engine("own", reversing, custom=True)
    assert J.find_engine("own", [], {"own": own}) is own
    assert J.find_engine("own", [J.Engine("own", reversing)], {"own": own}).custom is False
    assert J.find_engine("none") is J.DEFAULT
    assert J.rotate_key(["a", "b"], 0, "quota exceeded", ["quota"]) == 1
    assert J.rotate_key(["a", "b"], 1, "quota exceeded", ["quota"]) is None


def test_multipart():
    body = J.multipart({"purpose": (None, "batch"), "file": ("x.jsonl", "{}")}, "B")
    assert body.startswith('--B\r\nContent-Disposition: form-data; name="purpose"\r\n\r\nbatch\r\n') and body.endswith("{}\r\n--B--\r\n")


def test_batch_jobs(spark):
    rows = [("a", "title", "t"), ("b", "batch_id", "1"), ("b", "batch_status", "completed"), ("c", "batch_id", "2"), ("c", "batch_status", "running"), ("d", "batch_id", "3"), ("d", "batch_status", "failed")]
    got = {r.cache_id: r.action for r in J.jobs(spark.createDataFrame(rows, "cache_id string, key string, value string")).collect()}
    assert got == {"a": "create", "b": "apply", "c": "wait", "d": "create"}


def test_files_of_several_formats(spark):
    files = [("a.srt", "1\nt\nA\n\n2\nt\nB"), ("b.pgn", "1. e4 {fine}"), ("c.html", "<p>C</p>"), ("d.txt", "D\n\nE"), ("e.txt", None)]
    got = sorted((r.path, r.kind, r.seq, r.text) for r in FM.file_segments(spark.createDataFrame(files, "path string, text string")).collect())
    assert got == [("a.srt", "srt", 0, "A"), ("a.srt", "srt", 1, "B"), ("b.pgn", "pgn", 0, "fine"), ("c.html", "page", 0, "C"), ("d.txt", "text", 0, "D"), ("d.txt", "text", 2, "E")]
    assert {"utf_8", "latin_1", "shift_jis"} <= set(FM.charsets())


def test_languages(spark):
    rows = spark.createDataFrame([("Arabic", "ar"), ("Auto detect", "fr"), ("Klingon", None)], "language string, lang string")
    codes = spark.createDataFrame([("Arabic", "AR", "x"), ("Arabic", "ara", "y")], "name string, code string, engine string")
    assert {r.language: (r.code, r.direction) for r in with_direction(with_code(rows, codes, engine="x")).collect()} == {"Arabic": ("AR", "rtl"), "Auto detect": ("auto", "auto"), "Klingon": (None, "auto")}
