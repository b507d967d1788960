import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import placeholders as PH
from tessera.functions import text as T
from tessera.functions.html import trim
from tessera.operators import align as A
from tessera.operators import cache as C
from tessera.operators import exchange as X
from tessera.operators import grid as G
from tessera.operators import segments as S
from tessera.operators import translate as TR
from tessera.sources import readers as R
from tessera.sources import writers as W


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if not isinstance(v, int) else 'int'}" for k, v in values.items()))
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [(" a\xa0b ", "a b"), ("\u3000x", "x"), ("a\u200bb\ufeff", "ab"), ("a \t\n b", "a b"), (" a \x1a b ", "a  b"), ("", ""), ("\xad\x7f", "")],
)
def test_trim(spark, text, want):
    assert one(spark, T.trim_text(F.col("x")), x=text) == want
    assert trim(text) == want


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \t\n\r\x0b\x1c\x1f\x85\xa0\xad\u1680\u2003\u2028\u202f\u205f\u3000\u200b\ufeff\u00e9", max_size=12), min_size=20, max_size=40))
def test_trim_as_python(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", T.trim_text(F.col("x"))).collect()
    assert all(trim(r[0]) == r[1] for r in rows)


def test_natural_order(spark):
    names = ["c10.html", "c9.html", "c09.html", "c9b10", "c9b2", "", "10", "9", "a"]
    df = spark.createDataFrame([(n,) for n in names], "x string")
    key = lambda n: [(t, int(d) if d else -1) for t, d in re.findall(r"(\D*)(\d*)", n)]
    assert [r[0] for r in df.orderBy(T.natural_key(F.col("x")), "x").collect()] == sorted(names, key=lambda n: (key(n), n))


@pytest.mark.parametrize(("text", "want"), [("aaaaaa b", "aaaa b"), ("a\nb", "a<br/>b"), ("éééééé!!!!!!", "éééé!!!!!!")])
def test_polish(spark, text, want):
    assert one(spark, T.polish(F.col("x")), x=text) == want


def test_shorten_and_digest_input(spark):
    assert one(spark, T.shorten(F.col("x")), x="a" * 201) == "a" * 200 + "..."
    assert one(spark, T.digest_input(F.col("x")), x="a" * 10 + "b" * 5 + "c" * 10) == "a" * 10 + "25" + "c" * 10


GLOSSARY = [("a", "a"), ("b", "Z\\1$")]


def test_glossary(spark):
    masked = one(spark, PH.glossary_replace(F.col("x"), GLOSSARY), x="a b c")
    assert masked == "{{id_000000}} {{id_000001}} c"
    assert one(spark, PH.glossary_restore(F.col("x"), GLOSSARY), x="{ {id_000000}} {{id _ 000001}  } c") == "a Z\\1$ c"
    assert PH.unsafe_terms([("x", "y"), ("id", "z")]) == ["id"]
    assert R.glossary("\ufeffa\n\n\nb\nZ\nlost\n") == [("a", "a"), ("b", "Z")]


def test_reserved_markup_comes_back(spark):
    got = one(spark, PH.restore_reserved(F.col("x"), F.array(F.lit("<br/>"), F.lit('<img src="$1\\2"/>'))), x="a < {{id_00000}} b {id _ 0 0 0 0 1 }}")
    assert got == 'a &lt; <br/> b <img src="$1\\2"/>'


@pytest.mark.parametrize("text", ["123", " - ", "“…”", "$%&", "[1]", "１２", "—"])
def test_no_letters(spark, text):
    assert one(spark, S.ignored(F.col("x")), x=text)


@pytest.mark.parametrize(("mode", "rule", "text", "want"), [("normal", "CODE", "a code b", True), ("case", "CODE", "a code b", False), ("regex", "^c.d", "code", True), ("normal", "a.c", "abc", False)])
def test_rules(spark, mode, rule, text, want):
    assert one(spark, S.ignored(F.col("x"), rules=[rule], mode=mode), x=text) is want


def test_rules_that_do_not_compile():
    assert S.rule_errors(["(", "a"], "regex") == ["("]
    assert S.rule_errors(["("], "normal") == []


def _merge(spark, texts, most):
    df = spark.createDataFrame([(0, k, t, t, False) for k, t in enumerate(texts)], "doc_id int, oid int, text string, raw string, ignored boolean")
    return [(r.oid, r.n, r.raw, r.text) for r in S.merge(df, most).orderBy("oid").collect()]


def test_merge(spark):
    assert _merge(spark, ["a", "b", "c"], 1000) == [(0, 3, "a\n\nb\n\nc\n\n", "a\n\nb\n\nc\n\n")]
    assert _merge(spark, ["a", "b", "c"], 2) == [(k, 1, c, c + "\n\n") for k, c in enumerate("abc")]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="xy", min_size=1, max_size=9), min_size=1, max_size=25), st.integers(3, 30))
def test_merge_walk(spark, texts, most):
    want, raw, txt, n = [], "", "", 0
    for t in texts:
        c = t + "\n\n"
        if len(txt + c) < most:
            raw, txt, n = raw + t + "\n\n", txt + c, n + 1
            continue
        if txt:
            want.append((len(want), n, raw, txt))
        raw, txt, n = t, c, 1
    want.append((len(want), n, raw, txt))
    assert _merge(spark, texts, most) == want


@pytest.mark.parametrize(
    ("original", "translation", "position", "want"),
    [
        ("a\n\nb\n\nc", "A\n\nB\n\nC", "below", [("a", "A"), ("b", "B"), ("c", "C")]),
        ("a\n\nb\n\nc", "A\n\nB", "below", [("a", None), ("b", None), ("c", "A\n\nB")]),
        ("a\n\nb\n\nc", "A\n\nB", "above", [("a", "A\n\nB"), ("b", None), ("c", None)]),
        ("a\n\nb\n\nc", "A\n\nB", "left", [("a", "A"), ("b", "B"), ("c", None)]),
        ("a\n\nb\n\n", "A\n\nB\n\nC\n\nD", "below", [("a", "A"), ("b", "B\n\nC\n\nD")]),
        ("a {{id_0}} b", "A {{id_0} B", "below", [("a", "A"), ("b", "B")]),
        ("a\n\n\n\nb\n\n", "A\n\n\n\nB", "below", [("a", None), ("", None), ("b", "A\n\nB")]),
        ("a\n\nb\n\n", None, "below", [("a", None), ("b", None)]),
    ],
)
def test_align(spark, original, translation, position, want):
    df = spark.createDataFrame([(original, translation)], "o string, t string")
    assert [tuple(p) for p in df.select(A.align(F.col("o"), F.col("t"), position=position)).first()[0]] == want


@pytest.mark.parametrize(("original", "translation", "want"), [("a\n\nb", "A\nB", "A\n\nB"), ("a\n\nb", "A\n\nB", "A\n\nB"), ("a\n\nb", " ", " "), ("a\n\nb\n\nc", "A\nB\n\nC", "A\n\nB\n\nC")])
def test_repair(spark, original, translation, want):
    assert one(spark, A.repair(F.col("o"), F.col("t")), o=original, t=translation) == want


def test_insert_ignore_conflicts_on_either_key(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "oid int, md5 string")
    new = spark.createDataFrame([(1, "c", 0), (3, "b", 1), (4, "d", 2), (4, "e", 3), (5, "d", 4), (6, "f", 5)], "oid int, md5 string, k int")
    assert sorted(map(tuple, C.insert_ignore(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (4, "d"), (6, "f")]


def test_update_only_given_rows(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "oid int, translation string")
    new = spark.createDataFrame([(2, None), (9, "x")], "oid int, translation string")
    assert sorted(map(tuple, C.update(old, new, ["translation"]).collect())) == [(1, "a"), (2, None)]


def test_retries():
    waits = []

    def fail(text):
        raise OSError("no")

    assert TR.with_retries(fail, "x", 5, waits.append) == (None, 6, "no")
    assert waits == [5, 10, 15, 20, 25]

    def fatal(text):
        raise TR.Fatal("key")

    assert TR.with_retries(fatal, "x", 5)[1:] == (1, "key")


def test_service_stops_after_errors(spark):
    def call(text):
        if text == "bad":
            raise OSError("down")
        return text[::-1]

    rows = spark.createDataFrame([(str(k), t) for k, t in enumerate(["ab", "bad", "bad", "cd", "ef"])], "id string, original string").coalesce(1)
    got = {r.id: (r.translation, r.calls, r.error) for r in TR.call_service(rows, call, attempts=1, most_errors=4, step=0).collect()}
    assert got == {"0": ("ba", 1, None), "1": (None, 2, "down"), "2": (None, 2, "down"), "3": (None, 0, "stopped"), "4": (None, 0, "stopped")}


@pytest.mark.parametrize(
    ("definition", "want"),
    [
        ("{", "not JSON"), ("[]", "not an object"), ("{}", "no name"), ('{"name":"Builtin"}', "name is taken"), ('{"name":"n"}', "no languages"),
        ('{"name":"n","languages":{"source":{}}}', "source or target missing"), ('{"name":"n","languages":{"English":"en"}}', "no request"),
        ('{"name":"n","languages":{"E":"e"},"request":{"m":"GET"}}', "no url"), ('{"name":"n","languages":{"E":"e"},"request":{"url":"u","data":{"q":"x"}}}', "no <text> in data"),
        ('{"name":"n","languages":{"E":"e"},"request":{"url":"u","headers":"x"}}', "headers are no object"), ('{"name":"n","languages":{"E":"e"},"request":{"url":"u","data":"<text>"}}', "no content type"),
        ('{"name":"n","languages":{"E":"e"},"request":{"url":"u","data":"<text>","headers":{"Content-Type":"x"}}}', "no response expression"),
        ('{"name":"n","languages":{"E":"e"},"request":{"url":"u","data":{"q":"<text>"}},"response":"response[0]"}', None),
    ],
)
def test_engine_definitions(spark, definition, want):
    assert one(spark, X.engine_error(F.col("x"), F.array(F.lit("builtin"))), x=definition) == want


def test_json_ends_with_its_value(spark):
    ok = ['{"a":[1]}', "[]", " 1 ", "null", '"x]"', "[1,0]", "[null]"]
    bad = ["4305024215708615 words", '{"a":1} x', "1 2", "1,2", "1,0", "1,0] x", "1] x", "[1],0]", "1,null", "null,null] x", "{} {}", "1,", ",", "", " ", "text", "]", '"x', '1,"', None]
    df = spark.createDataFrame([(x,) for x in ok + bad], "x string").select("x", X.is_json(F.col("x")).alias("ok"), X.engine_error(F.col("x"), F.array()).alias("error"))
    rows = df.collect()
    assert [r.x for r in rows if r.ok] == ok
    assert [r.x for r in rows if r.error == "not JSON"] == bad


def test_stream_payload_may_hold_its_own_mark(spark):
    rows = [(0, 0, 'data: {"choices":[{"delta":{"content":"a data: b"}}]}'), (0, 1, "data: [DONE]"), (0, 2, 'data: {"choices":[{"delta":{"content":"late"}}]}')]
    assert X.stream_texts(spark.createDataFrame(rows, "s int, k int, line string"), "s", "k").first().text == "a data: b"


def test_ranges_and_chunks(spark):
    df = spark.createDataFrame([(x,) for x in [5, 1, 2, 3, 7, 8, 8]], "x int")
    assert sorted(map(tuple, G.ranges(df, "x").collect())) == [(1, 3), (5, 5), (7, 8)]
    assert G.ranges(df.filter("x > 99"), "x").collect() == []
    for n, k, want in [(10, 3, [3, 3, 4]), (15, 11, None), (3, 0, [1, 1, 1]), (2, 9, [1, 1])]:
        got = spark.range(n).select(G.chunk_of(F.col("id"), F.lit(n), F.lit(k)).alias("c")).groupBy("c").count().orderBy("c").collect()
        assert sum(r[1] for r in got) == n
        assert want is None or [r[1] for r in got] == want


def test_formats(spark):
    text = "1\n0 --> 1\nA\nB\n\n2\n1 --> 2\nC\n\nbroken"
    got = one(spark, R.subtitles(F.col("x")), x=text)
    assert [tuple(e) for e in got] == [("1", "0 --> 1", "A\nB"), ("2", "1 --> 2", "C"), ("broken", None, None)]
    assert one(spark, R.game_comments(F.col("x")), x="1. e4 {good} e5 {12} {_}") == ["{good}", "{_}"]
    assert one(spark, W.place_comment(F.col("c"), F.lit("good"), F.lit("gut"), "below"), c="{good}") == "{good | gut}"
    assert one(spark, W.replace_comments(F.col("x"), F.array(F.struct(F.lit("{a}").alias("raw"), F.lit("{b}").alias("new")), F.struct(F.lit("{a}").alias("raw"), F.lit("{c}").alias("new")))), x="{a} {a} {a}") == "{b} {c} {a}"


def test_whole_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("a\r\né".encode("latin-1"))
    assert R.read_files(spark, str(tmp_path), "ISO-8859-1").first().text == "a\né"
    (tmp_path / "g.txt").write_text("x\ny\n\nz")
    assert R.read_glossary(spark, str(tmp_path / "g.txt")) == [("x", "y"), ("z", "z")]
    assert R.read_glossary(spark, str(tmp_path / "none.txt")) == []
