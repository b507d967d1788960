"""Cache, contents, units and sinks against plain Python."""

import html
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import settings as ST
from tessera.operators import cache as C
from tessera.operators import exchange as X
from tessera.operators import grid as G
from tessera.operators import jobs as J
from tessera.operators import segments as S
from tessera.operators import translate as TR
from tessera.sources import readers as R
from tessera.sources import writers as W


def accepted(existing, incoming):
    ids, hashes, out = {i for i, _ in existing}, {h for _, h in existing}, []
    for i, h, k in sorted(incoming, key=lambda r: r[2]):
        if (i is None or i not in ids) and (h is None or h not in hashes):
            ids, hashes = ids | {i} - {None}, hashes | {h} - {None}
            out.append((i, h, k))
    return out


def test_insert_ignore(spark):
    rng = random.Random(3)
    for n in (3, 12, 60):
        old = [(k, f"h{k}", -1) for k in range(0, n, 5)]
        new = [(rng.choice([None, *range(n)]), rng.choice([None, *(f"h{x}" for x in range(n))]), k) for k in range(2 * n)]
        schema = "oid int, md5 string, _a int"  # a column that is named like one of the operator's own
        got = C.insert_ignore(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema).repartition(3), ["_a"])
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, old + accepted([r[:2] for r in old], new)))
    chain = [(1, "a", 0), (1, "b", 1), (2, "b", 2)]  # the second is left out and so doesn't block the third
    got = C.insert_ignore(spark.createDataFrame([], schema), spark.createDataFrame(chain, schema), ["_a"])
    assert sorted(r._a for r in got.collect()) == [0, 2]


def test_upsert_needs_an_order(spark):
    rows = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "x", 1), ("b", "y", 1)], "key string, value string, n int")
    old = spark.createDataFrame([("a", "0"), ("c", "0")], C.INFO)
    assert {tuple(r) for r in C.upsert(old, rows, "key", ["n"]).collect()} == {("a", "2"), ("b", "y"), ("c", "0")}
    with pytest.raises(ValueError):
        C.upsert(old, rows, "key", [])


def test_a_cache_on_disk(spark, tmp_path):
    path = str(tmp_path / "caches" / "a")
    cache, info = C.empty(spark)
    assert cache.count() == info.count() == 0 and C.file_bytes(spark, path) == 0
    rows = spark.createDataFrame([(k, f"{random.Random(k).random()}" * 20, *[None] * 8) for k in range(3000)], C.CACHE)
    assert C.save(rows.limit(1), path) and C.save(rows, path)  # the first was too small to be complete
    assert not C.save(rows.limit(1), path) and spark.read.parquet(path).count() == 3000
    assert C.move(spark, path, str(tmp_path / "caches" / "b")) and not C.move(spark, path, str(tmp_path / "caches" / "c"))
    assert C.clean(spark, str(tmp_path / "caches"), ["a", "b"]) == ["b"] and not C.remove(spark, path)


def test_contents_of_any_depth(spark):
    rows = [("x", f"n{k}", f"n{k - 1}" if k else None, k % 7, f"title {k}") for k in range(70)]
    rows += [("x", "side", "n3", 100, " side "), ("y", "r", None, 0, "root"), ("y", "lost", "nowhere", 0, "lost"), ("y", "below", "lost", 0, "below")]
    got = R.contents(spark.createDataFrame(rows, "book string, node string, parent string, seq int, title string"), "book")
    want = {("x", f"title {k}", tuple(j % 7 for j in range(k + 1))) for k in range(70)} | {("x", "side", (0, 1, 2, 3, 100)), ("y", "root", (0,))}
    assert {(r.book, r.title, tuple(r.place)) for r in got.collect()} == want
    circle = spark.createDataFrame([("x", "a", "b", 0, "a"), ("x", "b", "a", 0, "b"), ("x", "c", None, 0, "c")], "book string, node string, parent string, seq int, title string")
    with pytest.raises(ValueError, match="circle"):
        R.contents(circle, "book")
    assert R.contents(circle.filter("false"), "book").collect() == []


def merged(texts, most, sep):
    units, size = [], 0
    for raw, text in texts:
        content = text + sep
        fits = bool(units) and size + len(content) < most or not units and len(content) < most
        if not units or not size + len(content) < most:
            units.append(["", "", 0])
            size = 0
        units[-1] = [units[-1][0] + raw + (sep if fits else ""), units[-1][1] + content, units[-1][2] + 1]
        size += len(content)
    return [tuple(u) for u in units]


def test_merge_against_python(spark):
    rng = random.Random(4)
    docs = [(k, "\n".join(rng.choice(["", "12", "a" * rng.randint(1, 30), " b  c "]) for _ in range(rng.randint(0, 40)))) for k in range(60)] + [(60, None), (61, "x" * 5000 + "\ny")]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    for most in (1, 12, 40, 1800):
        want = {}
        for k, t in docs:
            kept = [(x, " ".join(x.split())) for x in (t or "").split("\n") if x.strip() and x != "12"]
            want[k] = merged(kept, most, "\n\n")
        for got in (S.merge_documents(df, most), S.merge(S.segment(df), most)):
            found = {k: [] for k, _ in docs}
            for r in sorted(got.collect(), key=lambda r: (r.doc_id, r.oid)):
                found[r.doc_id].append((r.raw, r.text, r.n))
            assert found == want


def test_segments_are_not_shuffled(spark):
    df = spark.createDataFrame([(1, "a\nb")], "doc_id int, text string")
    for out in (S.segment(df), S.merge_documents(df)):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_long_document_is_merged_in_time(spark):
    df = spark.range(1).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: F.concat(F.lit("line "), i.cast("string"))), "\n").alias("text"))
    assert S.merge_documents(df).agg(F.sum("n")).first()[0] == 100_000


@pytest.mark.parametrize("text", ["a &amp; b", "&amp;lt;", "&#39;x&#x27; &#128512;&#x1F600;", "no & entity; &unknown; &#xZZ; &", "&lt;b&gt;", "", "&quot;&apos;", "&#55296; &#1114112;", "&eacute;&rsquo;&hellip;&Auml;&NotEqualTilde;", "&copy 2020 &notit; &#150;", None])
def test_unescape(spark, text):
    want = text if text is None else html.unescape(text)
    rows = spark.createDataFrame([(text,)], "t string")
    assert rows.select(X.unescape(F.col("t"))).first()[0] == want
    assert rows.select(X.unescape_all(F.array("t", F.lit("&lt;"), "t"))).first()[0] == [want, "<", want]


def test_rules_of_any_alphabet(spark):
    rows = spark.createDataFrame([("une école",), ("UNE ÉCOLE",), ("ΣΊΣΥΦΟΣ",), ("straße",)], "t string")
    hit = lambda rule, mode: [r[0] for r in rows.select(S.ignored(F.col("t"), rules=[rule], mode=mode)).collect()]
    assert hit("École", "normal") == [True, True, False, False] and hit("école", "case") == [True, False, False, False]
    assert hit("σίσυφος", "normal") == [False, False, True, False] and hit("STRASSE", "normal") == [False] * 4


def test_documents_stay_apart(spark, tmp_path):
    rows = [(1, "a\nb\n"), (2, ""), (3, None), (4, "x\n\ny"), (5, "é")]
    W.write_documents(spark.createDataFrame(rows, "doc_id int, text string"), str(tmp_path / "out"))
    assert sorted(map(tuple, W.read_documents(spark, str(tmp_path / "out")).collect())) == [(i, t or "") for i, t in rows]


def test_charsets(spark, tmp_path):
    for charset, text in (("utf-8", "é漢"), ("iso-8859-15", "é€"), ("mac_roman", "é"), ("big5", "漢字"), ("cp720", "abc é")):
        (tmp_path / f"{charset}.txt").write_bytes((text + "\r\nb").encode(charset))
        assert R.read_files(spark, str(tmp_path / f"{charset}.txt"), charset).first().text == text + "\nb"
    with pytest.raises(LookupError):
        R.read_files(spark, str(tmp_path), "no such charset")


def test_settings():
    s = {"a": {"b": {"c": 1}}, "x": 0}
    assert ST.get(s, "a.b.c") == 1 and ST.get(s, "a.b.d") is None and ST.get(s, "x", 5) == 0 and ST.get(s, "x.y", 5) == 5 and ST.get({}, "a.b", defaults=s) == {"c": 1}
    assert ST.with_value(s, "a.b.d", 2) == {"a": {"b": {"c": 1, "d": 2}}, "x": 0} and ST.with_value(s, "x.y", 1)["x"] == {"y": 1}
    assert ST.without(s, "a.b.c") == {"a": {"b": {}}, "x": 0} and ST.without(s, "q.r") == s and ST.without(s, "x") == {"a": {"b": {"c": 1}}}
    assert s == {"a": {"b": {"c": 1}}, "x": 0}


def test_what_to_translate(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "oid int, translation string")
    ids = lambda df: sorted((r.oid, r.fresh) for r in df.collect())
    assert ids(TR.to_translate(rows)) == [(2, False), (3, False)]
    assert ids(TR.to_translate(rows.filter("oid = 1"))) == [(1, True)]
    assert ids(TR.to_translate_selected(rows, F.col("oid") < 3)) == [(1, True), (2, True)]
    assert ids(TR.to_translate_selected(rows, F.col("oid") < 9)) == [(2, False), (3, False)]


def test_an_engine_is_asked_as_it_may_be(spark):
    def call(text, timeout):
        if text == "bad":
            raise TR.Fatal(f"no answer in {timeout}")
        return text.upper()

    rows = spark.createDataFrame([("1", "a"), ("2", "bad"), ("3", "c")], "id string, original string").coalesce(1)
    engine = J.Engine("e", TR.reversing, concurrency=1, interval=0.05, timeout=3.0)
    got = {r.id: (r.translation, r.error) for r in J.call_engine(rows, engine, call).collect()}
    assert got == {"1": ("A", None), "2": (None, "no answer in 3.0"), "3": (None, "stopped")}


def test_order_of_names(spark):
    rows = spark.createDataFrame([(x,) for x in ("Zulu", "Ärmel", "Arm", "Éwé", "Esperanto", "Catalan", "Basque")], "name string")
    assert [r.name for r in G.sort_languages(rows, "Zulu", ["Catalan", "Basque"]).collect()] == ["Zulu", "Catalan", "Basque", "Arm", "Ärmel", "Esperanto", "Éwé"]
    engines = spark.createDataFrame([("paid", False, False, 0), ("free", True, False, 1), ("c10", False, True, 2), ("c9", False, True, 3)], "name string, free boolean, custom boolean, position int")
    assert [r.name for r in G.sort_engines(engines).collect()] == ["free", "paid", "c9", "c10"]


def test_row_index_is_the_order_of_all_rows(spark):
    rows = spark.range(0, 5000, 1, 7).select("id", F.when(F.col("id") % 9 > 0, F.col("id") % 13).alias("v"), F.lit(0).alias("_part"))
    for down in (False, True):
        got = {r.id: r.place for r in G.row_index(rows, G.catalog_order("v", down, "id"), "place").collect()}
        order = sorted(got, key=lambda i: (i % 9 > 0, i % 13 if i % 9 else 0, i), reverse=down)
        assert [got[i] for i in order] == list(range(5000))
    assert [r.id for r in G.sort_catalog(rows, "v", True, "id").limit(2).collect()] == [4991, 4978]
    assert G.row_index(rows.limit(0), [F.col("id")]).count() == 0


def test_languages_by_code(spark):
    rows = spark.createDataFrame([("Deutsch", "DE"), ("Ärabic", "ar"), ("English", "EN-us"), ("English (UK)", "en_GB"), ("Zulu", "zu"), ("None", None)], "name string, code string")
    names = lambda df: [r.name for r in df.collect()]
    assert names(G.source_languages(rows, "en")) == ["English (UK)", "English", "Ärabic", "Deutsch", "None", "Zulu"]
    assert names(G.target_languages(rows, "en_us")) == ["English", "English (UK)", "Ärabic", "Deutsch", "None", "Zulu"]
    assert names(G.source_languages(rows, None)) == ["Ärabic", "Deutsch", "English", "English (UK)", "None", "Zulu"]


def test_rules_that_do_not_compile(spark):
    assert S.rule_errors(["a+", "[", "(?<n>x)", "*"], "regex") == ["[", "*"]
    assert S.rule_errors(["[", "*"], "normal") == [] and S.rule_errors(["p > a", "p:hover"], "selector") == ["p:hover"]


def by_rule(old, new):
    """One row after the other against what is there."""
    ids, hashes, out = {i for i, *_ in old if i is not None}, {h for _, h, *_ in old if h is not None}, list(old)
    for i, h, _ in sorted(new, key=lambda r: r[2]):
        if (i is None or i not in ids) and (h is None or h not in hashes):
            out.append((i, h))
            ids.add(i)
            hashes.add(h)
    return sorted(map(str, out))


@pytest.mark.parametrize("walk", [1_000_000, 0])
def test_insert_ignore_is_the_rule(spark, monkeypatch, walk):
    monkeypatch.setattr(C, "WALK_ROWS", walk)
    rng = random.Random(4)
    new = [(rng.choice([None, *range(60)]), rng.choice([None, *"abcdefghijklmnopqrstuvwxyz"]), k) for k in range(300)]
    new += [(1000 + (k + 1) // 2, f"h{k // 2}", 1000 + k) for k in range(400)]  # a chain
    new += [(5000 + k, "hot", 2000 + k) for k in range(300)] + [(7, "q", 3000)] * 40
    old = [(1, "a"), (None, None), (2, None)]
    got = C.insert_ignore(spark.createDataFrame(old, "oid int, md5 string"), spark.createDataFrame(rng.sample(new, len(new)), "oid int, md5 string, k int").repartition(5), ["k"])
    assert sorted(str(tuple(r)) for r in got.collect()) == by_rule(old, new)
    none = spark.createDataFrame([], "oid int, md5 string, k int")
    assert C.insert_ignore(spark.createDataFrame(old, "oid int, md5 string"), none, ["k"]).count() == 3


def test_a_long_chain_of_conflicts_takes_few_jobs(spark):
    rows = spark.range(100_000).select(((F.col("id") + 1) / 2).cast("long").alias("oid"), (F.col("id") / 2).cast("long").cast("string").alias("md5"), "id")
    sc = spark.sparkContext
    sc.setJobGroup("chain", "chain")
    got = C.insert_ignore(spark.createDataFrame([], "oid long, md5 string"), rows, ["id"])
    jobs = len(sc.statusTracker().getJobIdsForGroup("chain"))
    assert got.count() == len(by_rule([], [((k + 1) // 2, str(k // 2), k) for k in range(100_000)]))
    assert jobs < 80


def test_components(spark):
    edges = [(f"a{k}", f"b{k}") for k in range(200)] + [(f"a{k + 1}", f"b{k}") for k in range(199) if k != 90] + [("x", f"y{k}") for k in range(50)] + [("a", "a")]
    got = C.components(spark.createDataFrame(edges, "a string, b string")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.c, set()).add((r.a, r.b))
    assert sorted(map(len, groups.values())) == [1, 50, 181, 217] and len(got) == len(edges)
