"""Many caches in one place: changed one by one, read as of one moment."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import cache as C
from tessera.operators.store import CacheStore


def rows(spark, ids, n=20):
    base = spark.range(n).select(F.col("id").alias("oid"), F.md5(F.col("id").cast("string")).alias("md5"), F.lit("r").alias("raw"), F.concat(F.lit("text "), "id").alias("original"), F.lit(False).alias("ignored"), *[F.lit(None).cast("string").alias(c) for c in ("attributes", "page", "translation", "engine_name", "target_lang")])
    return base.crossJoin(spark.createDataFrame([(i,) for i in ids], "cache_id string"))


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("part-*") if "data" in str(p)}


def test_one_cache_is_changed_and_readers_see_one_moment(spark, tmp_path):
    store = CacheStore(spark, f"file://{tmp_path}/s")
    assert store.generation() is None and store.read().count() == 0 and store.files().count() == 0 and store.remove(["a"]) is None
    store.write(rows(spark, ["a", "b/ü", "c"]))
    before, seen = files(tmp_path), store.read()
    changes = spark.createDataFrame([("b/ü", 3, "new"), ("b/ü", 99, "none"), ("gone", 1, "none")], "cache_id string, oid int, translation string")
    store.update(changes, ["translation"])
    after = files(tmp_path)
    assert before.items() <= after.items() and len(after) > len(before)  # nothing that was there is touched
    assert len({os.path.dirname(p) for p in after.keys() - before.keys()}) == 1  # and one cache was written
    assert seen.filter("translation is not null").count() == 0 and seen.count() == 60
    assert [(r.cache_id, r.oid) for r in store.read().filter("translation = 'new'").collect()] == [("b/ü", 3)] and store.read().count() == 60
    assert store.read(["a", "no"]).select("cache_id").distinct().collect() == [("a",)]
    assert store.update(changes.filter("cache_id = 'gone'"), ["translation"]) is None
    store.insert(rows(spark, ["x"], 25).drop("cache_id"), "c", ["oid"])
    assert {r.cache_id: r["count"] for r in store.read().groupBy("cache_id").count().collect()} == {"a": 20, "b/ü": 20, "c": 25}
    store.remove(["a"])
    assert sorted(r.cache_id for r in store.manifest().collect()) == ["b/ü", "c"]
    assert store.vacuum() >= 4 and store.vacuum() == 0 and store.read().count() == 45


def test_two_changes_at_once(spark, tmp_path):
    store = CacheStore(spark, f"file://{tmp_path}/s")
    first = store.write(rows(spark, ["a"]))
    with pytest.raises(RuntimeError):
        store._swap("other", "new")
    assert store.generation() == first


def test_catalogue_of_the_files(spark, tmp_path):
    store = CacheStore(spark, f"file://{tmp_path}/s")
    store.write(rows(spark, ["a", "b"]))
    store.write(rows(spark, ["b"], 500))
    info = spark.createDataFrame([("a", "title", "A"), ("a", "merge_length", "1800"), ("b", "engine_name", "e")], "cache_id string, key string, value string")
    got = {r.name: r for r in store.catalog(info).collect()}
    size = {r.cache_id: sum(p.stat().st_size for p in (tmp_path / "s" / r.folder).glob("part-*")) for r in store.manifest().collect()}
    assert {k: r.bytes for k, r in got.items()} == size and size["b"] > size["a"]
    assert (got["a"].title, got["a"].merge, got["b"].title, got["b"].engine) == ("A", 1800, "[Unknown]", "e") and all(r.time for r in got.values())
    assert C.total_megabytes(store.files()).first()[0] == round(sum(size.values()) / 1e6, 2)


def test_documents_are_joined_before_they_become_rows(spark):
    from tessera.plans.common import cache_table

    tables = {
        "documents": spark.createDataFrame([(1, "a\n\nb", "de"), (2, "c", "en"), (2, "c2", "fr"), (3, None, "de"), (None, "d", "de"), (5, "e\nf", None)], "doc_id long, text string, lang string"),
        "labels": spark.createDataFrame([(1, 1), (1, 0), (2, 1), (9, 1)], "doc_id long, quality int"),
    }
    more = tables["documents"].selectExpr("doc_id", "lang as cache_id")
    got = cache_table(tables.get, more)
    want = cache_table(tables.get).join(more, "doc_id")
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) and got.count() == 10
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")  # the join is below
