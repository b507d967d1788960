"""The translation cache as DataFrames: (oid, md5, raw, original, ignored, attributes, page, translation, engine_name,
target_lang) and an info table (key, value). Changes give a new DataFrame, to be written to a new folder."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import materialise, row_index, ship

#: A cache of more bytes than this counts as complete.
COMPLETE_BYTES = 50_000


#: The tables of a cache.
CACHE = "oid long, md5 string, raw string, original string, ignored boolean, attributes string, page string, translation string, engine_name string, target_lang string"
INFO = "key string, value string"


def empty(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The cache and info tables of a new job."""
    return spark.createDataFrame([], CACHE), spark.createDataFrame([], INFO)


def _fresh_names(df: DataFrame, *names: str) -> list[str]:
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


#: Conflicting rows that one task looks through in order; of more, each component of the conflicts is a task's work.
WALK_ROWS = 1_000_000
#: Rounds that accept what is first of all its conflicts, before the rest is walked.
ROUNDS = 3


def insert_ignore(existing: DataFrame, incoming: DataFrame, order: Sequence[str], ids: str = "oid", hashes: str = "md5") -> DataFrame:
    """existing and those rows of incoming that conflict with no row accepted before them on either unique column.

    Incoming rows are tried in `order`, with all columns to tell ties apart: a row is left out if its id or its hash exists
    or is that of an accepted row before it. A row that was left out blocks no other. Nulls conflict with nothing.

    Rows are ranked once; from then on keys and ranks alone move. Of rows equal in both keys the first counts. Up to WALK_ROWS
    keys are walked in order by one task. Of more, a few rounds accept the first row of both its keys and leave out what
    conflicts with it, which settles all but chains of conflicts, and what is left is walked, by one task again if it is few
    enough, else each component of the graph of ids and hashes by one. So jobs don't grow with the length of a chain.
    """
    n, a, b = _fresh_names(incoming, "_order", "_a", "_b")
    every = F.struct(*order, *[c for c in incoming.columns if c not in order])
    of = lambda df, c: df.filter(F.col(c).isNotNull()).select(F.concat(F.lit("="), F.col(c).cast("string")).alias("x")).distinct()
    ranked = row_index(incoming, [every.asc()], n)
    # a null conflicts with nothing: a key of its own
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.concat(F.lit("-"), F.col(n).cast("string")))
    keys = ranked.select(key(ids).alias(a), key(hashes).alias(b), F.col(n).alias("k")).select(F.col(a).alias("a"), F.col(b).alias("b"), "k")
    keys = keys.join(of(existing, ids), F.col("a") == F.col("x"), "left_anti").join(of(existing, hashes), F.col("b") == F.col("x"), "left_anti")
    left = materialise(keys.groupBy("a", "b").agg(F.min("k").alias("k")), "insert-undecided")
    rest, accepted = left.count(), []
    for _ in range(ROUNDS):
        if rest <= WALK_ROWS:
            break
        # least ranks are combined in each task before they move, so a key of many rows is no task's work
        least = lambda c: left.groupBy(c).agg(F.min("k").alias("k"))  # noqa: B023, E731
        new = materialise(left.join(least("a").select("k"), "k", "left_semi").join(least("b").select("k"), "k", "left_semi"), "insert-accepted")
        accepted.append(new)
        taken = lambda c: new.select(F.col(c).alias("x"))  # noqa: B023, E731
        left = materialise(left.join(taken("a"), F.col("a") == F.col("x"), "left_anti").join(taken("b"), F.col("b") == F.col("x"), "left_anti"), "insert-undecided")
        rest = left.count()
    ship(existing.sparkSession)
    rows = left.withColumn("c", F.lit(0).cast("long")) if rest <= WALK_ROWS else components(left)
    accepted.append(rows.groupBy("c").applyInArrow(_walk, "a string, b string, k long"))
    found = accepted[0]
    for more in accepted[1:]:
        found = found.unionByName(more)
    chosen = ranked.join(found.select(F.col("k").alias(n)), n, "left_semi")
    return existing.unionByName(chosen.select(*existing.columns))


def _walk(rows: pa.Table) -> pa.Table:
    """Rows in order of k that share neither key with an accepted one before them."""
    rows = rows.sort_by("k")
    ids, hashes, keep = set(), set(), []
    for a, b in zip(rows["a"].to_pylist(), rows["b"].to_pylist(), strict=True):
        keep.append(a not in ids and b not in hashes)
        if keep[-1]:
            ids.add(a)
            hashes.add(b)
    return rows.filter(pa.array(keep, pa.bool_())).select(["a", "b", "k"])


def components(rows: DataFrame) -> DataFrame:
    """rows (a, b, ...) with c, which is equal for rows that share an a or a b, directly or by others between.

    Keys are nodes and rows are edges between them. Each round joins every node to the least neighbour of its neighbourhood,
    first the larger ones and then the smaller, until nothing changes; rounds are as many as the logarithm of a chain.
    Nodes are 64-bit hashes: two that collide make one component of two, and a walk of both gives the same result.
    """
    name = lambda c: F.xxhash64(F.lit(c), F.col(c))
    edges = materialise(rows.select(F.greatest(name("a"), name("b")).alias("u"), F.least(name("a"), name("b")).alias("v")).filter("u <> v").distinct(), "component-edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = materialise(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "component-edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        small = materialise(small, "component-edges")
        if small.join(edges, ["u", "v"], "left_anti").isEmpty() and edges.join(small, ["u", "v"], "left_anti").isEmpty():
            return rows.withColumn("_u", name("a")).join(small.select(F.col("u").alias("_u"), "v"), "_u", "left").withColumn("c", F.coalesce("v", "_u")).drop("_u", "v")
        edges = small


def upsert(existing: DataFrame, incoming: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row a key: the last incoming one by `order` (of equal ones the largest in all columns), else the existing one."""
    if not order:
        raise ValueError("rows have no order of their own: name the columns that say which is last")
    last = F.max_by(F.struct(*existing.columns), F.struct(*order, *[c for c in incoming.columns if c not in order]))
    last = incoming.groupBy(F.col(key).alias("_key")).agg(last.alias("_row")).select("_row.*")
    return existing.join(last.select(key), key, "left_anti").select(*existing.columns).unionByName(last)


def save(rows: DataFrame, path: str) -> bool:
    """Write a whole cache at once, if there is none at path or one too small to be complete. Whether it was written."""
    if not file_bytes(rows.sparkSession, path) <= COMPLETE_BYTES:
        return False
    rows.write.mode("overwrite").parquet(path)
    return True


def _files(spark: SparkSession, path: str) -> tuple[object, object]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def file_bytes(spark: SparkSession, path: str) -> int:
    """Bytes below a path, 0 where there is nothing."""
    files, p = _files(spark, path)
    return files.getContentSummary(p).getLength() if files.exists(p) else 0


def move(spark: SparkSession, path: str, to: str) -> bool:
    """Give a cache another place; not over another one."""
    (files, p), (_, q) = _files(spark, path), _files(spark, to)
    return files.exists(p) and not files.exists(q) and files.rename(p, q)


def remove(spark: SparkSession, path: str) -> bool:
    files, p = _files(spark, path)
    return files.delete(p, True)


def clean(spark: SparkSession, root: str, temporary: Sequence[str]) -> list[str]:
    """Remove the caches of root that are named temporary; the names of those that were there."""
    return [name for name in temporary if remove(spark, f"{root.rstrip('/')}/{name}")]


def visible(cache: DataFrame) -> DataFrame:
    """Rows that aren't ignored; a row that doesn't say isn't shown."""
    return cache.filter(~F.col("ignored"))


def get(cache: DataFrame, ids: DataFrame, key: str = "oid") -> DataFrame:
    return cache.join(ids.select(key), key, "left_semi")


def first(cache: DataFrame, order: str = "oid", **equal: object) -> DataFrame:
    """The first row by `order` that has these values (all of them), or of all rows."""
    for k, v in equal.items():
        cache = cache.filter(F.col(k) == F.lit(v))
    return cache.orderBy(order).limit(1)


def update(cache: DataFrame, changes: DataFrame, columns: Sequence[str], key: str = "oid") -> DataFrame:
    """cache with `columns` set from changes where a row of changes has its key; one row a key in changes."""
    new = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    both = cache.join(new, F.col(key) == F.col("_key"), "left")
    return both.select(*[(F.when(F.col("_key").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)) if c in columns else F.col(c)).alias(c) for c in cache.columns])


def ignore(cache: DataFrame, ids: DataFrame, key: str = "oid") -> DataFrame:
    return update(cache, ids.select(key).distinct().withColumn("ignored", F.lit(True)), ["ignored"], key)


def delete(cache: DataFrame, ids: DataFrame, key: str = "oid") -> DataFrame:
    return cache.join(ids.select(key), key, "left_anti")


def untranslated(translation: Column) -> Column:
    """Null and empty alike."""
    return F.coalesce(translation, F.lit("")) == ""


def translated_only(cache: DataFrame) -> DataFrame:
    return cache.filter(~untranslated(F.col("translation")))


def is_fresh(n_bytes: Column) -> Column:
    """No cache, or one too small to be complete."""
    return F.coalesce(n_bytes, F.lit(0)) <= COMPLETE_BYTES


def catalog(info: DataFrame, files: DataFrame) -> DataFrame:
    """A row a cache: title, engine, lang, merge, bytes, time and name, from info (cache_id, key, value) and files
    (cache_id, bytes, modified). The keys are given, so the pivot needs no pass to find them."""
    wide = info.groupBy("cache_id").pivot("key", ["title", "engine_name", "target_lang", "merge_length"]).agg(F.max("value"))
    merged = F.coalesce(F.when(F.col("merge_length") == "", None).otherwise(F.col("merge_length")).cast("int"), F.lit(0))
    return files.join(wide, "cache_id", "left").select(
        F.coalesce("title", F.lit("[Unknown]")).alias("title"), F.col("engine_name").alias("engine"), F.col("target_lang").alias("lang"), merged.alias("merge"),
        "bytes", F.date_format("modified", "yyyy-MM-dd HH:mm:ss").alias("time"), F.col("cache_id").alias("name"),
    )


def total_megabytes(files: DataFrame) -> DataFrame:
    return files.agg(F.round(F.sum("bytes") / 10**6, 2).alias("megabytes"))
