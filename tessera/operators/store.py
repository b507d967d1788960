"""Many caches in one place: a folder for each, changed one by one, read as of one moment.

    root/data/<generation>/_cache=<md5 of cache_id>/...   the rows of a cache, with its cache_id
    root/manifests/<generation>/...                       cache_id and folder of every cache
    root/current                                          the generation that counts

A change writes the caches that it touches to new folders, then a manifest of all, and then swaps the pointer by a rename.
Nothing that a manifest names is ever changed, so a reader sees the caches of the moment at which it looked at the pointer,
whatever is written meanwhile. Changes are made one at a time; of two at once the later one fails.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import cache as C

_MANIFEST = "cache_id string, folder string"


class CacheStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # ---- the pointer

    def _file(self, name: str) -> tuple[object, object]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def generation(self) -> str | None:
        """The generation that counts now; none before anything was written."""
        files, path = self._file("current")
        if not files.exists(path):
            return None
        return self.spark.read.text(f"{self.root}/current", wholetext=True).first()[0].strip()

    def _swap(self, before: str | None, new: str) -> None:
        if self.generation() != before:
            raise RuntimeError("the store was changed meanwhile")
        files, draft = self._file(f".current-{new}")
        out = files.create(draft, True)
        out.write(bytearray(new.encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(draft, self._file("current")[1], how)

    def manifest(self, generation: str | None = None) -> DataFrame:
        """cache_id and folder of every cache."""
        generation = generation or self.generation()
        if generation is None:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifests/{generation}")

    def _publish(self, before: str | None, manifest: DataFrame, new: str) -> None:
        manifest.coalesce(1).write.parquet(f"{self.root}/manifests/{new}")  # a short row a cache
        self._swap(before, new)

    # ---- caches

    def read(self, cache_ids: Sequence[str] | None = None) -> DataFrame:
        """The rows of these caches, or of all, as of now: cache_id and the columns of a cache."""
        found = self.manifest()
        found = found if cache_ids is None else found.filter(F.col("cache_id").isin(list(cache_ids)))
        folders = [f"{self.root}/{r.folder}" for r in found.select("folder").collect()]  # a path for each cache that is read
        return self.spark.read.schema(f"cache_id string, {C.CACHE}").parquet(*folders) if folders else self.spark.createDataFrame([], f"cache_id string, {C.CACHE}")

    def write(self, rows: DataFrame) -> str:
        """Replace the caches that rows (cache_id and the columns of a cache) hold; others stay. The new generation."""
        before, new = self.generation(), uuid.uuid4().hex
        kinds = self.spark.createDataFrame([], f"cache_id string, {C.CACHE}").schema
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in kinds])
        name = F.md5("cache_id")
        # dealt by cache and a part of its rows, so that a large one is written by several tasks
        dealt = rows.repartition("cache_id", F.pmod(F.xxhash64("oid"), F.lit(16)))
        dealt.withColumn("_cache", name).write.partitionBy("_cache").parquet(f"{self.root}/data/{new}")
        made = self.spark.read.schema("cache_id string").parquet(f"{self.root}/data/{new}").distinct()
        made = made.select("cache_id", F.concat(F.lit(f"data/{new}/_cache="), name).alias("folder"))
        self._publish(before, self.manifest(before).join(made, "cache_id", "left_anti").unionByName(made), new)
        return new

    def update(self, changes: DataFrame, columns: Sequence[str]) -> str | None:
        """Set columns from changes (cache_id, oid, columns; one row a paragraph). Only the caches that changes name are read
        and written again. None if they name none that there is."""
        named = changes.select("cache_id").join(self.manifest(), "cache_id", "left_semi").distinct()
        touched = [r.cache_id for r in named.collect()]  # names of caches
        if not touched:
            return None
        new = changes.select(F.struct("cache_id", F.col("oid").cast("long").alias("oid")).alias("_of"), *columns)
        rows = self.read(touched).withColumn("_of", F.struct("cache_id", "oid"))
        return self.write(C.update(rows, new, columns, "_of").drop("_of"))

    def insert(self, rows: DataFrame, cache_id: str, order: Sequence[str]) -> str:
        """Insert-ignore into one cache."""
        old = self.read([cache_id]).drop("cache_id")
        return self.write(C.insert_ignore(old, rows, order).withColumn("cache_id", F.lit(cache_id)))

    def remove(self, cache_ids: Sequence[str]) -> str | None:
        """Leave caches out from now on; their files go with vacuum()."""
        before, new = self.generation(), uuid.uuid4().hex
        if before is None:
            return None
        self._publish(before, self.manifest(before).filter(~F.col("cache_id").isin(list(cache_ids))), new)
        return new

    def files(self) -> DataFrame:
        """cache_id, bytes and modified (the last time) of every cache, from its files: one distributed listing whose
        contents aren't read."""
        generation = self.generation()
        if generation is None:
            return self.spark.createDataFrame([], "cache_id string, bytes long, modified timestamp")
        there = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.root}/data").select("path", "length", "modificationTime")
        folder = F.regexp_extract("path", r"/(data/[^/]+/_cache(?:=|%3D)[0-9a-f]{32})/[^/]+$", 1)
        sizes = there.groupBy(F.replace(folder, F.lit("%3D"), F.lit("=")).alias("folder")).agg(F.sum("length").alias("bytes"), F.max("modificationTime").alias("modified"))
        return self.manifest(generation).join(sizes, "folder", "left").select("cache_id", F.coalesce("bytes", F.lit(0)).alias("bytes"), "modified")

    def catalog(self, info: DataFrame) -> DataFrame:
        """The catalogue of all caches, from info (cache_id, key, value) and their files."""
        return C.catalog(info, self.files())

    def vacuum(self) -> int:
        """Remove generations' folders that no cache of the present one is in. Not while older readers are at work."""
        current = self.generation()
        used = {r[0] for r in self.manifest(current).select(F.split_part("folder", F.lit("/"), F.lit(2))).distinct().collect()} if current else set()
        n = 0
        for kind, keep in (("data", used), ("manifests", {current})):
            files, path = self._file(kind)
            for status in files.listStatus(path) if files.exists(path) else []:  # a folder a change
                if status.getPath().getName() not in keep:
                    n += bool(files.delete(status.getPath(), True))
        return n
