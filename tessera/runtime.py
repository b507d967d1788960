"""What every job needs from its session: the shared scratch folder, and the package on the executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't share the driver's folders (once a session)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name in the cluster's shared scratch space, spark.checkpoint.dir. Where that is unset on one machine
    (local[...], as in tests), a temporary folder stands in; on a cluster it is an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = getattr(sc, "_tessera_scratch", None)
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="tessera-scratch-")
            sc._tessera_scratch = base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a table from which its rows are dealt out if it has fewer parts than there are cores.
SPREAD_BYTES = 4 << 20


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. A file of one row group is one task's work however many cores wait, so a table of some size that has
    fewer parts than there are cores is dealt out to them; large tables have more parts and aren't touched."""
    df = spark.read.parquet(path)
    plan, cores = df._jdf.queryExecution(), spark.sparkContext.defaultParallelism
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) < SPREAD_BYTES or df._jdf.rdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Names that df has no column of, with underscores before them as needed."""
    taken = {c.lower() for c in df.columns}
    return [next(x for k in range(len(taken) + 1) if (x := "_" * k + name).lower() not in taken) for name in names]


def ranged(rows: DataFrame, order: Sequence[Column], part: str, place: str) -> DataFrame:
    """rows dealt out by ranges of an order and written sorted: part numbers the ranges in order, place the rows of each."""
    (at,) = fresh_names(rows, "at")
    written = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "ranged")
    # as that function puts them together
    return written.select(*[F.col(f"`{c}`") for c in rows.columns], F.shiftrightunsigned(F.col(at), 33).alias(part), F.col(at).bitwiseAND((1 << 33) - 1).alias(place))


#: Rows up to which a group's places are counted where it is sorted as one; larger ones are counted by ranges.
MOST_GROUP_ROWS = 1_000_000


def row_index(rows: DataFrame, order: Sequence[Column], name: str = "row", by: Sequence[str] = (), most: int = MOST_GROUP_ROWS) -> DataFrame:
    """rows with `name`: the place of each in `order`, from 0, of all rows or of those that are equal in the columns `by`,
    without a task that holds them all.

    Rows are dealt out by ranges of the order and written sorted; a row's place is the number of rows in the ranges before
    and its place in its own. Groups of up to `most` rows move once instead, and are sorted and counted where they are. Rows
    that are equal by `order` stand together, in no certain order: end it with a column that tells them apart. No rows give
    no rows.
    """
    if by:
        n, mark = fresh_names(rows.withColumn(name, F.lit(0)), "n", "mark")
        large = materialise(rows.groupBy(*by).agg(F.count(F.lit(1)).alias(n)).filter(F.col(n) > most).select(*by), "large-groups")
        counted = lambda df: df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long") - 1)
        if large.isEmpty():
            return counted(rows)
        same = [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in by]
        marked = rows.alias("l").join(F.broadcast(large.withColumn(mark, F.lit(1)).alias("r")), same, "left").select(*[F.col(f"l.`{c}`") for c in rows.columns], F.col(mark))
        return counted(marked.filter(F.col(mark).isNull()).drop(mark)).unionByName(_index_by_ranges(marked.filter(F.col(mark).isNotNull()).drop(mark), order, name, by))
    return _index_by_ranges(rows, order, name, by)


def _index_by_ranges(rows: DataFrame, order: Sequence[Column], name: str, by: Sequence[str]) -> DataFrame:
    of, at, n, base, ahead = fresh_names(rows.withColumn(name, F.lit(0)), "part", "place", "n", "base", "ahead")
    written = ranged(rows, [*[F.col(c).asc() for c in by], *order], of, at)
    own = [F.col(f"`{c}`") for c in rows.columns]
    sizes = written.groupBy(of, *by).agg(F.count(F.lit(1)).alias(n), F.min(at).alias(base))
    if not by:  # a row a range
        before = sizes.select(F.col(of).alias(ahead), (F.sum(n).over(Window.orderBy(of)) - F.col(n)).alias(base))
        return written.join(F.broadcast(before), F.col(of) == F.col(ahead)).select(*own, (F.col(base) + F.col(at)).alias(name))
    # a group goes on from range to range; the places of those in one range are counted there
    before = Window.partitionBy(*by).orderBy(of).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn(ahead, F.coalesce(F.sum(n).over(before), F.lit(0)) - F.col(base)).drop(n, base)
    keys = [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in by]
    placed = written.alias("l").join(sizes.alias("r"), [F.col(f"l.{of}") == F.col(f"r.{of}"), *keys])
    return placed.select(*[F.col(f"l.`{c}`") for c in rows.columns], (F.col(ahead) + F.col(f"l.{at}")).alias(name))
