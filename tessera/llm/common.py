"""Shared pieces of the corpus operators: text keys, packed distinct texts, folders that Python tasks can open."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two seeds make one 128-bit key.
_SECOND_SEED = 7


def text_keys(text: Column) -> list[Column]:
    """k1, k2: a 128-bit key of a text (two XXH64 with different seeds)."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(_SECOND_SEED), text).alias("k2")]


def keyed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `_text` (null: empty) and its key k1, k2."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select("*", text.alias("_text"), *text_keys(text))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c = zstandard.ZstdCompressor(level=3)
    for b in batches:
        packed = [c.compress(x.as_buffer()) if x.is_valid else None for x in b.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), *b.columns[1:]], ["packed", *b.schema.names[1:]])


def packed_texts(docs: DataFrame) -> DataFrame:
    """The distinct texts of keyed() documents: k1, k2, packed (zstd), owner (smallest doc_id that has the text).

    Texts are compressed before they move, and each task joins the copies that it has before the shuffle, so a
    text that a third of all rows share moves once a task.
    """
    packed = docs.select(F.col("_text").cast("binary").alias("t"), "k1", "k2", F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(
        _pack, "packed binary not null, k1 long not null, k2 long not null, doc_id long"
    )
    return packed.groupBy("k1", "k2").agg(F.first("packed").alias("packed"), F.min("doc_id").alias("owner"))


def unpack(value: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(value, max_output_size=0) if value else b""


def split_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined to a right side that has one row a key, where a key may hold a large part of left.

    A side that was grouped by the keys already stands by them, and then AQE can't split a large key. A further key made
    of the others has both sides dealt out anew, which costs one more shuffle of the side of one row a key, and AQE
    splits the other where it is skewed.
    """
    again = F.pmod(F.xxhash64(F.lit(3), *keys), F.lit(8)).cast("int")  # few values, so that it adds little to a shuffle
    return left.withColumn("_again", again).join(right.withColumn("_again", again), [*keys, "_again"], how).drop("_again")
