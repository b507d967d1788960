"""Sinks: documents put together again, and their metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def place_text(original: Column, translation: Column, position: str, joint: str = "\n") -> Column:
    """A translation in the place of, behind (below, right) or before the original; null leaves the original."""
    both = translation if position == "only" else F.concat(original, F.lit(joint), translation) if position in ("below", "right") else F.concat(translation, F.lit(joint), original)
    return F.when(translation.isNull(), original).otherwise(both)


def place_comment(comment: Column, text: Column, translation: Column, position: str) -> Column:
    """A game comment with its translation beside it, in braces."""
    return F.when(translation.isNull(), comment).otherwise(F.concat(F.lit("{"), place_text(text, translation, position, " | "), F.lit("}")))


def place_entry(text: Column, translation: Column, ignored: Column, position: str) -> Column:
    """Metadata and contents: joined by a space; ignored ones and translations equal to the text stay as they are."""
    return F.when(ignored | translation.isNull() | (translation == text), text).otherwise(place_text(text, translation, position, " "))


def subtitle_text(entries: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """key, text: entries (number, time, text) in order, an empty line between."""
    one = F.concat_ws("\n", "number", "time", "text")
    return entries.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, one.alias("t")))).alias("e")).select(key, F.array_join(F.transform("e", lambda x: x["t"]), "\n\n").alias("text"))


def replace_comments(text: Column, comments: Column) -> Column:
    """A game text with each comment (array of struct<raw, new>, in order) replaced once, behind the one before."""
    zero = F.struct(F.lit("").alias("done"), text.alias("rest"))

    def step(acc: Column, x: Column) -> Column:
        k = F.position(x["raw"], acc["rest"])
        head, tail = F.left(acc["rest"], k - 1), F.substr(acc["rest"], k + F.length(x["raw"]))
        return F.when(k == 0, acc).otherwise(F.struct(F.concat(acc["done"], head, x["new"]).alias("done"), tail.alias("rest")))

    return F.aggregate(comments, zero, step, lambda acc: F.concat(acc["done"], acc["rest"]))


def output_metadata(title: Column, language: Column, tags: Column, mark: str, new_tags: list[str]) -> list[Column]:
    """A translated document's title, language and tags."""
    return [F.concat(title, F.lit(" ["), F.lit(mark), F.lit("]")).alias("title"), language.alias("language"), F.array_distinct(F.concat(tags, F.array(*map(F.lit, new_tags)))).alias("tags")]


def file_name(title: Column, most: int = 200) -> Column:
    """A title as a file name: signs that file systems reserve become _, and long ones are cut."""
    return F.substring(F.regexp_replace(title, r'[\\/:*?"<>|\x{00}-\x{1f}]', "_"), 1, most)


def write_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Documents (key, text) at a path of any of Spark's file systems, each in a folder key=... of its own, so that a
    document with line ends stays one. A null text is an empty one. Rows that repeat a key are one document after another.
    Documents are dealt by key, so that none is in two files."""
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("value"))
    rows.repartition(key).sortWithinPartitions(key).write.partitionBy(key).text(path)


def read_documents(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """key, text of write_documents()."""
    rows = spark.read.option("basePath", path).text(path, wholetext=True)
    return rows.select(key, F.regexp_replace("value", r"\n\z", "").alias("text"))
