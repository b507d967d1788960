"""Review queries over the table of paragraphs. Places of rows in an order are runtime.row_index()."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import natural_key
from tessera.operators.cache import untranslated
from tessera.runtime import row_index


def status(translation: Column, error: Column, aligned: Column, merged: bool = True) -> Column:
    """red: an error; gray: no translation; yellow: not aligned, of merged units; else green."""
    out = F.when(error.isNotNull(), "red").when(untranslated(translation), "gray")
    return (out.when(~aligned, "yellow") if merged else out).otherwise("green")


def by_category(rows: DataFrame, category: str, merged: bool = True) -> DataFrame:
    """all, non_aligned (of merged units), translated or untranslated."""
    if category == "non_aligned":
        return rows.filter(~F.col("aligned")) if merged else rows
    if category == "translated":
        return rows.filter(~untranslated(F.col("translation")))
    if category == "untranslated":
        return rows.filter(untranslated(F.col("translation")))
    if category != "all":
        raise ValueError(category)
    return rows


def search(rows: DataFrame, text: str, column: str) -> DataFrame:
    """Rows whose column holds text in any case; null is empty, and an empty text finds all."""
    return rows if text == "" else rows.filter(F.contains(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(text.lower())))


def with_attribute(rows: DataFrame, name: str, value: str, attributes: str = "attributes") -> DataFrame:
    return rows.filter(F.from_json(attributes, "map<string,string>")[name] == value)


def ranges(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Runs of consecutive numbers: by, first, last. Repeated numbers count once; no numbers, no runs."""
    distinct = rows.select(*by, value).filter(F.col(value).isNotNull()).distinct()
    island = F.col(value) - F.row_number().over(Window.partitionBy(*by).orderBy(value))
    return distinct.withColumn("_i", island).groupBy(*by, "_i").agg(F.min(value).alias("first"), F.max(value).alias("last")).drop("_i")


def chunk_of(index: Column, n: Column, k: Column) -> Column:
    """The slice (from 0) of the index-th of n items among k nearly equal slices with bounds floor(n / k * i): k is n at
    most, and singles where k is under 1. Exact in integers, so no item is lost to rounding."""
    k = F.when(k < 1, n).otherwise(F.least(k, n))
    return F.floor(((index + 1) * k - 1) / n).cast("int")


def catalog_order(column: str, descending: bool, position: str) -> list[Column]:
    """By column, ties as they stand; descending reverses all of it, ties too. Nulls come first, or last."""
    return [F.col(column).desc_nulls_last(), F.col(position).desc()] if descending else [F.col(column).asc_nulls_first(), F.col(position).asc()]


def sort_catalog(rows: DataFrame, column: str, descending: bool, position: str) -> DataFrame:
    """rows in catalog_order()."""
    return rows.orderBy(*catalog_order(column, descending, position))


def sort_engines(engines: DataFrame) -> DataFrame:
    """Free ones first, each as they stand; custom ones after, in natural order."""
    return engines.orderBy("custom", F.when(~F.col("custom"), ~F.col("free")), F.when(~F.col("custom"), F.col("position")), F.when(F.col("custom"), natural_key(F.col("name"))))


def sort_languages(languages: DataFrame, wanted: str | None = None, recommended: Sequence[str] = ()) -> DataFrame:
    """The wanted one first, then the recommended ones as they are named, then by name without
    regard to marks on letters."""
    place = F.array_position(F.array(*map(F.lit, recommended)).cast("array<string>"), F.col("name"))
    return languages.orderBy(F.coalesce(F.col("name") != F.lit(wanted), F.lit(True)), place == 0, place, F.collate("name", "UNICODE_AI"), "name")


def source_languages(languages: DataFrame, wanted: str | None) -> DataFrame:
    """Languages (name, code) to translate from: those whose code begins with that of a book's language, in any case, come
    first and in falling order, then the others by name without regard to marks on letters."""
    match = F.coalesce(F.startswith(F.lower("code"), F.lit((wanted or "").lower())), F.lit(False)) & F.lit(bool(wanted))
    folded = F.collate("name", "UNICODE_AI")
    return languages.orderBy(match.desc(), F.when(match, folded).desc(), F.when(match, F.col("name")).desc(), folded, "name")


def target_languages(languages: DataFrame, own: str) -> DataFrame:
    """Languages (name, code) to translate into: those of the reader's own language first, both parts by name."""
    match = F.coalesce(F.startswith(F.lower(F.replace("code", F.lit("-"), F.lit("_"))), F.lit(own.lower().replace("-", "_").split("_")[0])), F.lit(False))
    return languages.orderBy(match.desc(), F.collate("name", "UNICODE_AI"), "name")


def counts(rows: DataFrame, selected: Column) -> DataFrame:
    """Items and characters, of all and of the selected."""
    size = F.length("original")
    return rows.agg(
        F.count(F.lit(1)).alias("items"), F.coalesce(F.sum(size), F.lit(0)).alias("characters"),
        F.count_if(selected).alias("selected_items"), F.coalesce(F.sum(F.when(selected, size)), F.lit(0)).alias("selected_characters"),
    )


def can_output(rows: DataFrame) -> DataFrame:
    """ready: something is translated; warn: something isn't aligned."""
    return rows.agg(F.coalesce(F.bool_or(~untranslated(F.col("translation"))), F.lit(False)).alias("ready"), F.coalesce(F.bool_or(~F.col("aligned")), F.lit(False)).alias("warn"))
