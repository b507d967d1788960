"""Dimensions of languages: names, codes by service, and writing direction. Small tables, joined by broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Directions of languages; others are 'auto' (fixed values).
DIRECTIONS = {"iw": "rtl", "ar": "rtl", "en": "ltr", "es": "ltr", "it": "ltr", "de": "ltr"}
AUTO = "Auto detect"


def directions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DIRECTIONS.items()), "code string, direction string")


def with_direction(rows: DataFrame, code: str = "lang") -> DataFrame:
    """rows with direction of their language code."""
    dim = directions(rows.sparkSession).withColumnRenamed("code", "_code")
    return rows.join(F.broadcast(dim), F.col(code) == F.col("_code"), "left").drop("_code").withColumn("direction", F.coalesce("direction", F.lit("auto")))


def with_code(rows: DataFrame, languages: DataFrame, name: str = "language", engine: str | None = None, most: int = 10_000) -> DataFrame:
    """rows with code of a language name from languages (name, code[, engine]); 'Auto detect' has 'auto', an unknown one
    null. The table is broadcast up to `most` rows, else Spark chooses."""
    dim = languages.filter(F.col("engine") == engine) if engine else languages
    dim = dim.select(F.col("name").alias("_name"), F.col("code").alias("_lang_code"))
    dim = F.broadcast(dim) if dim.limit(most + 1).count() <= most else dim
    return rows.join(dim, F.col(name) == F.col("_name"), "left").withColumn("code", F.when(F.col(name) == AUTO, "auto").otherwise(F.col("_lang_code"))).drop("_name", "_lang_code")
