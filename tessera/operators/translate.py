"""The translation stage: what needs a translation, and a pluggable translator. Calls to services are operators.service."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.placeholders import Glossary, glossary_replace, glossary_restore
from tessera.functions.text import strip
from tessera.operators.align import repair
from tessera.operators.cache import untranslated
from tessera.operators.service import Fatal, call_service, run_job, with_retries

__all__ = [
    "Fatal", "Translator", "backoff", "call_service", "error_runs", "progress", "reversing", "run_job", "running_misaligned", "to_translate", "to_translate_selected", "totals",
    "translate", "with_retries",
]

#: A translator is an expression from a text to its translation.
Translator = Callable[[Column], Column]


def reversing(text: Column) -> Column:
    """A stand-in for a service: small and capital letters change places with no network."""
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, low + up, up + low)


def translate(segments: DataFrame, translator: Translator, engine: str, target: str, glossary: Glossary = (), fresh: bool = False, separator: str | None = None) -> DataFrame:
    """segments (text as `original`) with translation, engine_name, target_lang and is_cache.

    Rows with a translation are taken from the cache unless fresh; only the others meet the translator, after the
    glossary's terms became placeholders, and before they become their targets. With a separator, translations of
    merged units are repaired where they aren't aligned.
    """
    kept = F.lit(False) if fresh else ~untranslated(F.col("translation"))
    new = strip(glossary_restore(translator(glossary_replace(F.col("original"), glossary)), glossary))
    if separator:
        new = repair(F.col("original"), new, separator)
    out = segments.withColumn("is_cache", kept)
    out = out.withColumn("translation", F.when(F.col("is_cache"), F.col("translation")).otherwise(new))
    for name, value in (("engine_name", engine), ("target_lang", target)):
        old = F.col(name) if name in segments.columns else F.lit(None).cast("string")
        out = out.withColumn(name, F.when(F.col("is_cache"), old).otherwise(F.lit(value)))
    return out


def to_translate(segments: DataFrame) -> DataFrame:
    """The rows without a translation; where there is none, all rows, to be translated anew (`fresh`). Which of both is
    asked once, by a look for the first such row."""
    left = segments.filter(untranslated(F.col("translation")))
    return segments.withColumn("fresh", F.lit(True)) if left.isEmpty() else left.withColumn("fresh", F.lit(False))


def to_translate_selected(segments: DataFrame, selected: Column) -> DataFrame:
    """The selected rows, to be translated anew; a selection of all rows is treated as no selection."""
    if segments.filter(~F.coalesce(selected, F.lit(False))).isEmpty():
        return to_translate(segments)
    return segments.filter(selected).withColumn("fresh", F.lit(True))


def backoff(attempts: Column) -> Column:
    """The waits before each further call: 5, 10, 15 ... seconds."""
    return F.transform(F.when(attempts > 0, F.sequence(F.lit(1), attempts)).otherwise(F.array().cast("array<int>")), lambda i: 5 * i)


def error_runs(log: DataFrame, is_error: Column, by: Sequence[str], order: Sequence[str], least: int = 10) -> DataFrame:
    """Runs of at least `least` errors without a success between: by, run, n_errors, first and last of order[0]. In the
    order of the log, this is where a breaker with that limit opens."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = log.withColumn("_e", F.coalesce(is_error, F.lit(False))).withColumn("run", F.sum(F.when(F.col("_e"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.filter("_e").groupBy(*by, "run").agg(F.count(F.lit(1)).alias("n_errors"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))
    return runs.filter(F.col("n_errors") >= least)


def totals(rows: DataFrame, original: str = "original") -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum(F.length(original)), F.lit(0)).alias("characters"))


def running_misaligned(rows: DataFrame, aligned: Column, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """misaligned: how many rows of the job up to and with each aren't aligned."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("misaligned", F.count_if(~aligned).over(before))


def progress(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """done: the share of its job's rows that are done with each row."""
    w = Window.partitionBy(*by)
    return rows.withColumn("done", F.row_number().over(w.orderBy(*order)) / F.count(F.lit(1)).over(w))
