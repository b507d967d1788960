"""The corpus pipeline: documents to token digests in five stages, each of which works on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, quality, simhash, site_lines
from tessera.runtime import materialise, read_table, ship

#: Near copies in the pipeline: sets of shingles of five words with a Jaccard similarity of 0.8, looked for by 256-bit
#: fingerprints. At 0.8 they differ in 39 bits on average with a deviation of 6 (48 in texts of four shingles against
#: five), unrelated ones in 128 with a deviation of 8; links within RADIUS, SCREEN of them in the first 64, are checked.
SIMILARITY, SHINGLE, WORDS, RADIUS, SCREEN = 0.8, 5, 4, 64, 24


def _fresh(name: str, docs: DataFrame) -> str:
    """A column name that docs doesn't have."""
    while name.lower() in map(str.lower, docs.columns):
        name = f"_{name}"
    return name


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at 0.7 or more. It is fitted on the labelled rows of docs that
    aren't held out; a document is judged by its text alone."""
    ship(spark)
    stats = _fresh("statistics", docs)
    known = materialise(docs.withColumn(stats, quality.statistics_column(F.col("text"))), "pipeline-statistics")
    model = quality.fit(known.select(F.col(stats).alias("x"), F.col("doc_id").cast("long").alias("doc_id")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return known.filter(quality.score_column(model, F.col(stats)) >= quality.THRESHOLD).drop(stats)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source, where equal texts count once: copies, which the next stage
    joins, make no line boilerplate. n_chars follows the text."""
    n_lines, n_dropped = _fresh("lines", docs), _fresh("dropped", docs)
    kept = site_lines.drop_site_lines(docs, host="source", per_text=True, names=(n_lines, n_dropped))
    n_chars = F.when(F.col(n_dropped) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", n_chars).drop(n_lines, n_dropped).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id (null after all others). Links are
    checked on the texts. Rows that repeat a doc_id are judged by their texts; documents without words are alike."""
    return simhash.first_of_groups(docs, SIMILARITY, SHINGLE, WORDS, RADIUS, SCREEN)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark, word for word or with other values."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of the documents that are left."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_copies", near_copy_stage),
    ("benchmark", benchmark_stage),
    ("encoding", encoding_stage),
]

#: A fitted classifier and a tokenizer aren't SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
