"""Quality classifier: ridge scores over random Fourier features of document statistics, with isotonic calibration.

A pass over the texts leaves a short vector of statistics a document. Random Fourier features approximate a Gaussian
kernel over it; each task sums its part of the normal equations by fold, tasks' parts are summed on a few executors, and
the driver solves systems of fixed size: one of all folds, and one without each. Scores of the labelled rows, each by the
solution that hasn't seen its fold, are counted in bins of fixed number, from which isotonic steps turn a score into the
share of good documents around it.
"""

from __future__ import annotations

import dataclasses
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import materialise, ship

FEATURES, RIDGE, SEED, BINS, FOLDS, SUMS, THRESHOLD = 256, 1e-4, 5, 2048, 5, 32, 0.7
_MARKS = "#*$%&|<>"
NAMES = (
    "words", "word_length", "upper", "marks", "bars", "exclamations", "digits", "stops", "distinct", "top_word",
    "repeats", "dup_lines", "words_a_line", "packed", "capitals", "wide", "marked_words", "spaces",
)


def statistics(text: str) -> list[float]:
    """The vector of a text, in the order of NAMES; zeros for a text without words."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(NAMES)
    data = text.encode()
    lines = [x for x in text.split("\n") if x.strip()]
    of = text.count
    marks = [of(c) for c in _MARKS]
    counts = Counter(words)
    letters = sum(map(len, words))
    digits = sum(map(of, "0123456789"))
    lower = text.lower()
    upper = sum(map(str.__ne__, text, lower)) if len(lower) == size and lower != text else 0
    last = Counter([w[-1] for w in words])
    return [
        np.log1p(n), letters / n, np.arcsinh(20 * upper / size), np.arcsinh(100 * sum(marks) / size), np.arcsinh(100 * marks[_MARKS.index("|")] / size),
        np.arcsinh(100 * of("!") / size), np.arcsinh(50 * digits / size), np.arcsinh(50 * (of(".") + of(",")) / size), len(counts) / n, np.arcsinh(10 * max(counts.values()) / n),
        np.arcsinh(50 * sum(map(str.__eq__, words, words[1:])) / n), np.arcsinh(10 * (len(lines) - len(set(lines))) / len(lines)), np.log1p(n / len(lines)),
        np.log(len(zstandard.compress(data, 1)) / len(data)), np.arcsinh(5 * sum(map(str.isupper, [w[0] for w in words])) / n), (len(data) - size) / size,
        np.arcsinh(20 * sum(last[c] for c in _MARKS) / n), (size - letters) / size,
    ]


def _stat_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = pa.array([statistics(t.as_py()) for t in b.column(0)], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([x, *b.columns[1:]], ["x", *b.schema.names[1:]])


@dataclasses.dataclass(frozen=True)
class Model:
    """A fitted classifier: of one size whatever it was fitted on."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return features(x, self.mean, self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1. Within a step, where isotonic values tie, the ridge score still orders a little."""
        raw = self.raw(x)
        return np.clip(0.99 * np.interp(raw, *self.steps) + 0.01 * np.clip(raw, 0, 1), 0, 1)


def features(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, n: int = FEATURES, seed: int = SEED) -> np.ndarray:
    """Random Fourier features of standardised statistics for a Gaussian kernel whose width is sqrt(dimensions), and 1."""
    rng = np.random.default_rng(seed)
    d = len(mean)
    w, phase = rng.normal(0, 1 / np.sqrt(d), (d, n)), rng.uniform(0, 2 * np.pi, n)
    z = np.clip((x - mean) / scale, -6, 6)
    return np.column_stack([np.sqrt(2 / n) * np.cos(z @ w + phase), np.ones(len(x))])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _normal_parts(mean: np.ndarray, scale: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                p = b.slice(k, 4096)
                z, y = features(_matrix(p.column(0)), mean, scale), p.column(1).to_numpy(zero_copy_only=False).astype(float)
                folds = p.column(2).to_numpy()
                for f in np.unique(folds).tolist():
                    part = z[folds == f].T @ np.column_stack([z[folds == f], y[folds == f]])
                    total[f] = total[f] + part if f in total else part
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["fold", "part"])

    return run


def _sum_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for f, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            part = np.frombuffer(x.as_buffer())
            total[f] = total[f] + part if f in total else part.copy()
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["fold", "part"])


def _raw_rows(models: dict[int, Model]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, folds = _matrix(b.column(0)), b.column(2).to_numpy()
                raw = np.empty(len(x))
                for f in np.unique(folds).tolist():
                    raw[folds == f] = models[f].raw(x[folds == f])
                yield pa.RecordBatch.from_arrays([pa.array(raw), b.column(1)], ["raw", "y"])

    return run


def solve(parts: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge weights from summed normal equations; the constant feature is last and bears no penalty."""
    gram, right, n = parts[:, :-1], parts[:, -1], parts[-1, -2]
    penalty = np.full(len(right), ridge * n)
    penalty[-1] = 0
    return np.linalg.solve(gram + np.diag(penalty) + 1e-9 * np.eye(len(right)), right)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the non-decreasing function nearest to the means y of n values each at ascending x: the pooled blocks'
    centres and means."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, n, strict=True):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame, ridge: float = RIDGE) -> Model:
    """Fit on the rows of stats (x, doc_id) that labels (doc_id, quality) marks and that aren't held out; all of them,
    there is no sample. Calibration is out of fold: a row's score for it comes from the rows of the other folds. A doc_id that labels marks more than once counts as good if any row says so; null labels don't
    count. Without labelled rows every score is about a half."""
    d = len(NAMES)
    marks = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    train = stats.filter(~held_out(F.col("doc_id"))).join(marks, "doc_id").select("x", "y", fold)
    means = train.agg(F.count(F.lit(1)), *[f(F.col("x")[k]) for k in range(d) for f in (F.avg, F.stddev_pop)]).first()
    if not means[0]:
        return Model(np.zeros(d), np.ones(d), np.zeros(FEATURES + 1), (np.array([0.0]), np.array([0.5])))
    mean, scale = np.array(means[1::2]), np.maximum(np.array(means[2::2]), 1e-3)
    parts = train.mapInArrow(_normal_parts(mean, scale), "fold int, part binary")
    some = parts.repartition(SUMS).mapInArrow(_sum_parts, "fold int, part binary")  # so that no task gets all parts of a fold
    summed = some.repartition(FOLDS, "fold").mapInArrow(_sum_parts, "fold int, part binary")
    parts = {r.fold: np.frombuffer(r.part).reshape(FEATURES + 1, FEATURES + 2) for r in summed.collect()}  # FOLDS of fixed size
    every = np.sum([parts[f] for f in sorted(parts)], axis=0)
    unit = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    model = Model(mean, scale, solve(every, ridge), unit)
    others = {f: Model(mean, scale, solve(every - x, ridge), unit) if len(parts) > 1 else model for f, x in parts.items()}
    low, width = -0.5, 2.0 / BINS
    binned = train.mapInArrow(_raw_rows(others), "raw double, y double")
    binned = binned.groupBy(F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("raw") - low) / width))).alias("bin"))
    rows = sorted(tuple(r) for r in binned.agg(F.avg("raw"), F.avg("y"), F.count(F.lit(1))).collect())  # BINS at most
    return dataclasses.replace(model, steps=isotonic(*(np.array(c, float) for c in list(zip(*rows, strict=True))[1:])))


def document_statistics(docs: DataFrame) -> DataFrame:
    """x (NAMES) and doc_id of each row of docs (doc_id, text), written to the shared folder. Null texts are empty."""
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    return materialise(rows.mapInArrow(_stat_rows, "x array<double>, doc_id long"), "quality-statistics")


def _score_rows(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array(model.score(_matrix(b.column(0))))], ["doc_id", "score"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold) of each row of docs (doc_id, text); a null doc_id
    is not held out. Empty texts have a score like any other. An empty table gives an empty result."""
    stats = document_statistics(docs)
    rows = stats.mapInArrow(_score_rows(fit(stats, labels)), "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def statistics_column(text: Column) -> Column:
    """The statistics of a text as a column: rows stay where they are, only texts go to Python."""

    @F.pandas_udf("array<double>")
    def stats(texts):  # noqa: ANN001, ANN202
        return texts.map(statistics)

    return stats(F.coalesce(text, F.lit("")))


def score_column(model: Model, stats: Column) -> Column:
    """The score of a statistics_column()."""

    @F.pandas_udf("double")
    def score(rows):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(model.score(np.stack(rows.to_list())) if len(rows) else [], dtype=float)

    return score(stats)
