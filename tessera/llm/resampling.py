"""Importance resampling towards a target distribution, by hashed runs of words.

Runs of one and two words fall into buckets. A bucket's gain is the logarithm of how much commoner it is in the target
than in the corpus, a document's weight the mean gain of its features. Counts and gains are cut into bits: plane i of a
document has the bit of each bucket whose count has bit i, plane j of the gains likewise, the last with a negative sign. The
sum of counts times gains is the sum of popcount(count plane & gain plane) * 2**(i + j), exact in integers.

Spark: the texts are read twice, first for the buckets' totals (a row a bucket and task), then for the weights; what moves
is a narrow row a document. Drawn documents are those of the highest scores, ranked without a task that holds them all.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import materialise, row_index, ship

BUCKETS = 10_000

#: Small letters for capital ones, and a space for what stands in no word.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Words whose checksums a task keeps, bytes of text that it splits at once, bytes of the longest word that tables know.
KEPT, BLOCK, LONG = 500_000, 1 << 20, 63


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """What a byte does to a CRC-32, and what n bytes of zero do to each byte of one: crc(a + b) is crc(a) moved over len(b)
    zeros, exclusive-or crc(b)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    moved = np.empty((LONG + 1, 4, 256), np.uint32)
    moved[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(LONG):
        moved[n + 1] = t[moved[n] & 255] ^ (moved[n] >> 8)
    return t, moved


_STEP, _MOVED = _tables()


class _Checksums(dict):
    """A word's CRC-32, and its length (LONG + 1 for longer ones) in the bits above."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        value = zlib.crc32(word) | min(len(word), LONG + 1) << 32
        if len(word) <= LONG:
            self[word] = value
        return value


def _blocks(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, by blocks that end between words."""
    data = data.translate(_WORDS)
    at, n = 0, len(data)
    while at < n:
        end = n if n - at <= BLOCK else data.find(b" ", at + BLOCK)
        end = n if end < 0 else end
        yield data[at:end].split()
        at = end


def features(data: bytes, known: _Checksums) -> tuple[int, list[np.ndarray]]:
    """The number of words of a text, and the buckets of its words and pairs of neighbours, block by block."""
    n, found, last = 0, [], []
    for words in _blocks(data):
        if not words:
            continue
        n += len(words)
        words = last + words
        v = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        crc, size = (v & 0xFFFFFFFF).astype(np.uint32), v >> 32
        found.append(crc[len(last) :] % BUCKETS)
        if len(words) > 1:
            c = ~crc[:-1]
            c = ~(_STEP[(c ^ np.uint32(32)) & 255] ^ (c >> 8))  # a space behind the first word
            s = np.minimum(size[1:], LONG)
            pair = _MOVED[s, 0, c & 255] ^ _MOVED[s, 1, c >> 8 & 255] ^ _MOVED[s, 2, c >> 16 & 255] ^ _MOVED[s, 3, c >> 24] ^ crc[1:]
            for k in np.flatnonzero(size[1:] > LONG).tolist():
                pair[k] = zlib.crc32(words[k + 1], int(c[k]))
            found.append(pair % BUCKETS)
        last = words[-1:]
    return n, found


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, known = np.zeros(BUCKETS, np.int64), _Checksums()
    for b in batches:
        for text in b.column(0):
            for part in features(text.as_py() or b"", known)[1]:
                total += np.bincount(part, minlength=BUCKETS)
    used = np.flatnonzero(total)
    if len(used):
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])


def bucket_totals(texts: DataFrame, column: str = "text") -> np.ndarray:
    """How many features of a column of texts fall into each bucket."""
    ship(texts.sparkSession)
    rows = texts.select(F.col(column).cast("binary")).mapInArrow(_totals, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in rows.collect():  # a row a bucket
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's floor(1000 * ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), in doubles."""
    all_s, all_t = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_s / ((s + 1.0) * all_t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def planes(values: np.ndarray, n: int) -> np.ndarray:
    """The lowest n bits of each value: n rows of one bit a bucket, as 64-bit words."""
    v = values.astype(np.uint16) if n <= 16 else values.astype(np.uint64)
    bits = np.packbits((v >> np.arange(n, dtype=v.dtype)[:, None]).astype(np.uint8) & np.uint8(1), axis=1)
    return np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)


def gain_planes(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The planes of signed gains, and what a bit of each is worth: the last is the sign's, below zero."""
    n = max(int(abs(gain).max()).bit_length(), 1) + 1
    worth = np.int64(1) << np.arange(n)
    worth[-1] = -worth[-1]
    return planes(gain & ((1 << n) - 1), n), worth


def weight(counts: np.ndarray, gain: np.ndarray, worth: np.ndarray) -> int:
    """The sum over all buckets of count times gain."""
    top = int(counts.max())
    own = planes(counts, top.bit_length())
    ones = np.bitwise_count(own[:, None, :] & gain[None]).sum(axis=2, dtype=np.int64)
    return int((np.int64(1) << np.arange(len(own))) @ ones @ worth)


def noise(doc_id: int | None, seed: int) -> int:
    """floor(1000 g) of a standard Gumbel variable drawn from seed:doc_id. A null id is written as nothing."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weights(model: object, seed: int) -> Callable:
    kinds = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "n_features", "weight", "score")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (gain, worth) = _Checksums(), gain_planes(np.frombuffer(model.value, np.int64))
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                n, parts = features(text.as_py() or b"", known)
                size, total = 0, 0
                if n:
                    counts = np.bincount(parts[0] if len(parts) == 1 else np.concatenate(parts[:2]), minlength=BUCKETS)
                    for x in parts[2:]:
                        counts += np.bincount(x, minlength=BUCKETS)
                    size, total = 2 * n - 1, weight(counts, gain, worth)
                w = total // size if size else 0
                for to, x in zip(cols, (doc_id, n, size, w, w + noise(doc_id, seed)), strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], schema=kinds)

    return run


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of docs (doc_id, text): floor(percent * N / 100) of the
    N rows with at least least_words words are drawn, those of the highest scores, ranked from 1; the others have no rank.

    target is a table with a column text. Texts that are null or hold no word have no features and weight 0. Ties go to the
    smaller doc_id, a null id last; rows that share both are ranked as they stand. Other columns are ignored. An empty
    table gives an empty result, an empty target gains that favour what is rare.
    """
    spark = docs.sparkSession
    ship(spark)
    gain = spark.sparkContext.broadcast(gains(bucket_totals(docs), bucket_totals(target)).tobytes())  # a number a bucket
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    scored = rows.mapInArrow(_weights(gain, seed), "doc_id long, n_words long, n_features long, weight long, score long")
    scored = materialise(scored.withColumn("_row", F.monotonically_increasing_id()), "weights")
    may = F.col("n_words") >= least_words
    n = percent * scored.filter(may).count() // 100
    placed = row_index(scored, [may.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row")], "_at")
    return placed.withColumn("rank", F.when(may & (F.col("_at") < n), F.col("_at") + 1)).drop("_row", "_at")
