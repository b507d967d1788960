"""Token-id files with Elias-Fano document boundaries.

A shard is two files. `.ids` holds the ids of its documents one after another (little-endian, 2 bytes where the
vocabulary allows, else 4). `.idx` holds, per shard, two Elias-Fano sequences: the end of each document in `.ids` and
the document ids. A sequence of n values below u takes about 2 + log2(u / n) bits a value: the low bits are packed, the
high bits stand in a bit vector with a 1 for each value. The place of every SAMPLE-th 1 is kept (4 bytes each), so one
offset is found by one look-up and a short scan, without a table of 64-bit offsets.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import codec
from tessera.llm.folders import new_name, open_folder
from tessera.runtime import materialise, shared_folder, ship

SAMPLE, HEAD = 64, 64
_HEAD = struct.Struct("<QqQB")
_INDEX = struct.Struct("<8sBQQQ")
_MAGIC = b"TOKIDS\0\1"
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1)


class EliasFano:
    """A non-decreasing sequence of integers; values are kept above their first."""

    def __init__(self, n: int, least: int, span: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray) -> None:
        self.n, self.least, self.span, self.low_bits, self.low, self.high, self.samples = n, least, span, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        if not n:
            return cls(0, 0, 0, 0, b"", b"", np.zeros(0, np.uint32))
        least = int(values[0])
        v = (values - least).astype(np.uint64)
        span = int(v[-1])
        bits = max(0, (span // n).bit_length() - 1) if span >= n else 0
        low = b"".join(
            np.packbits(((v[k : k + 65536, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8), bitorder="little").tobytes()
            for k in range(0, n, 65536)
        ) if bits else b""
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        marks = np.zeros(int(ones[-1]) + 1, np.uint8)
        marks[ones] = 1
        return cls(n, least, span, bits, low, np.packbits(marks, bitorder="little").tobytes(), ones[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.n, self.least, self.span, self.low_bits) + struct.pack("<QQ", len(self.low), len(self.high)) + self.low + self.high + self.samples.tobytes()

    @classmethod
    def read(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        n, least, span, bits = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        n_low, n_high = struct.unpack_from("<QQ", data, at)
        at += 16
        low, high = data[at : at + n_low], data[at + n_low : at + n_low + n_high]
        at += n_low + n_high
        k = -(-n // SAMPLE)
        return cls(n, least, span, bits, low, high, np.frombuffer(data, "<u4", k, at)), at + 4 * k

    def select(self, i: int) -> int:
        """Place of the i-th 1 among the high bits."""
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, first = divmod(place, 8)
        bits = self.high[byte] >> first << first  # from the sampled 1 on
        while left >= int(_ONES[bits]):
            left -= int(_ONES[bits])
            byte += 1
            bits = self.high[byte]
        for k in range(8):
            if bits >> k & 1:
                if not left:
                    return 8 * byte + k
                left -= 1
        raise ValueError("damaged index")

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = (self.select(i) - i) << self.low_bits
        if self.low_bits:
            first, last = i * self.low_bits, (i + 1) * self.low_bits
            word = int.from_bytes(self.low[first // 8 : -(-last // 8)], "little")
            value |= word >> first % 8 & (1 << self.low_bits) - 1
        return value + self.least

    def block(self, i: int, j: int) -> np.ndarray:
        """Values i to j - 1: select finds the first, and the bits behind it hold the others, so that memory is in
        proportion to the block."""
        j = min(j, self.n)
        if i >= j:
            return np.zeros(0, np.int64)
        first, last = self.select(i), self.select(j - 1)
        bits = np.unpackbits(np.frombuffer(self.high, np.uint8, last // 8 - first // 8 + 1, first // 8), bitorder="little")
        ones = np.flatnonzero(bits[first % 8 : last - first // 8 * 8 + 1]) + first
        v = (ones - np.arange(i, j)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            at, end = i * self.low_bits, j * self.low_bits
            low = np.unpackbits(np.frombuffer(self.low, np.uint8, -(-end // 8) - at // 8, at // 8), bitorder="little")[at % 8 :][: end - at]
            v += low.reshape(-1, self.low_bits).astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))
        return v.astype(np.int64) + self.least


def index_bytes(ends: np.ndarray, doc_ids: np.ndarray, n_null: int, width: int) -> bytes:
    return _INDEX.pack(_MAGIC, width, len(ends), int(ends[-1]) if len(ends) else 0, n_null) + EliasFano.of(ends).to_bytes() + EliasFano.of(doc_ids).to_bytes()


def read_index(data: bytes) -> tuple[EliasFano, EliasFano, int, int]:
    """Ends, document ids (without the n_null documents before them), n_null and the bytes of an id."""
    magic, width, _, _, n_null = _INDEX.unpack_from(data, 0)
    if magic != _MAGIC:
        raise ValueError("not an index of token-id files")
    ends, at = EliasFano.read(data, _INDEX.size)
    ids, _ = EliasFano.read(data, at)
    return ends, ids, n_null, width


def _write(model: object, folder: str, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        lengths, doc_ids, n_null, c = [], [], 0, codec(model.value)
        end = np.array([end_id], c.kind).tobytes()
        for b in batches:
            if out is None:
                files, path = open_folder(folder)
                files.create_dir(path, recursive=True)
                name = new_name(path, f"shard-{TaskContext.get().partitionId():06d}", "ids")
                out = files.open_output_stream(name)
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = c.encode(text.as_py() or "")
                out.write(ids.astype(c.kind).tobytes() + end)
                lengths.append(len(ids) + 1)
                if doc_id is None:
                    n_null += 1
                else:
                    doc_ids.append(doc_id)
        if out is None:
            return
        out.close()
        ends = np.cumsum(np.array(lengths, np.int64))
        with files.open_output_stream(name[:-4] + ".idx") as f:
            f.write(index_bytes(ends, np.array(doc_ids, np.int64), n_null, c.kind.itemsize))
        row = {"shard": TaskContext.get().partitionId(), "name": name.rsplit("/", 1)[1][:-4], "folder": folder, "n_docs": len(ends), "n_ids": int(ends[-1])}
        yield pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int64()), ("name", pa.string()), ("folder", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return run


def write_token_files(docs: DataFrame, tokenizer_file: str, end_id: int = 0, shards: int | None = None) -> DataFrame:
    """Write the ids of docs (doc_id, text), an end id after each, in ascending doc_id order (nulls first, rows with
    one doc_id by their text). Returns the manifest: shard, name, folder, n_docs, n_ids.

    A null text is empty and writes the end id alone. Empty tables write no shard. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_file, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())  # one vocabulary file: its size doesn't depend on the input
    folder = shared_folder(spark, "token-ids")
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the head of a text parts rows that share a doc_id, or have none, among shards; it keeps the sampled keys small
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.left("text", F.lit(HEAD)))
    ordered = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return materialise(ordered.mapInArrow(_write(model, folder, end_id), "shard long, name string, folder string, n_docs long, n_ids long"), "token-manifest")


#: Ids, and boundaries, that a reader holds at once.
BLOCK, DOCS = 1 << 21, 1 << 14


def _crcs(f: object, width: int, lengths: list[int]) -> Iterator[int]:
    """CRC-32 of the ids, as 32-bit ones, of documents that follow each other in f: many short ones at once, a long one in parts."""
    k = 0
    while k < len(lengths):
        if lengths[k] > BLOCK:
            crc, left = 0, lengths[k]
            while left:
                part = np.frombuffer(f.read(width * min(left, BLOCK)), f"<u{width}")
                crc, left = zlib.crc32(part.astype("<u4"), crc), left - len(part)
            yield crc
            k += 1
            continue
        first, total = k, 0
        while k < len(lengths) and total + lengths[k] <= BLOCK:
            total, k = total + lengths[k], k + 1
        view = memoryview(np.frombuffer(f.read(width * total), f"<u{width}").astype("<u4")).cast("B")
        at = 0
        for n in lengths[first:k]:
            yield zlib.crc32(view[at : at + 4 * n])
            at += 4 * n


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    for b in batches:
        for row in b.to_pylist():
            files, path = open_folder(row["folder"])
            with files.open_input_file(f"{path}/{row['name']}.idx") as f:
                ends, ids, n_null, width = read_index(f.read())
            with files.open_input_stream(f"{path}/{row['name']}.ids", buffer_size=1 << 20) as f:
                start = 0
                for k in range(0, ends.n, DOCS):
                    block = ends.block(k, k + DOCS)
                    starts = np.concatenate([[start], block[:-1]])
                    start = int(block[-1])
                    nulls = max(0, min(n_null - k, len(block)))
                    doc_ids = pa.array([None] * nulls + ids.block(max(0, k - n_null), k + len(block) - n_null).tolist(), pa.int64())
                    crcs = pa.array(_crcs(f, width, (block - starts).tolist()), pa.int64())
                    yield pa.RecordBatch.from_arrays([doc_ids, pa.array(starts + row["base"]), pa.array(block - starts), crcs], names)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens (with the end id) and ids_crc32 (over unsigned 32-bit
    little-endian ids) of each document, from the files of a manifest. Shards are read side by side."""
    ship(manifest.sparkSession)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard, not a document
    shards = manifest.select("folder", "name", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards.repartition(n).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(manifest_row: dict, i: int) -> np.ndarray:
    """Ids of the i-th document of a shard, by two offsets from its index."""
    files, path = open_folder(manifest_row["folder"])
    with files.open_input_file(f"{path}/{manifest_row['name']}.idx") as f:
        ends, _, _, width = read_index(f.read())
    start, end = ends[i - 1] if i else 0, ends[i]
    with files.open_input_file(f"{path}/{manifest_row['name']}.ids") as f:
        return np.frombuffer(f.read_at(width * (end - start), width * start), f"<u{width}")
