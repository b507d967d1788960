"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut into chunks where a rolling hash of the bytes before a word start has its low bits zero, so texts that
share a passage share its chunks whatever stands around them. Chunks that occur more than once among the distinct texts
are encoded once and their ids joined to every place; what lies between is encoded in place. Where a join may not be a
border of the whole text's encoding, a window around it is encoded again and widened until it agrees with what stands
on both sides.

Spark: one shuffle of compressed distinct texts by text key, one small shuffle of chunk hashes, one of shared ids.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import keyed, packed_texts, split_join
from tessera.runtime import ship

#: Split before merges of the byte-level models (a fixed value of their format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space as PATTERN's \\s has it, and runs of it that the pattern engine's stack might not hold.
_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG_RUN = 4096
_LONG = re.compile(f"(?<!{_SPACE}){_SPACE}{{{LONG_RUN},}}")

#: Chunks: bytes that the rolling hash sees, one word start in CHUNK_MOD ends a chunk, least and most bytes.
WINDOW, CHUNK_MOD, LEAST, MOST = 32, 64, 128, 8192
_MULT = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64)


def _unicode_of_bytes() -> dict[str, int]:
    """The printable stand-in that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Encodes as the tokenizers library does with a byte-level BPE file and add_special_tokens=False.

    The merges run in tiktoken, which takes a merge's rank from its id; a file whose merges are not in id order is
    refused. The strings of added tokens in a text become their ids, as in that library.
    """

    def __init__(self, model_json: bytes) -> None:
        spec = json.loads(model_json)
        back = _unicode_of_bytes()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {bytes(back[c] for c in tok): i for tok, i in spec["model"]["vocab"].items() if tok not in self.special}
        merges = spec["model"]["merges"]
        made = [b"".join(bytes(back[c] for c in part) for part in (m.split(" ") if isinstance(m, str) else m)) for m in merges]
        order = [vocab[m] for m in made]
        if any(a >= b for a, b in zip(order, order[1:], strict=False)):
            raise ValueError("merges are not in the order of their ids")
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only plain byte-level files are known")
        self.encoding = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens=self.special)
        self.piece = tiktoken.Encoding("piece", pat_str=r"(?s).+", mergeable_ranks=vocab, special_tokens={})
        self.allowed = set(self.special)
        n = max([*vocab.values(), *self.special.values()]) + 1
        self.pieces: list[bytes] = [b""] * n
        for tok, i in vocab.items():
            self.pieces[i] = tok
        for tok, i in self.special.items():
            self.pieces[i] = tok.encode()
        self.lengths = np.array([len(x) for x in self.pieces], np.int64)
        self.decimal = [str(i) for i in range(n)]
        self.kind = np.dtype("<u2" if n <= 65536 else "<u4")

    def _encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=()) if text else np.zeros(0, np.uint32)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text of any length. Long runs of white space are taken out by hand, as the pattern would look for
        their end step by step and give up: such a run is one piece if the text or an added token follows, else its last
        character belongs to what follows."""
        if len(text) < LONG_RUN or not _LONG.search(text):
            return self._encode(text)
        parts, at = [], 0
        for m in _LONG.finditer(text):
            start, end = m.span()
            if end < len(text) and not text.startswith(tuple(self.special), end):
                end -= 1
            parts += [self._encode(text[at:start]), self.piece.encode_to_numpy(text[start:end])]
            at = end
        return np.concatenate([*parts, self._encode(text[at:])])

    def encode_bytes(self, data: bytes) -> np.ndarray:
        return self.encode(data.decode())

    def decode(self, ids: list[int]) -> str:
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids]).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(model_json: bytes) -> Codec:
    """The worker's codec for this file; kept for the tasks that follow."""
    key = hashlib.sha1(model_json).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(model_json)
    return _CODECS[key]


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, 0 to n."""
    if len(_POWERS[0]) <= n:
        m = max(n + 1, 1 << 16)
        for k, base in enumerate((_MULT, _INV)):
            steps = np.full(m, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def safe_cuts(data: bytes) -> np.ndarray:
    """Places where white space follows a character that is none: there the encoding of a text is always the encoding
    of both sides, as no piece of the pattern holds white space after anything else and none looks past such a place.
    Only characters of one or two bytes count before the place, so that wide white space can't be taken for a letter."""
    b = np.frombuffer(data, np.uint8)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    p = np.flatnonzero(space[2:]) + 2
    last, lead = b[p - 1], b[p - 2]
    return p[((last > 32) & (last < 127)) | ((last >= 128) & (lead >= 0xC3) & (lead <= 0xDF))]


def chunk_borders(data: bytes) -> list[int]:
    """Ends of the content-defined chunks, the last being len(data). The hash is polynomial modulo 2**64 over the
    WINDOW bytes before a safe cut. A chunk of MOST bytes without a border ends at a character, maybe inside a word."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    p = safe_cuts(data)
    p = p[p >= WINDOW]
    ends: list[int] = []
    if len(p):
        up, down = _powers(min(n, 1 << 20))
        if n <= 1 << 20:
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_TABLE[np.frombuffer(data, np.uint8)] * up[:n], out=total[1:])
            h = (total[p] - total[p - WINDOW]) * down[p - WINDOW]
        else:  # long texts by their windows, so that memory stays in proportion to the cuts
            b = np.frombuffer(data, np.uint8)
            h = np.zeros(len(p), np.uint64)
            for j in range(WINDOW):
                h += _TABLE[b[p - WINDOW + j]] * up[j]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        p = p[(h >> np.uint64(40)) % np.uint64(CHUNK_MOD) == 0]
    start = 0
    for end in [*p.tolist(), n]:
        while end - start > MOST:
            cut = start + MOST
            while data[cut] & 0xC0 == 0x80:
                cut -= 1
            ends.append(cut)
            start = cut
        if end - start >= LEAST or end == n:
            ends.append(end)
            start = end
    return ends


def join_pieces(data: bytes, pieces: list[tuple[int, np.ndarray]], c: Codec) -> tuple[np.ndarray, int]:
    """Ids of data from the ids of its pieces (start, ids), and the number of repaired joins."""
    if not pieces:
        return np.zeros(0, np.uint32), 0
    ids = np.concatenate([x for _, x in pieces]).astype(np.uint32) if len(pieces) > 1 else pieces[0][1]
    cuts = safe_cuts(data) if len(pieces) > 1 else np.zeros(0, np.int64)
    inner = np.array([s for s, _ in pieces[1:]], np.int64)
    bad = inner[~np.isin(inner, cuts)] if len(inner) else inner
    if not len(bad):
        return ids, 0
    starts = np.concatenate([[0], np.cumsum(c.lengths[ids])])
    borders = np.concatenate([[0], cuts, [len(data)]])
    out, done, fixed = [], 0, 0  # done: bytes whose ids are in out
    for p in bad.tolist():
        if p < done:
            continue
        k = 1
        while True:
            at = int(np.searchsorted(borders, p))
            lo, hi = borders[max(0, at - k)], borders[min(len(borders) - 1, at - 1 + k)]
            lo = max(int(lo), done)
            left, right = max(int(borders[max(0, at - k - 1)]), done), int(borders[min(len(borders) - 1, at + k)])
            i, j, i0, j0 = (int(np.searchsorted(starts, x)) for x in (lo, hi, left, right))
            fresh = c.encode_bytes(data[lo:hi])
            whole = starts[i] == lo and starts[j] == hi and starts[i0] == left and starts[j0] == right
            if whole and np.array_equal(c.encode_bytes(data[left:right]), np.concatenate([ids[i0:i], fresh, ids[j:j0]])):
                break
            if lo <= done and hi >= len(data):
                break
            k += 1
        out += [ids[int(np.searchsorted(starts, done)) : i], fresh]
        done, fixed = int(hi), fixed + 1
    out.append(ids[int(np.searchsorted(starts, done)) :])
    return np.concatenate(out), fixed


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = zstandard.ZstdDecompressor()
    for b in batches:
        rows = ([], [], [], [], [], [])
        for packed, k1, k2 in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            data, start = d.decompress(packed), 0
            for end in chunk_borders(data):
                h = xxhash.xxh3_128_intdigest(data[start:end])
                for to, x in zip(rows, ((h >> 64) - (1 << 63), (h & 0xFFFFFFFFFFFFFFFF) - (1 << 63), k1, k2, start, end - start), strict=True):
                    to.append(x)
                start = end
        kinds = (pa.int64(),) * 4 + (pa.int32(),) * 2
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], ["h1", "h2", "k1", "k2", "at", "n"])


def _encode_shared(model: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, d = codec(model.value), zstandard.ZstdDecompressor()
        for b in batches:
            h1, h2, ids = [], [], []
            for packed, chunks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = d.decompress(packed)
                for x in chunks:
                    h1.append(x["h1"])
                    h2.append(x["h2"])
                    ids.append(c.encode_bytes(data[x["at"] : x["at"] + x["n"]]).astype(c.kind).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(ids, pa.binary())], ["h1", "h2", "ids"])

    return run


def _assemble(model: object, with_ids: bool) -> Callable:
    names = ["k1", "k2", "n_tokens", "ids_sha256", "decoded_sha256", "n_reused", "n_repaired"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, d = codec(model.value), zstandard.ZstdDecompressor()
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for k1, k2, packed, shared in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                data, pieces, at = d.decompress(packed), [], 0
                for x in sorted(shared or [], key=lambda x: x["at"]):
                    if x["at"] > at:
                        pieces.append((at, c.encode_bytes(data[at : x["at"]])))
                    pieces.append((x["at"], np.frombuffer(x["ids"], c.kind)))
                    at = x["at"] + x["n"]
                if at < len(data):
                    pieces.append((at, c.encode_bytes(data[at:])))
                ids, fixed = join_pieces(data, pieces, c)
                ids = ids.tolist()
                decimal = c.decimal
                row = [k1, k2, len(ids), hashlib.sha256(",".join([decimal[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest(), len(shared or []), fixed]
                for to, x in zip(cols, row + [ids] * with_ids, strict=True):
                    to.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names)

    return run


def encode_documents(docs: DataFrame, tokenizer_file: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_reused (chunks whose ids came from elsewhere), n_repaired (joins
    encoded again) and, if asked for, ids, for every row of docs (doc_id, text).

    A null text is empty and an empty text has no ids. Rows with equal texts have equal results, whatever their doc_id,
    which may be null or repeat; a row in is a row out. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_file, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())  # one vocabulary file: its size doesn't depend on the input
    rows = keyed(docs.select("doc_id", "text"))
    texts = packed_texts(rows).select("packed", "k1", "k2")
    chunks = texts.mapInArrow(_chunk_rows, "h1 long not null, h2 long not null, k1 long not null, k2 long not null, at int not null, n int not null")
    counted = chunks.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("places"), F.min(F.struct("k1", "k2", "at", "n")).alias("first"))
    reps = counted.filter("places > 1").select("first.k1", "first.k2", F.struct("first.at", "first.n", "h1", "h2").alias("c"))
    reps = reps.groupBy("k1", "k2").agg(F.collect_list("c").alias("chunks"))
    encoded = texts.join(reps, ["k1", "k2"]).select("packed", "chunks").mapInArrow(_encode_shared(model), "h1 long not null, h2 long not null, ids binary not null")
    shared = split_join(chunks, encoded, ["h1", "h2"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "n", "ids")).alias("shared"))
    schema = "k1 long not null, k2 long not null, n_tokens long, ids_sha256 string, decoded_sha256 string, n_reused long, n_repaired long" + ", ids array<int>" * with_ids
    done = texts.join(shared, ["k1", "k2"], "left").select("k1", "k2", "packed", "shared").mapInArrow(_assemble(model, with_ids), schema)
    return split_join(rows.select("doc_id", "k1", "k2"), done, ["k1", "k2"]).drop("k1", "k2")


def decode_documents(ids: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id, text from (doc_id, ids array<int>): the inverse of encode_documents(with_ids=True). Null ids: null text."""
    spark = ids.sparkSession
    ship(spark)
    with open(tokenizer_file, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else c.decode(x) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return ids.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


__all__ = ["Codec", "chunk_borders", "codec", "decode_documents", "encode_documents", "join_pieces", "safe_cuts"]
