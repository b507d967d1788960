"""Best-fit packing of token sequences, planned on the histogram of lengths.

Best-fit takes the longest piece first and puts it where the least room is left. Pieces of one length are alike to it, so
the plan is made from counts: at most `most` lengths, whatever the number of documents. Sequences that are filled in the
same way stand in ranges, and a line of the plan fills a range of sequences with a range of pieces. Pieces are then ranked
within their length, and each takes the slot of its rank.

Spark: texts are read once and become narrow rows (a length and a checksum a piece); no text and no token moves. Ranks are
a piece's place in its task plus the pieces of that length in the tasks before.
"""

from __future__ import annotations

import bisect
import json
import re
import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.bpe import _unicode_of_bytes
from tessera.runtime import materialise, ship

#: Words whose ids a task keeps, bytes of the longest that it does, and bytes of text that it splits at once.
KEPT, LONG, BLOCK = 300_000, 64, 1 << 20

#: How such vocabularies write a word's end (a fixed value of their format).
END = "</w>"
_BYTES = _unicode_of_bytes()


#: Letters whose small form is one letter and which composition leaves alone: those of Latin-1 and its first extension. A text
#: of them, of printable ASCII, of typographic points and of ASCII's white space is plain.
_PLAIN = re.compile("[\\t-\\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f\u2010-\u2027]+")

#: The split of the word-end models (a fixed value of their format), and what it finds in small plain texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PIECES = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^\\t-\\r a-z0-9\u00df-\u00f6\u00f8-\u017f]+")
_SPACES = re.compile("[\\t-\\r ]+")
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


class _Pieces(dict):
    """Ids of the pieces of small plain texts."""

    def __init__(self, encoding: tiktoken.Encoding) -> None:
        self.encoding = encoding

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= KEPT:
            self.clear()
        found = self.encoding.encode_ordinary(piece + " ")
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= LONG:
            self[piece] = ids
        return ids


class WordCodec(dict):
    """Ids of a text as the tokenizers library gives them for a BPE file with word ends and add_special_tokens=False, as
    little-endian unsigned 32-bit ids. Pieces of the split are encoded once and kept.

    Merges run in tiktoken, which takes a merge's rank from its id; a piece's end is written as a space there. Texts that
    aren't plain, or hold the string of an added token, go word by word, those words that aren't by the library: no
    token of such a file holds white space or looks past it. Other files are refused.
    """

    def __init__(self, model_json: bytes) -> None:
        spec = json.loads(model_json)
        model, pre = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}, {}])
        if (
            (spec["normalizer"] or {}).get("normalizers") != _NORMAL
            or [x.get("type") for x in pre] != ["Split", "ByteLevel"] or pre[0]["pattern"] != {"Regex": PATTERN} or not pre[0]["invert"] or pre[0]["behavior"] != "Removed"
            or pre[1]["add_prefix_space"] or pre[1]["use_regex"] or model["end_of_word_suffix"] != END or model.get("dropout")
            or any(x["lstrip"] or x["rstrip"] or x["single_word"] or set(x["content"]) & set(" \t\n\r") for x in spec["added_tokens"])
        ):
            raise ValueError("only files of word-end models are known")
        added = {x["content"] for x in spec["added_tokens"]}
        known = lambda tok: (tok[: -len(END)] if tok.endswith(END) else tok, b" " * tok.endswith(END))
        vocab = {}
        for tok, i in model["vocab"].items():
            if tok not in added:
                letters, end = known(tok)
                vocab[bytes(_BYTES[c] for c in letters) + end] = i
        made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        order = [model["vocab"][m] for m in made]
        if order != sorted(order) or min(order) <= max(i for t, i in vocab.items() if len(t.rstrip(b" ")) <= 1):
            raise ValueError("merges are not in the order of their ids")
        self.pieces = _Pieces(tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=vocab, special_tokens={}))
        self.added = re.compile("|".join(map(re.escape, sorted(added)))) if added else None
        self.library = Tokenizer.from_buffer(model_json)
        self.library.no_truncation()
        self.library.no_padding()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT:
            self.clear()
        ids = self._plain(word)
        if ids is None:
            found = self.library.encode(word, add_special_tokens=False).ids
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(word) <= LONG:
            self[word] = ids
        return ids

    def _plain(self, text: str) -> bytes | None:
        if not _PLAIN.fullmatch(text) or self.added and self.added.search(text):
            return None
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text.lower())))

    def encode(self, data: bytes) -> bytes:
        """Ids of a text of any length, given in UTF-8."""
        parts, at, n = [], 0, len(data)
        while at < n:
            end = min(n, at + BLOCK)
            while end < n and data[end] not in b" \t\n\r\x0b\x0c":
                end += 1
            text = data[at:end].decode("utf-8", "replace")
            ids = self._plain(text)
            parts.append(b"".join(map(self.__getitem__, _SPACES.split(text))) if ids is None else ids)
            at = end
        return parts[0] if len(parts) == 1 else b"".join(parts)


_CODECS: dict[int, WordCodec] = {}


def _codec(model_json: bytes) -> WordCodec:
    key = zlib.crc32(model_json)
    if key not in _CODECS:
        _CODECS[key] = WordCodec(model_json)
    return _CODECS[key]


def _pieces(model: object, end_id: int, most: int, with_ids: bool) -> Callable:
    end = np.array([end_id], "<u4").tobytes()
    kinds = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int64()), ("nth", pa.int64())])
    if with_ids:
        kinds = kinds.append(pa.field("ids", pa.list_(pa.int32())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, task, seen = _codec(model.value), TaskContext.get().partitionId(), Counter()
        for b in batches:
            cols: tuple[list, ...] = tuple([] for _ in kinds)
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = memoryview(c.encode(text.as_py() or b"") + end)
                for k in range(0, len(data), 4 * most):
                    part = data[k : k + 4 * most]
                    n = len(part) // 4
                    row = [doc_id, k // (4 * most), k // 4, n, zlib.crc32(part), task, seen[n]]
                    seen[n] += 1
                    for to, x in zip(cols, row + [np.frombuffer(part, "<u4")] * with_ids, strict=True):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(cols, kinds, strict=True)], schema=kinds)

    return run


def best_fit(counts: Mapping[int, int], most: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths: lines (length, rank, n, sequence, each, offset). The n pieces of a length
    from `rank` on go to consecutive sequences from `sequence` on, `each` to a sequence (the last may get fewer), one
    after another from `offset`.

    A length splits two ranges of sequences at most, and a range that is used keeps less than half of its room. So there
    are at most 3 * most * log2(most) lines, whatever the counts.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left: ranges of sequences (first, number)
    rooms: list[int] = []
    plan, opened = [], 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                room[left] = []
                bisect.insort(rooms, left)
            room[left].append((first, n))

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = most // length
                n = -(-left // each)
                put(most, opened, n)
                opened += n
                continue
            r = rooms[at]
            first, n = room[r].pop()
            if not room[r]:
                del room[r], rooms[at]
            each = r // length
            full = min(n, left // each)
            if full:
                plan.append((length, rank, full * each, first, each, most - r))
                rank, left = rank + full * each, left - full * each
                put(r - each * length, first, full)
            if full < n and 0 < left < each:
                plan.append((length, rank, left, first + full, left, most - r))
                put(r - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(r, first + full, n - full)
    return plan


def pack_documents(docs: DataFrame, tokenizer_file: str, end_id: int = 1, most: int = 4096, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids of every piece of docs (doc_id,
    text), packed into sequences of at most `most` tokens.

    A document is the ids of its text and end_id. Only longer ones are cut, into pieces of `most`, of which the last may be
    shorter. A null text is empty: its end id alone. Each row is a document of its own, also if ids repeat or are null.
    Other columns are ignored; an empty table gives no pieces.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_file, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())  # one vocabulary file: its size doesn't depend on the input
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long" + ", ids array<int>" * with_ids
    pieces = materialise(rows.mapInArrow(_pieces(model, end_id, most, with_ids), schema), "pieces")

    by_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task")  # a row a task, not a piece
    by_task = by_task.withColumn("base", F.sum("n").over(before) - F.col("n"))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `most` rows at most
    plan = best_fit(counts, most)
    # ranks go to the plan by blocks of their length, about four for each line of it: a block meets few lines, and blocks are
    # as bounded as lines, however many pieces there are
    lines = Counter(x[0] for x in plan)
    width = {x: -(-counts[x] // (4 * lines[x])) for x in counts}
    names = "p_length long, p_rank long, p_n long, p_sequence long, p_each long, p_at long, p_width long"
    slots = spark.createDataFrame([(*x, width[x[0]]) for x in plan], names)
    blocks = slots.withColumn("p_block", F.explode(F.sequence(F.expr("p_rank div p_width"), F.expr("(p_rank + p_n - 1) div p_width"))))
    widths = spark.createDataFrame(sorted(width.items()), "length long, width long")
    ranked = pieces.join(by_task.join(F.broadcast(widths), "length").drop("n"), ["task", "length"]).withColumn("r", F.col("base") + F.col("nth"))
    ranked = ranked.withColumn("block", F.expr("r div width"))
    placed = ranked.join(F.broadcast(blocks), F.expr("length = p_length AND block = p_block AND r >= p_rank AND r < p_rank + p_n"))
    placed = placed.withColumn("sequence_id", F.expr("p_sequence + (r - p_rank) div p_each")).withColumn("offset", F.expr("p_at + (r - p_rank) % p_each * length"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids and n_pieces of the sequences that pack_documents(with_ids=True) planned; each is of bounded size."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"), F.count(F.lit(1)).alias("n_pieces"))
