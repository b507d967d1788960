"""WARC archives as a chunked record table.

A payload travels as rows of its record id and a chunk number, at most CHUNK bytes each, on the way in and on the way
out, and every row carries the digest of the payload so far. Which record is a response is decided on keys and digests
alone; payloads are cut where they are read, move once, and are joined nowhere. Writers and readers hold one chunk, never
a record. Archives are gzip files of one member a record; a new file begins at SEGMENT bytes, so readers share the work.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import split_join
from tessera.llm.folders import new_name, open_folder
from tessera.runtime import materialise, shared_folder, ship

CHUNK, SEGMENT = 1 << 16, 128 << 20
_READ = 1 << 18
#: Payloads that are broadcast by digest so that their copies stay where they are: at most so many, of so many copies.
MOST_COPIED, COPIES = 10_000, 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "folder string, name string, n_records long"
_ROWS = "record_id string, page_id long, record_type string, refers_to long, url string, chunk_no int, is_last boolean, payload_bytes long, payload_digest string, data binary"


def _record_id(page_id: Column, sha: Column, copy: Column) -> Column:
    m = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("-")), sha, copy.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(m, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


_DEALT = "sha string, chunk_no int, src int, page_id long, url string, n long, data binary"
_RECORDS = "record_id string, refers_record string, page_id long, url string, record_type string, refers_to long, sha string, n long, chunk_no int, so_far string, data binary"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])


def _batches(rows: Iterator[tuple], schema: pa.Schema, data: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches of a few megabytes; data: the column whose bytes count."""
    held, size = [], 0
    for x in rows:
        held.append(x)
        size += len(x[data] or b"") + 300
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _cut(chunk: int, bound: int) -> Callable:
    """Payloads to chunk rows, straight from the column's memory: each payload of `bound` bytes or more once a task; a
    shorter one every time, with its page, as it is a record of its own."""

    def rows(batches: Iterator[pa.RecordBatch], src: int) -> Iterator[tuple]:
        seen: set[bytes] = set()
        own = 0
        for b in batches:
            for page_id, url, html in zip(*b.columns, strict=True):
                data = memoryview(html.as_buffer()) if html.is_valid and len(html.as_buffer()) else memoryview(b"")
                digest = hashlib.sha1(data).digest()
                alone = len(data) < bound
                if digest in seen and not alone:
                    continue
                seen.add(digest)
                key = digest.hex().upper()
                for k, at in enumerate(range(0, max(len(data), 1), chunk)):
                    page = (page_id.as_py(), url.as_py()) if alone else (None, None)
                    yield (f"{key}-{src}-{own}" if alone else key, k, src, *page, len(data), bytes(data[at : at + chunk]))
                own += alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(rows(batches, TaskContext.get().partitionId()), _arrow(_DEALT), 6)

    return run


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Response rows: each chunk of a payload with its record, and the digest of the payload up to it. Of a payload that
    several tasks cut the chunks of one are taken."""

    def rows() -> Iterator[tuple]:
        key, src, head, digest, own = None, None, None, None, 0
        for b in batches:
            for sha, chunk_no, part, page_id, url, n, data in zip(*b.columns, strict=True):
                if sha.as_py() != key:
                    key, src, head, digest = sha.as_py(), None, (page_id.as_py(), url.as_py()), hashlib.sha1()
                    own = key.partition("-")[2]
                if chunk_no.as_py() < 0:
                    continue
                src = part.as_py() if src is None else src
                if part.as_py() == src:
                    block = data.as_buffer().to_pybytes() if data.is_valid else b""
                    digest.update(block)
                    yield (_id(head[0], key[:40], own or "0"), None, *head, "response", None, key[:40], n.as_py(), chunk_no.as_py(), _base32(digest.hexdigest()), block)

    return _batches(rows(), _arrow(_RECORDS), 10)


def _id(page_id: int | None, sha: str, copy: str) -> str:
    m = hashlib.md5(f"{'-' if page_id is None else page_id}|{sha}|{copy}".encode()).hexdigest()
    return f"<urn:uuid:{m[:8]}-{m[8:12]}-{m[12:16]}-{m[16:20]}-{m[20:]}>"


def _dealt(pages: DataFrame, min_revisit_bytes: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Chunks of the distinct payloads, sorted behind the keys of their responses and ready for _carry; and the revisits."""
    spark = pages.sparkSession
    ship(spark)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    shared = p.filter(F.octet_length("payload") >= min_revisit_bytes).select("page_id", "url", F.upper(F.sha1("payload")).alias("sha"), F.octet_length("payload").cast("long").alias("n"))
    rows = materialise(shared.groupBy("sha", "page_id").agg(F.count(F.lit(1)).alias("c"), F.min("url").alias("url"), F.min("n").alias("n")), "warc-keys")
    first_id = rows.groupBy("sha").agg(F.min("page_id").alias("first_id"))
    rest = split_join(rows, first_id, ["sha"]).withColumn("is_first", F.col("page_id").eqNullSafe(F.col("first_id")))
    copies = F.expr("sequence(if(is_first, 1, 0), cast(c as int) - 1)")
    revisits = rest.filter(~F.col("is_first") | (F.col("c") > 1)).select("sha", "page_id", "url", "n", "first_id", F.explode(copies).alias("copy")).select(
        _record_id(F.col("page_id"), F.col("sha"), F.col("copy")).alias("record_id"), _record_id(F.col("first_id"), F.col("sha"), F.lit(0)).alias("refers_record"),
        "page_id", "url", F.lit("revisit").alias("record_type"), F.col("first_id").alias("refers_to"), "sha", "n", F.lit(0).alias("chunk_no"),
        F.lit(None).cast("string").alias("so_far"), F.lit(None).cast("binary").alias("data"),
    )
    # a response's key row stands before its chunks in the order of a partition
    heads = rows.groupBy("sha").agg(F.min_by(F.struct("page_id", "url", "n"), F.coalesce("page_id", F.lit((1 << 63) - 1))).alias("r"))
    heads = heads.select("sha", F.lit(-1).alias("chunk_no"), F.lit(-1).alias("src"), "r.page_id", "r.url", "r.n", F.lit(None).cast("binary").alias("data"))
    # of the payloads with the most copies only the response's is cut; of others each task sends one
    copied = rows.groupBy("sha").agg(F.sum("c").alias("copies"), F.min("page_id").alias("first_id")).filter(F.col("copies") >= COPIES)
    copied = copied.orderBy(F.desc("copies"), "sha").limit(MOST_COPIED).select(F.col("sha").alias("copied"), "first_id")
    own = p.join(F.broadcast(copied), F.upper(F.sha1("payload")) == F.col("copied"), "left").filter(F.col("copied").isNull() | F.col("page_id").eqNullSafe(F.col("first_id")))
    chunks = own.select("page_id", "url", "payload").mapInArrow(_cut(chunk, min_revisit_bytes), _DEALT)
    dealt = heads.union(chunks).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "sha")
    return dealt.sortWithinPartitions("sha", "chunk_no", "src"), revisits


def chunked_records(pages: DataFrame, min_revisit_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """The record table of pages (page_id, url, html): a row a record and chunk, with so_far, the digest up to it.

    Of equal payloads of at least min_revisit_bytes bytes the one with the smallest page_id is a response, and the others
    are revisits that carry no payload; shorter payloads are responses each. Rows that repeat both page_id and payload keep
    one response. A null page_id is after all others; where all are null one of them is the response. Null html is an empty
    payload. The chunks of a record follow each other in one partition. Each task sends a payload that it has once.
    """
    dealt, revisits = _dealt(pages, min_revisit_bytes, chunk)
    return dealt.mapInArrow(_carry, _RECORDS).union(revisits)


def _base32(sha_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha_hex)).decode()


def _write(folder: str, segment: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path, out, done = None, "", None, []
        member, digest, left, sha = None, None, 0, ""

        def put(data: bytes) -> None:
            nonlocal size
            packed = member.compress(data)
            size += len(packed)
            out.write(packed)

        name, size, n = "", 0, 0
        for b in batches:
            cols = {k: b.column(k) for k in b.schema.names}
            for k in range(b.num_rows):
                get = lambda c, k=k: cols[c][k].as_py()
                if get("chunk_no") == 0:
                    if out is None or size >= segment:
                        if out is not None:
                            out.close()
                            done.append((name, n))
                        if files is None:
                            files, path = open_folder(folder)
                            files.create_dir(path, recursive=True)
                        name, size, n = new_name(path, "segment", "warc.gz"), 0, 0
                        out = files.open_output_stream(name, compression=None)
                    n += 1
                    sha, left, digest = get("sha").lower(), get("n"), hashlib.sha1()
                    kind = get("record_type")
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {left}\r\n\r\n".encode()
                    head = [
                        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {get('record_id')}", "WARC-Date: 1970-01-01T00:00:00Z",
                        "WARC-Target-URI: " + get("url").replace("\r", "%0D").replace("\n", "%0A"), "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{_base32(sha)}",
                    ]
                    if get("page_id") is not None:
                        head.append(f"X-Page-Id: {get('page_id')}")
                    if kind == "revisit":
                        left = 0
                        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {get('refers_record')}"]
                        if get("refers_to") is not None:
                            head.append(f"X-Refers-To-Page: {get('refers_to')}")
                    head.append(f"Content-Length: {len(http) + left}")
                    member = zlib.compressobj(3, zlib.DEFLATED, 31)
                    put(("\r\n".join(head) + "\r\n\r\n").encode() + http)
                data = get("data") or b""
                digest.update(data)
                put(data)
                left -= len(data)
                if not left:
                    if kind == "response" and digest.hexdigest() != sha:
                        raise ValueError(f"digest of {get('record_id')} differs from its chunks'")
                    put(b"\r\n\r\n")
                    packed = member.flush()
                    size += len(packed)
                    out.write(packed)
        if out is not None:
            out.close()
            done.append((name, n))
        yield pa.RecordBatch.from_pylist([{"folder": folder, "name": x.rsplit("/", 1)[1], "n_records": k} for x, k in done], pa.schema([("folder", pa.string()), ("name", pa.string()), ("n_records", pa.int64())]))

    return run


def archive_pages(pages: DataFrame, min_revisit_bytes: int = 0, chunk: int = CHUNK, segment: int = SEGMENT) -> DataFrame:
    """write_warc(chunked_records(pages)), with chunks going to their file in the task that puts them in order."""
    dealt, revisits = _dealt(pages, min_revisit_bytes, chunk)
    folder = shared_folder(pages.sparkSession, "warc")
    write = _write(folder, segment)
    rows = dealt.mapInArrow(lambda batches: write(_carry(batches)), _MANIFEST).union(revisits.mapInArrow(write, _MANIFEST))
    return materialise(rows, "warc-manifest")


def write_warc(records: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Write chunked_records() as archives in the shared folder; a row an archive. Archives of lost attempts aren't in the manifest."""
    spark = records.sparkSession
    ship(spark)
    folder = shared_folder(spark, "warc")
    return materialise(records.mapInArrow(_write(folder, segment), _MANIFEST), "warc-manifest")


class _Stream:
    """The decompressed bytes of a gzip file of many members, a buffer at a time."""

    def __init__(self, f: object) -> None:
        self.f, self.gz, self.raw, self.buf, self.over = f, zlib.decompressobj(31), b"", b"", False

    def _more(self) -> bool:
        while not self.over:
            raw = self.raw or self.f.read(_READ)
            if not raw:
                self.over = True
                return False
            out = self.gz.decompress(raw, _READ)
            self.raw = self.gz.unconsumed_tail
            if self.gz.eof:
                self.raw, self.gz = self.gz.unused_data, zlib.decompressobj(31)
            if out:
                self.buf += out
                return True
        return False

    def line(self) -> bytes | None:
        """Up to the next CRLF, which is dropped; None at the end of the file."""
        while (k := self.buf.find(b"\r\n")) < 0:
            if not self._more():
                return None
        x, self.buf = self.buf[:k], self.buf[k + 2 :]
        return x

    def some(self, most: int) -> bytes:
        """At most so many bytes, at least one unless the file ends."""
        if not self.buf:
            self._more()
        x, self.buf = self.buf[:most], self.buf[most:]
        return x

    def exactly(self, n: int) -> bytes:
        while len(self.buf) < n and self._more():
            pass
        if len(self.buf) < n:
            raise ValueError("an archive ends inside a record")
        x, self.buf = self.buf[:n], self.buf[n:]
        return x


def _head(s: _Stream) -> dict[str, str]:
    found = {}
    while x := s.line():
        k, _, v = x.decode().partition(":")
        found[k.lower()] = v.strip()
    return found


def _read(chunk: int, with_data: bool) -> Callable:
    def rows(folder: str, name: str) -> Iterator[tuple]:
        files, path = open_folder(folder)
        with files.open_input_stream(f"{path}/{name}", compression=None) as f:
            s = _Stream(f)
            while (first := s.line()) is not None:
                if not first.startswith(b"WARC/"):
                    raise ValueError(f"no record where one should begin in {name}")
                head = _head(s)
                s.line()
                http = _head(s)
                number = lambda k: int(head[k]) if k in head else None  # noqa: B023, E731
                total, kind, said = int(http["content-length"]), head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                same = (head["warc-record-id"], number("x-page-id"), kind, number("x-refers-to-page"), head["warc-target-uri"])
                if kind == "revisit":
                    yield (*same, 0, True, total, said, None)
                else:
                    left, k, digest = total, 0, hashlib.sha1()
                    while left or not k:
                        data = s.exactly(min(chunk, left))
                        digest.update(data)
                        left, k = left - len(data), k + 1
                        so_far = base64.b32encode(digest.digest()).decode()
                        if not left and so_far != said:
                            raise ValueError(f"the payload of {same[0]} doesn't have its digest")
                        if with_data or not left:
                            yield (*same, k - 1, not left, total - left, so_far, data if with_data else None)
                if s.exactly(4) != b"\r\n\r\n":
                    raise ValueError(f"no end of a record in {name}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((x for b in batches for row in b.to_pylist() for x in rows(row["folder"], row["name"])), _arrow(_ROWS), 9)

    return run


def read_warc(manifest: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunk rows of archives: payload_bytes and payload_digest (bare base32 SHA-1) cover the payload up to and with
    that chunk, so the row with is_last has those of the full payload; a revisit has one row with its header's. Without
    data only last rows come."""
    ship(manifest.sparkSession)
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("folder", "name").repartition(n).mapInArrow(_read(chunk, with_data), _ROWS)
