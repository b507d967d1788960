"""Books in EPUB files: pages, metadata and table of contents as DataFrames, and books made of them again.

A book is a row of bytes. One pass opens it in a task and gives rows of its parts, which go on as columns: pages to
operators.pages, metadata and contents to readers.metadata() and readers.contents(), all three to segments.number_book().
"""

from __future__ import annotations

import io
import posixpath
import shutil
import urllib.parse
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import materialise, ship

#: What a file that is no book, a damaged or a locked one gives.
_BROKEN = (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, KeyError, ValueError, RuntimeError, EOFError)

_PARTS = pa.schema([("book", pa.string()), ("part", pa.string()), ("name", pa.string()), ("seq", pa.int32()), ("parent", pa.string()), ("kind", pa.string()), ("text", pa.string()), ("error", pa.string())])
_SQL = "book string, part string, name string, seq int, parent string, kind string, text string, error string"


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _all(e: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (x for x in e.iter() if _local(x) == name)


def _inside(e: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [x for x in e if _local(x) == name]


def _words(e: ElementTree.Element | None) -> str:
    return " ".join("".join(e.itertext()).split()) if e is not None else ""


def _contents(root: ElementTree.Element) -> Iterator[tuple[str, str | None, int, ElementTree.Element | None]]:
    """(node, parent, seq, label) of a table of contents: navPoints of NCX, or the list of an EPUB 3 nav."""
    tops = [(p, None) for m in _all(root, "navMap") for p in _inside(m, "navPoint")]
    nav = not tops
    if nav:
        navs = [n for n in _all(root, "nav") if any(k.endswith("type") and v == "toc" for k, v in n.attrib.items())] or list(_all(root, "nav"))
        tops = [(p, None) for n in navs[:1] for o in _inside(n, "ol") for p in _inside(o, "li")]
    left, number = [(p, parent, k) for k, (p, parent) in enumerate(tops)][::-1], 0
    while left:
        point, parent, seq = left.pop()
        node, number = f"n{number}", number + 1
        label = next((x for x in point if _local(x) in ("navLabel", "a", "span")), None)
        yield node, parent, seq, label
        below = [x for o in _inside(point, "ol") for x in _inside(o, "li")] if nav else _inside(point, "navPoint")
        left += [(x, node, k) for k, x in enumerate(below)][::-1]


class _Package:
    """The parts of an open book: its package file, and its table of contents if there is one."""

    def __init__(self, z: zipfile.ZipFile) -> None:
        self.names = set(z.namelist())
        root = next(_all(ElementTree.fromstring(z.read("META-INF/container.xml")), "rootfile"), None)
        if root is None:
            raise KeyError("rootfile")
        self.opf = root.attrib["full-path"]
        self.package = ElementTree.fromstring(z.read(self.opf))
        self.items = {x.attrib["id"]: x.attrib for m in _all(self.package, "manifest") for x in _inside(m, "item")}
        nav = next((x for x in self.items.values() if "nav" in x.get("properties", "").split()), None)
        ncx = next((x for x in self.items.values() if x.get("media-type") == "application/x-dtbncx+xml"), None)
        self.toc = next((self.place(t["href"]) for t in (ncx, nav) if t is not None and self.place(t["href"]) in self.names), None)

    def place(self, href: str) -> str:
        return posixpath.normpath(posixpath.join(posixpath.dirname(self.opf), urllib.parse.unquote(href)))

    def metadata(self) -> Iterator[tuple[str, int, ElementTree.Element]]:
        """(name, place among those of the name, element) of each piece with a text."""
        for m in _all(self.package, "metadata"):
            counts: dict[str, int] = {}
            for x in m:
                if _words(x):
                    yield _local(x), counts.setdefault(_local(x), 0), x
                    counts[_local(x)] += 1


def _open(book: str, content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        p = _Package(z)
        for name, seq, x in p.metadata():
            yield book, "metadata", name, seq, None, None, _words(x), None
        if p.toc:
            yield from ((book, "contents", node, seq, parent, None, _words(label), None) for node, parent, seq, label in _contents(ElementTree.fromstring(z.read(p.toc))))
        spine = {x.attrib["idref"]: k for s in _all(p.package, "spine") for k, x in enumerate(_inside(s, "itemref"))}
        for k, x in p.items.items():
            name = p.place(x["href"])
            if x.get("media-type") in ("application/xhtml+xml", "text/html") and name in p.names:
                yield book, "page", name, spine.get(k), None, x["media-type"], z.read(name).decode("utf-8-sig", "replace"), None


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for book, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            try:
                rows = list(_open(book, content.as_buffer().to_pybytes()))
            except _BROKEN as e:
                rows = [(book, "error", None, None, None, None, None, f"{type(e).__name__}: {e}")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _PARTS.types, strict=True)], schema=_PARTS)


def read_books(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """book (path), part, name, seq, parent, kind, text, error: a row for each page (name: its path in the file, seq: its
    place in the reading order, null outside it), each piece of metadata (name, seq) and each entry of the contents (name:
    node, parent, seq). A file that is no book, or a damaged one, is one
    row with part 'error'; an empty file gives none. Written once, as every part is read apart."""
    ship(spark)
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return materialise(files.mapInArrow(_run, _SQL), "books")


def pages(books: DataFrame) -> DataFrame:
    """book, href, spine, html, as operators.pages takes them (key: a struct or one of both)."""
    return books.filter("part = 'page'").select("book", F.col("name").alias("href"), F.col("seq").alias("spine"), F.col("text").alias("html"))


def metadata(books: DataFrame) -> DataFrame:
    """book and metadata, a map of names to texts in order."""
    rows = books.filter("part = 'metadata'").groupBy("book", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]).alias("texts"))
    return rows.groupBy("book").agg(F.map_from_entries(F.collect_list(F.struct("name", "texts"))).alias("metadata"))


def nodes(books: DataFrame) -> DataFrame:
    """book, node, parent, seq, title, as readers.contents() takes them."""
    return books.filter("part = 'contents'").select("book", F.col("name").alias("node"), "parent", "seq", F.col("text").alias("title"))


def _xml(data: bytes, root: ElementTree.Element) -> bytes:
    """A changed tree as a file, with the prefixes that it had."""
    for _, (prefix, uri) in ElementTree.iterparse(io.BytesIO(data), events=("start-ns",)):
        if not prefix.startswith("ns"):
            ElementTree.register_namespace(prefix, uri)
    return ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)


def _say(label: ElementTree.Element, text: str) -> None:
    """Give a label of the contents, or a piece of metadata, another text."""
    inner = next((x for x in label.iter() if _local(x) == "text"), label)
    for child in list(inner):
        inner.remove(child)
    inner.text = text


def _changed(z: zipfile.ZipFile, changes: list[dict]) -> dict[str, bytes]:
    """The files of a book that its changes touch, as they are to be."""
    p = _Package(z)
    new = {(c["part"], c["name"], c["seq"] if c["part"] == "metadata" else None): c["text"] for c in changes if c["text"] is not None}
    out = {name: text.encode() for (part, name, _), text in new.items() if part == "page" and name in p.names}
    touched = [(x, new["metadata", name, seq]) for name, seq, x in p.metadata() if ("metadata", name, seq) in new and _words(x) != new["metadata", name, seq]]
    for x, text in touched:
        _say(x, text)
    if touched:
        out[p.opf] = _xml(z.read(p.opf), p.package)
    if p.toc and any(part == "contents" for part, _, _ in new):
        data = out.get(p.toc) or z.read(p.toc)
        root = ElementTree.fromstring(data)
        labels = [(label, new["contents", node, None]) for node, _, _, label in _contents(root) if ("contents", node, None) in new and label is not None]
        for label, text in labels:
            _say(label, text)
        out[p.toc] = _xml(data, root)
    return out


def _rewrite(content: bytes, changes: list[dict], out: object) -> None:
    """A book with its changes, written entry by entry in the order of the old one; what isn't changed is copied in blocks."""
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w") as made:
        changed = _changed(z, changes)
        for info in sorted(z.infolist(), key=lambda i: i.filename != "mimetype"):  # which readers expect first
            entry = zipfile.ZipInfo(info.filename, info.date_time)
            entry.compress_type, entry.external_attr = zipfile.ZIP_STORED if info.filename == "mimetype" else info.compress_type, info.external_attr
            if info.filename in changed:
                made.writestr(entry, changed[info.filename])
            else:
                with z.open(info) as old, made.open(entry, "w", force_zip64=info.file_size >= 1 << 31) as new:
                    shutil.copyfileobj(old, new, 1 << 20)


def write_books(spark: SparkSession, paths: str | list[str], changes: DataFrame, folder: str) -> DataFrame:
    """Write the books at paths with changes to them as EPUB files below folder, a place of any file system that tasks reach.
    Returns the manifest: book, path, bytes and error.

    changes has the columns of read_books() that name a part (book, part, name, seq) and its new text; parts that no row
    names stay as they are, byte by byte, and a null text is none. Pages that the book doesn't have are left out. Books
    without changes are copied; one that can't be read is a row with an error and no file.

    Each task writes under names that no other attempt uses, and removes what it began if it fails. The manifest is
    written last and says which files count: `written_books` reads it, `sweep` removes what others have left.
    """
    ship(spark)
    kinds = pa.schema([("book", pa.string()), ("path", pa.string()), ("bytes", pa.int64()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(f"{root}/books", recursive=True)
        for b in batches:
            for book, content, found in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                stem = posixpath.basename(book).rsplit(".", 1)[0][:100]
                name, error = f"books/{stem}-{uuid.uuid4().hex}.epub", None
                try:
                    with files.open_output_stream(f"{root}/{name}") as out:
                        _rewrite(content.as_buffer().to_pybytes(), found or [], _Counted(out))
                except BaseException as e:
                    files.delete_file(f"{root}/{name}")
                    if not isinstance(e, _BROKEN):
                        raise
                    error = f"{type(e).__name__}: {e}"
                size = None if error else files.get_file_info(f"{root}/{name}").size
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((book, None if error else name, size, error), kinds.types, strict=True)], schema=kinds)

    per_book = changes.groupBy("book").agg(F.collect_list(F.struct("part", "name", "seq", "text")).alias("changes"))  # a book's
    books = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("book"), "content")
    rows = books.join(per_book, "book", "left").select("book", "content", "changes")
    rows.mapInArrow(run, "book string, path string, bytes long, error string").write.mode("overwrite").parquet(f"{folder.rstrip('/')}/manifest")
    return written_books(spark, folder)


class _Counted(io.RawIOBase):
    """A stream that knows how far it is but can't go back, as zipfile takes it."""

    def __init__(self, out: object) -> None:
        self.out, self.at = out, 0

    def writable(self) -> bool:
        return True

    def write(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at


def written_books(spark: SparkSession, folder: str) -> DataFrame:
    """book, path, bytes and error of the books that write_books() has finished."""
    rows = spark.read.schema("book string, path string, bytes long, error string").parquet(f"{folder.rstrip('/')}/manifest")
    return rows.withColumn("path", F.concat(F.lit(f"{folder.rstrip('/')}/"), "path"))


def sweep(spark: SparkSession, folder: str) -> int:
    """Remove files of write_books() that its manifest doesn't name; how many there were."""
    ship(spark)
    known = written_books(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    there = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/books").select(F.element_at(F.split("path", "/"), -1).alias("name"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                files.delete_file(f"{root}/books/{urllib.parse.unquote(name)}")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return there.join(known, "name", "left_anti").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
