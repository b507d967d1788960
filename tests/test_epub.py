"""Whole books: read, numbered and their pages segmented."""

import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import pages as P
from tessera.operators import segments as S
from tessera.operators import translate as TR
from tessera.sources import epub as E
from tessera.sources import readers as R
from tessera.sources import writers as W

CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/book.opf" media-type="x"/></rootfiles></container>'
OPF = """<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>A Book</dc:title><dc:creator>Ann</dc:creator><dc:creator>Bob</dc:creator><dc:language>en</dc:language></metadata>
<manifest><item id="p2" href="text/two%20.xhtml" media-type="application/xhtml+xml"/><item id="p1" href="text/one.html" media-type="text/html"/><item id="c" href="s.css" media-type="text/css"/><item id="gone" href="gone.xhtml" media-type="application/xhtml+xml"/>{toc}</manifest>
<spine><itemref idref="p1"/></spine></package>"""
NCX = '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>One</text></navLabel><navPoint><navLabel><text>One A</text></navLabel></navPoint></navPoint><navPoint><navLabel><text>Two</text></navLabel></navPoint></navMap></ncx>'
NAV = '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol><li><a href="x">One</a><ol><li><a href="y">One A</a></li></ol></li><li><span>Two</span></li></ol></nav></body></html>'


def book(path, toc, name, text):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", CONTAINER)
        z.writestr("OPS/book.opf", OPF.format(toc=toc))
        z.writestr("OPS/text/one.html", "<html><body><p>First</p><p>1.2</p></body></html>")
        z.writestr("OPS/text/two .xhtml", "<html><body><p>Second</p></body></html>")
        z.writestr(f"OPS/{name}", text)


def test_books(spark, tmp_path):
    book(tmp_path / "a.epub", '<item id="t" href="toc.ncx" media-type="application/x-dtbncx+xml"/>', "toc.ncx", NCX)
    book(tmp_path / "b.epub", '<item id="t" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>', "nav.xhtml", NAV)
    (tmp_path / "c.epub").write_bytes(b"no book")
    books = E.read_books(spark, str(tmp_path)).withColumn("book", F.regexp_extract("book", r"(\w)\.epub$", 1))
    assert [(r.book, r.error.split(":")[0]) for r in books.filter("part = 'error'").collect()] == [("c", "BadZipFile")]
    assert {(r.book, r.href, r.spine) for r in E.pages(books).filter("href like '%text%'").collect()} == {(b, h, s) for b in "ab" for h, s in (("OPS/text/one.html", 0), ("OPS/text/two .xhtml", None))}
    assert {r.book: dict(r.metadata) for r in E.metadata(books).collect()} == {b: {"title": ["A Book"], "creator": ["Ann", "Bob"], "language": ["en"]} for b in "ab"}
    toc = R.contents(E.nodes(books), "book")
    assert {(r.book, r.title, tuple(r.place)) for r in toc.collect()} == {(b, *x) for b in "ab" for x in (("One", (0,)), ("One A", (0, 0)), ("Two", (1,)))}
    keyed = E.pages(books).filter("book = 'a'").withColumn("page", F.concat_ws("|", "book", "href"))
    parts = P.page_segments(keyed, "page").withColumn("book", F.split_part("page", F.lit("|"), F.lit(1)))
    meta = R.metadata(E.metadata(books).filter("book = 'a'"), "book", translate=True)
    rows = S.number_book(meta, toc.filter("book = 'a'"), parts).orderBy("oid").collect()
    assert [(r.oid, r.part, r.text, r.ignored) for r in rows] == [
        (0, "metadata", "A Book", False), (1, "metadata", "Ann", False), (2, "metadata", "Bob", False), (3, "contents", "One", False), (4, "contents", "One A", False), (5, "contents", "Two", False),
        (6, "page", "First", False), (7, "page", "1.2", True), (8, "page", "Second", False),
    ]


def test_damaged_books_are_error_rows(spark, tmp_path):
    book(tmp_path / "a.epub", "", "x", "")
    whole = (tmp_path / "a.epub").read_bytes()
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("META-INF/container.xml", "<container><rootfiles/></container>")
    with zipfile.ZipFile(tmp_path / "c.epub", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("META-INF/container.xml", CONTAINER * 9)
    deflated = bytearray((tmp_path / "c.epub").read_bytes())
    deflated[60:90] = b"\xff" * 30
    (tmp_path / "c.epub").write_bytes(deflated)
    (tmp_path / "d.epub").write_bytes(whole[: len(whole) // 2])
    books = E.read_books(spark, str(tmp_path)).withColumn("book", F.regexp_extract("book", r"(\w)\.epub$", 1))
    assert sorted((r.book, r.part) for r in books.filter("part = 'error'").collect()) == [(b, "error") for b in "bcd"]
    assert {r.book for r in E.pages(books).collect()} == {"a"}


def test_read_translate_write_read(spark, tmp_path):
    book(tmp_path / "a.epub", '<item id="t" href="toc.ncx" media-type="application/x-dtbncx+xml"/>', "toc.ncx", NCX)
    book(tmp_path / "b b.epub", '<item id="t" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>', "nav.xhtml", NAV)
    with zipfile.ZipFile(tmp_path / "a.epub", "a", zipfile.ZIP_DEFLATED) as z:
        z.writestr("OPS/s.css", "p {color: red}" * 900)
        z.writestr("mimetype", "application/epub+zip")
    (tmp_path / "c.epub").write_bytes(b"no book")
    books = E.read_books(spark, str(tmp_path))
    swap = lambda c: TR.reversing(F.col(c))
    pages = E.pages(books).select(F.struct("book", "href").alias("page"), "html")
    parts = P.page_segments(pages, "page").filter("not ignored").select("page", "seq", swap("content").alias("translation"))
    new = P.rewrite_pages(pages, parts, "page").select("page.book", F.lit("page").alias("part"), F.col("page.href").alias("name"), F.lit(None).cast("int").alias("seq"), F.col("html").alias("text"))
    meta = books.filter("part = 'metadata' and name in ('title', 'creator')")
    title = F.when(F.col("name") == "title", F.concat("text", F.lit(" [XX]"))).otherwise(W.place_entry(F.col("text"), swap("text"), F.lit(False), "below"))
    meta = meta.select("book", "part", "name", "seq", title.alias("text"))
    toc = books.filter("part = 'contents'").select("book", "part", "name", "seq", W.place_entry(F.col("text"), swap("text"), F.lit(False), "only").alias("text"))
    out = f"file://{tmp_path}/out"
    done = {r.book.rsplit("/", 1)[1]: r for r in E.write_books(spark, str(tmp_path), new.unionByName(meta).unionByName(toc), out).collect()}
    assert set(done) == {"a.epub", "b%20b.epub", "c.epub"} or set(done) == {"a.epub", "b b.epub", "c.epub"}
    assert done["c.epub"].error.startswith("BadZipFile") and done["c.epub"].bytes is None and done["a.epub"].bytes > 0

    again = E.read_books(spark, f"{out}/books").withColumn("book", F.regexp_extract("book", r"/(\w)[^/]*$", 1))
    assert again.filter("part = 'error'").isEmpty()
    got = {(r.book, r.name): r.text for r in again.filter("part = 'page'").collect()}
    assert "<p>First</p>" in got["a", "OPS/text/one.html"] and "fIRST" in got["a", "OPS/text/one.html"] and "sECOND" in got["b", "OPS/text/two .xhtml"] and "1.2" in got["a", "OPS/text/one.html"]
    assert {r.book: dict(r.metadata) for r in E.metadata(again).collect()} == {b: {"title": ["A Book [XX]"], "creator": ["Ann aNN", "Bob bOB"], "language": ["en"]} for b in "ab"}
    assert {(r.book, r.title, tuple(r.place)) for r in R.contents(E.nodes(again), "book").collect()} == {(b, *x) for b in "ab" for x in (("oNE", (0,)), ("oNE a", (0, 0)), ("tWO", (1,)))}
    with zipfile.ZipFile(next((tmp_path / "out" / "books").glob("a-*"))) as z, zipfile.ZipFile(tmp_path / "a.epub") as old:
        assert z.infolist()[0].filename == "mimetype" and z.read("OPS/s.css") == old.read("OPS/s.css") and z.testzip() is None
        assert b"<dc:title>" in z.read("OPS/book.opf") and b"<navLabel>" in z.read("OPS/toc.ncx") and set(z.namelist()) == set(old.namelist())

    (tmp_path / "out" / "books" / "left-over.epub").write_bytes(b"of a lost attempt")
    assert E.sweep(spark, out) == 1 and E.sweep(spark, out) == 0
    assert len(list((tmp_path / "out" / "books").glob("*.epub"))) == 2


def test_a_failed_attempt_leaves_no_file(spark, tmp_path):
    book(tmp_path / "a.epub", "", "x", "")
    bad = spark.createDataFrame([(r.book, "page", r.name, None, "x") for r in E.read_books(spark, str(tmp_path)).filter("part = 'page'").limit(1).collect()], "book string, part string, name string, seq int, text string")
    bad = bad.withColumn("text", F.raise_error(F.lit("gone")).cast("string"))
    with pytest.raises(Exception, match="gone"):
        E.write_books(spark, str(tmp_path), bad, f"file://{tmp_path}/out")
    assert not list((tmp_path / "out").rglob("*.epub")) and not (tmp_path / "out" / "manifest" / "_SUCCESS").exists()
