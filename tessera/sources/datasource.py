"""Subtitles, game records and books as data sources: spark.read.format("srt" | "pgn" | "epub"), and write.format() of them.

    datasource.register(spark)
    spark.read.format("srt").option("encoding", "latin-1").load("file:///subtitles")
    rows.repartition("path").write.format("srt").mode("append").save("file:///translated")

A reader lists the files below its path and gives tasks whole files, of about PART_BYTES together; the option pathGlobFilter
leaves files out before they are opened. Filters aren't pushed down: this Spark keeps those of one query for all others of
the same DataFrame, which would lose rows. A writer's tasks write each file
under a name of their own; commit gives the files their names, abort removes them, so a failed job leaves none. Rows of
one file are one task's: deal them out by `path`. Files are reached by Arrow's file systems.
"""

from __future__ import annotations

import fnmatch
import os
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import Any

from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tessera.runtime import ship
from tessera.sources import epub

PART_BYTES = 64 << 20
STAGING = "_staging"


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


class FileReader(DataSourceReader):
    """Whole files with one ending below a path. A file is a task's work; a parser gives its rows behind its path."""

    def __init__(self, options: dict[str, str], ending: str) -> None:
        self.path, self.encoding, self.ending = options["path"], options.get("encoding", "utf-8"), ending
        self.wanted = options.get("pathglobfilter") or options.get("pathGlobFilter") or "*"

    def partitions(self) -> list[Files]:
        files, root = _open(self.path)
        info = files.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(root, recursive=True))
        parts: list[Files] = []
        size = PART_BYTES
        for f in sorted((f for f in found if f.type == fs.FileType.File and self._read_here(f.path, root)), key=lambda f: f.path):
            if size + f.size > PART_BYTES:
                parts.append(Files([]))
                size = 0
            parts[-1].paths.append(f.path)
            size += f.size
        return parts or [Files([])]

    def _read_here(self, path: str, root: str) -> bool:
        inside = posixpath.relpath(path, root).split("/") if path != root else [posixpath.basename(path)]
        return path.endswith(self.ending) and not any(x.startswith(("_", ".")) and x not in (".", "..") for x in inside) and fnmatch.fnmatchcase(inside[-1], self.wanted)

    def read(self, partition: Files) -> Iterator[tuple]:
        files, _ = _open(self.path)
        for path in partition.paths:
            with files.open_input_stream(path) as f:
                yield from ((path, *row) for row in self.rows(path, f.read()))

    def text(self, data: bytes) -> str:
        return re.sub("\r\n?", "\n", data.decode(self.encoding, "replace").removeprefix("﻿"))

    def rows(self, path: str, data: bytes) -> Iterator[tuple]:
        raise NotImplementedError


class FileWriter(DataSourceWriter):
    """A file for each `path` of the rows: its last part is the file's name below the folder that is written to."""

    def __init__(self, options: dict[str, str], overwrite: bool, ending: str) -> None:
        self.folder, self.encoding, self.overwrite, self.ending, self.job = options["path"], options.get("encoding", "utf-8"), overwrite, ending, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        files, root = _open(self.folder)
        rows = sorted((r.asDict(recursive=True) for r in iterator), key=lambda r: (r["path"], r.get("seq") or 0))
        done = Written([])
        files.create_dir(f"{root}/{STAGING}/{self.job}", recursive=True)
        for path, found in groupby(rows, key=lambda r: r["path"]):
            own = f"{root}/{STAGING}/{self.job}/{uuid.uuid4().hex}"
            with files.open_output_stream(own) as out:
                self.put(path, list(found), out)
            name = posixpath.basename(path)
            done.files.append((own, name if name.endswith(self.ending) else name + self.ending))
        return done

    def put(self, path: str, rows: list[dict[str, Any]], out: Any) -> None:
        out.write(self.text(rows).encode(self.encoding))

    def text(self, rows: list[dict[str, Any]]) -> str:
        raise NotImplementedError

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _open(self.folder)
        named = [x for m in messages if m for x in m.files]
        names = [name for _, name in named]
        twice = {n for n in names if names.count(n) > 1} if len(names) < 1000 else {n for n, g in groupby(sorted(names)) if len(list(g)) > 1}
        there = {posixpath.basename(f.path) for f in files.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File}
        if twice or not self.overwrite and there & set(names):
            self.abort(messages)
            raise ValueError(f"files that were written twice, or that exist: {sorted(twice or there & set(names))[:5]}")
        if self.overwrite:
            for name in there:
                if name.endswith(self.ending):
                    files.delete_file(f"{root}/{name}")
        for own, name in named:
            files.move(own, f"{root}/{name}")
        files.delete_dir(f"{root}/{STAGING}/{self.job}")

    def abort(self, messages: list[Written | None]) -> None:
        files, root = _open(self.folder)
        if files.get_file_info(f"{root}/{STAGING}/{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{STAGING}/{self.job}")


class _Source(DataSource):
    ending = ""
    reading: type[FileReader]
    writing: type[FileWriter]

    def reader(self, schema: StructType) -> FileReader:
        return self.reading(dict(self.options), self.ending)

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return self.writing(dict(self.options), overwrite, self.ending)


class SubtitleReader(FileReader):
    def rows(self, path: str, data: bytes) -> Iterator[tuple]:
        for seq, section in enumerate(x for x in self.text(data).strip().split("\n\n") if x):
            number, _, rest = section.partition("\n")
            time, _, text = rest.partition("\n")
            yield seq, number, time, text


class SubtitleWriter(FileWriter):
    def text(self, rows: list[dict[str, Any]]) -> str:
        return "\n\n".join("\n".join(x for x in (r["number"], r["time"], r["text"]) if x is not None) for r in rows)


class SubtitleSource(_Source):
    """path, seq, number, time, text of the sections of subtitle files; sections are parted by one empty line."""

    ending, reading, writing = ".srt", SubtitleReader, SubtitleWriter

    @classmethod
    def name(cls) -> str:
        return "srt"

    def schema(self) -> str:
        return "path string, seq int, number string, time string, text string"


class GameReader(FileReader):
    #: A comment with a letter in it (a fixed value of the format, with the range as services expect it).
    comment = re.compile(r"(\{[^}]*[a-zA-z][^}]*\})")

    def rows(self, path: str, data: bytes) -> Iterator[tuple]:
        for seq, piece in enumerate(self.comment.split(self.text(data))):
            if piece:
                yield seq, "comment" if seq % 2 else "moves", piece


class GameWriter(FileWriter):
    def text(self, rows: list[dict[str, Any]]) -> str:
        return "".join(r["text"] for r in rows if r["text"] is not None)


class GameSource(_Source):
    """path, seq, kind (moves or comment), text: the pieces of game records, whose texts joined are the file."""

    ending, reading, writing = ".pgn", GameReader, GameWriter

    @classmethod
    def name(cls) -> str:
        return "pgn"

    def schema(self) -> str:
        return "path string, seq int, kind string, text string"


class BookReader(FileReader):
    def rows(self, path: str, data: bytes) -> Iterator[tuple]:
        try:
            found = list(epub._open(path, data))
        except epub._BROKEN as e:
            found = [(path, "error", None, None, None, None, None, f"{type(e).__name__}: {e}")]
        yield from (row[1:] for row in found)


class BookWriter(FileWriter):
    def put(self, path: str, rows: list[dict[str, Any]], out: Any) -> None:
        files, at = _open(path)
        with files.open_input_stream(at) as f:
            epub._rewrite(f.read(), rows, epub._Counted(out))


class BookSource(_Source):
    """path, part, name, seq, parent, kind, text, error of books, as epub.read_books(). Written rows change the book that
    stands at their path; parts without a row stay as they are."""

    ending, reading, writing = ".epub", BookReader, BookWriter

    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return "path string, part string, name string, seq int, parent string, kind string, text string, error string"


def register(spark: SparkSession) -> None:
    """Make the formats srt, pgn and epub known to a session."""
    ship(spark)
    for source in (SubtitleSource, GameSource, BookSource):
        spark.dataSource.register(source)
