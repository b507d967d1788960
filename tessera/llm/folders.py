"""Files that Python tasks write to and read from the shared folder, by Arrow's file systems."""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a shared folder (file:, hdfs:, s3: or a plain path)."""
    return fs.FileSystem.from_uri(uri)


def new_name(folder: str, stem: str, ending: str) -> str:
    """A name that no other attempt of a task uses: only names in a committed manifest count."""
    return f"{folder}/{stem}-{uuid.uuid4().hex}.{ending}"
