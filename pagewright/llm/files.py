"""Files that tasks write below a shared folder.

Each attempt of a task writes under a name of its own and reports that name in its rows: only files
named in a stored result count, so attempts that are lost or run twice leave nothing that is read.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file, on any store that Arrow knows."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def new_file(folder: str, part: int, suffix: str) -> str:
    """Name for the output of one attempt at partition `part`; makes the folder."""
    system, path = located(folder)
    system.create_dir(path, recursive=True)
    return f"{folder}/part-{part:06d}-{uuid.uuid4().hex}{suffix}"
