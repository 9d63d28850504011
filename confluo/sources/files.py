"""Files that tasks open themselves: local ones and those of the stores that Arrow reaches."""

from __future__ import annotations

import re

import pyarrow as pa
from pyarrow import fs


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def opened(path: str) -> pa.NativeFile:
    """The file, for reading at any place."""
    where, name = store(path)
    return where.open_input_file(name)


def found(path: str, ending: str) -> list[tuple[str, int]]:
    """Path and size of a file, or of a folder's files with this ending, by name."""
    where, name = store(path)
    scheme = path[: len(path) - len(name)] if path.endswith(name) else ""
    info = where.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    some = [info] if info.is_file else where.get_file_info(fs.FileSelector(name, recursive=True))
    return sorted((scheme + f.path, f.size) for f in some if f.is_file and (info.is_file or f.path.lower().endswith(ending)))


def size_of(path: str) -> int | None:
    """A file's size; none if there is no such file."""
    where, name = store(path)
    info = where.get_file_info(name)
    return info.size if info.is_file else None
