"""Open files by URI from Python tasks, on local disks and object stores."""

from __future__ import annotations

import fnmatch
import io
import re

import pyarrow.fs as pafs


def normalize_uri(path: str) -> str:
    """Drop a query string; give object-store paths the scheme Spark reads."""
    path = str(path).split("?", 1)[0]
    return re.sub(r"^s3n?://", "s3a://", path)


def open_filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a URI and the path on it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def list_files(uri: str, extensions: tuple[str, ...] = ()) -> list[tuple[str, int]]:
    """(uri, size) of the visible files below a folder, or of one file.

    The last part of the path may be a pattern with ``*``.
    """
    folder, _, name = uri.rpartition("/")
    if "*" in name:
        home = open_filesystem(folder)[1].rstrip("/")
        beside = [f for f in list_files(folder, extensions) if open_filesystem(f[0])[1].rpartition("/")[0] == home]
        return [f for f in beside if fnmatch.fnmatchcase(f[0].rpartition("/")[2], name)]
    filesystem, path = open_filesystem(uri)
    info = filesystem.get_file_info(path)
    found = [info]
    if info.type == pafs.FileType.Directory:
        found = filesystem.get_file_info(pafs.FileSelector(path, recursive=True))
        found = [f for f in found if f.type == pafs.FileType.File]
        root = path.rstrip("/") + "/"
        found = [f for f in found if not any(p[:1] in "._" for p in f.path.removeprefix(root).split("/"))]
        if extensions:
            found = [f for f in found if f.path.lower().endswith(extensions)]
    elif info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(uri)
    scheme = uri[: uri.index("://") + 3] if "://" in uri and not uri.startswith("file:") else ""
    return sorted((scheme + f.path, f.size or 0) for f in found)


def read_head(uri: str, size: int) -> bytes:
    """The first bytes of a file."""
    filesystem, path = open_filesystem(uri)
    with filesystem.open_input_stream(path) as stream:
        return stream.read(size)


class _Positioned(io.RawIOBase):
    """An Arrow file as a Python one: seeking before the start is an OSError."""

    def __init__(self, file):
        self._file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._file.tell()

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        start = {io.SEEK_SET: 0, io.SEEK_CUR: self._file.tell(), io.SEEK_END: self._file.size()}[whence]
        if start + offset < 0:
            raise OSError("position before the start of the file")
        return self._file.seek(start + offset)

    def readinto(self, buffer) -> int:
        data = self._file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def close(self) -> None:
        self._file.close()
        super().close()


def open_seekable(uri: str) -> io.BufferedReader:
    """A file that can be read from any position."""
    filesystem, path = open_filesystem(uri)
    return io.BufferedReader(_Positioned(filesystem.open_input_file(path)), 1024 * 1024)
