"""Opening and placing files from inside a task, on any file system Arrow knows."""

from __future__ import annotations

import io
import posixpath
import shutil
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from typing import IO
from urllib.parse import quote

from pyarrow import fs as pafs

from .. import fixed_values as fv

# Bytes of a file that cost less to fetch at once than in several reads.
_AT_ONCE = 256 * 1024


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path for a Spark path such as ``file:/data/x``."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    if path.startswith("/"):
        return pafs.LocalFileSystem(), path
    scheme, _, rest = path.partition(":")
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    # Spark gives paths as they are; a URI needs blanks and the like escaped.
    return pafs.FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/:@')}")


class ReadFailed(Exception):
    """The file system failed, as opposed to what stands in a file."""


class _Source:
    """A file whose own errors are told apart from those of a decoder on top of it."""

    def __init__(self, path: str):
        def opened() -> IO[bytes]:
            fs, name = locate(path)
            return fs.open_input_file(name)

        self._file = self._try(opened)

    @staticmethod
    def _try(call, *args):
        try:
            return call(*args)
        except OSError as problem:
            raise ReadFailed(str(problem)) from problem

    def read(self, size: int = -1) -> bytes:
        return self._try(self._file.read, None if size is None or size < 0 else size)

    def seek(self, offset: int, whence: int = 0) -> int:
        return self._try(self._file.seek, offset, whence)

    def tell(self) -> int:
        return self._try(self._file.tell)

    def size(self) -> int:
        return self._try(self._file.size)

    def seekable(self) -> bool:
        return True

    def close(self) -> None:
        self._file.close()

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        self.close()


def open_seekable(path: str) -> IO[bytes]:
    """A file of which only the parts read are fetched; its failures are ``ReadFailed``."""
    return _Source(path)


def open_small(path: str) -> IO[bytes]:
    """As :func:`open_seekable`, but a small file is fetched in one read."""
    source = open_seekable(path)
    if source.size() > _AT_ONCE:
        return source
    with source:
        return io.BytesIO(source.read())


def place(path: str, fill: Callable[[IO[bytes]], None]) -> int:
    """Write a file under a name of its own, then rename it to ``path``.

    A task that dies leaves at most a stray temporary file, and a repeated task
    replaces the file with the same bytes.
    """
    fs, name = locate(path)
    folder, base = posixpath.split(name)
    fs.create_dir(folder, recursive=True)
    temporary = f"{folder}/.{base}.{uuid.uuid4().hex}.tmp"
    try:
        with fs.open_output_stream(temporary) as out:
            fill(out)
        move(fs, temporary, name)
    except BaseException:
        if fs.get_file_info(temporary).type == pafs.FileType.File:
            fs.delete_file(temporary)
        raise
    return fs.get_file_info(name).size


def move(fs: pafs.FileSystem, source: str, target: str) -> None:
    """Rename over whatever is there, also where a rename would refuse to."""
    try:
        fs.move(source, target)
    except OSError:
        both = [info.type == pafs.FileType.File for info in fs.get_file_info([source, target])]
        if not all(both):
            raise
        fs.delete_file(target)
        fs.move(source, target)


def copy_file(source: str, target: str) -> int:
    def fill(out: IO[bytes]) -> None:
        with open_seekable(source) as src:
            shutil.copyfileobj(src, out, fv.COPY_BLOCK)

    return place(target, fill)


def remove_folder(folder: str) -> None:
    fs, name = locate(folder)
    if fs.get_file_info(name).type == pafs.FileType.Directory:
        fs.delete_dir(name)


@contextmanager
def opened(paths_to_open=open_seekable):
    """Keep the last opened file of a run of rows that share it."""
    state: dict[str, object] = {"path": None, "file": None}

    def get(path: str):
        if state["path"] != path:
            if state["file"] is not None:
                state["file"].close()
            state["path"], state["file"] = None, None
            state["file"] = paths_to_open(path)
            state["path"] = path
        return state["file"]

    try:
        yield get
    finally:
        if state["file"] is not None:
            state["file"].close()
