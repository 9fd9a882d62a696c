"""Whole files in the shared folder, written and range-read by tasks.

A file appears under its final name only when it is complete, so a task that is run again, or twice at
once, leaves one whole file.  Paths are URIs that pyarrow's file systems open (file://, hdfs://, s3://).
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@contextmanager
def new_file(uri: str) -> Iterator:
    """A sink; moved to ``uri`` at the end, and removed if the block fails."""
    store, path = opened(uri)
    store.create_dir(posixpath.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with store.open_output_stream(part) as sink:
            yield sink
        if store.get_file_info(path).type == fs.FileType.File:
            store.delete_file(path)
        store.move(part, path)
    except BaseException:
        if store.get_file_info(part).type == fs.FileType.File:
            store.delete_file(part)
        raise


def read_all(uri: str) -> bytes:
    store, path = opened(uri)
    with store.open_input_file(path) as f:
        return f.read()


class Ranges:
    """Range reads of one file."""

    def __init__(self, uri: str):
        store, path = opened(uri)
        self._file = store.open_input_file(path)

    def read(self, offset: int, length: int) -> bytes:
        return self._file.read_at(length, offset)

    def size(self) -> int:
        return self._file.size()

    def close(self) -> None:
        self._file.close()
