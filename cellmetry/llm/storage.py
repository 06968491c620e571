"""Files that Python tasks write to and read from a folder that all executors share."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a folder or file given as a path or URI."""
    return fs.FileSystem.from_uri(path)


class Output:
    """A file under a name of its own attempt; whoever commits the task lists the name.

    A lost or repeated task leaves at most an unlisted file behind and never touches
    one that is listed.
    """

    def __init__(self, folder: str, stem: str, suffix: str) -> None:
        store, at = open_store(folder)
        store.create_dir(at, recursive=True)
        name = f"{stem}-{uuid.uuid4().hex}{suffix}"
        self.path = f"{folder.rstrip('/')}/{name}"
        self.stream = store.open_output_stream(f"{at.rstrip('/')}/{name}", compression=None)


def open_input(path: str) -> pa.NativeFile:
    """A memory map of a local file, else a random-access file of its store."""
    store, at = open_store(path)
    if isinstance(store, fs.LocalFileSystem):
        return pa.memory_map(at)
    return store.open_input_file(at)
