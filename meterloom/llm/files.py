"""Files that executors write to and read from the shared folder."""
from __future__ import annotations

import os
from collections.abc import Iterable
from urllib.parse import urlparse

from pyarrow import fs
from pyspark import TaskContext


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that all executors share, and the path in it."""
    where = urlparse(uri)
    return (fs.LocalFileSystem(), where.path) if where.scheme in ("", "file") else fs.FileSystem.from_uri(uri)


def put(uri: str, parts: Iterable[bytes]) -> int:
    """Write under another name, then rename: a file is whole or isn't there, and a task that runs again replaces it."""
    place, path = store(uri)
    place.create_dir(os.path.dirname(path), recursive=True)
    task = TaskContext.get()
    own = f"{path}.{task.taskAttemptId() if task else 0}.part"
    size = 0
    with place.open_output_stream(own) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    place.move(own, path)
    return size
