"""Files in the shared folder, opened by its URI from Python on the driver and in workers."""

from __future__ import annotations

import uuid

from pyarrow import fs


def locate(uri: str):
    """(file system, path) of a URI or a plain path."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_whole(uri: str, data: bytes) -> None:
    """Write a file so that it is either absent or whole, however often a task is tried."""
    system, path = locate(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(data)
    system.move(own, path)


def read_whole(uri: str) -> bytes:
    system, path = locate(uri)
    with system.open_input_file(path) as f:
        return f.read()
