"""Files in the folder that executors share, by its own file system."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def normal(path: str) -> str:
    """``file:/x`` and ``/x`` as ``file:///x``; other schemes as they are."""
    if path.startswith("file:"):
        path = path[5:]
    return "file:///" + path.lstrip("/") if path.startswith("/") else path


class Whole:
    """A file that appears under its name once it is complete; a repeated task replaces it by the same bytes."""

    def __init__(self, uri: str):
        self.system, self.path = opened(normal(uri))
        self.part = f"{self.path}.{uuid.uuid4().hex}.tmp"

    def __enter__(self):
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.sink = self.system.open_output_stream(self.part)
        return self.sink

    def __exit__(self, kind, *_):
        self.sink.close()
        if kind is None:
            self.system.move(self.part, self.path)
        else:
            self.system.delete_file(self.part)


def reader(uri: str):
    system, path = opened(normal(uri))
    return system.open_input_file(path)
