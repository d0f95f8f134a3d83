"""Byte streams for Python workers on local, HDFS or object-store folders."""

from __future__ import annotations

import os
from urllib.parse import urlparse


def _filesystem(uri: str):
    """(pyarrow file system or None for local files, path)."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return None, parts.path
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def open_input(uri: str):
    system, path = _filesystem(uri)
    return open(path, "rb") if system is None else system.open_input_file(path)


class Replacing:
    """Write a file under a name of this attempt and put it in place at the end,
    so that a retried or speculative task never leaves half a file."""

    def __init__(self, uri: str, attempt: str):
        self.uri, self.draft = uri, f"{uri}.{attempt}.tmp"

    def __enter__(self):
        system, path = _filesystem(self.draft)
        if system is None:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            self.stream = open(path, "wb")
        else:
            system.create_dir(os.path.dirname(path), recursive=True)
            self.stream = system.open_output_stream(path)
        return self.stream

    def __exit__(self, kind, value, trace):
        self.stream.close()
        system, draft = _filesystem(self.draft)
        path = _filesystem(self.uri)[1]
        if kind is not None:
            os.remove(draft) if system is None else system.delete_file(draft)
        elif system is None:
            os.replace(draft, path)
        else:
            system.move(draft, path)


def delete(uri: str) -> None:
    system, path = _filesystem(uri)
    if system is None:
        if os.path.exists(path):
            os.remove(path)
    else:
        system.delete_file(path)
