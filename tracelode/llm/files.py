"""Files that tasks write to and read from the shared folder, and how a retried task leaves no trace."""

from __future__ import annotations

import uuid
from typing import BinaryIO

import pyarrow.fs as pafs


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, gs, ...); a plain path is a local one."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def attempt_path(folder: str, suffix: str) -> str:
    """A name that no other attempt of any task uses: only files that a finished task reports are ever read."""
    return f"{folder}/{uuid.uuid4().hex}{suffix}"


def create(path: str) -> BinaryIO:
    system, name = _open(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    return system.open_output_stream(name, compression=None)  # the name of an archive must not choose for us


def reader(path: str) -> BinaryIO:
    system, name = _open(path)
    return system.open_input_file(name)
