"""Files that tasks write: one attempt's file never shows under another's name.

A file is written beside its place under a name of its own and then moved there, so readers see whole files only, and a
repeated task writes the same file again.
"""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def put(folder: str, name: str, data: bytes) -> None:
    """Write a file below a folder that all executors share."""
    fs, base = pafs.FileSystem.from_uri(folder)
    part = f"{base}/_{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(data)
    if fs.get_file_info(f"{base}/{name}").type != pafs.FileType.NotFound:  # not every file system moves over a file
        fs.delete_file(f"{base}/{name}")
    fs.move(part, f"{base}/{name}")


def make(folder: str) -> None:
    """Create a folder, with those above it."""
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
