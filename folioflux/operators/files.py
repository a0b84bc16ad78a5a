"""Whole files in the shared folder, written and read by tasks."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse


def _local(uri: str) -> str | None:
    at = urlparse(uri)
    return at.path if at.scheme in ("", "file") else None


def write_file(uri: str, data: bytes) -> None:
    """Write a whole file; a repeated attempt writes it again, and readers never see a part of it."""
    path = _local(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, path)


def read_file(uri: str) -> bytes | None:
    """The file's bytes; None if there is none."""
    path = _local(uri)
    if path is not None:
        if not os.path.exists(path):
            return None
        with open(path, "rb") as f:
            return f.read()
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(path) as f:
        return f.read()
