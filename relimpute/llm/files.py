"""Arrays as files in the shared folder, mapped into memory where it is a mounted one."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

import numpy as np


def local(uri: str) -> str | None:
    """The path of a file on a mounted file system; None for any other store."""
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def write_array(uri: str, values: np.ndarray) -> None:
    """Write in one step: a task that runs twice leaves the same file, never a part of it."""
    if path := local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as out:
            out.write(np.ascontiguousarray(values).tobytes())
        os.replace(part, path)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(os.path.dirname(path), recursive=True)
        with store.open_output_stream(path) as out:
            out.write(np.ascontiguousarray(values).tobytes())


def read_array(uri: str, dtype) -> np.ndarray:
    """The array, mapped and not loaded if the store is mounted; empty if it has no values."""
    if path := local(uri):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as source:
        return np.frombuffer(source.read(), dtype)
