"""Whole files and byte ranges in the shared folder, from Python workers, for any scheme that pyarrow knows."""

from __future__ import annotations

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_bytes(uri: str, data: bytes) -> None:
    """Write a file under a name that no reader knows yet, creating its folder."""
    system, path = _at(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path) as out:
        out.write(data)


def open_output(uri: str):
    system, path = _at(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path)


def read_bytes(uri: str) -> bytes:
    system, path = _at(uri)
    with system.open_input_file(path) as f:
        return f.read()


def open_input(uri: str):
    """An open file with ``read_at(length, offset)``."""
    system, path = _at(uri)
    return system.open_input_file(path)
