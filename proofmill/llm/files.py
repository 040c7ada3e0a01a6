"""Files that tasks write to and read from the shared folder.

Paths are those that Spark is given: local and mounted folders, ``file``,
``hdfs`` and ``viewfs`` (with libhdfs), ``s3`` with its Hadoop names ``s3a`` and
``s3n``, ``gs``, ``abfs`` and ``abfss``, and ``dbfs`` by its mount. Any other
scheme is refused by name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it."""
    scheme, mark, rest = path.partition(":")
    if not mark or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "dbfs":
        return fs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    if scheme in ("s3a", "s3n"):
        path = "s3:" + rest
    try:
        return fs.FileSystem.from_uri(path)
    except pa.ArrowInvalid as e:
        raise ValueError(f"files in {scheme}: are not supported; let spark.checkpoint.dir name another store ({e})") from None


def write(path: str, data: bytes) -> None:
    store, at = store_of(path)
    with store.open_output_stream(at, compression=None) as out:  # the bytes as they are, whatever the name ends in
        out.write(data)


def read(path: str, start: int = 0, length: int | None = None) -> bytes:
    store, at = store_of(path)
    with store.open_input_file(at) as file:
        file.seek(start)
        return file.read() if length is None else file.read(length)


def blocks(path: str, size: int = 1 << 20) -> Iterator[bytes]:
    store, at = store_of(path)
    with store.open_input_stream(at, compression=None) as file:
        while block := file.read(size):
            yield block


def part_name(folder: str, part: int, seq: int, ending: str) -> str:
    """A name of this attempt alone: only files that a finished task reports are ever read."""
    return f"{folder}/part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}{ending}"


def table(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def column(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of the named columns, as Python values."""
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)
