"""Files of an operator's own format in the shared folder, written and read by tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; ``file:/x`` and ``/x`` are local or mounted folders."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def write_file(path: str, *pieces: bytes) -> None:
    """Write under a hidden name, then move into place, so that a task may run twice."""
    system, name = opened(path)
    folder, _, last = name.rpartition("/")
    system.create_dir(folder, recursive=True)
    part = f"{folder}/.{last}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        for piece in pieces:
            out.write(piece)
    system.move(part, name)


def read_file(path: str) -> bytes:
    system, name = opened(path)
    with system.open_input_stream(name) as f:
        return f.read()


def listed(spark: SparkSession, path: str, ending: str) -> DataFrame | None:
    """``path`` of each file in a folder, dealt to tasks by size; None where there is none."""
    system, name = opened(path)
    found = system.get_file_info(fs.FileSelector(name, allow_not_found=True))
    if not any(f.path.endswith(ending) for f in found):
        return None
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{ending}").load(path).select("path")
