"""Whole files written and ranges read by tasks, on any file system that pyarrow knows by URI."""

from __future__ import annotations

from pyarrow import fs
from pyspark import TaskContext


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a bare path is local."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_file(uri: str, parts: list[bytes]) -> None:
    system, path = locate(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as out:
        for part in parts:
            out.write(part)


def read_range(uri: str, offset: int, length: int) -> bytes:
    system, path = locate(uri)
    with system.open_input_file(path) as file:
        return file.read_at(length, offset)


def attempt_name() -> str:
    """A name no other task attempt has. Files of attempts that failed are in no manifest and never read."""
    task = TaskContext.get()
    return f"part-{task.partitionId():06d}-{task.stageId()}-{task.taskAttemptId()}"
