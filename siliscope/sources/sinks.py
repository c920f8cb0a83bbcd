"""Binary files as a Spark sink: one file per row, placed by the task that writes it.

Registered as a Python data source, so a job writes with ``df.write.format("binary_files")`` and the tasks' commits are
Spark's. A task writes below ``_temporary`` first and moves its files into place when it has written all of them; a task that runs
again moves the same bytes to the same places. The driver only learns how many files there are. Files go to the file system of the
folder's address (local or mounted, HDFS, S3, GCS), as pyarrow opens it.
"""
from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "binary_files"
ASIDE = "_temporary"


@dataclass
class Written(WriterCommitMessage):
    files: int


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of an address; a path without scheme is local."""
    if ":/" in folder and not folder.startswith("/"):
        scheme, rest = folder.split(":", 1)
        return fs.FileSystem.from_uri(f"file:///{rest.lstrip('/')}" if scheme == "file" else folder)
    return fs.LocalFileSystem(), folder


class BinaryFiles(DataSource):
    """Writes (path, content) rows as files below ``path``; the column ``path`` is relative to it."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = opened(self.folder)
        aside, places = posixpath.join(root, ASIDE, uuid.uuid4().hex), []
        for batch in iterator:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                if path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"path leaves the folder: {path}")
                held = posixpath.join(aside, str(len(places)))
                system.create_dir(aside, recursive=True)
                with system.open_output_stream(held) as out:
                    out.write(content.as_buffer())
                places.append((held, posixpath.join(root, path)))
        for parent in sorted({posixpath.dirname(place) for _, place in places}):
            system.create_dir(parent, recursive=True)
        for held, place in places:
            system.move(held, place)
        return Written(len(places))

    def _clear(self) -> None:
        system, root = opened(self.folder)
        if system.get_file_info(posixpath.join(root, ASIDE)).type == fs.FileType.Directory:
            system.delete_dir(posixpath.join(root, ASIDE))

    def commit(self, messages) -> None:
        self._clear()

    def abort(self, messages) -> None:
        self._clear()


def write_files(files: DataFrame, folder: str) -> None:
    """Write (path, content) rows as files below a folder that driver and executors share. Paths should be unique."""
    files.sparkSession.dataSource.register(BinaryFiles)
    files.select("path", "content").write.format(FORMAT).mode("append").save(folder)
