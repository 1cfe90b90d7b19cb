"""A Spark data source that writes one text file per note: ``<path>/<label>/<id>.txt``.

Tasks write each file under a temporary name and move it to its place, so a reader never meets half a
file and a repeated task replaces its own files by equal ones. Each task lists what it wrote below
``<path>/_written-<job>``: a failed job deletes the listed files, a finished one the lists, and leaves
``_SUCCESS``. A null or empty text is written as one line feed, because Spark's readers pass over files
without a byte. Paths are those of ``pyarrow.fs``: a shared mount, ``hdfs://``, ``s3://`` or ``gs://``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import Row
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "note_files"
SCHEMA = "label string, doc_id string, text string"
# What may stand in a file or folder name; hidden names would not be read back.
NAME = re.compile(r"[^\W_.][\w.-]*", re.ASCII)


def located(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path below it; a path without a scheme, or with ``file:``, is a local or mounted one."""
    plain = re.sub(r"^file:/+", "/", path)
    if "://" in plain:
        return arrow_fs.FileSystem.from_uri(plain)
    return arrow_fs.LocalFileSystem(), plain.rstrip("/")


def checked(name: object) -> str:
    if not isinstance(name, str) or not NAME.fullmatch(name):
        raise ValueError(f"{name!r} cannot be a file name")
    return name


@dataclass
class Written(WriterCommitMessage):
    files: int


class NoteFilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path = path
        self.lists = f"_written-{uuid.uuid4().hex}"
        if overwrite:
            fs, root = located(path)
            if fs.get_file_info(root).type == arrow_fs.FileType.Directory:
                fs.delete_dir_contents(root)

    def write(self, rows: Iterator[Row]) -> Written:
        fs, root = located(self.path)
        fs.create_dir(f"{root}/{self.lists}", recursive=True)
        task = TaskContext.get()
        made: set[str] = set()
        count = 0
        # The list is complete up to the file being written: a name is added before the file appears.
        with fs.open_output_stream(f"{root}/{self.lists}/{task.partitionId()}-{task.taskAttemptId()}") as listed:
            for row in rows:
                label, name = checked(row["label"]), checked(row["doc_id"])
                if label not in made:
                    fs.create_dir(f"{root}/{label}", recursive=True)
                    made.add(label)
                place = f"{label}/{name}.txt"
                listed.write(f"{place}\n".encode())
                hidden = f"{root}/{label}/.{name}-{task.taskAttemptId()}"
                with fs.open_output_stream(hidden) as file:
                    file.write((row["text"] or "\n").encode())
                fs.move(hidden, f"{root}/{place}")
                count += 1
        return Written(count)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = located(self.path)
        fs.create_dir(f"{root}/{self.lists}", recursive=True)
        fs.delete_dir(f"{root}/{self.lists}")
        with fs.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = located(self.path)
        folder = f"{root}/{self.lists}"
        if fs.get_file_info(folder).type != arrow_fs.FileType.Directory:
            return
        for info in fs.get_file_info(arrow_fs.FileSelector(folder)):
            with fs.open_input_stream(info.path) as listed:
                for place in listed.read().decode().splitlines():
                    if fs.get_file_info(f"{root}/{place}").type == arrow_fs.FileType.File:
                        fs.delete_file(f"{root}/{place}")
        fs.delete_dir(folder)


class NoteFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: T.StructType, overwrite: bool) -> NoteFilesWriter:
        return NoteFilesWriter(self.options["path"], overwrite)
