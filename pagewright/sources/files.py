"""A data source that writes a file for each row, all of them or none.

    spark.dataSource.register(FileSet)
    reports.select("name", "content").write.format("file_set").mode("append").save("s3://bucket/reports")

A task writes its rows to a folder of its own under `_staged`; only when all tasks have ended are the folders moved to their
places, one move a task. What a failed task or a failed job has written is deleted. Tasks that are run twice, as after the
loss of an executor, write to different folders, of which one is moved. The files of task n of a save are in
`part-<save>-<n>`, so that names need only differ within a task. Paths are those of Arrow's file systems.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    place: str


class FileSet(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_set"

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a file set is only added to: use mode('append')")
        if [f.name for f in schema.fields] != ["name", "content"]:
            raise ValueError("a file set has the columns name and content")
        return FileSetWriter(self.options["path"])


class FileSetWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.save = path, uuid.uuid4().hex

    def root(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("/") else posixpath.abspath(self.path))

    def write(self, iterator: Iterator[Row]) -> Staged:
        from pyspark import TaskContext

        files, base = self.root()
        task = TaskContext.get().partitionId()
        folder = posixpath.join(base, "_staged", self.save, uuid.uuid4().hex)
        files.create_dir(folder, recursive=True)
        try:
            for row in iterator:
                if row["name"] is None or posixpath.basename(row["name"]) != row["name"] or row["name"] in ("", ".", ".."):
                    raise ValueError(f"no name for a file: {row['name']!r}")
                with files.open_output_stream(posixpath.join(folder, row["name"])) as out:
                    out.write((row["content"] or "").encode())
        except BaseException:
            files.delete_dir(folder)
            raise
        return Staged(folder, posixpath.join(base, f"part-{self.save}-{task:05d}"))

    def commit(self, messages: list[Staged | None]) -> None:
        files, base = self.root()
        for m in messages:
            if m is not None:
                files.move(m.folder, m.place)
        self.tidy(files, base)

    def abort(self, messages: list[Staged | None]) -> None:
        self.tidy(*self.root())

    def tidy(self, files, base: str) -> None:
        from pyarrow.fs import FileSelector, FileType

        own = posixpath.join(base, "_staged", self.save)
        if files.get_file_info(own).type == FileType.Directory:
            files.delete_dir(own)
        staged = posixpath.join(base, "_staged")
        if files.get_file_info(staged).type == FileType.Directory and not files.get_file_info(FileSelector(staged)):
            files.delete_dir(staged)
