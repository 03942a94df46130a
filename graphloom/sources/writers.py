"""Files that tasks write together: one text file from ordered rows, and a folder of notes.

Tasks write parts beside the target. The commit joins the parts of the tasks that ended well, in order of partition, and
moves the result to its place in one step; a failed job deletes its parts. So the target is there whole or not at all,
and rows never pass through the driver one by one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .listing import store

#: Bytes that the commit copies at a time.
COPY = 4 << 20


@dataclass
class _Part(WriterCommitMessage):
    partition: int
    name: str
    rows: int


class _OneFile(DataSourceWriter):
    def __init__(self, options):
        self.path, self.after = options["path"], options.get("after")
        self.head, self.tail, self.between = (options.get(k, "") for k in ("head", "tail", "between"))
        self.parts = f"{store(self.path)[1]}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> _Part:
        system, _ = store(self.path)
        system.create_dir(self.parts, recursive=True)
        context = TaskContext.get()
        part, n = _Part(context.partitionId(), f"{self.parts}/{context.partitionId()}-{uuid.uuid4().hex}", 0), 0
        with system.open_output_stream(part.name, compression=None) as f:
            for row in iterator:
                f.write(((self.between if n else "") + row[0]).encode())
                n += 1
        part.rows = n
        return part

    def commit(self, messages) -> None:
        system, path = store(self.path)
        system.create_dir(path.rpartition("/")[0] or "/", recursive=True)
        with system.open_output_stream(f"{self.parts}.whole", compression=None) as f:

            def copy(name: str) -> None:
                with system.open_input_stream(name, compression=None) as part:
                    while data := part.read(COPY):
                        f.write(data)

            if self.after:
                copy(store(self.after)[1])
            f.write(self.head.encode())
            first = True
            for part in sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition):
                if not first:
                    f.write(self.between.encode())
                copy(part.name)
                first = False
            f.write(self.tail.encode())
        system.move(f"{self.parts}.whole", path)
        self.abort(messages)

    def abort(self, messages) -> None:
        system, _ = store(self.path)
        if system.get_file_info(self.parts).type == fs.FileType.Directory:
            system.delete_dir(self.parts)


class OneFile(DataSource):
    """df of one text column .write.format("one_file").save(path): its rows in order of partition, `between` them, `head` before, `tail` behind.

    after: a file that comes before all. The file that was at path stays until the new one is whole.
    """

    @classmethod
    def name(cls) -> str:
        return "one_file"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _OneFile(self.options)


class _Notes(DataSourceWriter):
    def __init__(self, options):
        self.path, self.end = options["path"], options.get("end", ".md")
        self.fresh = f"{store(self.path)[1]}.writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> _Part:
        system, _ = store(self.path)
        system.create_dir(self.fresh, recursive=True)
        n = 0
        for row in iterator:
            whole = f"{self.fresh}/{row[0]}{self.end}"
            with system.open_output_stream(whole, compression=None) as f:
                f.write(row[1].encode())
            n += 1
        return _Part(TaskContext.get().partitionId(), "", n)

    def commit(self, messages) -> None:
        system, path = store(self.path)
        system.create_dir(self.fresh, recursive=True)
        if system.get_file_info(path).type == fs.FileType.Directory:
            system.delete_dir(path)
        system.move(self.fresh, path)

    def abort(self, messages) -> None:
        system, _ = store(self.path)
        if system.get_file_info(self.fresh).type == fs.FileType.Directory:
            system.delete_dir(self.fresh)


class Notes(DataSource):
    """df of (file, text) .write.format("notes").save(folder): a file for each row. The folder is replaced once all are written."""

    @classmethod
    def name(cls) -> str:
        return "notes"

    def schema(self) -> str:
        return "file string, text string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Notes(self.options)


def register(spark: SparkSession) -> None:
    for source in (OneFile, Notes):
        spark.dataSource.register(source)


def write_lines(df: DataFrame, line: Column, order: list[Column], path: str, head: str = "", tail: str = "", between: str = "\n", after: str | None = None) -> None:
    """One file of df's lines in this order; rows are sorted in ranges and written by tasks."""
    register(df.sparkSession)
    rows = df.select(line.alias("value"), *[c.alias(f"o{k}") for k, c in enumerate(order)]).orderBy(*[F.col(f"o{k}") for k in range(len(order))])
    w = rows.select("value").write.format("one_file").mode("append").option("head", head).option("tail", tail).option("between", between)
    (w.option("after", after) if after else w).save(path)


def write_notes(notes: DataFrame, folder: str, end: str = ".md") -> None:
    """A file in folder for each row (file, text), written by tasks; the folder's former files go."""
    register(notes.sparkSession)
    notes.select("file", "text").write.format("notes").mode("append").option("end", end).save(folder)


def delete(path: str) -> None:
    system, at = store(path)
    if system.get_file_info(at).is_file:
        system.delete_file(at)
