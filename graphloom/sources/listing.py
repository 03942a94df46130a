"""Listing folders without entering what is passed over, reading only what is left, and following a folder as a stream.

Folders are listed through Arrow's file systems, so a root may lie on a local disk or in any store that Arrow opens.
The driver lists the first levels; once there are FOLDERS folders to go, tasks list what is below them. A folder that
the rules pass over is never listed, and no file is opened before its name, size and place have been checked.
"""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# Directories that are passed over.
SKIPPED = ("venv", ".venv", "env", ".env", "node_modules", "__pycache__", ".git", "dist", "build", "target", "out", "bin", "obj", "site-packages", "lib64", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".eggs")
SKIPPED_ENDS = ("_venv", "_env", ".egg-info")
#: Folders that the driver lists before tasks go on; bytes of files that a task reads; files that a stream's task reads.
FOLDERS, TASK_BYTES, FILES = 256, 64 << 20, 64

_FILE = "file_path string, relative_path string, size_bytes long, modified long"


def passed_over(name: str) -> bool:
    """Whether a folder of this name isn't entered: hidden, or made by tools."""
    low = name.lower()
    return low.startswith(".") or low in SKIPPED or low.endswith(SKIPPED_ENDS)


def store(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a root, and its path there without a slash at the end."""
    if "://" in root and not root.startswith("file:"):
        found, path = fs.FileSystem.from_uri(root)
        return found, path.rstrip("/")
    return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", root).rstrip("/") or "/"


def entries(system: fs.FileSystem, folder: str) -> tuple[list[fs.FileInfo], list[str]]:
    """Files and folders to enter of one folder; hidden files, symbolic links and what is passed over are left out."""
    files, folders = [], []
    local = isinstance(system, fs.LocalFileSystem)
    for x in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if local and os.path.islink(x.path):
            continue
        if x.type == fs.FileType.Directory:
            if not passed_over(x.base_name):
                folders.append(x.path)
        elif x.type == fs.FileType.File and not x.base_name.startswith("."):
            files.append(x)
    return files, folders


def _row(x: fs.FileInfo, base: str) -> tuple[str, str, int, int]:
    return x.path, x.path[len(base.rstrip("/")) + 1 :], x.size, x.mtime_ns or 0


def walk(root: str, start: list[str] | None = None, until: int | None = None) -> tuple[list[tuple[str, str, int, int]], list[str]]:
    """(path, relative path, size, time of change) of files below start, and folders not entered yet once there are so many."""
    system, base = store(root)
    rows, todo = [], [base] if start is None else list(start)
    while todo and (until is None or len(todo) < until):
        files, folders = entries(system, todo.pop(0))
        rows += [_row(x, base) for x in files]
        todo += folders
    return rows, todo


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, relative_path, size_bytes, modified) of the files below root that may be read; no file is opened."""
    system, base = store(root)
    if system.get_file_info(base).type != fs.FileType.Directory:
        raise FileNotFoundError(f"Root path not found: {root}")
    rows, todo = walk(root, until=FOLDERS)
    near = spark.createDataFrame(rows, _FILE)
    if not todo:
        return near

    def below(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                found = walk(root, [folder])[0]
                cols = list(zip(*found, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file_path", "relative_path", "size_bytes", "modified"])

    far = spark.createDataFrame([(x,) for x in todo], "folder string").repartition(len(todo)).mapInArrow(below, _FILE)
    return near.unionByName(far)


def with_content(files: DataFrame, root: str) -> DataFrame:
    """files with the column content, read by tasks of about TASK_BYTES; a file that is gone by then has none."""
    schema = files.schema.add("content", "binary")

    def read(batches: Iterator[pa.RecordBatch]):
        system, _ = store(root)
        for batch in batches:
            paths = batch.column("file_path").to_pylist()
            for i, path in enumerate(paths):
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([content(system, path)], pa.binary())], names=[*batch.schema.names, "content"])

    total = files.agg(F.sum("size_bytes")).first()[0] or 0
    return files.repartition(max(1, -(-total // TASK_BYTES)), "file_path").mapInArrow(read, schema)


def content(system: fs.FileSystem, path: str) -> bytes | None:
    try:
        with system.open_input_stream(path, compression=None) as f:
            return f.read()
    except FileNotFoundError:
        return None


# A folder as a stream of changes


def differences(old: dict[str, list[int]], new: dict[str, list[int]]) -> list[tuple[str, str, str | None]]:
    """(kind, path, former path) between two listings {path: [size, time of change]}, in order of path.

    A new file whose size and time equal those of one that is gone, and of no other that is gone or new, is that file
    renamed, without a look inside; its former path is deleted all the same.
    """
    gone = {p: tuple(x) for p, x in old.items() if p not in new}
    fresh = {p: tuple(x) for p, x in new.items() if p not in old}
    places: dict[tuple, tuple[list[str], list[str]]] = {}
    for k, side in enumerate((gone, fresh)):
        for p, x in side.items():
            places.setdefault(x, ([], []))[k].append(p)
    moved = {b[0]: a[0] for a, b in places.values() if len(a) == 1 and len(b) == 1}
    out = [("changed", p, None) for p, x in new.items() if p in old and list(old[p]) != list(x)]
    out += [("renamed", p, moved[p]) if p in moved else ("created", p, None) for p in fresh]
    out += [("deleted", p, None) for p in gone]
    return sorted(out, key=lambda x: (x[1], x[0]))


class _Files(InputPartition):
    def __init__(self, rows):
        self.rows = rows


class _Changes(DataSourceStreamReader):
    """Offsets name listings, which lie as JSON in the state folder; an offset's listing is never written anew."""

    def __init__(self, options):
        self.root, self.state = options["path"].rstrip("/"), options["state"].rstrip("/")
        self.extensions = tuple(x for x in options.get("extensions", "").split(",") if x)
        self.most = int(options.get("maxbytes", 1 << 20))
        self.every = float(options.get("every", 0))
        self.looked = 0.0

    def _at(self, number: int) -> tuple[fs.FileSystem, str]:
        system, folder = store(self.state)
        system.create_dir(folder, recursive=True)
        return system, f"{folder}/listing-{number}.json"

    def _load(self, number: int) -> dict[str, list[int]]:
        if number == 0:
            return {}
        system, path = self._at(number)
        with system.open_input_stream(path) as f:
            return json.loads(f.read())

    def _last(self) -> int:
        system, path = self._at(0)
        names = [x.base_name for x in system.get_file_info(fs.FileSelector(os.path.dirname(path)))]
        return max([int(m[1]) for x in names if (m := re.fullmatch(r"listing-(\d+)\.json", x))], default=0)

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        """The last listing, or a new one where anything differs."""
        last = self._last()
        if time.monotonic() - self.looked < self.every:
            return {"listing": last}
        self.looked = time.monotonic()
        rows, _ = walk(self.root)
        now = {rel: [size, at] for _, rel, size, at in rows if size <= self.most and (not self.extensions or rel.lower().endswith(self.extensions))}
        if now == self._load(last):
            return {"listing": last}
        system, path = self._at(last + 1)
        with system.open_output_stream(f"{path}.part") as f:
            f.write(json.dumps(now).encode())
        system.move(f"{path}.part", path)
        return {"listing": last + 1}

    def partitions(self, start: dict, end: dict):
        rows = differences(self._load(start["listing"]), self._load(end["listing"]))
        now = time.time_ns() // 1000
        parts = [_Files([(kind, p, old, now) for kind, p, old in rows[i : i + FILES]]) for i in range(0, len(rows), FILES)]
        return parts or [_Files([])]

    def read(self, partition):
        import datetime

        system, base = store(self.root)
        for kind, path, old, at in partition.rows:
            ts = datetime.datetime.fromtimestamp(at / 1e6, datetime.timezone.utc)
            data = None if kind == "deleted" else content(system, f"{base}/{path}")
            yield path, kind, old, None if data is None else data.decode("utf-8", "replace"), ts

    def commit(self, end: dict) -> None:
        """Listings before the one that was read up to are needed no more."""
        system, path = self._at(0)
        for x in system.get_file_info(fs.FileSelector(os.path.dirname(path))):
            if (m := re.fullmatch(r"listing-(\d+)\.json", x.base_name)) and int(m[1]) < end["listing"]:
                system.delete_file(x.path)


class FolderChanges(DataSource):
    """spark.readStream.format("folder_changes").option("path", folder).option("state", folder): what changes below a folder.

    Rows are (path, kind, former, content, ts): created, changed, renamed (with the former path, which also is
    deleted) and deleted files. The first batch has every file as created. Files are told apart by path, size and
    time of change alone; content is read for created, changed and renamed ones, by the tasks. Options: extensions
    (ends of names, with commas), maxBytes, every (seconds between two listings at least).
    """

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return "path string, kind string, former string, content string, ts timestamp"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Changes(self.options)


def folder_changes(spark: SparkSession, folder: str, state: str, extensions: tuple[str, ...] = (), every: float = 0) -> DataFrame:
    """The stream of changes below folder; state: a shared folder for its listings, one for each stream."""
    spark.dataSource.register(FolderChanges)
    r = spark.readStream.format("folder_changes").option("path", folder).option("state", state).option("every", str(every))
    return r.option("extensions", ",".join(e.lower() for e in extensions)).load()
