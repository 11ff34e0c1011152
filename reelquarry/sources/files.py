"""What the sources share: one partition per file, whole files only in tasks, replaced files only when complete."""

from __future__ import annotations

import glob
import os
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql.datasource import DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage


def open_path(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in path:
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path.removeprefix("file:")


def list_files(path: str, suffixes: tuple[str, ...] = ()) -> list[str]:
    """Files of a path, folder (with its subfolders) or local glob."""
    if "://" not in path and any(c in path for c in "*?["):
        return sorted(p for p in glob.glob(path, recursive=True) if os.path.isfile(p))
    fs, place = open_path(path)
    info = fs.get_file_info(place)
    if info.type == pyarrow.fs.FileType.File:
        return [path]
    found = fs.get_file_info(pyarrow.fs.FileSelector(place, recursive=True, allow_not_found=True))
    scheme = path[: path.index(place)] if "://" in path and place in path else ""
    return sorted(scheme + f.path for f in found if f.type == pyarrow.fs.FileType.File and (not suffixes or f.path.lower().endswith(suffixes)))


def read(path: str, at: int = 0, size: int | None = None) -> bytes:
    fs, place = open_path(path)
    with fs.open_input_file(place) as f:
        f.seek(at)
        return f.read() if size is None else f.read(size)


def replace(path: str, content: bytes) -> None:
    """Writes under another name, then renames, so that a task that fails leaves no half file."""
    fs, place = open_path(path)
    fs.create_dir(os.path.dirname(place), recursive=True)
    other = f"{place}.{uuid.uuid4().hex}"
    with fs.open_output_stream(other) as f:
        f.write(content)
    fs.move(other, place)


@dataclass
class FilePartition(InputPartition):
    path: str

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class FileReader(DataSourceReader):
    """Reads rows(path) of each file; mode PERMISSIVE gives a row with `error` for a broken file, FAILFAST raises."""

    suffixes: tuple[str, ...] = ()

    def __init__(self, options: dict, schema):
        self.options, self.schema = options, schema

    def partitions(self) -> list[InputPartition]:
        return [FilePartition(p) for p in list_files(self.options["path"], self.suffixes)] or [FilePartition("")]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        if not partition.path:
            return
        names = self.schema.fieldNames()
        try:
            for r in self.rows(partition.path):  # rows leave as they are read; an error row follows what was sound
                yield tuple(r.get(n) for n in names)
        except (ValueError, IndexError) as e:
            if self.options.get("mode", "PERMISSIVE").upper() == "FAILFAST":
                raise
            row = {"path": partition.path, "error": str(e) or "broken file"}
            yield tuple(row.get(n) for n in names)

    def rows(self, path: str) -> Iterator[dict]:
        raise NotImplementedError


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has written under temporary names: (temporary, final) paths."""

    files: list[tuple[str, str]]


class FileWriter(DataSourceWriter):
    """Writes whole files: tasks write under temporary names, the commit renames them, and a job that fails leaves nothing.

    Rows of one file have to be in one partition; the commit fails if two tasks wrote the same file.
    """

    def __init__(self, options: dict, schema):
        self.options, self.names = options, schema.fieldNames()
        self.job = uuid.uuid4().hex

    def contents(self, rows: Iterator[dict]) -> Iterator[tuple[str, bytes]]:
        """(name, content) of each file of a task's rows."""
        raise NotImplementedError

    def write(self, rows: Iterator) -> Written:
        base, done = self.options["path"].rstrip("/"), []
        for name, content in self.contents(dict(zip(self.names, tuple(r), strict=True)) for r in rows):
            temporary = f"{base}/_{self.job}/{uuid.uuid4().hex}"
            replace(temporary, content)
            done.append((temporary, f"{base}/{name}"))
        return Written(done)

    def _clean(self) -> None:
        fs, place = open_path(f"{self.options['path'].rstrip('/')}/_{self.job}")
        if fs.get_file_info(place).type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(place)

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        twice = [name for name, n in Counter(final for _, final in files).items() if n > 1]
        if twice:
            self._clean()
            raise ValueError(f"rows of {twice[0]} came from more than one partition, or twice from one")
        for temporary, final in files:
            fs, source = open_path(temporary)
            target = open_path(final)[1]
            fs.create_dir(os.path.dirname(target), recursive=True)
            fs.move(source, target)
        self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()
