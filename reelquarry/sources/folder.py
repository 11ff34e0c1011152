"""A folder of files as a sink: entries of archives, textures, or whatever has a name and content."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource

from .files import FileReader, FileWriter, read

UNSAFE = re.compile(r"(^|[/\\\\])\.\.([/\\\\]|$)|^([/\\\\]|[A-Za-z]:)|\x00")


class FolderReader(FileReader):
    """One row per file. Option suffix: only files whose names end with it, in any case."""

    def __init__(self, options: dict, schema):
        super().__init__(options, schema)
        self.suffixes = (options["suffix"].lower(),) if options.get("suffix") else ()

    def rows(self, path: str) -> Iterator[dict]:
        content = read(path)
        yield {"path": path, "name": path.rpartition("/")[2], "size": len(content), "content": content}


class FolderWriter(FileWriter):
    """Writes (name, content) rows below the path, with the folders that the names ask for.

    A name that would leave the path fails the job, or is left out with the option unsafe=skip. Rows without content
    give empty files.
    """

    def contents(self, rows: Iterator[dict]) -> Iterator[tuple[str, bytes]]:
        for r in rows:
            name = r["name"]
            if not name or UNSAFE.search(name):
                if self.options.get("unsafe") == "skip":
                    continue
                raise ValueError(f"the name {name!r} is not inside the folder")
            yield name.replace("\\", "/"), bytes(r["content"] or b"")


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "assetfolder"

    def schema(self) -> str:
        return "path string, name string, size long, content binary, error string"

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> FolderWriter:
        return FolderWriter(self.options, schema)
