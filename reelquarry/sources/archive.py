"""Archives: a header, a directory of offsets, sizes and names, and payloads on 64-byte boundaries."""

from __future__ import annotations

import operator
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..functions.codecs import lz
from .files import FilePartition, FileReader, FileWriter, read

COMPARE = {"==": operator.eq, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
MAGIC, TRAILER, FLAGS, ALIGN = b"BIG4", b"L280", 0x15050000, 64


def directory(content: bytes) -> tuple[dict, list[dict]]:
    """Header and entries; every number is checked against the bytes that are there."""
    if len(content) < 16:
        raise ValueError("no header")
    magic, length = content[:4], int.from_bytes(content[4:8], "little")
    count, size = struct.unpack(">II", content[8:16])
    if magic[:3] != b"BIG" or size > len(content) or count * 9 > size:
        raise ValueError("no archive header")
    entries, at = [], 16
    for i in range(count):
        end = content.find(b"\0", at + 8, size)
        if end < 0:
            raise ValueError("the directory is cut off")
        offset, stored = struct.unpack(">II", content[at : at + 8])
        entries.append({"idx": i, "name": content[at + 8 : end].decode("utf-8", "replace"), "offset": offset, "size": stored})
        at = end + 1
    tail = content[size - 8 : size]
    known = tail[:1].isalpha() and tail[1:4].isdigit()
    version, flags = (int(tail[1:4]), int.from_bytes(tail[4:8], "big")) if known else (None, None)
    return {"magic": magic.decode("latin-1"), "length": length, "file_count": count, "header_size": size, "version": version, "flags": flags}, entries


def build(entries: list[tuple[str, bytes]], compressed: bool = False) -> bytes:
    names = [n.encode() for n, _ in entries]
    size = 24 + sum(9 + len(n) for n in names)
    place = lambda x: -(-x // ALIGN) * ALIGN
    at, table = place(size), bytearray()
    offsets = []
    for name, (_, payload) in zip(names, entries, strict=True):
        table += struct.pack(">II", at, len(payload)) + name + b"\0"
        offsets.append(at)
        at = place(at + len(payload))
    out = bytearray(at if entries else size)
    end = offsets[-1] + len(entries[-1][1]) if entries else size
    out[:16] = MAGIC + end.to_bytes(4, "little") + struct.pack(">II", len(entries), size)
    out[16 : 16 + len(table)] = table
    out[size - 8 : size] = TRAILER + (FLAGS | int(compressed)).to_bytes(4, "big")
    for offset, (_, payload) in zip(offsets, entries, strict=True):
        out[offset : offset + len(payload)] = payload
    return bytes(out[:end])


@dataclass
class EntryPartition(FilePartition):
    """A run of an archive's entries."""

    first: int
    last: int | None

    def __init__(self, path: str, first: int = 0, last: int | None = None):
        super().__init__(path)
        self.first, self.last = first, last


class ArchiveReader(FileReader):
    """Options: content=true reads payloads, unpack=true decompresses packed ones; index=i and name=n read one entry each.

    Filters on idx, name, size and path by equality or order are applied to the directory, so that only the entries
    that pass are read. With content, an archive's entries are dealt to partitions of about `partition` bytes (128 MB).
    """

    def __init__(self, options: dict, schema):
        super().__init__(options, schema)
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        kinds = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            column = getattr(f, "attribute", ())
            if type(f) in kinds and len(column) == 1 and column[0] in ("idx", "name", "size", "path"):
                self.tests.append((column[0], kinds[type(f)], f.value))
            else:
                yield f

    def _wanted(self, row: dict) -> bool:
        index, name = self.options.get("index"), self.options.get("name")
        if (index is not None and int(index) != row["idx"]) or (name is not None and name.lower() != row["name"].lower()):
            return False
        return all(COMPARE[op](row[c], v) for c, op, v in self.tests)

    def _directory(self, path: str) -> tuple[dict, list[dict]]:
        head = read(path, 0, 16)
        if len(head) < 16:
            raise ValueError("no header")
        return directory(read(path, 0, max(16, int.from_bytes(head[12:16], "big"))))

    def partitions(self) -> list[InputPartition]:
        found = super().partitions()
        if self.options.get("content", "").lower() != "true":
            return found
        out: list[InputPartition] = []
        most = int(self.options.get("partition", 128 << 20))
        for p in found:
            try:
                sizes = [e["size"] for e in self._directory(p.path)[1]] if p.path else []
            except ValueError:  # the task reports it
                sizes = []
            first = held = 0
            for i, n in enumerate(sizes):
                if held and held + n > most:
                    out.append(EntryPartition(p.path, first, i))
                    first, held = i, 0
                held += n
            out.append(EntryPartition(p.path, first))
        return out

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        self.run = (getattr(partition, "first", 0), getattr(partition, "last", None))
        return super().read(partition)

    def rows(self, path: str) -> Iterator[dict]:
        header, entries = self._directory(path)
        for e in entries[slice(*self.run)]:
            if not self._wanted({"path": path, **e}):
                continue
            start = read(path, e["offset"], 16) if e["size"] > 12 else b""
            packed = lz.is_packed(start[: e["size"]])
            row = {"path": path, **header, **e, "compressed": packed, "unpacked_size": lz.header(start)[0] if packed else e["size"]}
            if self.options.get("content", "").lower() == "true":
                raw = read(path, e["offset"], e["size"])
                if len(raw) < e["size"]:
                    raise ValueError(f"entry {e['name']} is cut off")
                row["content"] = lz.decode(raw) if packed and self.options.get("unpack", "true").lower() == "true" else raw
            yield row


class ArchiveWriter(FileWriter):
    """Writes (archive, name, content) rows: one file per archive of the task. Rows of an archive have to be in one partition, in order."""

    def contents(self, rows: Iterator[dict]) -> Iterator[tuple[str, bytes]]:
        held: dict[str, list] = {}
        limit = self.options.get("packthreshold")
        for r in rows:
            content = bytes(r["content"] or b"")
            ext = r["name"].lower().rpartition(".")[2]
            if limit is not None and ext not in ("cdata", "vp6", "snd", "imp"):
                packed = lz.encode(content)
                content = packed if len(packed) < len(content) - int(limit) else content
            held.setdefault(r["archive"], []).append((r["name"].lower(), content))
        for archive, entries in held.items():
            yield archive, build(entries, limit is not None)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "assetarchive"

    def schema(self) -> str:
        return (
            "path string, magic string, length long, file_count long, header_size long, version int, flags long, "
            "idx int, name string, offset long, size long, unpacked_size long, compressed boolean, content binary, error string"
        )

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options, schema)
