"""Chunked sound streams: a header chunk of sparse tags, a count, data chunks, and an end marker."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.codecs import adpcm
from .files import FilePartition, FileReader, FileWriter, list_files, read

#: Tags of a stream's sound.
TAGS = {0x80: "version", 0x82: "channels", 0x84: "sample_rate", 0x85: "n_frames", 0xA0: "encoding"}
#: Bytes before the XA blocks of a channel in a data chunk.
LEAD = bytes(4)


def tags(data: bytes) -> dict[int, int | bytes]:
    """Sparse tags up to the end marker 255; 252 and 253 are skipped, blobs of 255 bytes or more carry a 32-bit size."""
    out: dict[int, int | bytes] = {}
    at = 0
    while at < len(data) and data[at] != 255:
        tag = data[at]
        at += 1
        if tag in (252, 253, 254):
            continue
        size = data[at]
        at += 1
        if size == 255:
            size = int.from_bytes(data[at : at + 4], "big")
            at += 4
        if at + size > len(data):
            raise ValueError("a tag is cut off")
        raw = data[at : at + size]
        out[tag] = int.from_bytes(raw, "big", signed=True) if size <= 4 else raw
        at += size
    return out


def tag_bytes(values: dict[int, int]) -> bytes:
    out = bytearray()
    for tag, value in values.items():
        size = next(n for n in (1, 2, 3, 4) if -(1 << (8 * n - 1)) <= value < 1 << (8 * n - 1)) if value else 0
        out += bytes([tag, size]) + (value.to_bytes(size, "big", signed=True) if size else b"")
    return bytes(out) + b"\xff"


def walk(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    while at + 8 <= len(content):
        size = int.from_bytes(content[at + 4 : at + 8], "little")
        if size < 8 or at + size > len(content):
            raise ValueError("a chunk is cut off")
        yield content[at : at + 4], content[at + 8 : at + size]
        at += size


def _chunk(name: bytes, payload: bytes) -> bytes:
    payload += b"\0" * (-len(payload) % 4)
    return name + (len(payload) + 8).to_bytes(4, "little") + payload


def _coded(samples: np.ndarray, encoding: int) -> bytes:
    if encoding == 10:
        return LEAD + adpcm.xa_encode(samples.tolist())
    if encoding == 29:
        return adpcm.xas_encode(samples.tolist())
    if encoding == 0:
        return samples.astype(">i2").tobytes()
    raise ValueError(f"encoding {encoding} isn't supported")


def build(samples: np.ndarray, rate: int, frames: int, encoding: int = 0) -> bytes:
    """A stream of (frames, channels): encoding 10 is XA, with four bytes before each channel's blocks, 0 is big-endian PCM, 29 is XAS."""
    n, channels = samples.shape
    body = b"GSTR" + tag_bytes({0x80: 1, 0x82: channels, 0x84: rate, 0x85: n, 0xA0: encoding})
    parts = [samples[i : i + frames] for i in range(0, n, frames)]
    out = _chunk(b"SCHl", body) + _chunk(b"SCCl", struct.pack(">I", len(parts)))
    for p in parts:
        coded = [_coded(p[:, c], encoding) for c in range(channels)]
        starts = np.cumsum([0, *map(len, coded[:-1])])
        out += _chunk(b"SCDl", struct.pack(f">I{channels}I", len(p), *starts.tolist()) + b"".join(coded))
    return out + _chunk(b"SCEl", b"")


def parse(content: bytes) -> Iterator[dict]:
    """One dict per channel of each data chunk."""
    meta: dict = {}
    seq, start = 0, 0
    for name, payload in walk(content):
        if name == b"SCHl":
            if payload[:4] != b"GSTR":
                raise ValueError("no sound header")
            found = tags(payload[4:])
            meta = {"version": 0, "channels": 1, "sample_rate": 22050, "n_frames": 0, "encoding": 0}
            meta |= {TAGS[t]: v for t, v in found.items() if t in TAGS and isinstance(v, int)}
            if not 1 <= meta["channels"] <= 64:
                raise ValueError("no such number of channels")
        elif name == b"SCDl":
            if not meta:
                raise ValueError("data before the header")
            n, *offsets = struct.unpack_from(f">I{meta['channels']}I", payload)
            data = payload[4 + 4 * meta["channels"] :]
            for c, offset in enumerate(offsets):
                if meta["encoding"] == 29:
                    size = -(-n // 128) * 76
                    samples = adpcm.xas_decode(data[offset : offset + size])[:n]
                elif meta["encoding"] == 10:
                    samples = adpcm.xa_decode(data[offset + len(LEAD) :], count=n)[0][:n]
                elif meta["encoding"] == 0:
                    samples = np.frombuffer(data, ">i2", n, offset).tolist()
                else:
                    raise ValueError(f"encoding {meta['encoding']} isn't supported")
                yield {**meta, "seq": seq, "start": start, "channel": c, "samples": samples}
            seq, start = seq + 1, start + n
        elif name == b"SCEl":
            return
    raise ValueError("no end marker")


class ChunkStreamReader(FileReader):
    def rows(self, path: str) -> Iterator[dict]:
        for r in parse(read(path)):
            yield {"path": path, **r}


class ChunkStreamArrivals(DataSourceStreamReader):
    """Files as they arrive in a folder, in the order of their names: each micro-batch takes the new ones, whole, up to their end markers."""

    def __init__(self, options: dict, schema):
        self.reader, self.path = ChunkStreamReader(options, schema), options["path"]

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        found = list_files(self.path)
        return {"after": found[-1] if found else ""}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [FilePartition(p) for p in list_files(self.path) if start["after"] < p <= end["after"]]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        return self.reader.read(partition)

    def commit(self, end: dict) -> None:
        pass


class ChunkStreamWriter(FileWriter):
    """Writes blocks (name, sample_rate, channel, blk, samples): the rows of a file have to be in one partition. Options: encoding, frames of a chunk."""

    def contents(self, rows: Iterator[dict]) -> Iterator[tuple[str, bytes]]:
        for name, (rate, samples) in gather(rows).items():
            yield name, build(samples, rate, int(self.options.get("frames", 1024)), int(self.options.get("encoding", 0)))


def gather(rows: Iterator[dict]) -> dict[str, tuple[int, np.ndarray]]:
    """Sample rate and samples (frames, channels) of each file of a task's rows."""
    held: dict[str, dict] = {}
    rates: dict[str, int] = {}
    for r in rows:
        rates[r["name"]] = r["sample_rate"]
        held.setdefault(r["name"], {})[(r["channel"], r["blk"])] = r["samples"]
    out = {}
    for name, parts in held.items():
        channels = 1 + max(c for c, _ in parts)
        joined = [np.concatenate([np.array(parts[k], np.int64) for k in sorted(parts) if k[0] == c]) for c in range(channels)]
        out[name] = (rates[name], np.stack(joined, axis=1))
    return out


class ChunkStreamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "assetstream"

    def schema(self) -> str:
        return "path string, version int, channels int, sample_rate int, n_frames long, encoding int, seq int, start long, channel int, samples array<int>, error string"

    def reader(self, schema) -> ChunkStreamReader:
        return ChunkStreamReader(self.options, schema)

    def streamReader(self, schema) -> ChunkStreamArrivals:
        return ChunkStreamArrivals(self.options, schema)

    def writer(self, schema, overwrite: bool) -> ChunkStreamWriter:
        return ChunkStreamWriter(self.options, schema)
