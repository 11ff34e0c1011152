"""RIFF/WAVE: one row per channel and block of frames, with the file's metadata; content=false gives one row of metadata."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource

from .chunks import gather
from .files import FileReader, FileWriter, read

#: Format tags of plain and extensible PCM, and speaker masks by number of channels.
TAGS, MASKS = (1, 65534), {4: 0x33, 6: 0x3F, 8: 0xFF}
SUBFORMAT = bytes.fromhex("0100000000001000800000aa00389b71")
BLOCK = 4096


def chunks(content: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(id, offset, size) of each chunk. A data chunk of size 0 is passed over."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE header")
    at = 12
    while at + 8 <= len(content):
        name, size = content[at : at + 4], int.from_bytes(content[at + 4 : at + 8], "little")
        if name != b"data" or size:
            yield name, at + 8, min(size, len(content) - at - 8)
        at += 8 + size + size % 2


def parse(content: bytes) -> tuple[dict, np.ndarray]:
    """Metadata and samples (frames, channels) as 16-bit integers; 24-bit samples keep their upper 16 bits."""
    found: dict[bytes, tuple[int, int]] = {}
    for name, at, size in chunks(content):
        found.setdefault(name, (at, size))
    if b"fmt " not in found or b"data" not in found or found[b"fmt "][1] < 16:
        raise ValueError("no fmt or data chunk")
    tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", content, found[b"fmt "][0])
    if tag not in TAGS or bits not in (8, 16, 24) or not channels:
        raise ValueError(f"format {tag} with {bits} bits isn't supported")
    at, size = found[b"data"]
    n = size // (channels * bits // 8)
    raw = np.frombuffer(content, np.uint8, n * channels * bits // 8, at)
    if bits == 8:
        samples = (raw.astype(np.int16) - 128) * 256
    elif bits == 16:
        samples = raw.view("<i2")
    else:
        samples = raw.reshape(-1, 3)[:, 1:].copy().view("<i2").reshape(-1)
    loop = (None, None)
    if b"smpl" in found and found[b"smpl"][1] >= 60:
        words = struct.unpack_from("<15I", content, found[b"smpl"][0])
        loop = (words[11], words[12]) if words[7] else loop
    return {"channels": channels, "sample_rate": rate, "bits": bits, "n_frames": n, "loop_start": loop[0], "loop_end": loop[1]}, samples.reshape(n, channels).astype(np.int16)


def build(samples: np.ndarray, rate: int, loop: tuple[int, int] | None = None, bits: int = 16) -> bytes:
    """A WAVE file of (frames, channels); more than two channels are written as extensible."""
    n, channels = samples.shape
    step = channels * bits // 8
    head = struct.pack("<HHIIHH", 65534 if channels > 2 else 1, channels, rate, rate * step, step, bits)
    if channels > 2:
        head += struct.pack("<HHI", 22, bits, MASKS.get(channels, (1 << channels) - 1)) + SUBFORMAT
    data = ((samples.astype(np.int32) >> 8) + 128).astype(np.uint8).tobytes() if bits == 8 else samples.astype("<i2").tobytes()
    body = b"WAVE" + b"fmt " + len(head).to_bytes(4, "little") + head
    if loop:
        body += b"smpl" + struct.pack("<I9I6I", 60, 0, 0, 1_000_000_000 // max(rate, 1), 60, 0, 0, 0, 1, 0, 0, 0, *loop, 0, 0)
    body += b"data" + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) % 2)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


class WaveReader(FileReader):
    suffixes = (".wav",)

    def rows(self, path: str) -> Iterator[dict]:
        meta, samples = parse(read(path))
        if self.options.get("content", "true").lower() != "true":
            yield {"path": path, **meta}
            return
        for c in range(meta["channels"]):
            for at in range(0, meta["n_frames"], BLOCK):
                yield {"path": path, **meta, "channel": c, "blk": at // BLOCK, "samples": samples[at : at + BLOCK, c].tolist()}


class WaveWriter(FileWriter):
    """Writes blocks (name, sample_rate, channel, blk, samples) as files: the rows of a file have to be in one partition."""

    def contents(self, rows: Iterator[dict]) -> Iterator[tuple[str, bytes]]:
        for name, (rate, samples) in gather(rows).items():
            yield name, build(samples, rate, bits=int(self.options.get("bits", 16)))


class WaveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "assetwave"

    def schema(self) -> str:
        return "path string, channels int, sample_rate int, bits int, n_frames long, loop_start long, loop_end long, channel int, blk long, samples array<int>, error string"

    def reader(self, schema) -> WaveReader:
        return WaveReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> WaveWriter:
        return WaveWriter(self.options, schema)
