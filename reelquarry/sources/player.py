"""Header / stream pairs: a packed bit header, then chunks of bytes and frames, in one file or split over a companion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource

from ..functions.codecs import adpcm
from .chunks import gather
from .files import FileReader, FileWriter, open_path, read

#: Header fields and widths, and what codec numbers stand for (2 PCM, 4 XAS, 5 to 7 granule).
FIELDS = (("version", 4), ("codec", 4), ("channels", 6), ("sample_rate", 18), ("play_type", 2), ("looped", 1), ("n_frames", 29))
LAST = 1 << 31


def header(content: bytes) -> tuple[dict, int]:
    """Fields of the packed header and the number of bytes that it takes."""
    if len(content) < 8:
        raise ValueError("no header")
    word, left, out = int.from_bytes(content[:8], "big"), 64, {}
    for name, width in FIELDS:
        left -= width
        out[name] = word >> left & ((1 << width) - 1)
    out["channels"] += 1
    if out["play_type"] > 2 or not out["sample_rate"]:
        raise ValueError("no valid header")
    at = 8
    for name, there in (("loop_start", out["looped"]), ("resident", out["play_type"] == 2), ("loop_offset", out["looped"] and out["play_type"] > 0)):
        out[name] = None
        if there:
            if at + 4 > len(content):
                raise ValueError("the header is cut off")
            out[name] = int.from_bytes(content[at : at + 4], "big")
            at += 4
    return out, at


def build_header(**values: int) -> bytes:
    word = 0
    for name, width in FIELDS:
        v = values.get(name, 0) - (name == "channels")
        if not 0 <= v < 1 << width:
            raise ValueError(f"{name} doesn't fit")
        word = word << width | v
    more = [values[k] for k in ("loop_start", "resident", "loop_offset") if k in values]
    return word.to_bytes(8, "big") + b"".join(x.to_bytes(4, "big") for x in more)


def chunks(content: bytes) -> Iterator[tuple[int, bytes, bool]]:
    """(frames, payload, last) of each chunk: 32-bit size with the last chunk's mark in bit 31, 32-bit frames."""
    at = 0
    while at + 8 <= len(content):
        size, frames = int.from_bytes(content[at : at + 4], "big"), int.from_bytes(content[at + 4 : at + 8], "big")
        last, size = bool(size & LAST), size & (LAST - 1)
        if size < 8 or at + size > len(content):
            raise ValueError("a chunk is cut off")
        yield frames, content[at + 8 : at + size], last
        if last:
            return
        at += size


def build_chunk(frames: int, payload: bytes, last: bool = False) -> bytes:
    return ((len(payload) + 8) | (LAST if last else 0)).to_bytes(4, "big") + frames.to_bytes(4, "big") + payload


class PlayerReader(FileReader):
    """Reads .snr files; the .sns companion of the same stem follows where the sound streams."""

    suffixes = (".snr",)

    def rows(self, path: str) -> Iterator[dict]:
        content = read(path)
        meta, at = header(content)
        parts = [("header", content[at:])]
        if meta["play_type"]:
            other = path[: -len(".snr")] + ".sns"
            fs, place = open_path(other)
            if not fs.get_file_info(place).is_file:
                raise ValueError("the stream file is missing")
            parts.append(("stream", read(other)))
        seq = 0
        for part, data in parts:
            for frames, payload, last in chunks(data):
                yield {"path": path, **meta, "looped": bool(meta["looped"]), "part": part, "seq": seq, "frames": frames, "n_bytes": len(payload), "is_last": last, "payload": payload}
                seq += 1


def build(samples: np.ndarray, rate: int, frames: int, play_type: int, resident: int = 0, codec: int = 2) -> tuple[bytes, bytes]:
    """Header file and stream file: play type 0 keeps all chunks resident, 1 streams all, 2 keeps the first `resident` frames."""
    n, channels = samples.shape
    more = {"resident": resident} if play_type == 2 else {}
    head = build_header(version=1, codec=codec, channels=channels, sample_rate=rate, play_type=play_type, n_frames=n, **more)

    def coded(part: np.ndarray) -> bytes:
        if codec == 4:
            return b"".join(adpcm.xas_encode(part[:, c].tolist()) for c in range(channels))
        return part.astype(">i2").tobytes()

    def run(part: np.ndarray) -> bytes:
        cuts = range(0, len(part), frames)
        return b"".join(build_chunk(len(p), coded(p), i + frames >= len(part)) for i in cuts for p in [part[i : i + frames]])

    split = {0: n, 1: 0}.get(play_type, resident)
    return head + run(samples[:split]), run(samples[split:])


class PlayerWriter(FileWriter):
    """Writes blocks (name, sample_rate, channel, blk, samples) as name.snr and, where the sound streams, name.sns. Options: codec, frames, play_type, resident."""

    def contents(self, rows: Iterator[dict]) -> Iterator[tuple[str, bytes]]:
        number = lambda k, d: int(self.options.get(k, d))
        for name, (rate, samples) in gather(rows).items():
            head, stream = build(samples, rate, number("frames", 1024), number("play_type", 0), number("resident", 0), number("codec", 2))
            if stream:
                yield f"{name}.sns", stream
            yield f"{name}.snr", head


class PlayerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "assetplayer"

    def schema(self) -> str:
        return (
            "path string, version int, codec int, channels int, sample_rate int, play_type int, looped boolean, n_frames long, loop_start long, resident long, loop_offset long, "
            "part string, seq int, frames long, n_bytes long, is_last boolean, payload binary, error string"
        )

    def reader(self, schema) -> PlayerReader:
        return PlayerReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> PlayerWriter:
        return PlayerWriter(self.options, schema)
