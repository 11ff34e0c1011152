"""MPEG audio framing: one row per frame, after a scan for seven headers that agree."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource

from ..functions.sound import BASE_RATES, BITRATES_FULL, BITRATES_LAYER1, BITRATES_LAYER1_LOW, BITRATES_LAYER2, BITRATES_LOW
from .files import FileReader, read

AGREE = 7


def frame(word: int) -> dict | None:
    """Fields of a frame header with the whole frame's size, or None."""
    version, layer = word >> 19 & 3, 4 - (word >> 17 & 3)
    bitrate, rate, pad = word >> 12 & 15, word >> 10 & 3, word >> 9 & 1
    if word >> 21 != 0x7FF or version == 1 or layer == 4 or rate == 3 or not 1 <= bitrate <= 14:
        return None
    low = version != 3
    by_layer = {1: BITRATES_LAYER1_LOW if low else BITRATES_LAYER1, 2: BITRATES_LOW if low else BITRATES_LAYER2, 3: BITRATES_LOW if low else BITRATES_FULL}
    kbit = by_layer[layer][bitrate - 1]
    hz = BASE_RATES[rate] // {3: 1, 2: 2, 0: 4}[version]
    half = layer == 3 and low
    size = 4 * (12000 * kbit // hz + pad) if layer == 1 else (72000 if half else 144000) * kbit // hz + pad
    return {"version": version, "layer": layer, "kbit": kbit, "sample_rate": hz, "channels": 1 if word >> 6 & 3 == 3 else 2, "frames": 384 if layer == 1 else 576 if half else 1152, "size": size}


def walk(content: bytes, at: int) -> Iterator[tuple[int, dict]]:
    while at + 4 <= len(content) and (f := frame(int.from_bytes(content[at : at + 4], "big"))):
        yield at, f
        at += f["size"]


def sync(content: bytes) -> int:
    """First place at which seven frames follow each other with one layer and rate, or as many as the file holds; -1 for none."""
    at = content.find(b"\xff")
    while 0 <= at:
        found = []
        for place, f in walk(content, at):
            found.append(f)
            end = place + f["size"]
            if len(found) == AGREE:
                break
        if found and (len(found) == AGREE or end == len(content)) and len({(f["layer"], f["sample_rate"]) for f in found}) == 1:
            return at
        at = content.find(b"\xff", at + 1)
    return -1


def strict_sync(content: bytes) -> int:
    """First place from which seven valid frame headers follow each other; -1 for none."""
    at = content.find(b"\xff")
    while 0 <= at:
        if sum(1 for _, _ in zip(range(AGREE), walk(content, at), strict=False)) == AGREE:
            return at
        at = content.find(b"\xff", at + 1)
    return -1


class MpegReader(FileReader):
    suffixes = (".mp3", ".mp2", ".mp1")

    def rows(self, path: str) -> Iterator[dict]:
        content = read(path)
        at = sync(content)
        if at < 0:
            raise ValueError("no frames")
        start = 0
        for seq, (place, f) in enumerate(walk(content, at)):
            yield {"path": path, "seq": seq, "offset": place, "start": start, **f, "payload": content[place : place + f["size"]]}
            start += f["frames"]


class MpegSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "assetmpeg"

    def schema(self) -> str:
        return "path string, seq int, offset long, start long, version int, layer int, kbit int, sample_rate int, channels int, frames int, size int, payload binary, error string"

    def reader(self, schema) -> MpegReader:
        return MpegReader(self.options, schema)
