"""MPEG layer-3 frames to granules that stand alone, without loss, and the blocks that granules and plain samples are stored in.

A granule holds header bits, side information and main data together.
A frame's main data may begin in earlier frames (the bit reservoir), so a stream is read in order and what is left over
is carried from frame to frame.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes that a frame can reach back at most.
RESERVOIR = 511


class Bits:
    """Bits of some bytes, read from the front."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def take(self, n: int) -> int:
        if n > self.left:
            raise ValueError("bits are cut off")
        self.left -= n
        return self.value >> self.left & ((1 << n) - 1)


@dataclass
class Granule:
    index: int
    data: bytes


class Remux:
    """One stream's frames, fed in order. `held` is the state between frames."""

    def __init__(self, held: bytes = b""):
        self.held = held

    def feed(self, frame: bytes) -> list[Granule]:
        """The granules of a whole frame; none while the reservoir that it reaches into isn't known, as at the start of a cut stream."""
        head = Bits(frame[:4])
        sync, version, layer, plain = head.take(11), head.take(2), head.take(2), head.take(1)
        head.take(4)
        rate = head.take(2)
        head.take(2)
        mode, extension = head.take(2), head.take(2)
        if sync != 0x7FF or version == 1 or layer != 1 or rate == 3:
            raise ValueError("no layer-3 frame")
        channels, full = 1 if mode == 3 else 2, version == 3
        granules, rest = (2, 59) if full else (1, 63)
        size = {(1, True): 17, (2, True): 32, (1, False): 9, (2, False): 17}[channels, full]
        at = 4 if plain else 6
        side = Bits(frame[at : at + size])
        back = side.take(9 if full else 8)
        side.take((5 if channels == 1 else 3) if full else channels)
        shared = side.take(4 * channels) if full else 0
        facts = [[(side.take(12), side.take(rest - 12)) for _ in range(channels)] for _ in range(granules)]
        payload = frame[at + size :]
        known = back <= len(self.held)
        main = Bits(self.held[len(self.held) - back :] + payload) if known else None
        self.held = (self.held + payload)[-RESERVOIR:]
        if main is None:
            return []
        out = []
        for g in range(granules):
            word = ((version << 2 | rate) << 2 | mode) << 2 | extension
            word, n = word << 1 | g, 9
            if full and g == 1:  # which scale factors the second granule shares with the first
                word, n = word << 4 * channels | shared, n + 4 * channels
            for length, more in facts[g]:
                word, n = (word << 12 | length) << (rest - 12) | more, n + rest
            for length, _ in facts[g]:
                word, n = word << length | main.take(length), n + length
            out.append(Granule(g, (word << -n % 8).to_bytes(-(-n // 8), "big")))
        return out


#: Samples of a granule, and what a block's offset does to the samples before it: nothing, silence, or leaving them.
GRANULE_SAMPLES = 576
IGNORE, PRESERVE, MUTE = 0, 1, 2
#: Samples of a channel that one block can hold as they are.
MOST_PCM = 1023


@dataclass
class Block:
    """A block of coded sound: a granule, samples as they are (frames, channels), or both."""

    granule: bytes
    pcm: np.ndarray
    mode: int = IGNORE
    offset: int = 0

    def build(self) -> bytes:
        n, channels = self.pcm.shape
        extended = bool(n or self.offset)
        size = (6 if extended else 2) + len(self.granule) + 2 * n * channels
        if n > MOST_PCM or len(self.granule) > 1023 * extended + 4093 * (not extended) or size > 4095:
            raise ValueError("the block is too large")
        head = (extended << 15 | (channels - 1) << 14 | size).to_bytes(2, "big")
        more = (self.mode << 30 | self.offset << 20 | n << 10 | len(self.granule)).to_bytes(4, "big") if extended else b""
        return head + more + self.granule + self.pcm.astype(">i2").tobytes()

    @property
    def usable(self) -> int:
        """Samples of a channel that the block adds to a stream."""
        if self.granule:
            return GRANULE_SAMPLES - (self.offset if self.mode == IGNORE else 0)
        return len(self.pcm) * (2 if self.mode == MUTE else 1)


def blocks(data: bytes) -> Iterator[Block]:
    """The blocks of a stream, one after another."""
    at = 0
    while at < len(data):
        if at + 2 > len(data):
            raise ValueError("a block is cut off")
        short = int.from_bytes(data[at : at + 2], "big")
        channels, size = (short >> 14 & 1) + 1, short & 0xFFF
        if short >> 15:
            long = int.from_bytes(data[at + 2 : at + 6], "big")
            head, mode, offset, n, granule = 6, long >> 30, long >> 20 & 1023, long >> 10 & 1023, long & 1023
        else:
            head, mode, offset, n, granule = 2, IGNORE, 0, 0, size - 2
        if size < head + granule + 2 * n * channels or at + size > len(data):
            raise ValueError("a block is cut off")
        start = at + head + granule
        pcm = np.frombuffer(data[start : start + 2 * n * channels], ">i2").reshape(n, channels).astype(np.int16)
        yield Block(data[at + head : start], pcm, mode, offset)
        at += size


def raw_block(samples: np.ndarray, offset: int = 0) -> bytes:
    """Samples (frames, channels) that replace a granule's from an offset on, channel after channel, as the first version has them."""
    return len(samples).to_bytes(4, "big") + offset.to_bytes(4, "big") + samples.T.astype(">i2").tobytes()


def parse_raw_block(data: bytes, channels: int) -> tuple[np.ndarray, int, int]:
    """Samples, their offset, and the bytes that the block takes."""
    n, offset = int.from_bytes(data[:4], "big"), int.from_bytes(data[4:8], "big")
    end = 8 + 2 * n * channels
    if len(data) < end:
        raise ValueError("a raw block is cut off")
    return np.frombuffer(data[8:end], ">i2").reshape(channels, n).T.astype(np.int16), offset, end


def pcm_encode(samples: np.ndarray) -> bytes:
    """Samples (frames, channels) in blocks that hold them as they are: the lossless part of the second version's codec."""
    step = MOST_PCM if samples.shape[1] == 1 else 1020
    return b"".join(Block(b"", samples[i : i + step]).build() for i in range(0, len(samples), step))


def pcm_decode(data: bytes) -> np.ndarray:
    """Samples of such blocks; blocks with granules are refused."""
    parts = []
    for b in blocks(data):
        if b.granule:
            raise ValueError("granules aren't decoded")
        parts.append(b.pcm)
    return np.concatenate(parts) if parts else np.empty((0, 1), np.int16)
