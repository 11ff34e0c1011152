"""Block compression of textures from the public format descriptions: BC1 (DXT1), BC2 (DXT3) and BC3 (DXT5)."""

from __future__ import annotations

import struct

import numpy as np

FORMATS = ("DXT1", "DXT3", "DXT5")


def _565(c: np.ndarray) -> int:
    r, g, b = (int(x) for x in c[:3])
    return (r >> 3) << 11 | (g >> 2) << 5 | b >> 3


def _888(v: int) -> np.ndarray:
    r, g, b = v >> 11, v >> 5 & 63, v & 31
    return np.array([r << 3 | r >> 2, g << 2 | g >> 4, b << 3 | b >> 2], np.int32)


def _colours(a: int, b: int, three: bool) -> np.ndarray:
    x, y = _888(a), _888(b)
    return np.stack([x, y, (x + y) // 2, np.zeros(3, np.int32)]) if three else np.stack([x, y, (2 * x + y) // 3, (x + 2 * y) // 3])


def _colour_block(block: np.ndarray, clear: bool) -> bytes:
    """Eight bytes for 16 pixels; with `clear`, pixels of alpha under 128 take the transparent entry."""
    rgb = block[:, :3].astype(np.int32)
    gone = block[:, 3] < 128 if clear else np.zeros(16, bool)
    seen = rgb[~gone] if (~gone).any() else rgb[:1] * 0
    axis = seen.max(axis=0) - seen.min(axis=0)
    along = seen @ axis
    a, b = _565(seen[along.argmax()]), _565(seen[along.argmin()])
    three = bool(gone.any())
    a, b = (min(a, b), max(a, b)) if three else (max(a, b), min(a, b))
    table = _colours(a, b, three or a == b)
    distance = ((rgb[:, None] - table[None]) ** 2).sum(axis=2)
    distance[:, 3] = 1 << 30 if three or a == b else distance[:, 3]
    index = np.where(gone, 3, distance.argmin(axis=1))
    return struct.pack("<HHI", a, b, sum(int(k) << (2 * i) for i, k in enumerate(index)))


def _alpha_table(a: int, b: int) -> np.ndarray:
    steps = [((7 - i) * a + i * b) // 7 for i in range(1, 7)] if a > b else [*(((5 - i) * a + i * b) // 5 for i in range(1, 5)), 0, 255]
    return np.array([a, b, *steps], np.int32)


def _alpha_block(alpha: np.ndarray) -> bytes:
    a, b = int(alpha.max()), int(alpha.min())
    index = np.abs(alpha.astype(np.int32)[:, None] - _alpha_table(a, b)[None]).argmin(axis=1)
    return bytes([a, b]) + sum(int(k) << (3 * i) for i, k in enumerate(index)).to_bytes(6, "little")


def encode(image: np.ndarray, kind: str) -> bytes:
    """Blocks of an image (height, width, 4) of bytes; sides that aren't multiples of four repeat their edge."""
    h, w = image.shape[:2]
    padded = np.pad(image, ((0, -h % 4), (0, -w % 4), (0, 0)), "edge")
    out = bytearray()
    for y in range(0, padded.shape[0], 4):
        for x in range(0, padded.shape[1], 4):
            block = padded[y : y + 4, x : x + 4].reshape(16, 4)
            if kind == "DXT3":
                out += sum(int(a) // 17 << (4 * i) for i, a in enumerate(block[:, 3])).to_bytes(8, "little")
            elif kind == "DXT5":
                out += _alpha_block(block[:, 3])
            out += _colour_block(block, kind == "DXT1")
    return bytes(out)


def decode(data: bytes, width: int, height: int, kind: str) -> np.ndarray:
    size = 8 if kind == "DXT1" else 16
    across = -(-width // 4)
    if len(data) < size * across * -(-height // 4):
        raise ValueError("blocks are cut off")
    out = np.zeros((-(-height // 4) * 4, across * 4, 4), np.uint8)
    for i in range(across * -(-height // 4)):
        part = data[i * size : i * size + size]
        a, b, index = struct.unpack("<HHI", part[-8:])
        three = kind == "DXT1" and a <= b
        pick = np.array([index >> (2 * k) & 3 for k in range(16)])
        block = np.full((16, 4), 255, np.int32)
        block[:, :3] = _colours(a, b, three)[pick]
        if three:
            block[pick == 3, 3] = 0
        if kind == "DXT3":
            block[:, 3] = [(int.from_bytes(part[:8], "little") >> (4 * k) & 15) * 17 for k in range(16)]
        elif kind == "DXT5":
            bits = int.from_bytes(part[2:8], "little")
            block[:, 3] = _alpha_table(part[0], part[1])[[bits >> (3 * k) & 7 for k in range(16)]]
        y, x = i // across * 4, i % across * 4
        out[y : y + 4, x : x + 4] = block.reshape(4, 4, 4)
    return out[:height, :width]


def dds(levels: list[bytes], width: int, height: int, kind: str) -> bytes:
    """A DDS file of block-compressed mip levels."""
    flags, caps = 0x81007 | (0x20000 if len(levels) > 1 else 0), 0x1000 | (0x400008 if len(levels) > 1 else 0)
    head = struct.pack("<4s7I44x2I4s5I5I", b"DDS ", 124, flags, height, width, len(levels[0]), 0, len(levels), 32, 4, kind.encode(), 0, 0, 0, 0, 0, caps, 0, 0, 0, 0)
    return head + b"".join(levels)


def mip_levels(image: np.ndarray) -> list[np.ndarray]:
    """The image and its halves by 2 x 2 means, truncated, down to one pixel; sides have to be powers of two."""
    out = [image]
    while max(out[-1].shape[:2]) > 1:
        h, w = out[-1].shape[:2]
        dy, dx = 2 if h > 1 else 1, 2 if w > 1 else 1
        mean = out[-1].astype(np.int32).reshape(h // dy, dy, w // dx, dx, 4).sum(axis=(1, 3)) // (dy * dx)
        out.append(mean.astype(np.uint8))
    return out
