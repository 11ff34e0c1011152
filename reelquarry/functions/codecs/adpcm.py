"""Block ADPCM: XA (15 bytes for 28 samples, or 61 raw) and XAS (76 bytes for 128 samples).

A recurrence is serial in its samples but not in its blocks, so arrays hold many blocks or streams and step through
the samples of all of them at once.
"""

from __future__ import annotations

import numpy as np

#: Predictors in 1/256, and the first byte of a raw block.
COEFFICIENTS = ((0, 0), (240, 0), (460, -208), (392, -220))
RAW = 0xEE
C1, C2 = np.array(COEFFICIENTS, np.int64).T
XA, XAS = 28, 128


def _clip(x: np.ndarray) -> np.ndarray:
    return np.clip(x, -32768, 32767)


def _quantise(x: np.ndarray, c1: int, c2: int, shift: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nibbles of blocks (blocks, samples) under one filter and a shift for each, their squared error, and the last two samples."""
    nibbles, error = np.empty(x.shape, np.int64), np.zeros(len(x), np.int64)
    scale = 20 - shift
    half = np.left_shift(np.int64(1), scale - 1)
    for i in range(x.shape[1]):
        base = c1 * one + c2 * two
        n = np.clip((np.left_shift(x[:, i], 8) - base + half) >> scale, -8, 7)
        y = _clip((np.left_shift(n, scale) + base) >> 8)
        error += (x[:, i] - y) ** 2
        nibbles[:, i] = n
        one, two = y, one
    return nibbles, error, one, two


def search(x: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, ...]:
    """Filter, shift and nibbles of least squared error for blocks (blocks, samples) after (one, two), and the last two decoded samples."""
    before1 = np.concatenate([one[:, None], x[:, :-1]], axis=1)
    before2 = np.concatenate([two[:, None], before1[:, :-1]], axis=1)
    best = None
    for f, (c1, c2) in enumerate(COEFFICIENTS):
        peak = np.abs(x - ((c1 * before1 + c2 * before2) >> 8)).max(axis=1)
        fit = 12 - np.searchsorted(7 << np.arange(13), peak).clip(0, 12)  # the largest shift that holds the peak, else 0
        for shift in (fit, np.maximum(fit - 1, 0)):
            nibbles, error, last, last2 = _quantise(x, c1, c2, shift, one, two)
            found = [np.full(len(x), f), shift, nibbles, last, last2, error]
            if best is None:
                best = found
            else:
                better = error < best[5]
                best = [np.where(better[:, None] if a.ndim == 2 else better, a, b) for a, b in zip(found, best, strict=True)]
    return tuple(best[:5])


def _run(nibbles: np.ndarray, f: np.ndarray, shift: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Samples of blocks from their signed nibbles (blocks, samples)."""
    c1, c2 = C1[f], C2[f]
    out = np.empty(nibbles.shape, np.int64)
    scale = 20 - shift
    for i in range(nibbles.shape[1]):
        one, two = _clip((np.left_shift(nibbles[:, i], scale) + c1 * one + c2 * two) >> 8), one
        out[:, i] = one
    return out


def _unpack(data: np.ndarray) -> np.ndarray:
    """Bytes (blocks, n) to signed nibbles (blocks, 2 n), high ones first."""
    both = np.stack([data >> 4, data & 15], axis=-1).reshape(len(data), 2 * data.shape[1]).astype(np.int64)
    return np.where(both > 7, both - 16, both)


def _pack(nibbles: np.ndarray) -> np.ndarray:
    return ((nibbles[:, ::2] & 15) << 4 | nibbles[:, 1::2] & 15).astype(np.uint8)


def _whole(samples: list, size: int) -> np.ndarray:
    """Samples in blocks (blocks, size), the last one filled with its last sample."""
    x = _clip(np.asarray(samples, np.int64))
    return np.pad(x, (0, -len(x) % size), "edge").reshape(-1, size) if len(x) else np.empty((0, size), np.int64)


def xa_encode_many(streams: list) -> list[bytes]:
    """Each stream as whole blocks of 28 samples, the last one filled with its last sample; the first block of a stream is raw."""
    blocks = [_whole(s, XA) for s in streams]
    out = [bytearray() for _ in streams]
    state = np.zeros((len(streams), 2), np.int64)
    for k, b in enumerate(blocks):
        if len(b):
            out[k] += bytes([RAW]) + np.array([b[0, -1], b[0, -2], *b[0]], ">i2").tobytes()
            state[k] = b[0, -1], b[0, -2]
    for at in range(1, max(map(len, blocks), default=0)):
        here = np.array([k for k, b in enumerate(blocks) if len(b) > at])
        f, shift, nibbles, one, two = search(np.stack([blocks[k][at] for k in here]), state[here, 0], state[here, 1])
        state[here, 0], state[here, 1] = one, two
        packed = np.concatenate([(f << 4 | shift).astype(np.uint8)[:, None], _pack(nibbles)], axis=1)
        for k, p in zip(here, packed, strict=True):
            out[k] += p.tobytes()
    return [bytes(x) for x in out]


def xa_encode(samples: list) -> bytes:
    return xa_encode_many([samples])[0]


def xa_decode(data: bytes, state: tuple[int, int] = (0, 0), count: int | None = None) -> tuple[list[int], tuple[int, int]]:
    """Samples of whole blocks, up to the one that makes `count` of them, and the state after them, which the next call takes on."""
    out: list[int] = []
    one, two = state
    i = 0
    while i < len(data) and (count is None or len(out) < count):
        if data[i] == RAW:
            if i + 61 > len(data):
                raise ValueError("a raw block is cut off")
            one, two, *part = np.frombuffer(data[i + 1 : i + 61], ">i2").tolist()
            i += 61
        else:
            if i + 15 > len(data) or data[i] >> 4 > 3:
                raise ValueError("a block is cut off or has an unknown filter")
            c1, c2 = COEFFICIENTS[data[i] >> 4]
            scale, part = 20 - (data[i] & 15), []
            for b in data[i + 1 : i + 15]:
                for n in (b >> 4, b & 15):
                    x = (((n - 16 if n > 7 else n) << scale) + c1 * one + c2 * two) >> 8
                    one, two = -32768 if x < -32768 else 32767 if x > 32767 else x, one
                    part.append(one)
            i += 15
        out += part
    return out, (one, two)


def xas_encode(samples: list) -> bytes:
    """Groups of 4 blocks of 32 samples; each block holds its first two samples with filter and shift in their low nibbles."""
    return xas_groups(_whole(samples, XAS)).tobytes()


def xas_groups(groups: np.ndarray) -> np.ndarray:
    """Groups (groups, 128) of 16-bit samples to their bytes (groups, 76)."""
    blocks = groups.reshape(-1, 32)
    seeds = np.minimum(_clip(blocks[:, :2] + 8), 32767) & ~15
    f, shift, nibbles, _, _ = search(blocks[:, 2:], seeds[:, 1], seeds[:, 0])
    heads = np.stack([seeds[:, 0] | f, seeds[:, 1] | shift], axis=1).astype("<i2").view(np.uint8).reshape(-1, 16)
    rows = _pack(nibbles).reshape(-1, 4, 15).transpose(0, 2, 1).reshape(-1, 60)
    return np.concatenate([heads, rows], axis=1)


def xas_samples(data: np.ndarray) -> np.ndarray:
    """Bytes (groups, 76) to samples (groups, 128). Each group stands alone, so any range of groups can be decoded by itself."""
    heads = np.ascontiguousarray(data[:, :16]).view("<i2").astype(np.int64).reshape(-1, 2)
    rows = data[:, 16:].reshape(-1, 15, 4).transpose(0, 2, 1).reshape(-1, 15)
    seeds = heads & ~15
    rest = _run(_unpack(rows), heads[:, 0] & 3, heads[:, 1] & 15, seeds[:, 1], seeds[:, 0])
    return np.concatenate([seeds, rest], axis=1).reshape(-1, 128)


def xas_decode(data: bytes, start: int = 0, count: int | None = None) -> list[int]:
    """Samples start .. start + count; groups before them are skipped, not decoded."""
    if len(data) % 76:
        raise ValueError("groups are cut off")
    first = start // XAS
    last = len(data) // 76 if count is None else -(-(start + count) // XAS)
    found = xas_samples(np.frombuffer(data, np.uint8).reshape(-1, 76)[first:last]).reshape(-1)
    return found[start - first * XAS :][:count].tolist()


class XaFeed:
    """Pull decoding: bytes are fed as they arrive, samples are pulled in any number, and what is left over is kept for the next call."""

    def __init__(self):
        self.new()

    def new(self) -> None:
        """Forgets everything: the next bytes begin another stream."""
        self.data, self.samples, self.state = b"", [], (0, 0)

    def feed(self, data: bytes) -> None:
        self.data += data

    def pull(self, n: int) -> list[int]:
        """Up to n samples; fewer where the bytes fed so far don't hold a whole further block."""
        at = 0
        while len(self.samples) < n and at < len(self.data):
            size = 61 if self.data[at] == RAW else 15
            if at + size > len(self.data):
                break
            part, self.state = xa_decode(self.data[at : at + size], self.state)
            self.samples += part
            at += size
        self.data, out, self.samples = self.data[at:], self.samples[:n], self.samples[n:]
        return out
