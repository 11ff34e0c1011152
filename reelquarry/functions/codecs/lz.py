"""LZ byte codec: commands of literals and copies within the last 128 KiB, after a signature and the unpacked size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import together

WINDOW, LONGEST = 131071, 1028


class Corrupt(ValueError):
    """The stream breaks the format: it is truncated, copies from before its start or doesn't give its size."""


def is_packed(data: bytes) -> bool:
    return len(data) >= 2 and data[1] == 0xFB and data[0] in (0x10, 0x11, 0x90, 0x91)


def header(data: bytes) -> tuple[int, int]:
    """Unpacked size and the place where commands begin."""
    if not is_packed(data):
        raise Corrupt("no signature")
    width = 4 if data[0] & 0x80 else 3
    at = 2 + (width if data[0] & 1 else 0)
    if len(data) < at + width:
        raise Corrupt("no size")
    return int.from_bytes(data[at : at + width], "big"), at + width


def decode(data: bytes) -> bytes:
    size, i = header(data)
    out = bytearray()
    try:
        while True:
            a = data[i]
            if a < 0x80:
                literals, distance, length, i = a & 3, ((a & 0x60) << 3) + data[i + 1] + 1, ((a >> 2) & 7) + 3, i + 2
            elif a < 0xC0:
                b = data[i + 1]
                literals, distance, length, i = b >> 6, ((b & 0x3F) << 8) + data[i + 2] + 1, (a & 0x3F) + 4, i + 3
            elif a < 0xE0:
                literals, distance, length = a & 3, ((a & 0x10) << 12) + (data[i + 1] << 8) + data[i + 2] + 1, ((a & 0x0C) << 6) + data[i + 3] + 5
                i += 4
            elif a < 0xFC:
                literals, distance, length, i = ((a & 0x1F) << 2) + 4, 0, 0, i + 1
            else:
                literals, distance, length, i = a & 3, 0, 0, i + 1
            if i + literals > len(data):
                raise Corrupt("literals are cut off")
            out += data[i : i + literals]
            i += literals
            if length:
                if distance > len(out):
                    raise Corrupt("a copy begins before the start")
                start = len(out) - distance
                if distance >= length:
                    out += out[start : start + length]
                else:  # the copy overlaps what it writes
                    unit = bytes(out[start:])
                    out += (unit * (length // distance + 1))[:length]
            if len(out) > size:
                raise Corrupt("more bytes than announced")
            if a >= 0xFC:
                break
    except IndexError:
        raise Corrupt("commands are cut off") from None
    if len(out) != size:
        raise Corrupt("fewer bytes than announced")
    return bytes(out)


def _command(distance: int, length: int) -> int:
    """Bytes that a copy's command takes; 0 where none holds it."""
    if distance <= 1024 and 3 <= length <= 10:
        return 2
    if distance <= 16384 and 4 <= length <= 67:
        return 3
    return 4 if distance <= WINDOW and 5 <= length <= LONGEST else 0


#: Matches up to this length, 12 at least, are found for all places at once, longer ones where the parse arrives. Bytes that are coded at a time; a longer text is coded alone.
DEPTH, PORTION = 16, 1 << 16


def _ordered(key: np.ndarray, places: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and their places, which are below 1 << bits and stay in order where keys are equal."""
    if len(key) and int(key.max()).bit_length() + bits < 64:
        both = np.sort(key << bits | places)
        return both >> bits, both & ((1 << bits) - 1)
    order = np.lexsort((places, key))
    return key[order], places[order]


def _nearest(d: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each place of texts that follow one another: length, up to DEPTH, and distance of the match whose copy saves most, then of the longest, then of the nearest.

    Then the places whose first DEPTH bytes occur again, grouped by these and in order, and the group of each. Each round adds a byte to the
    groups of equal bytes; a place that shares its bytes with no other within the window leaves.
    """
    n = len(d)
    length, distance, bits = np.zeros(n, np.int16), np.zeros(n, np.int32), n.bit_length()
    of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    end = ends[of]
    places = np.flatnonzero(np.arange(3, n + 3) <= end)
    group = of[places] << 24 | d[places].astype(np.int64) << 16 | d[places + 1].astype(np.int64) << 8 | d[places + 2]
    for size in range(3, DEPTH + 1):
        if not len(places):
            break
        group, places = _ordered(group, places, bits)
        back = np.diff(places)
        same = (np.diff(group) == 0) & (back <= WINDOW)
        near = same & (back <= {3: 1024, 4: 16384}[size]) if size < 5 else same
        at, back = places[1:][near], back[near]
        if size < 12:  # a byte more doesn't pay where its command is larger by two
            pays = (back <= 16384) | (length[at] < size - 1) | (distance[at] > 1024)
            at, back = at[pays], back[pays]
        length[at], distance[at] = size, back
        stays = np.zeros(len(places), bool)
        stays[1:] = same
        stays[:-1] |= same
        group = np.cumsum(np.concatenate([[0], ~same]))[stays]
        places = places[stays]
        if size < DEPTH:
            inside = places + size < end[places]
            group, places = group[inside], places[inside]
            group = group << 8 | d[places + size]
    return length, distance, places, group


def _longest(d: np.ndarray, places: np.ndarray, i: int, length: int, most: int) -> tuple[int, int]:
    """Place and length of the longest match at i, up to `most`, among places that share `length` bytes with it; the nearest if there are several."""
    j = int(places[-1])
    if (d[j + length : j + most] == d[i + length : i + most]).all():
        return j, most
    while length < most:
        if len(places) > 64:
            whole, n = d[places + length] == d[i + length], 1
        else:
            n = min(32, most - length)
            equal = d[places[:, None] + np.arange(length, length + n)] == d[i + length : i + length + n]
            whole = equal.all(1)
        if not whole.any():
            run = equal.argmin(1) if n > 1 else 0 * places
            return int(places[np.flatnonzero(run == run.max())[-1]]), length + int(run.max())
        places, length = places[whole], length + n
    return int(places[-1]), length


def _parse(d: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, length and distance of each copy of a greedy parse."""
    length, distance, places, group = _nearest(d, ends)
    rank, first = np.zeros(len(d), np.int64), np.searchsorted(group, group)
    rank[places] = np.arange(len(places))
    found, longer, i = [], {}, 0
    for a in range(0, len(d), PORTION):
        z = min(a + PORTION, len(d))
        sizes = length[a:z]
        following = np.minimum.accumulate(np.where(sizes > 0, np.arange(a, z), z)[::-1])[::-1].tolist()  # the next place that has a match
        sizes = sizes.tolist()
        while i < z and (i := following[i - a]) < z:
            found.append(i)
            k = sizes[i - a]
            if k == DEPTH:
                r = rank[i]
                earlier = places[first[r] : r]
                earlier = earlier[np.searchsorted(earlier, i - WINDOW) :]
                j, k = _longest(d, earlier, i, k, min(LONGEST, int(ends[np.searchsorted(ends, i, "right")]) - i))
                longer[len(found) - 1] = (k, i - j)
            i += k
    at = np.array(found, np.int64)
    size, back = length[at].astype(np.int64), distance[at].astype(np.int64)
    if longer:
        size[list(longer)], back[list(longer)] = np.array(list(longer.values())).T
    return at, size, back


def _assembled(d: np.ndarray, ends: np.ndarray, at: np.ndarray, size: np.ndarray, back: np.ndarray) -> list[bytes]:
    """Streams of texts that follow one another, from the copies of all; each text's end is a command like a copy of nothing."""
    texts = np.diff(ends, prepend=0)
    order = np.argsort(np.concatenate([ends, at]), kind="stable")
    last = (order < len(ends)).astype(bool)
    at, size, back = (np.concatenate(x)[order] for x in ((ends, at), (0 * ends, size), (0 * ends, back)))
    run = at - np.concatenate([[0], (at + size)[:-1]])  # literals before the command: whole fours in blocks of up to 112, the others after its head
    fours = run // 4 * 4
    blocks = -(-fours // 112)
    head = np.select([last, (back <= 1024) & (size <= 10), (back <= 16384) & (size <= 67)], [1, 2, 3], 4)
    sign = np.zeros(len(at), np.int64)
    sign[np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])] = np.where(texts > 0xFFFFFF, 6, 5)
    stop = np.cumsum(sign + run + blocks + head)
    start = stop - run - blocks - head
    out = np.zeros(int(stop[-1]), np.uint8)

    of = np.repeat(np.arange(len(run)), run)  # the command that each literal comes before
    place = np.arange(len(of)) - np.repeat(np.cumsum(run) - run, run)
    out[start[of] + place + np.where(place < fours[of], place // 112 + 1, (blocks + head)[of])] = d[(at - run)[of] + place]
    of = np.repeat(np.arange(len(run)), blocks)
    block = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    out[start[of] + 113 * block] = 0xE0 | np.minimum(112, fours[of] - 112 * block) // 4 - 1

    here, n, b = start + fours + blocks, run - fours, back - 1
    out[here[last]] = 0xFC | n[last]
    for width, parts in (
        (2, lambda n, b, k: (b >> 3 & 0x60 | k - 3 << 2 | n, b)),
        (3, lambda n, b, k: (0x80 | k - 4, n << 6 | b >> 8, b)),
        (4, lambda n, b, k: (0xC0 | b >> 12 & 0x10 | k - 5 >> 6 & 0x0C | n, b >> 8, b, k - 5)),
    ):
        mine = ~last & (head == width)
        for j, byte in enumerate(parts(n[mine], b[mine], size[mine])):
            out[here[mine] + j] = byte & 0xFF
    whole, cuts = out.tobytes(), stop[last].tolist()
    packed = []
    for text, a, z in zip(texts.tolist(), [0, *cuts], cuts, strict=False):
        mark = b"\x90\xfb" + text.to_bytes(4, "big") if text > 0xFFFFFF else b"\x10\xfb" + text.to_bytes(3, "big")
        packed.append(mark + whole[a + len(mark) : z])
    return packed


def encode_many(texts: list[bytes]) -> list[bytes]:
    """Greedy parse of each text. At each place all earlier places within the window that share three bytes count; the copy that saves most wins, then the longest, then the nearest.

    From 12 bytes on that is the longest copy. Texts are coded about PORTION bytes at a time.
    """
    packed, portion, size = [], [], 0
    for i, x in enumerate(texts):
        portion.append(x)
        size += len(x)
        if i + 1 == len(texts) or size + len(texts[i + 1]) > PORTION:
            d, ends = np.frombuffer(b"".join(portion), np.uint8), np.cumsum([len(x) for x in portion])
            packed += _assembled(d, ends, *_parse(d, ends))
            portion, size = [], 0
    return packed


def encode(data: bytes) -> bytes:
    return encode_many([data])[0]


@F.pandas_udf(T.BinaryType())
def lz_pack(content: pd.Series) -> pd.Series:
    return together(encode_many, content)


@F.pandas_udf(T.BinaryType())
def lz_unpack(content: pd.Series) -> pd.Series:
    """Unpacked bytes; content that isn't packed stays as it is, corrupt streams give NULL."""

    def one(x: bytes | None) -> bytes | None:
        if x is None or not is_packed(bytes(x)):
            return x
        try:
            return decode(bytes(x))
        except Corrupt:
            return None

    return content.map(one)
