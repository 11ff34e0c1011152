"""Endian integers, bit fields and sparse tags over binary columns, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def be_uint(content: Column, at: int | Column, n: int) -> Column:
    """Unsigned big-endian integer of n bytes (1 to 7) from byte `at`, counted from 0; NULL beyond the end."""
    start = (at if isinstance(at, Column) else F.lit(at)) + 1
    part = F.substring(content, start, F.lit(n))
    return F.when(F.octet_length(part) == n, F.conv(F.hex(part), 16, 10).cast("long"))


def le_uint(content: Column, at: int | Column, n: int) -> Column:
    """Unsigned little-endian integer of n bytes (1 to 7)."""
    start = at if isinstance(at, Column) else F.lit(at)
    total = F.lit(0).cast("long")
    for i in range(n):
        total = total + be_uint(content, start + i, 1) * F.lit(1 << (8 * i))
    return total


def be_bytes(value: Column, n: int) -> Column:
    """The low n bytes of a non-negative integer, big-endian."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * n, "0"))


def le_bytes(value: Column, n: int) -> Column:
    big = be_bytes(value, n)
    return F.unhex(F.concat(*[F.hex(F.substring(big, n - i, 1)) for i in range(n)]))


def bits(word: Column, width: int, at: int, n: int) -> Column:
    """n bits of a word of `width` bits, from bit `at` counted from the most significant."""
    return F.shiftright(word.cast("long"), width - at - n).bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def signed(value: Column, n_bytes: int | Column) -> Column:
    """Sign extension of an unsigned value of n bytes; no bytes mean 0."""
    n = n_bytes if isinstance(n_bytes, Column) else F.lit(n_bytes)
    full = F.pow(F.lit(2.0), n * 8).cast("long")
    return F.when(n == 0, F.lit(0).cast("long")).when(value >= full / 2, value - full).otherwise(value)


def wrap_s16(value: Column) -> Column:
    """16-bit wraparound, which ANSI casts refuse."""
    return F.shiftright(F.shiftleft(value.cast("int").bitwiseAND(F.lit(0xFFFF)), 16), 16)


def align_up(value: Column, step: int) -> Column:
    return (F.ceil(value / step) * step).cast("long")


#: Fixed value: the upper bound of three bytes is 8388352 in the tag format, not 8388607.
TAG_LIMITS = ((1, -128, 127), (2, -32768, 32767), (3, -8388608, 8388352))


def tag_width(value: Column, default: Column) -> Column:
    """Bytes of a tag's shortest signed form; NULL where the value is the default and no tag is written."""
    out = F.when(value == default, F.lit(None).cast("int")).when(value == 0, 0)
    for n, low, high in TAG_LIMITS:
        out = out.when(value.between(low, high), n)
    return out.otherwise(4)


def tag_bytes(tag: int, value: Column, default: Column) -> Column:
    """Tag number, width and big-endian two's complement value; empty for the default."""
    width = tag_width(value, default)
    raw = F.substring(F.unhex(F.lpad(F.hex(value.cast("long")), 16, "0")), F.lit(9) - width, width)
    head = F.concat(be_bytes(F.lit(tag), 1), be_bytes(width, 1))
    return F.when(width.isNull(), F.unhex(F.lit(""))).otherwise(F.concat(head, raw))


def half_to_double(word: Column) -> Column:
    """IEEE half-precision bits to double; infinities and NaN as such."""
    sign = F.when(bits(word, 16, 0, 1) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent, fraction = bits(word, 16, 1, 5), bits(word, 16, 6, 10)
    normal = F.pow(F.lit(2.0), exponent - 15) * (1 + fraction / 1024)
    special = F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return sign * F.when(exponent == 31, special).when(exponent == 0, fraction * F.lit(2.0**-24)).otherwise(normal)


def double_to_half(x: Column) -> Column:
    """Nearest half-precision bits of a double, ties to even; what is too large becomes infinity, NaN stays NaN."""
    size = F.abs(x)
    exponent = F.greatest(F.floor(F.log2(F.when(size > 0, size).otherwise(1.0))), F.lit(-14))
    exponent = F.when(size >= F.pow(F.lit(2.0), exponent + 1), exponent + 1).when((size < F.pow(F.lit(2.0), exponent)) & (exponent > -14), exponent - 1).otherwise(exponent)
    # Units of the last place, of which a normal number has 1024 to 2047; one more moves on to the next exponent by itself.
    units = F.rint(size / F.pow(F.lit(2.0), exponent - 10)).cast("long")
    word = F.when(size == 0, F.lit(0)).when(size >= 65520.0, F.lit(0x7C00)).otherwise((exponent.cast("long") + 14) * 1024 + units)
    sign = F.when((x < 0) | (x.cast("string") == "-0.0"), F.lit(0x8000)).otherwise(F.lit(0))
    return F.when(F.isnan(x), F.lit(0x7E00)).otherwise(word + sign).cast("long")


def fixed_tag(tag: int, value: Column, default: Column, width: int) -> Column:
    """A tag whose value takes `width` bytes (0 to 4) in two's complement; empty for the default."""
    raw = F.substring(F.unhex(F.lpad(F.hex(value.cast("long")), 16, "0")), 9 - width, width)
    return F.when(value == default, F.unhex(F.lit(""))).otherwise(F.concat(be_bytes(F.lit(tag), 1), be_bytes(F.lit(width), 1), raw))


def blob_tag(tag: int, data: Column) -> Column:
    """A tag of bytes, whose size takes one byte below 255 and five from there on; empty for no data."""
    n = F.octet_length(data)
    size = F.when(n < 255, be_bytes(n, 1)).otherwise(F.concat(F.unhex(F.lit("FF")), be_bytes(n, 4)))
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.unhex(F.lit(""))).otherwise(F.concat(be_bytes(F.lit(tag), 1), size, data))


def marker(tag: int) -> Column:
    return be_bytes(F.lit(tag), 1)


def align_tag(offset: Column, size: Column, alignment: int) -> Column:
    """Skipped bytes (252) after which the data of a tag of `size` bytes lies on a multiple of `alignment`."""
    head = F.when(size >= 255, 6).otherwise(2)
    return F.unhex(F.repeat(F.lit("FC"), F.pmod(-(offset + head), F.lit(alignment)).cast("int")))


def codebook(content: Column, at: int | Column, big: bool) -> Column:
    """Sixteen signed 16-bit values of a channel's codebook, which takes 33 bytes."""
    start = at if isinstance(at, Column) else F.lit(at)
    word = lambda i: (be_uint if big else le_uint)(content, start + 2 * i, 2)
    return F.array(*[signed(word(i), 2).cast("int") for i in range(16)])


def sideband(content: Column, at: Column, size: Column) -> Column:
    """A channel's time-stretch bytes, as they are; NULL where they are cut off."""
    part = F.substring(content, at + 1, size)
    return F.when(F.octet_length(part) == size, part)


def scaling_table(content: Column, position: Column, offset: Column) -> Column:
    """The 128 bytes of a table at an offset relative to four bytes before the position; NULL where they are cut off."""
    at = position + offset - 4
    return F.when(at >= 0, sideband(content, at, F.lit(128)))
