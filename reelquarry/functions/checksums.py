"""Checksums of MPEG audio, as Arrow UDFs: bit-serial, so not for columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _table(polynomial: int, reflected: bool) -> list[int]:
    """The 256 remainders of a 16-bit CRC, from its polynomial."""
    out = []
    for i in range(256):
        r = i if reflected else i << 8
        for _ in range(8):
            if reflected:
                r = r >> 1 ^ (polynomial if r & 1 else 0)
            else:
                r = (r << 1 ^ (polynomial if r & 0x8000 else 0)) & 0xFFFF
        out.append(r)
    return out


HEADER, PAYLOAD = _table(0x8005, False), _table(0xA001, True)


def header_crc(data: bytes, start: int = 0xFFFF) -> int:
    """CRC of the protected bytes of a frame: polynomial 0x8005, most significant bit first."""
    for b in data:
        start = (start << 8 & 0xFFFF) ^ HEADER[start >> 8 ^ b]
    return start


def payload_crc(data: bytes, start: int = 0) -> int:
    """Running CRC of a stream's payload: the same polynomial, least significant bit first."""
    for b in data:
        start = start >> 8 ^ PAYLOAD[(start ^ b) & 255]
    return start


@F.pandas_udf(T.IntegerType())
def crc16_header(content: pd.Series) -> pd.Series:
    return content.map(lambda x: None if x is None else header_crc(bytes(x)))


@F.pandas_udf(T.IntegerType())
def crc16_payload(content: pd.Series) -> pd.Series:
    return content.map(lambda x: None if x is None else payload_crc(bytes(x)))
