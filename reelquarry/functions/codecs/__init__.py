"""Codecs as Arrow UDFs, and what all byte codecs have in common."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def together(change: Callable[[list[bytes]], list[bytes]], values: pd.Series) -> pd.Series:
    """Values changed in one call, None for None."""
    there = values.notna()
    changed = iter(change([bytes(x) for x in values[there]]))
    return pd.Series([next(changed) if x else None for x in there], dtype=object)


@dataclass(frozen=True)
class ByteCodec:
    """A codec of bytes: whether bytes are coded by it, what size they unpack to, both directions, and for some coding of many at once."""

    name: str
    is_coded: Callable[[bytes], bool]
    size: Callable[[bytes], int]
    decode: Callable[[bytes], bytes]
    encode: Callable[[bytes], bytes]
    encode_many: Callable[[list[bytes]], list[bytes]] | None = None

    def column(self, direction: str, content: Column) -> Column:
        """decode or encode over a column, by Arrow batches; NULL for NULL and for bytes that the codec refuses."""
        change = getattr(self, direction)
        many = self.encode_many if direction == "encode" else None

        @F.pandas_udf(T.BinaryType())
        def run(values: pd.Series) -> pd.Series:
            if many:
                return together(many, values)

            def one(x: bytes | None) -> bytes | None:
                try:
                    return None if x is None else change(bytes(x))
                except ValueError:
                    return None

            return values.map(one)

        return run(content)


def byte_codecs() -> dict[str, ByteCodec]:
    """Registered codecs by name."""
    from . import lz

    return {
        "lz": ByteCodec("lz", lz.is_packed, lambda x: lz.header(x)[0], lz.decode, lz.encode, lz.encode_many),
        "none": ByteCodec("none", lambda x: True, len, bytes, bytes),
    }
