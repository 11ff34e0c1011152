"""Codecs and resampling of sample streams in pieces of bounded size, so that no stream has to fit into one row or task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import adpcm

TAPS, BREAKPOINT = 256, 0.95
#: Samples of an XA segment, which begins with a raw block and so decodes by itself; and of a piece of a stream that is resampled.
XA_SEGMENT, PIECE = 64 * adpcm.XA, 16384


def segments(rows: DataFrame, key: str, sample: str, size: int) -> DataFrame:
    """Streams numbered by n in arrays of up to `size` samples: key, seg, samples."""
    placed = rows.withColumn("seg", F.floor(F.col("n") / size).cast("long"))
    packed = placed.groupBy(key, "seg").agg(F.array_sort(F.collect_list(F.struct("n", F.col(sample).alias("v")))).alias("s"))
    return packed.select(key, "seg", F.transform("s", lambda x: x["v"]).alias("samples"))


@F.pandas_udf(T.BinaryType())
def xa_pack(samples: pd.Series) -> pd.Series:
    """One XA segment per row; all rows of a batch are coded in step."""
    return pd.Series(adpcm.xa_encode_many(list(samples)))


@F.pandas_udf(T.BinaryType())
def xas_pack(samples: pd.Series) -> pd.Series:
    """Rows of any length as whole XAS groups."""
    parts = [adpcm._whole(s, adpcm.XAS) for s in samples]
    coded = adpcm.xas_groups(np.concatenate(parts)) if parts else None
    cut = np.cumsum([0, *map(len, parts)])
    return pd.Series([coded[i:j].tobytes() for i, j in zip(cut, cut[1:], strict=False)])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def xa_unpack(data: pd.Series) -> pd.Series:
    return pd.Series([adpcm.xa_decode(bytes(x))[0] for x in data])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def xas_unpack(data: pd.Series) -> pd.Series:
    parts = [np.frombuffer(x, np.uint8).reshape(-1, 76) for x in data]
    found = adpcm.xas_samples(np.concatenate(parts)) if parts else None
    cut = np.cumsum([0, *map(len, parts)])
    return pd.Series([found[i:j].reshape(-1) for i, j in zip(cut, cut[1:], strict=False)])


def round_trip(rows: DataFrame, key: str, sample: str, kind: str) -> DataFrame:
    """Streams numbered by n through a codec, xa or xas: key, n, n_bytes and the signal-to-noise ratio in decibels, 99 for no noise."""
    pack, unpack, size = (xa_pack, xa_unpack, XA_SEGMENT) if kind == "xa" else (xas_pack, xas_unpack, 16 * adpcm.XAS)
    coded = segments(rows, key, sample, size).withColumn("data", pack("samples")).withColumn("back", F.slice(unpack("data"), F.lit(1), F.size("samples")))
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    noise = F.zip_with("samples", "back", lambda a, b: a - b)
    totals = coded.select(key, F.size("samples").alias("n"), F.octet_length("data").alias("bytes"), square("samples").alias("p"), square(noise).alias("e"))
    totals = totals.groupBy(key).agg(F.sum("n").alias("n"), F.sum("bytes").alias("n_bytes"), F.sum("p").alias("p"), F.sum("e").alias("e"))
    ratio = F.when(F.col("e") == 0, 99.0).otherwise(10 * F.log10(F.greatest("p", F.lit(1.0)) / F.col("e")))
    return totals.select(key, "n", "n_bytes", ratio.alias("snr"))


def _taps(ratio: float, up: int) -> np.ndarray:
    half = TAPS * up
    t = np.arange(-half, half + 1)
    edge = BREAKPOINT * min(1.0, ratio) / up
    return edge * np.sinc(edge * t) * (0.5 + 0.5 * np.cos(np.pi * t / half))


def filtered(x: np.ndarray, taps: np.ndarray, size: int = 8192) -> np.ndarray:
    """x through a filter of odd length, centred, by overlap-add of blocks in the frequency domain."""
    step = size - len(taps) + 1
    spectrum = np.fft.rfft(taps, size)
    out = np.zeros(len(x) + size)
    for at in range(0, len(x), step):
        out[at : at + size] += np.fft.irfft(np.fft.rfft(x[at : at + step], size) * spectrum, size)
    half = len(taps) // 2
    return out[half : half + len(x)]


def up_factor(old: int, new: int) -> int:
    return 1 if new < old / 2 else 2


def resampled(x: np.ndarray, old: int, new: int, first: int = 0, last: int | None = None, before: int = 0, total: int | None = None) -> np.ndarray:
    """x at the new rate: band-limited by a windowed low-pass, then cubic Hermite interpolation.

    x may be a piece of a stream of `total` samples that begins at sample `before`; then the outputs that lie on samples
    first .. last - 1 of the stream are returned.
    """
    ratio = new / old
    total = len(x) if total is None else total
    last = total if last is None else last
    if total * ratio <= 1 or ratio == 1:
        return x[first - before : last - before]
    up = up_factor(old, new)
    wide = np.zeros(len(x) * up)
    wide[::up] = x * up
    smooth = filtered(wide, _taps(ratio, up))
    # Outputs k with first <= k / ratio < last, found with one to spare and then tested.
    k = np.arange(max(0, int(first * ratio) - 1), min(int(total * ratio), int(last * ratio) + 2))
    at = k / ratio
    at = at[(at >= first) & (at < last)] * up - before * up
    i = np.minimum(at.astype(int), len(smooth) - 1)
    f = at - i
    padded = np.pad(smooth, (1, 2), "edge")
    a, b, c, d = (padded[i + j] for j in range(4))
    m0, m1 = (c - a) / 2, (d - b) / 2
    return ((2 * b - 2 * c + m0 + m1) * f + (3 * c - 3 * b - 2 * m0 - m1)) * f * f + m0 * f + b


def resample_streams(rows: DataFrame, keys: str | list[str], sample: str, old: int | str, new: int) -> DataFrame:
    """Streams numbered by n, at another rate: keys, seg, samples. `old` is a rate, or a column that has each stream's.

    Pieces of a stream overlap by what the filter reaches, so they join without a seam.
    """
    keys = [keys] if isinstance(keys, str) else keys
    halo = TAPS + 4
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    own, place = F.floor(F.col("n") / PIECE).cast("long"), F.pmod("n", F.lit(PIECE))
    near = F.array(own, F.when(place < halo, own - 1), F.when(place >= PIECE - halo, own + 1))
    rate = (F.col(old) if isinstance(old, str) else F.lit(old)).cast("long").alias("old")
    dealt = rows.select(*keys, "n", F.col(sample).cast("double").alias("v"), rate, F.explode(F.array_compact(near)).alias("seg")).where("seg >= 0")
    dealt = dealt.join(sizes, keys).where(F.col("seg") * PIECE < F.col("total"))
    kinds = dict(rows.dtypes)

    def piece(t: pa.Table) -> pa.Table:
        t = t.sort_by("n")
        seg, total, rate = t["seg"][0].as_py(), t["total"][0].as_py(), t["old"][0].as_py()
        first, last = seg * PIECE, min(total, (seg + 1) * PIECE)
        found = resampled(t["v"].to_numpy(), rate, new, first, last, t["n"][0].as_py(), total)
        return pa.table({**{k: t[k].slice(0, 1) for k in keys}, "seg": t["seg"].slice(0, 1), "samples": pa.array([found], pa.list_(pa.float64()))})

    return dealt.groupBy(*keys, "seg").applyInArrow(piece, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", seg long, samples array<double>")


def granules(rows: DataFrame, key: str, order: str, frame: str | Column, shares: int | None = None) -> DataFrame:
    """Layer-3 frames of streams to granules: key, order, granule, data. A stream is read in its order with its bit reservoir carried over; broken frames have an error.

    A frame that is an expression is computed from its row once the rows are dealt and sorted, so that tasks sort only what it is made of. As such rows
    are small, `shares` says over how many tasks they are dealt; without it the planner joins shares by their bytes.
    """
    from .granules import Remux

    kind = dict(rows.dtypes)[key]
    schema = pa.schema([(key, rows.select(key).limit(0).toArrow().schema.field(0).type), (order, pa.int64()), ("granule", pa.int32()), ("data", pa.binary()), ("error", pa.string())])
    dealt = rows.withColumn(order, F.col(order).cast("long"))
    dealt = (dealt.repartition(shares, key) if shares else dealt.repartition(key)).sortWithinPartitions(key, order)
    dealt = dealt.select(key, order, (F.col(frame) if isinstance(frame, str) else frame).alias("__frame"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, remux = object(), Remux()
        for b in batches:
            out = []
            for k, n, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != now:
                    now, remux = k, Remux()
                try:
                    out += [(k, n, g.index, g.data, None) for g in remux.feed(content or b"")]
                except ValueError as e:
                    out.append((k, n, None, None, str(e)))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return dealt.mapInArrow(run, f"{key} {kind}, {order} long, granule int, data binary, error string")


@F.pandas_udf(T.BinaryType())
def pcm_blocks(samples: pd.Series) -> pd.Series:
    """Arrays of mono samples in blocks of plain samples."""
    from .granules import pcm_encode

    return pd.Series([pcm_encode(np.asarray(s, np.int64)[:, None]) for s in samples])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def pcm_unblocked(data: pd.Series) -> pd.Series:
    from .granules import pcm_decode

    return pd.Series([pcm_decode(bytes(x))[:, 0].astype(np.int32) for x in data])
