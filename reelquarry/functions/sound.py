"""Sample conversions, rate and bitrate tables, MPEG headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binary import bits

#: Sample rates of MPEG audio, and layer-3 bitrates in kbit/s for full and for halved rates.
RATES = (8000, 11025, 12000, 16000, 22050, 24000, 32000, 44100, 48000)
BITRATES_FULL = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
BITRATES_LOW = (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
BITRATES_LAYER1 = (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448)
BITRATES_LAYER2 = (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384)
BITRATES_LAYER1_LOW = (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256)
BASE_RATES = (44100, 48000, 32000)


def next_of(value: Column, table: tuple[int, ...]) -> Column:
    """Smallest table entry not below value; the largest entry beyond the table. The table is a few constants."""
    above = F.filter(F.array(*[F.lit(t) for t in table]), lambda t: t >= value)
    return F.coalesce(F.get(above, F.lit(0)), F.lit(table[-1]))


def to_s16(x: Column) -> Column:
    """Clamped to 16 bits, then truncated toward zero."""
    return F.least(F.greatest(x, F.lit(-32768.0)), F.lit(32767.0)).cast("int")


def pcm16_be_round_trip(sample: Column) -> Column:
    """A 16-bit sample through float and the big-endian PCM codec, whose scale factors are asymmetric."""
    return to_s16(sample / 32768.0 * 32767.0)


def u8_to_s16(x: Column) -> Column:
    return (x.cast("int") - 128) * 256


def s16_to_u8(x: Column) -> Column:
    return F.shiftright(x.cast("int"), 8) + 128


def s24_to_s16(x: Column) -> Column:
    return F.shiftright(x.cast("int"), 8)


def mpeg_header(word: Column) -> dict[str, Column]:
    """Fields of a 32-bit MPEG audio frame header; size in bytes without the header's four, NULL where invalid."""
    version, layer = bits(word, 32, 11, 2), 4 - bits(word, 32, 13, 2)
    rate_at, bitrate_at, pad = bits(word, 32, 20, 2), bits(word, 32, 16, 4), bits(word, 32, 22, 1)
    valid = (bits(word, 32, 0, 11) == 0x7FF) & (version != 1) & (layer < 4) & (rate_at < 3) & bitrate_at.between(1, 14)
    at = lambda t: F.get(F.array(*[F.lit(x) for x in t]), (bitrate_at - 1).cast("int"))
    low = version != 3
    kbit = (
        F.when((layer == 1) & low, at(BITRATES_LAYER1_LOW)).when(layer == 1, at(BITRATES_LAYER1)).when(low, at(BITRATES_LOW))
        .when(layer == 2, at(BITRATES_LAYER2)).otherwise(at(BITRATES_FULL))
    )
    divide = F.when(version == 3, 1).when(version == 2, 2).otherwise(4)
    rate = (F.get(F.array(*[F.lit(x) for x in BASE_RATES]), rate_at.cast("int")) / divide).cast("int")
    frames = F.when(layer == 1, 384).when((layer == 3) & low, 576).otherwise(1152)
    whole = lambda a, b: F.floor(a / b).cast("long")
    size = (
        F.when(layer == 1, 4 * (whole(12000 * kbit, rate) + pad))
        .when((layer == 3) & low, whole(72000 * kbit, rate) + pad).otherwise(whole(144000 * kbit, rate) + pad) - 4
    )
    fields = {"version": version, "layer": layer, "kbit": kbit, "rate": rate, "frames": frames, "size": size, "channels": F.when(bits(word, 32, 24, 2) == 3, 1).otherwise(2)}
    return {"valid": valid} | {k: F.when(valid, v.cast("long")) for k, v in fields.items()}


def bark(hz: Column) -> Column:
    """Critical-band rate of a frequency."""
    khz = hz / 1000.0
    return 13.0 * F.atan(0.76 * khz) + 3.5 * F.atan(khz * khz / 56.25)


def critical_bandwidth(hz: Column) -> Column:
    khz = hz / 1000.0
    return 25.0 + 75.0 * F.pow(1.0 + 1.4 * khz * khz, F.lit(0.69))


def hearing_threshold(hz: Column) -> Column:
    """Threshold in quiet in decibels by Terhardt's formula; frequencies are held to 10 Hz and 18 kHz."""
    khz = F.least(F.greatest(hz / 1000.0, F.lit(0.01)), F.lit(18.0))
    return 3.64 * F.pow(khz, F.lit(-0.8)) - 6.5 * F.exp(-0.6 * F.pow(khz - 3.3, F.lit(2.0))) + 0.001 * F.pow(khz, F.lit(4.0))


def nearest_of(value: Column, table: tuple[int, ...]) -> Column:
    """Table entry nearest to value, the smaller one in a tie."""
    return F.array_min(F.transform(F.array(*[F.lit(t) for t in table]), lambda t: F.struct(F.abs(t - value).alias("d"), t.alias("t"))))["t"]


def gain(sample: Column, factor: Column) -> Column:
    return sample * factor


def gcd(a: Column, b: Column, steps: int = 24) -> Column:
    """Greatest common divisor by Euclid's steps; sample rates need far fewer than 24."""
    pair = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")),
        lambda p, _: F.when(p["b"] == 0, p).otherwise(F.struct(p["b"].alias("a"), (p["a"] % F.when(p["b"] == 0, 1).otherwise(p["b"])).alias("b"))),
    )
    return pair["a"]


def log2(x: Column) -> Column:
    return F.log2(x)


def scale_clip(x: Column) -> Column:
    """A sample of -1 .. 1 at 16-bit scale, clipped, not rounded."""
    return F.least(F.greatest(x * 32768.0, F.lit(-32768.0)), F.lit(32767.0))


def deinterleave(samples: Column, channels: int) -> Column:
    """Interleaved samples as an array for each channel; an incomplete last frame is left out."""
    last = F.floor(F.size(samples) / channels) - 1
    one = lambda c: F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.get(samples, (i * channels + c).cast("int")))
    return F.when(last < 0, F.array(*[F.array().cast("array<double>")] * channels)).otherwise(F.array(*[one(c) for c in range(channels)]))


def resampled_count(n: Column, up: Column, factor: Column) -> Column:
    """Frames that a filter gives for n frames, upsampled and then resampled by a factor."""
    return (n * up * factor).cast("long")


#: Codecs by their four letters.
CODECS = (
    ("EL31", "granule layer 3"), ("L32P", "granule layer 3 with PCM"), ("L32S", "granule layer 3 with spikes"), ("MP30", "MPEG layer 3"), ("P6B0", "PCM 16 big-endian"),
    ("P6L0", "PCM 16 little-endian"), ("Xas1", "XAS"),
)


def codec_id(letters: str) -> int:
    """Four letters as the 32-bit number that stands for a codec."""
    return int.from_bytes(letters.encode("ascii"), "big")


def codecs(spark) -> DataFrame:
    """Registry of codecs: number, letters and name."""
    return spark.createDataFrame([(codec_id(k), k, v) for k, v in CODECS], "codec_id long, letters string, codec string")


def with_codec(rows: DataFrame, registry: DataFrame, column: str) -> DataFrame:
    """rows with letters and name of the codec whose number is in the column; NULL for numbers without a codec."""
    return rows.join(F.broadcast(registry.withColumnRenamed("codec_id", column)), column, "left")  # a row for each codec


def granule_head(first: Column) -> dict[str, Column]:
    """First byte of a granule and the bit after it (16 bits): version, rate, mode, mode extension and which granule of its frame it is."""
    return {k: bits(first, 16, at, n) for k, at, n in (("version", 0, 2), ("rate", 2, 2), ("mode", 4, 2), ("extension", 6, 2), ("granule", 8, 1))}


def block_head(short: Column, long: Column) -> dict[str, Column]:
    """Header of a block with PCM: 16 bits, and 32 more where the block is extended. Offsets count from the block's start."""
    extended = bits(short, 16, 0, 1) == 1
    size = bits(short, 16, 4, 12)
    more = lambda at, n: F.when(extended, bits(long, 32, at, n)).otherwise(F.lit(0).cast("long"))
    channels, granule, pcm = bits(short, 16, 1, 1) + 1, F.when(extended, bits(long, 32, 22, 10)).otherwise(size - 2), more(12, 10)
    return {
        "extended": extended, "channels": channels, "size": size, "mode": more(0, 2), "offset_samples": more(2, 10), "pcm_samples": pcm, "granule_size": granule,
        "granule_at": F.when(~extended, F.lit(2).cast("long")).when(granule > 0, F.lit(6).cast("long")).otherwise(F.lit(0).cast("long")),
        "pcm_at": F.when(extended, 6 + granule).otherwise(F.lit(0).cast("long")), "pcm_bytes": pcm * channels * 2,
    }
