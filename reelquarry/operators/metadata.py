"""Queries over metadata: sniffing, capabilities, validation, pairing, tags, defaults."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.binary import be_uint, bits, le_uint

#: Encodings by number.
ENCODINGS = {0: "s16l_int", 1: "s16b_int", 10: "eaxa_blk", 11: "u8_int", 29: "xas_int", 30: "ealayer3_int", 31: "ealayer3pcm_int", 32: "ealayer3spike_int"}
#: Playback locations by name, as bits.
LOCATIONS = {"default": 0, "maincpu": 4, "spu": 8, "ds3dhw": 16, "iopcpu": 256, "dsp": 512, "ds2dhw": 1024, "ram": 2048, "stream": 4096, "gigasample": 8192}
#: Format slots with their words, channel limits, encodings that they read and write, and bits of the playback locations.
#: 24-bit samples are read by wave files under the number 19.
FORMATS = (
    (1, "wave", 64, (19, 0, 11), (0, 11), 0), (34, "mpeg", 2, (16,), (), 0), (35, "sndstream", 6, (10,), (10,), 0), (39, "sndplayer", 64, (29, 30, 1, 31, 32), (29, 1, 30, 31, 32), 14336),
)
FORMAT_SCHEMA = "format_id int, word string, max_channels int, import_enc array<int>, export_enc array<int>, locations int"
#: What a sound is before anything says otherwise.
DEFAULTS = {
    "velmax": 127, "keymax": 127, "keybase": 60, "pan": 64, "panmult": 1, "vol": 127, "numenvelopes": 1, "releaseenvelope": -1, "initialenvelopevol": 127, "bend": 64,
    "samplerep": -1, "truncateloops": 1, "sustainstart": -1, "sustainend": -1, "bitrate": 50,
}


def formats(spark) -> DataFrame:
    """The capability table: a row for each format that has a driver."""
    return spark.createDataFrame([(i, w, n, list(a), list(b), p) for i, w, n, a, b, p in FORMATS], FORMAT_SCHEMA)


def _lookup(value: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value)


def encoding_name(encoding: Column) -> Column:
    """Name of an encoding's number; NULL for a number without one, Unknown outside the table."""
    return F.when(encoding.between(0, 32), _lookup(encoding, ENCODINGS)).otherwise("Unknown")


def encoding_id(name: Column) -> Column:
    return _lookup(name, {v: k for k, v in ENCODINGS.items()})


def codec_version(platform: Column, version: Column, encoding: Column) -> Column:
    """Version of the block codec that a platform's version asks for; 0 for other encodings."""
    newer = F.when(platform.isin(5, 6, 7, 8), version > 2).when(platform == 0, version > 1).otherwise(platform.isin(9, 10, 14))
    return F.when(encoding.isin(4, 10, 22) & newer, 1).otherwise(0)


def location_supported(location: Column, supported: Column) -> Column:
    """Whether a format with these location bits can place a sound there; formats with one location or none take any."""
    several = F.bit_count(supported) > 1
    return ~several | (location.bitwiseAND(F.bitwise_not(supported)).bitwiseAND(F.lit(sum(LOCATIONS.values()))) == 0)


def _fmt_tag(head: Column) -> Column:
    """Format tag of the first `fmt ` chunk of a RIFF file; NULL where there is none."""
    size = F.octet_length(head)
    at = F.aggregate(
        F.sequence(F.lit(0), F.floor(size / 8).cast("int")), F.lit(12).cast("long"),
        lambda p, _: F.when((p + 8 > size) | (F.substring(head, (p + 1).cast("int"), F.lit(4)) == F.lit(b"fmt ")), p).otherwise(p + 8 + F.coalesce(le_uint(head, (p + 4).cast("int"), 4), F.lit(0))),
    )
    fits = (F.substring(head, (at + 1).cast("int"), F.lit(4)) == F.lit(b"fmt ")) & (at < 2**31 - 64)
    return F.when(fits, le_uint(head, (at + 8).cast("int"), 2))


def player_header(head: Column) -> Column:
    """Fields of a packed player header as a struct, with `valid`."""
    first, second = be_uint(head, 0, 4), be_uint(head, 4, 4)
    rate, codec, play = bits(first, 32, 14, 18), bits(first, 32, 4, 4), bits(second, 32, 0, 2)
    looped, n = bits(second, 32, 2, 1) == 1, bits(second, 32, 3, 29)
    loop_start = F.when(looped, be_uint(head, 8, 4))
    after = F.when(looped, 12).otherwise(8)
    resident = F.when(play == 2, be_uint(head, after, 4))
    has_offset = looped & ((play == 1) | ((play == 2) & (loop_start >= resident)))
    offset = F.when(has_offset, be_uint(head, after + F.when(play == 2, 4).otherwise(0), 4))
    valid = (bits(first, 32, 0, 4) == 0) & (codec <= 7) & (rate > 0) & (play <= 2) & (~looped | (loop_start < n)) & ((play != 2) | resident.isNotNull()) & (~has_offset | (offset < 0x40000000))
    return F.struct(
        F.coalesce(valid, F.lit(False)).alias("valid"), codec.alias("codec"), (bits(first, 32, 8, 6) + 1).alias("channels"), rate.alias("sample_rate"), play.alias("play_type"),
        n.alias("n_frames"), loop_start.alias("loop_start"), resident.alias("resident"),
    )


@F.pandas_udf(T.LongType())
def mpeg_sync(content: pd.Series) -> pd.Series:
    """First place of seven frame headers in a row; -1 for none."""
    from ..sources.mpeg import strict_sync

    return pd.Series([-1 if x is None else strict_sync(bytes(x)) for x in content], dtype="int64")


def scores(head: Column, name: Column, has_companion: Column) -> Column:
    """Probe results as an array of (score, -order, format_id); a greater score wins, then the earlier driver."""
    part = lambda a, n: F.substring(head, a, n)
    wave = F.when((part(1, 4) == F.lit(b"RIFF")) & (part(9, 4) == F.lit(b"WAVE")) & _fmt_tag(head).isin(1, 65534), 100).otherwise(0)
    stream = F.when((F.octet_length(head) >= 50) & (part(1, 4) == F.lit(b"GSTR")), 100).otherwise(0)
    h = player_header(head)
    missing = ~has_companion & ((h["play_type"] == 1) | ((h["play_type"] == 2) & (h["resident"] < h["n_frames"])))
    player = F.when(~h["valid"] | missing, 0).when(name.endswith(".snr"), 90).otherwise(50)
    probe = lambda s, k, i: F.struct(F.coalesce(s, F.lit(0)).alias("score"), F.lit(-k).alias("later"), F.lit(i).alias("format_id"))
    return F.array(probe(wave, 0, 1), probe(stream, 1, 35), probe(player, 2, 39))


def sniff(files: DataFrame, head: Column, name: Column, has_companion: Column) -> DataFrame:
    """files with the best format and its score; NULL and 0 where no probe matches. The scan for MPEG frames only runs where no other probe is sure."""
    found = files.withColumn("__b", F.array_max(scores(head, name, has_companion)))
    found = found.withColumn("__m", mpeg_sync(F.when(F.col("__b.score") < 100, head)))
    mpeg = (F.col("__m") >= 0) & (F.col("__b.score") < 75)
    score = F.when(mpeg, 75).otherwise(F.col("__b.score"))
    return found.withColumns({"score": score, "format_id": F.when(mpeg, 34).when(F.col("__b.score") > 0, F.col("__b.format_id"))}).drop("__b", "__m")


#: Rates to which a sound of an encoding has to be brought or held.
LAYER12_RATES, LAYER2_RATES = (32000, 44100, 48000), (16000, 22050, 24000, 32000, 44100, 48000)


def validate_export(sounds: DataFrame, table: DataFrame) -> DataFrame:
    """sounds with the first export rule that fails as `error`, in the order in which an exporter asks them.

    sounds: format_id, encoding, channels, rate, n_frames, bitrate, location, loop_start, loop_end (-1 for none), sideband.
    """
    names = ["max_channels", "export_enc", "locations"]
    joined = sounds.join(F.broadcast(table.select("format_id", *names)), "format_id", "left")  # 52 slots at most
    start, end, n = F.col("loop_start"), F.col("loop_end"), F.col("n_frames")
    rules = (
        ("format", F.col("max_channels").isNull()), ("rate", F.col("rate") <= 0), ("channels", F.col("channels") <= 0), ("length", n < 0), ("bitrate", F.col("bitrate") < 0),
        ("max channels", F.col("channels") > F.col("max_channels")), ("encoding", ~F.array_contains("export_enc", F.col("encoding"))), ("location", ~location_supported(F.col("location"), F.col("locations"))),
        ("layer 1/2 rate", (F.col("encoding") == 14) & ~F.col("rate").isin(*LAYER12_RATES)), ("layer 2 rate", (F.col("encoding") == 15) & ~F.col("rate").isin(*LAYER2_RATES)),
        ("only loop start", (start >= 0) & (end < 0)), ("only loop end", (end >= 0) & (start < 0)), ("loop end past samples", (end >= 0) & (end >= n)), ("loop start after end", (start >= 0) & (end >= 0) & (start > end)),
        ("time stretch with loop", (start >= 0) & (end >= 0) & (F.col("sideband") > 0)), ("time stretch of several channels", (F.col("sideband") > 0) & (F.col("channels") >= 2)),
    )
    error = reduce(lambda e, rule: F.when(rule[1], rule[0]).otherwise(e), reversed(rules), F.lit(None).cast("string"))
    return joined.withColumn("error", error).drop(*names)


def bad_markers(markers: DataFrame, sounds: DataFrame, key: str) -> DataFrame:
    """Markers (key, position) outside their sound (key, n_frames); these only call for a warning."""
    return markers.join(sounds.select(key, "n_frames"), key).where((F.col("position") > F.col("n_frames")) | (F.col("position") < 0))


def clip_markers(markers: DataFrame, start: int, length: int) -> DataFrame:
    """Markers (position, ...) after a crop to [start, start + length): those inside, moved by start.

    With a start of 0 or more both ends are inside; with silence before the sound, the end isn't.
    """
    position = F.col("position")
    if start + length <= 0:
        inside = F.lit(False)
    else:
        inside = position.between(start, start + length) if start >= 0 else position < start + length
    return markers.where(inside).withColumn("position", position - start)


def pair(headers: DataFrame, streams: DataFrame, stem: str) -> DataFrame:
    """headers with the totals of their stream chunks and whether they have any."""
    totals = streams.groupBy(stem).agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n_bytes").alias("n_bytes"), F.max("seq").alias("last_seq"))
    return headers.join(totals, stem, "left").withColumn("complete", F.col("n_chunks").isNotNull())


def tag_overlay(defaults: dict[str, str], tags: Column) -> Column:
    """Defaults overridden by sparse tags: one map, the tags' values first."""
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    own = F.coalesce(tags, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k)), own)
