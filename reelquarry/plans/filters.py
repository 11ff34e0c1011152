"""Named, parameterised filters over sample streams, chained by DataFrame.transform, and the command line's argument form.

Streams are frames (asset_id, channel, n, sample) beside a table of sounds (asset_id, sample_rate, n_frames, ...). Filters
apply to all sounds of an asset.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metadata import LOCATIONS


@dataclass(frozen=True)
class Sounds:
    """Sound metadata and frames, which a filter changes together."""

    meta: DataFrame
    frames: DataFrame


@dataclass(frozen=True)
class Filter:
    """A filter's word, number, and parameters as (name, type, least, most). Types are int, float, str, or file_bytes for a file's content."""

    word: str
    number: int
    apply: Callable[..., Sounds]
    params: tuple[tuple[str, Callable, float | None, float | None], ...] = ()

    def parse(self, values: list[str]) -> dict:
        out = {}
        for (name, kind, low, high), text in zip(self.params, values, strict=True):
            value = kind(text)
            if (low is not None and value < low) or (high is not None and value > high):
                raise ValueError(f"{self.word}: {name} is not within {low} and {high}")
            out[name] = value
        return out


REGISTRY: dict[str, Filter] = {}
log = logging.getLogger("reelquarry")


def report(percent: int, word: str) -> None:
    """Default listener of a conversion's progress."""
    log.info("%d %%: %s", percent, word)


def register(f: Filter) -> Filter:
    if any(f.number == g.number and f.word != g.word for g in REGISTRY.values()):
        raise ValueError(f"number {f.number} is taken")
    REGISTRY[f.word] = f
    return f


def _quality(s: Sounds, quality: int) -> Sounds:
    return Sounds(s.meta.withColumn("quality", F.lit(quality)), s.frames)


def _location(s: Sounds, location: str) -> Sounds:
    if location not in LOCATIONS:
        raise ValueError(f"no location {location}")
    return Sounds(s.meta.withColumn("play_location", F.lit(LOCATIONS[location])), s.frames)


def file_bytes(path: str) -> bytes:
    """A parameter that names a file stands for its content."""
    from ..sources.files import read

    return read(path)


def _user_data(s: Sounds, blob: bytes) -> Sounds:
    """Appends a blob where fewer than four are there."""
    old = F.coalesce(F.col("user_data"), F.array().cast("array<binary>")) if "user_data" in s.meta.columns else F.array().cast("array<binary>")
    new = F.when(F.size(old) < 4, F.array_append(old, F.lit(bytearray(blob)))).otherwise(old)
    return Sounds(s.meta.withColumn("user_data", new), s.frames)


def _gain(s: Sounds, factor: float) -> Sounds:
    return Sounds(s.meta, s.frames.withColumn("sample", F.col("sample") * factor))


def _crop(s: Sounds, start: int, length: int) -> Sounds:
    """Frames start .. start + length - 1, with silence where there are none; loops outside are dropped."""
    keys = s.frames.select("asset_id", "channel").distinct()
    spine = keys.select("*", F.explode(F.sequence(F.lit(start).cast("long"), F.lit(start + length - 1).cast("long"))).alias("n"))
    frames = spine.join(s.frames, ["asset_id", "channel", "n"], "left")
    meta = s.meta.withColumn("n_frames", F.lit(length).cast("long"))
    if "loop_start" in meta.columns:
        inside = (F.col("loop_start") >= start) & (F.col("loop_end") < start + length)
        meta = meta.withColumns({c: F.when(inside, F.col(c) - start) for c in ("loop_start", "loop_end")})
    return Sounds(meta, frames.select("asset_id", "channel", (F.col("n") - start).alias("n"), F.coalesce("sample", F.lit(0.0)).alias("sample")))


def _resample(s: Sounds, rate: int) -> Sounds:
    from ..functions.codecs.frames import resample_streams
    from ..operators.ordered import running_sum

    keys = ["asset_id", "channel"]
    rows = s.frames.join(s.meta.select("asset_id", F.col("sample_rate").alias("__rate")), "asset_id")
    pieces = resample_streams(rows, keys, "sample", "__rate", rate).withColumns({"n": F.col("seg"), "size": F.size("samples").cast("long"), "stream": F.concat_ws(":", F.col("channel").cast("string"), F.col("asset_id").cast("string"))})
    placed = running_sum(pieces, "stream", "size", "upto")  # a piece begins where those before it end
    frames = placed.select(*keys, (F.col("upto") - F.col("size")).alias("start"), F.posexplode("samples").alias("i", "sample")).select(*keys, (F.col("start") + F.col("i")).alias("n"), "sample")
    counts = frames.where("channel = 0").groupBy("asset_id").agg(F.count(F.lit(1)).alias("n_frames"))
    return Sounds(s.meta.drop("n_frames").join(counts, "asset_id", "left").withColumn("sample_rate", F.lit(rate)), frames)


register(Filter("quality", 44, _quality, (("quality", int, 0, 100),)))
register(Filter("playloc", 50, _location, (("location", str, None, None),)))
register(Filter("userdata", 92, _user_data, (("blob", file_bytes, None, None),)))
register(Filter("gain", 200, _gain, (("factor", float, -1000.0, 1000.0),)))
register(Filter("resample", 120, _resample, (("rate", int, 1, 200_000),)))
register(Filter("crop", 150, _crop, (("start", int, None, None), ("length", int, 1, None))))


@dataclass
class Conversion:
    """A conversion as parsed from arguments."""

    source: str | None = None
    target: str | None = None
    filters: list[tuple[Filter, dict]] = field(default_factory=list)

    def run(self, sounds: Sounds, progress: Callable[[int, str], None] | None = None) -> Sounds:
        """Applies the filters in order; `progress` hears the percentage planned and the filter's word. Rows are counted by Spark, once an action runs."""
        for i, (f, values) in enumerate(self.filters, 1):
            sounds = f.apply(sounds, **values)
            (progress or report)(100 * i // len(self.filters), f.word)
        return sounds


def parse_arguments(arguments: list[str]) -> Conversion:
    """`-in path -out path -word values...`; unknown words are refused."""
    out, rest = Conversion(), list(arguments)
    while rest:
        word = rest.pop(0).lstrip("-")
        if word in ("in", "out"):
            if not rest:
                raise ValueError(f"-{word} lacks a path")
            setattr(out, "source" if word == "in" else "target", rest.pop(0))
        elif word in REGISTRY:
            f = REGISTRY[word]
            if len(rest) < len(f.params):
                raise ValueError(f"{word} takes {len(f.params)} values")
            out.filters.append((f, f.parse([rest.pop(0) for _ in f.params])))
        else:
            raise ValueError(f"no filter {word}")
    return out
