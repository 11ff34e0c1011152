"""Python Data Sources for asset files. `register(spark)` makes them available to spark.read and df.write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Data sources by the number of the format slot that they read.
DRIVERS = {1: "assetwave", 34: "assetmpeg", 35: "assetstream", 39: "assetplayer"}
#: Bytes of a file that the probes look at.
HEAD = 1 << 16


def register(spark: SparkSession) -> None:
    from .archive import ArchiveSource
    from .chunks import ChunkStreamSource
    from .folder import FolderSource
    from .mpeg import MpegSource
    from .player import PlayerSource
    from .wave import WaveSource

    for source in (ArchiveSource, WaveSource, ChunkStreamSource, PlayerSource, MpegSource, FolderSource):
        spark.dataSource.register(source)


def identify(spark: SparkSession, path: str) -> DataFrame:
    """Files below a path: path, format_id, source (the data source that reads them), score, and an error where no probe matches.

    The stream files of header/stream pairs count as companions of their headers and are left out where a header is there.
    """
    from ..operators import metadata

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.substring("content", 1, HEAD).alias("head"))
    stem = F.regexp_replace("path", r"\.[^./\\\\]*$", "")
    is_stream = F.lower("path").endswith(".sns")
    files = files.withColumn("stem", stem).withColumn("is_stream", is_stream)
    streams = files.where("is_stream").select("stem", F.lit(True).alias("other")).distinct()
    headers = files.where(F.lower("path").endswith(".snr")).select("stem", F.lit(True).alias("led")).distinct()
    rows = files.join(streams, "stem", "left").join(headers, "stem", "left").where("not (is_stream and coalesce(led, false))")
    found = metadata.sniff(rows, F.col("head"), F.col("path"), F.coalesce("other", F.lit(False)))
    names = F.create_map(*[F.lit(x) for kv in DRIVERS.items() for x in kv])
    error = F.when(F.col("format_id").isNull(), "no format matches")
    return found.select("path", "format_id", F.element_at(names, F.col("format_id")).alias("source"), "score", error.alias("error"))
