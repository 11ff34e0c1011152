"""Blocking of sample streams that arrive in chunks: whole blocks leave at once, the rest is carried as state."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "user_id long, blk long, n_valid long, samples array<double>"
STATE = "blk long, carried array<double>"
#: Columns by which the rows of a stream in one micro-batch are put in order.
ORDER = ["ts", "event_id"]


def _advance(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState, size: int) -> Iterator[pd.DataFrame]:
    """Emits the whole blocks of a stream. A row with `restart` set drops what is carried and begins at block 0; one with `flush` set fills the block with its last sample."""
    blk, carried = state.get if state.exists else (0, [])
    carried, done = list(carried), []
    rows = pd.concat(list(chunks)).sort_values(ORDER)
    for value, restart, flush in zip(rows["value"].tolist(), rows["restart"].tolist(), rows["flush"].tolist(), strict=True):
        if restart:
            blk, carried = 0, []
        carried.append(value)
        if len(carried) == size or flush:
            done.append((key[0], blk, len(carried), carried + carried[-1:] * (size - len(carried))))
            blk, carried = blk + 1, []
    state.update((blk, carried))
    yield pd.DataFrame(done, columns=["user_id", "blk", "n_valid", "samples"])


def blocks_of(samples: DataFrame, size: int) -> DataFrame:
    """A streaming DataFrame (user_id, ts, event_id, value, restart, flush) to its whole blocks."""
    return samples.groupBy("user_id").applyInPandasWithState(
        lambda k, it, s: _advance(k, it, s, size), OUT, STATE, "append", GroupStateTimeout.NoTimeout
    )


def _remove(spark: SparkSession, path: str) -> None:
    """Removes the stream's folder when the driver ends, if the session still runs."""
    sc = spark.sparkContext
    if sc._jsc is not None and not sc._jsc.sc().isStopped():
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def stream_blocks(spark: SparkSession, path: str, size: int) -> DataFrame:
    """Runs the file through a stream to its end and returns the blocks that were emitted for each user."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    rows = source.selectExpr("user_id", "ts", "event_id", "value", "false as restart", "false as flush")
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="reelquarry-")
    out = f"{base.rstrip('/')}/blocks-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, out)
    writer = blocks_of(rows, size).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUT).parquet(f"{out}/rows")
