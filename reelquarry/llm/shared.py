"""Tables kept in the folder that driver and executors share, and small session helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set, a local master gets a folder of this machine; on a cluster that is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="reelquarry-"))
        found = sc.getCheckpointDir()
    return found


#: Folders made and not yet removed.
_folders: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one, removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _folders.append(path)
    atexit.register(remove_folder, spark, path)
    return path


def folders() -> int:
    """A mark for `settle`."""
    return len(_folders)


def settle(df: DataFrame, name: str, mark: int) -> DataFrame:
    """Like keep; then the folders made since the mark are removed, as nothing but df needed them."""
    out = keep(df, name)
    done, _folders[mark:] = _folders[mark:-1], _folders[-1:]
    for path in done:
        remove_folder(df.sparkSession, path)
    return out


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder through Hadoop's file system; a session that has ended is no error."""
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: the plan behind it is cut, lost executors lose nothing."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def aside(docs: DataFrame, *needed: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with all columns but the needed ones renamed, so that no working column meets them, and the new name of each of docs' columns."""
    names = {c: c if c in needed else f"__own{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


#: Rows of one key that a join leaves to one task, and keys of more rows that are broadcast at most; more of these are joined.
SPREAD, HOT_KEYS = 512, 200_000


def hot_keys(counts: DataFrame, on: str) -> DataFrame | None:
    """Keys (on, __ways) with more than SPREAD rows and the tasks that share them, from counts (on, m); None if there is none."""
    hot = keep(counts.where(F.col("m") > SPREAD).select(on, F.ceil(F.col("m") / SPREAD).cast("int").alias("__ways")), "hot-keys")
    n = hot.count()
    return None if not n else F.broadcast(hot) if n <= HOT_KEYS else hot


def spread_join(left: DataFrame, right: DataFrame, on: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """left joined with right, which has few rows for a key, by the column `on`; keys in hot are dealt over several tasks.

    A hot key's rows on the right are copied for each of its tasks, so there are fewer copies than rows of left / SPREAD.
    Null keys match nothing.
    """
    if hot is None:
        return left.join(right, on, how)
    dealt = F.pmod(F.xxhash64(*left.columns), F.coalesce("__ways", F.lit(1))).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__ways"), F.lit(1)) - 1))
    salted = left.join(hot, on, "left").withColumn("__salt", dealt).drop("__ways")
    return salted.join(right.join(hot, on, "left").withColumn("__salt", copies).drop("__ways"), [on, "__salt"], how).drop("__salt")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where a small input comes in fewer partitions than there are, for work in Python; a large input stays where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Bytes and rows of one Arrow batch that Python workers get; a batch holds at least one whole row.
BATCH_BYTES, BATCH_ROWS = 16 << 20, 2000


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch limits where they are higher, so that batches of long texts fit a worker. Results don't depend on them."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = spark.conf.get(key, None) or "0"
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
