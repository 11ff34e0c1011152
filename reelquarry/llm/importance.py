"""Quality selection by importance resampling.

Words and word pairs are hashed into 262,144 buckets. Two generative bag-of-n-grams models are counted in Spark: one of the target
(a sample, of about TARGET at most, of the documents labelled good and not toxic) and one of all raw texts. A document's log weight is the sum over its n-grams
of log p_target - log p_raw. Sampling without replacement by these weights is Gumbel top-k: the k documents with the largest
log weight plus Gumbel noise. The noise comes from a hash of id and text, so a rerun draws the same sample.

The k-th largest key is found without a sort, by histograms of the leading bits of the keys, four times 13 bits, each of
which only looks into the bucket where the k-th key lies. By default k is the number of documents times the share of
good labels among the labels.

Defined results: null and empty texts have no n-grams and log weight 0; without target documents all log weights are 0;
documents that tie with the k-th key are all kept; null ids and repeated rows are weighed like others, and equal
rows get equal noise. A document with several labels is good if all of them are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import aside, bound_batches, keep, spread

BITS = 18
SIZE = 1 << BITS
U = np.uint64
#: Labelled documents that the target model is counted on, on average at most: those whose ids have the smallest hashes.
TARGET, GRAIN = 20_000, 1 << 20
#: Words that are hashed at once, so that very long texts need no more memory.
STRETCH = 1 << 20


def buckets(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of the text's lower-case words and pairs of neighbours, a stretch at a time."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    with np.errstate(over="ignore"):
        for at in range(0, len(words), STRETCH):
            some = words[at : at + STRETCH + 1]  # one more for the last pair
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, some), U, len(some))
            pairs = (h[:-1] * U(0x9E3779B97F4A7C15) + h[1:]) * U(0xD6E8FEB86659FD93)
            yield (np.concatenate([h[:STRETCH], pairs[:STRETCH]]) >> U(64 - BITS)).astype(np.int64)


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SIZE, np.int64)
    for b in batches:
        found = [x for text in b.column(0) for x in buckets(text.as_py())]
        if found:
            total += np.bincount(np.concatenate(found), minlength=SIZE)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])


def model(texts: DataFrame) -> np.ndarray:
    """Smoothed log probabilities of the buckets."""
    found = texts.mapInArrow(_sum, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row for each bucket at most
    n = np.ones(SIZE)
    n[found["bucket"].to_numpy()] += found["n"].to_numpy()
    return np.log(n / n.sum())


def _weigh(batches: Iterator[pa.RecordBatch], ratio: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes, logs = [], []
        for text in b.column(0):
            found = [ratio[x] for x in buckets(text.as_py())]
            sizes.append(sum(map(len, found)))
            logs.append(float(sum(x.sum() for x in found)))
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(sizes, pa.int64()), pa.array(logs, pa.float64())], [*b.schema.names[1:], "n_ngrams", "log_weight"])


def good_ids(labels: DataFrame) -> DataFrame:
    """doc_ids of which every label is good and not toxic."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return labels.groupBy("doc_id").agg(F.min(F.coalesce(good, F.lit(False))).alias("good"))


def _ordered(key: Column) -> Column:
    """A double as a long of the same order, not negative: leading bits make the histogram."""
    # Keys are scaled to 2**-20 and clamped to 51 bits, far beyond any sum of log ratios; ties at this grain count as equal.
    return (F.greatest(F.lit(-(2.0**49)), F.least(F.lit(2.0**49), F.round(key * 2.0**20))) + 2.0**50).cast("long")


def kth_largest(rows: DataFrame, column: str, k: int) -> int:
    """The k-th largest value of a long column of 0 to 2**52, by histograms of 13 bits at a time."""
    prefix, left = 0, k
    for level in range(1, 5):
        shift = 52 - 13 * level
        inside = rows.where(F.shiftright(column, shift + 13) == prefix)
        bars = inside.groupBy(F.shiftright(column, shift).alias("b")).count().collect()  # 8,192 rows at most
        for r in sorted(bars, key=lambda r: -r.b):
            if r["count"] >= left:
                prefix = r.b
                break
            left -= r["count"]
        else:
            return 0
    return prefix


def select(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """docs with text replaced by n_ngrams, log_weight, gumbel_key and kept."""
    bound_batches(docs.sparkSession)
    judged = keep(good_ids(labels.where("doc_id is not null")), "labels")
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    raw = model(spread(texts.select("text")))
    n_good, n_judged = judged.agg(F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0)), F.count(F.lit(1))).first()
    share = int(min(1.0, TARGET / max(n_good, 1)) * GRAIN)
    few = judged.where(F.col("good") & (F.pmod(F.xxhash64("doc_id"), F.lit(GRAIN)) < share)).select("doc_id")
    target = model(texts.join(F.broadcast(few), "doc_id", "left_semi").select("text"))  # about TARGET ids at most, so no text moves
    ratio = docs.sparkSession.sparkContext.broadcast(target - raw if n_good else np.zeros(SIZE))  # a number for each bucket
    docs, names = aside(docs, "doc_id", "text")
    own = [new for c, new in names.items() if c not in ("text", "n_ngrams", "log_weight", "gumbel_key", "kept")]
    noise = F.xxhash64("doc_id", "text").alias("__noise")
    rows = docs.select(F.col("text").cast("string").alias("text"), *own, noise)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text"]
    weighed = spread(rows).mapInArrow(lambda it: _weigh(it, ratio.value), ", ".join([*fields, "n_ngrams long", "log_weight double"]))
    uniform = (F.shiftrightunsigned("__noise", 12) + F.lit(0.5)) / F.lit(2.0**52)
    keyed = keep(weighed.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform))).withColumn("__key", _ordered(F.col("gumbel_key"))), "weighed")
    n = keyed.count()
    k = min(n, k if k is not None else round(n * n_good / n_judged) if n_judged else n)
    last = kth_largest(keyed, "__key", k) if k else 1 << 60
    back = {new: c for c, new in names.items()}
    return keyed.select(*[F.col(new).alias(back[new]) for new in own], "n_ngrams", "log_weight", "gumbel_key", (F.col("__key") >= last).alias("kept"))


def op3_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """All documents weighed against those with good labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return select(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
