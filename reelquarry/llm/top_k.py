"""Exact top-k search by inner product with norm buckets.

Vectors are grouped by length into buckets at quantiles of the length, longest first, and buckets into blocks of bounded
size. The longest bucket is searched first and gives each query a score that its k-th best can't fall below.
A bucket is met only by queries whose score bound |q| |p| reaches that score; in it the bound turns into a local
cosine threshold. High thresholds prune by a coordinate (the query's largest one has to lie in an interval), low ones by
length (a prefix of the block in order of length). What is left is verified by integer products.

Queries are met in blocks as well, so tasks stay bounded; each block returns k rows per query at most. For the
buckets after the longest one, queries that reach equally many buckets share blocks, and candidates are only copied for blocks of
queries that reach their bucket.

Defined results: vectors that are null or hold a null or a non-finite component take no part; so do rows with null ids.
Empty vectors score 0 with all. Components that one of two vectors lacks count as 0. Repeated rows are candidates as often as
they are there; of a query id with several rows the one with the smallest encoding is the query. Queries without
any candidate have no rows. Scores are compared exactly, whatever their size; one beyond a long is returned as the
long next to it. Ids are cast to long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import keep

SCALE, K = 1024, 10
#: Lengths at which vectors are grouped at most; rows of a block of candidates and of queries.
BUCKETS, BLOCK, QUERY_BLOCK = 32, 4096, 4096
#: Local cosine threshold from which a coordinate prunes more than the length.
COORDINATE_FROM = 0.4
SLACK = 1e-9
LOWEST, HIGHEST = -(2**63), 2**63 - 1
#: From here on a double times SCALE is whole already.
WHOLE = 2.0**43
RESULT = "query_id long, vec_id long, score long, beyond binary"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as doubles floor(SCALE * x) / SCALE, which are exact, with their length times SCALE and a running number to deal them by."""
    nth = 0
    for b in batches:
        ids, norms, vectors = [], [], []
        for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if i is None or x is None or None in x:
                continue
            v = np.array(x, np.float64)
            if np.isfinite(v).all():
                small = np.abs(v) < WHOLE
                v[small] = np.floor(v[small] * SCALE) / SCALE
                ids.append(i)
                norms.append(_length(v))
                vectors.append(v.astype("<f8").tobytes())
        dealt = np.arange(nth, nth + len(ids))
        nth += len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(norms, pa.float64()), pa.array(dealt, pa.int64()), pa.array(vectors, pa.binary())], ["vec_id", "norm", "nth", "v"])


def _length(v: np.ndarray) -> float:
    """Length times SCALE; infinite beyond the doubles, which prunes nothing."""
    most = float(np.abs(v).max(initial=0.0))
    with np.errstate(over="ignore"):
        return float(np.sqrt(((v / most) ** 2).sum()) * most * SCALE) if most else 0.0


def _matrix(blobs: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(blobs), width))
    for row, x in zip(out, blobs, strict=True):
        row[: len(x) // 8] = np.frombuffer(x, "<f8")
    return out


def _products(p: np.ndarray, q: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of the rows of p with q, both times SCALE; Python's integers where a long might not hold them."""
    if bound < 2.0**52:
        return ((p * SCALE) @ (q * SCALE)).astype(np.int64)
    if bound < 2.0**62 and max(np.abs(p).max(initial=0), np.abs(q).max(initial=0)) < 2.0**52:
        return (p * SCALE).astype(np.int64) @ (q * SCALE).astype(np.int64)
    whole = np.frompyfunc(lambda x: int(x * SCALE) if abs(x) < WHOLE else int(x) * SCALE, 1, 1)
    return whole(p) @ whole(q) if len(q) else np.zeros(len(p), object)


def _beyond(score: int) -> bytes:
    """Orders scores that are returned as the same long."""
    if LOWEST <= score <= HIGHEST:
        return b"\x01"
    size = (abs(score).bit_length() + 7) // 8
    text = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return b"\x02" + text if score > 0 else b"\x00" + bytes(255 - x for x in text)


def _search(queries: pa.Table, block: pa.Table, k: int) -> pa.Table:
    """The k best candidates of the block for each query that can still be among its k best."""
    out: list[tuple] = []
    if queries.num_rows and block.num_rows:
        blobs = block["v"].to_pylist()
        asked = queries["v"].to_pylist()
        width = max(map(len, blobs + asked)) // 8
        norm = block["norm"].to_numpy()
        order = np.argsort(-norm, kind="stable")
        norm, ids, p = norm[order], block["vec_id"].to_numpy()[order], _matrix([blobs[i] for i in order], width)
        with np.errstate(over="ignore", invalid="ignore"):
            unit = p / np.maximum(norm / SCALE, 1e-300)[:, None]
        for qid, floor, length, q in zip(queries["query_id"].to_pylist(), queries["floor"].to_pylist(), queries["norm"].to_pylist(), _matrix(asked, width), strict=True):
            some = np.arange(len(norm))
            if floor is not None and floor > 0 and length > 0:
                local = floor / (length * max(norm[0], 1e-300)) - SLACK
                if local > 1:
                    continue
                if local >= COORDINATE_FROM:
                    f = int(np.abs(q).argmax())
                    x = q[f] / (length / SCALE)
                    reach = np.sqrt(max(1 - x * x, 0.0) * (1 - local * local)) + SLACK
                    high = 1.0 if local <= x else x * local + reach  # beyond the threshold's cone the bound isn't x * local
                    low = -1.0 if local <= -x else x * local - reach
                    some = np.flatnonzero((unit[:, f] >= low - SLACK) & (unit[:, f] <= high + SLACK))
                else:
                    some = some[: np.searchsorted(-norm, -floor / length * (1 - SLACK), side="right")]
            some = some[ids[some] != qid]
            if len(some):
                s = _products(p[some], q, float(norm[0] * length))
                if floor is not None and floor > LOWEST:
                    some, s = some[s >= floor], s[s >= floor]
                if s.dtype == object:
                    best = sorted(range(len(s)), key=lambda i: (-s[i], ids[some[i]]))[:k]
                else:
                    best = np.lexsort((ids[some], -s))[:k]
                out += [(qid, int(ids[some[i]]), min(max(int(s[i]), LOWEST), HIGHEST), _beyond(int(s[i]))) for i in best]
    a, b, c, d = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.int64()), "beyond": pa.array(d, pa.binary())})


def _meet(queries: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    keys = ["bucket", "block", "part"]
    return queries.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(lambda q, b: _search(q, b, k), RESULT)


def _best(rows: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("beyond").desc(), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """vectors (vec_id, embedding) to query_id, rank, vec_id, score for the rows where is_query holds."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    data = keep(rows.mapInArrow(_encode, "vec_id long, norm double, nth long, v binary"), "vectors")
    asked = keep(data.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("v", "norm")).alias("x")).select("query_id", "x.*"), "queries")
    total, n_queries = data.count(), asked.count()
    if not total or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n = min(BUCKETS, -(-total // BLOCK))
    cuts = data.select(F.percentile_approx("norm", [1 - i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else []
    bucket = F.lit(0)
    for c in cuts or []:  # at most 31 lengths
        bucket = bucket + (F.col("norm") < c).cast("int")
    placed = data.withColumn("bucket", bucket)
    sizes = placed.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"), F.max("norm").alias("longest"))
    sizes = sorted(sizes.collect(), key=lambda r: r.bucket)  # a row for each bucket, 32 at most, longest first
    blocks_of = lambda values: F.element_at(F.create_map(*[F.lit(int(x)) for kv in values.items() for x in kv]), F.col("bucket"))
    blocks = placed.withColumn("block", F.pmod("nth", blocks_of({r.bucket: r.n for r in sizes})).cast("int"))
    parts = -(-n_queries // QUERY_BLOCK)
    first, others = sizes[0], sizes[1:]
    dealt = F.xxhash64("query_id")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    to_first = asked.select(F.lit(first.bucket).alias("bucket"), each(F.lit(first.n)).alias("block"), F.pmod(dealt, F.lit(parts)).cast("int").alias("part"), "query_id", "norm", "v", F.lit(None).cast("long").alias("floor"))
    longest = blocks.where(F.col("bucket") == first.bucket).select("bucket", "block", each(F.lit(parts)).alias("part"), "vec_id", "norm", "v")
    seeds = keep(_best(_meet(to_first, longest, k), k), "seeds")
    final = lambda rows: _best(rows, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    if not others:
        return final(seeds.drop("rank"))
    floors = seeds.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    reach = F.lit(0)  # buckets are in order of length, so a query reaches the first ones
    for r in others:
        bound = F.col("norm") * F.lit(r.longest) * (1 + SLACK) >= F.col("floor")
        reach = reach + (F.col("floor").isNull() | bound | F.isnan(F.col("norm") * F.lit(r.longest))).cast("int")
    known = keep(asked.join(floors, "query_id", "left").withColumn("reach", reach).where("reach > 0"), "reach")
    # Parts of queries with a longer reach come first, so a bucket meets the first parts up to its own number.
    offset, upto, start = {}, {}, 0
    for r in sorted(known.groupBy("reach").count().collect(), key=lambda r: -r.reach):  # a row for each bucket at most
        offset[r.reach] = (start, -(-r["count"] // QUERY_BLOCK))
        start += offset[r.reach][1]
    for at, r in enumerate(others, 1):
        upto[r.bucket] = sum(n for reached, (_, n) in offset.items() if reached >= at)
    met = {b: n for b, n in upto.items() if n}
    if not met:
        return final(seeds.drop("rank"))
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for reached, v in offset.items() for x in (reached, v[i])]), F.col("reach"))
    part = (pick(0) + F.pmod(dealt, pick(1))).cast("int").alias("part")
    reached = F.slice(F.array(*[F.struct(F.lit(r.bucket).alias("bucket"), F.lit(r.n).alias("n")) for r in others]), 1, F.col("reach"))
    to_rest = known.select(part, "query_id", "norm", "v", "floor", F.explode(reached).alias("x")).select("x.bucket", each(F.col("x.n")).alias("block"), "part", "query_id", "norm", "v", "floor")
    rest = blocks.where(F.col("bucket").isin(*met)).select("bucket", "block", each(blocks_of(met)).alias("part"), "vec_id", "norm", "v")
    return final(seeds.drop("rank").unionByName(_meet(to_rest, rest, k)))


def op8_exact_top_k(spark, sf_dir: str) -> DataFrame:
    """Contract query: every hundredth id against all rows."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
