"""Near-duplicate groups with b-bit MinHash.

A document's set is its distinct 5-word shingles. Workers take 128 minima of each set, keep 4 low bits of each
in packed bit planes, and hash the minima in 32 bands of 4 rows. Documents that share a band are candidates; the
similarity of candidates is estimated from the count of equal b-bit values, corrected for chance collisions.
Candidates whose estimate could belong to a pair over the threshold are confirmed on their full sets.

Equal sets are one node from the start. To avoid all pairs of a large group, a round of stars comes first: in each
bucket every node meets one centre, drawn at random by bucket, and confirmed links merge labels. What remains
is exact: in buckets that still hold more than one label, all pairs of different labels are met, so no candidate
pair is left out by the stars. Small buckets are joined with themselves. Large ones meet in blocks of bounded size,
where a worker counts common shingles of whole blocks at once on the full sets, so that every pair it finds is a
link; one link between two labels is returned instead of all pairs, as more would merge nothing else.

A pair at the threshold is missed by banding with probability (1 - 0.75**4)**32 = 5e-6 and by the estimate with
about 1e-7; both fall fast as similarity rises.

Defined results: texts that are null or hold no words have the empty set and link with nothing; rows with a null
id have a null component and are kept; repeated rows share one component, and each row is returned. A
repeated id with different texts counts as one document of both texts. Very long texts are read whole. Ids are cast to long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import bound_batches, hot_keys, keep, spread, spread_join

PERMUTATIONS, BANDS, PLANES, WIDTH = 128, 32, 4, 5
ROWS = PERMUTATIONS // BANDS
#: Nodes up to which a bucket is joined with itself, and nodes of a block of a larger one.
SMALL, BLOCK = 48, 2048
U = np.uint64
_RNG = np.random.RandomState(7)
MULTIPLY = (_RNG.randint(0, 1 << 31, PERMUTATIONS).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
ADD = _RNG.randint(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, in place."""
    x ^= x >> U(33)
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; of its whole word sequence if that is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, n)
    k = min(n, width)
    with np.errstate(over="ignore"):
        s = h[: n - k + 1] + U(k)
        for i in range(1, k):
            s = mix(s * U(0x9E3779B97F4A7C15) + h[i : n - k + 1 + i])
        return np.unique(mix(s))


def minima(found: np.ndarray) -> np.ndarray:
    """The 128 minima of a set of hashes, as mixed 32-bit values."""
    x = (found >> U(32)).astype(np.uint32)
    out = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(x), 2048):
            h = np.multiply.outer(MULTIPLY, x[at : at + 2048])
            h += ADD[:, None]
            np.minimum(out, h.min(axis=1), out=out)
        out ^= out >> np.uint32(16)
        out *= np.uint32(0x85EBCA6B)
        out ^= out >> np.uint32(13)
        out *= np.uint32(0xC2B2AE35)
        out ^= out >> np.uint32(16)
    return out


def band_hashes(m: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = np.arange(1, BANDS + 1, dtype=U) * U(0x9E3779B97F4A7C15)
        for col in m.reshape(BANDS, ROWS).T:
            key = mix(key * U(0xD6E8FEB86659FD93) + col.astype(U) + U(1))
    return key.view(np.int64)


def bit_planes(m: np.ndarray) -> np.ndarray:
    """Low bits of the minima: plane j holds bit j of all of them, in two longs."""
    bits = (m[None, :] >> np.arange(PLANES, dtype=np.uint32)[:, None]) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8), axis=1).reshape(-1).view(np.int64)


LONGS = PLANES * PERMUTATIONS // 64


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes, his, los, bands, planes = [], [], [], [], []
        for text in b.column(1):
            found = shingles(text.as_py())
            sizes.append(len(found))
            if len(found):
                digest = xxhash.xxh3_128_intdigest(found.tobytes())
                m = minima(found)
                his.append((digest >> 64) - (1 << 63))
                los.append((digest & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
                bands.append(band_hashes(m))
                planes.append(bit_planes(m))
            else:
                his.append(None)
                los.append(None)
        full = np.array([bool(n) for n in sizes], bool)
        offset = lambda k: pa.array(np.concatenate([[0], np.cumsum(full * k)]).astype(np.int32))
        flat = lambda x: pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(sizes, pa.int64()), pa.array(his, pa.int64()), pa.array(los, pa.int64()),
             pa.ListArray.from_arrays(offset(BANDS), flat(bands)), pa.ListArray.from_arrays(offset(LONGS), flat(planes))],
            ["doc_id", "n_shingles", "hi", "lo", "bands", "planes"],
        )


def _similar(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, text_a, text_b) whose sets are similar enough; the set of a row's b serves the next rows of the same b."""
    last: tuple = (None, None, None)
    for batch in batches:
        good = []
        for i in range(batch.num_rows):
            b, text_b = batch.column(1)[i].as_py(), batch.column(3)[i].as_py()
            if last[0] != b or last[1] != text_b:
                last = (b, text_b, shingles(text_b))
            x, y = shingles(batch.column(2)[i].as_py()), last[2]
            common = len(np.intersect1d(x, y, assume_unique=True))
            good.append(bool(common) and 100 * common >= percent * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def least_matches(percent: int, sigmas: float = 5.3) -> int:
    """Equal b-bit values that a pair at the threshold has with all but negligible probability."""
    p = percent / 100 + (1 - percent / 100) * 0.5**PLANES
    return int(PERMUTATIONS * p - sigmas * (PERMUTATIONS * p * (1 - p)) ** 0.5)


def matches(x: Column, y: Column) -> Column:
    """Number of equal b-bit values by bit counts over the planes."""
    half = PERMUTATIONS // 64
    out = F.lit(PERMUTATIONS)
    for k in range(half):
        differ = F.lit(0).cast("long")
        for j in range(PLANES):
            differ = differ.bitwiseOR(F.get(x, F.lit(j * half + k)).bitwiseXOR(F.get(y, F.lit(j * half + k))))
        out = out - F.bit_count(differ)
    return out


def estimate(count: Column) -> Column:
    """Similarity from the number of equal b-bit values, corrected for chance collisions."""
    chance = 0.5**PLANES
    return F.greatest(F.lit(0.0), (count / PERMUTATIONS - chance) / (1 - chance))


def _confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b), with few rows for an a, that are similar on their full sets."""
    found = keep(pairs.select("a", "b"), "pairs")
    hot = hot_keys(found.groupBy("b").agg(F.count(F.lit(1)).alias("m")), "b")
    left = found.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    joined = spread_join(left, texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b", hot).select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(lambda it: _similar(it, percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs (doc_id, text, ...) to one row per input row: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    raw = keep(
        spread(texts).mapInArrow(_sketches, "doc_id long, n_shingles long, hi long, lo long, bands array<long>, planes array<long>"),
        "sketches",
    )
    known = raw.where("n_shingles > 0 and doc_id is not null")
    sets = keep(known.groupBy("hi", "lo").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("m")), "sets")
    with_set = raw.where("hi is not null").select("doc_id", "n_shingles", "hi", "lo")
    same = spread_join(with_set, sets.select("hi", F.col("lo").alias("l"), "node"), "hi", hot_keys(sets.groupBy("hi").agg(F.sum("m").alias("m")), "hi"), "left")
    # Rows with a null id may have a set of their own; two sets with one `hi` differ in `lo`.
    alone = F.lit(None).cast("long").alias("node")
    of_set = same.where("l = lo or l is null").select("doc_id", "n_shingles", "node").unionByName(raw.where("hi is null").select("doc_id", "n_shingles", alone))
    of_set = keep(of_set, "nodes")
    nodes = known.join(sets.select(F.col("node").alias("doc_id"), "hi", "lo"), ["doc_id", "hi", "lo"])
    nodes = keep(nodes.select(F.col("doc_id").alias("node"), "bands", "planes").dropDuplicates(["node", "planes"]), "distinct")
    labels = _link(texts, nodes, percent)
    named = spread_join(of_set, labels, "node", hot_keys(of_set.groupBy("node").agg(F.count(F.lit(1)).alias("m")), "node"), "left")
    component = F.coalesce("label", "node", "doc_id")
    return named.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def _link(texts: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(node, label) of the nodes that have a candidate."""
    least = least_matches(percent)
    entries = nodes.select("node", F.explode("bands").alias("key"))
    order = F.xxhash64("node", "key")
    counts = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min_by("node", order).alias("c")).where("n > 1")
    counts = keep(counts, "buckets")
    hot = hot_keys(counts.withColumnRenamed("n", "m"), "key")
    entries = keep(spread_join(entries, counts, "key", hot), "entries")
    known = entries.select("node").distinct()
    some = keep(texts.join(known.select(F.col("node").alias("doc_id")), "doc_id"), "texts")
    planes = nodes.select("node", "planes")
    met = entries.where("node <> c").select(F.col("node").alias("a"), F.col("c").alias("b")).distinct()
    best = _scored(met, planes, least).groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("m", "b")), asc=False), 1, 2).alias("x"))
    stars = best.select("a", F.explode("x").alias("x")).select("a", "x.b")
    joined = components(keep(_confirm(stars, some, percent), "links"))
    labels = keep(known.join(joined, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "all-labels")
    left = _mixed(entries, labels, planes, hot)
    more = keep(_confirm(_small(left, least), some, percent).unionByName(_large(left, some, least, percent)), "links")
    to = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    again = components(more.join(to("a"), "a").join(to("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    named = labels.join(again.select(F.col("node").alias("label"), F.col("label").alias("lower")), "label", "left")
    return named.select("node", F.coalesce("lower", "label").alias("label"))


def _scored(met: DataFrame, planes: DataFrame, least: int) -> DataFrame:
    a, b = planes.toDF("a", "pa"), planes.toDF("b", "pb")
    return met.join(a, "a").join(b, "b").withColumn("m", matches(F.col("pa"), F.col("pb"))).where(F.col("m") >= least).drop("pa", "pb")


def _mixed(entries: DataFrame, labels: DataFrame, planes: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Entries of the buckets that hold more than one label."""
    here = entries.select("node", "key", "n").join(labels, "node")
    mixed = here.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("key")
    return keep(spread_join(here, mixed, "key", hot).join(planes, "node"), "mixed")


def _small(left: DataFrame, least: int) -> DataFrame:
    """Pairs of different labels in buckets of up to SMALL nodes."""
    rows = left.where(F.col("n") <= SMALL)
    x = rows.select("key", F.col("node").alias("a"), F.col("label").alias("la"), F.col("planes").alias("pa"))
    y = rows.select("key", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("planes").alias("pb"))
    near = (F.col("x.a") < F.col("y.b")) & (F.col("x.la") != F.col("y.lb")) & (matches(F.col("x.pa"), F.col("y.pb")) >= least)
    return x.alias("x").join(y.alias("y"), (F.col("x.key") == F.col("y.key")) & near).select("a", "b").distinct()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets as sorted 64-bit hashes, by which pairs are confirmed."""
    for b in batches:
        sets = [shingles(t.as_py()).astype("<u8").tobytes() for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["node", "found"])


def _large(left: DataFrame, texts: DataFrame, least: int, percent: int) -> DataFrame:
    """Links between different labels in buckets of more than SMALL nodes, one for each two labels of two blocks."""
    rows = left.where(F.col("n") > SMALL)
    wanted = texts.join(rows.select(F.col("node").alias("doc_id")).distinct(), "doc_id").select("doc_id", "text")
    sets = keep(wanted.mapInArrow(_hashes, "node long, found binary").dropDuplicates(["node", "found"]), "hashes")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    # A node's block meets the blocks from its own on, and is met by those up to its own.
    x = rows.select("key", own.alias("p"), F.explode(F.sequence(own, blocks - 1)).alias("q"), "node", "label", "planes").join(sets, "node")
    y = rows.select("key", F.explode(F.sequence(F.lit(0), own)).alias("p"), own.alias("q"), "node", "label", "planes").join(sets, "node")
    y = y.select(*[F.col(c).alias(c) for c in y.columns])  # columns of its own for the cogroup
    keys = ["key", "p", "q"]
    return x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInArrow(lambda s, t: _between(s, t, least, percent), "a long, b long")


def _between(x: pa.Table, y: pa.Table, least: int, percent: int) -> pa.Table:
    """A link between each two labels of two blocks that have one, confirmed on the full sets."""
    links: dict[tuple[int, int], tuple[int, int]] = {}
    if x.num_rows and y.num_rows:
        def read(t: pa.Table) -> tuple:
            sets = [np.frombuffer(b, "<u8") for b in t["found"].to_pylist()]
            planes = np.array(t["planes"].to_pylist(), np.int64).view(U).reshape(-1, PLANES, PERMUTATIONS // 64)
            return t["node"].to_numpy(), t["label"].to_numpy(), planes, sets

        near = lambda p, q: PERMUTATIONS - np.bitwise_count(np.bitwise_or.reduce(p[None] ^ q, axis=1)).sum(axis=1)
        xs, ys = read(x), read(y)
        ask = np.zeros((len(xs[0]), len(ys[0])), bool)
        for i in range(len(xs[0])):
            ask[i] = (xs[1][i] != ys[1]) & (near(xs[2][i], ys[2]) >= least)
        if ask.any(axis=0).sum() < ask.any(axis=1).sum():  # the side with fewer nodes to ask leads
            xs, ys, ask = ys, xs, ask.T
        sizes = np.fromiter(map(len, ys[3]), np.int64, len(ys[3]))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        words, place = np.unique(np.concatenate(ys[3]), return_inverse=True)
        for i in np.flatnonzero(ask.any(axis=1)):
            at = np.minimum(np.searchsorted(words, xs[3][i]), len(words) - 1)
            has = np.zeros(len(words), np.int32)
            has[at[words[at] == xs[3][i]]] = 1
            common = np.add.reduceat(has[place], starts)
            united = len(xs[3][i]) + sizes - common
            for j in np.flatnonzero(ask[i] & (common > 0) & (100 * common >= percent * united)):
                labels = (int(min(xs[1][i], ys[1][j])), int(max(xs[1][i], ys[1][j])))
                pair = (int(min(xs[0][i], ys[0][j])), int(max(xs[0][i], ys[0][j])))
                links.setdefault(labels, pair)
    a, b = zip(*links.values(), strict=True) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs without the rows whose group has a smaller doc_id; of rows that repeat the kept id, one stays. Columns are docs' own."""
    groups = near_duplicates(docs, percent)
    kept = groups.where("kept").select("doc_id").distinct()
    named = docs.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"]).join(kept.where("doc_id is not null"), "doc_id")
    return named.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def op4_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query over all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
