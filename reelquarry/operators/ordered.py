"""Ordered-stream operators: prefix sums, blocks, predictors, cross-fades, crops, schedules.

Streams are keyed (a user, an asset, a channel) and ordered inside the key, so windows are partitioned by key. Where
one sequence spans a whole table, running sums go in two steps: totals of blocks of the order column, a running sum
over these few, and a window inside each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix_sum(df: DataFrame, order: str, value: Column, name: str, step: int = 4096) -> DataFrame:
    """df with the sum of value over all rows that come before by `order`, a unique integer; no task holds more than `step` rows of it."""
    rows = df.withColumns({"__v": value, "__b": F.floor(F.col(order) / step)})
    totals = rows.groupBy("__b").agg(F.sum("__v").alias("__t"))
    # Totals are dealt to runs of blocks in turn, so that the windows over them stay small as well.
    runs = totals.withColumn("__r", F.floor(F.col("__b") / step))
    of_run = runs.groupBy("__r").agg(F.sum("__t").alias("__rt"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    of_run = of_run.withColumn("__r0", F.coalesce(F.sum("__rt").over(before(Window.orderBy("__r"))), F.lit(0)))
    starts = runs.withColumn("__b0", F.coalesce(F.sum("__t").over(before(Window.partitionBy("__r").orderBy("__b"))), F.lit(0)))
    starts = starts.join(of_run, "__r").select("__b", (F.col("__b0") + F.col("__r0")).alias("__s"))
    inside = F.coalesce(F.sum("__v").over(before(Window.partitionBy("__b").orderBy(order))), F.lit(0))
    return rows.withColumn("__i", inside).join(starts, "__b").withColumn(name, (F.col("__s") + F.col("__i")).cast("long")).drop("__v", "__b", "__i", "__s")


def fixed(x: Column, digits: int = 3) -> Column:
    """x to so many digits, halves up, by arithmetic that other engines repeat exactly."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def numbered(df: DataFrame, key: str, order: list[str], name: str = "n", parts: int = 1) -> DataFrame:
    """df with each row's position in its stream, from 0.

    With parts > 1 streams too long for one task are dealt by ranges of the first order column: rows are counted in each range, and
    the ranges before a row's own are added to its place in it. Rows of one key with one value of that column stay together.
    """
    if parts <= 1:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long") - 1)
    place = F.unix_micros(order[0]) if dict(df.dtypes)[order[0]].startswith("timestamp") else F.col(order[0])
    cuts = df.select(F.percentile_approx(place, [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    at = F.lit(0)
    for c in sorted(set(cuts)):  # parts - 1 numbers at most
        at = at + F.coalesce(place > c, F.lit(False)).cast("int")
    rows = df.withColumn("__p", at)
    sizes = rows.groupBy(key, "__p").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(key).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(key).alias("__k"), F.col("__p").alias("__q"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__b"))
    inside = F.row_number().over(Window.partitionBy(key, "__p").orderBy(*order))
    joined = rows.withColumn("__i", inside).join(sizes, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__p") == F.col("__q")))
    return joined.withColumn(name, (F.col("__b") + F.col("__i") - 1).cast("long")).drop("__p", "__k", "__q", "__b", "__i")


def running_sum(df: DataFrame, key: str, value: str, name: str, step: int = 65536) -> DataFrame:
    """df, streams numbered by n, with the sum of value up to each row and the stream's `total` and `frames`; no task holds more than `step` rows of a stream."""
    rows = df.withColumn("__p", F.floor(F.col("n") / step))
    sums = rows.groupBy(key, "__p").agg(F.sum(value).alias("__s"), F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(key)
    before = F.coalesce(F.sum("__s").over(w.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(key, "__p", before.alias("__b"), F.sum("__s").over(w).alias("total"), F.sum("__c").over(w).alias("frames"))
    inside = F.sum(value).over(Window.partitionBy(key, "__p").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__i", inside).join(sums, [key, "__p"]).withColumn(name, F.col("__b") + F.col("__i")).drop("__p", "__b", "__i")


#: Fixed values of the ADPCM formats: predictor pairs in 1/256.
PREDICTORS = ((0, 0), (240, 0), (460, -208), (392, -220))


def predictor_errors(df: DataFrame, key: str, sample: str, size: int = 28) -> DataFrame:
    """Per block of `size` samples of a stream numbered by n: the largest error of each of the four predictors."""
    w = Window.partitionBy(key).orderBy("n")
    one, two = F.coalesce(F.lag(sample, 1).over(w), F.lit(0.0)), F.coalesce(F.lag(sample, 2).over(w), F.lit(0.0))
    rows = df.withColumns({"x1": one, "x2": two, "blk": F.floor(F.col("n") / size).cast("long")})
    error = lambda a, b: F.max(F.abs(F.col(sample) - (F.col("x1") * a + F.col("x2") * b) / 256.0))
    return rows.groupBy(key, "blk").agg(F.count(F.lit(1)).alias("n_valid"), *[error(a, b).alias(f"e{i}") for i, (a, b) in enumerate(PREDICTORS)])


def best_predictor(errors: DataFrame) -> DataFrame:
    """errors with the first predictor of least error; the first one outright if its error is at most 7."""
    least = F.least("e0", "e1", "e2", "e3")
    pick = F.when(F.col("e0") <= 7, 0)
    for i in range(3):
        pick = pick.when(F.col(f"e{i}") == least, i)
    return errors.withColumns({"predictor": pick.otherwise(3), "error": F.when(F.col("e0") <= 7, F.col("e0")).otherwise(least)})


def shift_for(error: Column) -> Column:
    """Shift of a 4-bit ADPCM block: the first s of 0 to 11 whose bit of 16384 >> s is set in the rounded error, else 12."""
    e = F.least(F.floor(error), F.lit(32767)).cast("long")
    out = None
    for s in range(12):
        bit = 16384 >> s
        hit = (e + (bit >> 3)).bitwiseAND(F.lit(bit).cast("long")) != 0
        out = F.when(hit, s) if out is None else out.when(hit, s)
    return out.otherwise(12)


def pad_blocks(df: DataFrame, key: str, sample: str, size: int) -> DataFrame:
    """Streams numbered by n, filled to whole blocks by their last sample: key, blk, samples, n_valid."""
    rows = df.withColumn("blk", F.floor(F.col("n") / size).cast("long"))
    packed = rows.groupBy(key, "blk").agg(F.array_sort(F.collect_list(F.struct("n", F.col(sample).alias("v")))).alias("s"))  # size samples at most
    values = F.transform("s", lambda x: x["v"])
    return packed.select(
        key, "blk", F.concat(values, F.array_repeat(F.element_at(values, -1), F.lit(size) - F.size("s"))).alias("samples"), F.size("s").cast("long").alias("n_valid")
    )


def crop(df: DataFrame, key: str, sample: str, start: int, length: int) -> DataFrame:
    """Samples start .. start + length - 1 of each stream, silence where the stream has none: key, n, sample."""
    spine = df.select(key).distinct().select(key, F.explode(F.sequence(F.lit(start).cast("long"), F.lit(start + length - 1).cast("long"))).alias("n"))
    inside = df.where(F.col("n").between(start, start + length - 1)).select(key, "n", F.col(sample).alias("__s"))
    return spine.join(inside, [key, "n"], "left").select(key, (F.col("n") - start).alias("n"), F.coalesce("__s", F.lit(0.0)).alias("sample"))


def cross_fade(df: DataFrame, key: str, a: str, b: str, length: int) -> DataFrame:
    """a fades to b linearly over the first `length` samples of each stream, b follows."""
    share = F.least(F.col("n") / F.lit(length), F.lit(1.0))
    return df.select(key, "n", (F.col(a) * (1 - share) + F.col(b) * share).alias("mixed"))


def slopes(df: DataFrame, key: str, sample: str) -> DataFrame:
    """Centred differences, with the stream's ends taken as level."""
    w = Window.partitionBy(key).orderBy("n")
    before, after = F.coalesce(F.lag(sample).over(w), F.col(sample)), F.coalesce(F.lead(sample).over(w), F.col(sample))
    return df.withColumn("slope", (after - before) * 0.5)


def hermite_half(df: DataFrame, key: str, sample: str) -> DataFrame:
    """Cubic Hermite value half-way between each sample and the next."""
    w = Window.partitionBy(key).orderBy("n")
    both = slopes(df, key, sample).withColumns({"y1": F.lead(sample).over(w), "m1": F.lead("slope").over(w)})
    value = (F.col(sample) + F.col("y1")) * 0.5 + (F.col("slope") - F.col("m1")) * 0.125
    return both.where(F.col("y1").isNotNull()).withColumn("between", value)


def chunk_schedule(df: DataFrame, rate: Column, per_second: int, n_frames: Column, block: int) -> DataFrame:
    """Frames of each chunk of a stream: running targets trunc((k + 1) rate / per_second), rounded up to whole blocks, ended by the length."""
    upto = lambda k: F.least(F.ceil(F.floor((k + 1) * rate / per_second) / block) * block, n_frames).cast("long")
    last = F.ceil(n_frames * per_second / rate).cast("int")
    k = F.explode(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0)))).alias("chunk")
    rows = df.select("*", k)
    at = F.col("chunk")
    return rows.withColumns({"start": F.when(at == 0, F.lit(0).cast("long")).otherwise(upto(at - 1)), "stop": upto(at)}).where("stop > start")


def loudness_filtered(df: DataFrame, key: str, sample: str, rate: int, piece: int = 1 << 16) -> DataFrame:
    """Streams numbered by n through the equal-loudness filters, in place of the samples: key, n, sample.

    A stream is read in its order, piece by piece, with the filters' states carried over; only a piece is held.
    """
    from ..functions import loudness

    first, second = loudness.equal_loudness(rate), loudness.high_pass(rate)
    kind = dict(df.dtypes)[key]
    rows = df.select(key, F.col("n").cast("long").alias("n"), F.col(sample).cast("double").alias(sample))
    # One task per share of the keys, sorted by key and n: a key's rows follow each other.
    dealt = rows.repartition(key).sortWithinPartitions(key, "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), [(None, None), (None, None)]
        for b in batches:
            keys, out = b.column(0).to_pylist(), np.empty(b.num_rows)
            x, at = b.column(2).to_numpy(zero_copy_only=False), 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at] and end - at < piece:
                    end += 1
                if keys[at] != now:
                    now, state = keys[at], [(None, None), (None, None)]
                y, *one = loudness.recursive(x[at:end], *first, *state[0])
                y, *two = loudness.recursive(y, *second, *state[1])
                state = [tuple(one), tuple(two)]
                out[at:end] = y
                at = end
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out)], b.schema.names)

    return dealt.mapInArrow(run, f"{key} {kind}, n long, {sample} double")


def loudness_buckets(df: DataFrame, keys: list[str], sample: str, window: int = 50, table: int = 12000) -> DataFrame:
    """Windows of a stream numbered by n, counted by loudness bucket: hundredths of a decibel of the mean square."""
    rows = df.withColumn("win", F.floor(F.col("n") / window))
    power = rows.groupBy(*keys, "win").agg((F.sum(F.col(sample) * F.col(sample)) / F.count(F.lit(1))).alias("ms"))
    value = (1000 * F.log10(0.5 * F.col("ms") + F.lit(1e-37))).cast("long")
    return power.withColumn("bucket", F.least(F.greatest(value, F.lit(0)), F.lit(table - 1)).cast("long")).groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("windows"))


def loudness_gain(buckets: DataFrame, keys: list[str]) -> DataFrame:
    """From the loudest bucket down, the first that covers a twentieth of the windows; gain is 64.82 dB less its level."""
    w = Window.partitionBy(*keys)
    down = F.sum("windows").over(w.orderBy(F.col("bucket").desc()))
    rows = buckets.withColumns({"covered": down, "total": F.sum("windows").over(w)}).where(F.col("covered") >= F.ceil(F.col("total") * 0.05))
    return rows.groupBy(*keys).agg(F.max("bucket").alias("bucket"), F.max("total").alias("windows")).withColumn("gain", F.lit(64.82) - F.col("bucket") / 100.0)


def seek_table(df: DataFrame, key: str, size: str, points: int = 100) -> DataFrame:
    """Quantised byte positions of a stream of frames numbered by n, at each hundredth of its frames."""
    rows = running_sum(df, key, size, "cum")
    # A frame is the one of all points whose index it is; short streams have several points on a frame.
    first = F.ceil(F.col("n") * points / F.col("frames"))
    last = F.ceil((F.col("n") + 1) * points / F.col("frames")) - 1
    value = F.least(F.lit(255), F.floor(256 * F.col("cum") / F.col("total"))).cast("long")
    point = F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("point")
    return rows.where(last >= first).select(key, point, value.alias("position"))


#: Keys of several rows that are broadcast; if there are more, they are joined.
SEVERAL = 200_000


def earlier_places(codes: np.ndarray, span: int, width: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of whole numbers below `span` at which `width` of them are found that an earlier place within the window holds, and the distance to the nearest one."""
    places = max(len(codes) - (width - 1), 0)
    group, most = codes[:places].astype(np.int64), span
    for j in range(1, width):
        if most * span >= 1 << 63:
            group, most = np.unique(group, return_inverse=True)[1], max(places, 1)
        group, most = group * span + codes[j : j + places], most * span
    order = np.argsort(group, kind="stable")
    back = np.diff(order)
    found = (np.diff(group[order]) == 0) & (back <= window)
    return order[1:][found], back[found]


def _matches_of_rows(df: DataFrame, key: str, kind: str, values: str, text: bool, width: int, window: int, portion: int = 1 << 18) -> DataFrame:
    """matches_before where each row is a stream; nothing is shuffled, and a row and `portion` of its matches are held."""
    rows = df.select(key, F.col(values).cast("binary") if text else F.transform(values, lambda x: F.xxhash64(x)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(keys: pa.Array, rows: list[int], n: list[np.ndarray], back: list[np.ndarray]) -> pa.RecordBatch:
            columns = [keys.take(pa.array(np.repeat(rows, [len(x) for x in n]))), pa.array(np.concatenate(n).astype(np.int64)), pa.array(np.concatenate(back).astype(np.int64))]
            return pa.RecordBatch.from_arrays(columns, [key, "n", "back"])

        for b in batches:
            keys, content = b.columns
            kept: tuple[list, list, list] = ([], [], [])
            held = 0
            for i, x in enumerate(content):
                if not x.is_valid:
                    continue
                if text:
                    codes, span = np.frombuffer(x.as_py().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), 0x110000
                else:
                    known, codes = np.unique(x.values.to_numpy(zero_copy_only=False), return_inverse=True)
                    span = max(len(known), 1)
                n, back = earlier_places(codes, span, width, window)
                for at in range(0, len(n), portion):
                    for to, part in zip(kept, (i, n[at : at + portion], back[at : at + portion]), strict=True):
                        to.append(part)
                    held += len(kept[1][-1])
                    if held >= portion:
                        yield batch(keys, *kept)
                        kept, held = ([], [], []), 0
            if held:
                yield batch(keys, *kept)

    return rows.mapInArrow(run, f"`{key}` {kind}, n long, back long")


def matches_before(df: DataFrame, key: str, values: str, width: int = 3, window: int = 131071) -> DataFrame:
    """Places of an array column, or of a text's characters, at which `width` values are found that an earlier place within the window holds: key, n, back (the distance to the nearest one).

    Rows are read where they are. Only those that share their key with another, so that their places count together, go by windows over all of them.
    """
    kinds = dict(df.dtypes)
    text = kinds[values] == "string"
    alone = lambda rows: _matches_of_rows(rows, key, kinds[key], values, text, width, window)
    several = df.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("__c")).where("__c > 1").select("__k")
    n_several = several.limit(SEVERAL + 1).count()
    if not n_several:
        return alone(df)
    several = F.broadcast(several) if n_several <= SEVERAL else several
    same = F.col(key).eqNullSafe(F.col("__k"))
    rows = df.join(several, same, "left_semi").select(key, (F.split(values, "") if text else F.col(values)).alias("__v")).where(F.size("__v") >= width)
    at = F.posexplode(F.transform(F.sequence(F.lit(1), F.size("__v") - (width - 1)), lambda i: F.xxhash64(F.slice("__v", i, F.lit(width))))).alias("n", "h")
    back = F.col("n") - F.lag("n").over(Window.partitionBy(key, "h").orderBy("n"))
    shared = rows.select(key, at).withColumn("back", back).where(F.col("back") <= window)
    return alone(df.join(several, same, "left_anti")).unionByName(shared.select(key, F.col("n").cast("long").alias("n"), F.col("back").cast("long").alias("back")))


def kth_smallest(values: Column, k: Column) -> Column:
    """The k-th value of an array in order, counted from 1; NULL beyond its end."""
    return F.get(F.array_sort(values), (k - 1).cast("int"))


def by_magnitude(values: Column) -> Column:
    """An array in order of falling magnitude."""
    return F.transform(F.sort_array(F.transform(values, lambda x: F.struct(F.abs(x).alias("m"), x.alias("x"))), asc=False), lambda s: s["x"])


def xa_samples(data: Column, one: Column, two: Column) -> Column:
    """Samples of one coded XA block of 15 bytes after the samples one and two, in built-in expressions."""
    def decoded(digits: Column) -> Column:
        f, shift = F.get(digits, F.lit(0)), F.get(digits, F.lit(1))
        pick = lambda i: F.get(F.array(*[F.lit(c[i]).cast("long") for c in PREDICTORS]), f)
        scale = F.get(F.array(*[F.lit(1 << (20 - s)).cast("long") for s in range(13)]), shift)

        def step(s: Column, n: Column) -> Column:
            x = F.when(n > 7, n - 16).otherwise(n) * scale + pick(0) * F.element_at(s, -1) + pick(1) * F.element_at(s, -2)
            return F.concat(s, F.array(F.least(F.greatest(F.shiftright(x, 8), F.lit(-32768).cast("long")), F.lit(32767).cast("long"))))

        return F.slice(F.aggregate(F.slice(digits, 3, 28), F.array(two.cast("long"), one.cast("long")), step), 3, 28)

    # The block's thirty half bytes: filter, shift, and the samples' nibbles.
    digits = F.transform(F.split(F.hex(data), ""), lambda x: F.position(x, F.lit("0123456789ABCDEF")) - 1)
    return F.get(F.transform(F.array(digits), decoded), F.lit(0))
