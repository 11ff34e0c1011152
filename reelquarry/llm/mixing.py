"""Mixing sources to target weights with hash-threshold histograms.

Sizes are numbers of words. Every document has a 52-bit hash; words are summed by source and bucket of the hash's
leading bits, the bucket in which a source's budget ends is found by a running sum over its few buckets, and only
that bucket is split further, four times by 13 bits. The result is one threshold per source: documents at or
below it are taken once more. Nothing is sorted, and a rerun takes the same documents.

Budgets: the mix holds `share` of all words, dealt by weights that repeat over the sources in order of code
points, null last. No source gives more than `most` times its size; what it can't give is dealt to the others by weight
until none is above. Every document is taken as often as its source's budget goes round, and those under the threshold
once more. The threshold is the one whose sum comes nearest to the budget, the smaller sum in a tie.

Defined results: a null text has size 0; a null source is a source of its own; rows with null ids hash by their text
alone; rows that repeat id and text share a hash and are taken alike; sources without words have target 0. The
table of sources has one row per source and is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import hex_number, word_count
from .shared import aside, keep

WEIGHTS = (5, 2, 1)
LEVELS, LEVEL_BITS = 4, 13
BITS = LEVELS * LEVEL_BITS
#: Working columns beside the documents' own.
SIZE, HASH, SOURCE = "__size", "__hash", "__source"


def sized(docs: DataFrame) -> DataFrame:
    """docs with size and hash. The hash is of id and text, so that rows of one id with other texts differ."""
    name = F.concat_ws(":", F.col("doc_id").cast("string"), F.coalesce(F.col("text"), F.lit("")))
    return docs.withColumns({SIZE: word_count(F.col("text")), HASH: hex_number(F.md5(name), 1, 13)})


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, size) rows to source, source_size and target.

    Sources reach their caps in order of cap / weight; with those that have reached theirs taken out, the rest share
    what is left by weight. The level of the first source that stays below its cap is the level of all that do.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.select("source", F.col("size").alias("source_size"), weight.alias("w"), (F.col("size") * most).alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    levels = rows.withColumns({"level": F.when(level * F.col("w") <= F.col("cap"), level), "nth": F.row_number().over(order)})
    common = F.min_by("level", F.when(F.col("level").isNotNull(), F.col("nth"))).over(everything)
    return levels.select("source", "source_size", F.when(common.isNull(), F.col("cap")).otherwise(F.least("cap", common * F.col("w"))).alias("target"))


def thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """plan with rounds (times that all documents are taken) and last: the highest hash that is taken once more, -1 for none.

    rows: (source, size, hash). Each level sums words by the next bits of the hash inside the bucket where the
    budget ends.
    """
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = plan.withColumn("rounds", rounds).select(
        "source", "source_size", "target", "rounds", (F.col("target") - F.col("rounds") * F.col("source_size")).alias("budget"),
        F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("inside"),
    )
    for level in range(1, LEVELS + 1):
        shift = BITS - level * LEVEL_BITS
        here = rows.join(state.select(F.col("source").alias("s"), "prefix"), F.col("source").eqNullSafe(F.col("s")))
        inside = here.where(F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix"))
        buckets = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        buckets = buckets.where("n > 0").withColumnRenamed("source", "s")
        run = F.sum("n").over(Window.partitionBy("s").orderBy("bucket"))
        summed = buckets.withColumn("upto", run).join(state, F.col("source").eqNullSafe(F.col("s")))
        over = summed.where(F.col("below") + F.col("upto") > F.col("budget"))
        end = over.groupBy("s").agg(F.min_by(F.struct("bucket", "n", "upto"), "bucket").alias("e"))
        state = keep(
            state.join(end, F.col("source").eqNullSafe(F.col("s")), "left").select(
                "source", "source_size", "target", "rounds", "budget",
                F.coalesce(F.col("e.bucket"), F.lit(1 << (BITS - shift)).cast("long")).alias("prefix"),
                F.when(F.col("e").isNull(), F.col("below")).otherwise(F.col("below") + F.col("e.upto") - F.col("e.n")).alias("below"),
                F.coalesce("e.n", F.lit(0)).cast("long").alias("inside"),
            ),
            "thresholds",
        )
    take = (F.col("inside") > 0) & (F.col("below") + F.col("inside") - F.col("budget") < F.col("budget") - F.col("below"))
    return state.select("source", "source_size", "target", "rounds", F.when(take, F.col("prefix")).otherwise(F.col("prefix") - 1).alias("last"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """docs with size, source_size, target and copies: how often the mix takes the document. Columns of docs with these names are replaced."""
    renamed, names = aside(docs, "doc_id", "text", "source")
    own = {c: new for c, new in names.items() if c not in ("size", "source_size", "target", "copies")}
    with_sizes = sized(renamed)
    rows = keep(with_sizes.select("source", F.col(SIZE).alias("size"), F.col(HASH).alias("hash")), "sizes")
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("size")), weights, share, most)
    ends = thresholds(rows, plan).withColumnsRenamed({"source": SOURCE, "rounds": "__rounds", "last": "__last"})
    joined = with_sizes.select(*own.values(), SIZE, HASH).join(ends, F.col("source").eqNullSafe(F.col(SOURCE)))
    return joined.select(*[F.col(new).alias(c) for c, new in own.items()], F.col(SIZE).alias("size"), "source_size", "target", copies(F.col(HASH), F.col(SIZE)).alias("copies"))


def copies(hashed: Column, size: Column) -> Column:
    """Rounds of the source, and one more below its threshold; texts without words don't count against a budget and get no extra copy."""
    return (F.col("__rounds") + F.when((hashed <= F.col("__last")) & (size > 0), 1).otherwise(0)).cast("int")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with docs' own columns."""
    own, _ = aside(docs, "doc_id", "text", "source")
    out = mix(own)
    times = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return out.where("copies > 0").select(*own.columns, times.alias("__copy")).drop("__copy").toDF(*docs.columns)


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Contract query over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = mix(docs)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
