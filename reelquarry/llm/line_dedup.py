"""Line dedup by content-defined chunks of lines.

Lines are split at line feeds, and long lines of prose once more after a full stop and a space, so that a paragraph set as one
line is a run of lines as well. Each line gets a 32-bit hash; a rolling hash over the last two lines' hashes
decides where a chunk ends: after the lines where it is a local minimum. Boundaries thus follow the content and survive
shifts, and every chunk but the ends of a document has two lines or more. Chunks of several lines, and of LEAST_CHARS
characters or more, that occur more than once in all documents are removed except for their first occurrence by (doc_id, position).
Hashes only nominate chunks: a chunk goes when the bytes of its lines are equal to those of an earlier one's.

Only DataFrame functions are used. Texts are chunked once; hashes of chunks are counted by partial aggregation, and
the rows of a chunk with many copies are dealt over several tasks.

Defined results: null and empty texts stay as they are; a text of which all chunks go becomes empty. Separators
of what is left stay as they were; none is left at the end of a text whose last line goes. Rows that
repeat an id and its text are one document, and don't remove each other's chunks; rows with the same id and
other texts are told apart by a hash of the text; null ids order first. Further columns stay as they are.
Very long texts are chunked whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import hex_number, let
from .shared import aside, hot_keys, keep, spread_join

#: Characters from which a chunk counts as a passage.
LEAST_CHARS = 40
#: Names of working columns; they are put beside any columns of the documents.
KEY, CUT, GONE, ID, OTHER, SPANS = "__key", "__chunks", "__gone", "__id", "__other", "__spans"
ADDED = ("n_lines", "n_lines_removed", "n_chunks_removed")
WRAP = 1 << 32


def bare_lines(text: Column) -> Column:
    """The lines of text without separators."""
    return F.split(F.replace(text, F.lit(". "), F.lit(".\n")), "\n")


def lines_of(text: Column) -> Column:
    """The same lines with the separator that follows each; the last one's separator is no part of the text."""

    def folded(line: Column) -> Column:
        return let(bare_lines(line), lambda p: F.transform(p, lambda x, i: F.concat(x, F.when(i == F.size(p) - 1, "\n").otherwise(" "))))

    return F.flatten(F.transform(F.split(text, "\n"), folded))


def n_lines(text: Column) -> Column:
    """Number of lines without splitting the text."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.length(text) - F.length(F.replace(text, F.lit(". "), F.lit("."))) + 1


def _chunks(lines: Column) -> Column:
    """Place, number of lines and hash of each chunk of several lines."""

    def places(rolled: Column, h: Column) -> Column:
        at = lambda i: F.get(rolled, i)
        least = lambda i: (at(i - 1) < at(i - 2)) & (at(i - 1) <= at(i))
        return let(F.filter(F.sequence(F.lit(0), F.size(rolled) - 1), lambda i: (i == 0) | least(i)), lambda s: spans(s, h))

    def spans(starts: Column, h: Column) -> Column:
        def span(s: Column, j: Column) -> Column:
            n = F.coalesce(F.get(starts, j + 1), F.size(h)) - s
            return F.struct(s.alias("at"), n.alias("n"), F.xxhash64(F.slice(h, s + 1, n)).alias("h"))

        return F.filter(F.transform(starts, span), lambda c: c["n"] > 1)

    def rolls(h: Column) -> Column:
        return let(F.transform(h, lambda x, i: F.pmod(x + F.coalesce(F.get(h, i - 1), F.lit(0)) * 31, F.lit(WRAP))), lambda r: places(r, h))

    return let(F.transform(lines, lambda x: hex_number(F.md5(x), 1, 8)), rolls)


def chunked(docs: DataFrame) -> DataFrame:
    """docs with the chunks that may be removed: place, number of lines and hash of the lines' hashes; and a key of the document."""
    return docs.withColumns({KEY: F.xxhash64("doc_id", "text"), CUT: let(bare_lines(F.coalesce(F.col("text"), F.lit(""))), _chunks)})


def _texts(lines: Column) -> Column:
    """The nominated chunks with their lines, joined alike whatever separated them."""
    return F.transform(SPANS, lambda s: F.struct(s["at"].alias("at"), s["n"].alias("n"), s["h"].alias("h"), F.array_join(F.slice(lines, s["at"] + 1, s["n"]), "\n").alias("chunk")))


def removals(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with their keys, and (id, key, spans): the chunks of each document to remove, after byte comparison."""
    keyed = docs.withColumn(KEY, F.xxhash64("doc_id", "text"))
    spans = keep(chunked(docs.select("doc_id", "text")).select("doc_id", KEY, F.explode(CUT).alias("c")).select("doc_id", KEY, "c.*"), "chunks")
    counts = keep(spans.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "chunk-counts")
    hot = hot_keys(counts, "h")
    places = (
        spread_join(spans, counts.select("h"), "h", hot).groupBy(F.col("doc_id").alias(ID), F.col(KEY).alias(OTHER))
        .agg(F.collect_set(F.struct("at", "n", "h")).alias(SPANS))
    )
    of_doc = (F.col(KEY) == F.col(OTHER)) & F.col("doc_id").eqNullSafe(F.col(ID))
    nominated = (
        keyed.select("doc_id", "text", KEY).join(places, of_doc).dropDuplicates([KEY, "doc_id"])
        .select("doc_id", KEY, F.explode(let(bare_lines(F.col("text")), _texts)).alias("c"))
        .select("doc_id", KEY, "c.*").where(F.length("chunk") >= LEAST_CHARS)
    )
    place = F.struct("doc_id", KEY, "at")
    first = nominated.groupBy("h", "chunk").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1")
    met = spread_join(nominated, first.select("h", F.col("chunk").alias("earlier"), "first"), "h", hot)
    gone = (
        met.where((F.col("chunk") == F.col("earlier")) & ~place.eqNullSafe(F.col("first")))
        .groupBy(F.col("doc_id").alias(ID), F.col(KEY).alias(OTHER)).agg(F.collect_set(F.struct("at", "n", F.length("chunk").alias("chars"))).alias(GONE))
    )
    return keyed, gone


def dedup_lines(docs: DataFrame, copies_from: float | None = None) -> DataFrame:
    """docs (doc_id, text, ...) with repeated chunks removed from text, and n_lines, n_lines_removed, n_chunks_removed, in place of columns of these names.

    copies_from: documents that would lose this share of their characters or more stay whole: they are copies of
    documents rather than documents with a passage, and whole copies are for near-duplicate detection to judge.
    """
    own, names = aside(docs, "doc_id", "text")
    keyed, gone = removals(own)
    of_doc = (F.col(KEY) == F.col(OTHER)) & F.col("doc_id").eqNullSafe(F.col(ID))

    def rest(lines: Column) -> Column:
        lost = F.flatten(F.transform(F.col(GONE), lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1)))
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost)
        joined = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "")
        return let(joined, lambda x: F.substring(x, F.lit(1), F.length(x) - 1))

    total = lambda name: F.aggregate(GONE, F.lit(0), lambda a, s: a + s[name])
    cut = F.col(GONE).isNotNull()
    if copies_from is not None:
        cut = cut & (total("chars") < copies_from * F.length("text"))
    return keyed.join(gone, of_doc, "left").select(
        *[F.when(cut, let(lines_of(F.col("text")), rest)).otherwise(F.col("text")).alias("text") if c == "text" else F.col(new).alias(c) for c, new in names.items() if c not in ADDED],
        F.coalesce(n_lines(F.col("text")), F.lit(0)).cast("long").alias("n_lines"),
        F.when(cut, total("n")).otherwise(0).cast("long").alias("n_lines_removed"),
        F.when(cut, F.size(GONE)).otherwise(0).cast("long").alias("n_chunks_removed"),
    )


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents with repeated chunks removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs)
