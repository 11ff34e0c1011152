"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document: measurements go to columns, failures to one bit each of
`failed_bits`. A policy is a named, versioned set of rule bits; applying one is a bitwise test, so policies
can change and be compared without touching the texts again. Ablations are bitwise aggregates of the ledger.

The toxic rule has no list of its own: its words are learned from labelled documents, in whatever language these are
(`toxic_words`). A word counts if many documents labelled toxic hold it and hardly any other does. Documents are
labelled by id; at most LABELLED of them, on average, are read, and copies of a text count once.

Defined results: null and empty texts measure 0 everywhere and fail the rules that ask for words; null ids,
repeated rows and further columns are kept as they are, one ledger row for each input row; an empty table
gives an empty ledger. Very long texts are measured whole. Without labels no word is toxic; a document with several labels
is toxic if one of them says so; null labels say nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import SPACES, hex_number, let, words
from .shared import aside, keep

#: Labelled documents that the toxic words are learned from, on average at most: those whose ids have the smallest hashes.
LABELLED, GRAIN = 20_000, 1 << 32
#: A toxic word: in so many toxic documents at least, in this share of them, and so many times as often as in others. At most VOCABULARY, the most frequent.
LEAST_DOCS, LEAST_SHARE, LIFT, VOCABULARY = 5, 0.01, 50.0, 1000
PUNCTUATION = ".,;:!?\"'()"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MEASURES = "__measures"


@dataclass(frozen=True)
class Policy:
    """Rules that reject a document, by name."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << BIT[r] for r in self.rules)


def _paired(h: Column, gap: int) -> Column:
    """Hash of each element with the one gap places on."""
    return F.zip_with(F.slice(h, 1, F.size(h) - gap), F.slice(h, gap + 1, F.size(h)), lambda a, b: F.xxhash64(a, b))


def _repeat_words(wh: Column) -> Column:
    """Words that lie in 8-word windows found twice or more; wh: the words' hashes. Windows are compared by 64-bit hashes of these."""

    def covered(starts: Column) -> Column:
        step = lambda a, i: F.struct(
            (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")
        )
        return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), step, lambda a: a["n"])

    def starts(by_hash: Column) -> Column:
        same = lambda i, j: F.get(by_hash, i)["h"].eqNullSafe(F.get(by_hash, j)["h"])
        repeated = F.filter(F.sequence(F.lit(0), F.size(by_hash) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
        return let(F.sort_array(F.transform(repeated, lambda i: F.get(by_hash, i)["i"])), covered)

    def eights(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(pairs), starts))

    def fours(h: Column) -> Column:  # without a repeated half window there is no repeated window
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(_paired(h, 4), eights))

    count = let(_paired(wh, 1), lambda twos: let(_paired(twos, 2), fours))
    return F.when(F.size(wh) <= WINDOW, F.lit(0)).otherwise(count).cast("long")


def _stutters(wh: Column) -> Column:
    """Words equal to the word before."""
    same = F.zip_with(F.slice(wh, 1, F.size(wh) - 1), F.slice(wh, 2, F.size(wh)), lambda a, b: a == b)
    return F.when(F.size(wh) > 1, F.size(F.array_remove(same, False))).otherwise(F.lit(0)).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def bare(word: Column) -> Column:
    """A word in lower case without punctuation around it."""
    return F.btrim(F.lower(word), F.lit(PUNCTUATION))


def toxic_words(docs: DataFrame, labels: DataFrame) -> list[str]:
    """Words that mark toxic documents, from docs (doc_id, text) and labels (doc_id, toxic); VOCABULARY of them at most."""
    judged = keep(labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic")), "labels")
    n = judged.count()
    if not n:
        return []
    share = int(min(1.0, LABELLED / n) * GRAIN)
    few = judged.where(hex_number(F.md5(F.col("doc_id").cast("string")), 1, 8) < share)  # about LABELLED rows of two numbers at most
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(few), "doc_id")
    once = keep(texts.groupBy(F.xxhash64("text").alias("h")).agg(F.any_value("text").alias("text"), F.max("toxic").alias("toxic")), "labelled-texts")
    total, n_toxic = once.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    found = once.select("toxic", F.explode(F.array_distinct(F.transform(words(F.col("text")), bare))).alias("word")).where("word <> ''")
    counted = found.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))
    enough = (F.col("t") >= LEAST_DOCS) & (F.col("t") >= LEAST_SHARE * n_toxic)
    rare = F.col("t") * float(max(total - n_toxic, 1)) >= LIFT * n_toxic * (F.col("o") + 1)
    return [r.word for r in counted.where(enough & rare).orderBy(F.col("t").desc(), "word").limit(VOCABULARY).collect()]


def _toxic(w: Column, vocabulary: Sequence[str]) -> Column:
    """Words of the vocabulary, repeats counted."""
    if not vocabulary:
        return F.lit(0).cast("long")
    return F.size(F.filter(w, lambda x: bare(x).isin(*vocabulary))).cast("long")


def _word_measures(w: Column, vocabulary: Sequence[str]) -> Column:
    runs = lambda wh: F.struct(_repeat_words(wh).alias("n_repeat_words"), _stutters(wh).alias("n_stutters"))
    return F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        let(F.transform(w, lambda x: F.xxhash64(x)), runs).alias("runs"),
        _toxic(w, vocabulary).alias("n_toxic"),
    )


def _found(text: Column, part: str) -> Column:
    """How often part occurs, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def _measured(docs: DataFrame, vocabulary: Sequence[str] = ()) -> tuple[DataFrame, dict[str, str]]:
    """docs under other names with a struct of the measurements, and the names; every text is split once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n_lines = let(_lines(text), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    docs, names = aside(docs, "text")
    both = docs.withColumns({"__w": let(words(text), lambda w: _word_measures(w, vocabulary)), "__l": n_lines})
    values = {
        "n_words": F.col("__w.n_words"), "word_chars": F.col("__w.word_chars"), "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": F.col("__l.dup").cast("long"), "n_repeat_words": F.col("__w.runs.n_repeat_words"), "n_stutters": F.col("__w.runs.n_stutters"),
        "n_lines": F.col("__l.n").cast("long"), "n_upper": F.regexp_count(text, F.lit("[A-Z]")).cast("long"), "n_shouts": _found(text, "!!"),
        "n_broken": _found(text, "\ufffd"), "n_toxic": F.col("__w.n_toxic"),
    }
    measures = F.struct(*[v.alias(k) for k, v in values.items()])
    return both.select(*docs.columns, measures.alias(MEASURES)), names


def measure(docs: DataFrame, vocabulary: Sequence[str] = ()) -> DataFrame:
    """docs with the measurements that the rules use, in place of columns of these names. vocabulary: the toxic words."""
    return _opened(*_measured(docs, vocabulary))


def _opened(rows: DataFrame, names: dict[str, str], *more: str) -> DataFrame:
    found = rows.schema[MEASURES].dataType.names
    return rows.select(*[F.col(new).alias(c) for c, new in names.items() if c not in (*found, *more)], f"{MEASURES}.*", *more)


def _c(name: str) -> Column:
    return F.col(f"{MEASURES}.{name}")




def _rules() -> dict[str, Column]:
    return {
        "few_words": _c("n_words") < 20,
        "repeated_windows": 100 * _c("n_repeat_words") > 30 * _c("n_words"),
        "repeated_lines": (100 * _c("n_dup_lines") > 30 * _c("n_lines")) & (_c("n_dup_lines") > 1),
        "symbols": 100 * _c("n_symbols") > 10 * _c("n_words"),
        "word_length": (_c("word_chars") < 2 * _c("n_words")) | (_c("word_chars") > 15 * _c("n_words")),
        "capitals": 100 * _c("n_upper") > 40 * _c("word_chars"),
        "shouting": (100 * _c("n_shouts") > 20 * _c("n_words")) & (_c("n_words") > 0),
        "broken_characters": 1000 * _c("n_broken") > _c("word_chars"),
        "toxic": _c("n_toxic") >= 2,
        "stutters": 100 * _c("n_stutters") > 20 * _c("n_words"),
    }


RULE_NAMES = (
    "few_words", "repeated_windows", "repeated_lines", "symbols", "word_length", "capitals", "shouting", "broken_characters", "toxic", "stutters",
)
BIT = {name: i for i, name in enumerate(RULE_NAMES)}
BASE = Policy("base", 1, ("few_words", "repeated_windows"))
STANDARD = Policy("standard", 1, RULE_NAMES)
POLICIES = (BASE, STANDARD)


def _bits() -> Column:
    bits = F.lit(0).cast("long")
    for name, failed in _rules().items():
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame, vocabulary: Sequence[str] = ()) -> DataFrame:
    """docs with the measurements and `failed_bits`: bit BIT[rule] is set where the document fails the rule. vocabulary: the toxic words."""
    rows, names = _measured(docs, vocabulary)
    return _opened(rows.withColumn("failed_bits", _bits()), names, "failed_bits")


def fails(policy: Policy, bits: str = "failed_bits") -> Column:
    """True where the ledger row fails the policy."""
    return F.col(bits).bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def filter_documents(docs: DataFrame, policy: Policy = STANDARD, vocabulary: Sequence[str] = ()) -> DataFrame:
    """The documents that pass the policy, with their own columns only. vocabulary: the toxic words."""
    rows, names = _measured(docs, vocabulary)
    return rows.withColumn("__bits", _bits()).where(~fails(policy, "__bits")).select(*[F.col(new).alias(c) for c, new in names.items()])


def ablation(rows: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """One row per rule of the policy: how many documents it fails, how many it alone rejects, and how many would pass without it."""
    bits = F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    by_bits = rows.groupBy(bits.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rule = rows.sparkSession.createDataFrame([(r, 1 << BIT[r]) for r in policy.rules], "rule string, bit long")
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return (
        by_bits.join(F.broadcast(rule))  # at most 2 ** rules rows by one row per rule, whatever the input
        .groupBy("rule")
        .agg(
            total(has).alias("n_failed"),
            total(F.col("bits") == F.col("bit")).alias("n_only_this"),
            total(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_pass_without"),
        )
    )


def _ledger_of(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ledger(docs, toxic_words(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Contract query over all documents."""
    return _ledger_of(spark, sf_dir).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        fails(BASE).alias("base_failed"), (~fails(STANDARD)).alias("kept"), "n_toxic", "failed_bits",
    )


def op9_rule_ablation(spark, sf_dir: str) -> DataFrame:
    """What each rule of the standard policy does to all documents."""
    return ablation(_ledger_of(spark, sf_dir))
