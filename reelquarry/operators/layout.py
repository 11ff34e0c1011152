"""Archive manifests: names, policies and the layout of payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binary import align_up
from .ordered import prefix_sum

ALIGN, HEADER, ENTRY = 64, 24, 9
#: Extensions that are never compressed, and the one that is never packed.
STORED, LEFT_OUT = ("cdata", "vp6", "snd", "imp"), ".asset"


def natural_key(name: Column) -> Column:
    """Sort key under which runs of digits compare as numbers, whatever their length: a total order, as the name itself decides between equal numbers."""
    runs = F.regexp_extract_all(name, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def number(x: Column) -> Column:
        digits = F.ltrim(x, F.lit("0"))
        return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)

    key = F.array_join(F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), number(x)).otherwise(x)), "")
    return F.concat(key, F.lit("\x00"), name)


def extension(name: Column) -> Column:
    return F.regexp_extract(F.lower(name), r"\.([^./\\]*)$", 1)


def trim_control(text: Column) -> Column:
    """Without control characters and spaces at both ends, then without quotes."""
    return F.btrim(F.regexp_replace(text, r"^[\x01-\x20]+|[\x01-\x20]+$", ""), F.lit('"'))


def with_policy(entries: DataFrame, threshold: int = 1024) -> DataFrame:
    """entries (name, size, packed_size) without left-out files, with the decision to store compressed and the stored size."""
    kept = entries.where(~F.col("name").endswith(LEFT_OUT))
    pack = ~extension(F.col("name")).isin(*STORED) & (F.col("packed_size") < F.col("size") - threshold)
    return kept.withColumn("compressed", pack).withColumn("stored", F.when(F.col("compressed"), F.col("packed_size")).otherwise(F.col("size")))


def layout(entries: DataFrame, order: str, size: str = "size") -> DataFrame:
    """entries (name, ...) in one archive, with header_size and offset: payloads begin on 64-byte boundaries after the header."""
    head = entries.agg(align_up(F.lit(HEADER) + F.coalesce(F.sum(F.octet_length("name") + ENTRY), F.lit(0)), ALIGN).alias("header_size"))
    placed = prefix_sum(entries, order, align_up(F.col(size), ALIGN), "__before")
    return placed.crossJoin(F.broadcast(head)).withColumn("offset", F.col("header_size") + F.col("__before")).drop("__before")  # head is one row


def sticky(lines: DataFrame, keys: list[str], order: str, switch: Column, name: str) -> DataFrame:
    """lines with the last switch value that is not NULL up to each line."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(name, F.last(switch, ignorenulls=True).over(w))


def safe_name(name: Column) -> Column:
    """False for entry names that would leave the target folder."""
    return ~(name.rlike(r"(^|[/\\])\.\.([/\\]|$)") | name.rlike(r"^([/\\]|[A-Za-z]:)"))


def _cut_quotes(x: Column) -> Column:
    return F.btrim(x, F.lit('"'))


def manifest(lines: DataFrame, keys: list[str], order: str, line: str = "line") -> DataFrame:
    """Lines of list files to their entries: keys, order, src, dst and compress.

    -pack0 and -pack1 switch compression off and on for the lines after them, -packthresh1024 is passed over, and other lines
    are `source=destination`. A line without a destination goes to its source's name; blank lines are left out.
    """
    text = F.regexp_replace(F.col(line), r"^[\x01-\x20]+|[\x01-\x20]+$", "")
    rows = lines.withColumn("__t", text)
    rows = sticky(rows, keys, order, F.when(F.col("__t").isin("-pack0", "-pack1"), F.col("__t") == "-pack1"), "__on")
    parts = F.array_remove(F.split("__t", "="), "")
    found = rows.where("__t <> '' and __t not in ('-pack0', '-pack1', '-packthresh1024')").withColumn("__p", parts).where("size(__p) > 0")
    src = _cut_quotes(F.get("__p", F.lit(0)))
    return found.select(*keys, order, src.alias("src"), F.coalesce(_cut_quotes(F.get("__p", F.lit(1))), src).alias("dst"), F.coalesce("__on", F.lit(False)).alias("compress"))


def re_rooted(file: Column, root: Column) -> tuple[Column, Column]:
    """Source path and entry name of a file found below a root: the root and the separator after it are cut out of the name, or put before a file without it."""
    at = F.position(root, file)
    inside = at > 0
    name = F.concat(F.substring(file, F.lit(1), at - 1), F.substring(file, at + F.length(root) + 1, F.length(file)))
    return F.when(inside, file).otherwise(F.concat(root, F.lit("\\"), file)), F.when(inside, name).otherwise(file)


def with_extension(name: Column, ext: str, rule: Column | None = None) -> Column:
    """name with an extension put after it, and before that what a rule adds."""
    return F.concat(name, *([F.coalesce(rule, F.lit(""))] if rule is not None else []), F.lit("." + ext))


def change_extension(name: Column, ext: str) -> Column:
    """name with its last four characters (an extension of three letters) replaced."""
    return with_extension(F.substring(name, F.lit(1), F.greatest(F.length(name) - 4, F.lit(0))), ext)
