"""Language-model scoring with an interpolated modified Kneser-Ney model of order two or three.

Counting goes from the longest n-grams down. Workers hash words to 64 bits, count a portion of text at a time, and emit packed
sorted arrays by shard; Spark shuffles them, and each shard merges its own. Triples are dealt by their hash. Pairs are dealt by their first word;
first words that hold more than a fair share of all tokens, the beginning of texts among them, are dealt over several
shards by the second word, so no shard grows with one word. Which words these are is read off a sample, as it only
decides where pairs are counted.

Triples are counted first. The facts of pairs (their count, how many triples of count one, two and more follow, and in how many
different triples they end) are then counted over the text again, with the triples' counts looked up in the shards
written before. A portion that holds c of a triple's C occurrences adds c / C of it, so that all portions together add one; sums
are rounded to the whole numbers that they are. Facts of words follow from the merged pairs, without the text.

Storage: each shard is a file of its sizes, sorted hashes and counts (a byte each, larger ones apart) in the shared folder,
renamed into place when complete, so that a task which runs twice leaves the same file. Workers map the files to memory; where the
shared folder isn't a file system of the machine, they copy a shard to their own temporary folder when they first need it.

Scoring: P3(w|uv) = max(c(uvw) - D(c), 0) / c(uv) + g(uv) P2(w|v), where P2 and P1 are the same form over the numbers
of different triples and pairs that end in (vw) and w, and P1 is interpolated with 1 / (V + 1) for words that training doesn't
know. A context that training doesn't know leaves the next shorter one. With order two, P2 is the highest and counts occurrences. Texts
begin in contexts of their own and end with an end token, which counts as a token.

Defined results: null and empty texts hold the end token only; null ids count as crc32 0, so such rows are held out; repeated rows
count as often as they are there; without training rows N and V are 0 and every token has probability 1.
Very long texts are counted and scored whole.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import crc_mod
from .minhash import mix
from .shared import bound_batches, keep, new_folder, spread

U = np.uint64
#: A word holds no space, so these can't be words.
BEGIN, END = U(xxhash.xxh3_64_intdigest(b" begin")), U(xxhash.xxh3_64_intdigest(b" end"))
#: Tokens that a worker counts or scores together, bytes of text that one shard counts, and shards that a task merges.
PORTION, SHARD_BYTES, SHARDS_OF_TASK = 1_000_000, 8 << 20, 4
#: Tasks up to which each shard has one of its own.
TASKS = 20_000
#: Order of the query's model. Order three needs more disk and memory than the check tool allows; the README has the figures.
ORDER = 2
#: Share of the text, and bytes of it, from which frequent words are read at least.
SAMPLE_SHARE, SAMPLE_BYTES = 2e-4, 16 << 20
#: Facts of a pair by order: its count, and for order three the triples of count 1, 2 and more after it and those that end in it.
PAIR_FACTS = {2: 1, 3: 5}
#: Facts of a word: its count, pairs that end in it, and the sum and classes of the pairs after it.
WORD_FACTS = 6


def token_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of text in lower case (A-Z only), then the end token."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out = np.empty(len(words) + 1, U)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))
    out[-1] = END
    return out


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the hash, so sorted hashes are sorted by shard."""
    return ((h >> U(32)) * U(shards) >> U(32)).astype(np.int64)


def _portions(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[list[np.ndarray]]:
    held, size = [], 0
    for b in batches:
        for text in b.column(at):
            held.append(token_hashes(text.as_py()))
            size += len(held[-1])
            if size >= PORTION:
                yield held
                held, size = [], 0
    if held:
        yield held


class Portion:
    """The distinct words, pairs and triples of some texts, each as places in the arrays of the shorter ones."""

    def __init__(self, held: list[np.ndarray], order: int, places: bool = True):
        self.starts = np.cumsum([0, *map(len, held)])[:-1]
        self.words, at = np.unique(np.concatenate([*held, [BEGIN]]), return_inverse=True)
        begin, at = at[-1], at[:-1]
        before = np.concatenate([[begin], at[:-1]])
        before[self.starts] = begin
        size = len(self.words)
        self.token_word = at
        code = before * size + at
        if order == 3:
            code = np.append(code, begin * size + begin)  # the context in which texts begin
        if places or order == 3:
            pairs, place, self.count = np.unique(code, return_inverse=True, return_counts=True)
            self.token_pair = place[: len(at)]
        else:
            pairs, self.count = np.unique(code, return_counts=True)
        self.v, self.w = pairs // size, pairs % size
        if order == 3:
            none = place[-1]
            self.count[none] = len(held)
            context = np.concatenate([[none], self.token_pair[:-1]])
            context[self.starts] = none
            triples, self.token_triple, self.triple_count = np.unique(context * len(pairs) + self.token_pair, return_inverse=True, return_counts=True)
            self.context, self.pair = triples // len(pairs), triples % len(pairs)

    def pair_keys(self) -> np.ndarray:
        return pair_key(self.words[self.v], self.words[self.w])

    def triple_keys(self, pairs: np.ndarray) -> np.ndarray:
        return pair_key(pairs[self.context], self.words[self.w[self.pair]])


def pair_key(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(u * U(0x9E3779B97F4A7C15) ^ mix(v + U(0xD6E8FEB86659FD93)))


def _runs(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Shards that occur in the sorted array, with the begin and end of each."""
    first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.empty(0, np.int64)
    return zip(shard[first].tolist(), first.tolist(), [*first[1:].tolist(), len(shard)], strict=len(shard) > 0)


BLOBS = "shard int, k binary, v binary, c binary"


def _blobs(shard: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """A row for each shard that occurs in the sorted array, with the bytes of its part of two columns, and of all others one after another."""
    rows = [(s, columns[0][i:j].tobytes(), columns[1][i:j].tobytes(), b"".join(c[i:j].tobytes() for c in columns[2:])) for s, i, j in _runs(shard)]
    to, *parts = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *[pa.array(p, pa.binary()) for p in parts]], ["shard", "k", "v", "c"])


def _triples(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for held in _portions(batches, 0):
        p = Portion(held, 3)
        key = p.triple_keys(p.pair_keys())
        order = np.argsort(key)
        yield _blobs(shard_of(key[order], shards), key[order], p.triple_count[order].astype("<u4"))


def _pairs(batches: Iterator[pa.RecordBatch], shards: int, hot: dict[int, int], folder: str, order: int) -> Iterator[pa.RecordBatch]:
    for held in _portions(batches, 0):
        p = Portion(held, order, places=False)
        parts = [p.count.astype("<u4")]
        if order == 3:
            key = p.pair_keys()
            triples = p.triple_keys(key)
            total = _look_up(folder, "triples", shard_of(triples, shards), triples, 1)[0]
            share = p.triple_count / total
            for k in (1, 2, 3):
                mine = total == k if k < 3 else total >= 3
                parts.append(np.bincount(p.context[mine], share[mine], len(key)))
            parts.append(np.bincount(p.pair, share, len(key)))
        shard = pair_shards(p, shards, hot)
        by = np.argsort(shard, kind="stable")  # pairs of one first word stay together, which the shuffle compresses
        yield _blobs(shard[by], p.words[p.v[by]], p.words[p.w[by]], *[x[by] for x in parts])


def pair_shards(p: Portion, shards: int, hot: dict[int, int]) -> np.ndarray:
    """Where the pairs of a portion are counted."""
    ways = np.array([hot.get(x, 1) for x in p.words.tolist()], U) if hot else np.ones(len(p.words), U)
    return (shard_of(p.words, shards)[p.v] + (p.words[p.w] % ways[p.v]).astype(np.int64)) % shards


def _frequent(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """First words of pairs that are frequent among those of a task, with their counts, and under the number 0 the count of all."""
    total, found = 0, {}
    for held in _portions(batches, 0):
        h, c = np.unique(np.concatenate([*held, [BEGIN] * len(held)]).astype(U), return_counts=True)
        total += int(c.sum())
        often = c * (16 * shards) >= c.sum()
        for x, n in zip(h[often].tolist(), c[often].tolist(), strict=True):
            found[x] = found.get(x, 0) + n
    names = [0, *found]
    yield pa.RecordBatch.from_arrays([pa.array([x.to_bytes(8, "little") for x in names], pa.binary()), pa.array([total, *found.values()], pa.int64())], ["h", "c"])


def hot_words(texts: DataFrame, size: int, shards: int) -> dict[int, int]:
    """First words with more than a fair share of the pairs of a sample, 4 for each shard at most, and over how many shards each is dealt."""
    share = min(1.0, max(SAMPLE_SHARE, SAMPLE_BYTES / max(size, 1)))
    some = texts.sample(share, seed=1) if share < 1 else texts
    rows = some.mapInArrow(lambda it: _frequent(it, shards), "h binary, c long").groupBy("h").agg(F.sum("c").alias("c"))
    rows = keep(rows, "frequent")
    total = rows.where(F.col("h") == F.lit(bytes(8))).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    found = rows.where((F.col("h") != F.lit(bytes(8))) & (F.col("c") * (4 * shards) >= total)).collect()
    return {int.from_bytes(r.h, "little"): min(shards, 1 + 4 * shards * r.c // total) for r in found}


def _facts(table: pa.Table, order: int) -> np.ndarray:
    """The facts of the rows' pairs, as numbers that can be summed."""
    out = []
    for c in table["c"].to_pylist():
        n = len(c) // (4 + 8 * (PAIR_FACTS[order] - 1))
        counts, shares = np.frombuffer(c, "<u4", n), np.frombuffer(c, "<f8", offset=4 * n) if order == 3 else np.empty(0)
        out.append(np.concatenate([counts[None].astype(np.float64), shares.reshape(PAIR_FACTS[order] - 1, n)]))
    return np.concatenate(out, axis=1)


def _joined(table: pa.Table, column: str, kind: object) -> np.ndarray:
    return np.frombuffer(b"".join(table[column].to_pylist()), kind)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the place of the first of each, and the sums of the rows of values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], order[first], np.add.reduceat(values[:, order], first, axis=1) if len(first) else values


def _file_system(folder: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" not in folder:
        folder = folder.replace("file:", "", 1) if folder.startswith("file:") else folder
        return pa.fs.LocalFileSystem(), folder
    return pa.fs.FileSystem.from_uri(folder)


def _publish(folder: str, name: str, parts: list[np.ndarray]) -> None:
    """Writes the parts one after another under a name of its own, then renames."""
    fs, path = _file_system(folder)
    fs.create_dir(path, recursive=True)
    temporary = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as out:
        for p in parts:
            out.write(p.tobytes())
    fs.move(temporary, f"{path}/{name}")


def _shelve(folder: str, name: str, keys: np.ndarray, columns: np.ndarray) -> None:
    """One shard's file: sizes, keys, large values, their places, and a byte for each value, 255 for a large one."""
    over = [np.flatnonzero(c >= 255) for c in columns]
    sizes = np.array([len(keys), *map(len, over)], "<u8")
    large = [c[o].astype("<u8") for c, o in zip(columns, over, strict=True)]
    _publish(folder, name, [sizes, keys, *large, *[o.astype("<u4") for o in over], *[np.minimum(c, 255).astype(np.uint8) for c in columns]])


def _unshelved(data: np.ndarray, keys: np.ndarray, columns: int) -> np.ndarray:
    """The columns' values for sorted keys; 0 for keys that the shard lacks."""
    n, *over = data[: 8 * (columns + 1)].view("<u8").tolist()
    cuts = np.cumsum([8 * (columns + 1), 8 * n, *[8 * m for m in over], *[4 * m for m in over], *[n] * columns])
    part = lambda i: data[cuts[i] : cuts[i + 1]]
    own = part(0).view(U)
    place = np.minimum(np.searchsorted(own, keys), n - 1)
    hit = own[place] == keys
    out = np.zeros((columns, len(keys)), np.int64)
    for c in range(columns):
        out[c] = np.where(hit, part(1 + 2 * columns + c)[place], 0)
        big = np.flatnonzero(out[c] == 255)
        if len(big):
            out[c, big] = part(1 + c).view("<u8")[np.searchsorted(part(1 + columns + c).view("<u4"), place[big])]
    return out


def _look_up(folder: str, kind: str, shard: np.ndarray, keys: np.ndarray, columns: int) -> np.ndarray:
    """Facts (columns, keys) of keys in any order, each in its shard."""
    order = np.lexsort((keys, shard))
    ordered = keys[order]
    out = np.zeros((columns, len(keys)), np.int64)
    for s, i, j in _runs(shard[order]):
        data = _mapped(folder, f"{kind}-{s}")
        if data is not None:
            out[:, order[i:j]] = _unshelved(data, ordered[i:j], columns)
    return out


def _classes(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return [int((counts == n).sum()) for n in (1, 2, 3, 4)]


def _merge_triples(table: pa.Table, folder: str) -> pa.Table:
    """Writes one shard of triples; returns its counts of counts."""
    shard = table["shard"][0].as_py()
    keys, _, (counts,) = _summed(_joined(table, "k", U), _joined(table, "v", "<u4").astype(np.int64)[None])
    _shelve(folder, f"triples-{shard}", keys, counts[None])
    return pa.table({"numbers": pa.array([_classes(counts)], pa.list_(pa.int64()))})


def _merge_pairs(table: pa.Table, folder: str, shards: int, order: int) -> pa.Table:
    """Writes one shard of pairs; returns counts of counts, and blobs of the facts that its pairs add to words."""
    shard = table["shard"][0].as_py()
    v, w = _joined(table, "k", U), _joined(table, "v", U)
    keys, first, facts = _summed(pair_key(v, w), _facts(table, order))
    v, w, facts = v[first], w[first], np.rint(facts).astype(np.int64)
    _shelve(folder, f"pairs-{shard}", keys, facts)
    own = np.flatnonzero(w != BEGIN)  # all but the context in which texts begin
    v, w, counted, count = v[own], w[own], facts[-1, own], facts[0, own]
    rows = [(shard, None, None, None, _classes(counted))]
    before = np.stack([counted, counted == 1, counted == 2, counted >= 3]).astype(np.int64)
    for first, of, values in ((2, v, before), (0, w, np.stack([count, np.ones_like(count)]))):  # facts from `first` on
        words, _, sums = _summed(of, values)
        kind = "<u4" if sums.max(initial=0) < 1 << 32 else "<u8"
        rows += [(s, first, words[i:j].tobytes(), sums[:, i:j].astype(kind).tobytes(), None) for s, i, j in _runs(shard_of(words, shards))]
    to, first, k, c, numbers = zip(*rows, strict=True)
    return pa.table({"shard": pa.array(to, pa.int32()), "first": pa.array(first, pa.int32()), "k": pa.array(k, pa.binary()), "c": pa.array(c, pa.binary()), "numbers": pa.array(numbers, pa.list_(pa.int64()))})


def _merge_words(table: pa.Table, folder: str) -> pa.Table:
    """Writes one shard of words; returns its words, tokens, pairs, counts of the numbers of pairs, and how many of these are 3 or more."""
    shard = table["shard"][0].as_py()
    facts, at = np.zeros((WORD_FACTS, sum(map(len, table["k"].to_pylist())) // 8), np.int64), 0
    for first, k, c in zip(table["first"].to_pylist(), table["k"].to_pylist(), table["c"].to_pylist(), strict=True):
        n, rows = len(k) // 8, 2 if first == 0 else 4
        part = np.frombuffer(c, f"<u{len(c) // (n * rows)}").reshape(rows, n)
        facts[first : first + len(part), at : at + n] = part
        at += n
    keys, _, facts = _summed(_joined(table, "k", U), facts)
    _shelve(folder, f"words-{shard}", keys, facts)
    numbers = [int((facts[0] > 0).sum()), int(facts[0].sum()), int(facts[1].sum()), *_classes(facts[1]), int((facts[1] >= 3).sum())]
    return pa.table({"numbers": pa.array([numbers], pa.list_(pa.int64()))})


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 0, 1, 2 and 3 or more; absolute ones of 0.75 where counts of counts are 0."""
    if not (n1 and n2 and n3 and n4):
        return [0.0, 0.75, 0.75, 0.75]
    y = n1 / (n1 + 2 * n2)
    return [0.0, *[min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]]


@dataclass
class Model:
    """What workers need besides the files: some numbers, and the hot words, at most 4 for each shard."""

    folder: str
    shards: int
    hot: dict[int, int]
    order: int
    tokens: int
    words: int
    continuations: int
    floor: float
    triple_discounts: list[float]
    pair_discounts: list[float]
    word_discounts: list[float]

    def score(self, held: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """For each text of the portion: tokens, known tokens, base score, score."""
        p = Portion(held, self.order)
        words = _look_up(self.folder, "words", shard_of(p.words, self.shards), p.words, WORD_FACTS)
        keys = p.pair_keys()
        pairs = _look_up(self.folder, "pairs", pair_shards(p, self.shards, self.hot), keys, PAIR_FACTS[self.order])
        low = np.full(len(p.words), 1.0 / (self.words + 1))
        if self.continuations:
            low = _held_back(words[1], self.word_discounts) / self.continuations + self.floor / (self.words + 1)
        counted = pairs[-1]
        total, spare = words[2][p.v], _spare(words[3:], words[2], self.pair_discounts)[p.v]
        found = _held_back(counted, self.pair_discounts) / np.maximum(total, 1) + spare * low[p.w]
        if self.order == 3:
            triples = p.triple_keys(keys)
            count = _look_up(self.folder, "triples", shard_of(triples, self.shards), triples, 1)[0]
            known = pairs[1:4].sum(axis=0) > 0
            total, spare = np.where(known, pairs[0], 0)[p.context], _spare(pairs[1:4], pairs[0], self.triple_discounts)[p.context]
            found = _held_back(count, self.triple_discounts) / np.maximum(total, 1) + spare * found[p.pair]
            logs = np.log10(found)[p.token_triple]
        else:
            logs = np.log10(found)[p.token_pair]
        count = words[0][p.token_word]
        base = np.log10((count + 0.1) / (self.tokens + 0.1 * (self.words + 1)))
        add = lambda x: np.add.reduceat(x, p.starts)
        return np.diff([*p.starts, len(count)]), add((count > 0).astype(np.int64)), add(base), add(logs)


def _held_back(counts: np.ndarray, discount: list[float]) -> np.ndarray:
    return np.maximum(counts - np.array(discount)[np.minimum(counts, 3)], 0)


def _spare(classes: np.ndarray, total: np.ndarray, discount: list[float]) -> np.ndarray:
    """Share of a context's probability that its shorter context gets; all of it for a context without followers."""
    return np.where(classes.sum(axis=0) > 0, (classes * np.array(discount[1:])[:, None]).sum(axis=0) / np.maximum(total, 1), 1.0)


_maps: dict[str, np.ndarray | None] = {}
_copies: list = []


def _mapped(folder: str, name: str) -> np.ndarray | None:
    """The file's bytes, mapped to memory once per worker; None for a shard without a file."""
    path = f"{folder}/{name}"
    if path not in _maps:
        if len(_maps) > 4096:
            _maps.clear()
        fs, place = _file_system(path)
        if fs.get_file_info(place).type == pa.fs.FileType.NotFound:
            _maps[path] = None
            return None
        if not isinstance(fs, pa.fs.LocalFileSystem):
            if not _copies:
                _copies.append(tempfile.TemporaryDirectory())
            local = f"{_copies[0].name}/{uuid.uuid4().hex}"
            pa.fs.copy_files(place, local, source_filesystem=fs, destination_filesystem=pa.fs.LocalFileSystem())
            place = local
        _maps[path] = np.memmap(place, np.uint8, "r")
    return _maps[path]


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """A model of order 2 or 3 of all texts of docs."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = docs.sparkSession
    bound_batches(spark)
    texts = spread(docs.select(F.col("text").cast("string").alias("text")))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(6, -(-size // SHARD_BYTES))
    folder = new_folder(spark, "model")
    # A task merges a few shards at most, however many there are.
    tasks = max(min(shards, TASKS), -(-shards // SHARDS_OF_TASK))
    by_shard = lambda rows: rows.repartition(tasks, "shard").groupBy("shard")
    triples = [0] * 4
    if order == 3:
        found = by_shard(texts.mapInArrow(lambda it: _triples(it, shards), BLOBS))
        triples = _total(keep(found.applyInArrow(lambda t: _merge_triples(t, folder), "numbers array<long>"), "triples"), 4)
    hot = hot_words(texts, size, shards)
    found = by_shard(texts.mapInArrow(lambda it: _pairs(it, shards, hot, folder, order), BLOBS))
    pairs = keep(found.applyInArrow(lambda t: _merge_pairs(t, folder, shards, order), "shard int, first int, k binary, c binary, numbers array<long>"), "pairs")
    merged = by_shard(pairs.where("k is not null").select("shard", "first", "k", "c")).applyInArrow(lambda t: _merge_words(t, folder), "numbers array<long>")
    words, tokens, continuations, *m, m3_up = _total(keep(merged, "words"), 8)
    low = discounts(*m)
    floor = (low[1] * m[0] + low[2] * m[1] + low[3] * m3_up) / continuations if continuations else 1.0
    return Model(folder, shards, hot, order, tokens, words, continuations, floor, discounts(*triples), discounts(*_total(pairs, 4)), low)


def _total(rows: DataFrame, n: int) -> list[int]:
    """Sums of the shards' numbers."""
    return list(rows.agg(*[F.coalesce(F.sum(F.get("numbers", F.lit(i))), F.lit(0)) for i in range(n)]).first())


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    rest, held, size = [], [], 0

    def flush() -> pa.RecordBatch:
        table = pa.Table.from_batches(rest).combine_chunks()
        columns = [pa.array(x) for x in model.score(held)]
        made = pa.table([*table.columns, *columns], names=[*table.schema.names, "n_tokens", "n_known", "base_score", "score"])
        return made.combine_chunks().to_batches()[0]

    for b in batches:
        start = 0
        for i, text in enumerate(b.column(0)):
            held.append(token_hashes(text.as_py()))
            size += len(held[-1])
            if size >= PORTION or i == b.num_rows - 1:
                rest.append(pa.RecordBatch.from_arrays([c.slice(start, i + 1 - start) for c in b.columns[1:]], b.schema.names[1:]))
                start = i + 1
            if size >= PORTION:
                yield flush()
                rest, held, size = [], [], 0
    if held:
        yield flush()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with text replaced by n_tokens, n_known, base_score and score. Columns of docs with these names are replaced."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some numbers for each shard
    own = [c for c in docs.columns if c not in ("text", "n_tokens", "n_known", "base_score", "score")]
    rows = docs.select(F.col("text").cast("string").alias("text"), *own)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text"]
    return spread(rows).mapInArrow(lambda it: _score(it, shared.value), ", ".join([*fields, "n_tokens long", "n_known long", "base_score double", "score double"]))


def op10_kneser_ney(spark, sf_dir: str) -> DataFrame:
    """Contract query over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = crc_mod(F.col("doc_id"), 10) == 0
    model = train(docs.where(~held_out))
    out = score(docs.withColumn("held_out", held_out), model)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
