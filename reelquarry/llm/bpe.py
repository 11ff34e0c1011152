"""BPE encoding and decoding with a pair occurrence index.

A worker gathers the distinct words of many documents, lays their symbols out in one array, and maps each pair of
neighbouring symbols to all its positions. Active ranks are taken in ascending order from a heap: all positions
of the lowest rank are merged at once, and only the pairs beside them are looked up again and put on the lists of
their ranks. Words are then replaced by their ids in each document.

The tokenizer file is a parameter: a JSON file of the tokenizers library with a BPE model over byte-level symbols
and a word-end suffix, the NFC, white-space and lower-case normalisers, a split pattern and no decoder, so that
decoding joins the tokens with spaces. Other layouts are refused.

Defined results: null texts encode as empty texts, with no ids and an empty decoded text; null ids, repeated rows
and further columns stay as they are; strings of special tokens in a text become their ids, as in the library.
Very long texts are encoded whole; a worker holds the words of some megabytes of text at a time. Characters first
assigned in Unicode 16 or later may be split or lower-cased differently than in the library, by the Unicode
version of Python and its regex module.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches, spread

#: Characters of text whose words are encoded together, and distinct words that a worker remembers between such portions.
PORTION, REMEMBERED = 6_000_000, 300_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else the next from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class PairIndexBPE:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        splits = [p["type"] for p in spec["pre_tokenizer"]["pretokenizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or splits != ["Split", "ByteLevel"] or spec["decoder"] or not model["end_of_word_suffix"]:
            raise ValueError("this tokenizer layout isn't supported")
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t.encode() for t, i in (vocab | self.special).items()}
        self.starts = {t[0] for t in self.special if t}  # most texts hold none of these characters
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}")).findall
        symbols, end = byte_symbols(), model["end_of_word_suffix"]
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.last = np.array([vocab[s + end] for s in symbols], np.int32)
        self._merges(vocab, model["merges"])
        self._forget()

    def _merges(self, vocab: dict[str, int], merges: list) -> None:
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        a = np.array([vocab[x] for x, _ in pairs], np.int64)
        b = np.array([vocab[y] for _, y in pairs], np.int64)
        self.left, self.right, self.made = a, b, np.array([vocab[x + y] for x, y in pairs], np.int64)
        self.base = max(vocab.values()) + 1
        order = np.argsort(a * self.base + b, kind="stable")
        self.keys, self.ranks = (a * self.base + b)[order], order
        first = np.full(self.base, len(pairs))
        np.minimum.at(first, a, np.arange(len(pairs)))
        np.minimum.at(first, b, np.arange(len(pairs)))
        #: Merges whose product takes part in a merge of lower rank: their positions go one by one in each word.
        self.early = first[self.made] < np.arange(len(pairs))

    def _forget(self) -> None:
        self.index: dict[str, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.word_ids: list[bytes] = []

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; -1 for a pair that doesn't merge."""
        key = a.astype(np.int64) * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(sizes)
        symbol = self.inner[data]
        symbol[ends - 1] = self.last[data[ends - 1]]
        n = len(symbol)
        after = np.arange(1, n + 1, dtype=np.int32)
        after[ends - 1] = -1
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[ends - sizes] = -1
        word = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
        alive = np.ones(n, bool)
        places: dict[int, list[np.ndarray]] = defaultdict(list)
        heap: list[int] = []

        def note(p: np.ndarray) -> None:
            """Puts pairs that begin at p on the lists of their ranks."""
            p = p[after[p] >= 0]
            r = self.rank(symbol[p], symbol[after[p]])
            p, r = p[r >= 0], r[r >= 0]
            if len(p):
                order = np.argsort(r, kind="stable")
                p, r = p[order], r[order]
                cuts = np.flatnonzero(np.diff(r)) + 1
                for group, k in zip(np.split(p, cuts), r[np.concatenate([[0], cuts])].tolist(), strict=True):
                    if k not in places:
                        heapq.heappush(heap, k)
                    places[k].append(group)

        for at in range(0, n, 1 << 20):
            note(np.arange(at, min(n, at + (1 << 20)), dtype=np.int32))
        while heap:
            k = heapq.heappop(heap)
            p = np.unique(np.concatenate(places.pop(k)))
            a, b = self.left[k], self.right[k]
            p = p[alive[p] & (symbol[p] == a) & (after[p] >= 0)]
            p = p[symbol[after[p]] == b]
            if self.early[k]:  # the first place of each word only; the others wait
                first = np.concatenate([[True], np.diff(word[p]) > 0])[: len(p)]
                if not first.all():
                    places[k].append(p[~first])
                    heapq.heappush(heap, k)
                p = p[first]
            elif a == b:
                p = self._apart(p, after)
            if not len(p):
                continue
            q = after[p]
            symbol[p] = self.made[k]
            alive[q] = False
            after[p] = after[q]
            has = after[p] >= 0
            before[after[p[has]]] = p[has]
            left = before[p]
            note(np.unique(np.concatenate([p, left[left >= 0]])))
        out = symbol[alive].astype("<u4").tobytes()
        counts = np.bincount(word[alive], minlength=len(raw))
        stops = np.cumsum(counts) * 4
        return [out[e - c : e] for e, c in zip(stops.tolist(), (counts * 4).tolist(), strict=True)]

    @staticmethod
    def _apart(p: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Of places of a pair of equal symbols, those that merge from left to right without overlap."""
        if len(p) < 2:
            return p
        joined = np.concatenate([[False], after[p[:-1]] == p[1:]])
        start = np.maximum.accumulate(np.where(joined, 0, np.arange(len(p))))
        return p[(np.arange(len(p)) - start) % 2 == 0]

    def _pieces(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final form, as one character at a time
        return self.words(text.lower())

    def lookup(self, text: str) -> np.ndarray | list:
        """Places of the text's words in the index; a list of such arrays and special ids where the text holds special tokens."""
        number = lambda t: np.fromiter(map(self.index.__getitem__, self._pieces(t)), np.int32)
        if self.at_special is None or not any(c in text for c in self.starts) or not self.at_special.search(text):
            return number(text)
        return [self.special[t] if t in self.special else number(t) for t in self.at_special.split(text)]

    def settle(self) -> None:
        """Encodes the words that are in the index but have no ids yet."""
        new = list(self.index)[len(self.word_ids) :] if len(self.index) > len(self.word_ids) else []
        self.word_ids += self.encode_words(new)

    def ids(self, found: np.ndarray | list) -> bytes:
        if isinstance(found, list):
            return b"".join(x.to_bytes(4, "little") if isinstance(x, int) else self.ids(x) for x in found)
        return b"".join(map(self.word_ids.__getitem__, found.tolist()))

    def decode(self, ids: bytes) -> bytes:
        """Tokens of the ids, joined with spaces, as UTF-8."""
        return b" ".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ready: dict[int, PairIndexBPE] = {}


def _encoder(content: str) -> PairIndexBPE:
    """One encoder per worker and tokenizer."""
    key = hash(content)
    if key not in _ready:
        _ready.clear()
        _ready[key] = PairIndexBPE(content)
    return _ready[key]


def _encode(batches: Iterator[pa.RecordBatch], content: str) -> Iterator[pa.RecordBatch]:
    coder = _encoder(content)

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        coder.settle()
        for rest, found in held:
            for at in range(0, len(found), 200):
                ids = [coder.ids(x) for x in found[at : at + 200]]
                part = rest.slice(at, 200)
                arrays = [*part.columns, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([coder.decode(x) for x in ids], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, [*part.schema.names, "n_tokens", "ids", "decoded"])
        if len(coder.index) > REMEMBERED:
            coder._forget()

    held, size = [], 0
    for batch in batches:
        texts = batch.column(0)
        found = []
        for i in range(len(texts)):
            text = texts[i].as_py() or ""
            found.append(coder.lookup(text))
            size += len(text)
        held.append((pa.RecordBatch.from_arrays(batch.columns[1:], batch.schema.names[1:]), found))
        if size >= PORTION:
            yield from flush(held)
            held, size = [], 0
    if held:
        yield from flush(held)


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """docs with text replaced by n_tokens, ids (little-endian unsigned 32-bit integers) and decoded. tokenizer: a path on the driver.

    Columns of docs with one of these names are replaced.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    with open(tokenizer, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())  # one vocabulary file, of a size that the input doesn't change
    rest = [c for c in docs.columns if c not in ("text", "n_tokens", "ids", "decoded")]
    rows = docs.select(F.col("text").cast("string").alias("text"), *rest)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text"]
    return spread(rows).mapInArrow(lambda it: _encode(it, content.value), ", ".join([*fields, "n_tokens long", "ids binary", "decoded string"]))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    """Contract query over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(encode(docs, default_tokenizer()))
