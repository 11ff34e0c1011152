"""The operators in Python: against brute force on small fixtures, and on odd rows."""

import hashlib
import json
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reelquarry.llm import bpe, chat, importance, kneser_ney, language_id, minhash, shared, top_k
from reelquarry.llm.graph import components

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain_groups(rows):
    """Component of each row, by comparing all pairs of distinct sets."""
    sets = defaultdict(list)
    for i, t in rows:
        sets[shingle_set(t)].append(i)
    keys = [k for k in sets if k]
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            common = len(keys[i] & keys[j])
            if 100 * common >= 75 * (len(keys[i]) + len(keys[j]) - common):
                parent[find(i)] = find(j)
    least = defaultdict(lambda: math.inf)
    for k, key in enumerate(keys):
        least[find(k)] = min([least[find(k)], *(i for i in sets[key] if i is not None)])
    return {key: least[find(k)] for k, key in enumerate(keys)}


def variants(n, seed=0):
    """A base text and near copies with few to many changed words, and unrelated texts."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(120)]
    out = []
    for i in range(n):
        w = list(base) if i % 4 else [f"u{i}_{k}" for k in range(50)]
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"r{rng.random()}"
        out.append((i, " ".join(w)))
    return out


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 8)  # large buckets are met in blocks already here
    monkeypatch.setattr(minhash, "BLOCK", 32)
    rows = variants(150)
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = plain_groups(rows)
    assert {(r.doc_id, r.component_id) for r in out} == {(i, want[shingle_set(t)]) for i, t in rows}
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_near_duplicates_on_odd_rows(spark, odd, odd_rows, empty):
    out = minhash.near_duplicates(odd).collect()
    assert Counter((r.doc_id, r.n_shingles) for r in out) == Counter((i, len(shingle_set(t))) for i, t, *_ in odd_rows)
    component = {r.doc_id: r.component_id for r in out if r.doc_id != 3}
    assert [component[i] for i in (1, 2, 4, 5, 6, 8, 9, 11)] == [1, 1, 4, 5, 6, 8, 8, 1]
    assert all(r.kept and r.component_id is None or r.component_id == 1 for r in out if r.doc_id is None)
    assert minhash.near_duplicates(empty).count() == 0 and minhash.keep_one(odd).columns == odd.columns


def test_blocks_find_the_one_link_among_near_misses():
    def table(texts, label, at):
        batch = pa.RecordBatch.from_arrays([pa.array(range(at, at + len(texts))), pa.array(texts)], ["doc_id", "text"])
        sets = next(minhash._hashes(iter([batch])))
        planes = [minhash.bit_planes(minhash.minima(minhash.shingles(t))).tolist() for t in texts]
        return pa.table({"node": sets["node"], "label": [label] * len(texts), "planes": planes, "found": sets["found"]})

    misses = [[f"m{k}_{i}" for i in range(10)] for k in range(8)]  # 5 of 7 shingles in common: no links
    true = [f"t{i}" for i in range(24)]  # 18 of 22 shingles in common
    x = table([" ".join(w) for w in (true, *misses)], 1, 1)
    y = table([" ".join(w[:-1] + ["other"]) for w in ([*true[:-1], "more"], *misses)], 2, 101)
    least = 0  # whatever the estimate says, only the full sets decide
    found = minhash._between(x, y, least, 75).to_pylist()
    assert {"a": 1, "b": 101} in found and len(found) == 1
    assert minhash._between(x.slice(1), y.slice(1), least, 75).num_rows == 0


def test_estimate_is_near_the_similarity():
    a, b = [f"x{i}" for i in range(400)], [f"x{i}" for i in range(60, 460)]
    x, y = (minhash.shingles(" ".join(w)) for w in (a, b))
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    p, q = (minhash.bit_planes(minhash.minima(s)).view(np.uint64).reshape(4, 2) for s in (x, y))
    m = 128 - int(np.bitwise_count(np.bitwise_or.reduce(p ^ q, axis=0)).sum())
    assert abs((m / 128 - 1 / 16) / (15 / 16) - true) < 0.15


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (100, 90)]
    out = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {i: 1 for i in range(1, 41)} | {90: 90, 95: 90, 100: 90}


def test_bpe_equals_the_library(spark, odd, odd_rows, empty):
    t = Tokenizer.from_file(bpe.default_tokenizer())
    texts = [x for _, x, *_ in odd_rows] + ["<|endoftext|>a <|startoftext|>", "it's 123 don't!! ΣΑΣ", "aaaa" * 50, " x y"]
    docs = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)], "doc_id long, text string, ids int")
    for r in bpe.encode(docs, bpe.default_tokenizer()).collect():
        ids = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids and r.n_tokens == len(ids) and r.decoded == t.decode(ids, skip_special_tokens=False)
    assert bpe.digests(bpe.encode(empty, bpe.default_tokenizer())).count() == 0
    r = bpe.digests(bpe.encode(odd.where("doc_id = 5"), bpe.default_tokenizer())).first()
    assert r.ids_sha256 == r.decoded_sha256 == hashlib.sha256(b"").hexdigest()


def test_bpe_random_words():
    t, c = Tokenizer.from_file(bpe.default_tokenizer()), bpe.PairIndexBPE(open(bpe.default_tokenizer(), encoding="utf-8").read())
    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice("aabbcehinorst lé'1!") for _ in range(rng.randint(0, 60)))
        found = c.lookup(text)
        c.settle()
        assert np.frombuffer(c.ids(found), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def plain_kn(train, texts, order=3):
    """Interpolated modified Kneser-Ney with dictionaries: counts of the longest n-grams, below them numbers of different longer ones."""
    tokens = lambda t: [*(t or "").encode().lower().split(), "END"]

    def grams(t):
        w = ["BEGIN"] * (order - 1) + tokens(t)
        return [tuple(w[i : i + order]) for i in range(len(w) - order + 1)]

    uni, levels = Counter(x for t in train for x in tokens(t)), [Counter(g for t in train for g in grams(t))]
    for _ in range(order - 1):
        levels.append(Counter(g[1:] for g in levels[-1]))
    levels = levels[::-1]  # by length of the n-gram, the shortest first
    n, v = sum(uni.values()), len(uni)
    d = [kneser_ney.discounts(*(sum(c == k for c in x.values()) for k in (1, 2, 3, 4))) for x in levels]
    total, follow = [Counter() for _ in levels], [defaultdict(Counter) for _ in levels]
    for i, x in enumerate(levels):
        for g, c in x.items():
            total[i][g[:-1]] += c
            follow[i][g[:-1]][min(c, 3)] += 1

    def p(g):
        if not g:
            return 1 / (v + 1)
        i, context = len(g) - 1, g[:-1]
        if not total[i][context]:
            return p(g[1:])
        c = levels[i][g]
        spare = sum(d[i][k] * m for k, m in follow[i][context].items())
        return (max(c - d[i][min(c, 3)], 0) + spare * p(g[1:])) / total[i][context]

    out = []
    for t in texts:
        base = sum(math.log10((uni[b] + 0.1) / (n + 0.1 * (v + 1))) for b in tokens(t))
        out.append((len(tokens(t)), sum(uni[x] > 0 for x in tokens(t)), n, base, sum(math.log10(p(g)) for g in grams(t))))
    return out


def test_kneser_ney_equals_dictionaries(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    import zlib

    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    want = plain_kn([t for i, t in rows if not held[i]], [t for _, t in rows], kneser_ney.ORDER)
    got = {r.doc_id: r for r in kneser_ney.op10_kneser_ney(spark, SF).collect()}
    for (i, _), (n, known, total, base, score) in zip(rows, want, strict=True):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, held[i])
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)


@pytest.mark.parametrize("order", [2, 3])
def test_kneser_ney_over_many_portions(spark, monkeypatch, order):
    """Counts over 255, short and empty texts, a frequent word and context, portions that share most n-grams."""
    monkeypatch.setattr(kneser_ney, "PORTION", 500)
    monkeypatch.setattr(kneser_ney, "SHARD_BYTES", 2000)
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "the", f"w{rng.randrange(300)}"]) for _ in range(60)) for _ in range(120)] + [" ".join(["the x"] * 300)] + ["", None, "the", "A b", "a B"] * 60
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    model = kneser_ney.train(docs, order)
    assert int(kneser_ney.BEGIN) in model.hot and max(model.hot.values()) > 1
    ask = [*texts, "the never-seen the", "w1 w2 w3 never seen", "never"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ask)], "doc_id long, text string")
    got = [r.score for r in kneser_ney.score(rows, model).orderBy("doc_id").collect()]
    assert got == pytest.approx([x[4] for x in plain_kn(texts, ask, order)], rel=1e-9)
    # After a known context the probabilities of all words and of one unknown word add up to 1.
    words = sorted({w.lower() for t in texts for w in (t or "").split()})
    for context in ("the", "the x", "a b"):
        k = len(context.split())
        hashes = [kneser_ney.token_hashes(f"{context} {w}") for w in [*words, "never-seen"]] + [kneser_ney.token_hashes(context)]
        alone = lambda h: 10 ** (model.score([h[: k + 1]])[3][0] - model.score([h[:k]])[3][0])
        assert sum(map(alone, hashes)) == pytest.approx(1.0, abs=1e-6)


def test_kneser_ney_on_odd_rows(odd, odd_rows, empty):
    model = kneser_ney.train(odd)
    out = kneser_ney.score(odd.withColumnRenamed("label", "base_score"), model).collect()
    assert len(out) == len(odd_rows) and all(np.isfinite(r.score) and isinstance(r.score, float) for r in out)
    nothing = kneser_ney.train(empty)
    assert nothing.tokens == 0 and kneser_ney.score(empty, nothing).count() == 0
    assert {r.score for r in kneser_ney.score(odd.select("doc_id", "text"), nothing).collect()} == {0.0}


def test_language_id(spark, odd, odd_rows, empty):
    out = language_id.op7_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97 and out.where("score < 0 or score > 1").count() == 0
    model = language_id.train(odd)
    rows = language_id.predict(odd, model).collect()
    assert len(rows) == len(odd_rows) and {r.lang_pred for r in rows if r.doc_id in (4, 5, 6)} == {"und"} and {r.lang_pred for r in rows} <= {"en", "fr", "und"}
    assert {r.lang_pred for r in language_id.predict(odd, language_id.train(empty)).collect()} == {"und"}


def plain_grams(text):
    """Counts of hashed n-grams, one by one."""
    if not any(map(str.isalpha, text)):
        return Counter()
    c = [max(ord(x), 32) if ord(x) >= 33 else 32 for x in text.lower()]
    out = Counter()
    for order in (1, 2, 3):
        for i in range(len(c) - order + 1):
            h = 0
            for x in c[i : i + order]:
                h = (h + x) * 0x9E3779B97F4A7C15 % 2**64
            out[h >> 49] += 1
    return out


def test_language_id_equals_dictionaries():
    """Features, weights by follow-the-regularised-leader and the softmax, with dictionaries and one coordinate at a time."""
    rng = random.Random(8)
    texts = ["Der Hund bellt und das Haus ist gro\u00df", "le chien et la maison de la ville", "the dog and the house in the town", "", "123 !!"]
    texts += [" ".join(rng.choice(t.split()) for _ in range(6)) for t in texts[:3] for _ in range(5)]
    for t in texts:
        found = language_id.counts(t)
        assert {int(k): int(found[k]) for k in np.flatnonzero(found)} == plain_grams(t)
    labelled = [(t, i % 3) for i, t in enumerate(texts[:3])] + [(t, i // 5) for i, t in enumerate(texts[5:])]
    df = Counter(k for t, _ in labelled for k in plain_grams(t))
    idf = lambda k: math.log((1 + len(labelled)) / (1 + df[k])) + 1

    def vector(t):
        x = {k: (1 + math.log(n)) * idf(k) for k, n in plain_grams(t).items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        return {k: v / size for k, v in x.items()} | {language_id.SIZE: 1.0}

    rows = [(vector(t), y) for t, y in labelled]
    train = [r for i, r in enumerate(rows) if i % 5]
    z, n = defaultdict(float), defaultdict(float)
    L = language_id

    def weight(k, c):
        if abs(z[k, c]) <= L.L1:
            return 0.0
        return -(z[k, c] - math.copysign(L.L1, z[k, c])) / ((L.BETA + math.sqrt(n[k, c])) / L.ALPHA + L.L2)

    def softmax(x):
        s = [sum(v * weight(k, c) for k, v in x.items()) for c in range(3)]
        e = [math.exp(v - max(s)) for v in s]
        return [v / sum(e) for v in e]

    for epoch in range(L.EPOCHS):
        for i in np.random.RandomState(epoch).permutation(len(train)):
            x, y = train[i]
            p = softmax(x)
            for k, v in x.items():
                for c in range(3):
                    w, g = weight(k, c), v * (p[c] - (c == y))
                    z[k, c] += g - (math.sqrt(n[k, c] + g * g) - math.sqrt(n[k, c])) / L.ALPHA * w
                    n[k, c] += g * g
    scale = np.array([idf(k) for k in range(L.SIZE)])
    w, t = L.fit([(*L.tf_idf(L.counts(x), scale), y) for x, y in labelled], 3)
    assert all(w[k, c] == pytest.approx(weight(k, c), abs=1e-5) for k, c in list(z)) and np.count_nonzero(w) <= len(z)
    assert [int(np.argmax(softmax(vector(x)))) for x, _ in labelled] == [y for _, y in labelled] and 2.0**-4 <= t <= 4


def test_language_id_on_copies_of_one_text(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "'the same text each time' as text", "'en' as lang")
    out = language_id.predict(docs, language_id.train(docs)).groupBy("lang_pred").count().collect()
    assert [tuple(r) for r in out] == [("en", 3000)]


def test_language_id_sample_counts_texts_not_copies(spark, monkeypatch):
    def count_rows(table, idf, langs):
        return pa.table({"w": pa.array([bytes(4 * (language_id.SIZE + 1) * len(langs))], pa.binary()), "t": [float(table.num_rows)]})

    monkeypatch.setattr(language_id, "_train", count_rows)
    copies = spark.range(40_000).selectExpr("'the same few words' as text", "'en' as lang")
    others = spark.range(300).selectExpr("concat('text of number ', id) as text", "'en' as lang")
    model = language_id.train(copies.unionByName(others), sample=100)
    assert model[0] == ["en"] and model[2] == 100  # by a share of the rows, 2 of the 301 texts were left
    alone = language_id.train(copies, sample=1)
    assert alone[0] == ["en"] and alone[2] == 1


def plain_top(rows, k=10):
    v = []
    for i, x in rows:
        if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            v.append((i, tuple(int(Fraction(c) * 1024 // 1) for c in x)))
    out = []
    for q, x in {i: min(y for j, y in v if j == i) for i, _ in v if i % 100 == 0}.items():
        found = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), i) for i, y in v if i != q)[:k]
        out += [(q, r + 1, i, min(max(-s, -(2**63)), 2**63 - 1)) for r, (s, i) in enumerate(found)]
    return Counter(out)


@pytest.mark.parametrize("kind", ["spread", "ties", "few", "huge"])
def test_top_k_matches_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(top_k, "BLOCK", 64)
    monkeypatch.setattr(top_k, "QUERY_BLOCK", 2)
    rng = np.random.RandomState(4)
    n = 7 if kind == "few" else 500
    x = rng.randn(n, 8) * np.exp(rng.randn(n, 1)) * 0.2 if kind in ("spread", "huge") else rng.randint(-1, 2, (n, 8)) * 0.25
    rows = [(i, [float(c) for c in y]) for i, y in enumerate(x)] + [(902, [None] * 8), (903, [float("nan")] * 8), (None, [1.0] * 8), (1, [float(c) for c in x[1]]), (904, None), (905, [float("inf")] * 8), (1, [0.5] * 3), (5, [])]
    if kind == "huge":
        sizes = (1e12, 1e13, 2.0**43, 2.0**52 + 1, 1e18, 1e100, 1.7e308, -1e13, -1e200)
        rows += [(1000 + k, [0.0] * (k % 8) + [c]) for k, c in enumerate(sizes * 3)] + [(2000, [1e13] * 8), (2100, [1e160, -1e13]), (2200, [-1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "0 as rank", "'x' as norm", "1 as bucket", "2 as v", "3 as query_id")
    out = top_k.top_k(df, F.col("vec_id") % 100 == 0).collect()
    assert Counter(tuple(r) for r in out) == plain_top(rows)


def test_top_k_of_one_common_vector(spark, monkeypatch):
    monkeypatch.setattr(top_k, "BLOCK", 64)
    rows = [(i if i < 20 else 7, [0.5, 0.25]) for i in range(400)]
    out = top_k.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, 3).collect()
    assert sorted(map(tuple, out)) == [(0, r, i, 512 * 512 + 256 * 256) for r, i in ((1, 1), (2, 2), (3, 3))] + [(10, r, i, 512 * 512 + 256 * 256) for r, i in ((1, 0), (2, 1), (3, 2))]


def test_top_k_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k.top_k(none, F.col("vec_id") % 100 == 0).count() == 0


def test_importance(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(1, 1, 0), (8, 1, 0), (10, 0, 0), (7, 1, 1), (None, 1, 0), (8, 1, None)], "doc_id long, quality int, toxic int")
    out = importance.select(odd, labels).collect()
    assert len(out) == len(odd_rows) and {r.log_weight for r in out if r.doc_id in (4, 5, 6)} == {0.0}
    kept = sorted((r.gumbel_key for r in out if r.kept), reverse=True)
    assert len(kept) >= 8 and min(kept) >= max(r.gumbel_key for r in out if not r.kept)
    assert importance.select(empty, labels).count() == 0
    assert importance.select(odd, labels, k=3).where("kept").count() >= 3
    none = labels.where("doc_id < 0")
    assert {r.log_weight for r in importance.select(odd, none).collect()} == {0.0}


def plain_importance(rows, labels):
    """doc_id to (n_ngrams, log_weight, gumbel_key) and the number kept, by dictionaries."""
    mask = 2**64 - 1

    def found(text):
        h = [xxhash.xxh3_64_intdigest(w) for w in (text or "").encode().lower().split()]
        pairs = [((a * 0x9E3779B97F4A7C15 + b) * 0xD6E8FEB86659FD93) & mask for a, b in zip(h, h[1:], strict=False)]
        return [x >> 46 for x in h + pairs]

    judged = defaultdict(list)
    for i, quality, toxic in labels:
        judged[i].append(quality == 1 and not toxic)
    good = {i for i, x in judged.items() if all(x)}
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(found(t))
        if i in good:
            target.update(found(t))
    p = lambda c, b: math.log((c[b] + 1) / (sum(c.values()) + 2**18))
    out = {}
    for i, t in rows:
        weight = sum(p(target, b) - p(raw, b) for b in found(t))
        h = xxhash.xxh64_intdigest(t.encode(), xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42))
        out[i] = (len(found(t)), weight, weight - math.log(-math.log(((h >> 12) + 0.5) / 2**52)))
    return out, round(len(rows) * len(good) / len(judged))


def test_importance_equals_dictionaries(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("text is not null")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic")
    want, k = plain_importance([tuple(r) for r in docs.collect()], [tuple(r) for r in labels.collect()])
    out = importance.select(docs, labels).collect()
    last = sorted((x[2] for x in want.values()), reverse=True)[k - 1]
    for r in out:
        n, weight, key = want[r.doc_id]
        assert r.n_ngrams == n and r.log_weight == pytest.approx(weight, abs=1e-6) and r.gumbel_key == pytest.approx(key, abs=1e-6) and r.kept == (key >= last - 1e-9)
    assert sum(r.kept for r in out) == k > 0


def test_importance_prefers_the_target(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["good", "fine", "nice"] if i % 2 else ["bad", "poor", "junk"]) for _ in range(30))) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    out = importance.select(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    assert all(r.kept == bool(r.doc_id % 2) for r in out)


def test_kth_largest(spark):
    values = [random.Random(5).randrange(1 << 52) for _ in range(500)] + [77] * 40
    df = spark.createDataFrame([(v,) for v in values], "x long")
    for k in (1, 3, 250, 500, 510, 540):
        assert importance.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]


CALL = {"content": None, "tool_calls": [{"id": "c1", "name": "add", "arguments": {"b": 2, "a": 1}}]}
TOOLS = {"add": {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "integer"}}, "required": ["a", "b"], "additionalProperties": False}}


def test_chat_links_orders_and_validates(spark):
    bad = {"tool_calls": [{"id": "c2", "name": "add", "arguments": {"a": "1", "b": 2}}]}
    rows = [
        (1, 0, "user", "add é"), (1, 1, "tool", json.dumps({"tool_call_id": "c1", "content": "3"})), (1, 2, "assistant", json.dumps(CALL)), (1, 3, "assistant", "done"),
        (2, 0, "assistant", json.dumps(bad)), (2, 1, "tool", json.dumps({"tool_call_id": "zz"})), (3, 5, None, None), (3, None, "user", "{broken"), (None, 0, "user", ""), (3, 5, None, None),
    ]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), TOOLS).collect()
    one = sorted((r.position, r.turn, r.n_calls, r.n_linked, r.problem) for r in out if r.conv_id == 1)
    assert one == [(0, 0, 0, 0, None), (1, 2, 1, 1, None), (2, 1, 0, 1, None), (3, 3, 0, 0, None)]
    assert next(r.message for r in out if r.n_calls and r.conv_id == 1) == '{"content":null,"role":"assistant","tool_calls":[{"arguments":{"a":1,"b":2},"id":"c1","name":"add"}]}'
    assert {r.problem for r in out if r.conv_id == 2} == {"arguments.a is no integer", "no call of this result"}
    assert sorted(r.position for r in out if r.conv_id == 3) == [0, 1, 2] and len(out) == len(rows)
    assert next(r.message for r in out if r.conv_id == 3 and r.turn is None) == '{"content":"{broken","role":"user"}'


@pytest.mark.parametrize(("value", "schema", "why"), [
    (True, {"type": "integer"}, "is no integer"), ({"x": 1}, {"required": ["y"]}, "lacks y"), ([1, "a"], {"items": {"type": "number"}}, "[1] is no number"),
    ("c", {"enum": ["a"]}, "none of"), ({"z": 1}, {"additionalProperties": False}, "has z"), (1.5, {"type": "number"}, None),
    ("x", {"type": "uri"}, "unknown type uri"), (2.0, {"type": "integer"}, None), (True, {"enum": [1]}, "none of"), (3, {"maximum": 2}, "above 2"), ("ab", {"minLength": 3}, "below 3"),
    ([], {"minItems": 1}, "below 1"), ("ab", {"pattern": "^b"}, "pattern"), ({"a": 1}, {"properties": {"a": False}}, "not allowed"), (1, "x", "no schema"), (2, {"const": 3}, "none of"),
    ({"a": "x"}, {"additionalProperties": {"type": "integer"}}, "arguments.a is no integer"),
])
def test_schema(value, schema, why):
    found = chat.invalid(value, schema)
    assert found is None if why is None else why in found


def test_schema_with_a_list_of_types():
    schema = {"type": ["string", "null"]}
    assert chat.invalid("x", schema) is None and chat.invalid(None, schema) is None
    assert chat.invalid(1, schema) == "arguments is no string or null"
    assert chat.invalid(True, {"type": ["integer", "null"]}) == "arguments is no integer or null"


def plain_chats(rows, tools):
    """(conv, position, turn, role, message, n_calls, n_linked, problem) of turns, by walking through each conversation."""
    parsed = [(c, t, r, *chat.parse(r, x, tools)) for c, t, r, x in rows]
    first = {}
    for c, t, _, _, calls, _, _ in parsed:
        for call in calls:
            key = (c, call["id"])
            first[key] = min(first.get(key, t), t, key=lambda v: math.inf if v is None else v)
    answered = {(c, a) for c, _, _, _, _, a, _ in parsed if a is not None}
    out, low = [], -math.inf
    null_low = lambda v: low if v is None else v
    for conv in {c for c, *_ in rows}:
        here = []
        for c, t, r, message, calls, answers, problem in parsed:
            if c != conv:
                continue
            at, after, linked = t, False, 0
            if answers is not None:
                linked = int((c, answers) in first)
                problem = problem or (None if linked else "no call of this result")
                call = first.get((c, answers))
                if call is not None and t is not None and call > t:
                    at, after = call, True
            elif calls:
                linked = sum((c, x["id"]) in answered for x in calls)
                problem = problem or ("a call without result" if linked < len(calls) else None)
            here.append(((null_low(at), after, null_low(t), r is not None, r or "", message), (t, r, message, len(calls), linked, problem)))
        out += [(conv, k, *x) for k, (_, x) in enumerate(sorted(here, key=lambda x: x[0]))]
    return Counter(out)


@pytest.mark.parametrize("seed", range(3))
def test_chats_equal_plain_version(spark, monkeypatch, seed):
    monkeypatch.setattr(shared, "SPREAD", 5)
    rng = random.Random(seed)
    rows = []
    for _ in range(200):
        conv, turn, name = rng.choice([1, 1, 1, 2, 3, None]), rng.choice([*range(12), None]), f"c{rng.randrange(6)}"
        text = rng.choice([
            "plain \u00e9", "", None, "{broken", '{"a": NaN}', '{"content":"\\ud800","tool_calls":[{"id":"\\ud800","name":"add","arguments":{}}]}',
            json.dumps({"tool_calls": [{"id": name, "name": rng.choice(["add", "other"]), "arguments": rng.choice([{"a": 1, "b": 2}, {"a": "1"}, None])} for _ in range(rng.randint(0, 2))]}),
            json.dumps({"tool_call_id": name, "content": rng.choice([1, None, "x"])}), json.dumps({"tool_calls": [7, {"id": 1}]}),
        ])
        rows.append((conv, turn, rng.choice(["user", "assistant", "tool", "tool", None]), text))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as position", "'x' as message", "2 as link", "3 as n_calls")
    out = chat.format_chats(frame.repartition(3), TOOLS).collect()
    assert Counter(tuple(r) for r in out) == plain_chats(rows, TOOLS)


def test_chat_query_links_validates_and_orders(spark):
    out = chat.op6_chat_format(spark, SF)
    facts = {r.problem: r["count"] for r in out.groupBy("problem").count().collect()}
    assert out.where("role = 'tool' and n_linked = 1").count() > 10 and facts["no call of this result"] and facts["a call without result"] and facts["no tool erase"]
    assert any("is no integer" in (p or "") for p in facts) and any("lacks" in (p or "") for p in facts)
    turns = [(r.conv_id, r.position, r.turn) for r in out.orderBy("conv_id", "position").collect()]
    assert any(a[0] == b[0] and a[2] > b[2] for a, b in zip(turns, turns[1:], strict=False))  # a late result was moved


def test_chat_of_nothing(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
