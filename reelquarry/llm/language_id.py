"""Language ID: sparse multinomial logistic regression on TF-IDF of character n-grams.

N-grams of one to three characters of the lower-case text are hashed to 32,768 features; document frequencies are
counted in Spark over all training documents. The weights are trained with follow-the-regularised-leader and
elastic-net penalties on a bounded sample of labelled rows (SAMPLE rows in all, dealt evenly to the languages, those
with the smallest hashes), in one task. A fifth of the sample is held back to fit the temperature of the softmax.
Prediction reads every whole text.

Defined results: `und` with score 0 for texts that are null or have no letter, and for all texts where no labelled
training row exists or none is drawn; null ids count as crc32 0; repeated rows are predicted alike; further columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import crc_mod
from .shared import bound_batches, spread

BITS, ORDERS = 15, 3
SIZE = 1 << BITS
#: Labelled rows that the weights are fitted on, at most.
SAMPLE = 4000
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.002, 0.002, 3
UNKNOWN = "und"
#: Distinct texts that are looked at for each row of the sample, and beyond that so that few wanted rows are found as well; the grain of shares of the hashes.
SPARE, LEAST, GRAIN = 8, 32, 1 << 20
#: Code points that are hashed at once.
STRETCH = 1 << 20


def counts(text: str) -> np.ndarray:
    """Counts of the text's hashed n-grams; all zero for a text without letters."""
    out = np.zeros(SIZE, np.int64)
    if not any(map(str.isalpha, text)):
        return out
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    c[(c < 33)] = 32
    with np.errstate(over="ignore"):
        for at in range(0, len(c), STRETCH):
            part = c[at : at + STRETCH + ORDERS - 1]
            fresh = min(STRETCH, len(c) - at)
            h = np.zeros(len(part), np.uint64)
            for order in range(ORDERS):
                n = len(part) - order
                if n <= 0:
                    break
                h = (h[:n] + part[order:]) * np.uint64(0x9E3779B97F4A7C15)
                out += np.bincount((h[:fresh] >> np.uint64(64 - BITS)).astype(np.int64), minlength=SIZE)
    return out


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, n = np.zeros(SIZE, np.int64), 0
    for b in batches:
        for text in b.column(0):
            found = counts(text.as_py() or "")
            seen += found > 0
            n += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int32()), pa.array([*seen[at].tolist(), n], pa.int64())], ["feature", "n"])


def tf_idf(found: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features present and their weights, of length 1."""
    at = np.flatnonzero(found)
    x = (1 + np.log(found[at])) * idf[at]
    return at, x / max(np.sqrt((x * x).sum()), 1e-12)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int) -> tuple[np.ndarray, float]:
    """Weights (features and a bias, classes) and temperature. Every fifth example only serves the temperature."""
    z, n = np.zeros((SIZE + 1, n_classes)), np.zeros((SIZE + 1, n_classes))

    def weights(at: np.ndarray) -> np.ndarray:
        free = np.abs(z[at]) > L1
        return np.where(free, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    rows = [(np.append(at, SIZE), np.append(x, 1.0), y) for at, x, y in examples]
    train = [r for i, r in enumerate(rows) if i % 5] or rows
    for epoch in range(EPOCHS):
        for i in np.random.RandomState(epoch).permutation(len(train)):
            at, x, y = train[i]
            w = weights(at)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(np.arange(SIZE + 1))
    held = [(x @ w[at], y) for i, (at, x, y) in enumerate(rows) if i % 5 == 0] or [(x @ w[at], y) for at, x, y in rows]
    loss = lambda t: -sum(np.log(max(_softmax(s / t)[y], 1e-12)) for s, y in held)
    return w.astype(np.float32), min((2.0 ** (i / 4) for i in range(-16, 9)), key=loss)


def _train(table: pa.Table, idf: bytes, langs: list[str]) -> pa.Table:
    scale = np.frombuffer(idf)
    rows = sorted(zip(table["h"].to_pylist(), table["text"].to_pylist(), table["lang"].to_pylist(), strict=True))
    w, t = fit([(*tf_idf(counts(text), scale), langs.index(lang)) for _, text, lang in rows], len(langs))
    return pa.table({"w": pa.array([w.tobytes()], pa.binary()), "t": [t]})


def _predict(batches: Iterator[pa.RecordBatch], model: tuple) -> Iterator[pa.RecordBatch]:
    langs, w, t, idf = model
    for b in batches:
        best, scores = [], []
        for text in b.column(0):
            found = counts(text.as_py() or "")
            if not langs or not found.any():
                best.append(UNKNOWN)
                scores.append(0.0)
                continue
            at, x = tf_idf(found, idf)
            p = _softmax((x @ w[at] + w[SIZE]) / t)
            best.append(langs[int(p.argmax())])
            scores.append(float(p.max()))
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(best, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names[1:], "lang_pred", "score"])


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple:
    """Languages, weights, temperature and inverse document frequencies, from docs (text, lang)."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    seen = spread(rows.select("text")).mapInArrow(_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    found = {r.feature: r.n for r in seen.collect()}  # a row for each feature, 32,769 at most
    n = found.pop(-1, 0)
    df = np.zeros(SIZE)
    df[list(found)] = list(found.values())
    idf = np.log((1 + n) / (1 + df)) + 1
    labelled = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    # The sample bounds the number of languages as well: the most frequent ones first.
    # Texts are told apart by their hashes, so that copies neither count nor take places.
    texts = labelled.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("copies"))
    counted = texts.groupBy("lang").agg(F.sum("copies").alias("rows"), F.count(F.lit(1)).alias("texts")).orderBy(F.col("rows").desc(), "lang").limit(sample).collect()
    langs = sorted(r.lang for r in counted)
    if not langs:
        return [], np.zeros((SIZE + 1, 0), np.float32), 1.0, idf
    each = max(1, sample // len(langs))
    # Of each language, a share of the hashes that holds some times the texts wanted, or all of them.
    share = [(r.lang, ceil(min(1.0, (SPARE * each + LEAST) / r.texts) * GRAIN)) for r in counted]
    shares = F.broadcast(docs.sparkSession.createDataFrame(share, "lang string, share long"))  # no more rows than the sample
    few = labelled.join(shares, "lang").where(F.pmod("h", F.lit(GRAIN)) < F.col("share")).dropDuplicates(["lang", "h"])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(GRAIN)), "h"))
    chosen = few.withColumn("nth", nth).where(F.col("nth") <= each)
    raw = idf.tobytes()
    fitted = chosen.select("h", "text", "lang", F.lit(0).alias("one")).groupBy("one").applyInArrow(lambda t: _train(t, raw, langs), "w binary, t double").first()
    if fitted is None:
        return [], np.zeros((SIZE + 1, 0), np.float32), 1.0, idf
    return langs, np.frombuffer(fitted.w, np.float32).reshape(SIZE + 1, len(langs)), fitted.t, idf


def predict(docs: DataFrame, model: tuple) -> DataFrame:
    """docs with text replaced by lang_pred and score. Columns of docs with these names are replaced."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features by languages, of a size that the input doesn't change
    own = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    rows = docs.select(F.col("text").cast("string").alias("text"), *own)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text"]
    return spread(rows).mapInArrow(lambda it: _predict(it, shared.value), ", ".join([*fields, "lang_pred string", "score double"]))


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, 3) == 1


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """Contract query over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()))
    return predict(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
