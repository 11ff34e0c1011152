"""The pipeline against a plain version of each stage, and on odd rows."""

import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from test_free import plain_groups, shingle_set
from test_native import WORD, plain_dedup, plain_facts, plain_mix
from tokenizers import Tokenizer

from reelquarry.llm import bpe, quality_rules

SF = "/root/testdata/sf0.001"


def toxic_vocabulary(docs, labels):
    """Toxic words from (doc_id, text) and (doc_id, toxic)."""
    flag = defaultdict(int)
    for i, toxic in labels:
        flag[i] = max(flag[i], toxic)
    texts = {}
    for i, t in docs:
        if i in flag and t is not None:
            texts[t] = max(texts.get(t, 0), flag[i])
    hold = (Counter(), Counter())
    for t, f in texts.items():
        hold[f].update({x.lower().strip(quality_rules.PUNCTUATION) for x in WORD.findall(t)} - {""})
    n = sum(texts.values())
    others = max(len(texts) - n, 1)
    return {w for w, c in hold[1].items() if c >= 5 and c >= 0.01 * n and c * others >= 50 * n * (hold[0][w] + 1)}


def passes(text, vocabulary):
    n, chars, symbols, dup, repeat = plain_facts(text)
    t, w = text or "", WORD.findall(text or "")
    lines = [x for x in t.split("\n") if WORD.search(x)]
    toxic = sum(x.lower().strip(quality_rules.PUNCTUATION) in vocabulary for x in w)
    upper, stutter = sum("A" <= c <= "Z" for c in t), sum(a == b for a, b in zip(w, w[1:], strict=False))
    failed = (
        n < 20, 100 * repeat > 30 * n, 100 * dup > 30 * len(lines) and dup > 1, 100 * symbols > 10 * n, chars < 2 * n or chars > 15 * n,
        100 * upper > 40 * chars, 100 * t.count("!!") > 20 * n and n > 0, 1000 * t.count("�") > chars, toxic >= 2, 100 * stutter > 20 * n,
    )
    return not any(failed)


def plain_copies(rows):
    """(doc_id, text, source) to how often the mix takes each."""
    size = {i: len(WORD.findall(t)) for i, t, _ in rows}
    target = plain_mix([(s, size[i]) for i, _, s in rows])
    by_source, out = defaultdict(list), {}
    for i, t, s in rows:
        by_source[s].append((int(hashlib.md5(f"{i}:{t}".encode()).hexdigest()[:13], 16), i))
    for s, found in by_source.items():
        total = sum(size[i] for _, i in found)
        rounds = int(target[s] // total) if total else 0
        budget, upto = target[s] - rounds * total, 0
        for _, i in sorted(found):
            take = upto + size[i] <= budget or (upto <= budget and upto + size[i] - budget < budget - upto)
            upto += size[i]
            out[i] = rounds + take
    return out


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_pipeline_equals_plain_stages(spark, sf):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    vocabulary = toxic_vocabulary([(i, t) for i, t, _ in docs], labels)
    good = [(i, t, s) for i, t, s in docs if passes(t, vocabulary)]
    texts = plain_dedup([(i, t) for i, t, _ in good], corpus_pipeline.COPIES_FROM)
    groups = plain_groups(texts.items())
    kept = [(i, texts[i], s) for i, _, s in good if not shingle_set(texts[i]) or groups[shingle_set(texts[i])] == i]
    copies = plain_copies(kept)
    coder = Tokenizer.from_file(bpe.default_tokenizer())
    want = Counter()
    for i, t, _ in kept:
        ids = np.array(coder.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        want[(i, len(ids) // 4, hashlib.sha256(ids).hexdigest())] += copies[i]
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens", "ids_sha256").collect())
    assert got == +want and len(docs) > len(good) > len(kept) and min(n for _, n, _ in got) > 0


def test_stages_keep_columns_on_odd_rows(spark, odd, empty):
    for start in (odd, empty):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == start.columns and docs.schema["n_chars"].dataType == start.schema["n_chars"].dataType
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_clean_documents_stay(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(40)), "en", "a", 0) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF)
        assert docs.count() == 30 and re.fullmatch("[a-z_]+", name)
