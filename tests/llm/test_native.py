"""Quality rules, line dedup and mixing: against SQL, against plain Python, and on odd rows."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sqlcheck import check

from reelquarry.llm import catalogue, importance, line_dedup, minhash, mixing, quality_rules, shared
from reelquarry.llm.oracles import SQL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", [n for n in sorted(SQL) if n != "op4_minhash_near_dedup"])
def test_query_matches_sql(spark, name):
    check(spark, catalogue.queries()[name], SQL[name])


def plain_facts(text):
    w = WORD.findall(text or "")
    windows = defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    repeated = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


def test_rules_on_odd_rows(odd, odd_rows):
    out = quality_rules.ledger(odd.select("doc_id", "text")).collect()
    want = Counter((i, *plain_facts(t)) for i, t, *_ in odd_rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == want


def test_rules_repeated_windows(spark):
    eight = "a b c d e f g h"
    texts = [eight, eight + " " + eight, "x " + eight + " y " + eight, " ".join(["a"] * 20), eight + " " + eight[2:], "a b c d e f g h a b c d e f g"]
    out = quality_rules.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert [r.n_repeat_words for r in out] == [plain_facts(t)[4] for t in texts]


def test_toxic_words_come_from_labels(spark, odd, empty):
    mark = lambda i: f"dreckhund{i % 3}"
    rows = [(i, f"text of number {i} with {mark(i)} and {mark(i + 1).upper()}!" if i % 5 == 0 else f"text of number {i} with nothing and no one") for i in range(200)]
    docs = spark.createDataFrame([*rows, (900, None), (None, "dreckhund1")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(150)] + [(0, None), (None, 1), (7, 0), (7, 0)], "doc_id long, toxic int")
    found = quality_rules.toxic_words(docs, labels)
    assert sorted(found) == ["dreckhund0", "dreckhund1", "dreckhund2"]
    out = {r.doc_id: r.n_toxic for r in quality_rules.measure(docs, found).collect()}
    assert out[195] == 2 and out[3] == out[900] == 0 and out[None] == 1
    assert quality_rules.toxic_words(docs, labels.where("doc_id < 0")) == [] and quality_rules.toxic_words(empty, labels) == []
    assert quality_rules.toxic_words(odd.drop("label"), spark.createDataFrame([(1, 1), (2, None)], "doc_id long, toxic int")) == []


def test_rules_filter_keeps_columns(odd, empty):
    assert quality_rules.filter_documents(odd.drop("n_words")).columns == odd.drop("n_words").columns
    assert quality_rules.filter_documents(empty).count() == 0


def test_ablation(spark):
    rows = spark.createDataFrame([(0,), (1,), (3,), (2,), (0,)], "failed_bits long")
    out = {r.rule: (r.n_failed, r.n_only_this, r.n_pass_without) for r in quality_rules.ablation(rows, quality_rules.BASE).collect()}
    assert out == {"few_words": (2, 1, 3), "repeated_windows": (2, 1, 3)}


def test_lines_multi_line_passage_goes_once(spark):
    passage = "\n".join(f"short line {i} of a passage" for i in range(40))
    prose = " ".join(f"This is sentence {i} of a paragraph." for i in range(20))
    docs = [(1, f"intro\n{passage}\nend"), (2, f"other begin\nand more\n{passage}\nfinish"), (3, f"x\n{prose}\ny"), (4, f"p. {prose} The end."), (5, "clean\nshort\nend"), (6, "clean")]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[1].text == docs[0][1] and out[3].text == docs[2][1] and out[5].text == docs[4][1] and out[6].text == "clean"
    assert out[2].n_lines_removed > 25 and out[2].text.startswith("other begin") and out[2].text.endswith("finish")
    assert out[4].n_lines_removed > 10 and out[4].text.startswith("p. ") and out[4].text.endswith(" The end.")
    assert [out[i].n_lines for i in (1, 4, 6)] == [42, 22, 1]


def test_lines_leave_whole_copies(spark):
    line = lambda k, i: f"line {i} of the document number {k}"
    whole = "\n".join(line(1, i) for i in range(40))
    near = "\n".join(line(1, i) if i != 20 else "another line" for i in range(40))
    part = "\n".join([line(1, i) if 10 <= i < 30 else line(3, i) for i in range(80)])
    docs = spark.createDataFrame([(1, whole), (2, near), (3, part), (4, whole)], "doc_id long, text string")
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs, copies_from=0.5).collect()}
    assert out[2].text == near and out[4].text == whole and out[2].n_lines_removed == 0 < out[3].n_lines_removed
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}[4] == ""


def test_lines_hot_chunks_are_spread(spark, monkeypatch):
    monkeypatch.setattr(shared, "SPREAD", 4)
    text = lambda i: f"begin {i}\n" + "\n".join(f"common line {k} of all documents" for k in range(30)) + f"\nend {i}"
    out = line_dedup.dedup_lines(spark.createDataFrame([(i, text(i)) for i in range(60)], "doc_id long, text string")).collect()
    assert sorted(r.n_lines_removed > 15 for r in out) == [False] + [True] * 59 and len(out) == 60


def plain_lines(text):
    """Lines with their separators, and the places where chunks begin."""
    lines = []
    for x in text.split("\n"):
        parts = x.replace(". ", ".\n").split("\n")
        lines += [(p, " ") for p in parts[:-1]] + [(parts[-1], "\n")]
    h = [int(hashlib.md5(p.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) for p, _ in lines]
    r = [(x + 31 * (h[i - 1] if i else 0)) % 2**32 for i, x in enumerate(h)]
    return [p + s for p, s in lines], [i for i in range(len(r)) if i == 0 or (i > 1 and r[i - 1] < r[i - 2] and r[i - 1] <= r[i])]


def plain_dedup(docs, copies_from=None):
    """(doc_id, text) to texts without repeated chunks."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        lines, begins = plain_lines(text)
        kept, lost = [], 0
        for a, b in zip(begins, [*begins[1:], len(lines)], strict=True):
            chunk = "\n".join(x[:-1] for x in lines[a:b])
            if b - a > 1 and len(chunk) >= line_dedup.LEAST_CHARS:
                if chunk in seen:
                    lost += len(chunk)
                    continue
                seen.add(chunk)
            kept += lines[a:b]
        out[i] = text if copies_from is not None and lost >= copies_from * len(text) else "".join(kept)[:-1]
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from([f"line {i} is a line of twenty and more characters" for i in range(12)] + ["", "a. b", "x. ", ". ", "y."]), max_size=25).map("\n".join), min_size=1, max_size=8))
def test_lines_equal_plain_version(spark, texts):
    docs = list(enumerate(texts))
    for share in (None, 0.5):
        out = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), share).collect()
        assert {r.doc_id: r.text for r in out} == plain_dedup(docs, share)


def test_lines_on_odd_rows(odd, odd_rows, empty):
    longer = (" copy", "\nanother line of this document: copy")
    out = line_dedup.dedup_lines(odd.withColumn("text", F.replace("text", F.lit(longer[0]), F.lit(longer[1])))).collect()
    assert len(out) == len(odd_rows) and line_dedup.dedup_lines(empty).count() == 0
    texts = defaultdict(list)
    for r in out:
        texts[r.doc_id].append(r.text)
    long = odd_rows[0][1].replace(*longer)
    assert texts[None].count(long) == 1  # null ids order first, so theirs is the first occurrence
    assert all(len(x) < 50 for x in texts[1] + texts[2]) and texts[2][0] == texts[2][1] and texts[4] == [None] and texts[5] == [""]
    assert texts[7] == [odd_rows[7][1]] and texts[10] == [odd_rows[12][1]]
    assert set(out[0].asDict()) >= set(odd.columns)


def plain_mix(rows):
    sizes = defaultdict(int)
    for source, size in rows:
        sizes[source] += size
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        for s in over or open_:
            target[s] = 2.0 * sizes[s] if s in over else level * weight[s]
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    return target


def test_mix_targets_and_sums(spark):
    rows = [(i, " ".join(["w"] * (i * 7 % 50)), (None, "b", "a", "é", "z")[i % 5] if i % 3 else "b") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out, again = mixing.mix(docs).collect(), mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    target = plain_mix([(s, len(t.split())) for _, t, s in rows])
    taken = Counter()
    for r in out:
        assert r.target == pytest.approx(target[r.source]) and r.copies <= 2
        taken[r.source] += r.size * r.copies
    assert all(abs(taken[s] - target[s]) <= 25 for s in target)


def test_mix_on_odd_rows(odd, odd_rows, empty):
    out = mixing.mix(odd).collect()
    assert len(out) == len(odd_rows) and all(isinstance(r["size"], int) for r in out)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(odd).columns == odd.columns
    null = empty.unionByName(odd.select(*empty.columns).where("text is null"))
    assert [r.copies * r["size"] for r in mixing.mix(null).collect()] == [0, 0]


def test_columns_named_like_working_ones_stay(odd, odd_rows, empty):
    taken = ["__key", "__chunks", "__gone", "__id", "__other", "__spans", "__size", "__hash", "__source", "__rounds", "__last", "__measures", "__w", "__l", "__bits", "__noise", "__copy", "__own3", "__salt", "__ways", "h", "m", "at", "first"]
    clash = odd.select("doc_id", "text", "lang", "source", "n_chars").selectExpr("*", *[f"'mine' as `{c}`" for c in taken])
    labels = odd.selectExpr("doc_id", "1 as quality", "0 as toxic")
    for out in (line_dedup.dedup_lines(clash), mixing.mix(clash), mixing.mixed_documents(clash), quality_rules.ledger(clash), quality_rules.filter_documents(clash), importance.select(clash, labels), minhash.keep_one(clash)):
        rows = out.collect()
        assert set(taken) <= set(out.columns) and rows and all(r[c] == "mine" for r in rows for c in taken)
