import numpy as np
import pytest
from pyspark.sql import functions as F

from reelquarry.functions import binary, checksums, loudness, sound
from reelquarry.functions.codecs import texture
from reelquarry.operators import images, layout, metadata, ordered
from reelquarry.sources import chunks


def test_checksums(spark):
    assert checksums.header_crc(b"123456789") == 0xAEE7 and checksums.payload_crc(b"123456789") == 0xBB3D
    df = spark.createDataFrame([(bytearray(b"123456789"),), (None,)], "c binary")
    assert [r[0] for r in df.select(checksums.crc16_payload("c")).collect()] == [0xBB3D, None]


def test_sound_functions(spark):
    row = spark.range(1).select(
        sound.bark(F.lit(1000.0)).alias("bark"), sound.critical_bandwidth(F.lit(1000.0)).alias("cb"), sound.hearing_threshold(F.lit(3300.0)).alias("ath"),
        sound.nearest_of(F.lit(100), sound.BITRATES_FULL).alias("near"), sound.gcd(F.lit(44100), F.lit(48000)).alias("gcd"), sound.gcd(F.lit(7), F.lit(0)).alias("zero"),
        sound.u8_to_s16(F.lit(0)).alias("low"), sound.s16_to_u8(F.lit(32767)).alias("high"), sound.s24_to_s16(F.lit(-1)).alias("s24"),
    ).first()
    assert row.bark == pytest.approx(8.51, abs=0.05) and row.cb == pytest.approx(162.2, abs=0.3) and -6 < row.ath < -4
    assert (row.near, row.gcd, row.zero, row.low, row.high, row.s24) == (96, 300, 7, -32768, 255, -1)


def test_image_functions(spark):
    row = spark.range(1).select(
        images.pack_bgra(F.lit(1), F.lit(2), F.lit(3), F.lit(255)).alias("bgra"), images.pack_12_12_8(F.lit(1.0), F.lit(0.0), F.lit(1.0)).alias("packed"),
        images.pack_qwvu(F.lit(-1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("qwvu"), images.rgbe_to_float(F.lit(128), F.lit(129)).alias("rgbe"),
        images.mip_count(F.lit(256), F.lit(4)).alias("mips"), images.power_of_two(F.lit(0)).alias("zero"), images.grey(F.lit(100.0), F.lit(100.0), F.lit(100.0)).alias("grey"),
    ).first()
    assert (row.bgra, row.packed, row.qwvu) == (0xFF010203, 0xFFF000FF, 0x8100007F)
    assert row.rgbe == 1.0 and row.mips == 9 and not row.zero and row.grey == pytest.approx(100.0)


def test_natural_key_orders_numbers_of_any_length(spark):
    names = ["a" + "1" * 22, "a" + "1" * 20 + "99", "a" + "1" * 20 + "98", "a2", "a10", "a010", "a", "a0", "b1", "a9z", "a9 z"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").withColumn("k", layout.natural_key(F.col("n")))
    keys = {r.n: r.k for r in rows.collect()}
    assert len(set(keys.values())) == len(names)
    number = lambda n: (int("".join(c for c in n[1:] if c.isdigit()) or -1), n)
    plain = [n for n in names if n[0] == "a" and n[1:].isdigit()]
    assert sorted(plain, key=keys.get) == sorted(plain, key=number)


def test_manifest(spark):
    lines = ["-pack1", '"in/a b.txt"="out/A"', "", "  -pack0\t", "x=y=z", "-packthresh1024", "alone", "-pack1", "=p=q="]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)] + [(2, 0, "m=n"), (2, 1, None)], "f int, n int, line string")
    out = [tuple(r) for r in layout.manifest(rows, ["f"], "n").orderBy("f", "n").collect()]
    assert out == [(1, 1, "in/a b.txt", "out/A", True), (1, 4, "x", "y", False), (1, 6, "alone", "alone", False), (1, 8, "p", "q", True), (2, 0, "m", "n", False)]


def test_half_precision(spark):
    values = [0.0, -0.0, 1.0, -2.5, 65504.0, 65519.9, 65520.0, 1e9, -1e9, 6e-8, 3e-8, 2.0**-24, 2.0**-14, 2.0**-14 - 2.0**-25, 0.1, 1 / 3, 2049.0, 2051.0, float("inf"), float("nan"), 1023.75, 0.99999]
    out = spark.createDataFrame([(v,) for v in values], "x double").select("x", binary.double_to_half(F.col("x")).alias("h")).collect()
    with np.errstate(over="ignore"):
        want = [int(np.float16(v).view(np.uint16)) for v in values]
    assert [r.h for r in out] == want
    back = spark.createDataFrame([(w,) for w in want[:-3]], "w int").select(binary.half_to_double(F.col("w")).alias("x")).collect()
    assert [r.x for r in back] == [float(np.uint16(w).view(np.float16)) for w in want[:-3]]


def test_tags(spark):
    data = F.lit(bytearray(b"q" * 300))
    row = spark.range(1).select(
        binary.blob_tag(20, data).alias("blob"), binary.blob_tag(20, F.lit(bytearray())).alias("none"), binary.fixed_tag(130, F.lit(-2), F.lit(0), 3).alias("fixed"), binary.fixed_tag(130, F.lit(7), F.lit(7), 3).alias("default"),
        F.concat(binary.align_tag(F.lit(5), F.lit(300), 16), binary.blob_tag(20, data)).alias("aligned"),
    ).first()
    assert bytes(row.blob[:7]) == b"\x14\xff\0\0\x01\x2cq" and not row.none and bytes(row.fixed) == b"\x82\x03\xff\xff\xfe" and not row.default
    assert (5 + bytes(row.aligned).index(b"q")) % 16 == 0 and bytes(row.aligned)[0] == 0xFC
    assert chunks.tags(bytes(row.aligned) + bytes(row.fixed) + b"\xff") == {20: b"q" * 300, 130: -2}


def plain_filter(x, b, a):
    y = []
    for i in range(len(x)):
        y.append(sum(b[j] * x[i - j] for j in range(len(b)) if i >= j) - sum(a[j] * y[i - 1 - j] for j in range(len(a)) if i > j))
    return y


def test_loudness_filter(spark):
    rng = np.random.RandomState(2)
    streams = {1: rng.randn(700), 2: rng.randn(3), 9: np.sin(np.arange(500) / 5)}
    rows = spark.createDataFrame([(k, i, float(v)) for k, x in streams.items() for i, v in enumerate(x)], "k long, n long, v double").repartition(5)
    out = ordered.loudness_filtered(rows, "k", "v", 44100, piece=64).orderBy("k", "n").collect()
    for k, x in streams.items():
        want = plain_filter(plain_filter(x, *loudness.equal_loudness(44100)), *loudness.high_pass(44100))
        assert [r.v for r in out if r.k == k] == pytest.approx(want, abs=1e-9)
    with pytest.raises(ValueError, match="no loudness filter"):
        loudness.equal_loudness(44000)
    assert abs(loudness.filtered(np.ones(20000), 48000)[-1]) < 1e-3  # a constant is inaudible


def test_export_rules_in_order(spark):
    good = {"format_id": 39, "encoding": 29, "channels": 1, "rate": 44100, "n_frames": 10, "bitrate": 50, "location": 2048, "loop_start": -1, "loop_end": -1, "sideband": 0}
    cases = [
        ({}, None), ({"format_id": 3}, "format"), ({"rate": 0, "channels": 0}, "rate"), ({"channels": 0, "n_frames": -1}, "channels"), ({"n_frames": -1, "bitrate": -1}, "length"), ({"n_frames": 0}, None), ({"bitrate": -1, "channels": 65}, "bitrate"),
        ({"channels": 65, "encoding": 0}, "max channels"), ({"encoding": 0, "location": 8}, "encoding"), ({"location": 8, "loop_start": 1}, "location"), ({"format_id": 1, "encoding": 0, "location": 8}, None), ({"rate": 200000}, None),
        ({"loop_start": 1}, "only loop start"), ({"loop_end": 1}, "only loop end"), ({"loop_start": 1, "loop_end": 10}, "loop end past samples"), ({"loop_start": 5, "loop_end": 4}, "loop start after end"), ({"loop_start": 0, "loop_end": 9}, None),
        ({"loop_start": 0, "loop_end": 9, "sideband": 1}, "time stretch with loop"), ({"sideband": 1, "channels": 2}, "time stretch of several channels"), ({"sideband": 1}, None),
    ]
    rows = spark.createDataFrame([(i, *(good | change).values()) for i, (change, _) in enumerate(cases)], "i int, " + ", ".join(f"{k} int" for k in good))
    out = {r.i: r.error for r in metadata.validate_export(rows, metadata.formats(spark)).collect()}
    assert [out[i] for i in range(len(cases))] == [want for _, want in cases]
    marks = spark.createDataFrame([(1, -1), (1, 0), (1, 10), (1, 11)], "k int, position int")
    sounds = spark.createDataFrame([(1, 10)], "k int, n_frames int")
    assert sorted(r.position for r in metadata.bad_markers(marks, sounds, "k").collect()) == [-1, 11]
    assert metadata.clip_markers(marks, -20, 10).count() == 0


def test_match_distances(spark):
    df = spark.createDataFrame([(1, list("abcabcabd")), (2, list("ab")), (3, ["x"] * 6)], "k int, v array<string>")
    out = sorted((r.k, r.n, r.back) for r in ordered.matches_before(df, "k", "v").collect())
    assert out == [(1, 3, 3), (1, 4, 3), (1, 5, 3), (3, 1, 1), (3, 2, 1), (3, 3, 1)]
    assert ordered.matches_before(df, "k", "v", window=2).where("k = 1").count() == 0


def test_matches_shuffle_no_places(spark, monkeypatch):
    """Rows alone with their key are read where they are; those that share a key count together, as windows over all places have it."""
    texts = [(1, "abcabcabd"), (2, "ab"), (3, None), (4, "\U0001f600é\U0001f600é\U0001f600é" * 3), (5, "x" * 40 + "y" * 9 + "x" * 5), (6, "")]
    again = [(7, "abcabc"), (7, "zabc"), (None, "xyzxyz"), (None, "xyz")]
    make = lambda rows: spark.createDataFrame(rows, "k int, v string")
    plan = ordered.matches_before(make(texts), "k", "v")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan

    def want(rows, window):
        out = []
        for k in {k for k, _ in rows}:
            at = {}
            for n, gram in sorted((n, v[n : n + 3]) for key, v in rows if key == k and v for n in range(len(v) - 2)):
                if gram in at and n - at[gram] <= window:
                    out.append((k, n, n - at[gram]))
                at[gram] = n
        return sorted(out, key=repr)

    for most in (200_000, 1):  # keys of several rows are broadcast or joined
        monkeypatch.setattr(ordered, "SEVERAL", most)
        for window in (131071, 8):
            found = ordered.matches_before(make(texts + again), "k", "v", window=window).collect()
            assert sorted(((r.k, r.n, r.back) for r in found), key=repr) == want(texts + again, window)
    n, back = ordered.earlier_places(np.array([5, 9, 9, 5, 9, 9, 5, 9]), 1 << 40, 3, 99)  # numbers that don't fit side by side
    assert sorted(zip(n.tolist(), back.tolist(), strict=True)) == [(3, 3), (4, 3), (5, 3)]


def test_textures_in_columns(spark):
    pixels = spark.createDataFrame([(1, x, y, x * 30, y * 30, 0, 255) for x in range(8) for y in range(4)] + [(2, x, 0, 1, 1, 1, 1) for x in range(3)], "image_id long, x int, y int, r int, g int, b int, a int")
    kinds = spark.createDataFrame([(1, "DXT1"), (2, "DXT5")], "image_id long, format string")
    one, two = images.compressed(pixels, kinds).orderBy("image_id").collect()
    assert (one.width, one.height, one.levels, one.error) == (8, 4, 4, None) and bytes(one.dds[:4]) == b"DDS " and two.dds is None and "powers" in two.error
    first = texture.decode(bytes(one.dds[128:]), 8, 4, "DXT1")
    assert abs(int(first[3, 7, 0]) - 210) < 40 and first[..., 3].min() == 255
    c = spark.range(1).select(images.float_to_rgbe(F.lit(1.0), F.lit(0.5), F.lit(0.0)).alias("c"), images.float_to_rgbe(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("z")).first()
    assert tuple(c.c) == (128, 64, 0, 129) and tuple(c.z) == (0, 0, 0, 0)


def test_numbers_and_sums_in_parts(spark):
    rng = np.random.RandomState(4)
    rows = [(int(k), int(t), i, int(v)) for i, (k, t, v) in enumerate(zip(rng.choice([1, 1, 1, 2], 500), rng.randint(0, 60, 500), rng.randint(0, 9, 500), strict=True))]
    df = spark.createDataFrame([*rows, (3, None, 900, 1), (3, 5, 901, 1)], "k int, t int, i int, v int")
    one = {(r.k, r.i): r.n for r in ordered.numbered(df, "k", ["t", "i"]).collect()}
    assert {(r.k, r.i): r.n for r in ordered.numbered(df, "k", ["t", "i"], parts=7).collect()} == one
    numbered = ordered.numbered(df, "k", ["t", "i"])
    order = {k: sorted((n, i) for (a, i), n in one.items() if a == k) for k in (1, 2, 3)}
    value = {r[2]: r[3] for r in rows} | {900: 1, 901: 1}
    for r in ordered.running_sum(numbered, "k", "v", "cum", step=16).collect():
        mine = order[r.k]
        assert r.cum == sum(value[i] for n, i in mine if n <= r.n) and r.total == sum(value[i] for _, i in mine) and r.frames == len(mine)
