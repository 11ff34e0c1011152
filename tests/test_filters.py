import pytest
from pyspark.sql import functions as F

from reelquarry.functions import binary
from reelquarry.operators import layout
from reelquarry.plans.filters import Sounds, parse_arguments
from reelquarry.streaming.blocks import _advance


@pytest.fixture
def sounds(spark):
    frames = spark.range(200).select(F.lit("a").alias("asset_id"), F.lit(0).alias("channel"), F.col("id").alias("n"), F.sin(F.col("id") / 9).alias("sample"))
    meta = spark.createDataFrame([("a", 44100, 200, 20, 90)], "asset_id string, sample_rate int, n_frames long, loop_start int, loop_end int")
    return Sounds(meta, frames)


def test_chain(sounds, tmp_path):
    (tmp_path / "blob").write_bytes(b"hi")
    heard = []
    job = parse_arguments(f"-in x.wav -crop -10 100 -quality 70 -playloc stream -userdata {tmp_path}/blob -resample 22050 -gain 0.5 -gain 2.0 -out y.wav".split())
    assert (job.source, job.target) == ("x.wav", "y.wav")
    out = job.run(sounds, lambda percent, word: heard.append((percent, word)))
    meta = out.meta.first()
    assert (meta.sample_rate, meta.n_frames, meta.quality, meta.play_location, meta.loop_start) == (22050, 50, 70, 4096, None)
    assert out.frames.count() == 50 and bytes(meta.user_data[0]) == b"hi" and heard[0] == (14, "crop") and heard[-1] == (100, "gain")


def test_crop_pads_with_silence(sounds):
    out = parse_arguments(["-crop", "-3", "250"]).run(sounds)
    rows = {r.n: r.sample for r in out.frames.collect()}
    assert len(rows) == 250 and rows[0] == rows[2] == rows[249] == 0.0 and rows[4] != 0.0
    assert out.meta.first().loop_start == 23


@pytest.mark.parametrize("bad", [["-nope"], ["-quality", "101"], ["-crop", "1"], ["-in"], ["-quality", "x"]])
def test_bad_arguments(bad):
    with pytest.raises(ValueError):
        parse_arguments(bad)


def test_endian_and_bits(spark):
    row = spark.createDataFrame([(bytearray(b"\x01\x02\x03\xff"),)], "c binary").select(
        binary.be_uint(F.col("c"), 0, 4).alias("be"), binary.le_uint(F.col("c"), 0, 3).alias("le"), binary.be_uint(F.col("c"), 3, 2).alias("beyond"),
        binary.le_bytes(F.lit(258), 2).alias("out"), binary.signed(F.lit(255), 1).alias("s"), binary.wrap_s16(F.lit(70000)).alias("w"),
        binary.half_to_double(F.lit(0xC000)).alias("h"), layout.trim_control(F.lit('  "a b" ')).alias("t"), layout.safe_name(F.lit("a/../../b")).alias("safe"),
    ).first()
    assert (row.be, row.le, row.beyond, bytes(row.out), row.s, row.w, row.h, row.t, row.safe) == (0x010203FF, 0x030201, None, b"\x02\x01", -1, 4464, -2.0, "a b", False)


def test_natural_order(spark):
    names = ["a2", "a10", "a12", "a100", "a102", "a126", "a1100", "a1205"]
    df = spark.createDataFrame([(n,) for n in reversed(names)], "s string")
    assert [r.s for r in df.orderBy(layout.natural_key(F.col("s"))).collect()] == names


def test_state_restarts():
    import pandas as pd

    class State:
        exists, get = True, (3, [1.0])

        def update(self, new):
            self.new = new

    state = State()
    rows = pd.DataFrame({"ts": [4, 1, 2, 3], "event_id": 0, "value": [4.0, 1.0, 2.0, 3.0], "restart": [False, False, False, True], "flush": False})
    out = next(_advance((7,), iter([rows[:2], rows[2:]]), state, 3))  # rows of a micro-batch are put in order first
    assert out["blk"].tolist() == [3] and out["samples"].tolist() == [[1.0, 1.0, 2.0]] and state.new == (0, [3.0, 4.0])
    rows["flush"] = rows["ts"] == 4
    out = next(_advance((7,), iter([rows]), state, 3))
    assert out["samples"].tolist()[-1] == [3.0, 4.0, 4.0] and out["n_valid"].tolist()[-1] == 2 and state.new == (1, [])


def test_resample_sounds_of_several_rates(spark, monkeypatch):
    import numpy as np

    from reelquarry.functions.codecs import frames as codec

    monkeypatch.setattr(codec, "PIECE", 700)
    rng = np.random.RandomState(0)
    streams = {("a", 0): rng.randn(2000), ("a", 1): rng.randn(2000), ("b", 0): rng.randn(900)}
    rates = {"a": 44100, "b": 8000}
    rows = spark.createDataFrame([(k, c, i, float(v)) for (k, c), x in streams.items() for i, v in enumerate(x)], "asset_id string, channel int, n long, sample double")
    meta = spark.createDataFrame([(k, r, 0) for k, r in rates.items()], "asset_id string, sample_rate int, n_frames long")
    out = parse_arguments(["-resample", "16000"]).run(Sounds(meta, rows))
    got = {}
    for r in out.frames.orderBy("n").collect():
        got.setdefault((r.asset_id, r.channel), []).append((r.n, r.sample))
    for k, x in streams.items():
        want = codec.resampled(x, rates[k[0]], 16000)
        assert [n for n, _ in got[k]] == list(range(len(want))) and np.allclose([v for _, v in got[k]], want)
    assert {r.asset_id: r.n_frames for r in out.meta.collect()} == {"a": len(got["a", 0]), "b": len(got["b", 0])}
