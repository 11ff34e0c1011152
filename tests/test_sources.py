import numpy as np
import pytest

from reelquarry.functions.codecs import lz
from reelquarry.operators import images
from reelquarry.sources import archive, chunks, identify, mpeg, player, register, wave


@pytest.fixture(scope="module")
def sources(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    register(spark)
    return spark


@pytest.mark.parametrize("sizes", [[], [0], [5, 64, 13, 0], list(range(100))])
def test_archive_layout(sources, tmp_path, sizes):
    payload = [bytes([i % 251]) * n for i, n in enumerate(sizes)]
    (tmp_path / "a.big").write_bytes(archive.build([(f"dir/{i}.bin", p) for i, p in enumerate(payload)]))
    got = sources.read.format("assetarchive").option("content", "true").load(str(tmp_path / "a.big")).orderBy("idx").collect()
    assert [bytes(r.content) for r in got] == payload
    assert all(r.offset % 64 == 0 and r.error is None and r.version == 280 for r in got)
    assert all(a.offset + a.size <= b.offset for a, b in zip(got, got[1:], strict=False))


def test_archive_packed_entry_and_lookup(sources, tmp_path):
    text = b"abcabcabc" * 100
    (tmp_path / "a.big").write_bytes(archive.build([("A.txt", lz.encode(text)), ("b", b"tiny")]))
    row = sources.read.format("assetarchive").option("content", "true").option("name", "a.TXT").load(str(tmp_path)).collect()
    assert len(row) == 1 and row[0].compressed and row[0].unpacked_size == 900 and bytes(row[0].content) == text


def test_archive_write(sources, tmp_path):
    rows = sources.createDataFrame([("x.big", f"N{i}", b"z" * 5000 * i) for i in range(4)], "archive string, name string, content binary").coalesce(1)
    rows.write.format("assetarchive").mode("append").option("packthreshold", "1024").save(str(tmp_path))
    got = sources.read.format("assetarchive").option("content", "true").load(str(tmp_path)).orderBy("idx").collect()
    assert [(r.name, len(r.content), r.compressed) for r in got] == [("n0", 0, False), ("n1", 5000, True), ("n2", 10000, True), ("n3", 15000, True)]


def test_broken_files_give_error_rows(sources, tmp_path):
    (tmp_path / "a.big").write_bytes(b"BIG4" + b"\xff" * 12)
    assert sources.read.format("assetarchive").load(str(tmp_path)).first().error
    with pytest.raises(Exception, match="header|cut"):
        sources.read.format("assetarchive").option("mode", "FAILFAST").load(str(tmp_path)).collect()


@pytest.mark.parametrize("channels", [1, 2, 4, 6, 8])
def test_wave(sources, tmp_path, channels):
    x = (np.arange(5000)[:, None] * (np.arange(channels) + 1) % 4000 - 2000).astype(np.int16)
    (tmp_path / "a.wav").write_bytes(wave.build(x, 22050, loop=(10, 400)))
    got = sources.read.format("assetwave").load(str(tmp_path)).orderBy("channel", "blk").collect()
    assert {(r.channels, r.sample_rate, r.n_frames, r.loop_start, r.loop_end) for r in got} == {(channels, 22050, 5000, 10, 400)}
    for c in range(channels):
        assert sum((r.samples for r in got if r.channel == c), []) == x[:, c].tolist()


def test_wave_depths_and_empty_data():
    x = np.array([[0], [256], [-32768], [32512]], np.int16)
    assert wave.parse(wave.build(x, 8000, bits=8))[1].tolist() == x.tolist()
    head = wave.build(x, 8000)
    wide = head[:34] + (24).to_bytes(2, "little") + b"data" + (6).to_bytes(4, "little") + bytes([9, 1, 2, 9, 0xFF, 0xFF])
    assert wave.parse(wide)[1].tolist() == [[513], [-1]]
    empty = head[:36] + b"data\0\0\0\0" + head[36:]
    assert wave.parse(empty)[1].tolist() == x.tolist()


def test_wave_write(sources, tmp_path):
    rows = sources.createDataFrame([("t.wav", 8000, c, b, [c * 10 + b] * 3) for c in range(2) for b in range(3)], "name string, sample_rate int, channel int, blk long, samples array<int>")
    rows.coalesce(1).write.format("assetwave").mode("append").save(str(tmp_path))
    assert wave.parse((tmp_path / "t.wav").read_bytes())[1][:, 1].tolist() == [10] * 3 + [11] * 3 + [12] * 3


@pytest.mark.parametrize(("encoding", "n"), [(0, 0), (0, 700), (29, 700), (10, 0), (10, 700)])
def test_chunk_stream(sources, tmp_path, encoding, n):
    x = (3000 * np.sin(np.arange(n)[:, None] / np.array([9, 15]))).astype(np.int16)
    (tmp_path / "s.asf").write_bytes(chunks.build(x, 32000, 256, encoding))
    got = sources.read.format("assetstream").load(str(tmp_path)).orderBy("seq").collect()
    assert len(got) == 2 * -(-n // 256)
    left = sum((r.samples for r in got if r.channel == 0), [])
    assert np.abs(np.array(left) - x[:, 0]).max(initial=0) <= (0 if encoding == 0 else 200)


def test_chunk_stream_needs_its_end():
    data = chunks.build(np.zeros((4, 1), np.int16), 8000, 4)
    with pytest.raises(ValueError, match="end"):
        list(chunks.parse(data[:-8]))


def test_tags_round_trip():
    values = {128: 0, 130: -1, 132: 48000, 133: 8388352, 160: -(2**31)}
    assert chunks.tags(chunks.tag_bytes(values)) == values
    assert chunks.tags(bytes([20, 255, 0, 0, 1, 4]) + b"q" * 260 + b"\xff") == {20: b"q" * 260}


def test_player_pair(sources, tmp_path):
    head = player.build_header(version=1, codec=4, channels=2, sample_rate=44100, play_type=1, n_frames=300)
    (tmp_path / "a.snr").write_bytes(head)
    (tmp_path / "a.sns").write_bytes(player.build_chunk(200, b"x" * 7) + player.build_chunk(100, b"y", last=True))
    (tmp_path / "b.snr").write_bytes(head)
    got = sources.read.format("assetplayer").load(str(tmp_path)).orderBy("path", "seq").collect()
    assert [(r.frames, r.n_bytes, r.is_last, r.part) for r in got[:2]] == [(200, 7, False, "stream"), (100, 1, True, "stream")]
    assert got[0].channels == 2 and got[0].sample_rate == 44100 and "missing" in got[2].error


def test_player_header_fields():
    data = player.build_header(version=2, codec=2, channels=6, sample_rate=48000, play_type=2, looped=1, n_frames=9, loop_start=3, resident=4, loop_offset=5)
    fields, size = player.header(data)
    assert size == 20 and (fields["loop_start"], fields["resident"], fields["loop_offset"], fields["channels"]) == (3, 4, 5, 6)


def test_mpeg_frames(sources, tmp_path):
    word = 0x7FF << 21 | 3 << 19 | 1 << 17 | 1 << 16 | 9 << 12
    size = mpeg.frame(word)["size"]
    assert size == 144000 * 128 // 44100
    (tmp_path / "a.mp3").write_bytes(b"ID3 junk\xff\xfb" + (word.to_bytes(4, "big") + b"\0" * (size - 4)) * 9)
    got = sources.read.format("assetmpeg").load(str(tmp_path)).orderBy("seq").collect()
    assert len(got) == 9 and got[0].offset == 10 and got[8].start == 8 * 1152 and {r.kbit for r in got} == {128}


@pytest.fixture
def blocks(spark):
    rows = [("t", 8000, c, b, [(c * 100 + b * 10 + i) * 40 for i in range(60)]) for c in range(2) for b in range(5)]
    return spark.createDataFrame(rows, "name string, sample_rate int, channel int, blk long, samples array<int>").coalesce(1)


@pytest.mark.parametrize("encoding", [0, 10, 29])
def test_chunk_stream_write(sources, blocks, tmp_path, encoding):
    blocks.write.format("assetstream").mode("append").option("encoding", str(encoding)).option("frames", "128").save(str(tmp_path))
    got = sources.read.format("assetstream").load(str(tmp_path)).orderBy("channel", "seq").collect()
    want = sum((r.samples for r in blocks.where("channel = 1").orderBy("blk").collect()), [])
    back = sum((r.samples for r in got if r.channel == 1), [])
    assert len(back) == 300 and np.abs(np.array(back) - want).max() <= (0 if encoding == 0 else 260)


@pytest.mark.parametrize(("play_type", "resident", "parts"), [(0, 0, {"header"}), (1, 0, {"stream"}), (2, 100, {"header", "stream"})])
def test_player_write(sources, blocks, tmp_path, play_type, resident, parts):
    blocks.write.format("assetplayer").mode("append").option("play_type", str(play_type)).option("resident", str(resident)).option("frames", "64").save(str(tmp_path))
    got = sources.read.format("assetplayer").load(str(tmp_path)).orderBy("seq").collect()
    assert {r.part for r in got} == parts and sum(r.frames for r in got) == 300 and got[-1].is_last
    data = b"".join(bytes(r.payload) for r in got)
    assert np.frombuffer(data, ">i2").reshape(-1, 2)[:3, 1].tolist() == [4000, 4040, 4080]


def test_archive_entries_over_partitions_and_filters(sources, tmp_path):
    (tmp_path / "a.big").write_bytes(archive.build([(f"n{i}", bytes([i]) * 100) for i in range(50)]))
    df = sources.read.format("assetarchive").option("content", "true").option("partition", "1000").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 5
    assert [(r.idx, bytes(r.content)[:1]) for r in df.orderBy("idx").collect()] == [(i, bytes([i])) for i in range(50)]
    assert [r.name for r in df.where("idx >= 10 and idx < 13 and name > 'n10'").orderBy("idx").collect()] == ["n11", "n12"]
    assert "PushedFilters: [IsNotNull" in df.where("idx = 7")._jdf.queryExecution().toString() or df.where("idx = 7").count() == 1
    # An entry that a filter leaves out isn't read: its payload may be cut off.
    whole = archive.build([("first", b"x" * 100), ("second", b"y" * 100)])
    (tmp_path / "a.big").write_bytes(whole[:-50])
    assert [r.error for r in sources.read.format("assetarchive").option("content", "true").load(str(tmp_path)).where("idx = 0").collect()] == [None]


def test_writers_refuse_a_file_from_two_partitions(sources, tmp_path):
    rows = sources.createDataFrame([("x.big", f"n{i}", b"z") for i in range(8)], "archive string, name string, content binary").repartition(4)
    with pytest.raises(Exception, match="more than one partition"):
        rows.write.format("assetarchive").mode("append").save(str(tmp_path))
    assert not list(tmp_path.iterdir())


def test_folder_sink(sources, tmp_path):
    rows = sources.createDataFrame([("a/b/c.bin", b"123"), ("d.dds", b"DDS "), ("empty", None)], "name string, content binary").repartition(3)
    rows.write.format("assetfolder").mode("append").save(str(tmp_path))
    assert (tmp_path / "a/b/c.bin").read_bytes() == b"123" and (tmp_path / "empty").read_bytes() == b"" and len(list(tmp_path.iterdir())) == 3
    back = sources.read.format("assetfolder").option("suffix", ".DDS").load(str(tmp_path)).collect()
    assert [(r.name, bytes(r.content), r.size) for r in back] == [("d.dds", b"DDS ", 4)]
    bad = sources.createDataFrame([("../up", b"1"), ("/root", b"1"), ("c:x", b"1"), ("a/../../b", b"1"), ("fine", b"1")], "name string, content binary")
    with pytest.raises(Exception, match="not inside"):
        bad.write.format("assetfolder").mode("append").save(str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or not list((tmp_path / "out").iterdir())
    bad.write.format("assetfolder").mode("append").option("unsafe", "skip").save(str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["fine"]


def test_archive_to_folder(sources, tmp_path):
    (tmp_path / "a.big").write_bytes(archive.build([("dir/A.txt", lz.encode(b"abc" * 50)), ("b", b"tiny")]))
    entries = sources.read.format("assetarchive").option("content", "true").load(str(tmp_path / "a.big")).select("name", "content")
    entries.write.format("assetfolder").mode("append").save(str(tmp_path / "out"))
    assert (tmp_path / "out/dir/A.txt").read_bytes() == b"abc" * 50 and (tmp_path / "out/b").read_bytes() == b"tiny"


def test_strict_sync():
    frame = (0xFFFB9000).to_bytes(4, "big") + b"\0" * 413
    assert mpeg.strict_sync(b"ID3" + frame * 7) == 3 and mpeg.strict_sync(frame * 6) == -1 and mpeg.strict_sync(b"\xff" * 50) == -1


def test_chunk_streams_arrive(sources, tmp_path):
    """Files that come into a folder are read once each, up to their end markers."""
    (tmp_path / "in").mkdir()
    x = np.arange(300, dtype=np.int16)[:, None]
    (tmp_path / "in/a.asf").write_bytes(chunks.build(x, 8000, 100, 0))

    def run():
        rows = sources.readStream.format("assetstream").load(str(tmp_path / "in"))
        q = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sources.read.parquet(str(tmp_path / "out"))

    assert run().count() == 3
    (tmp_path / "in/b.asf").write_bytes(chunks.build(x, 8000, 150, 10))
    out = run().orderBy("path", "seq").collect()
    assert len(out) == 5 and sum((r.samples for r in out[:3]), []) == x[:, 0].tolist() and out[3].encoding == 10


def test_images_load(spark, tmp_path):
    import struct
    import zlib

    def png(pixels):
        h, w, n = pixels.shape
        part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        raw = b"".join(b"\0" + row.tobytes() for row in pixels)
        return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6 if n == 4 else 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")

    image = np.arange(2 * 3 * 4, dtype=np.uint8).reshape(2, 3, 4) * 9
    (tmp_path / "a.png").write_bytes(png(image))
    (tmp_path / "b.png").write_bytes(png(image[..., :3].copy()))
    (tmp_path / "broken.png").write_bytes(b"no image")
    out = images.load(spark, str(tmp_path)).collect()
    assert len(out) == 12 and {(r.capable, r.a) for r in out if r.image_id.endswith("b.png")} == {(False, 255)}
    assert {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in out if r.image_id.endswith("a.png")} == {(x, y): tuple(image[y, x].tolist()) for x in range(3) for y in range(2)}


def test_identify_files(sources, tmp_path):
    x = np.zeros((10, 1), np.int16)
    head = lambda play: player.build_header(version=0, codec=2, channels=1, sample_rate=8000, play_type=play, n_frames=10, **({"resident": 0} if play == 2 else {}))
    frame = (0xFFFB9000).to_bytes(4, "big") + b"\0" * 413
    made = {"a.wav": wave.build(x, 8000), "sub/b.mp3": b"junk" + frame * 8, "d.snr": head(0), "e.snr": head(1), "f.snr": head(1), "f.sns": b"stream", "g.bin": head(0), "h.txt": b"text", "i": b"GSTR" + b"\0" * 60}
    (tmp_path / "sub").mkdir()
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    out = {r.path.rpartition("/")[2]: (r.source, r.score, r.error) for r in identify(sources, str(tmp_path)).collect()}
    none = (None, 0, "no format matches")
    assert out == {
        "a.wav": ("assetwave", 100, None), "b.mp3": ("assetmpeg", 75, None), "d.snr": ("assetplayer", 90, None), "e.snr": none, "f.snr": ("assetplayer", 90, None), "g.bin": ("assetplayer", 50, None), "h.txt": none, "i": ("assetstream", 100, None),
    }
