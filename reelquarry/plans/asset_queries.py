"""Queries of the asset operators over the driver's tables, which stand in for archives, streams, images and sound metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import binary, sound
from ..operators import images, layout, metadata, ordered


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where a small input comes in fewer partitions than there are; a large input stays where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _entries(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text", "n_chars")
    name = F.lower(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", name.alias("name"), F.octet_length("text").cast("long").alias("size"), F.col("n_chars").alias("packed_size"))


def _stream(spark, sf_dir):
    """Each user's events as a stream of samples numbered by n."""
    return ordered.numbered(table(spark, sf_dir, "events", "user_id", "ts", "event_id", "event_type", "value"), "user_id", ["ts", "event_id"])


def q01_archive_layout(spark, sf_dir):
    return layout.layout(_entries(spark, sf_dir).select("doc_id", "name", "size"), "doc_id")


def q02_compress_policy(spark, sf_dir):
    kind = F.get(F.array(*[F.lit(x) for x in (".txt", ".snd", ".asset", ".VP6")]), (F.col("doc_id") % 4).cast("int"))
    named = _entries(spark, sf_dir).withColumn("name", F.concat(F.regexp_replace("name", r"\.txt$", ""), kind))
    return layout.with_policy(named, 30).select("name", "size", "packed_size", "compressed", "stored")


def q03_natural_order(spark, sf_dir):
    parts = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand")
    label = F.concat("p_brand", F.lit(" a"), F.col("p_partkey").cast("string"), F.lit("b"), (F.col("p_partkey") % 7).cast("string"))
    keyed = parts.select("p_partkey", "p_brand", label.alias("label"), layout.natural_key(label).alias("natural_key"))
    return keyed.withColumn("place", F.row_number().over(Window.partitionBy("p_brand").orderBy("natural_key", "p_partkey")).cast("long"))


def _bytes(*parts):
    """Binary of hexadecimal text or columns of it."""
    return F.unhex(F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts]))


def _heads(spark, sf_dir):
    """Heads of files of nine kinds by page: wave, wave with another chunk first, wave of an unknown tag, stream, short stream, MPEG frames, and players of each play type."""
    page = F.col("page_id")
    zeros = lambda n: F.repeat(F.lit("00"), n if not isinstance(n, int) else F.lit(n))
    riff, fmt = "524946460000000057415645", "666D742010000000"
    frames = 5 + F.floor(page / 9) % 5
    mpeg = F.concat(F.lit("494433"), F.repeat(F.concat(F.lit("FFFB9000"), zeros(413)), frames.cast("int")))
    word = lambda v, n: F.lpad(F.hex(v.cast("long")), 2 * n, "0")
    # Version 0, codec 2, channels - 1, rate; then play type, no loop, frames.
    player = lambda play, frames: F.concat(word(F.lit(2 << 24) + (page % 4) * (1 << 18) + 44100, 4), word(F.lit(play << 30) + frames, 4))
    resident = F.floor(page / 9) % 2 * 500
    kinds = (
        F.concat(F.lit(riff + fmt + "0100"), zeros(14)), F.concat(F.lit(riff + "4C49535406000000"), zeros(6), F.lit(fmt + "FEFF"), zeros(14)), F.concat(F.lit(riff + fmt + "0300"), zeros(14)),
        F.concat(F.lit("47535452"), zeros(46)), F.concat(F.lit("47535452"), zeros(36)), mpeg, F.concat(player(0, F.lit(1000)), zeros(8)), F.concat(player(1, F.lit(1000)), zeros(8)),
        F.concat(player(2, F.lit(400)), word(resident, 4), zeros(8)),
    )
    head = F.lit(None).cast("string")
    for i, k in enumerate(kinds):
        head = F.when(page % 9 == i, k).otherwise(head)
    tail = F.when(page % 2 == 0, ".snr").otherwise(".bin")
    return table(spark, sf_dir, "pages", "page_id").select("page_id", F.unhex(head).alias("head"), F.concat(F.lit("f"), page.cast("string"), tail).alias("name"))


def q04_sniff_best(spark, sf_dir):
    out = metadata.sniff(_heads(spark, sf_dir), F.col("head"), F.col("name"), F.col("page_id") % 4 < 2)
    return out.select("page_id", "name", F.col("score").cast("long").alias("score"), F.col("format_id").cast("long").alias("format_id"))


def q05_predictor_select(spark, sf_dir):
    out = ordered.best_predictor(ordered.predictor_errors(_stream(spark, sf_dir), "user_id", "value"))
    return out.select("user_id", "blk", "n_valid", "predictor", ordered.fixed(F.col("error")).alias("error"))


def q06_shift_select(spark, sf_dir):
    rows = table(spark, sf_dir, "events", "event_id", "value")
    return rows.select("event_id", ordered.shift_for(F.col("value") * 60).alias("shift"))


def q07_block_pad(spark, sf_dir):
    out = ordered.pad_blocks(_stream(spark, sf_dir), "user_id", "value", 28)
    return out.select("user_id", "blk", "n_valid", F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.element_at("samples", 28).alias("last"))


def q08_s16_clamp_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    sample = sound.to_s16((F.col("l_extendedprice") - 30000) * (1 + F.col("l_discount")))
    rows = rows.select("l_orderkey", "l_linenumber", sample.alias("sample"))
    return rows.withColumn("coded", sound.pcm16_be_round_trip(F.col("sample")))


def q09_rate_snap(spark, sf_dir):
    rate = F.floor(F.col("o_totalprice") / 5).cast("long")
    return table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").select("o_orderkey", rate.alias("rate"), sound.next_of(rate, sound.RATES).alias("snapped"))


def q10_bitrate_snap(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_linestatus")
    asked = (F.col("l_quantity") * 7).cast("long")
    snapped = F.when(F.col("l_linestatus") == "F", sound.next_of(asked, sound.BITRATES_FULL)).otherwise(sound.next_of(asked, sound.BITRATES_LOW))
    return rows.select("l_orderkey", "l_linenumber", asked.alias("asked"), snapped.alias("kbit"))


def q11_crop_pad(spark, sf_dir):
    return ordered.crop(_stream(spark, sf_dir), "user_id", "value", -8, 64)


def _frames(spark, sf_dir, channels):
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return rows.select("vec_id", (F.col("i") % channels).alias("channel"), F.floor(F.col("i") / channels).cast("int").alias("n"), F.round(F.col("v").cast("double"), 6).alias("sample"))


#: Order of the channels of 4- and 6-channel sound in files, by channel in memory.
REMAP = {4: (0, 2, 1, 3), 6: (0, 2, 1, 4, 5, 3)}


def q12_channel_remap(spark, sf_dir):
    to = F.get(F.array(*[F.lit(x) for x in REMAP[4]]), F.col("channel"))
    return _frames(spark, sf_dir, 4).withColumn("channel", to)


def q13_interleave(spark, sf_dir):
    planar = _frames(spark, sf_dir, 2)
    packed = planar.groupBy("vec_id", "channel").agg(F.array_sort(F.collect_list(F.struct("n", "sample"))).alias("s"))
    return packed.select("vec_id", "channel", F.size("s").cast("long").alias("n_frames"), F.element_at("s", 1)["sample"].alias("first"), F.element_at("s", -1)["sample"].alias("last"))


def _pixels(spark, sf_dir, width=8):
    return images.from_embeddings(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), width)


def q14_alpha_guess(spark, sf_dir):
    stats = images.alpha_stats(_pixels(spark, sf_dir))
    wanted = F.when(F.col("image_id") % 11 == 0, "DXT3").otherwise("DXT1")
    out = images.guess_format(stats, wanted, F.col("image_id") % 7 != 0)
    return out.select("image_id", "constant", "one_bit", "least", "format", images.power_of_two(F.col("max_x") + 1).alias("valid"))


def q15_volume_slice(spark, sf_dir):
    return images.slices(_pixels(spark, sf_dir, 32).select("image_id", "x", "y", "r"), 2)


def q16_mip_chain(spark, sf_dir):
    level = _pixels(spark, sf_dir)
    out = None
    for k in range(1, 4):
        level = images.next_mip(level)
        this = level.select("image_id", F.lit(k).alias("level"), "x", "y", "r", "g", "b", "a")
        out = this if out is None else out.unionByName(this)
    return out


def _loud(spark, sf_dir):
    """Streams through the equal-loudness filters of 44.1 kHz."""
    return ordered.loudness_filtered(_stream(spark, sf_dir), "user_id", "value", 44100)


def q17_loudness_hist(spark, sf_dir):
    return ordered.loudness_gain(ordered.loudness_buckets(_loud(spark, sf_dir), ["user_id"], "value", 10), ["user_id"])


def q18_album_rollup(spark, sf_dir):
    rows = _loud(spark, sf_dir).withColumn("album", F.col("user_id") % 10)
    buckets = ordered.loudness_buckets(rows, ["album", "user_id"], "value", 10)
    return buckets.rollup("album", "user_id").agg(F.sum("windows").alias("windows"), F.max("bucket").alias("top"), F.grouping_id().cast("long").alias("level"))


def q19_crossfade(spark, sf_dir):
    rows = _stream(spark, sf_dir).withColumn("other", F.col("value") * -0.5)
    return ordered.cross_fade(rows, "user_id", "value", "other", 16).withColumn("mixed", ordered.fixed(F.col("mixed")))


def q20_hermite(spark, sf_dir):
    return ordered.hermite_half(_stream(spark, sf_dir), "user_id", "value").select("user_id", "n", ordered.fixed(F.col("between")).alias("between"))


def q21_export_validate(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    pick = lambda values, c: F.get(F.array(*[F.lit(x) for x in values]), (c % len(values)).cast("int"))
    part, supplier, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    sounds = rows.select(
        "l_orderkey", "l_linenumber", pick((1, 35, 39, 39, 7), part).alias("format_id"), pick((0, 10, 11, 29, 31), supplier).alias("encoding"), (part % 9).cast("int").alias("channels"),
        F.when(part % 31 == 0, 0).otherwise(part * 37 % 110000).cast("int").alias("rate"), (F.col("l_quantity").cast("int") - 2).alias("n_frames"), F.when(supplier % 29 == 0, -1).otherwise(50).alias("bitrate"),
        pick((0, 2048, 8, 4096), part + line).alias("location"), F.when(supplier % 2 == 0, line.cast("int")).otherwise(-1).alias("loop_start"), F.when(supplier % 3 > 0, 5 + line.cast("int") % 3).otherwise(-1).alias("loop_end"),
        F.when(part % 4 == 0, 64).otherwise(0).alias("sideband"),
    )
    return metadata.validate_export(sounds, metadata.formats(spark)).select("l_orderkey", "l_linenumber", "format_id", "encoding", "error")


def q22_tag_width(spark, sf_dir):
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    value = (F.floor(F.col("o_totalprice") * (F.col("o_orderkey") % 41)) - 8400000).cast("long")
    small = F.when(F.col("o_orderkey") % 3 == 0, value % 300).otherwise(value)
    out = rows.select("o_orderkey", small.alias("value"))
    return out.select("o_orderkey", "value", binary.tag_width(F.col("value"), F.lit(0)).alias("width"), F.hex(binary.tag_bytes(130, F.col("value"), F.lit(0))).alias("tag"))


def _mpeg_words(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    word = F.lit(0xFFE00000) + (F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_linenumber") * 31) % 2097152
    return rows.select("l_orderkey", "l_linenumber", word.cast("long").alias("word"))


def q23_mpeg_header(spark, sf_dir):
    rows = _mpeg_words(spark, sf_dir)
    return rows.select("*", *[c.alias(n) for n, c in sound.mpeg_header(F.col("word")).items()])


def q24_bit_header(spark, sf_dir):
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    word = (F.col("o_orderkey") * 2654435761 + F.col("o_custkey") * 40503) % 4294967296
    rows = rows.select("o_orderkey", word.cast("long").alias("word"))
    fields, at = [], 0
    for name, width in (("version", 4), ("codec", 4), ("channels", 6), ("rate", 18)):
        value = binary.bits(F.col("word"), 32, at, width)
        fields.append((value + 1 if name == "channels" else value).alias(name))
        at += width
    return rows.select("o_orderkey", "word", *fields)


def q25_chunk_schedule(spark, sf_dir):
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice").select(
        "o_orderkey", (F.col("o_custkey") % 40000 + 8000).alias("rate"), F.floor(F.col("o_totalprice") / 10).cast("long").alias("n_frames")
    )
    return ordered.chunk_schedule(rows, F.col("rate"), 15, F.col("n_frames"), 28).select("o_orderkey", "chunk", "start", "stop")


def q26_sticky_manifest(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role")
    switch = F.when(F.col("role") == "system", F.lit("-pack1")).when((F.col("role") == "user") & (F.col("turn") % 4 == 0), F.lit("-pack0"))
    return layout.sticky(rows, ["conv_id"], "turn", switch, "mode")


def q27_pair_join(spark, sf_dir):
    # Headers of every fifth customer have a stem of their own, which no chunk has.
    stem = F.when(F.col("o_custkey") % 5 == 0, -F.col("o_orderkey") - 1).otherwise(F.col("o_orderkey"))
    headers = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus").select(stem.alias("stem"), "o_orderstatus")
    chunks = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").select(
        F.col("l_orderkey").alias("stem"), F.col("l_linenumber").cast("long").alias("seq"), F.col("l_quantity").cast("long").alias("n_bytes")
    )
    return metadata.pair(headers, chunks, "stem")


def q28_tag_overlay(spark, sf_dir):
    rows = table(spark, sf_dir, "events", "event_id", "props")
    tags = F.from_json("props", "map<string,string>")
    full = metadata.tag_overlay({"k": "-1", "rate": "44100", "channels": "1"}, F.when(F.col("event_id") % 5 > 0, tags))
    rows = rows.select("event_id", full.alias("m"))
    return rows.select("event_id", *[F.element_at("m", k).cast("long").alias(k) for k in ("k", "rate", "channels")])


def q29_lz_roundtrip(spark, sf_dir):
    from ..functions.codecs.lz import lz_pack, lz_unpack

    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    back = lz_unpack(lz_pack(F.encode("text", "UTF-8")))
    return docs.select("doc_id", F.decode(back, "UTF-8").alias("text"))


def q30_lz_ratio(spark, sf_dir):
    from ..functions.codecs.lz import lz_pack

    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    sizes = docs.select("doc_id", F.octet_length("text").cast("long").alias("size"), lz_pack(F.encode("text", "UTF-8")).alias("p"))
    packed = F.octet_length("p")
    return sizes.select(
        "doc_id", "size", binary.be_uint(F.col("p"), 2, 3).alias("announced"), F.hex(F.substring("p", 1, 2)).alias("signature"),
        (packed <= F.col("size") + F.ceil(F.col("size") / 112) + 8).alias("bounded"), ((F.col("size") < 400) | (packed < F.col("size"))).alias("smaller"),
    )


def _coded(spark, sf_dir, kind):
    from ..functions.codecs import frames

    return frames.round_trip(_stream(spark, sf_dir).withColumn("value", sound.to_s16(F.col("value") * 50)), "user_id", "value", kind)


def q31_xas_roundtrip(spark, sf_dir):
    return _coded(spark, sf_dir, "xas").select("user_id", "n", "n_bytes", (F.col("snr") > 8).alias("close"))


def q32_xa_roundtrip(spark, sf_dir):
    return _coded(spark, sf_dir, "xa").select("user_id", "n", "n_bytes", (F.col("snr") > 8).alias("close"))


def q33_resample(spark, sf_dir):
    from ..functions.codecs import frames

    out = frames.resample_streams(_stream(spark, sf_dir), "user_id", "value", 44100, 22050)
    return out.groupBy("user_id").agg(F.sum(F.size("samples")).cast("long").alias("resampled"), F.count_if(F.array_max(F.transform("samples", lambda x: F.abs(x))) > 1e6).alias("wild"))


def q34_stream_state(spark, sf_dir):
    from ..streaming.blocks import stream_blocks

    out = stream_blocks(spark, f"{sf_dir}/events.parquet", 28)
    return out.select("user_id", "blk", "n_valid", F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.element_at("samples", 1).alias("first"), F.element_at("samples", 28).alias("last"))


def q35_seek_index(spark, sf_dir):
    rows = ordered.numbered(table(spark, sf_dir, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity"), "l_suppkey", ["l_orderkey", "l_linenumber", "l_quantity"])
    return ordered.seek_table(rows.withColumn("bytes", F.col("l_quantity").cast("long")), "l_suppkey", "bytes")


def q36_histograms(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_quantity")
    kbit = sound.next_of((F.col("l_quantity") * 7).cast("long"), sound.BITRATES_FULL)
    return rows.groupBy(kbit.alias("kbit"), "l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).count().na.fill(0)


def q37_manifest(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role")
    path = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    line = (
        F.when(F.col("role") == "system", "  -pack1 ").when(F.col("turn") % 5 == 4, "-pack0").when(F.col("turn") % 7 == 6, "-packthresh1024")
        .when(F.col("turn") % 3 == 0, F.concat(F.lit('\t"in/'), path, F.lit('.txt"="out/'), path, F.lit('.TXT" '))).otherwise(F.concat(F.lit("=in/"), path, F.lit("==")))
    )
    return layout.manifest(rows.withColumn("line", line), ["conv_id"], "turn")


def q38_paths(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang")
    root = F.concat(F.lit("data\\"), F.col("source"))
    file = F.when(F.col("doc_id") % 3 > 0, F.concat(root, F.lit("\\"), F.col("lang"), F.lit("\\f"), F.col("doc_id").cast("string"), F.lit(".snr"))).otherwise(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".Snr")))
    src, dst = layout.re_rooted(file, root)
    return docs.select(
        "doc_id", src.alias("src"), dst.alias("dst"), layout.extension(file).alias("extension"), layout.change_extension(file, "sns").alias("companion"),
        layout.with_extension(F.col("source"), "snr", F.when(F.col("doc_id") % 2 == 0, F.lit("_x"))).alias("added"), layout.safe_name(dst).alias("safe"),
    )


def q39_tag_kinds(spark, sf_dir):
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    n = F.col("o_custkey") % 300
    data = F.encode(F.repeat(F.lit("x"), n.cast("int")), "UTF-8")
    parts = [binary.fixed_tag(130, n - 100, F.lit(0), 2), binary.align_tag(F.col("o_orderkey"), n, 16), binary.blob_tag(20, data), binary.marker(255)]
    out = rows.select("o_orderkey", *[p.alias(f"p{i}") for i, p in enumerate(parts)])
    return out.select("o_orderkey", F.hex("p0").alias("fixed"), F.octet_length("p1").cast("long").alias("pad"), F.hex(F.substring("p2", 1, 7)).alias("blob_head"), F.octet_length("p2").cast("long").alias("blob_size"), F.hex("p3").alias("end"))


def q40_codebooks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    raw = docs.select("doc_id", F.encode("text", "UTF-8").alias("c"))
    at = (F.col("doc_id") % 10).cast("int")
    raw = raw.select("doc_id", binary.codebook(F.col("c"), at, True).alias("b"), binary.codebook(F.col("c"), at, False).alias("l"), binary.sideband(F.col("c"), at, F.lit(9)).alias("s"), binary.scaling_table(F.col("c"), at, F.lit(20)).alias("t"))
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x).cast("long")
    return raw.select("doc_id", total("b").alias("big"), total("l").alias("little"), F.hex("s").alias("sideband"), F.hex(F.substring("t", 1, 4)).alias("scaling"))


def q41_block_heads(spark, sf_dir):
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    rows = rows.select("o_orderkey", (F.col("o_orderkey") * 40503 % 65536).alias("short"), ((F.col("o_orderkey") * 2654435761 + F.col("o_custkey")) % 4294967296).cast("long").alias("long"))
    block, granule = sound.block_head(F.col("short"), F.col("long")), sound.granule_head(F.col("short"))
    return rows.select("o_orderkey", *[c.alias(k) for k, c in block.items()], *[c.alias(f"g_{k}") for k, c in granule.items()])


def q42_texture_formats(spark, sf_dir):
    rows = table(spark, sf_dir, "part", "p_partkey")
    pick = lambda values: F.get(F.array(*[F.lit(x) for x in values]), (F.col("p_partkey") % len(values)).cast("int"))
    return rows.select(
        "p_partkey", images.texture_format(pick(("A8R8G8B8", "DXT5", "PNG", "dxt3", "DXT1A", "R5G6B5", "X8R8G8B8", "DXT3", ""))).alias("format"),
        images.alpha_capable(pick(("DXT1", "DXT5", "A8R8G8B8", "R5G6B5", "A16B16G16R16F", "X8R8G8B8", "DXT2"))).alias("alpha"),
    )


def q43_marker_clip(spark, sf_dir):
    marks = table(spark, sf_dir, "events", "event_id", "value").select("event_id", F.floor(F.col("value") * 3).cast("long").alias("position"))
    runs = ((20, 100), (-30, 90), (0, 50), (-80, 60))
    out = None
    for i, (start, length) in enumerate(runs):
        this = metadata.clip_markers(marks, start, length).withColumn("crop", F.lit(i))
        out = this if out is None else out.unionByName(this)
    return out


def q44_encodings(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    encoding, platform, version = (F.col("l_partkey") % 36 - 1).cast("int"), (F.col("l_suppkey") % 16).cast("int"), (F.col("l_linenumber") % 5).cast("int")
    asked = F.get(F.array(*[F.lit(x) for x in metadata.LOCATIONS.values()]), (F.col("l_partkey") % len(metadata.LOCATIONS)).cast("int"))
    supported = F.get(F.array(F.lit(0), F.lit(2048), F.lit(14336), F.lit(28)), (F.col("l_suppkey") % 4).cast("int"))
    name = metadata.encoding_name(encoding)
    return rows.select(
        "l_orderkey", "l_linenumber", encoding.alias("encoding"), name.alias("name"), metadata.encoding_id(name).alias("back"), metadata.codec_version(platform, version, encoding).alias("codec_version"),
        metadata.location_supported(asked, supported).alias("supported"),
    )


def q45_sound_defaults(spark, sf_dir):
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    own = {"pan": (3, 100), "vol": (5, 128), "samplerep": (7, 33), "sustainstart": (4, 1000)}
    maps = [F.when(F.col("o_orderkey") % every == 0, F.create_map(F.lit(k), (F.col("o_custkey") % n).cast("string"))).otherwise(F.create_map().cast("map<string,string>")) for k, (every, n) in own.items()]
    full = metadata.tag_overlay({k: str(v) for k, v in metadata.DEFAULTS.items()}, F.map_concat(*maps))
    return rows.select("o_orderkey", full.alias("m")).select("o_orderkey", *[F.element_at("m", k).cast("long").alias(k) for k in metadata.DEFAULTS])


def q46_codec_registry(spark, sf_dir):
    rows = table(spark, sf_dir, "orders", "o_orderkey")
    ids = [sound.codec_id(k) for k, _ in sound.CODECS] + [sound.codec_id("None")]
    asked = rows.select("o_orderkey", F.get(F.array(*[F.lit(i) for i in ids]), (F.col("o_orderkey") % len(ids)).cast("int")).cast("long").alias("codec_id"))
    return sound.with_codec(asked, sound.codecs(spark), "codec_id").select("o_orderkey", "codec_id", "letters", "codec")


def q47_match_finder(spark, sf_dir):
    found = ordered.matches_before(spread(table(spark, sf_dir, "documents", "doc_id", "text")), "doc_id", "text")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("matches"), F.sum("back").alias("distance"), F.max("back").alias("farthest"))


def q48_sort_select(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding").where("size(embedding) > 0").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    k = F.col("vec_id") % 70 + 1
    by = ordered.by_magnitude(F.col("e"))
    return rows.select("vec_id", F.get(by, F.lit(0)).alias("largest"), F.abs(F.get(by, F.lit(9))).alias("tenth"), ordered.kth_smallest(F.col("e"), k).alias("kth"))


def q49_scale_deinterleave(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", F.transform("embedding", lambda x: sound.scale_clip(x.cast("double") * 4)).alias("e"))
    parts = sound.deinterleave(F.col("e"), 3)
    side = lambda c: F.get(parts, F.lit(c))
    return rows.select(
        "vec_id", F.size(side(0)).cast("long").alias("frames"), F.round(F.element_at(side(1), 1), 6).alias("second"), F.round(F.element_at(side(2), -1), 6).alias("last"), F.round(F.array_max("e"), 6).alias("most"),
        sound.resampled_count(F.col("vec_id"), F.lit(2), F.lit(0.75)).alias("resampled"), F.round(sound.log2(F.col("vec_id") + 1.0), 6).alias("bits"),
    )


def q50_xa_decode(spark, sf_dir):
    rows = spread(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"))
    head = F.concat(F.hex(F.col("o_orderkey") % 4), F.hex(F.col("o_custkey") % 13))  # filter and shift
    data = F.unhex(F.concat(head, F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 28)))
    samples = ordered.xa_samples(data, F.col("o_custkey") % 4000 - 2000, F.col("o_custkey") % 300)
    out = rows.select("o_orderkey", samples.alias("s"))
    return out.select("o_orderkey", F.get("s", F.lit(0)).alias("first"), F.get("s", F.lit(27)).alias("last"), F.array_min("s").alias("least"), F.array_max("s").alias("most"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def q51_lz_streams(spark, sf_dir):
    from ..functions.codecs.lz import lz_unpack

    # Four literals, copies of each kind from four back, which overlap themselves, and the end with up to three literals.
    key = F.col("o_orderkey")
    lead = F.concat(F.lit("L"), F.lpad((key % 1000).cast("string"), 3, "0"))
    short, middle, long, tail = key % 8 + 3, key % 64 + 4, key % 1000 + 5, (key % 4).cast("int")
    byte = lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")
    more = long - 5
    stream = F.concat(
        F.lit("10FB"), F.lpad(F.hex((4 + short + middle + long + tail).cast("long")), 6, "0"), F.lit("E0"), F.hex(F.encode(lead, "UTF-8")), byte((short - 3) * 4), F.lit("03"), byte(128 + middle - 4), F.lit("0003"),
        byte(192 + F.floor(more / 256) * 4), F.lit("0003"), byte(more % 256), byte(252 + tail), F.hex(F.encode(F.repeat(F.lit("e"), tail), "UTF-8")),
    )
    return table(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", F.decode(lz_unpack(F.unhex(stream)), "UTF-8").alias("text"))


def q52_half_rgbe(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", "i", (F.floor(F.col("v").cast("double") * 4096) / 64).alias("x"))
    word = binary.double_to_half(F.col("x"))
    shared = images.float_to_rgbe(F.abs(F.col("x")), F.abs(F.col("x")) / 2, F.lit(0.25))
    rows = rows.select("vec_id", "i", "x", word.alias("half"), binary.half_to_double(word).alias("back"), shared.alias("c"))
    return rows.select("vec_id", "i", "half", "back", F.col("c.r").alias("r"), F.col("c.g").alias("g"), F.col("c.b").alias("b"), F.col("c.e").alias("e"))


def q53_pixel_math(spark, sf_dir):
    rows = images.swap_red_blue(images.with_alpha(_pixels(spark, sf_dir), 255))
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return images.wrapped(rows.withColumn("x", F.col("x") + 5), 8, 4).select(
        "image_id", "x", "y", images.scale_bias(r, 1.5, -20.0).alias("scaled"), images.dot([r, g, b], [b, g, r]).alias("dot"), images.wrap_byte(r - g * 3).alias("wrapped"), images.contrast(g, 1.25).alias("contrast"),
        F.floor(images.grey(r, g, b) + 0.0000001).cast("long").alias("grey"), images.pack_bgra(r, g, b, F.col("a")).alias("packed"), images.to_bits(images.unit(r, 8), 5).alias("five"),
    )


def q54_endian(spark, sf_dir):
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    word = (F.col("o_orderkey") * 2654435761 + F.col("o_custkey") * 40503) % 4294967296
    rows = rows.select("o_orderkey", word.cast("long").alias("word"))
    both = rows.select("o_orderkey", "word", binary.be_bytes(F.col("word"), 4).alias("b"), binary.le_bytes(F.col("word"), 4).alias("l"))
    return both.select(
        "o_orderkey", F.hex("b").alias("big"), F.hex("l").alias("little"), binary.be_uint(F.col("l"), 0, 4).alias("swapped"), binary.le_uint(F.col("b"), 1, 3).alias("three"),
        binary.signed(binary.be_uint(F.col("b"), 0, 2), 2).alias("signed"), binary.wrap_s16(F.col("word") % 100000).cast("long").alias("wrapped"),
    )


def q55_sound_math(spark, sf_dir):
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    n, hz = F.col("o_custkey"), F.col("o_orderkey") % 20000 + 20.0
    return rows.select(
        "o_orderkey", sound.u8_to_s16(n % 256).cast("long").alias("s16"), sound.s16_to_u8(n % 65536 - 32768).cast("long").alias("u8"), sound.s24_to_s16(n * 977 % 16777216 - 8388608).cast("long").alias("s24"),
        F.round(sound.gain(n.cast("double"), F.lit(0.3125)), 6).alias("gain"), sound.gcd(n, F.lit(360)).alias("gcd"), sound.nearest_of(n % 400, sound.BITRATES_FULL).alias("nearest"),
        F.round(sound.bark(hz), 6).alias("bark"), F.round(sound.critical_bandwidth(hz), 4).alias("bandwidth"), F.round(sound.hearing_threshold(hz), 4).alias("threshold"),
    )


def q56_texture_files(spark, sf_dir):
    pixels = _pixels(spark, sf_dir)
    kinds = pixels.select("image_id").distinct().withColumn("format", F.get(F.array(*[F.lit(x) for x in ("DXT1", "DXT3", "DXT5", "X8R8G8B8")]), (F.col("image_id") % 4).cast("int")))
    out = images.compressed(pixels, kinds)
    return out.select("image_id", "format", "levels", F.octet_length("dds").cast("long").alias("size"), F.hex(F.substring("dds", 1, 20)).alias("head"), "error")


def q57_total_frames(spark, sf_dir):
    fields = sound.mpeg_header(F.col("word"))
    rows = _mpeg_words(spark, sf_dir).select("l_orderkey", *[c.alias(n) for n, c in fields.items()]).where("valid")
    return rows.groupBy("l_orderkey").agg(F.sum("frames").alias("frames"), F.sum(F.col("size") + 4).alias("bytes"), F.max("rate").alias("rate"))


def q58_crc(spark, sf_dir):
    from ..functions import checksums

    rows = table(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", binary.be_bytes(F.col("o_orderkey") * 2654435761 % 4294967296, 4).alias("c"))
    return rows.select("o_orderkey", checksums.crc16_header("c").cast("long").alias("header"), checksums.crc16_payload("c").cast("long").alias("payload"))


def q59_granules(spark, sf_dir):
    from ..functions.codecs import frames

    # Two mono frames of each order; the second one's main data begins in the first.
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders", "o_orderkey")
    shares = max(spark.sparkContext.defaultParallelism, 8 * orders.rdd.getNumPartitions())  # they grow with the input, so that tasks don't
    rows = orders.select("o_orderkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("seq"))
    digits = lambda name, n: F.substring(F.repeat(F.md5(F.concat(F.lit(name), key.cast("string"), F.lit("-"), F.col("seq").cast("string"))), 25), 1, n)
    width = lambda c, n: F.lpad(F.bin(c.cast("long")), n, "0")
    back = F.when(F.col("seq") == 1, key % 60 + 1).otherwise(0)
    fill = F.concat(*[F.lpad(F.conv(F.substring(digits("s", 32), i, 4), 16, 2), 16, "0") for i in range(1, 25, 4)])  # 96 bits
    side = F.concat(width(back, 9), F.lit("00000"), F.substring(fill, 1, 4), width(key % 1000 + 100, 12), F.substring(fill, 5, 47), width(key % 1500 + 50, 12), F.substring(fill, 50, 47))
    side = F.concat(*[F.lpad(F.conv(F.substring(side, 8 * i + 1, 8), 2, 16), 2, "0") for i in range(17)])
    content = F.unhex(F.concat(F.lit("FFFB90C0"), side, digits("m", 792)))
    out = frames.granules(rows, "o_orderkey", "seq", content, shares)
    return out.select("o_orderkey", "seq", "granule", F.octet_length("data").cast("long").alias("size"), F.hex(F.substring("data", 1, 24)).alias("head"), F.md5("data").alias("digest"), "error")


def q60_pcm_blocks(spark, sf_dir):
    from ..functions.codecs import frames

    rows = frames.segments(_stream(spark, sf_dir).withColumn("value", sound.to_s16(F.col("value") * 50)), "user_id", "value", 2048)
    rows = rows.withColumn("data", frames.pcm_blocks("samples")).withColumn("back", frames.pcm_unblocked("data"))
    head = sound.block_head(binary.be_uint(F.col("data"), 0, 2), binary.be_uint(F.col("data"), 2, 4))
    return rows.select("user_id", "seg", F.octet_length("data").cast("long").alias("size"), head["pcm_samples"].alias("first_block"), F.aggregate("back", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), (F.col("back") == F.col("samples")).alias("same"))


QUERIES = {name: f for name, f in list(globals().items()) if name[0] == "q" and name[1:3].isdigit()}
