"""SQL for DuckDB of the asset queries, written from the definition of each operator."""

from __future__ import annotations

from ..functions.loudness import equal_loudness, high_pass

_STREAM = "(SELECT user_id, ts, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)"
_ENTRIES = "(SELECT doc_id, lower(source || '/' || doc_id || '.txt') AS name, CAST(strlen(text) AS BIGINT) AS size, n_chars AS packed_size FROM documents)"
_RATES = "[8000, 11025, 12000, 16000, 22050, 24000, 32000, 44100, 48000]"
_FULL = "[32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]"
_LOW = "[8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]"


def _next(value: str, table: str) -> str:
    return f"coalesce(list_filter({table}, lambda t: t >= {value})[1], {table}[-1])"


def _pixels(width: int) -> str:
    grey = "CAST(least(greatest(floor((CAST(v AS DOUBLE) + 0.55) * 231.8), 0), 255) AS INTEGER)"
    return f"""(
      SELECT image_id, x, y, g0 AS r, g0 >> 1 AS g, 255 - g0 AS b,
        CASE image_id % 4 WHEN 0 THEN 255 WHEN 1 THEN 128 WHEN 2 THEN CASE WHEN g0 > 127 THEN 255 ELSE 0 END ELSE g0 END AS a
      FROM (SELECT image_id, CAST(i % {width} AS INTEGER) AS x, CAST(i // {width} AS INTEGER) AS y, {grey} AS g0
            FROM (SELECT vec_id AS image_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings)))"""


def _frames(channels: int) -> str:
    return f"""(SELECT vec_id, CAST(i % {channels} AS INTEGER) AS channel, CAST(i // {channels} AS INTEGER) AS n, round(CAST(v AS DOUBLE), 6) AS sample
      FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings))"""


_ERRORS = f"""(
  SELECT user_id, n // 28 AS blk, count(*) AS n_valid, max(abs(value)) AS e0, max(abs(value - 240 * x1 / 256.0)) AS e1,
    max(abs(value - (460 * x1 - 208 * x2) / 256.0)) AS e2, max(abs(value - (392 * x1 - 220 * x2) / 256.0)) AS e3
  FROM (SELECT *, coalesce(lag(value, 1) OVER w, 0) AS x1, coalesce(lag(value, 2) OVER w, 0) AS x2 FROM {_STREAM} WINDOW w AS (PARTITION BY user_id ORDER BY n))
  GROUP BY ALL)"""

_SHIFT = "CASE " + " ".join(f"WHEN (e + {(16384 >> s) >> 3}) & {16384 >> s} <> 0 THEN {s}" for s in range(12)) + " ELSE 12 END"

_WINDOWS = """(
  SELECT {keys}, least(greatest(CAST(trunc(1000 * log10(0.5 * ms + 1e-37)) AS BIGINT), 0), 11999) AS bucket, count(*) AS windows
  FROM (SELECT {keys}, n // 10 AS win, sum(value * value) / count(*) AS ms FROM {source} GROUP BY ALL) GROUP BY ALL)"""


def _filter(values: str, b: list[float], a: list[float]) -> str:
    """A list of doubles through a recursive filter: the sum over inputs first, then the recurrence as a fold that appends each output."""
    k = len(a)
    zeros = "[" + ", ".join(["0.0::DOUBLE"] * k) + "]"
    row = lambda v: "[" + ", ".join(f"{x}::DOUBLE" for x in v) + "]"
    forward = f"list_transform(range(1, len({values}) + 1), lambda i: list_dot_product(list_concat({zeros}, {values})[i:i + {k}], {row(b[::-1])}))"
    step = f"list_append(y, x[1] - list_dot_product(y[len(y) - {k - 1}:len(y)], {row(a[::-1])}))"
    return f"list_reduce(list_concat([{zeros}], list_transform({forward}, lambda f: [f])), lambda y, x: {step})[{k + 1}:]"


def _loud(rate: int) -> str:
    """Streams through both loudness filters."""
    first, second = ([list(map(float, c)) for c in f(rate)] for f in (equal_loudness, high_pass))
    return f"""(
      SELECT user_id, unnest(v) AS value, unnest(range(len(v))) AS n FROM (
        SELECT user_id, {_filter('u', *second)} AS v FROM (SELECT user_id, {_filter('w', *first)} AS u FROM (SELECT user_id, list(value ORDER BY n) AS w FROM {_STREAM} GROUP BY user_id))))"""


_LOUD = _loud(44100)


def _mips() -> str:
    step = "SELECT image_id, CAST(x // 2 AS INTEGER) AS x, CAST(y // 2 AS INTEGER) AS y, CAST(sum(r) // count(*) AS INTEGER) AS r, CAST(sum(g) // count(*) AS INTEGER) AS g, CAST(sum(b) // count(*) AS INTEGER) AS b, CAST(sum(a) // count(*) AS INTEGER) AS a FROM {0} GROUP BY image_id, x // 2, y // 2"
    return f"WITH m1 AS ({step.format(_pixels(8))}), m2 AS ({step.format('m1')}), m3 AS ({step.format('m2')}) " + " UNION ALL ".join(f"SELECT image_id, {k} AS level, x, y, r, g, b, a FROM m{k}" for k in (1, 2, 3))


def _mpeg() -> str:
    word = "CAST(4292870144 + (l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 31) % 2097152 AS BIGINT)"
    layer1 = "[32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448]"
    layer2 = "[32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384]"
    layer1_low = "[32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256]"
    return f"""
    WITH f AS (SELECT l_orderkey, l_linenumber, {word} AS word FROM lineitem),
    b AS (SELECT *, (word >> 19) & 3 AS v, 4 - ((word >> 17) & 3) AS l, (word >> 12) & 15 AS bi, (word >> 10) & 3 AS ri, (word >> 9) & 1 AS pad, (word >> 6) & 3 AS mode FROM f),
    c AS (SELECT *, (word >> 21) = 2047 AND v <> 1 AND l < 4 AND ri < 3 AND bi BETWEEN 1 AND 14 AS valid,
      CASE WHEN l = 1 AND v <> 3 THEN {layer1_low}[bi] WHEN l = 1 THEN {layer1}[bi] WHEN v <> 3 THEN {_LOW}[bi] WHEN l = 2 THEN {layer2}[bi] ELSE {_FULL}[bi] END AS kb,
      [44100, 48000, 32000][ri + 1] // CASE v WHEN 3 THEN 1 WHEN 2 THEN 2 ELSE 4 END AS hz FROM b)
    SELECT l_orderkey, l_linenumber, word, valid, CASE WHEN valid THEN v END AS version, CASE WHEN valid THEN l END AS layer,
      CASE WHEN valid THEN CAST(kb AS BIGINT) END AS kbit, CASE WHEN valid THEN CAST(hz AS BIGINT) END AS rate,
      CASE WHEN valid THEN CAST(CASE WHEN l = 1 THEN 384 WHEN l = 3 AND v <> 3 THEN 576 ELSE 1152 END AS BIGINT) END AS frames,
      CASE WHEN valid THEN CAST(CASE WHEN l = 1 THEN 4 * (12000 * kb // hz + pad) WHEN l = 3 AND v <> 3 THEN 72000 * kb // hz + pad ELSE 144000 * kb // hz + pad END - 4 AS BIGINT) END AS size,
      CASE WHEN valid THEN CAST(CASE mode WHEN 3 THEN 1 ELSE 2 END AS BIGINT) END AS channels
    FROM c"""


SQL: dict[str, str] = {
    "q01_archive_layout": f"""
      WITH e AS (SELECT doc_id, name, size FROM {_ENTRIES}), h AS (SELECT CAST(ceil((24 + sum(9 + strlen(name))) / 64.0) * 64 AS BIGINT) AS header_size FROM e)
      SELECT doc_id, name, size, header_size,
        CAST(header_size + coalesce(sum((size + 63) // 64 * 64) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM e, h""",
    "q02_compress_policy": f"""
      WITH e AS (SELECT regexp_replace(name, '\\.txt$', '') || ['.txt', '.snd', '.asset', '.VP6'][doc_id % 4 + 1] AS name, size, packed_size FROM {_ENTRIES}),
      p AS (SELECT *, doc_ext NOT IN ('cdata', 'vp6', 'snd', 'imp') AND packed_size < size - 30 AS compressed FROM (SELECT *, lower(regexp_extract(name, '\\.([^./]*)$', 1)) AS doc_ext FROM e WHERE NOT ends_with(name, '.asset')))
      SELECT name, size, packed_size, compressed, CASE WHEN compressed THEN packed_size ELSE size END AS stored FROM p""",
    "q03_natural_order": r"""
      WITH k AS (SELECT p_partkey, p_brand, p_brand || ' a' || p_partkey || 'b' || (p_partkey % 7) AS label FROM part),
      n AS (SELECT *, array_to_string(list_transform(regexp_extract_all(label, '([0-9]+|[^0-9]+)'),
        lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(CAST(length(ltrim(x, '0')) AS VARCHAR), 10, '0') || ltrim(x, '0') ELSE x END), '') || chr(0) || label AS natural_key FROM k)
      SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CAST(regexp_extract(label, ' a([0-9]+)b', 1) AS BIGINT), label) AS place FROM n""",
    "q04_sniff_best": """
      SELECT page_id, name, CAST(CASE kind WHEN 0 THEN 100 WHEN 1 THEN 100 WHEN 3 THEN 100 WHEN 5 THEN CASE WHEN 5 + page_id // 9 % 5 >= 7 THEN 75 ELSE 0 END WHEN 6 THEN named
          WHEN 7 THEN CASE WHEN other THEN named ELSE 0 END WHEN 8 THEN CASE WHEN other OR page_id // 9 % 2 * 500 >= 400 THEN named ELSE 0 END ELSE 0 END AS BIGINT) AS score,
        CAST(CASE kind WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 3 THEN 35 WHEN 5 THEN CASE WHEN 5 + page_id // 9 % 5 >= 7 THEN 34 END WHEN 6 THEN 39
          WHEN 7 THEN CASE WHEN other THEN 39 END WHEN 8 THEN CASE WHEN other OR page_id // 9 % 2 * 500 >= 400 THEN 39 END END AS BIGINT) AS format_id
      FROM (SELECT page_id, 'f' || page_id || CASE WHEN page_id % 2 = 0 THEN '.snr' ELSE '.bin' END AS name, page_id % 9 AS kind, page_id % 4 < 2 AS other, CASE WHEN page_id % 2 = 0 THEN 90 ELSE 50 END AS named FROM pages)""",
    "q05_predictor_select": f"""
      SELECT user_id, blk, n_valid, CASE WHEN e0 <= 7 THEN 0 WHEN e0 = m THEN 0 WHEN e1 = m THEN 1 WHEN e2 = m THEN 2 ELSE 3 END AS predictor,
        floor(CASE WHEN e0 <= 7 THEN e0 ELSE m END * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS error FROM (SELECT *, least(e0, e1, e2, e3) AS m FROM {_ERRORS})""",
    "q06_shift_select": f"SELECT event_id, {_SHIFT} AS shift FROM (SELECT event_id, CAST(least(floor(value * 60), 32767) AS BIGINT) AS e FROM events)",
    "q07_block_pad": f"""
      WITH b AS (SELECT user_id, n // 28 AS blk, count(*) AS n_valid, sum(value) AS s, max_by(value, n) AS last FROM {_STREAM} GROUP BY ALL)
      SELECT user_id, blk, n_valid, round(s + (28 - n_valid) * last, 4) AS total, last FROM b""",
    "q08_s16_clamp_roundtrip": """
      WITH s AS (SELECT l_orderkey, l_linenumber, CAST(trunc(least(greatest((l_extendedprice - 30000) * (1 + l_discount), -32768.0::DOUBLE), 32767.0::DOUBLE)) AS INTEGER) AS sample FROM lineitem)
      SELECT *, CAST(trunc(least(greatest(CAST(sample AS DOUBLE) / 32768.0::DOUBLE * 32767.0::DOUBLE, -32768.0::DOUBLE), 32767.0::DOUBLE)) AS INTEGER) AS coded FROM s""",
    "q09_rate_snap": f"SELECT o_orderkey, rate, {_next('rate', _RATES)} AS snapped FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 5) AS BIGINT) AS rate FROM orders)",
    "q10_bitrate_snap": f"""SELECT l_orderkey, l_linenumber, asked, CASE WHEN l_linestatus = 'F' THEN {_next('asked', _FULL)} ELSE {_next('asked', _LOW)} END AS kbit
      FROM (SELECT *, CAST(trunc(l_quantity * 7) AS BIGINT) AS asked FROM lineitem)""",
    "q11_crop_pad": f"""
      WITH u AS (SELECT DISTINCT user_id, unnest(range(-8, 56)) AS n FROM events)
      SELECT u.user_id, u.n + 8 AS n, coalesce(s.value, 0) AS sample FROM u LEFT JOIN {_STREAM} s ON s.user_id = u.user_id AND s.n = u.n""",
    "q12_channel_remap": f"SELECT vec_id, [0, 2, 1, 3][channel + 1] AS channel, n, sample FROM {_frames(4)}",
    "q13_interleave": f"""SELECT vec_id, channel, count(*) AS n_frames, min_by(sample, n) AS "first", max_by(sample, n) AS "last" FROM {_frames(2)} GROUP BY vec_id, channel""",
    "q14_alpha_guess": f"""
      WITH s AS (SELECT image_id, min(a) = max(a) AS constant, bool_and(a IN (0, 255)) AS one_bit, min(a) AS least, max(x) + 1 AS w FROM {_pixels(8)} GROUP BY image_id)
      SELECT image_id, constant, one_bit, least, CASE WHEN image_id % 11 = 0 THEN 'DXT3' WHEN image_id % 7 = 0 THEN 'DXT1' WHEN constant AND least = 255 THEN 'DXT1' WHEN constant OR one_bit THEN 'DXT3' ELSE 'DXT5' END AS format,
        w & (w - 1) = 0 AS valid FROM s""",
    "q15_volume_slice": f"SELECT image_id, x % 2 AS x, y, r, CAST(x // 2 AS INTEGER) AS slice FROM {_pixels(32)}",
    "q16_mip_chain": _mips(),
    "q17_loudness_hist": f"""
      WITH b AS (SELECT * FROM {_WINDOWS.format(keys='user_id', source=_LOUD)}),
      c AS (SELECT *, sum(windows) OVER (PARTITION BY user_id ORDER BY bucket DESC) AS covered, sum(windows) OVER (PARTITION BY user_id) AS total FROM b)
      SELECT user_id, max(bucket) AS bucket, CAST(max(total) AS BIGINT) AS windows, 64.82::DOUBLE - max(bucket) / 100.0::DOUBLE AS gain FROM c WHERE covered >= ceil(total * 0.05::DOUBLE) GROUP BY user_id""",
    "q18_album_rollup": f"""
      WITH b AS (SELECT * FROM {_WINDOWS.format(keys='album, user_id', source=f'(SELECT *, user_id % 10 AS album FROM {_LOUD})')})
      SELECT album, user_id, CAST(sum(windows) AS BIGINT) AS windows, max(bucket) AS top, CAST(grouping(album, user_id) AS BIGINT) AS level FROM b GROUP BY ROLLUP (album, user_id)""",
    "q19_crossfade": f"SELECT user_id, n, floor((value * (1 - k) + value * -0.5::DOUBLE * k) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS mixed FROM (SELECT *, least(n / 16.0::DOUBLE, 1.0::DOUBLE) AS k FROM {_STREAM})",
    "q20_hermite": f"""
      WITH s AS (SELECT user_id, n, value, (coalesce(lead(value) OVER w, value) - coalesce(lag(value) OVER w, value)) * 0.5 AS m FROM {_STREAM} WINDOW w AS (PARTITION BY user_id ORDER BY n)),
      p AS (SELECT *, lead(value) OVER w AS y1, lead(m) OVER w AS m1 FROM s WINDOW w AS (PARTITION BY user_id ORDER BY n))
      SELECT user_id, n, floor(((value + y1) * 0.5::DOUBLE + (m - m1) * 0.125::DOUBLE) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS "between" FROM p WHERE y1 IS NOT NULL""",
    "q21_export_validate": """
      WITH s AS (SELECT l_orderkey, l_linenumber, [1, 35, 39, 39, 7][l_partkey % 5 + 1] AS format_id, [0, 10, 11, 29, 31][l_suppkey % 5 + 1] AS encoding, l_partkey % 9 AS channels,
          CASE WHEN l_partkey % 31 = 0 THEN 0 ELSE l_partkey * 37 % 110000 END AS rate, CAST(trunc(l_quantity) AS BIGINT) - 2 AS n_frames, CASE WHEN l_suppkey % 29 = 0 THEN -1 ELSE 50 END AS bitrate,
          [0, 2048, 8, 4096][(l_partkey + l_linenumber) % 4 + 1] AS location, CASE WHEN l_suppkey % 2 = 0 THEN l_linenumber ELSE -1 END AS ls, CASE WHEN l_suppkey % 3 > 0 THEN 5 + l_linenumber % 3 ELSE -1 END AS le,
          CASE WHEN l_partkey % 4 = 0 THEN 64 ELSE 0 END AS sideband FROM lineitem),
      f(format_id, most, enc, several) AS (VALUES (1, 64, [0, 11], false), (34, 2, CAST([] AS INTEGER[]), false), (35, 6, [10], false), (39, 64, [29, 1, 30, 31, 32], true))
      SELECT l_orderkey, l_linenumber, s.format_id, encoding, CASE WHEN most IS NULL THEN 'format' WHEN rate <= 0 THEN 'rate' WHEN channels <= 0 THEN 'channels' WHEN n_frames < 0 THEN 'length' WHEN bitrate < 0 THEN 'bitrate'
        WHEN channels > most THEN 'max channels' WHEN NOT list_contains(enc, encoding) THEN 'encoding' WHEN several AND location = 8 THEN 'location'
        WHEN ls >= 0 AND le < 0 THEN 'only loop start' WHEN le >= 0 AND ls < 0 THEN 'only loop end' WHEN le >= 0 AND le >= n_frames THEN 'loop end past samples' WHEN ls >= 0 AND le >= 0 AND ls > le THEN 'loop start after end'
        WHEN ls >= 0 AND le >= 0 AND sideband > 0 THEN 'time stretch with loop' WHEN sideband > 0 AND channels >= 2 THEN 'time stretch of several channels' END AS error FROM s LEFT JOIN f USING (format_id)""",
    "q22_tag_width": """
      WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN w % 300 ELSE w END AS value FROM (SELECT o_orderkey, CAST(floor(o_totalprice * (o_orderkey % 41)) AS BIGINT) - 8400000 AS w FROM orders)),
      t AS (SELECT *, CASE WHEN value = 0 THEN NULL WHEN value BETWEEN -128 AND 127 THEN 1 WHEN value BETWEEN -32768 AND 32767 THEN 2 WHEN value BETWEEN -8388608 AND 8388352 THEN 3 ELSE 4 END AS width FROM v)
      SELECT *, CASE WHEN width IS NULL THEN '' ELSE '82' || lpad(hex(width), 2, '0') || right(lpad(hex(value & 4294967295), 8, '0'), 2 * width) END AS tag FROM t""",
    "q23_mpeg_header": _mpeg(),
    "q24_bit_header": """
      SELECT o_orderkey, word, word >> 28 AS version, (word >> 24) & 15 AS codec, ((word >> 18) & 63) + 1 AS channels, word & 262143 AS rate
      FROM (SELECT o_orderkey, CAST((o_orderkey * 2654435761 + o_custkey * 40503) % 4294967296 AS BIGINT) AS word FROM orders)""",
    "q25_chunk_schedule": """
      WITH s AS (SELECT o_orderkey, o_custkey % 40000 + 8000 AS rate, CAST(floor(o_totalprice / 10) AS BIGINT) AS n_frames FROM orders),
      k AS (SELECT *, unnest(range(0, greatest(CAST(ceil(n_frames * 15 / rate::DOUBLE) AS BIGINT) - 1, 0) + 1)) AS chunk FROM s),
      u AS (SELECT o_orderkey, CAST(chunk AS INTEGER) AS chunk, CASE WHEN chunk = 0 THEN 0 ELSE least((chunk * rate // 15 + 27) // 28 * 28, n_frames) END AS start, least(((chunk + 1) * rate // 15 + 27) // 28 * 28, n_frames) AS stop FROM k)
      SELECT * FROM u WHERE stop > start""",
    "q26_sticky_manifest": """
      SELECT conv_id, turn, role, last_value(CASE WHEN role = 'system' THEN '-pack1' WHEN role = 'user' AND turn % 4 = 0 THEN '-pack0' END IGNORE NULLS)
        OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mode FROM conversations""",
    "q27_pair_join": """
      WITH c AS (SELECT l_orderkey AS stem, count(*) AS n_chunks, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS n_bytes, CAST(max(l_linenumber) AS BIGINT) AS last_seq FROM lineitem GROUP BY 1),
      h AS (SELECT CASE WHEN o_custkey % 5 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END AS stem, o_orderstatus FROM orders)
      SELECT h.stem, o_orderstatus, n_chunks, n_bytes, last_seq, n_chunks IS NOT NULL AS complete FROM h LEFT JOIN c ON c.stem = h.stem""",
    "q28_tag_overlay": """
      SELECT event_id, coalesce(CASE WHEN event_id % 5 > 0 THEN CAST(props->>'$.k' AS BIGINT) END, -1) AS k, coalesce(CASE WHEN event_id % 5 > 0 THEN CAST(props->>'$.rate' AS BIGINT) END, 44100) AS rate,
        coalesce(CASE WHEN event_id % 5 > 0 THEN CAST(props->>'$.channels' AS BIGINT) END, 1) AS channels FROM events""",
    "q29_lz_roundtrip": "SELECT doc_id, text FROM documents",
    "q34_stream_state": f"""
      SELECT user_id, n // 28 AS blk, count(*) AS n_valid, round(sum(value), 4) AS total, min_by(value, n) AS "first", max_by(value, n) AS "last" FROM {_STREAM} GROUP BY user_id, n // 28 HAVING count(*) = 28""",
    "q35_seek_index": """
      WITH n AS (SELECT l_suppkey, CAST(trunc(l_quantity) AS BIGINT) AS q, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity) - 1 AS n FROM lineitem),
      c AS (SELECT l_suppkey, n, sum(q) OVER (PARTITION BY l_suppkey ORDER BY n) AS cum, sum(q) OVER (PARTITION BY l_suppkey) AS total, count(*) OVER (PARTITION BY l_suppkey) AS frames FROM n),
      p AS (SELECT l_suppkey, unnest(range(100)) AS point, c FROM (SELECT l_suppkey, count(*) AS c FROM lineitem GROUP BY 1))
      SELECT p.l_suppkey, CAST(point AS INTEGER) AS point, CAST(least(255, 256 * cum // total) AS BIGINT) AS position FROM p JOIN c ON c.l_suppkey = p.l_suppkey AND c.n = point * p.c // 100""",
    "q36_histograms": f"""
      WITH k AS (SELECT {_next('CAST(trunc(l_quantity * 7) AS BIGINT)', _FULL)} AS kbit, l_linestatus, l_returnflag FROM lineitem)
      SELECT kbit, l_linestatus, count(*) FILTER (l_returnflag = 'A') AS A, count(*) FILTER (l_returnflag = 'N') AS N, count(*) FILTER (l_returnflag = 'R') AS R FROM k GROUP BY kbit, l_linestatus""",
    "q30_lz_ratio": "SELECT doc_id, strlen(text) AS size, strlen(text) AS announced, '10FB' AS signature, true AS bounded, true AS smaller FROM documents",
    "q31_xas_roundtrip": "SELECT user_id, count(*) AS n, CAST((count(*) + 127) // 128 * 76 AS BIGINT) AS n_bytes, true AS close FROM events GROUP BY user_id",
    "q32_xa_roundtrip": """
      SELECT user_id, n, CAST(n // 1792 * (61 + 15 * 63) + CASE WHEN n % 1792 > 0 THEN 61 + 15 * ((n % 1792 + 27) // 28 - 1) ELSE 0 END AS BIGINT) AS n_bytes, true AS close
      FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)""",
    "q33_resample": "SELECT user_id, CASE WHEN n <= 2 THEN n ELSE n // 2 END AS resampled, CAST(0 AS BIGINT) AS wild FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)",
    "q37_manifest": """
      WITH l AS (SELECT conv_id, turn, role, conv_id || '/' || turn AS p, CASE WHEN role = 'system' THEN 1 WHEN turn % 5 = 4 THEN 0 END AS switch, role <> 'system' AND turn % 5 <> 4 AND turn % 7 <> 6 AS entry FROM conversations),
      s AS (SELECT *, last_value(switch IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS mode FROM l)
      SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'in/' || p || '.txt' ELSE 'in/' || p END AS src, CASE WHEN turn % 3 = 0 THEN 'out/' || p || '.TXT' ELSE 'in/' || p END AS dst, coalesce(mode = 1, false) AS compress FROM s WHERE entry""",
    "q38_paths": """
      WITH f AS (SELECT *, doc_id % 3 > 0 AS below, 'f' || doc_id AS stem FROM documents)
      SELECT doc_id, 'data\\' || source || '\\' || CASE WHEN below THEN lang || '\\' || stem || '.snr' ELSE stem || '.Snr' END AS src, CASE WHEN below THEN lang || '\\' || stem || '.snr' ELSE stem || '.Snr' END AS dst,
        'snr' AS extension, CASE WHEN below THEN 'data\\' || source || '\\' || lang || '\\' || stem || '.sns' ELSE stem || '.sns' END AS companion, source || CASE WHEN doc_id % 2 = 0 THEN '_x' ELSE '' END || '.snr' AS added, true AS safe FROM f""",
    "q39_tag_kinds": """
      WITH v AS (SELECT o_orderkey, o_custkey % 300 AS n, CASE WHEN o_custkey % 300 >= 255 THEN 6 ELSE 2 END AS head FROM orders)
      SELECT o_orderkey, CASE WHEN n = 100 THEN '' ELSE '8202' || right(lpad(hex((n - 100) & 65535), 4, '0'), 4) END AS fixed, CAST((16 - (o_orderkey + head) % 16) % 16 AS BIGINT) AS pad,
        CASE WHEN n = 0 THEN '' WHEN n < 255 THEN left('14' || lpad(hex(n), 2, '0') || repeat('78', n), 14) ELSE '14FF' || lpad(hex(n), 8, '0') || '78' END AS blob_head,
        CAST(CASE WHEN n = 0 THEN 0 ELSE n + head END AS BIGINT) AS blob_size, 'FF' AS "end" FROM v""",
    "q40_codebooks": """
      WITH h AS (SELECT doc_id, doc_id % 10 AS at0, hex(encode(text)) AS x, strlen(text) AS size FROM documents),
      b AS (SELECT *, list_transform(range(0, 32), lambda i: TRY_CAST('0x' || substr(x, 2 * (at0 + i) + 1, 2) AS BIGINT)) AS v FROM h)
      SELECT doc_id, CASE WHEN size >= at0 + 32 THEN CAST(list_sum(list_transform(range(1, 17), lambda i: ((v[2 * i - 1] * 256 + v[2 * i]) + 32768) % 65536 - 32768)) AS BIGINT) END AS big,
        CASE WHEN size >= at0 + 32 THEN CAST(list_sum(list_transform(range(1, 17), lambda i: ((v[2 * i] * 256 + v[2 * i - 1]) + 32768) % 65536 - 32768)) AS BIGINT) END AS little,
        CASE WHEN size >= at0 + 9 THEN substr(x, 2 * at0 + 1, 18) END AS sideband, CASE WHEN size >= at0 + 16 + 128 THEN substr(x, 2 * (at0 + 16) + 1, 8) END AS scaling FROM b""",
    "q41_block_heads": """
      WITH w AS (SELECT o_orderkey, o_orderkey * 40503 % 65536 AS s, CAST((o_orderkey * 2654435761 + o_custkey) % 4294967296 AS BIGINT) AS l FROM orders),
      f AS (SELECT *, s >= 32768 AS extended, s // 16384 % 2 + 1 AS channels, s % 4096 AS size, CASE WHEN s >= 32768 THEN l % 1024 ELSE s % 4096 - 2 END AS granule_size, CASE WHEN s >= 32768 THEN l // 1024 % 1024 ELSE 0 END AS pcm_samples FROM w)
      SELECT o_orderkey, extended, channels, size, CASE WHEN extended THEN l // 1073741824 ELSE 0 END AS mode, CASE WHEN extended THEN l // 1048576 % 1024 ELSE 0 END AS offset_samples, pcm_samples, granule_size,
        CAST(CASE WHEN NOT extended THEN 2 WHEN granule_size > 0 THEN 6 ELSE 0 END AS BIGINT) AS granule_at, CASE WHEN extended THEN 6 + granule_size ELSE 0 END AS pcm_at, pcm_samples * channels * 2 AS pcm_bytes,
        s // 16384 AS g_version, s // 4096 % 4 AS g_rate, s // 1024 % 4 AS g_mode, s // 256 % 4 AS g_extension, s // 128 % 2 AS g_granule FROM f""",
    "q42_texture_formats": """
      SELECT p_partkey, ['A8R8G8B8', 'DXT5', 'DXT1', 'DXT1', 'DXT1A', 'R5G6B5', 'X8R8G8B8', 'DXT3', 'DXT1'][p_partkey % 9 + 1] AS format, [false, true, true, false, true, false, true][p_partkey % 7 + 1] AS alpha FROM part""",
    "q43_marker_clip": """
      WITH m AS (SELECT event_id, CAST(floor(value * 3) AS BIGINT) AS p FROM events)
      SELECT event_id, p - 20 AS position, 0 AS crop FROM m WHERE p BETWEEN 20 AND 120 UNION ALL SELECT event_id, p + 30, 1 FROM m WHERE p < 60 UNION ALL SELECT event_id, p, 2 FROM m WHERE p BETWEEN 0 AND 50""",
    "q44_encodings": """
      WITH v AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 36 - 1 AS INTEGER) AS e, l_suppkey % 16 AS platform, l_linenumber % 5 AS ver, [0, 4, 8, 16, 256, 512, 1024, 2048, 4096, 8192][l_partkey % 10 + 1] AS asked, l_suppkey % 4 AS s FROM lineitem),
      d(e, name) AS (VALUES (0, 's16l_int'), (1, 's16b_int'), (10, 'eaxa_blk'), (11, 'u8_int'), (29, 'xas_int'), (30, 'ealayer3_int'), (31, 'ealayer3pcm_int'), (32, 'ealayer3spike_int'))
      SELECT l_orderkey, l_linenumber, v.e AS encoding, CASE WHEN v.e < 0 OR v.e > 32 THEN 'Unknown' ELSE d.name END AS name, CASE WHEN d.name IS NOT NULL THEN v.e END AS back,
        CASE WHEN v.e IN (4, 10, 22) AND ((platform IN (5, 6, 7, 8) AND ver > 2) OR (platform = 0 AND ver > 1) OR platform IN (9, 10, 14)) THEN 1 ELSE 0 END AS codec_version,
        CASE s WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN asked IN (0, 2048, 4096, 8192) ELSE asked IN (0, 4, 8, 16) END AS supported FROM v LEFT JOIN d ON d.e = v.e""",
    "q45_sound_defaults": """
      SELECT o_orderkey, 127 AS velmax, 127 AS keymax, 60 AS keybase, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 100 ELSE 64 END AS pan, 1 AS panmult, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey % 128 ELSE 127 END AS vol, 1 AS numenvelopes,
        -1 AS releaseenvelope, 127 AS initialenvelopevol, 64 AS bend, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey % 33 ELSE -1 END AS samplerep, 1 AS truncateloops, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 1000 ELSE -1 END AS sustainstart,
        -1 AS sustainend, 50 AS bitrate FROM orders""",
    "q46_codec_registry": """
      WITH r(k, letters, codec) AS (VALUES (0, 'EL31', 'granule layer 3'), (1, 'L32P', 'granule layer 3 with PCM'), (2, 'L32S', 'granule layer 3 with spikes'), (3, 'MP30', 'MPEG layer 3'), (4, 'P6B0', 'PCM 16 big-endian'), (5, 'P6L0', 'PCM 16 little-endian'), (6, 'Xas1', 'XAS'), (7, 'None', NULL))
      SELECT o_orderkey, CAST('0x' || hex(encode(letters)) AS BIGINT) AS codec_id, CASE WHEN k < 7 THEN letters END AS letters, codec FROM orders JOIN r ON o_orderkey % 8 = k""",
    "q47_match_finder": """
      WITH g AS (SELECT doc_id, n, substr(text, n + 1, 3) AS s FROM (SELECT doc_id, text, unnest(range(0, length(text) - 2)) AS n FROM documents WHERE length(text) >= 3)),
      b AS (SELECT doc_id, n - lag(n) OVER (PARTITION BY doc_id, s ORDER BY n) AS back FROM g)
      SELECT doc_id, count(*) AS matches, CAST(sum(back) AS BIGINT) AS distance, max(back) AS farthest FROM b WHERE back <= 131071 GROUP BY doc_id""",
    "q48_sort_select": """
      WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE len(embedding) > 0)
      SELECT vec_id, CASE WHEN list_max(e) >= abs(list_min(e)) THEN list_max(e) ELSE list_min(e) END AS largest, list_reverse_sort(list_transform(e, lambda x: abs(x)))[10] AS tenth, list_sort(e)[vec_id % 70 + 1] AS kth FROM e""",
    "q49_scale_deinterleave": """
      WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: least(greatest(CAST(x AS DOUBLE) * 4 * 32768.0::DOUBLE, -32768.0::DOUBLE), 32767.0::DOUBLE)) AS e FROM embeddings)
      SELECT vec_id, CAST(len(e) // 3 AS BIGINT) AS frames, round(e[2], 6) AS second, round(e[len(e) // 3 * 3], 6) AS "last", round(list_max(e), 6) AS most, CAST(floor(vec_id * 1.5::DOUBLE) AS BIGINT) AS resampled, round(log2(vec_id + 1.0::DOUBLE), 6) AS bits FROM e""",
    "q50_xa_decode": """
      WITH b AS (SELECT o_orderkey, o_custkey % 13 AS shift, [0, 240, 460, 392][o_orderkey % 4 + 1] AS c1, [0, 0, -208, -220][o_orderkey % 4 + 1] AS c2, o_custkey % 4000 - 2000 AS one, o_custkey % 300 AS two, substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 28) AS x FROM orders),
      n AS (SELECT *, list_transform(range(1, 29), lambda i: [(CAST('0x' || substr(x, i, 1) AS BIGINT) + 8) % 16 - 8]) AS nib FROM b),
      d AS (SELECT o_orderkey, list_reduce(list_concat([[two, one]], nib), lambda a, v: list_append(a, least(greatest((v[1] * (1 << (20 - shift)) + c1 * a[-1] + c2 * a[-2]) >> 8, -32768), 32767)))[3:] AS s FROM n)
      SELECT o_orderkey, s[1] AS "first", s[28] AS "last", list_min(s) AS least, list_max(s) AS most, CAST(list_sum(s) AS BIGINT) AS total FROM d""",
    "q51_lz_streams": """
      SELECT o_orderkey, substr(repeat('L' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0'), 300), 1, 4 + o_orderkey % 8 + 3 + o_orderkey % 64 + 4 + o_orderkey % 1000 + 5) || repeat('e', o_orderkey % 4) AS text FROM orders""",
    "q52_half_rgbe": """
      WITH v AS (SELECT vec_id, i, floor(CAST(v AS DOUBLE) * 4096) / 64 AS x FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings)),
      h AS (SELECT *, greatest(CASE WHEN x = 0 THEN 0 ELSE CAST(floor(log2(abs(x))) AS INTEGER) END, -14) AS e, greatest(abs(x), 0.25) AS m FROM v),
      k AS (SELECT *, CAST(round_even(abs(x) / pow(2, e - 10), 0) AS BIGINT) AS u, CAST(floor(log2(m)) AS INTEGER) + 1 AS c FROM h)
      SELECT vec_id, CAST(i AS INTEGER) AS i, CAST(CASE WHEN x = 0 THEN 0 ELSE CASE WHEN x < 0 THEN 32768 ELSE 0 END + (e + 14) * 1024 + u END AS BIGINT) AS half, CASE WHEN x < 0 THEN -1 ELSE 1 END * u * pow(2, e - 10) AS back,
        CAST(floor(abs(x) * pow(2, 8 - c)) AS INTEGER) AS r, CAST(floor(abs(x) / 2 * pow(2, 8 - c)) AS INTEGER) AS g, CAST(floor(0.25 * pow(2, 8 - c)) AS INTEGER) AS b, c + 128 AS e FROM k""",
    "q53_pixel_math": f"""
      WITH p AS (SELECT image_id, (x + 5) % 8 AS x, y % 4 AS y, b AS r, g, r AS b FROM {_pixels(8)})
      SELECT image_id, x, y, CAST(floor(least(greatest(r * 1.5::DOUBLE - 20, 0), 255)) AS INTEGER) AS scaled, 2 * r * b + g * g AS dot, (r - g * 3 + 768) % 256 AS wrapped, CAST(floor(least(greatest((g - 127.5::DOUBLE) * 1.25::DOUBLE + 127.5::DOUBLE, 0), 255)) AS INTEGER) AS contrast,
        CAST(floor((r * 0.3086::DOUBLE + g * 0.6094::DOUBLE + b * 0.0820::DOUBLE) + 0.0000001::DOUBLE) AS BIGINT) AS grey, 4278190080 + r * 65536 + g * 256 + b AS packed, CAST(floor(r / 255.0::DOUBLE * 31 + 0.5::DOUBLE) AS BIGINT) AS five FROM p""",
    "q54_endian": """
      WITH w AS (SELECT o_orderkey, CAST((o_orderkey * 2654435761 + o_custkey * 40503) % 4294967296 AS BIGINT) AS word FROM orders),
      b AS (SELECT *, word // 16777216 AS b0, word // 65536 % 256 AS b1, word // 256 % 256 AS b2, word % 256 AS b3 FROM w)
      SELECT o_orderkey, printf('%08X', word) AS big, printf('%02X%02X%02X%02X', b3, b2, b1, b0) AS little, b3 * 16777216 + b2 * 65536 + b1 * 256 + b0 AS swapped, b3 * 65536 + b2 * 256 + b1 AS three,
        (b0 * 256 + b1 + 32768) % 65536 - 32768 AS signed, (word % 100000 + 32768) % 65536 - 32768 AS wrapped FROM b""",
    "q55_sound_math": f"""
      WITH v AS (SELECT o_orderkey, o_custkey AS n, (o_orderkey % 20000 + 20.0::DOUBLE) / 1000.0::DOUBLE AS k, o_custkey % 400 AS w FROM orders)
      SELECT o_orderkey, (n % 256 - 128) * 256 AS s16, CAST(floor((n % 65536 - 32768) / 256.0::DOUBLE) AS BIGINT) + 128 AS u8, CAST(floor((n * 977 % 16777216 - 8388608) / 256.0::DOUBLE) AS BIGINT) AS s24, round(n * 0.3125::DOUBLE, 6) AS gain, gcd(n, 360) AS gcd,
        list_sort(list_transform({_FULL}, lambda t: [abs(t - w), t]))[1][2] AS nearest, round(13 * atan(0.76::DOUBLE * k) + 3.5::DOUBLE * atan(k * k / 56.25::DOUBLE), 6) AS bark, round(25 + 75 * pow(1 + 1.4::DOUBLE * k * k, 0.69::DOUBLE), 4) AS bandwidth,
        round(3.64::DOUBLE * pow(least(k, 18), -0.8::DOUBLE) - 6.5::DOUBLE * exp(-0.6::DOUBLE * pow(least(k, 18) - 3.3::DOUBLE, 2)) + 0.001::DOUBLE * pow(least(k, 18), 4), 4) AS threshold FROM v""",
    "q56_texture_files": """
      SELECT vec_id AS image_id, ['DXT1', 'DXT3', 'DXT5', 'X8R8G8B8'][vec_id % 4 + 1] AS format, CASE WHEN vec_id % 4 < 3 THEN 4 END AS levels, CASE vec_id % 4 WHEN 0 THEN 128 + 7 * 8 WHEN 1 THEN 128 + 7 * 16 WHEN 2 THEN 128 + 7 * 16 END AS size,
        CASE WHEN vec_id % 4 < 3 THEN '444453207C000000' || '07100A00' || '0800000008000000' END AS head, CASE WHEN vec_id % 4 = 3 THEN 'format X8R8G8B8 isn''t compressed' END AS error FROM embeddings""",
    "q57_total_frames": f"""
      SELECT l_orderkey, CAST(sum(frames) AS BIGINT) AS frames, CAST(sum(size + 4) AS BIGINT) AS bytes, max(rate) AS rate FROM ({_mpeg()}) WHERE valid GROUP BY l_orderkey""",
    "q58_crc": """
      WITH b AS (SELECT o_orderkey, o_orderkey * 2654435761 % 4294967296 AS w FROM orders),
      l AS (SELECT o_orderkey, list_transform(range(0, 32), lambda i: CAST((w >> (31 - i)) & 1 AS BIGINT)) AS bits, list_transform(range(0, 32), lambda i: CAST((w >> (24 - i // 8 * 8 + i % 8)) & 1 AS BIGINT)) AS low_first FROM b)
      SELECT o_orderkey, list_reduce(list_concat([CAST(65535 AS BIGINT)], bits), lambda a, x: CASE WHEN (a >> 15) <> x THEN xor((a * 2) & 65535, 32773) ELSE (a * 2) & 65535 END) AS header,
        list_reduce(list_concat([CAST(0 AS BIGINT)], low_first), lambda a, x: CASE WHEN (a & 1) <> x THEN xor(a >> 1, 40961) ELSE a >> 1 END) AS payload FROM l""",
    "q59_granules": """
      WITH k AS (SELECT o_orderkey AS k, unnest([0, 1]) AS seq FROM orders),
      d AS (SELECT k, seq, md5('s' || k || '-' || seq) AS s, left(repeat(md5('m' || k || '-' || seq), 25), 792) AS m FROM k),
      b AS (SELECT *, list_aggregate(list_transform(range(1, 25), lambda i: lpad(bin(CAST('0x' || s[i] AS INTEGER)), 4, '0')), 'string_agg', '') AS fill,
        list_aggregate(list_transform(range(1, 793), lambda i: lpad(bin(CAST('0x' || m[i] AS INTEGER)), 4, '0')), 'string_agg', '') AS own FROM d),
      p AS (SELECT *, CASE WHEN seq = 1 THEN right(lag(own) OVER (PARTITION BY k ORDER BY seq), CAST(8 * (k % 60 + 1) AS BIGINT)) ELSE '' END || own AS main, k % 1000 + 100 AS l0, k % 1500 + 50 AS l1 FROM b),
      g AS (
        SELECT k, seq, 0 AS granule, '11' || '00' || '11' || '00' || '0' || lpad(bin(l0), 12, '0') || substr(fill, 5, 47) || left(main, l0) AS bits FROM p UNION ALL
        SELECT k, seq, 1, '11' || '00' || '11' || '00' || '1' || left(fill, 4) || lpad(bin(l1), 12, '0') || substr(fill, 50, 47) || substr(main, l0 + 1, l1) FROM p),
      w AS (SELECT *, bits || repeat('0', CAST((8 - length(bits) % 8) % 8 AS BIGINT)) AS padded FROM g),
      h AS (SELECT k, seq, granule, length(padded) // 8 AS size, unhex(list_aggregate(list_transform(range(0, length(padded) // 4),
        lambda i: upper(printf('%x', 8 * CAST(padded[4 * i + 1] AS INTEGER) + 4 * CAST(padded[4 * i + 2] AS INTEGER) + 2 * CAST(padded[4 * i + 3] AS INTEGER) + CAST(padded[4 * i + 4] AS INTEGER)))), 'string_agg', '')) AS data FROM w)
      SELECT k AS o_orderkey, CAST(seq AS BIGINT) AS seq, granule, size, left(hex(data), 48) AS head, md5(data) AS digest, CAST(NULL AS VARCHAR) AS error FROM h""",
    "q60_pcm_blocks": f"""
      SELECT user_id, n // 2048 AS seg, CAST(2 * count(*) + 6 * ((count(*) + 1022) // 1023) AS BIGINT) AS size, least(count(*), 1023) AS first_block,
        CAST(sum(CAST(trunc(least(greatest(value * 50, -32768.0::DOUBLE), 32767.0::DOUBLE)) AS BIGINT)) AS BIGINT) AS total, true AS same FROM {_STREAM} GROUP BY user_id, n // 2048""",
}
