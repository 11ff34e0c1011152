"""SQL for DuckDB that states each query's result plainly, without its method."""

from __future__ import annotations

SQL: dict[str, str] = {}

_WORDS = r"list_filter(regexp_split_to_array(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

SQL["op1_line_dedup"] = r"""
WITH physical AS (
  SELECT doc_id, j, unnest(p) AS part, unnest(range(1, len(p) + 1)) AS k, len(p) AS parts
  FROM (SELECT doc_id, j, string_split(replace(ls[j], '. ', '.' || chr(10)), chr(10)) AS p
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS j FROM documents))
), lines AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY j, k) AS i, part, CASE WHEN k = parts THEN chr(10) ELSE ' ' END AS sep,
         CAST('0x' || substr(md5(part), 1, 8) AS BIGINT) AS h
  FROM physical
), rolled AS (
  SELECT *, (h + 31 * coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0)) % 4294967296 AS r FROM lines
), cut AS (
  SELECT *, i = 1 OR coalesce(lag(r) OVER w < lag(r, 2) OVER w AND lag(r) OVER w <= r, false) AS begins
  FROM rolled WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM cut
), chunks AS (
  SELECT doc_id, c, string_agg(part || sep, '' ORDER BY i) AS full_text, string_agg(part, chr(10) ORDER BY i) AS chunk, count(*) AS n
  FROM numbered GROUP BY doc_id, c
), judged AS (
  SELECT *, n > 1 AND length(chunk) >= 40 AND row_number() OVER (PARTITION BY chunk, n > 1 AND length(chunk) >= 40 ORDER BY doc_id, c) > 1 AS gone FROM chunks
)
SELECT doc_id, coalesce(left(string_agg(full_text, '' ORDER BY c) FILTER (WHERE NOT gone), -1), '') AS text,
       CAST(sum(n) AS BIGINT) AS n_lines,
       CAST(coalesce(sum(n) FILTER (WHERE gone), 0) AS BIGINT) AS n_lines_removed,
       CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_chunks_removed
FROM judged GROUP BY doc_id
"""

SQL["op2_mix_sources"] = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len({_WORDS.format('text')}) AS BIGINT) AS size,
         CAST('0x' || substr(md5(concat_ws(':', CAST(doc_id AS VARCHAR), coalesce(text, ''))), 1, 13) AS BIGINT) AS hash
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5.0, 2.0, 1.0][(nth - 1) % 3 + 1]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM sources
), levels AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed
), plan AS (
  SELECT source, source_size, least(cap, w * (SELECT min_by(level, k) FROM levels WHERE level * w <= cap)) AS target FROM levels
), budget AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS rounds,
         target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS budget FROM plan
), run AS (
  SELECT d.doc_id, d.source, d.size, b.source_size, b.target, b.rounds, b.budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.hash) AS tied
  FROM sized d JOIN budget b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, source, size, source_size, target,
  CAST(size * (rounds + CASE WHEN upto <= budget OR (upto - tied <= budget AND upto - budget < budget - (upto - tied)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM run
"""

SQL["op4_minhash_near_dedup"] = rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM worded
), sized AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM shingled),
one AS (SELECT doc_id, unnest(s) AS x FROM shingled),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.x = b.x AND a.doc_id <> b.doc_id
  JOIN sized m ON m.doc_id = a.doc_id JOIN sized n ON n.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, m.n, n.n HAVING 100 * count(*) >= 75 * (m.n + n.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT s.doc_id, s.n AS n_shingles, min(r.b) AS component_id, min(r.b) = s.doc_id AS kept
FROM sized s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.n
"""

_JUDGED = rf"""
WITH labelled AS (
  SELECT doc_id, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id
), few AS (
  SELECT * FROM labelled WHERE CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT)
    < CAST(trunc(least(1.0::DOUBLE, 20000.0::DOUBLE / (SELECT count(*) FROM labelled)) * 4294967296.0::DOUBLE) AS BIGINT)
), once AS (
  SELECT text, max(toxic) AS toxic FROM documents JOIN few USING (doc_id) WHERE text IS NOT NULL GROUP BY text
), totals AS (SELECT count(*) AS n, sum(toxic) AS t FROM once
), said AS (
  SELECT toxic, unnest(list_distinct(list_transform({_WORDS.format('text')}, lambda x: trim(lower(x), '.,;:!?"''()')))) AS word FROM once
), counted AS (SELECT word, sum(toxic) AS t, sum(1 - toxic) AS o FROM said WHERE word <> '' GROUP BY word
), vocabulary AS (
  SELECT word FROM counted, totals WHERE counted.t >= 5 AND counted.t >= 0.01::DOUBLE * totals.t
    AND counted.t * greatest(n - totals.t, 1)::DOUBLE >= 50.0::DOUBLE * totals.t * (o + 1) ORDER BY counted.t DESC, word LIMIT 1000
), worded AS (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format('text')} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM worded)
), hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM windows) WHERE n > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM hit) GROUP BY doc_id
), stutter AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN 0 ELSE len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) END AS n FROM worded
), insults AS (
  SELECT doc_id, count(*) AS n FROM (SELECT doc_id, trim(lower(unnest(w)), '.,;:!?"''()') AS word FROM worded) WHERE word IN (SELECT word FROM vocabulary) GROUP BY doc_id
), facts AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    len(ls) AS n_lines, len(regexp_extract_all(text, '[A-Z]')) AS n_upper,
    (length(text) - length(replace(text, '!!', ''))) // 2 AS n_shouts, length(text) - length(replace(text, chr(65533), '')) AS n_broken,
    CAST(coalesce(x.n, 0) AS BIGINT) AS n_toxic, s.n AS n_stutters
  FROM worded d LEFT JOIN repeats r ON r.doc_id = d.doc_id JOIN stutter s ON s.doc_id = d.doc_id LEFT JOIN insults x ON x.doc_id = d.doc_id
), judged AS (
  SELECT *, n_words < 20 AS r0, 100 * n_repeat_words > 30 * n_words AS r1, 100 * n_dup_lines > 30 * n_lines AND n_dup_lines > 1 AS r2,
    100 * n_symbols > 10 * n_words AS r3, word_chars < 2 * n_words OR word_chars > 15 * n_words AS r4, 100 * n_upper > 40 * word_chars AS r5,
    100 * n_shouts > 20 * n_words AND n_words > 0 AS r6, 1000 * n_broken > word_chars AS r7, n_toxic >= 2 AS r8, 100 * n_stutters > 20 * n_words AS r9
  FROM facts
)
"""

SQL["op9_quality_rules"] = (
    _JUDGED
    + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r0 OR r1 AS base_failed,
  NOT (r0 OR r1 OR r2 OR r3 OR r4 OR r5 OR r6 OR r7 OR r8 OR r9) AS kept, n_toxic,
  CAST(r0::INT + 2 * r1::INT + 4 * r2::INT + 8 * r3::INT + 16 * r4::INT + 32 * r5::INT + 64 * r6::INT + 128 * r7::INT + 256 * r8::INT + 512 * r9::INT AS BIGINT) AS failed_bits
FROM judged
"""
)

_RULES = ("few_words", "repeated_windows", "repeated_lines", "symbols", "word_length", "capitals", "shouting", "broken_characters", "toxic", "stutters")
_OTHERS = "(" + " + ".join(f"r{i}::INT" for i in range(10)) + ")"
SQL["op9_rule_ablation"] = _JUDGED + " UNION ALL ".join(
    f"SELECT '{name}' AS rule, count(*) FILTER (r{i}) AS n_failed, count(*) FILTER (r{i} AND {_OTHERS} = 1) AS n_only_this, "
    f"count(*) FILTER ({_OTHERS} - r{i}::INT = 0) AS n_pass_without FROM judged"
    for i, name in enumerate(_RULES)
)

SQL["op8_exact_top_k"] = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 10
"""

#: The table's turns with the calls and results that the query makes from them.
SQL["op6_chat_format"] = """
WITH asked AS (
  SELECT *, conv_id + turn AS n, CASE WHEN (conv_id + turn) % 17 = 0 THEN 'erase' WHEN (conv_id + turn) % 2 = 0 THEN 'find' ELSE 'count' END AS tool,
    CASE WHEN (conv_id + turn) % 7 = 0 THEN '"' || length(text) || '"' ELSE CAST(length(text) AS VARCHAR) END AS given FROM conversations WHERE role = 'assistant'
), calls AS (
  SELECT conv_id, turn * 4 - 2 AS turn, role, 'call_' || turn AS id,
    '{"content":null,"role":"assistant","tool_calls":[{"arguments":{' || CASE WHEN n % 3 = 0 THEN '' ELSE '"conversation":' || conv_id || ',' END
      || '"n_chars":' || given || ',"turn":' || turn || '},"id":"call_' || turn || '","name":"' || tool || '"}]}' AS message,
    CASE WHEN tool = 'erase' THEN 'no tool erase'
      WHEN tool = 'find' AND n % 3 = 0 THEN 'arguments lacks conversation'
      WHEN tool = 'find' AND n % 7 = 0 THEN 'arguments.n_chars is no integer or null'
      WHEN tool = 'count' AND n % 7 = 0 THEN 'arguments.n_chars is no integer'
      WHEN tool = 'count' AND length(text) < 40 THEN 'arguments.n_chars is below 40' END AS why FROM asked
), results AS (
  SELECT conv_id, CASE WHEN n % 5 = 0 THEN turn * 4 - 3 ELSE turn * 4 - 1 END AS turn, CASE WHEN n % 13 = 0 THEN 'lost_' ELSE 'call_' END || turn AS id,
    '{"content":' || length(text) || ',"role":"tool","tool_call_id":"' || CASE WHEN n % 13 = 0 THEN 'lost_' ELSE 'call_' END || turn || '"}' AS message
  FROM asked WHERE n % 11 <> 0
), linked AS (
  SELECT conv_id, id, min(turn) AS call_turn FROM calls SEMI JOIN results USING (conv_id, id) GROUP BY conv_id, id
), every AS (
  SELECT conv_id, turn * 4 AS turn, role, '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":' || CAST(to_json(role) AS VARCHAR) || '}' AS message,
    0 AS n_calls, 0 AS n_linked, CAST(NULL AS VARCHAR) AS problem, turn * 4 AS spot, 0 AS late FROM conversations
  UNION ALL
  SELECT c.conv_id, turn, role, message, 1, CASE WHEN l.id IS NULL THEN 0 ELSE 1 END, coalesce(why, CASE WHEN l.id IS NULL THEN 'a call without result' END), turn, 0
  FROM calls c LEFT JOIN linked l ON l.conv_id = c.conv_id AND l.id = c.id
  UNION ALL
  SELECT r.conv_id, turn, 'tool', message, 0, CASE WHEN l.id IS NULL THEN 0 ELSE 1 END, CASE WHEN l.id IS NULL THEN 'no call of this result' END,
    CASE WHEN call_turn > turn THEN call_turn ELSE turn END, CASE WHEN call_turn > turn THEN 1 ELSE 0 END
  FROM results r LEFT JOIN linked l ON l.conv_id = r.conv_id AND l.id = r.id
)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY spot, late, turn, role, message) - 1 AS BIGINT) AS position, turn, role, message,
  CAST(n_calls AS BIGINT) AS n_calls, CAST(n_linked AS BIGINT) AS n_linked, problem FROM every
"""
