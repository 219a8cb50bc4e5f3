"""DuckDB SQL of the queries that SQL can express."""

GRAM_LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}

QUALITY = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
lined AS (SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY i) AS nth,
            coalesce(list_sum(list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: length(x))), 0) AS chars
          FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
by_line AS (SELECT r, count(*) AS n_lines, count(*) FILTER (nth > 1) AS n_dup_lines, coalesce(sum(chars) FILTER (nth > 1), 0) AS dup_line_chars FROM lined GROUP BY r),
tokens AS (SELECT r, generate_subscripts(words, 1) AS i, unnest(words) AS word FROM w),
grams AS (SELECT w.r, n, i, list_aggregate(words[i : i + n - 1], 'string_agg', ' ') AS gram
          FROM w, unnest([5, 6, 7, 8, 9, 10]) AS t(n), unnest(range(1, greatest(len(words) - n + 2, 1))) AS s(i)),
marked AS (SELECT r, n, i, count(*) OVER (PARTITION BY r, n, gram) > 1 AS twice, row_number() OVER (PARTITION BY r, n, gram ORDER BY i) > 1 AS later FROM grams),
hit AS (SELECT DISTINCT r, n, i + k AS i FROM marked, unnest(range(0, n)) AS s(k) WHERE later),
hit5 AS (SELECT DISTINCT r, i + k AS i FROM marked, unnest(range(0, 5)) AS s(k) WHERE twice AND n = 5),
inside AS (SELECT r, {sums} FROM hit JOIN tokens USING (r, i) GROUP BY r),
repeated AS (SELECT r, count(*) AS n_repeat_words FROM hit5 GROUP BY r),
total AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM tokens GROUP BY r),
joined AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(dup_line_chars, 0) AS dup_line_chars,
         coalesce(n_repeat_words, 0) AS n_repeat_words, {fill}
  FROM d LEFT JOIN total USING (r) LEFT JOIN by_line USING (r) LEFT JOIN repeated USING (r) LEFT JOIN inside USING (r)),
failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM joined)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_dup_lines > 30 * n_lines OR 100 * dup_line_chars > 20 * word_chars OR {limits}) AS kept
FROM failed
""".format(
    sums=", ".join(f"coalesce(sum(length(word)) FILTER (n = {n}), 0) AS dup_{n}" for n in GRAM_LIMITS),
    fill=", ".join(f"coalesce(dup_{n}, 0) AS dup_{n}" for n in GRAM_LIMITS),
    limits=" OR ".join(f"100 * dup_{n} > {most} * word_chars" for n, most in GRAM_LIMITS.items()),
)

MIXING = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
               md5('7:' || coalesce(doc_id::VARCHAR, '')) AS place FROM documents),
total AS (SELECT sum(size)::DOUBLE AS words, greatest(1, ceil(sum(size) / 8388608))::BIGINT AS shards, round(sum(size) / 32)::BIGINT AS blocks FROM d),
s AS (SELECT source, size AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM (SELECT source, sum(size)::DOUBLE AS size FROM d GROUP BY source)),
w AS (SELECT *, ([5, 2, 1])[turn % 3 + 1]::DOUBLE AS weight FROM s),
-- each step fills the sources that are above three times their size
fill AS (
  SELECT 0 AS step, []::BIGINT[] AS filled, (SELECT words FROM total) / (SELECT sum(weight) FROM w) AS level
  UNION ALL
  SELECT step + 1, f, ((SELECT words FROM total) - coalesce((SELECT sum(3 * source_size) FROM w WHERE list_contains(f, turn)), 0)) / (SELECT sum(weight) FROM w WHERE NOT list_contains(f, turn))
  FROM (SELECT step, filled, level, (SELECT coalesce(list(turn ORDER BY turn), []) FROM w WHERE 3 * source_size < level * weight OR list_contains(filled, turn)) AS f FROM fill)
  WHERE len(f) > len(filled)),
level AS (SELECT level, filled FROM fill ORDER BY step DESC LIMIT 1),
t AS (SELECT w.*, round(CASE WHEN list_contains(filled, turn) THEN 3 * source_size ELSE level * weight END, 6) AS target FROM w, level),
q AS (SELECT turn, target / (2 * seat + 1) AS quotient, seat FROM t, total, range(0, (SELECT blocks FROM total)) AS r(seat) WHERE target > 0),
won AS (SELECT turn, count(*) AS quota FROM (SELECT turn FROM q ORDER BY quotient DESC, turn, seat LIMIT (SELECT blocks FROM total)) GROUP BY turn),
sharded AS (SELECT d.*, turn, source_size, target, ('0x' || substr(place, 1, 8))::BIGINT % shards AS shard FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, total),
pile AS (SELECT turn, shard, sum(size) AS pile FROM sharded GROUP BY turn, shard),
pq AS (SELECT turn, shard, seat, quota, row_number() OVER (PARTITION BY turn ORDER BY pile / (2 * seat + 1) DESC, shard, seat) AS nth
       FROM pile JOIN won USING (turn), range(0, (SELECT max(quota) FROM won)) AS r(seat) WHERE pile > 0 AND seat < quota),
pwon AS (SELECT turn, shard, count(*) AS quota FROM pq WHERE nth <= quota GROUP BY turn, shard),
wanted AS (SELECT turn, shard, pile, least(coalesce(quota, 0) * 32, 3 * pile)::BIGINT AS wanted FROM pile LEFT JOIN pwon USING (turn, shard)),
placed AS (SELECT *, sum(size) OVER (PARTITION BY turn, shard ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before FROM sharded)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (CASE WHEN pile > 0 THEN wanted // pile * size + greatest(0, least(size, wanted % pile - before)) ELSE 0 END)::BIGINT AS taken
FROM placed JOIN wanted USING (turn, shard)
"""

SUBSTRINGS = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
t AS (SELECT r, generate_subscripts(words, 1) AS i, unnest(words) AS word FROM d),
w AS (SELECT r, i, array_to_string(words[i : i + 34], ' ') AS run FROM d, unnest(range(1, greatest(len(words) - 33, 1))) AS s(i)),
c AS (SELECT run FROM w GROUP BY run HAVING count(*) > 1),
hit AS (SELECT DISTINCT r, i + k AS i FROM (SELECT r, i FROM w SEMI JOIN c USING (run)), unnest(range(0, 35)) AS s(k)),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM t ANTI JOIN hit USING (r, i) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

#: The given pages hold one plain article each; its marks and entities are few enough for patterns.
MAIN_TEXT = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS body FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(regexp_split_to_array(body, '</?(h1|p)>'), lambda x:
        trim(regexp_replace(regexp_replace(replace(regexp_replace(replace(x, '<br>', ' '), '</?b>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM a),
t AS (SELECT page_id, url, array_to_string(blocks, chr(10) || chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t
"""

#: Windows of 400 bytes by their hexadecimal digits; those of equal hash count as equal.
BYTES = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS digits FROM documents),
w AS (SELECT r, i, hash(substr(digits, 2 * i + 1, 800)) AS run FROM d, unnest(range(0, greatest(len(digits) // 2 - 399, 0))) AS s(i)),
hit AS (SELECT r, i FROM w SEMI JOIN (SELECT run FROM w GROUP BY run HAVING count(*) > 1) USING (run)),
-- a removed run begins where no hit begins in the 400 bytes before
begun AS (SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > 400, true) AS opens FROM hit),
runs AS (SELECT r, i, sum(opens::INT) OVER (PARTITION BY r ORDER BY i) AS nth FROM begun),
gone AS (SELECT r, nth, min(i) AS a, max(i) + 400 AS b FROM runs GROUP BY r, nth),
kept AS (SELECT r, string_agg(substr(digits, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last, sum(b - a) AS n_removed, count(*) AS n_spans
         FROM (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM gone) JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(digits) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(digits, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

SQL = {"op6_suffix_array_dedup": BYTES, "op1_quality_rules": QUALITY, "op4_html_main_text": MAIN_TEXT, "op7_mix_sources": MIXING, "op10_substring_dedup": SUBSTRINGS}
