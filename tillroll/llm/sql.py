"""DuckDB twins of the queries that SQL can express."""

LINE_QUALITY = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
words AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
triples AS (SELECT r, i, x, lead(x, 1) OVER (PARTITION BY r ORDER BY i) AS y, lead(x, 2) OVER (PARTITION BY r ORDER BY i) AS z FROM words),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, x, y, z) AS n FROM triples WHERE z IS NOT NULL),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE n > 1) GROUP BY r),
lines AS (SELECT r, l, count(*) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r, l),
line_facts AS (SELECT r, n, length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')) AS chars, l,
    regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS lw, length(l) - length(translate(l, '#*$%&|<>', '')) AS symbols FROM lines),
line_sums AS (SELECT r, sum(n - 1) AS dups, sum(CASE WHEN
      (len(list_filter(lw, lambda v: v IN ('|', '>', '»', '·'))) = 0 OR len(list_filter(lw, lambda v: v IN ('|', '>', '»', '·'))) * 5 < len(lw))
      AND symbols * 10 <= length(l) AND length(l) - length(replace(l, '!!', '')) < 4
      AND NOT regexp_matches(lower(l), '(lorem ipsum|javascript|cookie|privacy policy|terms of use|terms of service|all rights reserved|licensed under|copyright|subscribe|sign up|click here)')
      AND (len(lw) >= 4 OR regexp_matches(l, '[.!?…。！？:;"''”’»)\]][\x20\x09-\x0D]*\z'))
    THEN chars ELSE 0 END) AS kept_chars FROM line_facts GROUP BY r),
facts AS (SELECT d.r, doc_id, len(w.w) AS n_words, length(array_to_string(w.w, '')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
    coalesce(dups, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, coalesce(kept_chars, 0) AS kept_chars
  FROM d JOIN w USING (r) LEFT JOIN covered USING (r) LEFT JOIN line_sums USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND (word_chars - kept_chars) * 100 <= word_chars * 50 AS kept
FROM facts"""

DECONTAMINATE = r"""
WITH texts AS (SELECT DISTINCT 'd' AS kind, doc_id AS id, coalesce(text, '') AS t FROM documents UNION ALL SELECT DISTINCT 'i', item_id, coalesce(text, '') FROM benchmark),
w AS (SELECT row_number() OVER () AS r, kind, id, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS w FROM texts),
words AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w WHERE len(w) >= 5),
windows AS (SELECT r, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS s FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
shingles AS (SELECT DISTINCT r, s FROM windows WHERE s IS NOT NULL UNION SELECT r, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4
  UNION SELECT r, array_to_string(w[i:i + k - 1], ' ') FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT DISTINCT len(w) AS k FROM w WHERE kind = 'i' AND len(w) BETWEEN 1 AND 4) WHERE kind = 'd')),
items AS (SELECT r, id AS item_id, count(*) AS n FROM shingles JOIN w USING (r) WHERE kind = 'i' GROUP BY r, id),
found AS (SELECT d.r, i.r AS ir, count(*) AS n_found FROM shingles i JOIN items ON items.r = i.r JOIN shingles d ON d.s = i.s JOIN w ON w.r = d.r AND w.kind = 'd' GROUP BY d.r, i.r)
SELECT w.id AS doc_id, item_id, CAST(n AS BIGINT) AS n_item_shingles, CAST(n_found AS BIGINT) AS n_found
FROM found JOIN items ON items.r = found.ir JOIN w ON w.r = found.r WHERE n_found * 100 >= n * 80"""

CHAT = r"""
WITH rows_ AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
esc AS (SELECT *, replace(replace(replace(replace(replace(replace(replace(t, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>') AS et,
  replace(replace(replace(replace(replace(replace(replace(replace(r, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>'), chr(10), '\' || chr(10)) AS er FROM rows_)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(CASE r WHEN 'user' THEN length(et) + 15 WHEN 'assistant' THEN length(et) + 6 ELSE length(er) + 1 + length(et) + 15 END) AS BIGINT) AS formatted_chars
FROM esc GROUP BY conv_id"""

REPEATS = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT r, doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
stretches AS (SELECT r, doc_id, i, string_agg(x, ' ') OVER o AS s, count(*) OVER o AS n FROM words WINDOW o AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
firsts AS (SELECT s, min(doc_id) AS m FROM stretches WHERE n = 13 GROUP BY s),
covered AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS i FROM stretches JOIN firsts USING (s) WHERE n = 13 AND m < doc_id),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS k, count(*) AS n FROM words ANTI JOIN covered USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""

JACCARD = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d WHERE len(w) >= 3),
triples AS (SELECT r, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o AS s FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
shingles AS (SELECT DISTINCT r, s FROM triples WHERE s IS NOT NULL UNION ALL SELECT r, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
common AS (SELECT a.r AS p, b.r AS q, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r),
half AS (SELECT p, q FROM common JOIN sizes x ON x.r = p JOIN sizes y ON y.r = q WHERE 100 * c >= 90 * (x.n + y.n - c)),
links AS (SELECT p, q FROM half UNION ALL SELECT q, p FROM half),
reached AS (SELECT r AS p, r AS q FROM d UNION SELECT reached.p, links.q FROM reached JOIN links ON links.p = reached.q),
least_ AS (SELECT p, min(doc_id) AS component_id FROM reached JOIN d ON d.r = q GROUP BY p)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM d JOIN least_ ON least_.p = d.r LEFT JOIN sizes USING (r)"""

HARD_NEGATIVES = r"""
WITH e AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.id AS a, e.id AS b, a.l = e.l AS same, CAST(list_inner_product(a.v, e.v) AS BIGINT) AS s FROM e a JOIN e ON a.id <> e.id WHERE a.id % 50 = 0),
pos AS (SELECT a, b, s FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT pos.a AS anchor_id, pos.b AS positive_id, CAST(row_number() OVER (PARTITION BY pos.a, pos.b ORDER BY n.s DESC, n.b) AS INTEGER) AS rank, n.b AS negative_id, pos.s AS positive_score, n.s AS negative_score
FROM pos JOIN pairs n ON n.a = pos.a AND NOT n.same AND 50 * pos.s <= 100 * n.s AND 100 * n.s <= 95 * pos.s
QUALIFY row_number() OVER (PARTITION BY pos.a, pos.b ORDER BY n.s DESC, n.b) <= 3"""

MIX = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
run AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, size, r) AS upto FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS z, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM d GROUP BY source),
w AS (SELECT *, CASE turn % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s),
f AS (SELECT *, sum(z) OVER () AS every, coalesce(sum(z) OVER (ORDER BY z / w, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
  sum(w) OVER (ORDER BY z / w, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
g AS (SELECT *, z * 2.0::DOUBLE * rest <= w * (every * 1.5::DOUBLE - spent * 2.0::DOUBLE) AS stopped FROM f),
t AS (SELECT source, z, turn % 3 AS turn, CASE WHEN stopped THEN z * 2.0::DOUBLE ELSE w * (every * 1.5::DOUBLE - 2.0::DOUBLE * sum(CASE WHEN stopped THEN z ELSE 0 END) OVER ()) / sum(CASE WHEN stopped THEN 0 ELSE w END) OVER () END AS target FROM g),
t2 AS (SELECT source, z, turn, CASE WHEN isnan(target) THEN 0 ELSE target END AS target FROM t),
p AS (SELECT doc_id, size, z, turn, target, list_filter([upto - size / 2.0::DOUBLE, z + (upto - size / 2.0::DOUBLE)], lambda c: c < target) AS c FROM run JOIN t2 ON run.source IS NOT DISTINCT FROM t2.source),
q AS (SELECT *, list_transform(c, lambda x: CASE turn WHEN 0 THEN 2 * (x / target) / (1.5 + sqrt(2.25 - 2 * (x / target))) WHEN 1 THEN x / target
  ELSE CASE WHEN x / target * 1.0625 <= 0.3125 THEN 2 * (x / target * 1.0625) / (0.5 + sqrt(0.25 + x / target * 1.0625)) ELSE 0.5 + 2 * (x / target * 1.0625 - 0.3125) / (0.75 + sqrt(0.5625 + 6 * (x / target * 1.0625 - 0.3125))) END END) AS times FROM p)
SELECT doc_id, size, z AS source_size, target, size * len(c) AS taken, round(times[1], 6) AS first_position, round(times[-1], 6) AS last_position FROM q"""

SEARCH = r"""
WITH texts AS (SELECT row_number() OVER () AS r, 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT row_number() OVER (), 'i', item_id, text FROM benchmark),
words AS (SELECT kind, r, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{0}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) AS t FROM texts WHERE text IS NOT NULL),
lengths AS (SELECT r, count(*) AS n FROM words WHERE kind = 'd' GROUP BY r),
totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths),
tf AS (SELECT r, id, t, count(*) AS tf FROM words WHERE kind = 'd' GROUP BY r, id, t),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, totals GROUP BY t, n_docs),
asked AS (SELECT DISTINCT r AS item, id AS item_id, t FROM words WHERE kind = 'i'),
scores AS (SELECT item, item_id, tf.r, tf.id AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (t) JOIN weights USING (t) JOIN lengths ON lengths.r = tf.r, totals GROUP BY item, item_id, tf.r, tf.id)
SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0 WINDOW o AS (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, r) QUALIFY row_number() OVER o <= 50"""
