"""DuckDB SQL for the queries that it can express, over whole tables."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


OP4 = rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM w, unnest(range(1, len(w) - 1)) AS r(i)),
many AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM tri),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM many WHERE n >= 2) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w),
lin AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS dup FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT w.doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lin USING (doc_id)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  10 * n_symbols > n_words OR (n_lines >= 10 AND 100 * n_dup_lines > 30 * n_lines) OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS soft_failed FROM c),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE base_failed OR soft_failed) AS DOUBLE) AS failed FROM j GROUP BY source),
t AS (SELECT sum(n) AS rows_, sum(failed) AS fails, count(*) AS hosts, sum(failed * failed / n) AS squares FROM h),
m AS (SELECT *, fails / rows_ AS mean, squares / rows_ - (fails / rows_) * (fails / rows_) - (fails / rows_) * (1 - fails / rows_) * hosts / rows_ AS between_ FROM t),
p AS (SELECT mean, CASE WHEN between_ > 0 AND mean > 0 AND mean < 1 THEN greatest(mean * (1 - mean) / between_ - 1, 1.0) ELSE rows_ / hosts END AS weight FROM m),
rate AS (SELECT source, mean, n + weight AS w, (failed + mean * weight) / (n + weight) AS r FROM h, p),
v AS (SELECT source, CASE WHEN r - 2 * sqrt(r * (1 - r) / (w + 1)) > mean + 0.5 * (1 - mean) THEN 'rejected' WHEN r + 2 * sqrt(r * (1 - r) / (w + 1)) < 0.5 * mean THEN 'trusted' ELSE 'ordinary' END AS verdict FROM rate)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT (base_failed OR verdict = 'rejected' OR (soft_failed AND verdict <> 'trusted')) AS kept
FROM j JOIN v ON j.source IS NOT DISTINCT FROM v.source
"""

OP8 = """
WITH lines AS (SELECT doc_id, source, line, i FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
shared AS (SELECT source, trim(line, ' ') AS t, count(DISTINCT doc_id) AS n FROM lines WHERE trim(line, ' ') <> '' GROUP BY 1, 2),
bad AS (SELECT shared.source, t FROM shared JOIN pages ON shared.source IS NOT DISTINCT FROM pages.source WHERE n >= 10 AND pages >= 20 AND n > 0.1 * pages),
marked AS (SELECT doc_id, i, line, EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM lines.source AND bad.t = trim(lines.line, ' ')) AS gone FROM lines)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  CAST(length(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS BIGINT) AS kept_chars,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_ESCAPE = r"""regexp_replace(regexp_replace(replace(text, '\', '\\'), '(<)(<SYS>>|</SYS>>|s>|/s>|\|role\|>|\|text\|>|\|end\|>)', '\1\\\2', 'g'), '(\[)(INST\]|/INST\])', '\1\\\2', 'g')"""

OP9 = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
o AS (SELECT *, lag(role) OVER w AS before, lead(role) OVER w IS NULL AS last FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
v AS (SELECT *, CASE WHEN before IS NULL THEN role NOT IN ('system', 'user') WHEN before = 'user' THEN role <> 'assistant' ELSE role <> 'user' END AS bad,
  length({_ESCAPE}) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 23 + length(role) END AS chars FROM o)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, CAST(count(*) FILTER (WHERE bad) AS BIGINT) AS n_violations,
  count(*) FILTER (WHERE bad) = 0 AND bool_or(last AND role = 'assistant') AS valid
FROM v GROUP BY conv_id
"""

OP7 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)),
b AS (SELECT item_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM (SELECT CAST(item_id AS VARCHAR) AS item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM benchmark)),
win AS (SELECT DISTINCT item_id, least(len(w), 8) AS k, array_to_string(w[i:i + least(len(w), 8) - 1], ' ') AS s FROM b, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS r(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM win),
occ AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM d, ks, unnest(range(1, len(w) - k + 2)) AS r(i)),
hit AS (SELECT doc_id, i, occ.k, item_id FROM occ JOIN win USING (k, s)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP10 = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS s FROM d, unnest(range(1, len(w) - 48)) AS r(i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM win) WHERE m < doc_id),
step AS (SELECT doc_id, p, sum(v) AS v FROM (SELECT doc_id, i AS p, 1 AS v FROM again UNION ALL SELECT doc_id, i + 50, -1 FROM again) GROUP BY doc_id, p),
word AS (SELECT doc_id, p, w[p] AS w FROM d, unnest(range(1, len(w) + 1)) AS r(p)),
kept AS (SELECT word.doc_id, word.p, word.w, coalesce(sum(step.v) OVER (PARTITION BY word.doc_id ORDER BY word.p), 0) = 0 AS keep FROM word LEFT JOIN step ON word.doc_id = step.doc_id AND word.p = step.p)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(count(*) FILTER (WHERE NOT keep) AS BIGINT) AS n_removed, sha256(coalesce(string_agg(kept.w, ' ' ORDER BY p) FILTER (WHERE keep), '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id, d.w
"""

OP2 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 2], ' ')) AS s FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * k >= 90 * (nx.n + ny.n - k)),
both_ AS (SELECT x AS a, y AS b FROM links UNION SELECT y, x FROM links),
reach AS (SELECT a AS node, a AS seen FROM both_ UNION SELECT reach.node, both_.b FROM reach JOIN both_ ON reach.seen = both_.a),
least_ AS (SELECT node, min(seen) AS c FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(least_.c, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_ ON d.doc_id = least_.node
"""

OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, html, octet_length(encode(html)) AS n, sha1(html) AS hex FROM p),
q AS (SELECT *, min(page_id) OVER (PARTITION BY hex, n) AS first FROM h),
five AS (SELECT *, array_to_string(list_transform(range(40), lambda i: right('000' || bin(strpos('0123456789abcdef', substr(hex, i + 1, 1)) - 1), 4)), '') AS bits FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(substr(bits, 5 * k + 1, 1) AS INTEGER) + 8 * CAST(substr(bits, 5 * k + 2, 1) AS INTEGER) + 4 * CAST(substr(bits, 5 * k + 3, 1) AS INTEGER) + 2 * CAST(substr(bits, 5 * k + 4, 1) AS INTEGER) + CAST(substr(bits, 5 * k + 5, 1) AS INTEGER) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM five
"""

ORACLES = {
    "op1_warc": OP1,
    "op2_ngram_jaccard_join": OP2,
    "op4_quality_rules": OP4,
    "op7_benchmark_decontamination": OP7,
    "op8_line_dedup": OP8,
    "op9_chat_formatting": OP9,
    "op10_substring_dedup": OP10,
}
