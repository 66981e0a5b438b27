"""DuckDB SQL that gives the rows of the operators' queries, where SQL can express them."""

from __future__ import annotations

from tallyloom.llm.sharding import hilbert_positions

BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"

#: CRC-32 (reflected, polynomial 0xEDB88320) of a text's UTF-8 bytes, by the table of its bytes' remainders.
CRC_STEP = "CASE WHEN {x} & 1 = 1 THEN xor({x} >> 1, 3988292384) ELSE {x} >> 1 END"
CRC_TABLE = "range(256)"
for _ in range(8):
    CRC_TABLE = f"list_transform({CRC_TABLE}, lambda x: {CRC_STEP.format(x='x')})"

SHARDS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS s, coalesce(lang, '') AS l FROM documents),
table_ AS (SELECT {CRC_TABLE} AS crc),
bytes AS (SELECT doc_id, s, l, CAST(strlen(t) AS BIGINT) + 1 AS size, hex(encode(t)) AS h FROM d),
sums AS (SELECT doc_id, s, l, size, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, size - 1), lambda i: CAST('0x' || substr(h, CAST(2*i + 1 AS INTEGER), 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, crc[CAST(xor(c, b) & 255 AS INTEGER) + 1]))) AS text_crc32 FROM bytes, table_),
sources AS (SELECT s, CAST(16 * (sum(n) OVER (ORDER BY s) - n) // sum(n) OVER () AS INTEGER) AS sc FROM (SELECT s, count(*) AS n FROM d GROUP BY s)),
langs AS (SELECT l, CAST(16 * (sum(n) OVER (ORDER BY l) - n) // sum(n) OVER () AS INTEGER) AS lc FROM (SELECT l, count(*) AS n FROM d GROUP BY l)),
celled AS (SELECT doc_id, size, text_crc32, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h,
    {hilbert_positions(3, 4)}[(sc * 16 + lc) * 16 + least(length(bin(size)) - 1, 15) + 1] AS curve FROM sums JOIN sources USING (s) JOIN langs USING (l)),
placed AS (SELECT doc_id, size, text_crc32, curve, h % greatest(256, (count(*) OVER (PARTITION BY curve) + 99999) // 100000) AS salt FROM celled),
numbered AS (SELECT *, row_number() OVER (ORDER BY curve, salt, doc_id NULLS FIRST, size, text_crc32) - 1 AS g, count(*) OVER () AS n FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(g * 8 // n AS INTEGER) AS shard, g - ((g * 8 // n) * n + 7) // 8 AS slot,
  CAST(NULL AS INTEGER) AS grown_shard, CAST(curve AS INTEGER) AS curve FROM numbered
"""

RULES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce('h' || source, '') AS host FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{BLANK}+'), lambda x: x <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
windows AS (SELECT r, i, array_to_string(words[i:i+7], ' ') AS win FROM (SELECT r, words, unnest(range(1, greatest(1, len(words) - 6))) AS i FROM w)),
often AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM windows) WHERE c > 1),
covered AS (SELECT r, sum(least(8, i - p)) AS n FROM (SELECT r, i, lag(i, 1, -8) OVER (PARTITION BY r ORDER BY i) AS p FROM often) GROUP BY r),
plain AS (SELECT r, host, t, unnest(string_split(regexp_replace(translate(lower(t), '123456789' || chr(9) || chr(11) || chr(12) || chr(13), '000000000    '), ' {{2,}}', ' ', 'g'), chr(10))) AS raw FROM d),
line AS (SELECT r, host, t, trim(raw, ' ') AS x FROM plain WHERE trim(raw, ' ') <> ''),
hosts AS (SELECT host, count(DISTINCT t) AS n FROM d GROUP BY 1),
over_ AS (SELECT host, x FROM line JOIN hosts USING (host) GROUP BY host, x, n HAVING count(DISTINCT t) >= 20 AND count(DISTINCT t) > n * 0.1),
removed AS (SELECT r, sum(len(string_split(x, ' '))) AS n FROM line JOIN over_ USING (host, x) GROUP BY r),
f AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{BLANK}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(removed.n, 0) AS BIGINT) AS n_removed_words FROM w LEFT JOIN covered USING (r) LEFT JOIN removed USING (r)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_words - n_removed_words < n_words * 0.3 AS depleted FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT depleted AS kept, n_removed_words, depleted FROM v
"""

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{BLANK}+'), lambda x: x <> '') AS words FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS s FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
reach AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other),
least_ AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN least_ USING (doc_id)
"""

ARCHIVES = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT sha1(h) AS d, max(page_id) AS m FROM p WHERE strlen(h) >= 1000 GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN m <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m <> page_id THEN m END AS refers_to FROM p LEFT JOIN g ON sha1(h) = d
"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

FILTER_AUDIT = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{BLANK}+'), lambda x: x <> '') AS words FROM d),
firsts AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
fails AS (SELECT doc_id, part, (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
    + 4 * (100 * (length(t) - length(translate(t, '{UPPER}', ''))) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > least, false)::INT AS mask FROM w JOIN firsts USING (t)),
told AS (SELECT doc_id, max((coalesce(quality = 1, false))::INT) AS g, max((coalesce(toxic = 1, false))::INT) AS x FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(coalesce(g, 0)) AS good, sum(coalesce(x, 0)) AS toxic FROM fails LEFT JOIN told USING (doc_id) GROUP BY part, mask),
letters AS (SELECT * FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS v(f)),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, s AS step, 1 << (ascii(filter_order[s]) - 65) AS bit,
    coalesce(list_sum(list_transform(range(1, s), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::INT AS before FROM orders, range(1, 6) r(s))
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
  CAST(coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & bit <> 0), 0) AS BIGINT) AS shapley
FROM cells, steps GROUP BY part, filter_order, step, bit, before
"""
