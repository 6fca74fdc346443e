"""Checking SQL of the operators that SQL can express."""

OP3_SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         row_number() OVER () AS rid FROM documents),
words AS (
  SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM base),
windows AS (
  SELECT rid, pos, w[pos] || ' ' || w[pos + 1] || ' ' || w[pos + 2] AS gram
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS pos FROM words)),
twice AS (
  SELECT rid, pos FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT rid, count(DISTINCT place) AS n FROM (SELECT rid, pos + unnest([0, 1, 2]) AS place FROM twice) GROUP BY rid),
lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM base)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT b.rid, doc_id, source AS host, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM base b JOIN words USING (rid) LEFT JOIN covered c USING (rid) LEFT JOIN lines l USING (rid)),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base,
    10 * n_symbols > 3 * n_words AS symbols, 10 * n_dup_lines > 3 * n_lines AS lines,
    word_chars < 2 * n_words OR word_chars > 15 * n_words AS length FROM m),
hosts AS (
  SELECT host, rule, count(*) AS n, sum(CAST(fails AS INT)) AS k
  FROM (SELECT host, unnest(['base', 'symbols', 'lines', 'length']) AS rule,
               unnest([base, symbols, lines, length]) AS fails FROM f WHERE host IS NOT NULL)
  GROUP BY ALL),
moments AS (
  SELECT rule, sum(k) / sum(n) AS mean, count(*) / sum(n) AS per_doc,
         sum(CAST(k AS DOUBLE) * k / n) / sum(n) - (sum(k) / sum(n)) * (sum(k) / sum(n))
         - (sum(k) / sum(n)) * (1 - sum(k) / sum(n)) * count(*) / sum(n) AS variance FROM hosts GROUP BY rule),
prior AS (
  SELECT rule, mean, CASE WHEN variance <= 0 THEN 1000.0
    ELSE least(1000.0, greatest(1.0, mean * (1 - mean) / variance - 1)) END AS weight FROM moments),
bad AS (
  SELECT DISTINCT host FROM hosts JOIN prior USING (rule) WHERE (k + mean * weight) / (n + weight) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base AS base_failed,
  NOT base AND (host IS NULL OR host NOT IN (SELECT host FROM bad)) AS kept
FROM f
"""

# A digest of 160 bits is 8 groups of 20 bits: 5 hex digits, 4 letters of base 32.
OP2_SQL = """
WITH base AS (
  SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
coded AS (
  SELECT page_id, url, octet_length(encode(payload)) AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 +
      ((CAST('0x' || substr(sha1(payload), CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), '')
      AS payload_digest
  FROM base),
firsts AS (
  SELECT payload_digest, max(page_id) AS first FROM coded GROUP BY payload_digest)
SELECT page_id, url, CAST(payload_bytes AS BIGINT) AS payload_bytes, c.payload_digest,
  CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first OR first IS NULL THEN NULL ELSE first END AS refers_to
FROM coded c JOIN firsts f ON c.payload_digest = f.payload_digest
"""

OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""

# crc32 by its definition, bit by bit; digests of a level by one grouping, level by level.
_FRAMED = "coalesce(strlen({0}) || ':' || {0}, '-')"
_HEAD = " || ".join(_FRAMED.format(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", "n_chars"))
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP13_SQL = f"""
WITH RECURSIVE base AS (
  SELECT *, row_number() OVER () AS rid, xor(CAST(list_reduce(
      list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)),
      lambda crc, byte: list_reduce(range(8), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(crc, byte)),
      CAST(4294967295 AS BIGINT)) AS BIGINT), 4294967295) % 5 = 0 AS tampered FROM documents),
leaves AS (
  SELECT rid, doc_id, source, sha256({_HEAD} || {_FRAMED.format('text')}) AS leaf,
    CASE WHEN tampered THEN sha256({_HEAD} || {_FRAMED.format(_LOWERED)}) END AS changed FROM base),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n FROM leaves),
nodes AS (
  SELECT source, 0 AS level, pos, n, leaf AS digest FROM placed
  UNION ALL
  SELECT source, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos))
  FROM nodes WHERE n > 1 GROUP BY source, level, pos // 16, n),
subs AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, pos, n, subroot AS digest FROM subs
  UNION ALL
  SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos))
  FROM tops WHERE n > 1 GROUP BY level, pos // 16, n),
low_steps AS (
  SELECT source, level, pos,
    coalesce(string_agg(digest, '') OVER (PARTITION BY source, level, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(digest, '') OVER (PARTITION BY source, level, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM nodes WHERE n > 1),
high_steps AS (
  SELECT level, pos,
    coalesce(string_agg(digest, '') OVER (PARTITION BY level, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(digest, '') OVER (PARTITION BY level, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM tops WHERE n > 1),
climb AS (
  SELECT rid, source, 0 AS level, pos, n, coalesce(changed, leaf) AS digest, '' AS trail FROM placed
  UNION ALL
  SELECT rid, c.source, c.level + 1, c.pos // 16, (n + 15) // 16, sha256(before || digest || after), trail || before || after
  FROM climb c JOIN low_steps s ON c.source IS NOT DISTINCT FROM s.source AND c.level = s.level AND c.pos = s.pos WHERE n > 1),
climb_on AS (
  SELECT rid, subroot, 0 AS level, s.pos, s.n, digest, trail
  FROM climb c JOIN subs s ON c.source IS NOT DISTINCT FROM s.source WHERE c.n = 1
  UNION ALL
  SELECT rid, subroot, c.level + 1, c.pos // 16, (n + 15) // 16, sha256(before || digest || after), trail || before || after
  FROM climb_on c JOIN high_steps s ON c.level = s.level AND c.pos = s.pos WHERE n > 1)
SELECT doc_id, leaf, subroot, root, sha256(trail) AS proof_sha256, c.digest AS folded_root, c.digest = root AS verified
FROM placed JOIN climb_on c USING (rid) CROSS JOIN (SELECT digest AS root FROM tops WHERE n = 1) WHERE c.n = 1
"""

# Near words share what is left when one letter is taken out of the one, the other or both at the same place.
OP11_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
marked AS (
  SELECT run, xor(CAST(list_reduce(
      list_transform(range(1, strlen(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) + 1),
        lambda i: CAST('0x' || substr(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)), CAST(2 * i - 1 AS INT), 2) AS BIGINT)),
      lambda crc, byte: list_reduce(range(8), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(crc, byte)),
      CAST(4294967295 AS BIGINT)) AS BIGINT), 4294967295) AS h
  FROM runs WHERE length(run) >= 7),
words AS (
  SELECT word, count(*) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word
    FROM marked) WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
cut AS (
  SELECT word, n, i, substr(word, 1, CAST(i AS INT) - 1) || substr(word, CAST(i AS INT) + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i WHERE a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION
  SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, encode(near)) AS near, max(n) AS near_n FROM near GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form,
    CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
chain AS (
  SELECT word, word AS at_word, form AS next FROM formed
  UNION ALL
  SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON c.next = f.word)
SELECT f.word, form, c.at_word AS root, n, n_near, form_n
FROM formed f JOIN chain c ON f.word = c.word AND c.next IS NULL
"""
