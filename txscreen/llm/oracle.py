"""DuckDB SQL for the queries whose SQL isn't beside the operator."""

from txscreen.llm import quality, sharding
from txscreen.llm.common import LOWER, UPPER

_WORDS = r"'[^\x20\x09-\x0D]+'"
_SPACE = r"'[\x20\x09-\x0D]+'"

JACCARD = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    {_WORDS}) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY x, y),
links AS (
  SELECT x, y FROM shared JOIN sizes a ON x = a.doc_id JOIN sizes b ON y = b.doc_id
  WHERE 100 * shared.n >= 85 * (a.n + b.n - shared.n)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT reached.x, edges.y FROM reached JOIN edges ON reached.y = edges.x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM documents LEFT JOIN sizes USING (doc_id)
JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reached GROUP BY x) USING (doc_id)
"""

# Bytes as pairs of hexadecimal digits.
SUBSTRINGS = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS w
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM texts)),
found AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS r FROM windows),
repeated AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before
  FROM found WHERE r > 1),
numbered AS (
  SELECT doc_id, i, sum((before IS NULL OR i > before + 100)::INT)
    OVER (PARTITION BY doc_id ORDER BY i) AS run FROM repeated),
spans AS (
  SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM numbered GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM spans
  UNION ALL SELECT doc_id, 0, min(a) FROM spans GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, length(h) // 2) - a)), ''
    ORDER BY a) AS h
  FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS n FROM spans GROUP BY doc_id)
SELECT doc_id, length(texts.h) // 2 AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed,
  coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, texts.h))) AS kept_sha256
FROM texts LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

QUALITY = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w, coalesce(text, '') AS text,
    source FROM documents),
lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM words),
placed AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
fives AS (
  SELECT doc_id, i, lead(word, 4) OVER five AS fifth, word || ' ' || lead(word) OVER five || ' '
    || lead(word, 2) OVER five || ' ' || lead(word, 3) OVER five AS four
  FROM placed WINDOW five AS (PARTITION BY doc_id ORDER BY i)),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, four, fifth) AS times
  FROM fives WHERE fifth IS NOT NULL),
repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS p FROM windows WHERE times > 1)
  GROUP BY doc_id),
copies AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines
  WHERE regexp_matches(line, {_WORDS}) GROUP BY doc_id),
normal AS (
  SELECT doc_id, source, regexp_replace(lower(trim(regexp_replace(line, {_SPACE}, ' ', 'g'), ' ')),
    '[0-9]+', '0', 'g') AS line FROM lines),
counted AS (
  SELECT source, line, count(DISTINCT doc_id) AS docs FROM normal WHERE line <> ''
  GROUP BY source, line),
hosts AS (SELECT source, count(*) AS docs FROM documents GROUP BY source),
often AS (
  SELECT counted.source, line FROM counted JOIN hosts
    ON counted.source IS NOT DISTINCT FROM hosts.source
  WHERE counted.docs >= {quality.LINE_DOCS}
    AND counted.docs * 100 >= hosts.docs * {quality.LINE_PERCENT}),
chars AS (
  SELECT doc_id, sum(length(normal.line)) AS line_chars,
    coalesce(sum(length(normal.line)) FILTER (often.line IS NOT NULL), 0) AS boiler_chars
  FROM normal LEFT JOIN often
    ON normal.source IS NOT DISTINCT FROM often.source AND normal.line = often.line
  WHERE normal.line <> '' GROUP BY doc_id),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(text, {_SPACE}, '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(copies.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
    coalesce(line_chars, 0)::BIGINT AS line_chars, coalesce(boiler_chars, 0)::BIGINT AS boiler_chars
  FROM words LEFT JOIN copies USING (doc_id) LEFT JOIN repeats USING (doc_id)
    LEFT JOIN chars USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
    AND 100 * (line_chars - boiler_chars) >= {quality.LEAST_LEFT_PERCENT} * line_chars AS kept
FROM base
"""

# The checksum's table by its rule: eight halvings of each byte by the reflected polynomial.
_HALF = "(CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END)"

_FIELDS = " || ".join(
    f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
    for c in ("doc_id", "source", "lang", "{chars}", "text")
)

MANIFEST = f"""
WITH RECURSIVE entries AS (
  SELECT list(list_reduce(range(0, 8), lambda v, i: {_HALF.format("v")}, b) ORDER BY b) AS entry
  FROM (SELECT unnest(range(0, 256)) AS b)),
summed AS (
  SELECT *, xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''),
      lambda c: ascii(c)::BIGINT),
    lambda v, b: xor(v >> 8, entry[(xor(v, b) & 255) + 1]), 4294967295::BIGINT)) AS crc
  FROM documents, entries),
leaves AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS rank,
    count(*) OVER (PARTITION BY lang) AS n, sha256({_FIELDS.format(chars="n_chars")}) AS leaf,
    sha256({_FIELDS.format(chars="(n_chars + (crc % 7 = 0)::INT)")}) AS given
  FROM summed),
nodes AS (
  SELECT lang, 0 AS level, rank, n, leaf AS h FROM leaves
  UNION ALL
  SELECT lang, any_value(level) + 1, rank // 2, (any_value(n) + 1) // 2,
    sha256(string_agg(h, '' ORDER BY rank))
  FROM nodes WHERE n > 1 GROUP BY lang, rank // 2),
subroots AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, rank, n, h FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, rank // 2, (any_value(n) + 1) // 2,
    sha256(string_agg(h, '' ORDER BY rank))
  FROM tops WHERE n > 1 GROUP BY rank // 2),
climb AS (
  SELECT doc_id, lang, leaf, 0 AS level, rank, n, given AS node, '' AS siblings FROM leaves
  UNION ALL
  SELECT doc_id, c.lang, leaf, c.level + 1, c.rank // 2, (c.n + 1) // 2,
    sha256(CASE WHEN c.rank % 2 = 1 THEN h || node ELSE node || coalesce(h, '') END),
    siblings || coalesce(h, '')
  FROM climb c LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM c.lang
    AND s.level = c.level AND s.rank = xor(c.rank, 1)
  WHERE c.n > 1),
onward AS (
  SELECT doc_id, leaf, h AS subroot, 0 AS level, s.rank, s.n, node, siblings
  FROM climb c JOIN subroots s ON s.lang IS NOT DISTINCT FROM c.lang WHERE c.n = 1
  UNION ALL
  SELECT doc_id, leaf, subroot, c.level + 1, c.rank // 2, (c.n + 1) // 2,
    sha256(CASE WHEN c.rank % 2 = 1 THEN h || node ELSE node || coalesce(h, '') END),
    siblings || coalesce(h, '')
  FROM onward c LEFT JOIN tops s ON s.level = c.level AND s.rank = xor(c.rank, 1)
  WHERE c.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, node AS folded_root,
  node = root AS verified
FROM onward, (SELECT h AS root FROM tops WHERE n = 1) WHERE n = 1
"""

SHARDS = f"""
WITH entries AS (
  SELECT list(list_reduce(range(0, 8), lambda v, i: {_HALF.format("v")}, b) ORDER BY b) AS entry
  FROM (SELECT unnest(range(0, 256)) AS b)),
texts AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS h, text FROM documents),
summed AS (
  SELECT doc_id, source, length(h) // 2 + 1 AS size, xor(4294967295, list_reduce(
    list_transform(regexp_extract_all(h, '..'), lambda p: (
      16 * (instr('0123456789ABCDEF', p[1]) - 1) + instr('0123456789ABCDEF', p[2]) - 1)::BIGINT),
    lambda v, b: xor(v >> 8, entry[(xor(v, b) & 255) + 1]), 4294967295::BIGINT)) AS text_crc32
  FROM texts, entries),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source
      ORDER BY md5('{sharding.SEED}:' || coalesce(doc_id::VARCHAR, '')), doc_id) AS r,
    count(*) OVER (PARTITION BY source) AS n
  FROM summed),
placed AS (
  SELECT *, row_number() OVER (ORDER BY (2 * r - 1) / (2 * n)::DOUBLE,
    source IS NULL, source) - 1 AS g, count(*) OVER () AS rows
  FROM ranked)
SELECT doc_id, source, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law,
  (g * {sharding.SHARDS} // rows)::INT AS shard,
  (g - ((g * {sharding.SHARDS} // rows) * rows + {sharding.SHARDS - 1})
    // {sharding.SHARDS})::BIGINT AS slot,
  NULL::INT AS grown_shard
FROM placed
"""
