"""DuckDB SQL for the operators that SQL can express, written from their contracts."""

from __future__ import annotations

from cardinia.llm import mixing, sharding

_CRC = """xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)),
        lambda acc, b: xor(acc >> 8, t[(xor(acc, b) & 255) + 1])), 4294967295)"""
_CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda acc, k: CASE WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END)) AS t"


def repeated_passages(length: int = 400, words: int = 51) -> str:
    """Every window of ``length`` bytes by its md5; windows that occur twice, as merged spans; what is left of each text. Windows of words in that likewise."""
    return f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, b, unnest(range(1, n - {length} + 2)) AS p FROM d WHERE n >= {length}),
h AS (SELECT doc_id, p, md5_number(array_slice(b, p, p + {length - 1})) AS h FROM w),
again AS (SELECT doc_id, p FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
edges AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {length} THEN 0 ELSE 1 END AS starts FROM again),
numbered AS (SELECT doc_id, p, sum(starts) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM edges),
spans AS (SELECT doc_id, k, min(p) AS lo, max(p) + {length - 1} AS hi FROM numbered GROUP BY ALL),
kept AS (
    SELECT s.doc_id, s.k, array_slice(d.b, coalesce(lag(s.hi) OVER (PARTITION BY s.doc_id ORDER BY s.k), 0) + 1, s.lo - 1) AS piece FROM spans AS s JOIN d USING (doc_id)
    UNION ALL
    SELECT d.doc_id, 1000000000, array_slice(d.b, coalesce(max(s.hi), 0) + 1, d.n) FROM d LEFT JOIN spans AS s USING (doc_id) GROUP BY d.doc_id, d.b, d.n
),
joined AS (SELECT doc_id, string_agg(hex(piece), '' ORDER BY k) AS x FROM kept GROUP BY doc_id),
cut AS (SELECT doc_id, sum(hi - lo + 1) AS removed, count(*) AS spans FROM spans GROUP BY doc_id),
texts AS (SELECT b, row_number() OVER () AS c, min(doc_id) AS doc_id FROM d GROUP BY b),
words AS (
    SELECT t.c, k.k, list_filter(string_split(array_to_string(list_transform(regexp_extract_all(hex(k.piece), '..'), lambda x: CASE WHEN x IN ('20', '09', '0A', '0B', '0C', '0D') THEN ' ' ELSE x END), ''), ' '), lambda x: x <> '') AS w
    FROM kept AS k JOIN texts AS t USING (doc_id)
),
windows AS (SELECT c, k, p, md5(array_to_string(w[p:p + {words - 1}], ' ')) AS h FROM (SELECT c, k, w, unnest(range(1, len(w) - {words - 2})) AS p FROM words WHERE len(w) >= {words})),
shared AS (SELECT c, coalesce(p - lag(p) OVER (PARTITION BY c, k ORDER BY p), 0) <> 1 AS begins FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING min(c) < max(c))),
passages AS (SELECT c, count(*) AS passages FROM shared WHERE begins GROUP BY c)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(c.removed, 0) AS BIGINT) AS n_removed, coalesce(c.spans, 0) AS n_spans, sha256(unhex(j.x)) AS kept_sha256, coalesce(c.spans, 0) + coalesce(r.passages, 0) AS n_repeats
FROM d JOIN joined AS j USING (doc_id) LEFT JOIN cut AS c USING (doc_id) JOIN texts AS x USING (b) LEFT JOIN passages AS r ON r.c = x.c
"""


def feistel_shards(shards: int = sharding.SHARDS, seed: str = "shuffle", rounds: int = sharding.ROUNDS, digits: int = sharding.DIGITS) -> str:
    """Row numbers in the order of md5 bucket and id; the Feistel rounds as nested selects; the cycle walk as recursion."""
    prime = sharding.PRIME
    step = "SELECT row, n, m, k, p // m AS l, p % m AS r FROM walk WHERE k = 0 OR p >= n"
    for a, c in sharding.round_keys(seed, rounds):
        step = f"SELECT row, n, m, k, r AS l, (l + ((t + {a}) % {prime}) * ((t + {c}) % {prime}) % {prime} % m) % m AS r FROM (SELECT *, (r * {a} + {c}) % {prime} AS t FROM ({step}))"
    return f"""
WITH RECURSIVE tab AS ({_CRC_TABLE}),
base AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size, {_CRC} AS crc FROM documents, tab),
numbered AS (
    SELECT *, row_number() OVER (ORDER BY substr(md5(concat_ws('/', coalesce(CAST(doc_id AS VARCHAR), ''), size, crc)), 1, {digits}), doc_id NULLS FIRST, size, crc) - 1 AS row, count(*) OVER () AS n FROM base
),
walk(row, n, m, k, p) AS (
    SELECT row, n, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1, 0, row FROM numbered
    UNION ALL
    SELECT row, n, m, k + 1, l * m + r FROM ({step})
),
placed AS (SELECT row, p FROM walk WHERE k > 0 AND p < n)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, CAST(p % {shards} AS INTEGER) AS shard, p // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM numbered JOIN placed USING (row)
"""


def mixture(block: int = mixing.BLOCK) -> str:
    """Water level, golden-ratio schedule and blocks, with window functions over whole tables."""
    points, width = mixing.POINTS, mixing.CAP
    weights = list(mixing.WEIGHTS)
    return f"""
WITH sized AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS words FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM by_source),
weighed AS (SELECT *, {weights}[rank % {len(weights)} + 1] AS w, words * {mixing.CAP} AS cap, CAST(sum(words) OVER () AS DOUBLE) * {mixing.SHARE} AS total, sum({weights}[rank % {len(weights)} + 1]) OVER () AS all_w FROM ranked),
levels AS (
    SELECT *, (total - coalesce(sum(cap) OVER before, 0)) / (all_w - coalesce(sum(w) OVER before, 0)) AS here FROM weighed
    WINDOW before AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
targets AS (SELECT rank, source, words, total, least(CAST(cap AS DOUBLE), max(here) OVER () * w) AS target FROM levels),
ends AS (SELECT *, sum(target) OVER (ORDER BY rank) AS upto FROM targets),
circle AS (SELECT *, CASE WHEN upto >= total * (1 - 1e-12) THEN {points} ELSE least({points}, CAST(round(upto / total * {points}) AS BIGINT)) END AS hi FROM ends),
owners AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY rank), 0) AS lo, greatest(1, (words + {block - 1}) // {block}) AS blocks FROM circle),
slots AS (SELECT range AS t, range % {points} * {mixing.GOLDEN} % {points} AS u FROM range(CAST(ceil((SELECT max(total) FROM targets) / {block}) AS BIGINT))),
turns AS (SELECT o.rank, o.blocks, row_number() OVER (PARTITION BY o.rank ORDER BY s.t) - 1 AS turn FROM slots AS s JOIN owners AS o ON s.u >= o.lo AND s.u < o.hi),
times AS (SELECT rank, turn % blocks AS block, count(*) AS times FROM turns WHERE turn // blocks < {width} GROUP BY ALL),
laid AS (
    SELECT s.*, o.rank, o.words, o.target, coalesce(sum(s.size) OVER (PARTITION BY o.rank ORDER BY md5(concat_ws('/', coalesce(CAST(s.doc_id AS VARCHAR), ''), s.size)), s.doc_id NULLS FIRST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
           row_number() OVER () AS line
    FROM sized AS s JOIN owners AS o ON s.source IS NOT DISTINCT FROM o.source
),
pieces AS (SELECT line, rank, start, size, unnest(range(CAST(start // {block} AS BIGINT), CAST((start + size - 1) // {block} + 1 AS BIGINT))) AS block FROM laid WHERE size > 0),
taken AS (
    SELECT p.line, sum((least(p.start + p.size, (p.block + 1) * {block}) - greatest(p.start, p.block * {block})) * coalesce(x.times, 0)) AS taken
    FROM pieces AS p LEFT JOIN times AS x ON x.rank = p.rank AND x.block = p.block GROUP BY p.line
)
SELECT l.doc_id, l.size, l.words AS source_size, l.target, CAST(coalesce(t.taken, 0) AS BIGINT) AS taken, l.source FROM laid AS l LEFT JOIN taken AS t USING (line)
"""


def jaccard_components(width: int = 5) -> str:
    """All pairs of documents that share a shingle, their exact similarity, and reachability by recursion."""
    return f"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
),
shingles AS (
    SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i:i + {width - 1}], ' ')) END) AS s FROM words
    )
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM shingles AS a JOIN shingles AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes AS x ON x.doc_id = a JOIN sizes AS y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
steps AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM words UNION SELECT r.doc_id, s.b FROM reach AS r JOIN steps AS s ON s.a = r.other)
SELECT r.doc_id, coalesce(any_value(z.n), 0) AS n_shingles, min(r.other) AS component_id FROM reach AS r LEFT JOIN sizes AS z ON z.doc_id = r.doc_id GROUP BY r.doc_id
"""
