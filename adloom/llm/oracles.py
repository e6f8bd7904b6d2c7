"""Reference SQL (DuckDB) of the operators that SQL can express on whole tables."""

from __future__ import annotations

# The table of the reflected CRC-32 polynomial, as a list.
CRC = """
bits AS (
  SELECT i AS byte, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8)"""


def crc32(text: str) -> str:
    """SQL of the unsigned CRC-32 of a text; the table ``crc`` must be among those read."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    folded = f"list_reduce({octets}, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT)"
    return f"(CASE WHEN {text} = '' THEN 0 ELSE xor(4294967295, {folded}) END)"


WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

RUNS = f"""
WITH RECURSIVE {CRC},
split AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w, {crc32("doc_id::VARCHAR")} AS h FROM documents, crc),
placed AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM split),
sized AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM placed),
edited AS (
  SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE
    list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS w
  FROM sized),
words AS (SELECT r, n, unnest(w) AS word, unnest(range(n)) AS i FROM edited),
equal AS (
  SELECT x.r, y.i - x.i AS q, x.i, x.i - row_number() OVER (PARTITION BY x.r, y.i - x.i ORDER BY x.i) AS island
  FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
stretches AS (SELECT r, q, min(i) AS s, count(*) + q AS l FROM equal GROUP BY r, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS (SELECT r, s, l, min(q) AS q FROM stretches GROUP BY r, s, l),
summary AS (
  SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY r),
best AS (
  SELECT * FROM runs x
  WHERE NOT EXISTS (SELECT 1 FROM runs y WHERE y.r = x.r AND (y.l * x.q > x.l * y.q OR (y.l * x.q = x.l * y.q AND (y.s, y.q) < (x.s, x.q))))),
kept AS (
  SELECT w.r, string_agg(word, ' ' ORDER BY i) AS text FROM words w
  WHERE NOT EXISTS (SELECT 1 FROM runs x WHERE x.r = w.r AND w.i >= x.s + x.q AND w.i < x.s + x.l) GROUP BY w.r)
SELECT e.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.l::BIGINT AS length, b.q::BIGINT AS period,
  (b.l * 1000 // b.q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM edited e LEFT JOIN summary USING (r) LEFT JOIN best b USING (r) LEFT JOIN kept k USING (r)"""

SHARDS = f"""
WITH RECURSIVE {CRC},
keyed AS (
  SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size,
    ('0x' || md5('=' || coalesce(text, ''))[1:15])::BIGINT AS k1,
    ('0x' || md5(coalesce('=' || doc_id, '-') || chr(10) || '=' || coalesce(text, ''))[1:15])::BIGINT AS k2
  FROM documents),
placed AS (SELECT *, row_number() OVER (ORDER BY k1, k2) - 1 AS pos FROM keyed),
summed AS (SELECT *, sum(size) OVER (ORDER BY pos) - size AS below FROM placed),
bounds AS (SELECT pos, below FROM summed UNION ALL SELECT count(*), sum(size) FROM placed HAVING count(*) > 0),
targets AS (SELECT i, i * sum(size) / 16.0 AS target FROM placed, range(1, 16) t(i) GROUP BY i),
around AS (
  SELECT i, target, max(below) FILTER (below <= target) AS lo, max(pos) FILTER (below <= target) AS lo_at,
    min(below) FILTER (below > target) AS hi, min(pos) FILTER (below > target) AS hi_at
  FROM targets, bounds GROUP BY i, target),
cuts AS (SELECT CASE WHEN target - lo <= hi - target THEN lo_at ELSE hi_at END AS cut FROM around),
dealt AS (SELECT s.*, count(cut) AS shard, coalesce(max(cut), 0) AS first FROM summed s LEFT JOIN cuts ON cut <= pos GROUP BY ALL)
SELECT doc_id, size::BIGINT AS size, {crc32("text")}::BIGINT AS text_crc32, 'bytes' AS law, shard::INT AS shard,
  (pos - first)::BIGINT AS slot, NULL::INT AS grown_shard
FROM dealt, crc"""


TRIE = f"""
WITH RECURSIVE {CRC},
turns AS (
  SELECT conv_id AS c, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
    len({WORDS}) AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL),
lengths AS (SELECT c, count(*) AS n FROM turns GROUP BY c),
plans AS (SELECT l.c, l.c - l.c % 20 AS b, {crc32("l.c::VARCHAR")} % 4 AS h FROM lengths l, crc),
shared AS (SELECT p.*, least(h, coalesce(l.n, 0)) AS m FROM plans p LEFT JOIN lengths l ON l.c = p.b),
rebuilt AS (
  SELECT s.c, t.p, t.k, t.w FROM shared s JOIN turns t ON t.c = s.b AND t.p < s.h
  UNION ALL SELECT s.c, t.p - s.h + s.m, t.k, t.w FROM shared s JOIN turns t ON t.c = s.c AND t.p >= s.h),
paths AS (
  SELECT s.c, coalesce(list(k ORDER BY p) FILTER (k IS NOT NULL), []) AS path, coalesce(list(w ORDER BY p) FILTER (k IS NOT NULL), []) AS ws
  FROM shared s LEFT JOIN rebuilt r ON r.c = s.c GROUP BY s.c),
prefixes AS (SELECT c, d, path[1:d] AS node, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w, d = len(path) AS ended FROM paths, unnest(range(len(path) + 1)) t(d)),
nodes AS (
  SELECT node, d, any_value(w) AS w, min(c) AS c, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ended), '') AS ends
  FROM prefixes GROUP BY node, d),
above AS (SELECT node[1:k] AS top, d - k AS down, n, w, node FROM nodes, unnest(range(d + 1)) t(k)),
inner_nodes AS (SELECT DISTINCT top AS node FROM above WHERE down = 1),
sums AS (
  SELECT top AS node, count(*) FILTER (down = 1) AS children, count(*) FILTER (i.node IS NULL) AS leaves, sum((n - 1) * w) AS saved
  FROM above a LEFT JOIN inner_nodes i ON i.node = a.node GROUP BY top)
SELECT x.c AS conv_id, x.d::BIGINT AS depth, p.c AS parent_conv_id, x.n::BIGINT AS n_convs, s.children::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves,
  s.saved::BIGINT AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM nodes x JOIN sums s ON s.node = x.node LEFT JOIN nodes p ON x.d > 0 AND p.node = x.node[1:x.d - 1]"""


def oracle_sql() -> dict[str, str]:
    return {"op11_truncation_peeling": TRIE, "op12_internal_matching": RUNS, "op13_histogram_sort": SHARDS}
