"""DuckDB SQL with the same result as the registered query of the same name."""

from __future__ import annotations

from mirrorframe.llm.slots import SLOTS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES = {}

ORACLES["op1_decontamination"] = rf"""
WITH doc_words AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT item_id, w, u.i AS i, least(len(w), 10) AS size, array_to_string(w[u.i:u.i + least(len(w), 10) - 1], ' ') AS win
  FROM items, unnest(range(1, greatest(len(w) - 8, 2))) u(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT rid, u.i AS i, size, array_to_string(w[u.i:u.i + size - 1], ' ') AS win
  FROM doc_words, sizes, unnest(range(1, len(w) - size + 2)) u(i)
), hits AS (
  SELECT rid, d.i AS i, d.size AS size, item_id, b.i AS j, b.w AS bw FROM doc_windows d JOIN item_windows b ON d.win = b.win AND d.size = b.size
), hit_words AS (
  SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS k FROM hits) GROUP BY rid
), found AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY rid
), reach AS (
  SELECT rid, max((SELECT coalesce(min(k), least(len(bw) - j + 1, len(w) - i + 1)) FROM unnest(range(size, least(len(bw) - j + 1, len(w) - i + 1))) u(k)
         WHERE bw[j + k] <> w[i + k])) AS longest
  FROM hits JOIN doc_words USING (rid) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0)::BIGINT AS longest_match
FROM doc_words LEFT JOIN hit_words USING (rid) LEFT JOIN found USING (rid) LEFT JOIN reach USING (rid)
"""

ORACLES["op5_minhash_dedup"] = rf"""
WITH RECURSIVE doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM doc_words WHERE len(w) > 0
), shingles AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM common WHERE 100 * c >= 75 * (na + nb - c) UNION ALL SELECT b, a FROM common WHERE 100 * c >= 75 * (na + nb - c)
), reach AS (
  SELECT a AS doc_id, a AS r FROM (SELECT DISTINCT a FROM links) UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.doc_id
), classes AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(len(s), 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM doc_words LEFT JOIN sets USING (doc_id) LEFT JOIN classes USING (doc_id)
"""

ORACLES["op6_anchored_repeats"] = r"""
WITH doc_words AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), wins AS MATERIALIZED (
  SELECT rid, doc_id, u.i AS i, md5(array_to_string(w[u.i:u.i + 49], ' ')) AS h FROM doc_words, unnest(range(1, len(w) - 48)) u(i)
), firsts AS (SELECT h, min(doc_id) AS least FROM wins GROUP BY h),
gone AS (
  SELECT rid, list(DISTINCT k) AS ks FROM (SELECT rid, unnest(range(i, i + 50)) AS k FROM wins JOIN firsts USING (h) WHERE doc_id > least) GROUP BY rid
), kept AS (
  SELECT t.rid, list(t.x ORDER BY t.k) AS kw FROM (SELECT rid, u.k AS k, w[u.k] AS x FROM doc_words, unnest(range(1, len(w) + 1)) u(k)) t
  ANTI JOIN (SELECT rid, unnest(ks) AS k FROM gone) g ON t.rid = g.rid AND t.k = g.k GROUP BY t.rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed, sha256(coalesce(array_to_string(kw, ' '), '')) AS kept_sha256
FROM doc_words LEFT JOIN gone USING (rid) LEFT JOIN kept USING (rid)
"""

ORACLES["op8_url_filters"] = rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
)
SELECT page_id, host, path,
       CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
            WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
            WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
            WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN regexp_matches(host || path, '/wp-login\.php$') OR regexp_matches(host || path, '/cart/checkout(/|$)')
              OR regexp_matches(host || path, '^ads?\.[^/]*/click/') THEN 'block'
            ELSE 'allow' END AS verdict
FROM parts
"""

_CRC_TABLE = "SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(256) r(b)"

ORACLES["op9_virtual_slots"] = rf"""
WITH crc_table AS ({_CRC_TABLE}), hexed AS (
  SELECT row_number() OVER () AS rid, doc_id, text, hex(encode(coalesce(text, ''))) AS h FROM documents
), sums AS (
  SELECT rid, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, i * 2 + 1, 2))::BIGINT),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32
  FROM hexed, crc_table
), records AS (
  SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size, coalesce(text_crc32, 0)::BIGINT AS text_crc32,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {SLOTS})::INTEGER AS vslot
  FROM hexed JOIN sums USING (rid)
), owners AS (
  SELECT vslot, shard, CASE WHEN row_number() OVER (PARTITION BY shard ORDER BY vslot) > {SLOTS} // 17 + (shard < {SLOTS} % 17)::INTEGER
         THEN 16 ELSE shard END AS grown_shard
  FROM (SELECT v::INTEGER AS vslot, (v % 16)::INTEGER AS shard FROM range({SLOTS}) r(v))
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY vslot, doc_id, text_crc32, size) - 1)::BIGINT AS slot,
       grown_shard::INTEGER AS grown_shard, vslot
FROM records JOIN owners USING (vslot)
"""

ORACLES["op10_token_rollups"] = r"""
WITH counted AS (
  SELECT source, lang, octet_length(encode(coalesce(text, ''))) AS n_bytes,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w1,
         len(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z\x{80}-\x{10FFFF}]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]')) AS w2
  FROM documents
)
SELECT source, lang, CASE WHEN source = 'src0' THEN 'words-2' ELSE 'words-1' END AS tokenizer, count(*)::BIGINT AS n_docs,
       sum(CASE WHEN source = 'src0' THEN w2 ELSE w1 END)::BIGINT AS n_tokens, sum(n_bytes)::BIGINT AS n_bytes
FROM counted WHERE w1 >= 50 GROUP BY ALL
"""


def _rounds(rounds: int = 10, k: int = 8) -> str:
    """Every round as two tables: a<r> assigns the vectors to c<r>, and c<r + 1> are the floored means."""
    kept = """kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS x, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
)"""
    first = f"""c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h, x) - 1)::INTEGER AS c, q FROM (
    SELECT q, x, sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h FROM kept ORDER BY h, x LIMIT {k})
)"""
    out = [kept, first]
    for r in range(rounds + 1):
        out.append(f"""a{r} AS MATERIALIZED (
  SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT rid, c, list_sum(list_transform(range(1, 65), lambda i: (kept.q[i] - c{r}.q[i]) * (kept.q[i] - c{r}.q[i])))::BIGINT AS d FROM kept, c{r}) GROUP BY rid
)""")
        if r < rounds:
            out.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c{r}.c AS c, coalesce(m.q, c{r}.q) AS q FROM c{r} LEFT JOIN (
    SELECT c, list((CASE WHEN s < 0 AND s % n <> 0 THEN s // n - 1 ELSE s // n END)::BIGINT ORDER BY i) AS q
    FROM (SELECT c, u.i AS i, sum(q[u.i]::HUGEINT) AS s, count(*)::HUGEINT AS n FROM kept JOIN a{r} USING (rid), unnest(range(1, 65)) u(i) GROUP BY ALL) GROUP BY c
  ) m ON m.c = c{r}.c
)""")
    return "WITH " + ", ".join(out)


ORACLES["op11_pivot_clusters"] = rf"""
{_rounds()}
SELECT vec_id, a10.c AS cluster, a10.d AS distance, (sum(a10.d) OVER (PARTITION BY a10.c))::BIGINT AS cluster_inertia, (sum(a10.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c10.q, ',')) AS centroid_sha256
FROM kept JOIN a10 USING (rid) JOIN c10 ON c10.c = a10.c
"""

ORACLES["op12_token_groups"] = rf"""
WITH RECURSIVE doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM doc_words WHERE len(w) > 0
), shingles AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM common WHERE 100 * c >= 90 * (na + nb - c) UNION ALL SELECT b, a FROM common WHERE 100 * c >= 90 * (na + nb - c)
), reach AS (
  SELECT a AS doc_id, a AS r FROM (SELECT DISTINCT a FROM links) UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.doc_id
), classes AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(len(s), 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM doc_words LEFT JOIN sets USING (doc_id) LEFT JOIN classes USING (doc_id)
"""

ORACLES["op13_phrase_mining"] = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?
-
]')), '[^ 	]+') AS w
  FROM documents
), totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM pieces GROUP BY lang),
counts AS MATERIALIZED (
  SELECT lang, size, array_to_string(w[u.i:u.i + size - 1], ' ') AS phrase, count(*)::HUGEINT AS f
  FROM pieces, unnest(range(1, 6)) s(size), unnest(range(1, len(w) - size + 2)) u(i) GROUP BY ALL HAVING count(*) >= 100
), candidates AS MATERIALIZED (SELECT lang, size, phrase, f, string_split(phrase, ' ') AS w FROM counts WHERE size > 1),
inner_ones AS (
  SELECT lang, array_to_string(w[u.i:u.i + m - 1], ' ') AS phrase, max(f) AS longer
  FROM candidates, unnest(range(2, size)) t(m), unnest(range(1, size - m + 2)) u(i) GROUP BY ALL
), cuts AS (
  SELECT c.lang AS lang, c.phrase AS phrase, c.f AS a, t.k AS k, x.f AS l, y.f AS r, n, (1000 * c.f * n) // (x.f * y.f) AS score
  FROM candidates c JOIN totals USING (lang), unnest(range(1, size)) t(k)
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:t.k], ' ') JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[t.k + 1:], ' ')
), best AS (
  SELECT lang, phrase, a, n, arg_min(l, (score, k)) AS l, arg_min(r, (score, k)) AS r, min(score) AS score FROM cuts GROUP BY ALL
), ranked AS (
  SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank
  FROM best LEFT JOIN inner_ones USING (lang, phrase) WHERE longer IS NULL OR longer < a
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
