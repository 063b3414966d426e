"""DuckDB SQL for the queries that SQL can express."""

LINE_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, l, translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
often AS (SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE o.k IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE o.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN often o ON lines.k = o.k GROUP BY doc_id
"""

WARC_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS m FROM p GROUP BY h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(p.h, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) // CAST(32 ** (3 - i % 4) AS BIGINT)) % 32 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to
FROM p JOIN f ON p.h = f.h
"""

MIX_SQL = r"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(source, '') AS s, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents),
sizes AS (SELECT s, pow(count(*), 0.5) AS w FROM docs GROUP BY s),
per AS (SELECT 1000 * greatest(1, (count(*) + 499) // 500) AS p FROM sizes),
quota AS (SELECT s, w / sum(w) OVER () * p AS q, greatest(1, floor(w / sum(w) OVER () * p)) AS base, p FROM sizes CROSS JOIN per),
spare AS (SELECT s, base, p - sum(base) OVER () AS r, row_number() OVER (ORDER BY q - floor(q) DESC, s) AS more FROM quota),
take AS (SELECT s, count(*) AS less FROM (
  SELECT s, r, row_number() OVER (ORDER BY CASE WHEN k > 1 THEN k / base ELSE 0 END, base DESC, s) AS o
  FROM (SELECT s, base, r, unnest(range(1, CAST(base AS BIGINT))) AS k FROM spare WHERE r < 0)) WHERE o <= -r GROUP BY s),
share AS (SELECT spare.s, CAST(base + CASE WHEN r > 0 AND more <= r THEN 1 ELSE 0 END - coalesce(less, 0) AS BIGINT) AS a FROM spare LEFT JOIN take ON take.s = spare.s),
srt AS (SELECT list(s ORDER BY s) AS ss, list(a ORDER BY s) AS aa FROM share),
run AS (
  SELECT 0 AS t, list_transform(aa, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS j, ss, aa, p AS per FROM srt CROSS JOIN per
  UNION ALL
  SELECT t + 1, list_transform(range(1, len(aa) + 1), lambda i: done[i] + CASE WHEN i = p THEN 1 ELSE 0 END), p, done[p], ss, aa, per
  FROM (SELECT *, list_min(list_transform(list_filter(range(1, len(aa) + 1), lambda i: done[i] < aa[i] AND (done[i] * per) // aa[i] <= t),
      lambda i: ((done[i] + 1) * per + aa[i] - 1) // aa[i] * 100000 + i)) % 100000 AS p FROM run WHERE t < per)),
plan AS (SELECT ss[k] AS s, aa[k] AS a, j, t - 1 AS slot FROM run WHERE t > 0),
ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY s ORDER BY o, doc_id) - 1 AS r FROM docs)
SELECT d.doc_id, d.s AS source, CAST(r AS BIGINT) AS source_rank, CAST((r // 8) // share.a * p + plan.slot AS BIGINT) AS slot, CAST(((r // 8) // share.a * p + plan.slot) * 8 + r % 8 AS BIGINT) AS position
FROM ranked d JOIN share ON share.s = d.s JOIN plan ON plan.s = d.s AND plan.j = (r // 8) % share.a CROSS JOIN per
"""

NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s FROM w),
c AS (SELECT min(doc_id) AS c, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
e AS (SELECT c, n, unnest(s) AS x FROM c),
often AS (SELECT x, count(*) AS uses FROM e GROUP BY x HAVING count(*) > 1),
r AS (SELECT c, n, e.x, row_number() OVER (PARTITION BY c ORDER BY coalesce(uses, 1), e.x) AS k, uses FROM e LEFT JOIN often ON often.x = e.x),
p AS (SELECT c, n, x FROM r WHERE k <= n - ((85 * n + 99) // 100) + 1 AND uses > 1),
pairs AS (SELECT DISTINCT a.c AS a, b.c AS b FROM p a JOIN p b ON a.x = b.x AND a.c < b.c AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n),
links AS (SELECT pairs.a, pairs.b FROM pairs JOIN c a ON a.c = pairs.a JOIN c b ON b.c = pairs.b
  WHERE 100 * len(list_intersect(a.s, b.s)) >= 85 * (a.n + b.n - len(list_intersect(a.s, b.s)))),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT c AS a, c AS b FROM c UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.b),
comp AS (SELECT a AS c, min(b) AS m FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m, s.doc_id) AS component_id, s.doc_id = coalesce(m, s.doc_id) AS kept
FROM s LEFT JOIN c ON c.s = s.s LEFT JOIN comp ON comp.c = c.c
"""



def codes_sql(rounds: int = 6) -> str:
    """Rounds of plain assignment and floored means over 8 parts and 16 entries."""
    out = ["""WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, k, v[k * (len(v) // 8) + 1 : (k + 1) * (len(v) // 8)] AS q FROM kept CROSS JOIN (SELECT unnest(range(8)) AS k)),
b0 AS MATERIALIZED (SELECT k, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS e, q AS c FROM p WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 16))"""]
    near = "SELECT vec_id, p.k, min(CAST(list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * 16 + e) AS de FROM p JOIN b{0} b ON p.k = b.k GROUP BY vec_id, p.k"
    for i in range(rounds):
        out.append(f"a{i} AS MATERIALIZED ({near.format(i)})")
        out.append(f"""m{i} AS (SELECT k, e, list(m ORDER BY j) AS c FROM (SELECT k, e, j, (sum(x) - ((sum(x) % count(*) + count(*)) % count(*))) // count(*) AS m
  FROM (SELECT a.k, de % 16 AS e, CAST(unnest(q) AS BIGINT) AS x, unnest(range(len(q))) AS j FROM a{i} a JOIN p ON p.vec_id = a.vec_id AND p.k = a.k) GROUP BY k, e, j) GROUP BY k, e)""")
        out.append(f"b{i + 1} AS MATERIALIZED (SELECT b.k, b.e, coalesce(list_transform(m.c, lambda x: CAST(x AS BIGINT)), b.c) AS c FROM b{i} b LEFT JOIN m{i} m ON m.k = b.k AND m.e = b.e)")
    out.append(f"last AS ({near.format(rounds)})")
    out.append("coded AS (SELECT vec_id, string_agg(printf('%02x', de % 16), '' ORDER BY k) AS code, CAST(sum(de // 16) AS BIGINT) AS error FROM last GROUP BY vec_id)")
    return ",\n".join(out) + f"""
SELECT coded.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY k, e, j)) FROM (SELECT k, e, unnest(c) AS x, unnest(range(len(c))) AS j FROM b{rounds})) AS codebooks_sha256
FROM coded JOIN kept ON kept.vec_id = coded.vec_id"""


ORACLES = {"op12_vector_codes": codes_sql(), "op6_near_dedup": NEAR_SQL, "op2_mix_sources": MIX_SQL, "op7_warc": WARC_SQL, "op9_line_dedup": LINE_SQL}
