"""DuckDB SQL for those of the operators' queries that SQL can express."""

from pathlib import Path

_TEXTS = Path(__file__).parent / "licence_texts"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT row_number() OVER () AS rid, item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT rid, item_id, p AS q, least(10, len(w)) AS size, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS win
       FROM (SELECT rid, item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT doc_id, size, p, array_to_string(w[p : p + size - 1], ' ') AS win
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT doc_id, rid, item_id, p, q, dw.size FROM dw JOIN iw ON dw.win = iw.win AND dw.size = iw.size),
n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS place FROM hit) GROUP BY doc_id),
lm AS (SELECT doc_id, max(k) AS k FROM (SELECT doc_id, count(*) + size - 1 AS k FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, rid, p - q ORDER BY p) AS g FROM hit) GROUP BY doc_id, rid, p - q, g, size) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(k, 0) AS BIGINT) AS longest_match
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN lm USING (doc_id)
"""

OP2 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest
"""


OP6 = rf"""
WITH raw AS (SELECT regexp_extract(filename, '([^/]+)\.txt$', 1) AS licence, content AS body FROM read_text('{_TEXTS}/*.txt')
             UNION ALL SELECT string_split(l, chr(9))[1], string_split(l, chr(9))[2] FROM (SELECT unnest(string_split(content, chr(10))) AS l FROM read_text('{_TEXTS}/NOTICES')) WHERE l <> ''),
tw AS (SELECT row_number() OVER () AS tid, licence, list_filter(regexp_split_to_array(lower(body), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM raw),
tg AS (SELECT tid, licence, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM tw),
t AS (SELECT tid, licence, len(g) AS n, list_distinct(g) AS b, len(list_distinct(g)) AS m, g FROM tg),
probe AS (SELECT tid, pos, bg FROM (SELECT tid, pos, bg, row_number() OVER (PARTITION BY tid, pos * 16 // n ORDER BY length(bg) DESC, pos) AS k
          FROM (SELECT tid, n, unnest(range(len(g))) AS pos, unnest(g) AS bg FROM t)) WHERE k = 1),
dw AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
dg AS (SELECT rid, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM dw WHERE len(w) >= 2),
df AS (SELECT rid, unnest(range(len(g))) AS pos, unnest(g) AS bg FROM dg),
ds AS (SELECT DISTINCT rid, bg FROM df),
c AS (SELECT rid, tid FROM ds JOIN (SELECT tid, m, unnest(b) AS bg FROM t) USING (bg) GROUP BY rid, tid, m HAVING count(*) >= m * 0.8 / 1.2 - 1e-9),
st AS (SELECT DISTINCT rid, tid, greatest(0, df.pos - probe.pos) AS s FROM c JOIN probe USING (tid) JOIN df USING (rid, bg)),
wi AS (SELECT rid, tid, licence, s, m, b, dg.g[s + 1 : s + n] AS a FROM st JOIN t USING (tid) JOIN dg USING (rid)),
di AS (SELECT rid, tid, licence, s AS first, s + len(a) AS last, 2 * len(list_intersect(list_distinct(a), b)) - m AS lead_, 2.0 * len(list_intersect(list_distinct(a), b)) / (len(list_distinct(a)) + m) AS dice FROM wi),
h AS (SELECT rid, list(struct_pack(lead_ := lead_, dice := dice, first := first, last := last, licence := licence) ORDER BY lead_ DESC, dice DESC, first, last, licence) AS hits FROM di WHERE dice >= 0.8 GROUP BY rid),
r AS (SELECT rid, x.licence AS licence, x.dice AS dice FROM (SELECT rid, unnest(list_reduce(list_transform(hits, lambda x: [x]), lambda kept, x: CASE WHEN len(list_filter(kept, lambda y:
        2 * (least(y.last, x[1].last) - greatest(y.first, x[1].first)) > least(y.last - y.first, x[1].last - x[1].first) AND NOT (y.lead_ = x[1].lead_ AND y.dice = x[1].dice AND y.licence <> x[1].licence))) > 0 THEN kept ELSE kept || x END)) AS x FROM h)),
k AS (SELECT rid, count(DISTINCT licence) AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS ids, max(dice) AS best FROM r GROUP BY rid)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_licences, coalesce(ids, '') AS licences, round(CAST(coalesce(best, 0) AS DOUBLE), 6) AS best_dice
FROM dw LEFT JOIN k USING (rid)
"""


OP12 = """
WITH r AS (SELECT row_number() OVER () AS rn, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rn AS a, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])), 0) AS BIGINT) AS score
      FROM r a JOIN r b ON len(a.v) = len(b.v) AND a.rn <> b.rn WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT a, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.a, k ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
      FROM p JOIN s ON s.a = p.a AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT * FROM n WHERE rank <= 3
"""

OP13 = rf"""
WITH u AS (SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(action, h, s) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
f AS (SELECT page_id, h || s AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY len(h || s) DESC, len(h) DESC) AS k FROM p JOIN r ON (host = h OR suffix(host, '.' || h)) AND prefix(path, s))
SELECT p.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN f ON p.page_id = f.page_id AND k = 1
"""
