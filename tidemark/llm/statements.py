"""The results of operators stated again in SQL, where SQL can express them."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"


OP1_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_lower('text')}, '{_SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, x FROM (SELECT doc_id, array_to_string(w[i : i + 2], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3) u UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 2) v),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
rep AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS rep, n FROM (SELECT doc_id, sha256(string_agg(x, chr(10) ORDER BY x)) AS h, count(*) AS n FROM s GROUP BY doc_id) g),
one AS (SELECT s.doc_id, s.x FROM s JOIN rep ON s.doc_id = rep.doc_id AND rep.rep = rep.doc_id),
few AS (SELECT x FROM one GROUP BY x HAVING count(*) > 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM one a JOIN few USING (x) JOIN one b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 90 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a AS node, a AS seen FROM both_ways UNION SELECT node, b FROM reach JOIN both_ways ON seen = a),
root AS (SELECT node, min(seen) AS root FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(root, rep.rep, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN root ON rep.rep = node
"""

OP5_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13) u),
lo AS (SELECT k, min(doc_id) AS lo FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i FROM win JOIN lo USING (k) WHERE doc_id > lo) g CROSS JOIN (SELECT unnest(range(0, 13)) AS j) t),
spot AS (SELECT doc_id, i AS p, w[i] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) u),
kept AS (SELECT spot.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY spot.p) AS text FROM spot ANTI JOIN gone ON spot.doc_id = gone.doc_id AND spot.p = gone.p GROUP BY spot.doc_id)
SELECT w.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

OP8_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all({_lower('text')}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_lower('text')}, '{_ALNUM}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0) u),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS k FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w JOIN sizes ON len(w) >= size) u),
hit AS (SELECT dw.doc_id, dw.i, dw.size, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.size = bw.size),
place AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT DISTINCT doc_id, i, size FROM hit) h JOIN (SELECT unnest(range(0, 10)) AS j) t ON j < size) x GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS varchar) AS item FROM hit) x GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(place.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(place.n, 0) > 0 AS contaminated FROM w LEFT JOIN place USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP11_SQL = f"""
WITH crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
w AS (SELECT 'd' AS side, doc_id, regexp_extract_all({_lower('text')}, '{_ALNUM}') AS w FROM documents UNION ALL SELECT 'b', item_id, regexp_extract_all({_lower('text')}, '{_ALNUM}') FROM benchmark),
g AS (SELECT side, doc_id, array_to_string(w[i : i + k - 1], ' ') AS f FROM (SELECT side, doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) ks WHERE len(w) >= k) u),
n AS (SELECT side, doc_id, f, count(*) AS n FROM g GROUP BY ALL),
h AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM n) d),
b AS (SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(0, len(h) // 2), lambda j: ('0x' || h[2 * j + 1 : 2 * j + 2])::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS b FROM h, crc),
counts AS (SELECT b, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM n JOIN b USING (f) GROUP BY b),
totals AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM counts),
gain AS (SELECT b, floor(1000 * ln((c.t + 1)::DOUBLE * (o.s + 10000)::DOUBLE / ((c.s + 1)::DOUBLE * (o.t + 10000)::DOUBLE)))::BIGINT AS gain FROM counts c, totals o),
docs AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM n JOIN b USING (f) JOIN gain USING (b) WHERE side = 'd' GROUP BY doc_id),
score AS (SELECT w.doc_id, len(w.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || w.doc_id)[1:8])::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score FROM w LEFT JOIN docs USING (doc_id) WHERE side = 'd'),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS total FROM score WHERE n_words >= 20)
SELECT score.doc_id, n_features, weight, score, CASE WHEN place <= 5 * total // 100 THEN place END AS rank FROM score LEFT JOIN placed USING (doc_id)
"""

OP12_SQL = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_lower('text')}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, w[i : i + k - 1] AS w FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k) ks WHERE len(w) >= k) u),
f AS (SELECT lang, w, count(*) AS f FROM g GROUP BY lang, w),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(w) = 1 GROUP BY lang),
c AS (SELECT lang, w, f AS a FROM f WHERE len(w) >= 2 AND f >= 30),
cuts AS (SELECT c.lang, c.w, c.a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score FROM (SELECT *, unnest(range(1, len(w))) AS k FROM c) c JOIN f x ON x.lang = c.lang AND x.w = c.w[1:k] JOIN f y ON y.lang = c.lang AND y.w = c.w[k + 1 :]),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
inside AS (SELECT DISTINCT c.lang, w[i : i + k - 1] AS w, a FROM (SELECT c.*, k, unnest(range(1, len(w) - k + 2)) AS i FROM c JOIN (SELECT unnest([2, 3]) AS k) ks ON k < len(c.w)) c),
longer AS (SELECT lang, w, max(a) AS longer FROM inside GROUP BY lang, w),
kept AS (SELECT lowest.*, array_to_string(lowest.w, ' ') AS phrase FROM lowest LEFT JOIN longer ON lowest.lang = longer.lang AND lowest.w = longer.w WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""

OP13_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
l AS (SELECT doc_id, i, x[i] AS line, translate(trim(x[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS k FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM d) u),
few AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
kept AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS text FROM l ANTI JOIN few USING (k) GROUP BY doc_id)
SELECT d.doc_id, len(x) AS n_lines, len(x) - coalesce(n, 0) AS n_dropped, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
