"""One query per operator, over whole tables with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from govspark.llm.ann import op4_nearest_neighbours
from govspark.llm.bpe import op1_byte_bpe
from govspark.llm.centroids import op11_centroid_clusters
from govspark.llm.decontaminate import op12_decontaminate
from govspark.llm.html_text import op9_html_text
from govspark.llm.language_id import op6_language_id
from govspark.llm.mixing import op10_mixing
from govspark.llm.near_dedup import op5_near_duplicates
from govspark.llm.quality_lm import op2_quality_lm
from govspark.llm.repetition import op8_repetition_rules
from govspark.llm.spelling import op13_spelling_variants
from govspark.llm.token_files import op3_token_files
from govspark.llm.toxicity import op7_toxicity

QUERIES = {f.__name__: f for f in (
    op1_byte_bpe, op2_quality_lm, op3_token_files, op4_nearest_neighbours, op5_near_duplicates, op6_language_id, op7_toxicity, op8_repetition_rules,
    op9_html_text, op10_mixing, op11_centroid_clusters, op12_decontaminate, op13_spelling_variants)}

_ROUND = """
n{r} AS (SELECT vec_id, v, c, d FROM (SELECT k.vec_id, k.v, m.c, list_sum(list_transform(list_zip(k.v, m.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM k, m{r} m)
 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1),"""
_MEAN = """
s{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(range(1, 65)) AS i, unnest(v) AS x FROM n{r}) GROUP BY c, i) GROUP BY c),
m{t} AS (SELECT m.c, coalesce(s.v, m.v) AS v FROM m{r} m LEFT JOIN s{r} s ON m.c = s.c),"""

ORACLES: dict[str, str] = {
    "op11_centroid_clusters": """
WITH k AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
m0 AS (SELECT (row_number() OVER (ORDER BY sha256(concat('2:', vec_id::VARCHAR))) - 1)::INT AS c, v FROM k QUALIFY c < 40),"""
    + "".join(_ROUND.format(r=r) + _MEAN.format(r=r, t=r + 1) for r in range(5)) + _ROUND.format(r=5) + """
i AS (SELECT c, sum(d)::BIGINT AS own FROM n5 GROUP BY c)
SELECT vec_id, n.c AS cluster, d AS distance, own AS cluster_inertia, (SELECT sum(own)::BIGINT FROM i) AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM n5 n JOIN m5 m ON n.c = m.c JOIN i ON n.c = i.c""",
    "op10_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(concat_ws(':', '0', doc_id::VARCHAR)) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, (1 + place % 3)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS room FROM o),
f AS (SELECT *, room / weight AS ratio, (sum(source_size) OVER () - coalesce(sum(room) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
 FROM w WINDOW b AS (ORDER BY room / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, place, CASE WHEN ratio <= level THEN room ELSE weight * (SELECT level FROM f WHERE ratio > level ORDER BY ratio, place LIMIT 1) END AS target FROM f),
p AS (SELECT d.*, t.source_size, t.target, t.place,
 coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
 FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(round(target) / source_size)::BIGINT ELSE 0 END AS rounds FROM p),
l AS (SELECT *, least(greatest(round(target) - rounds * source_size - start, 0), size)::BIGINT AS last FROM r),
c AS (SELECT *, CASE WHEN size > 0 THEN rounds + CASE WHEN last > 0 THEN 1 ELSE 0 END ELSE 0 END AS copies,
 least(greatest((start + CASE WHEN rounds > 0 THEN size ELSE last END / 2.0::DOUBLE) / target, 0), 1) AS share,
 CASE place % 3 WHEN 0 THEN 0.625 WHEN 1 THEN 0.5 ELSE 0.375 END::DOUBLE AS half, CASE place % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS early FROM l),
v AS (SELECT *, share >= half AS second, CASE WHEN share >= half THEN (share - half) * 2 ELSE share * 2 END AS rest, CASE WHEN share >= half THEN 1.0 ELSE early END::DOUBLE AS low,
 CASE WHEN share >= half THEN 2 - early ELSE 1.0 END::DOUBLE AS high FROM c)
SELECT doc_id, size, source_size, target, (rounds * size + last)::BIGINT AS taken, copies::INT AS copies,
 CASE WHEN copies > 0 THEN (CASE WHEN second THEN 1 ELSE 0 END + CASE WHEN rest > 0 THEN 2 * rest / (low + sqrt(greatest(low * low + 2 * (high - low) * rest, 0))) ELSE 0 END) / 2 END AS first_position
FROM v""",
    "op12_decontaminate": r"""
WITH i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
s AS (SELECT *, least(len(words), 10) AS size FROM i WHERE len(words) > 0),
g AS (SELECT DISTINCT item_id, size, array_to_string(words[spot:spot + size - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS spot FROM s)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
p AS (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS spot FROM d, (SELECT DISTINCT size FROM s) WHERE len(words) >= size),
h AS (SELECT doc_id, spot, p.size, item_id FROM p JOIN g ON p.size = g.size AND array_to_string(words[spot:spot + p.size - 1], ' ') = gram),
n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(spot, spot + size)) AS place FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN t ON d.doc_id = t.doc_id""",
    "op13_spelling_variants": r"""
WITH RECURSIVE b AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS steps),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS times FROM r WHERE length(run) >= 7 GROUP BY ALL),
y AS (SELECT *, flatten(list_transform(string_split(concat(doc_id::VARCHAR, ':', run), ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [195, ord(x) - 64] END)) AS bytes FROM c),
h AS (SELECT run, times, xor(4294967295, list_reduce(bytes, lambda a, x: xor(a >> 8, steps[(xor(a, x) & 255) + 1]), 4294967295::BIGINT)) AS crc FROM y, b),
a AS (SELECT CASE WHEN crc % 31 = 0 THEN concat(left(run, (crc % length(run))::INT), substr(run, (crc % length(run))::INT + 2)) ELSE run END AS word, times FROM h),
w AS (SELECT word, sum(times)::BIGINT AS n FROM a WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
s AS (SELECT word, n, left(word, i::INT - 1) AS front, substr(word, i::INT + 1) AS back FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT x.word, y.word AS other, y.n AS other_n FROM s x JOIN s y ON x.front = y.front AND x.back = y.back AND x.word <> y.word
 UNION SELECT s.word, w.word, w.n FROM s JOIN w ON concat(s.front, s.back) = w.word UNION SELECT w.word, s.word, s.n FROM s JOIN w ON concat(s.front, s.back) = w.word),
o AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place FROM p),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
 FROM w LEFT JOIN o ON w.word = o.word AND place = 1),
t AS (SELECT word, word AS root, 0 AS depth FROM w UNION ALL SELECT t.word, f.form, depth + 1 FROM t JOIN f ON t.root = f.word WHERE f.form IS NOT NULL),
u AS (SELECT word, arg_max(root, depth) AS root FROM t GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN u ON f.word = u.word""",
}
