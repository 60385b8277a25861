"""The registered queries of this subpackage and their SQL twins (DuckDB)."""

from __future__ import annotations

from . import bpe, hashing_ann, html_text, mixing, neardup, packing, quality, ranking, repair, secrets, sharding, suffixtree, tokenfile

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_NORMAL = r"regexp_replace(trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '[0-9]', '0', 'g')"

#: Base counts, lines and verdict of operator 7 over a table ``{docs}``.
OP7_PARTS = rf"""
w7 AS (SELECT doc_id, source, text, {_WORDS} AS w FROM {{docs}}),
pos7 AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w7 WHERE len(w) >= 3),
win7 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM pos7),
rep7 AS (SELECT doc_id, sum(least(3, i - prev)) AS n_repeat_words
         FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -9) AS prev FROM win7 WHERE c > 1)
         GROUP BY doc_id),
raw7 AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM {{docs}}),
line7 AS (SELECT doc_id, source, md5(text) AS t, line, {_NORMAL} AS norm, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
          FROM raw7 WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup7 AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM line7 GROUP BY doc_id),
freq7 AS (SELECT source, norm, min(doc_id) AS first_id FROM line7 GROUP BY source, norm HAVING count(DISTINCT t) > {quality.MAX_DOCS}),
gone7 AS (SELECT l.doc_id, sum(l.n) AS removed_words
          FROM line7 l JOIN freq7 f ON l.source IS NOT DISTINCT FROM f.source AND l.norm = f.norm AND l.doc_id <> f.first_id
          GROUP BY l.doc_id),
base7 AS (SELECT w7.doc_id, CAST(len(w) AS BIGINT) AS n_words,
            CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
            CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
            CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
            CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
            CAST(coalesce(removed_words, 0) AS BIGINT) AS removed_words
          FROM w7 LEFT JOIN dup7 USING (doc_id) LEFT JOIN rep7 USING (doc_id) LEFT JOIN gone7 USING (doc_id)),
judged7 AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
            n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
            removed_words FROM base7),
verdict7 AS (SELECT *, NOT base_failed AND 100 * (n_words - removed_words) >= {quality.MIN_KEPT_PERCENT} * n_words AS kept FROM judged7)
"""

OP7_SQL = (
    "WITH " + OP7_PARTS.format(docs="documents") + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, removed_words FROM verdict7"
)

#: Shingle sets, links and components of operator 3 over a table ``{docs}``.
OP3_PARTS = rf"""
w3 AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {{docs}}),
s3 AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < {neardup.SHINGLE} THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - {neardup.SHINGLE} + 2), lambda i: array_to_string(w[i:i + {neardup.SHINGLE} - 1], ' '))) END AS s FROM w3),
n3 AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s3),
x3 AS (SELECT doc_id, unnest(s) AS sh FROM s3),
i3 AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x3 a JOIN x3 b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l3 AS (SELECT a, b FROM i3 JOIN n3 p ON p.doc_id = a JOIN n3 q ON q.doc_id = b WHERE 100 * i >= {neardup.PERCENT} * (p.n + q.n - i)),
b3 AS (SELECT a, b FROM l3 UNION ALL SELECT b, a FROM l3),
r3(doc_id, other) AS (SELECT doc_id, doc_id FROM n3 UNION SELECT r3.doc_id, b3.b FROM r3 JOIN b3 ON b3.a = r3.other),
c3 AS (SELECT r3.doc_id, any_value(n3.n) AS n_shingles, min(other) AS component_id FROM r3 JOIN n3 USING (doc_id) GROUP BY r3.doc_id)
"""

OP3_SQL = "WITH RECURSIVE " + OP3_PARTS.format(docs="documents") + "SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM c3"

_UNIT = "CAST(('0x' || substr(md5({0}), 1, 13))::BIGINT AS DOUBLE) / 4503599627370496.0"

OP8_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM s),
c AS (SELECT *, [1, 2, 3][CAST((no - 1) % 3 + 1 AS INT)] AS weight, {mixing.MAX_COPIES} * source_size AS cap FROM n),
p AS (SELECT *, CAST(coalesce(sum(cap) OVER o, 0) AS BIGINT) AS cap_before, CAST(coalesce(sum(weight) OVER o, 0) AS BIGINT) AS weight_before,
        CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(weight) OVER () AS BIGINT) AS all_weights
      FROM c WINDOW o AS (ORDER BY cap / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, max(CASE WHEN (total - cap_before) / (all_weights - weight_before) <= cap / weight THEN (total - cap_before) / (all_weights - weight_before) END) OVER () AS level FROM p),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * level) AS target,
        {_UNIT.format(f"'{mixing.SEED}:' || CAST(no AS VARCHAR)")} AS u FROM l),
e AS (SELECT *, CASE WHEN source_size = 0 THEN 0.0 ELSE target / source_size END AS e FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, h, doc_id) AS r FROM d),
f AS (SELECT r.doc_id, r.size, e.source_size, e.target, CAST(floor(e.e * r.r + e.u) - floor(e.e * (r.r - 1) + e.u) AS INTEGER) AS copies
      FROM r JOIN e ON r.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, copies FROM f
"""

_SCORE = "-ln((CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(s AS VARCHAR)), 1, 13))::BIGINT AS DOUBLE) + 0.5) / 4503599627370496.0)"

OP10_SQL = rf"""
WITH RECURSIVE step(i, k, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM step WHERE k = 8),
d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
        xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
          lambda a, x: xor(a >> 8, t[CAST(xor(a & 255, x) + 1 AS INT)])), 4294967295) AS text_crc32
      FROM documents, tab),
sc AS (SELECT doc_id, s, {_SCORE} AS score FROM (SELECT DISTINCT doc_id FROM documents), range(17) AS g(s)),
p AS (SELECT doc_id, arg_min(s, (score, s)) FILTER (s < 16) AS shard, arg_min(s, (score, s)) AS grown_shard FROM sc GROUP BY doc_id)
SELECT d.doc_id, d.size, d.text_crc32, 'key' AS law, CAST(p.shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY p.shard ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null')), d.doc_id, d.size, d.text_crc32) - 1 AS slot,
  CAST(p.grown_shard AS INTEGER) AS grown_shard
FROM d JOIN p ON d.doc_id IS NOT DISTINCT FROM p.doc_id
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
b AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS t FROM benchmark),
s AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d),
q AS (SELECT DISTINCT i, item_id, unnest(t) AS term FROM b),
p AS (SELECT r, doc_id, CAST(len AS BIGINT) AS n, term, count(*) AS tf
      FROM (SELECT r, doc_id, len(t) AS len, unnest(t) AS term FROM d) JOIN (SELECT DISTINCT term FROM q) USING (term) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2.0 * n_docs + 2) / (2.0 * df + 1))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
f AS (SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY i, item_id, r, doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM f WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {ranking.BEST}
"""


def pipeline(spark, sf_dir):
    """All stages of corpus_pipeline.py over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op9_boosted_dom": html_text.op9_boosted_dom,
    "op1_multi_index_hashing": hashing_ann.op1_multi_index_hashing,
    "op2_suffix_tree": suffixtree.op2_suffix_tree,
    "op5_wavelet_files": tokenfile.op5_wavelet_files,
    "op6_zstd_novelty": secrets.op6_zstd_novelty,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op3_coordinate_join": neardup.op3_coordinate_join,
    "op7_line_frequency": quality.op7_line_frequency,
    "op8_systematic_mix": mixing.op8_systematic_mix,
    "op10_rendezvous": sharding.op10_rendezvous,
    "op11_lr_repair": repair.op11_lr_repair,
    "op12_bin_completion": packing.op12_bin_completion,
    "op13_term_pipeline": ranking.op13_term_pipeline,
}

SQL = {
    "op3_coordinate_join": OP3_SQL,
    "op7_line_frequency": OP7_SQL,
    "op8_systematic_mix": OP8_SQL,
    "op10_rendezvous": OP10_SQL,
    "op13_term_pipeline": OP13_SQL,
}
