"""DuckDB SQL for the queries that SQL can express."""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP8 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT l.v, r.root FROM r JOIN l ON l.u = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""

OP4 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2),
  lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS g FROM b WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
p AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM p),
h AS (SELECT doc_id, item_id, dw.k, i FROM dw JOIN bw ON bw.g = dw.g AND bw.k = dw.k),
nh AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
ni AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.w), 0)::BIGINT AS n_words, coalesce(nh.n, 0) AS n_hit, coalesce(ni.n, 0) AS n_items,
  sha256(coalesce(ni.items, '')) AS items_sha256, coalesce(nh.n, 0) > 0 AS contaminated
FROM d LEFT JOIN nh ON nh.doc_id = d.doc_id LEFT JOIN ni ON ni.doc_id = d.doc_id
"""

# Weights are the roots as doubles, which 2^52 makes whole numbers.  The schedule slot by slot: among the blocks that may start, the earliest deadline wins; a source that runs out begins a new phase.
OP10 = """
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
s AS (SELECT list(source ORDER BY source) AS names, list(CAST(ceil(n / 16.0) AS BIGINT) ORDER BY source) AS blocks,
  list(CAST(sqrt(n) * 4503599627370496.0 AS HUGEINT) ORDER BY source) AS shares FROM n),
one AS (SELECT list(names) AS x, any_value(names) AS names, any_value(blocks) AS blocks, any_value(shares) AS shares FROM
  (SELECT flatten(list(names)) AS names, flatten(list(blocks)) AS blocks, flatten(list(shares)) AS shares FROM s)),
r(slot, t, phase, first, done, q, pick, release, deadline) AS (
  SELECT -1::BIGINT, 0::BIGINT, 0, 0::BIGINT, list_transform(blocks, lambda x: 0::BIGINT), list_transform(blocks, lambda x: 0::BIGINT), 0::BIGINT, 0::BIGINT, 0::BIGINT FROM one
  UNION ALL
  SELECT slot + 1, CASE WHEN done[i] + 1 = blocks[i] THEN 0 ELSE t + 1 END, CASE WHEN done[i] + 1 = blocks[i] THEN phase + 1 ELSE phase END,
    CASE WHEN done[i] + 1 = blocks[i] THEN slot + 2 ELSE first END,
    list_transform(range(1, len(done) + 1), lambda k: done[k] + CASE WHEN k = i THEN 1 ELSE 0 END),
    list_transform(range(1, len(done) + 1), lambda k: CASE WHEN done[i] + 1 = blocks[i] THEN 0 ELSE q[k] + CASE WHEN k = i THEN 1 ELSE 0 END END),
    i, (first + q[i] * total // shares[i])::BIGINT, (first + ((q[i] + 1) * total + shares[i] - 1) // shares[i])::BIGINT
  FROM (SELECT *, list_transform(list_sort(list_transform(list_filter(range(1, len(done) + 1),
      lambda k: done[k] < blocks[k] AND q[k] * total // shares[k] <= t), lambda k: [CAST(((q[k] + 1) * total + shares[k] - 1) // shares[k] AS BIGINT), k])), lambda e: e[2])[1] AS i
    FROM (SELECT r.*, blocks, shares, list_sum(list_transform(range(1, len(done) + 1), lambda k: CASE WHEN done[k] < blocks[k] THEN shares[k] ELSE 0::HUGEINT END))::HUGEINT AS total
      FROM r, one) WHERE total > 0)),
placed AS (SELECT slot, CASE WHEN pick > 0 THEN names[pick] END AS source, pick, release, deadline, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS source_block,
  lag(phase) OVER (ORDER BY slot) AS phase FROM r, one),
d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS i FROM documents)
SELECT d.doc_id, d.source, (i // 16)::BIGINT AS source_block, (i % 16)::INTEGER AS row_in_block, p.phase::INTEGER AS phase,
  p.release::BIGINT AS release, p.deadline::BIGINT AS deadline, p.slot AS slot
FROM d JOIN placed p ON p.pick > 0 AND p.source = d.source AND p.source_block = d.i // 16
"""

OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, octet_length(encode(html))::BIGINT AS n, sha1(html) AS digest, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n < 1000 OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> first THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS problem FROM q
"""

OP13 = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS a, e.vec_id AS v, a.label = e.label AS same, CAST(list_inner_product(a.q::DOUBLE[], e.q::DOUBLE[]) AS BIGINT) AS s
  FROM e AS a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, v) <= 5),
n AS (
  SELECT p.a, p.v AS p, s.v AS n, p.s AS ps, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.v ORDER BY s.s DESC, s.v) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s)
SELECT a AS anchor_id, p AS positive_id, rank::INTEGER AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 3
"""

def _term(p: str, q: str) -> str:
    part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({p} + {q})) ELSE 0 END"
    return f"({part(p)} + {part(q)})"


_CLASSES = [r"\p{Ll}", r"[\x20\x09-\x0D]", r"\p{Lu}", r"[\p{Lt}\p{Lm}\p{Lo}\p{M}]", r"\p{N}", r"\p{P}"]
_COUNTS = ", ".join(f"len(t) - len(regexp_replace(t, '{c}', '', 'g')) AS c{i}" for i, c in enumerate(_CLASSES))
_SHARES = " + ".join(_term(f"(c{i} / n_chars)", f"s{i}") for i in range(7))
OP11 = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT doc_id, lang, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS l,
  len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS dl, len(t) AS n_chars, {_COUNTS} FROM d),
m7 AS (SELECT *, n_chars - c0 - c1 - c2 - c3 - c4 - c5 AS c6 FROM m),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(nx - i, 8)))::BIGINT AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM rep) GROUP BY doc_id),
dw AS (SELECT doc_id, lang, word, count(*) AS c FROM (SELECT doc_id, lang, unnest(w) AS word FROM d) GROUP BY ALL),
lw AS (SELECT lang, word, sum(c) AS n, sum(sum(c)) OVER (PARTITION BY lang) AS total FROM dw WHERE lang IS NOT NULL GROUP BY lang, word),
ref AS (SELECT lang, word, n / total AS q FROM lw QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= 100),
rq AS (SELECT lang, sum(q) AS qq FROM ref GROUP BY lang),
found AS (SELECT dw.doc_id, ref.lang, sum({_term('(c / n_words)', 'q')} - q) AS d, sum(c / n_words) AS p
  FROM dw JOIN ref ON ref.word = dw.word JOIN m ON m.doc_id = dw.doc_id GROUP BY ALL),
far AS (SELECT m.doc_id, rq.lang, sqrt(greatest(0, (coalesce(d, 0) + qq + {_term('greatest(0, 1 - coalesce(p, 0))', '(1 - qq)')}) / 2)) AS wd
  FROM m CROSS JOIN rq LEFT JOIN found ON found.doc_id = m.doc_id AND found.lang = rq.lang),
cr AS (SELECT lang, {', '.join(f'sum(c{i}) / sum(n_chars) AS s{i}' for i in range(7))} FROM m7 WHERE lang IS NOT NULL GROUP BY lang),
near AS (SELECT m7.doc_id, cr.lang, sqrt(greatest(0, ({_SHARES}) / 2)) AS cd FROM m7 CROSS JOIN cr WHERE n_chars > 0),
best AS (SELECT m.doc_id, far.lang, CASE WHEN n_words >= 50 THEN wd END AS wd, CASE WHEN n_chars >= 300 THEN cd END AS cd
  FROM m JOIN far ON far.doc_id = m.doc_id LEFT JOIN near ON near.doc_id = m.doc_id AND near.lang = far.lang WHERE n_words >= 50 OR n_chars >= 300
  QUALIFY row_number() OVER (PARTITION BY m.doc_id ORDER BY CASE WHEN n_words >= 50 THEN wd ELSE 0 END + CASE WHEN n_chars >= 300 THEN cd ELSE 0 END, far.lang) = 1),
v AS (SELECT m.*, coalesce(cov.n, 0) AS n_repeat_words, best.lang AS language, wd, cd, n_words < 20 OR 100 * coalesce(cov.n, 0) > 30 * n_words AS base_failed
  FROM m LEFT JOIN cov ON cov.doc_id = m.doc_id LEFT JOIN best ON best.doc_id = m.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, (l - dl)::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(wd <= 0.26 + 2.0 / sqrt(n_words), true) AND coalesce(cd <= 0.16 + 2.4 / sqrt(n_chars), true) AS kept,
  language, round(wd, 6) AS word_distance, round(cd, 6) AS class_distance FROM v
"""

ORACLE = {
    "op11_quality_rules": OP11,
    "op13_hard_negatives": OP13,
    "op9_warc": OP9,
    "op4_decontamination": OP4,
    "op10_mixing": OP10,
    "op8_near_dedup": OP8,
}
