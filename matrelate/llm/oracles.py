"""DuckDB SQL for the queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op5_exact_dedup"] = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

ORACLES["op1_decontamination"] = """
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS phrase, list_sort(list_distinct(w[p:p + k - 1])) AS terms
        FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM bw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
grams AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS phrase
          FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM dw, ks WHERE len(w) >= k)),
hits AS (SELECT doc_id, p, k, item_id FROM grams JOIN win USING (k, phrase)),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS sha FROM hits GROUP BY doc_id),
sets AS (SELECT row_number() OVER () AS s, terms, len(terms) AS m FROM (SELECT DISTINCT terms FROM win)),
st AS (SELECT s, m, unnest(terms) AS t FROM sets),
pos AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM dw),
dt AS (SELECT DISTINCT doc_id, t FROM pos SEMI JOIN (SELECT DISTINCT t FROM st) USING (t)),
cand AS (SELECT doc_id, s FROM dt JOIN st USING (t) GROUP BY doc_id, s, m HAVING count(*) = m),
occ AS (SELECT doc_id, s, m, t, p FROM cand JOIN st USING (s) JOIN pos USING (doc_id, t)),
close AS (SELECT DISTINCT a.doc_id, a.s FROM occ a JOIN occ b ON a.doc_id = b.doc_id AND a.s = b.s AND b.p >= a.p AND b.p < a.p + 12
          GROUP BY a.doc_id, a.s, a.m, a.p HAVING count(DISTINCT b.t) = a.m),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM close JOIN sets USING (s) JOIN win USING (terms) GROUP BY doc_id),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
"""

ORACLES["op2_chat"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
           UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g') AS er,
             regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS et FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length(er) + 1 + length(et) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLES["op3_near_dedup"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE [array_to_string(w[p:p + 3], ' ') for p in range(1, len(w) - 2)] END) AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""

ORACLES["op8_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
win AS (SELECT doc_id, p, hash(array_to_string(w[p:p + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS q FROM win SEMI JOIN rep USING (h)),
lost AS (SELECT doc_id, count(*) AS n, list(q) AS qs FROM gone GROUP BY doc_id),
pos AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY q) AS t FROM pos ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
