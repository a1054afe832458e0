"""The queries of this subpackage: opN_<name> over the whole documents table."""

from __future__ import annotations

from .audio import audio_digests
from .bpe import encoded_digests
from .common import read
from .conversations import repair_reports
from .fingerprint import edited_likeness
from .jaccard import jaccard_components
from .langid import identify
from .lines import ORACLE as LINES_ORACLE
from .lines import line_digests
from .packing import pack_documents
from .pii import personal_data
from .resampling import resampled_documents
from .secrets import secret_digests
from .substring import substring_digests
from .warc import archived_pages


def op9_best_fit_packing(spark, sf_dir):
    return pack_documents(read(spark, sf_dir, "documents"))


def op1_substring_dedup(spark, sf_dir):
    return substring_digests(read(spark, sf_dir, "documents"))


def op2_audio_features(spark, sf_dir):
    return audio_digests(read(spark, sf_dir, "documents"))


def op3_canonical_digest(spark, sf_dir):
    return edited_likeness(read(spark, sf_dir, "documents"))


def op4_pii_deobfuscation(spark, sf_dir):
    return personal_data(read(spark, sf_dir, "documents"))


def op5_bpe_speculate_verify(spark, sf_dir):
    return encoded_digests(read(spark, sf_dir, "documents"))


def op6_line_template_tree(spark, sf_dir):
    return line_digests(read(spark, sf_dir, "documents"))


def op7_secret_forest(spark, sf_dir):
    return secret_digests(read(spark, sf_dir, "documents"))


def op8_language_id(spark, sf_dir):
    return identify(read(spark, sf_dir, "documents"))


def op10_jaccard_join(spark, sf_dir):
    return jaccard_components(read(spark, sf_dir, "documents")).drop("version")


def op11_conversation_repair(spark, sf_dir):
    return repair_reports(read(spark, sf_dir, "conversations"))


def op12_importance_resampling(spark, sf_dir):
    return resampled_documents(spark, sf_dir)


def op13_warc_revisits(spark, sf_dir):
    return archived_pages(read(spark, sf_dir, "pages"))


SUBSTRING_ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS s FROM w WHERE len(ws) >= 50),
h AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + 49], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM h JOIN f USING (h) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws)::bigint AS n_words, coalesce(n, 0)::bigint AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

JACCARD_ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\v\f\r]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda k: array_to_string(ws[k:k + 3], ' '))) END AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS shingle FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * k >= 85 * (na + nb - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, len(sh)::bigint AS n_shingles, m AS component_id FROM s JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = doc_id
"""

REPAIR_ORACLE = r"""
WITH RECURSIVE tab AS (SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, v) ORDER BY v) AS tab FROM (SELECT unnest(range(256)) AS v)),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))) AS x FROM conversations),
kinds AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(range(len(x) // 2), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::bigint), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295) % 20 AS kind FROM src, tab),
made AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM made),
judged AS (SELECT *, left(role, 1) AS i, CASE WHEN NOT regexp_matches(text, '[^ \t\n\v\f\r]') THEN 'blank' WHEN again THEN 'duplicate' WHEN right(regexp_replace(text, '[ \t\n\v\f\r]+$', ''), 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM placed),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows
  FROM (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i AS pair FROM judged) GROUP BY conv_id),
-- state: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; costs are padded, so that strings compare like pairs
grammar(role, q, after) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
edits(e, role, q, after) AS (SELECT 'K', * FROM grammar UNION ALL SELECT 'R', * FROM grammar WHERE role <> 's' UNION ALL SELECT 'D', NULL, q, q FROM range(4) t(q)),
inserts(letters, q, after) AS (SELECT '', q, q FROM range(4) t(q) UNION ALL SELECT 'I', q, after FROM grammar WHERE role <> 's'),
step(conv_id, n, q, w) AS (
  SELECT conv_id, 0::bigint, after, lpad((2 * length(letters))::varchar, 9, '0') || letters FROM facts, inserts WHERE q = 0
  UNION ALL
  SELECT conv_id, n, q, min(w) FROM (SELECT s.conv_id, j.n, t.after AS q,
      lpad((left(s.w, 9)::bigint + CASE e.e WHEN 'K' THEN 0 WHEN 'R' THEN 2 ELSE 3 END + CASE WHEN e.e <> 'D' AND j.fault = 'truncated' THEN 1 ELSE 0 END + 2 * length(t.letters))::varchar, 9, '0') || substr(s.w, 10) || e.e || t.letters AS w
    FROM step s JOIN judged j ON j.conv_id IS NOT DISTINCT FROM s.conv_id AND j.n = s.n + 1 JOIN edits e ON e.q = s.q AND (e.e <> 'K' OR e.role = j.i) AND (e.e = 'D' OR coalesce(j.fault, '') NOT IN ('blank', 'duplicate')) JOIN inserts t ON t.q = e.after) GROUP BY conv_id, n, q),
best AS (SELECT s.conv_id, min(w) AS w FROM step s JOIN facts f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND s.n = f.rows WHERE q IN (0, 3) GROUP BY s.conv_id),
letters AS (SELECT conv_id, unnest(string_split(substr(w, 10), '')) AS e, generate_subscripts(string_split(substr(w, 10), ''), 1) AS k FROM best WHERE length(w) > 9),
rows_read AS (SELECT *, count(*) FILTER (e <> 'I') OVER w AS n, count(*) FILTER (e <> 'D') OVER w AS out FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING)),
-- the first kept row tells whether a system row leads; from there users and assistants take turns
lead AS (SELECT r.conv_id, bool_or(r.out = 1 AND r.e = 'K' AND j.i = 's') AS led FROM rows_read r LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM r.conv_id AND j.n = r.n GROUP BY r.conv_id),
repaired AS (SELECT r.conv_id, string_agg(CASE r.e WHEN 'K' THEN j.role ELSE CASE WHEN (r.out + led::int) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE r.e WHEN 'I' THEN '' ELSE j.text END, chr(10) ORDER BY r.k) AS text
  FROM rows_read r JOIN lead l ON l.conv_id IS NOT DISTINCT FROM r.conv_id LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM r.conv_id AND j.n = r.n WHERE r.e <> 'D' GROUP BY r.conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(left(w, 9)::bigint, 0) AS cost, coalesce(substr(w, 10), '') AS audit, sha256(coalesce(p.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN repaired p ON p.conv_id IS NOT DISTINCT FROM c.conv_id
"""

RESAMPLING_ORACLE = r"""
WITH tab AS (SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, v) ORDER BY v) AS tab FROM (SELECT unnest(range(256)) AS v)),
texts AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
f AS (SELECT kind, id, unnest(ws) AS f FROM w UNION ALL SELECT kind, id, unnest(list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1])) FROM w),
n AS (SELECT kind, id, f, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM n)),
c AS (SELECT f, xor(list_reduce(list_transform(range(len(x) // 2), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::bigint), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295) % 10000 AS bucket FROM x, tab),
counts AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0)::double AS s, coalesce(sum(n) FILTER (kind = 'b'), 0)::double AS t FROM n JOIN c USING (f) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::bigint AS gain FROM counts),
weights AS (SELECT id, sum(n)::bigint AS n_features, floor(sum(n * gain)::double / sum(n))::bigint AS weight FROM n JOIN c USING (f) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY id),
scores AS (SELECT w.id AS doc_id, len(ws) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || w.id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint AS score FROM w LEFT JOIN weights USING (id) WHERE kind = 'd'),
ranks AS (SELECT *, CASE WHEN able THEN row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) END AS rank, count(*) FILTER (able) OVER () AS n FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM ranks
"""

WARC_ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages), top AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, octet_length(encode(h))::bigint AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, (k // 4 * 5 + 1)::int, 5))::bigint >> (15 - 5 * (k % 4))) & 31)::int + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to
FROM p JOIN top USING (h)
"""

QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_audio_features, op3_canonical_digest, op4_pii_deobfuscation, op5_bpe_speculate_verify, op6_line_template_tree, op7_secret_forest, op8_language_id, op9_best_fit_packing, op10_jaccard_join, op11_conversation_repair, op12_importance_resampling, op13_warc_revisits)}
ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": SUBSTRING_ORACLE, "op6_line_template_tree": LINES_ORACLE, "op10_jaccard_join": JACCARD_ORACLE, "op11_conversation_repair": REPAIR_ORACLE, "op12_importance_resampling": RESAMPLING_ORACLE, "op13_warc_revisits": WARC_ORACLE}
