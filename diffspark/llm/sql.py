"""DuckDB SQL for the results of the registered queries that SQL can express."""

import re

from diffspark.llm.imatch import RATES
from diffspark.llm.secrets import RULES

OP3 = r"""
WITH lines AS (
  SELECT doc_id, line, pos,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM documents)),
frequent AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT l.doc_id, l.line, l.pos, f.key IS NOT NULL AS dropped FROM lines l LEFT JOIN frequent f ON l.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP6 = r"""
WITH sized AS (
  SELECT d.doc_id, d.source, CAST(length(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         coalesce(l.w, 1.0) AS w
  FROM documents d LEFT JOIN (
    SELECT doc_id, max(CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 END) AS w FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id),
sources AS (
  SELECT source, sum(size) AS source_size,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w
  FROM sized GROUP BY source),
ordered AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / w AS r FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ordered),
targets AS (
  SELECT source, source_size, least(cap, w * (SELECT level FROM levels WHERE level * w <= cap ORDER BY r LIMIT 1)) AS target FROM levels),
keyed AS (
  SELECT s.doc_id, s.size, s.source, CAST(t.source_size AS BIGINT) AS source_size, t.target,
         coalesce(floor(t.target / nullif(t.source_size, 0)), 0) AS q,
         -ln((('0x' || substr(md5('7|' || s.doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 1) / 4503599627370496.0::DOUBLE) / s.w AS k
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
run AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM keyed)
SELECT doc_id, size, source_size, target,
       CAST(size * (q + CASE WHEN before + size / 2.0::DOUBLE <= target - q * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM run
"""

OP2 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(length(w) - 4, 1) + 1)) AS i FROM words WHERE length(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(l.m, d.doc_id)) AS component_id,
       least(d.doc_id, coalesce(l.m, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.a = d.doc_id
"""

OP8 = """
WITH sized AS (SELECT doc_id, h, CAST(length(h) / 2 AS BIGINT) AS n FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)),
win AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS w FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 49, 0))) AS i FROM sized)),
firsts AS (SELECT w, min(doc_id) AS m FROM win GROUP BY w),
hits AS (SELECT a.doc_id, a.i FROM win a JOIN firsts f ON f.w = a.w WHERE f.m < a.doc_id),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM hits),
grouped AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked),
spans AS (SELECT doc_id, g, min(i) AS s, max(i) + 50 AS e FROM grouped GROUP BY doc_id, g),
pieces AS (
  SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS a, s AS z FROM spans
  UNION ALL SELECT d.doc_id, coalesce(max(p.e), 0), d.n FROM sized d LEFT JOIN spans p ON p.doc_id = d.doc_id GROUP BY d.doc_id, d.n),
kept AS (SELECT p.doc_id, string_agg(substr(d.h, 2 * p.a + 1, 2 * (p.z - p.a)), '' ORDER BY p.a) AS k FROM pieces p JOIN sized d ON d.doc_id = p.doc_id GROUP BY p.doc_id),
counts AS (SELECT doc_id, CAST(sum(e - s) AS BIGINT) AS gone, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(c.gone, 0) AS n_removed, coalesce(c.n_spans, 0) AS n_spans, sha256(unhex(k.k)) AS kept_sha256
FROM sized d JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN counts c ON c.doc_id = d.doc_id
"""


def imatch_sql(rates: tuple[float, ...] = RATES, seed: int = 7) -> str:
    """Fingerprints subset by subset: a row for each document, version and subset that keeps a term."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    keeps = "\n".join(
        f"  UNION ALL SELECT term, {k} FROM lexicon WHERE ('0x' || substr(md5('{seed}|{k // 8}|' || term), {1 + 4 * (k % 8)}, 4))::BIGINT < {int(rate * 65536)}" for k, rate in enumerate(rates)
    ).replace("  UNION ALL", "  ", 1)
    return f"""
WITH ordered AS (
  SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
         coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), first_value(doc_id) OVER (ORDER BY doc_id DESC)) AS next_id FROM documents),
edits AS (
  SELECT o.doc_id, o.text, o.n, o.next_id, substr(o.text, 1, o.n - CAST(floor(o.n / 3.0) AS BIGINT)) || substr(x.text, 1, CAST(floor(o.n / 3.0) AS BIGINT)) AS edited
  FROM ordered o JOIN ordered x ON x.doc_id = o.next_id),
versions AS (SELECT doc_id, 0 AS v, text AS t FROM edits UNION ALL SELECT doc_id, 1, edited FROM edits),
terms AS (SELECT DISTINCT doc_id, v, term FROM (SELECT doc_id, v, unnest(regexp_extract_all({lower.format("t")}, '[^\\x20\\x09-\\x0D]+')) AS term FROM versions)),
df AS (SELECT term, count(*) AS df FROM terms WHERE v = 0 GROUP BY term),
lexicon AS (SELECT term FROM df WHERE df >= 2 AND (SELECT count(*) FROM documents) >= df * 4 AND (SELECT count(*) FROM documents) <= df * 1024),
subsets(term, k) AS (
{keeps}),
hashes AS (SELECT t.doc_id, t.v, s.k, substr(md5(string_agg(t.term, ' ' ORDER BY t.term)), 1, 8) AS h FROM terms t JOIN subsets s ON s.term = t.term GROUP BY t.doc_id, t.v, s.k),
slots AS (SELECT d.doc_id, d.v, k.k FROM (SELECT DISTINCT doc_id, v FROM hashes) d, (SELECT unnest(range({len(rates)})) AS k) k),
prints AS (SELECT s.doc_id, s.v, string_agg(coalesce(h.h, '........'), '-' ORDER BY s.k) AS f FROM slots s LEFT JOIN hashes h ON h.doc_id = s.doc_id AND h.v = s.v AND h.k = s.k GROUP BY s.doc_id, s.v),
full_prints AS (SELECT v.doc_id, v.v, coalesce(p.f, 'all:' || md5({lower.format("v.t")})) AS f, p.f IS NULL AS plain FROM versions v LEFT JOIN prints p ON p.doc_id = v.doc_id AND p.v = v.v),
pairs AS (SELECT doc_id AS a, 0 AS av, doc_id AS b, 1 AS bv, 0 AS kind FROM edits UNION ALL SELECT doc_id, 0, next_id, 0, 1 FROM edits),
either AS (
  SELECT p.a, p.kind, count(*) AS used, count(*) FILTER (WHERE x.h = y.h) AS same
  FROM pairs p, (SELECT unnest(range({len(rates)})) AS k) s
  LEFT JOIN hashes x ON x.doc_id = p.a AND x.v = p.av AND x.k = s.k LEFT JOIN hashes y ON y.doc_id = p.b AND y.v = p.bv AND y.k = s.k
  WHERE x.h IS NOT NULL OR y.h IS NOT NULL GROUP BY p.a, p.kind),
near AS (
  SELECT p.a, p.kind, CASE WHEN x.f = y.f THEN 1.0::DOUBLE WHEN x.plain OR y.plain THEN 0.0::DOUBLE ELSE e.same / e.used::DOUBLE END AS likeness
  FROM pairs p JOIN full_prints x ON x.doc_id = p.a AND x.v = p.av JOIN full_prints y ON y.doc_id = p.b AND y.v = p.bv LEFT JOIN either e ON e.a = p.a AND e.kind = p.kind)
SELECT e.doc_id, e.n AS n_chars, sha256(e.edited) AS edited_sha256, f.f AS fingerprint, g.f AS edited_fingerprint, x.likeness AS near_edited, y.likeness AS near_next
FROM edits e JOIN full_prints f ON f.doc_id = e.doc_id AND f.v = 0 JOIN full_prints g ON g.doc_id = e.doc_id AND g.v = 1
JOIN near x ON x.a = e.doc_id AND x.kind = 0 JOIN near y ON y.a = e.doc_id AND y.kind = 1
"""


def secrets_sql() -> str:
    """Matches and what lies between them, rule by rule; (?i) is spelt out, as it may fold more than ASCII."""
    hits = []
    for k, r in enumerate(RULES):
        pattern = r.pattern
        if pattern.startswith("(?i)"):
            word, rest = pattern[4:].split(")", 1)
            pattern = re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", word) + ")" + rest
        pattern = pattern.replace("'", "''")
        hits.append(
            f"""  SELECT doc_id, {k} AS k, '{r.kind}' AS kind, {r.least} AS least, unnest(range(1, len(m) + 1)) AS i, unnest(g[1:len(m)]) AS gap, unnest(m) AS m, unnest(v) AS v
  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {r.group}) AS v, string_split_regex(t, '{pattern}') AS g FROM texts WHERE regexp_matches(t, '{pattern}'))"""
        )
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
hits AS (
{"""
  UNION ALL
""".join(hits)}),
placed AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i) AS e FROM hits),
spans AS (SELECT doc_id, k, kind, CAST(e - length(m) AS BIGINT) AS s, kind || ':' || CAST(e - length(m) AS BIGINT) || ':' || CAST(e AS BIGINT) AS said FROM placed WHERE length(v) >= least)
SELECT d.doc_id, count(s.k) FILTER (WHERE s.k = 0) AS n_assign, count(s.k) FILTER (WHERE s.k = 1) AS n_access, count(s.k) FILTER (WHERE s.k = 2) AS n_hex,
       sha256(coalesce(string_agg(s.said, ',' ORDER BY s.s, s.k) FILTER (WHERE s.k < 3), '')) AS base_sha256, coalesce(string_agg(s.said, ',' ORDER BY s.s, s.k), '') AS spans
FROM texts d LEFT JOIN spans s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""


# What four bits add to a CRC-32 (polynomial 0xEDB88320, reflected).
CRC = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]::BIGINT[]"

#: Half a byte at a time, low half first; two words are one edit apart if deleting one place of each, or of the longer one alone, makes them equal.
OP13 = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
keyed AS (SELECT w, count(*) AS c, regexp_replace(hex(encode(doc_id || ':' || w)), '(.)(.)', '\\2\\1', 'g') AS x FROM runs WHERE length(w) >= 6 GROUP BY doc_id, w),
halves AS (SELECT w, c, list_transform(string_split(x, ''), lambda q: CAST(strpos('0123456789ABCDEF', q) - 1 AS BIGINT)) AS b FROM keyed),
hashed AS (
  SELECT w, c, xor(4294967295, list_reduce(b, lambda a, q: xor(a >> 4, ({CRC})[CAST(xor(a & 15, q) + 1 AS BIGINT)]), 4294967295::BIGINT)) AS h FROM halves),
edited AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM hashed),
vocab AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM edited WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.d = b.d AND a.i = b.i WHERE a.word <> b.word
  UNION SELECT c.word, c.n, v.word, v.n FROM cut c JOIN vocab v ON v.word = c.d
  UNION SELECT v.word, v.n, c.word, c.n FROM cut c JOIN vocab v ON v.word = c.d),
best AS (SELECT word, n, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word, n),
forms AS (
  SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 5 * v.n THEN b.other END AS form, CASE WHEN b.other_n >= 5 * v.n THEN b.other_n END AS form_n
  FROM vocab v LEFT JOIN best b ON b.word = v.word),
chain AS (
  SELECT word, form AS root, 1 AS steps FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT c.word, f.form, c.steps + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY word)
SELECT f.word, f.form, coalesce(r.root, f.word) AS root, f.n, f.n_near, f.form_n FROM forms f LEFT JOIN roots r ON r.word = f.word
"""


SQL = {"op2_minhash": OP2, "op3_line_dedup": OP3, "op6_mixing": OP6, "op8_suffix_dedup": OP8, "op10_imatch": imatch_sql(), "op11_secrets": secrets_sql(), "op13_spelling": OP13}
