"""DuckDB SQL for the queries that SQL can express; brute force over whole tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"



def _near(words: int, kept: str) -> str:
    """Groups of texts whose sets of shingles of ``words`` words are 80 % similar; ``kept`` is one more column or nothing."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + least({words}, len(w)) - 1) AS g
  FROM d, unnest(generate_series(1, len(w) - least({words}, len(w)) + 1)) AS t(i) WHERE len(w) > 0
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n AS x ON x.doc_id = a.doc_id JOIN n AS y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach AS r JOIN links AS l ON l.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id{kept}
FROM documents LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)"""


NEAR_DUPLICATES = _near(2, ", doc_id = component_id AS kept")
JACCARD_JOIN = _near(5, "")

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
phrases AS (
  SELECT DISTINCT item, n, list_slice(w, i, i + n - 1) AS phrase
  FROM (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0) AS x, unnest(generate_series(1, len(w) - n + 1)) AS t(i)
),
windows AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS phrase
  FROM d, (SELECT DISTINCT n FROM phrases) AS sizes, unnest(generate_series(1, len(w) - n + 1)) AS t(i)
),
hits AS (SELECT doc_id, i, n, item FROM windows JOIN phrases USING (n, phrase)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(generate_series(i, i + n - 1)) AS t(p) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""

LINE_DEDUP = f"""
WITH split AS (SELECT doc_id, u.line, u.n - 1 AS number, regexp_extract_all({_LOWER.replace('text', 'u.line')}, {_SPACED}) AS w
  FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, n)),
worded AS (
  SELECT doc_id, number, array_to_string(w, ' ') AS line, row_number() OVER o AS i, sum(len(w)) OVER o AS upto, len(w) AS words
  FROM split WHERE len(w) > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY number)
),
long AS (
  SELECT a.doc_id, a.i AS first_i, b.i AS last_i FROM worded AS a JOIN worded AS b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.words >= 50
),
ends AS (
  SELECT doc_id, first_i, min(last_i) AS last_i FROM long GROUP BY doc_id, first_i
  UNION SELECT doc_id, max(first_i), last_i FROM long GROUP BY doc_id, last_i
),
windows AS (
  SELECT e.doc_id, min(w.number) AS first, max(w.number) AS last, string_agg(w.line, chr(10) ORDER BY w.i) AS content
  FROM ends AS e JOIN worded AS w ON w.doc_id = e.doc_id AND w.i BETWEEN e.first_i AND e.last_i GROUP BY e.doc_id, e.first_i, e.last_i
),
later AS (SELECT doc_id, first, last FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, first) AS k FROM windows) AS r WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, number FROM later, unnest(generate_series(first, last)) AS t(number)),
runs AS (
  SELECT doc_id, string_agg(concat(a, '-', b), ',' ORDER BY a) AS deleted, sum(b - a + 1) AS n FROM (
    SELECT doc_id, min(number) AS a, max(number) AS b
    FROM (SELECT doc_id, number, number - row_number() OVER (PARTITION BY doc_id ORDER BY number) AS island FROM gone) AS g GROUP BY doc_id, island
  ) AS islands GROUP BY doc_id
),
rest AS (SELECT s.doc_id, string_agg(s.line, chr(10) ORDER BY s.number) AS text FROM split AS s ANTI JOIN gone AS g ON s.doc_id = g.doc_id AND s.number = g.number GROUP BY s.doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_deleted, coalesce(deleted, '') AS deleted, sha256(coalesce(rest.text, '')) AS text_sha256
FROM documents AS d LEFT JOIN runs USING (doc_id) LEFT JOIN rest USING (doc_id)"""

_FIVE = " + ".join(f"CAST(substr(bits, k * 5 + {i + 1}, 1) AS INTEGER) * {16 >> i}" for i in range(5))

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(CAST(unhex(sha1(coalesce(html, ''))) AS BIT) AS VARCHAR) AS bits FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS largest FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', {_FIVE} + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM q"""

FILL_IN_MIDDLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
),
h AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d
),
c AS (
  SELECT doc_id, text, n, u, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
),
p AS (
  SELECT doc_id, text, n, form, array_to_string(list_slice(u, 1, a), '') AS pre, array_to_string(list_slice(u, a + 1, b), '') AS mid,
    array_to_string(list_slice(u, b + 1, n), '') AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p"""

ORACLES = {
    "op1_near_duplicates": NEAR_DUPLICATES,
    "op2_decontamination": DECONTAMINATION,
    "op5_line_dedup": LINE_DEDUP,
    "op7_warc": WARC,
    "op11_fill_in_middle": FILL_IN_MIDDLE,
    "op12_jaccard_join": JACCARD_JOIN,
}
