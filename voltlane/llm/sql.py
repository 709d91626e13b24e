"""The same questions as DuckDB SQL, for the operators that SQL can express. Every constant is spelled out here."""

SQL: dict[str, str] = {}

SQL["op11_fill_in_middle"] = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || doc_id::VARCHAR) AS h
  FROM documents),
ranks AS (
  SELECT doc_id, t, n, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS r1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS r2,
    ('0x' || substr(h, 17, 8))::BIGINT % 100 AS p3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS p4
  FROM drawn),
formed AS (
  SELECT *, least(r1, r2) AS a, greatest(r1, r2) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR p3 >= 90 THEN 'plain'
         WHEN p4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM ranks),
parts AS (
  SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1, n - b) AS suffix FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256
FROM parts
"""

SQL["op13_line_dedup"] = """
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM cut),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
keys AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT keyed.*, last IS NOT NULL AND doc_id < last AS gone FROM keyed LEFT JOIN keys USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_grams = " UNION ALL ".join(
    f"SELECT lang, w[i:i + {k - 1}] AS p FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM pieces WHERE len(w) >= {k})"
    for k in range(1, 6))
SQL["op12_phrase_collocations"] = f"""
WITH cut AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
pieces AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM cut),
size AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM pieces GROUP BY lang),
counted AS (SELECT lang, p, count(*)::HUGEINT AS f FROM ({_grams}) GROUP BY lang, p HAVING count(*) >= 100),
cuts AS (SELECT lang, p, f AS a, unnest(range(1, len(p))) AS k FROM counted WHERE len(p) > 1),
scored AS (
  SELECT c.lang, c.p, c.a, k, x.f AS l, y.f AS r, n, (1000 * a * n) // (x.f * y.f) AS score
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN counted y ON y.lang = c.lang AND y.p = c.p[k + 1:]
  JOIN size s ON s.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inside AS (
  SELECT DISTINCT lang, q FROM (
    SELECT lang, p[1:len(p) - 1] AS q, f FROM counted WHERE len(p) > 2
    UNION ALL SELECT lang, p[2:] AS q, f FROM counted WHERE len(p) > 2) u
  WHERE EXISTS (SELECT 1 FROM counted c WHERE c.lang = u.lang AND c.p = u.q AND 100 * u.f >= 100 * c.f)),
named AS (
  SELECT l.*, array_to_string(p, ' ') AS phrase FROM lowest l
  WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = l.lang AND i.q = l.p)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM named)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""
