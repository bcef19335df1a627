"""DuckDB SQL that checks queries of this package."""

FREQUENT_LINES = r"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
placed AS (SELECT doc_id, r, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM placed),
often AS (SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
judged AS (SELECT k.*, o.key IS NOT NULL AND k.doc_id IS DISTINCT FROM o.top AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r
"""

COLLOCATIONS = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, row_number() OVER () AS p, piece FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs)),
listed AS (SELECT lang, p, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
words AS (SELECT lang, p, generate_subscripts(w, 1) AS i, unnest(w) AS a FROM listed),
runs AS (SELECT lang, a, lead(a, 1) OVER s AS b, lead(a, 2) OVER s AS c FROM words WINDOW s AS (PARTITION BY p ORDER BY i)),
one AS (SELECT lang, a, count(*)::HUGEINT AS f FROM runs GROUP BY ALL),
two AS (SELECT lang, a, b, count(*)::HUGEINT AS f FROM runs WHERE b IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
three AS (SELECT lang, a, b, c, count(*)::HUGEINT AS f FROM runs WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT t.lang, t.a || ' ' || t.b AS phrase, t.f AS a, 1 AS k, x.f AS l, y.f AS r FROM two t JOIN one x ON x.lang = t.lang AND x.a = t.a JOIN one y ON y.lang = t.lang AND y.a = t.b
  UNION ALL SELECT t.lang, t.a || ' ' || t.b || ' ' || t.c, t.f, 1, x.f, y.f FROM three t JOIN one x ON x.lang = t.lang AND x.a = t.a JOIN two y ON y.lang = t.lang AND y.a = t.b AND y.b = t.c
  UNION ALL SELECT t.lang, t.a || ' ' || t.b || ' ' || t.c, t.f, 2, x.f, y.f FROM three t JOIN two x ON x.lang = t.lang AND x.a = t.a AND x.b = t.b JOIN one y ON y.lang = t.lang AND y.a = t.c),
scored AS (SELECT *, (1000000 * a * a) // (l * r) AS score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, a || ' ' || b AS phrase, f FROM three UNION ALL SELECT lang, b || ' ' || c, f FROM three) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT k.lang, k.rank::BIGINT AS rank, k.phrase, k.a::BIGINT AS a, k.l::BIGINT AS l, k.r::BIGINT AS r, n.n::BIGINT AS n, k.score::BIGINT AS score
FROM ranked k JOIN (SELECT lang, sum(f) AS n FROM one GROUP BY lang) n ON n.lang = k.lang WHERE k.rank <= 2000
"""
