"""SQL twins of the llm queries, where SQL can state them and is quick enough on whole tables."""

from __future__ import annotations

WIDTHLESS = r"[\x{00AD}\x{034F}\x{061C}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFF9}-\x{FFFB}\x{E0001}-\x{E01EF}]"
WIDE = r"[\x{FF01}-\x{FFBE}\x{FFC2}-\x{FFC7}\x{FFCA}-\x{FFCF}\x{FFD2}-\x{FFD7}\x{FFDA}-\x{FFDC}\x{FFE0}-\x{FFE6}\x{FFE8}-\x{FFEE}]"
LIGATURE = r"[\x{FB00}-\x{FB06}\x{FB13}-\x{FB17}\x{0132}\x{0133}]"
SPACE = r"[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"


SPANS = """base AS (SELECT DISTINCT doc_id, coalesce(page_id::VARCHAR, 'doc ' || doc_id) AS page, text FROM documents WHERE length(text) >= 200),
      w AS (SELECT doc_id, page, text, unnest(range(length(text) - 199)) AS i FROM base), h AS (SELECT doc_id, page, i, md5_number(substring(text, i + 1, 200)) AS h FROM w),
      shared AS (SELECT h FROM h GROUP BY h HAVING min(page) <> max(page)), hit AS (SELECT DISTINCT doc_id, i FROM h SEMI JOIN shared USING (h)),
      o AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS opens FROM hit), r AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
      spans AS (SELECT doc_id, min(i)::INT AS span_start, (max(i) + 200)::INT AS span_end FROM r GROUP BY doc_id, run)"""


def oracle_sql() -> dict[str, str]:
    bad = " OR ".join(f"regexp_matches(t, '{p}')" for p in (WIDTHLESS, WIDE, LIGATURE, SPACE))
    mixed = " OR ".join(
        f"list_bool_or(list_transform(regexp_extract_all(t, '\\p{{L}}+'), lambda w: regexp_matches(w, '\\p{{{a}}}') AND regexp_matches(w, '\\p{{{b}}}')))" for a, b in (("Latin", "Greek"), ("Latin", "Cyrillic"), ("Greek", "Cyrillic"))
    )
    return {
        "p1_found": r"""WITH w AS (SELECT DISTINCT doc_id, clause_id, regexp_extract_all(lower(clause_text), '[\p{L}\p{N}]+') AS w FROM clauses WHERE clause_text IS NOT NULL),
      s AS (SELECT row_number() OVER () AS id, doc_id, clause_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 12),
      x AS (SELECT id, len(g) AS n, unnest(g) AS g FROM s),
      f AS (SELECT g FROM x GROUP BY g HAVING count(*) > 1),
      r AS (SELECT x.* FROM x SEMI JOIN f USING (g)),
      p AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS o FROM r a JOIN r b ON a.g = b.g AND a.id < b.id AND least(a.n, b.n) * 5 >= greatest(a.n, b.n) * 3 GROUP BY ALL),
      k AS (SELECT x.doc_id AS d, x.clause_id AS c, y.doc_id AS e, y.clause_id AS f FROM p JOIN s x ON x.id = a JOIN s y ON y.id = b WHERE o * 5 >= (na + nb - o) * 3)
      SELECT DISTINCT CASE WHEN (d, c) < (e, f) THEN d ELSE e END AS a_doc_id, CASE WHEN (d, c) < (e, f) THEN c ELSE f END AS a_clause_id,
        CASE WHEN (d, c) < (e, f) THEN e ELSE d END AS b_doc_id, CASE WHEN (d, c) < (e, f) THEN f ELSE c END AS b_clause_id FROM k WHERE (d, c) <> (e, f)""",
        "p1_links": r"""WITH RECURSIVE v AS (SELECT DISTINCT doc_id, clause_id, regexp_extract_all(lower(clause_text), '[\p{L}\p{N}]+') AS w FROM clauses),
      m AS (SELECT DISTINCT doc_id, clause_id, md5(array_to_string(w, ' ')) AS class, coalesce(len(w) >= 12, FALSE) AS long FROM v),
      s AS (SELECT DISTINCT md5(array_to_string(w, ' ')) AS class, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM v WHERE len(w) >= 12),
      x AS (SELECT class, len(g) AS n, unnest(g) AS g FROM s),
      p AS (SELECT a.class AS a, b.class AS b, a.n AS na, b.n AS nb, count(*) AS o FROM x a JOIN x b ON a.g = b.g AND a.class < b.class AND least(a.n, b.n) * 5 >= greatest(a.n, b.n) * 3 GROUP BY ALL),
      k AS (SELECT a, b FROM p WHERE o * 5 >= (na + nb - o) * 3), e AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
      t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON e.a = t.b), groups AS (SELECT a AS class, least(a, min(b)) AS g FROM t GROUP BY a),
      sizes AS (SELECT class, count(*) AS n FROM m WHERE long GROUP BY ALL), near AS (SELECT e.a AS class, sum(n) AS n FROM e JOIN sizes ON sizes.class = e.b GROUP BY ALL)
      SELECT doc_id, clause_id, m.class AS class_id, CASE WHEN long THEN sizes.n - 1 + coalesce(near.n, 0) ELSE 0 END::BIGINT AS n_links, CASE WHEN long THEN coalesce(g, m.class) END AS group_id
      FROM m LEFT JOIN sizes ON sizes.class = m.class LEFT JOIN near ON near.class = m.class LEFT JOIN groups ON groups.class = m.class""",
        "p2_cover": """SELECT DISTINCT table_name, doc_id, item_id, length(text) AS n_chars, md5(text) AS text_hash, TRUE AS limited, TRUE AS overlaps, TRUE AS several FROM (SELECT 'chunks' AS table_name, doc_id, chunk_id AS item_id, text FROM chunks
      UNION ALL SELECT 'clauses', doc_id, clause_id, clause_text FROM clauses) WHERE greatest(1, length(text) // 4) > 512""",
        "p3_residue": f"""SELECT table_name, count(*) AS n, count(*) FILTER (nfc_normalize(t) <> t OR {bad} OR {mixed}) AS n_changed, 0 AS n_left FROM (SELECT 'cleaned' AS table_name, cleaned_text AS t FROM cleaned UNION ALL SELECT 'entities', entity_text FROM entities) GROUP BY ALL""",
        "p8_found": f"WITH {SPANS} SELECT doc_id, span_start, span_end FROM spans",
        "p8_shared": f"""WITH {SPANS}, n AS (SELECT doc_id, max(coalesce(length(text), 0)) AS n_chars FROM documents GROUP BY ALL), s AS (SELECT doc_id, sum(span_end - span_start)::BIGINT AS c, count(*) AS k FROM spans GROUP BY ALL)
      SELECT n.doc_id, n_chars, coalesce(c, 0) AS shared_chars, coalesce(k, 0) AS n_spans, CASE WHEN n_chars > 0 THEN round(coalesce(c, 0) / n_chars, 6) ELSE 0.0 END AS share FROM n LEFT JOIN s ON s.doc_id = n.doc_id""",
        "p2_found": """SELECT DISTINCT * FROM (SELECT 'chunks' AS table_name, doc_id, chunk_id AS item_id, text FROM chunks
      UNION ALL SELECT 'clauses', doc_id, clause_id, clause_text FROM clauses) WHERE greatest(1, length(text) // 4) > 512""".replace("SELECT DISTINCT *", "SELECT DISTINCT table_name, doc_id, item_id"),
        "p3_found": f"""SELECT DISTINCT table_name, doc_id, row_key FROM (SELECT 'cleaned' AS table_name, doc_id, doc_id AS row_key, cleaned_text AS t FROM cleaned
      UNION ALL SELECT 'entities', doc_id, entity_id, entity_text FROM entities) WHERE nfc_normalize(t) <> t OR {bad} OR {mixed}""",
        "p7_found": r"""WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
      iw AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) AS x FROM i WHERE len(w) >= 13),
      d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
      dw AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) AS x FROM d WHERE len(w) >= 13)
      SELECT DISTINCT item_id, doc_id FROM dw JOIN iw USING (x)""",
    }
