"""SQL twins of the document and graph queries, for DuckDB on the same tables."""

from __future__ import annotations

from lexmill.functions import vocab

#: White space as Python has it, inside a class; and the same without the line end.
SP = r"\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
GAP = SP.replace(r"\n", "")


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '\\A[{SP}]+|[{SP}]+\\z', '', 'g')"


def words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '[{SP}]+'), lambda w: w <> '')"


TEXTS = "texts AS (SELECT doc_id, title, cleaned_text FROM cleaned QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ingested_at DESC) = 1)"
CLAUSES = "c AS (SELECT doc_id, clause_id, ord, section_id, section_title, clause_text FROM clauses QUALIFY row_number() OVER (PARTITION BY doc_id, clause_id ORDER BY ingested_at DESC) = 1)"
LINES = """cut AS (SELECT doc_id, string_split(cleaned_text, chr(10)) AS ls FROM texts WHERE cleaned_text IS NOT NULL),
      flat AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM cut),
      lines AS (SELECT doc_id, line_no, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_char, line FROM flat)"""


def clean_text() -> str:
    steps = ["replace(replace({t}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"]
    lig = "{t}"
    for sign, letters in vocab.LIGATURES.items():
        lig = f"replace({lig}, {q(sign)}, {q(letters)})"
    steps += [lig, "nfc_normalize({t})", f"regexp_replace({{t}}, '(?m)[{GAP}]+$', '', 'g')"]
    # three sentinels stand for what look-behind would tell
    blank = "CASE WHEN regexp_matches({t}, '\\A\\n{2,}\\z') THEN chr(10) ELSE regexp_replace(regexp_replace(regexp_replace({t}, '\\A\\n{3,}', chr(10) || chr(10)), '\\n{3,}\\z', chr(10) || chr(10)), '([^\\n])\\n{4,}([^\\n])', '\\1' || chr(10) || chr(10) || chr(10) || '\\2', 'g') END"
    steps.append(blank)
    ctes, notes = [TEXTS, "s0 AS (SELECT doc_id, cleaned_text AS t0 FROM texts)"], []
    for k, (step, note) in enumerate(zip(steps, vocab.NOTES.values())):
        ctes.append(f"s{k + 1} AS (SELECT *, {step.replace('{t}', f't{k}')} AS t{k + 1} FROM s{k})")
        notes.append(f"CASE WHEN t{k} <> t{k + 1} THEN {q(note)} END")
    return f"WITH {', '.join(ctes)} SELECT doc_id, t5 AS cleaned_text, array_to_string(list_filter([{', '.join(notes)}], lambda x: x IS NOT NULL), '; ') AS notes FROM s5"


def headings_cte() -> str:
    n = rf"^(\p{{Nd}}+(?:\.\p{{Nd}}+)*)\.?[{SP}]+((?s:.+))\z"
    roman = rf"(?i)^({vocab.ROMAN})\.?[{SP}]+((?s:.+))\z"
    marks = rf"^(#{{1,6}})[{SP}]+((?s:.+))\z"
    word = "[A-Z][A-Za-z0-9''&()/\\-]"
    letters = lambda c: f"length(regexp_replace({c}, '[^\\p{{L}}]', '', 'g'))"
    rest, colon = f"regexp_extract(s, '{n}', 2)", "regexp_extract(s, '^([^\\n:]{1,80}):\\z', 1)"
    body, first = strip(colon), f"{words(f'regexp_extract(s, {q(n)}, 2)')}[1]"
    return f"""{TEXTS}, {LINES},
      near AS (SELECT *, {strip("line")} AS s, lag(line) OVER w AS b, lead(line) OVER w AS a FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
      parts AS (SELECT *, {rest} AS rest, {first} AS first, {body} AS body, {colon} AS colon, len({words("s")}) AS nw FROM near WHERE s <> '' AND length(s) <= 120),
      styled AS (SELECT *, CASE
        WHEN regexp_matches(s, '{marks}') THEN 'markdown'
        WHEN rest <> '' AND NOT ends_with(rest, '.') AND ((regexp_matches(first, '\\p{{Lu}}') AND NOT regexp_matches(first, '[\\p{{Ll}}\\p{{Lt}}]') AND length(first) > 1) OR regexp_matches(rest, '^\\p{{Lu}}')) THEN 'numbered'
        WHEN regexp_extract(s, '{roman}', 1) <> '' AND regexp_matches(regexp_extract(s, '{roman}', 2), '^\\p{{Lu}}') THEN 'roman'
        WHEN {letters("s")} >= 2 AND regexp_matches(s, '^[ A-Z0-9\\-&.,''()/]+\\z') AND NOT (ends_with(s, '.') AND nw > 8) THEN 'uppercase'
        WHEN body <> '' AND NOT ends_with(body, '.') AND {letters("body")} >= 2 THEN 'colon'
        WHEN length(s) BETWEEN 3 AND 80 AND NOT ends_with(s, '.') AND nw <= 12
          AND (regexp_matches(s, '^{word}+(?:[{SP}]+{word}+){{0,8}}\\z') OR regexp_matches(s, '^{word}*(?:[{SP}]+[A-Za-z0-9''&()/\\-]+){{0,11}}[?]?\\z'))
          AND {strip("b")} = '' AND {strip("a")} = '' THEN 'standalone' END AS style FROM parts),
      headings AS (SELECT doc_id, line_no, start_char, style,
        CASE style WHEN 'markdown' THEN length(regexp_extract(s, '{marks}', 1)) WHEN 'numbered' THEN length(regexp_replace(regexp_extract(s, '{n}', 1), '[^.]', '', 'g')) + 1 ELSE 1 END AS level,
        CASE style WHEN 'markdown' THEN regexp_extract(s, '{marks}', 2) WHEN 'colon' THEN colon ELSE s END AS title FROM styled WHERE style IS NOT NULL)"""


def sections_cte() -> str:
    return f"""{headings_cte()},
      starts AS (SELECT doc_id, start_char AS span_start, level, title, TRUE AS headed FROM headings
        UNION ALL SELECT doc_id, 0, 1, NULL, FALSE FROM texts t WHERE cleaned_text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM headings h WHERE h.doc_id = t.doc_id AND h.start_char = 0)),
      no AS (SELECT *, row_number() OVER w AS section_no, lead(span_start) OVER w AS next FROM starts WINDOW w AS (PARTITION BY doc_id ORDER BY span_start)),
      secs AS (SELECT n.doc_id, section_no, printf('S%03d', section_no) AS section_id, n.title, substr(cleaned_text, span_start + 1, coalesce(next, length(cleaned_text)) - span_start) AS text,
        span_start, coalesce(next, length(cleaned_text)) AS span_end, level,
        CASE WHEN headed THEN (SELECT printf('S%03d', max(m.section_no)) FROM no m WHERE m.doc_id = n.doc_id AND m.headed AND m.section_no < n.section_no AND m.level < n.level) END AS parent_section_id
        FROM no n JOIN texts t ON t.doc_id = n.doc_id)"""


def spans_cte(patterns: list[tuple]) -> str:
    """spans (doc_id, clause_id, pattern_no, s, e, t) of all patterns over c."""
    rows = ", ".join(f"({k}, {q(p)})" for k, p in enumerate(patterns))
    return f"""pats(pattern_no, re) AS (VALUES {rows}),
      cut AS (SELECT doc_id, clause_id, pattern_no, string_split(regexp_replace(clause_text, re, chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS p FROM c, pats WHERE regexp_matches(clause_text, re)),
      hit AS (SELECT doc_id, clause_id, pattern_no, p, unnest(range(2, len(p) + 1)) AS i FROM cut),
      spans AS (SELECT doc_id, clause_id, pattern_no, split_part(p[i], chr(2), 1) AS t, list_sum(list_transform(p[1:i - 1], lambda x: length(replace(x, chr(2), '')))) AS s FROM hit)"""


def re2(pattern: str) -> str:
    """A pattern of ours in the other dialect."""
    return pattern.replace("(?iuU)", "(?i)").replace("(?U)", "").replace(r"[\s\x1c-\x1f]", f"[{SP}]").replace(r"\d", r"\p{Nd}")


def references_cte() -> str:
    kinds = "[" + ", ".join(q(t) for _, t in vocab.REFERENCES) + "]"
    return f"""{CLAUSES}, {spans_cte([re2(p) for p, _ in vocab.REFERENCES]).replace("hit AS", "rhit AS").replace("FROM hit)", "FROM rhit)").replace("spans AS", "rspans AS").replace("cut AS", "rcut AS").replace("FROM cut)", "FROM rcut)").replace("pats(", "rpats(").replace("c, pats", "c, rpats")},
      ronce AS (SELECT * FROM rspans QUALIFY row_number() OVER (PARTITION BY doc_id, clause_id, s, length(t) ORDER BY pattern_no) = 1),
      refs AS (SELECT doc_id, clause_id, row_number() OVER (PARTITION BY doc_id, clause_id ORDER BY s, pattern_no, length(t)) - 1 AS ref_no, t AS reference_text, ({kinds})[pattern_no + 1] AS reference_type, s AS ref_start, s + length(t) AS ref_end FROM ronce)"""


def entities_cte() -> str:
    rules = [(k, r"(?i)\b" + t + r"\b", kind, method, 0.95) for k, (terms, kind, method) in enumerate(vocab.DICTIONARIES) for t in terms]
    rules += [(3, re2(p), kind, method, conf) for p, kind, method, conf in vocab.TIMES]
    # a boundary of this dialect knows ASCII only
    word = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}]"
    info = ", ".join(f"({k}, {r[0]}, {q(r[2])}, {q(r[3])}, {r[4]})" for k, r in enumerate(rules))
    return f"""{references_cte()}, {spans_cte([r[1] for r in rules])},
      info(pattern_no, detector_no, entity_type, detection_method, confidence) AS (VALUES {info}),
      own AS (SELECT doc_id, clause_id, detector_no, pattern_no, s AS start_offset, s + length(t) AS end_offset, t AS entity_text, entity_type, CAST(confidence AS DOUBLE) AS confidence, detection_method FROM spans JOIN info USING (pattern_no) JOIN c USING (doc_id, clause_id)
        WHERE NOT regexp_matches(substr(clause_text, s::BIGINT, 1), '{word}') AND NOT regexp_matches(substr(clause_text, (s + length(t) + 1)::BIGINT, 1), '{word}') QUALIFY row_number() OVER (PARTITION BY doc_id, clause_id, detector_no, s, length(t) ORDER BY pattern_no) = 1),
      alle AS (SELECT * FROM own UNION ALL SELECT doc_id, clause_id, 4, 1000 + ref_no, ref_start, ref_end, reference_text, 'LAW_REFERENCE', 1.0, 'reference_detector' FROM refs),
      raw AS (SELECT a.*, printf('E%03d', row_number() OVER (PARTITION BY a.doc_id ORDER BY ord, a.clause_id, detector_no, pattern_no, start_offset)) AS entity_id FROM alle a JOIN c ON c.doc_id = a.doc_id AND c.clause_id = a.clause_id),
      merged AS (SELECT * FROM (SELECT *, max(end_offset) OVER (PARTITION BY doc_id, clause_id ORDER BY start_offset, end_offset DESC, detector_no, pattern_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cover FROM raw) WHERE cover IS NULL OR end_offset > cover)"""


def roles_cte() -> str:
    verbs = ", ".join(q(v) for v in vocab.VERBS)
    edge = "[.,;:!?()\\[\\]{}''\"]+"
    return f"""stripped AS (SELECT *, coalesce({strip("clause_text")}, '') AS s FROM c),
      facts AS (SELECT *, len({words("s")}) AS n, list_has_any(list_transform({words("lower(s)")}, lambda w: regexp_replace(w, '\\A{edge}|{edge}\\z', '', 'g')), [{verbs}]) AS verb,
        coalesce(section_title <> '' AND contains(lower(s), lower(section_title)), FALSE) AS titled, regexp_matches(s, '^\\p{{Lu}}') AS up,
        regexp_matches(s, '^[•\\-*–][{SP}]|^\\p{{Nd}}+[.)][{SP}]|^\\(?[a-z]\\)[{SP}]') AS listed FROM stripped),
      kinds AS (SELECT *, CASE WHEN s = '' THEN 1 WHEN listed THEN 2 WHEN n <= 4 AND (titled OR (up AND NOT verb)) THEN 3 WHEN verb THEN 4 WHEN n > 4 THEN 5 ELSE 6 END AS k FROM facts),
      roles AS (SELECT *, (['UNKNOWN', 'LIST_ITEM', 'HEADING', 'STATEMENT', 'STATEMENT', 'UNKNOWN'])[k] AS role,
        CAST(CASE k WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 WHEN 3 THEN CASE WHEN titled THEN 0.95 ELSE 0.85 END WHEN 4 THEN 0.92 WHEN 5 THEN 0.65 ELSE 0.5 END AS DOUBLE) AS confidence,
        CASE k WHEN 1 THEN 'empty_text' WHEN 2 THEN 'list_marker_detected' WHEN 3 THEN 'short_text' || CASE WHEN titled THEN ',matches_section_title' ELSE '' END || CASE WHEN up THEN ',title_case' ELSE '' END || CASE WHEN verb THEN '' ELSE ',no_verb' END
          WHEN 4 THEN 'contains_verb' WHEN 5 THEN 'long_text' ELSE 'no_heuristic_match' END AS reasons FROM kinds)"""


def hierarchy_cte(clauses: str = CLAUSES) -> str:
    first_word = f"regexp_replace(lower({words('st')}[1]), '\\.+\\z', '')"
    number = f"regexp_extract(st, '^(\\p{{Nd}}+(?:\\.\\p{{Nd}}+)*)\\.?[{SP}]', 1)"
    chapters = ", ".join(q(w) for w in vocab.CHAPTER_WORDS)
    return f"""{TEXTS}, {clauses},
      h0 AS (SELECT *, coalesce({strip("section_title")}, '') AS st, row_number() OVER (PARTITION BY doc_id ORDER BY ord, clause_id) AS k, row_number() OVER (PARTITION BY doc_id, section_id ORDER BY ord, clause_id) = 1 AS opens FROM c),
      h1 AS (SELECT *, CASE WHEN st = '' THEN 'Section' WHEN {first_word} IN ({chapters}) THEN 'Chapter' WHEN contains({number}, '.') THEN 'SubSection' ELSE 'Section' END AS label,
        CASE WHEN {number} <> '' THEN {number} ELSE regexp_extract(st, '{re2(vocab.CHAPTER_NUMBER)}', 1) END AS number FROM h0),
      h2 AS (SELECT *, lower(label) || '_' || section_id AS node, CASE label WHEN 'Chapter' THEN 1 WHEN 'Section' THEN 2 ELSE 3 END AS level FROM h1),
      op AS (SELECT * FROM h2 WHERE opens),
      he AS (SELECT doc_id, 2 * k AS ord, coalesce((SELECT arg_max(o.node, o.k) FROM op o WHERE o.doc_id = p.doc_id AND o.k < p.k AND o.level < p.level), 'law_' || doc_id) AS source, node AS target, 'HAS_' || upper(label) AS type FROM op p),
      ce AS (SELECT doc_id, 2 * k + 1 AS ord, last_value(CASE WHEN opens THEN node END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS source, 'clause_' || clause_id AS target, 'HAS_CLAUSE' AS type FROM h2),
      edges0 AS (SELECT * FROM he UNION ALL SELECT * FROM ce),
      nodes0 AS (SELECT DISTINCT c.doc_id, 0 AS ord, 'law_' || c.doc_id AS id, 'LawVersion' AS label, '' AS number, coalesce(t.title, '') AS title, '' AS identifier, '' AS clause_id, c.doc_id AS law_code, '' AS reference_type FROM c LEFT JOIN texts t ON t.doc_id = c.doc_id
        UNION ALL SELECT doc_id, 2 * k, node, label, CASE WHEN level < 3 THEN number ELSE '' END, CASE WHEN level < 3 THEN coalesce(section_title, '') ELSE '' END, CASE WHEN level = 3 THEN coalesce(section_title, '') ELSE '' END, '', '', '' FROM op
        UNION ALL SELECT doc_id, 2 * k + 1, 'clause_' || clause_id, 'Clause', '', '', '', clause_id, '', '' FROM h2)"""


def resolver_cte() -> str:
    fb = spans_cte([re2(p) for p, _ in vocab.FALLBACK_REFERENCES])
    kinds = "[" + ", ".join(q(t) for _, t in vocab.FALLBACK_REFERENCES) + "]"
    ref_value = r"""CASE WHEN reference_type = 'subsection' THEN regexp_extract(reference_text, '\((\d+|[a-z])\)', 1) WHEN reference_type IN ('section', 'clause', 'rule', 'article', 'regulation') THEN regexp_extract(reference_text, '(\d+[A-Z]?(?:-[A-Za-z])?)', 1)
          WHEN reference_type IN ('chapter', 'schedule', 'part') THEN upper(regexp_extract(reference_text, '(?i)\b([IVXLCDM]+)\b', 1)) ELSE '' END"""
    return f"""{hierarchy_cte(references_cte())}, {fb},
      given AS (SELECT doc_id, clause_id, reference_type AS kind, coalesce(nullif({ref_value}, ''), reference_text) AS value, reference_text AS ref_text, ref_start, ref_end, ref_no AS seq FROM refs
        UNION ALL SELECT doc_id, clause_id, ({kinds})[pattern_no + 1], CASE pattern_no WHEN 0 THEN regexp_extract(t, '(?i)part[{SP}]+(.+)\\z', 1) WHEN 1 THEN regexp_extract(t, '\\((.)\\)', 1) ELSE t END, t, s, s + length(t), 1000000 + pattern_no FROM spans),
      collected AS (SELECT * FROM given QUALIFY row_number() OVER (PARTITION BY doc_id, clause_id, ref_start, ref_end ORDER BY seq) = 1),
      ix0 AS (SELECT doc_id, ord, 0 AS turn, id, lower(label) AS kind, lower(number) AS key FROM nodes0 WHERE label IN ('Section', 'Chapter')
        UNION ALL SELECT doc_id, ord, 0, id, 'subsection', CASE WHEN regexp_extract(identifier, '\\((\\d+|[a-z])\\)', 1) <> '' THEN regexp_extract(identifier, '\\((\\d+|[a-z])\\)', 1) ELSE regexp_extract(identifier, '(\\d+(?:\\.\\d+)*)', 1) END FROM nodes0 WHERE label = 'SubSection'
        UNION ALL SELECT doc_id, ord, 1, id, 'subsection', lower(identifier) FROM nodes0 WHERE label = 'SubSection'
        UNION ALL SELECT doc_id, ord, 0, id, 'law', lower(law_code) FROM nodes0 WHERE label = 'LawVersion'),
      ix AS (SELECT doc_id, kind, key, arg_max(id, (ord, turn, id)) AS target FROM ix0 WHERE key <> '' GROUP BY ALL),
      ti0 AS (SELECT doc_id, lower(title) AS title, min(ord) AS f, arg_max(id, ord) AS id FROM nodes0 WHERE title <> '' GROUP BY ALL),
      ti AS (SELECT doc_id, kw AS kind, arg_min(id, (f, id)) AS target FROM ti0, (VALUES ('explanation'), ('proviso')) v(kw) WHERE contains(title, kw) GROUP BY ALL),
      look AS (SELECT *, lower(value) AS key, CASE WHEN kind IN ('article', 'part') THEN 'chapter' WHEN kind = 'act' THEN 'law' WHEN kind IN ('section', 'chapter', 'subsection', 'clause') THEN kind END AS k1,
        CASE WHEN kind IN ('article', 'part') THEN 'section' WHEN kind = 'subsection' THEN kind END AS k2, CASE WHEN kind = 'subsection' THEN regexp_extract(lower(value), '\\((\\d+|[a-z])\\)', 1) ELSE lower(value) END AS v2 FROM collected),
      res AS (SELECT l.doc_id, l.clause_id, l.kind, l.value, l.ref_text, l.ref_start, l.seq, c.ord AS clause_ord, 'clause_' || l.clause_id AS source, coalesce(a.target, b.target, ti.target) AS target FROM look l JOIN c ON c.doc_id = l.doc_id AND c.clause_id = l.clause_id
        LEFT JOIN ix a ON a.doc_id = l.doc_id AND a.kind = l.k1 AND a.key = l.key LEFT JOIN ix b ON b.doc_id = l.doc_id AND b.kind = l.k2 AND b.key = l.v2 LEFT JOIN ti ON ti.doc_id = l.doc_id AND ti.kind = l.kind),
      lk AS (SELECT DISTINCT doc_id, clause_id, source, coalesce(target, 'unresolved_' || clause_id || '_' || kind || '_' || lower(regexp_replace(value, '[^a-zA-Z0-9]', '_', 'g'))) AS t, CASE WHEN target IS NULL THEN 'UNRESOLVED_REFERENCE' ELSE 'REFERENCES' END AS type FROM res WHERE target IS NULL OR target <> source),
      nodes1 AS (SELECT doc_id, id, label FROM nodes0 UNION ALL SELECT DISTINCT doc_id, t, 'UnresolvedReference' FROM lk WHERE type = 'UNRESOLVED_REFERENCE'),
      edges1 AS (SELECT doc_id, source, target, type FROM edges0 UNION ALL SELECT doc_id, source, t, type FROM lk)"""


def oracle_sql() -> dict[str, str]:
    ent = "doc_id, clause_id, entity_id, entity_text, entity_type, start_offset, end_offset, confidence, detection_method"
    top = lambda name, text, order: f"{name} AS (SELECT doc_id, clause_id, array_to_string(list({text} ORDER BY r), ',') AS v FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, clause_id ORDER BY {order}) AS r FROM {'merged' if name == 'te' else 'refs'}) WHERE r <= 8 GROUP BY ALL)"
    rename = lambda column, names: f"CASE {column} {' '.join(f'WHEN {q(a)} THEN {q(b)}' for a, b in names.items())} ELSE {column} END"
    allowed = lambda names: ", ".join(q(n) for n in names)
    named = "coalesce(source, 'null') || ' ' || coalesce(type, 'null') || ' ' || coalesce(target, 'null')"
    broken = lambda nodes, edges: f"""
        SELECT doc_id, 'unknown_label' AS rule, id AS subject FROM {nodes} WHERE label NOT IN ({allowed(vocab.NODE_LABELS)})
        UNION ALL SELECT doc_id, 'empty_graph', '' FROM texts t WHERE NOT EXISTS (SELECT 1 FROM {nodes} n WHERE n.doc_id = t.doc_id)
        UNION ALL SELECT doc_id, 'duplicate_id', id FROM {nodes} GROUP BY ALL HAVING count(*) > 1
        UNION ALL SELECT doc_id, 'unknown_type', {named} FROM {edges} WHERE type IS NULL OR type NOT IN ({allowed(vocab.RELATIONSHIP_TYPES)})
        UNION ALL SELECT doc_id, 'dangling_source', {named} FROM {edges} e WHERE NOT EXISTS (SELECT 1 FROM {nodes} n WHERE n.doc_id = e.doc_id AND n.id = e.source)
        UNION ALL SELECT doc_id, 'dangling_target', {named} FROM {edges} e WHERE NOT EXISTS (SELECT 1 FROM {nodes} n WHERE n.doc_id = e.doc_id AND n.id = e.target)
        UNION ALL SELECT doc_id, 'self_loop', {named} FROM {edges} WHERE source = target"""  # noqa: E731
    stored = "stored AS (SELECT doc_id, ord, source, target, rel_type AS type FROM edges QUALIFY row_number() OVER (PARTITION BY doc_id, ord ORDER BY ingested_at DESC) = 1)"
    j = lambda x: f"coalesce(to_json({x})::VARCHAR, 'null')"
    own = f"""CASE label WHEN 'LawVersion' THEN '"law_code":' || {j("law_code")} || ',"title":' || {j("title")} WHEN 'SubSection' THEN '"identifier":' || {j("identifier")}
        WHEN 'Clause' THEN '"clause_id":' || {j("clause_id")} || ',"text":' || {j("source_clause")} || ',"confidence":"1.0"' WHEN 'UnresolvedReference' THEN '"reference_text":' || {j("number")} || ',"reference_type":' || {j("reference_type")} || ',"clause_id":' || {j("clause_id")}
        ELSE '"number":' || {j("number")} || ',"title":' || {j("title")} END"""
    statements = f"""lkd AS (SELECT *, coalesce(target, 'unresolved_' || clause_id || '_' || kind || '_' || lower(regexp_replace(value, '[^a-zA-Z0-9]', '_', 'g'))) AS t, CASE WHEN target IS NULL THEN 'UNRESOLVED_REFERENCE' ELSE 'REFERENCES' END AS type FROM res
        WHERE target IS NULL OR target <> source QUALIFY row_number() OVER (PARTITION BY doc_id, source, t, type ORDER BY clause_ord, ref_start, seq) = 1),
      nn AS (SELECT n.doc_id, n.ord, n.id, n.label, n.number, n.title, n.identifier, n.clause_id, n.law_code, n.reference_type, c.clause_text AS source_clause FROM nodes0 n LEFT JOIN c ON n.label = 'Clause' AND c.doc_id = n.doc_id AND c.clause_id = n.clause_id
        UNION ALL SELECT doc_id, (1 << 30) + clause_ord, t, 'UnresolvedReference', ref_text, '', '', clause_id, '', kind, clause_id FROM lkd WHERE target IS NULL),
      nk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord, id) - 1 AS no FROM nn),
      ee AS (SELECT doc_id, ord, source, target, type FROM edges0 UNION ALL SELECT doc_id, (1 << 30) + clause_ord, source, t, type FROM lkd),
      ek AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord, source, target, type) - 1 AS no FROM ee)
      SELECT doc_id, 0 AS part, no, 'MERGE (n:' || label || ' {{id: $n' || no || '_id}}) SET n += $n' || no || '_props' AS query, '{{"n' || no || '_id":' || {j("id")} || ',"n' || no || '_props":{{' || {own} || ',"id":' || {j("id")} || CASE WHEN source_clause IS NULL THEN '' ELSE ',"source_clause":' || {j("source_clause")} END || '}}}}' AS parameters, NULL AS error FROM nk
      UNION ALL SELECT doc_id, 1, no, 'MATCH (source {{id: $source_id}}) MATCH (target {{id: $target_id}}) MERGE (source)-[r:' || type || ']->(target) SET r += $r' || no || '_props', '{{"source_id":' || {j("source")} || ',"target_id":' || {j("target")} || ',"r' || no || '_props":{{}}}}', NULL FROM ek"""
    first = "[" + ", ".join(q(r) for r in ("empty_graph", "unknown_label", "empty_properties", "duplicate_id", "unknown_type", "dangling_source", "dangling_target", "self_loop")) + "]"
    window = "WINDOW w AS (PARTITION BY doc_id ORDER BY ord, clause_id), s AS (PARTITION BY doc_id, section_id ORDER BY ord, clause_id)"
    return {
        "clean_text": clean_text(),
        "doc_lines": f"WITH {TEXTS}, {LINES} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(start_char AS INTEGER) AS start_char, line FROM lines",
        "headings": f"WITH {headings_cte()} SELECT doc_id, line_no, start_char, style, level, title FROM headings",
        "heading_style_counts": f"WITH {headings_cte()} SELECT style, level, count(*) AS n FROM headings GROUP BY ALL",
        "sections": f"WITH {sections_cte()} SELECT * FROM secs",
        "section_tree_depth": f"WITH {sections_cte()} SELECT doc_id, level, count(*) AS n_sections, count(*) FILTER (parent_section_id IS NULL) AS n_roots FROM secs GROUP BY ALL",
        "clause_roles": f"WITH {CLAUSES}, {roles_cte()} SELECT doc_id, clause_id, role, confidence, reasons FROM roles",
        "clause_neighbors": f"WITH {CLAUSES} SELECT doc_id, clause_id, lag(clause_id) OVER w AS previous_clause_id, lead(clause_id) OVER w AS next_clause_id, concat_ws(',', lag(clause_id) OVER w, lead(clause_id) OVER w) AS neighbors FROM c {window.split(', s AS')[0]}",
        "section_positions": f"WITH {CLAUSES} SELECT doc_id, clause_id, row_number() OVER s - 1 AS section_position, row_number() OVER s = 1 AS is_first_in_section, lead(clause_id) OVER s IS NULL AS is_last_in_section FROM c WINDOW {window.split('), ')[1]}",
        "references": f"WITH {references_cte()} SELECT * FROM refs",
        "entities_raw": f"WITH {entities_cte()} SELECT {ent} FROM raw",
        "entities_merged": f"WITH {entities_cte()} SELECT {ent} FROM merged",
        "entity_counts": f"WITH {entities_cte()} SELECT entity_type, detection_method, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM merged GROUP BY ALL",
        "chunks": f"""WITH {entities_cte()}, {roles_cte()}, {top("te", "entity_text", "start_offset, end_offset DESC, detector_no, pattern_no")}, {top("tr", "reference_text", "ref_no")}
      SELECT r.doc_id, r.clause_id AS chunk_id, s AS text, greatest(1, length(s) // 4) AS token_estimate, role, section_id, CAST(confidence AS VARCHAR) AS confidence, reasons AS classification_reason, coalesce(te.v, '') AS entities, coalesce(tr.v, '') AS "references"
      FROM roles r LEFT JOIN te ON te.doc_id = r.doc_id AND te.clause_id = r.clause_id LEFT JOIN tr ON tr.doc_id = r.doc_id AND tr.clause_id = r.clause_id WHERE s <> ''""",
        "graph_nodes": f"WITH {hierarchy_cte()} SELECT doc_id, id, label, number, title, identifier, clause_id, law_code, reference_type FROM nodes0",
        "graph_edges": f"WITH {hierarchy_cte()} SELECT doc_id, source, target, type FROM edges0",
        "resolved_refs": f"WITH {resolver_cte()} SELECT doc_id, clause_id, kind, value, ref_text, target FROM res WHERE target IS NOT NULL",
        "unresolved_refs": f"WITH {resolver_cte()} SELECT doc_id, clause_id, kind, value, ref_text FROM res WHERE target IS NULL",
        "graph_violations": f"WITH {resolver_cte()} {broken('nodes1', 'edges1')}",
        "edge_violations": f"WITH {hierarchy_cte()}, {stored} SELECT rule, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM ({broken('nodes0', 'stored')}) GROUP BY ALL",
        "cypher_ops": f"WITH {resolver_cte()}, {statements}",
        "built_graphs": f"""WITH {resolver_cte()}, bad AS ({broken('nodes1', 'edges1')}), one AS (SELECT doc_id, min((list_position({first}, rule), rule || CASE WHEN subject = '' THEN '' ELSE ' ' || subject END))[2] AS error FROM bad GROUP BY ALL),
      n AS (SELECT doc_id, count(*) AS k FROM nodes1 GROUP BY ALL), m AS (SELECT doc_id, count(*) AS k FROM edges1 GROUP BY ALL)
      SELECT t.doc_id, coalesce(n.k, 0) AS nodes_in_ir, coalesce(m.k, 0) AS relationships_in_ir, error FROM texts t LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN one USING (doc_id)""",
        "enriched": f"""WITH {CLAUSES}, t AS (SELECT doc_id, clause_id, coalesce(clause_text, '') AS x, row_number() OVER (PARTITION BY doc_id ORDER BY ord, clause_id) AS k FROM c)
      SELECT doc_id, 'obl_clause_' || clause_id || '_' || (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1) AS id, NULL AS error, substr(x, 1, 3) AS subject, length(x)::VARCHAR AS object, '' AS condition FROM t WHERE contains(x, 'shall')
      UNION ALL SELECT doc_id, 'clause_' || clause_id, 'Invalid JSON from LLM', NULL, NULL, NULL FROM t WHERE contains(x, 'must') AND NOT contains(x, 'shall')""",
        "loaded_documents": """WITH t AS (SELECT *, doc_id || '.' || CASE document_format WHEN 'pdf' THEN 'TXT' ELSE document_format END AS filename FROM cleaned QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ingested_at DESC) = 1),
      k AS (SELECT *, CASE WHEN document_format = 'html' THEN 'unsupported_file_type' WHEN cleaned_text IS NULL THEN 'unreadable_document' WHEN document_format = 'docx' THEN 'corrupted_document' END AS error_kind FROM t)
      SELECT 'DOC_' || substr(sha256('in/' || filename), 1, 8) AS doc_id, filename, CASE document_format WHEN 'html' THEN 'unknown' WHEN 'docx' THEN 'docx' ELSE 'txt' END AS document_format, nullif(title, '') AS title, error_kind,
        CASE error_kind WHEN 'unsupported_file_type' THEN 'Unsupported file type: .html' WHEN 'unreadable_document' THEN 'Document not found: in/' || filename WHEN 'corrupted_document' THEN CASE WHEN cleaned_text = '' THEN 'DOCX file is empty' ELSE 'DOCX file is corrupted or unreadable' END END AS error_msg,
        CASE WHEN error_kind IS NULL THEN length(cleaned_text) END AS n_chars FROM k""",
        "document_json": f"""WITH {entities_cte()}, {TEXTS}, n AS (SELECT doc_id, count(*) AS k, arg_min(nxt, o) AS second FROM (SELECT doc_id, row_number() OVER w AS o, coalesce(lead(clause_id) OVER w, chr(1)) AS nxt FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY ord, clause_id)) GROUP BY ALL),
      m AS (SELECT doc_id, count(*) AS k FROM merged GROUP BY ALL), r AS (SELECT doc_id, count(*) AS k FROM refs GROUP BY ALL)
      SELECT t.doc_id, t.title, coalesce(n.k, 0) AS n_clauses, coalesce(m.k, 0) AS n_entities, coalesce(r.k, 0) AS n_references, nullif(second, chr(1)) AS second_clause FROM texts t LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN r USING (doc_id)""",
        "exported_labels": f"WITH {resolver_cte()} SELECT 'node' AS part, {rename('label', vocab.EXPORT_LABELS)} AS name, count(*) AS n FROM nodes1 GROUP BY ALL UNION ALL SELECT 'edge', {rename('type', vocab.EXPORT_TYPES)}, count(*) FROM edges1 GROUP BY ALL",
        "graph_stats": f"WITH {resolver_cte()} SELECT n.doc_id, nodes_in_ir, coalesce(relationships_in_ir, 0) AS relationships_in_ir FROM (SELECT doc_id, count(*) AS nodes_in_ir FROM nodes1 GROUP BY ALL) n LEFT JOIN (SELECT doc_id, count(*) AS relationships_in_ir FROM edges1 GROUP BY ALL) e ON e.doc_id = n.doc_id",
        "traversal_4hop": f"""WITH RECURSIVE {stored}, e AS (SELECT DISTINCT doc_id, source, target FROM stored WHERE source IS NOT NULL AND target IS NOT NULL),
      r(doc_id, start, node, hops) AS (SELECT doc_id, source, target, 1 FROM e WHERE starts_with(source, 'law_') UNION SELECT r.doc_id, r.start, e.target, r.hops + 1 FROM r JOIN e ON e.doc_id = r.doc_id AND e.source = r.node WHERE r.hops < 4)
      SELECT doc_id, start, hops, count(*) AS n FROM (SELECT doc_id, start, node, min(hops) AS hops FROM r GROUP BY ALL) GROUP BY ALL""",
        "knn_top10": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.v, b.v) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(score, 5) AS score, rank FROM r WHERE rank <= 10""",
        "clause_versions_asof": """SELECT doc_id, clause_id, length(clause_text) AS n_chars FROM (SELECT * FROM clauses WHERE ingested_at <= TIMESTAMP '2024-07-01' QUALIFY row_number() OVER (PARTITION BY doc_id, clause_id ORDER BY ingested_at DESC) = 1)
      WHERE deleted_at IS NULL OR deleted_at > TIMESTAMP '2024-07-01'""",
    }
