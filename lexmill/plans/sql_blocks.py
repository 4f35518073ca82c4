"""SQL twins of blocks, candidates and clause units, for DuckDB: scans as walks from line to line, rules as windows."""

from __future__ import annotations

import re

from lexmill.functions import vocab
from lexmill.plans.sql import CLAUSES, GAP, SP, TEXTS, clean_text, entities_cte, q, sections_cte, strip, words

MARK = r"(?:\p{Nd}+(?:\.\p{Nd}+)*[.)]|\(\p{Nd}+\)|[A-Za-z][.)]|\([A-Za-z]\)|[-*•])"
TITLE = rf"^[A-Z][A-Za-z0-9''&()/\-]+(?:[{SP}]+[A-Z][A-Za-z0-9''&()/\-]+){{0,8}}[{SP}]*\z"


def blocks_cte() -> str:
    """blocks, as the operator gives them, of the sections."""
    whole = "PARTITION BY doc_id, section_no ORDER BY k"
    first = lambda when, frame: f"coalesce(min(CASE WHEN {when} THEN k END) OVER ({whole} ROWS BETWEEN {frame} AND UNBOUNDED FOLLOWING), n)"
    raws, texts = "list_transform(ls[k + 1:stop], lambda x: x)", f"list_transform(ls[k + 1:stop], lambda x: {strip('x')})"
    return f"""{sections_cte()},
      b0 AS (SELECT doc_id, section_no, section_id, title, level, string_split(text, chr(10)) AS ls FROM secs),
      b1 AS (SELECT *, unnest(range(len(ls))) AS k, len(ls) AS n FROM b0),
      b2 AS (SELECT *, ls[k + 1] AS line, {strip("ls[k + 1]")} AS s, k + list_sum(list_transform(ls[1:k], lambda x: length(x))) AS at0 FROM b1),
      b3 AS (SELECT *, coalesce(at0, 0)::BIGINT AS here, CASE WHEN s = '' THEN 'blank' WHEN regexp_matches(s, '^{MARK}[{SP}]') THEN 'list' WHEN starts_with(s, '|') AND ends_with(s, '|') AND length(s) > 1 THEN 'table' WHEN regexp_matches(s, '(?i)https?://[^{SP}]') THEN 'link'
          WHEN regexp_matches(s, '^(?:Note|NOTE)[:{SP}]') THEN 'note' WHEN regexp_matches(s, '^>[{SP}]') THEN 'quote' ELSE 'text' END AS kind,
        s <> '' AND len({words("s")}) <= 5 AND NOT regexp_matches(s, '[.!?:;]\\z') AS short, regexp_matches(s, '^\\p{{Lu}}') AND regexp_matches(s, '[.!?]\\z') AS sentence FROM b2),
      b4 AS (SELECT *, {first("kind <> 'blank'", "CURRENT ROW")} AS nb, coalesce(first_value(CASE WHEN s <> '' THEN short END IGNORE NULLS) OVER ({whole} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), FALSE) AS next_short,
        {first("NOT (kind IN ('text', 'quote') AND NOT sentence)", "1 FOLLOWING")} AS e_list, {first("kind <> 'table'", "CURRENT ROW")} AS e_table, {first("kind <> 'quote'", "CURRENT ROW")} AS e_quote, {first("NOT short", "CURRENT ROW")} AS e_short, {first("kind <> 'text'", "CURRENT ROW")} AS e_text FROM b3),
      b5 AS (SELECT *, CASE WHEN kind = 'text' AND short AND next_short THEN 'implicit' ELSE kind END AS step FROM b4),
      b6 AS (SELECT *, CASE step WHEN 'list' THEN e_list WHEN 'table' THEN e_table WHEN 'quote' THEN e_quote WHEN 'implicit' THEN e_short WHEN 'text' THEN e_text ELSE k + 1 END AS stop FROM b5),
      heads AS (SELECT doc_id, section_no FROM b6 WHERE k = 0 AND title <> '' AND s <> '' AND (contains(s, title) OR contains(title, s) OR (regexp_matches(s, '{TITLE}') AND len({words("s")}) <= 10 AND NOT ends_with(s, '.')))),
      walk(doc_id, section_no, k) AS (
        SELECT b.doc_id, b.section_no, b.nb FROM b6 b LEFT JOIN heads h USING (doc_id, section_no) WHERE b.k = CASE WHEN h.doc_id IS NULL THEN 0 ELSE 1 END AND b.nb < b.n
        UNION ALL SELECT w.doc_id, w.section_no, t.nb FROM walk w JOIN b6 b USING (doc_id, section_no, k) JOIN b6 t ON t.doc_id = b.doc_id AND t.section_no = b.section_no AND t.k = b.stop WHERE t.nb < t.n),
      steps AS (SELECT b.*, lag(stop) OVER ({whole}) AS prev_stop, lag(step) OVER ({whole}) AS prev_step FROM b6 b SEMI JOIN walk w USING (doc_id, section_no, k)),
      b7 AS (SELECT *, NOT (step = 'list' AND coalesce(prev_step = 'list' AND prev_stop = k, FALSE)) AS opens FROM steps),
      b8 AS (SELECT *, sum(opens::INT) OVER ({whole}) AS block FROM b7),
      grp AS (SELECT doc_id, section_no, block, min(k) AS k0, sum(CASE WHEN NOT opens THEN 0 WHEN step = 'implicit' THEN 1 + stop - k ELSE 1 END) AS inc FROM b8 GROUP BY ALL),
      b9 AS (SELECT g.*, (h.doc_id IS NOT NULL)::INT + coalesce(sum(inc) OVER (PARTITION BY g.doc_id, g.section_no ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM grp g LEFT JOIN heads h USING (doc_id, section_no)),
      placed AS (SELECT b.*, o, k0, k - k0 AS rel, row_number() OVER (PARTITION BY b.doc_id, b.section_no, b.block ORDER BY b.k) - 1 AS item FROM b8 b JOIN b9 USING (doc_id, section_no, block)),
      every AS (
        SELECT doc_id, section_no, section_id, title, level, -1 AS block, 0 AS p1, 0 AS p2, 0 AS step, 1 AS depth, 1 AS no, NULL::BIGINT AS parent, 'HEADING' AS block_type, s AS text, 0 AS b, length(line) AS e FROM b6 SEMI JOIN heads USING (doc_id, section_no) WHERE k = 0
        UNION ALL SELECT doc_id, section_no, section_id, title, level, block, 0, 0, o, 1, o + 1, NULL, CASE step WHEN 'list' THEN 'LIST' WHEN 'implicit' THEN 'LIST' WHEN 'table' THEN 'TABLE' WHEN 'text' THEN 'PARAGRAPH' ELSE upper(step) END,
          CASE WHEN step IN ('list', 'implicit') THEN '' WHEN step IN ('link', 'note') THEN s WHEN step = 'quote' THEN array_to_string({raws}, chr(10)) ELSE array_to_string({texts}, chr(10)) END,
          CASE WHEN step NOT IN ('list', 'implicit') THEN here END, CASE WHEN step IN ('link', 'note') THEN here + length(line)
            WHEN step IN ('quote', 'text') THEN here + length(array_to_string(ls[k + 1:stop - 1], chr(10))) + CASE WHEN stop - k > 1 THEN 1 ELSE 0 END + CASE WHEN step = 'quote' THEN length(ls[stop]) ELSE length({strip("ls[stop]")}) END END FROM placed WHERE opens
        UNION ALL SELECT doc_id, section_no, section_id, title, level, block, item + 1, 0, 0, 2, o + 1 + item, o + 1, 'LIST_ITEM', array_to_string({texts}, ' '), here, NULL FROM placed WHERE step = 'list'
        UNION ALL SELECT doc_id, section_no, section_id, title, level, block, i + 1, 0, o + 1 + i, 2, o + 2 + i, o + 1, 'LIST_ITEM', {strip("ls[k + i + 1]")}, here + coalesce(list_sum(list_transform(ls[k + 1:k + i], lambda x: length(x) + 1)), 0), here + coalesce(list_sum(list_transform(ls[k + 1:k + i], lambda x: length(x) + 1)), 0) + length(ls[k + i + 1])
          FROM (SELECT *, unnest(range(stop - k)) AS i FROM placed WHERE step = 'implicit')
        UNION ALL SELECT doc_id, section_no, section_id, title, level, block, i + 1, 0, i, 2, o + 1 + i, NULL, 'TABLE_ROW', {strip("ls[k + i + 1]")}, NULL, NULL FROM (SELECT *, unnest(range(stop - k)) AS i FROM placed WHERE step = 'table')
        UNION ALL SELECT doc_id, section_no, section_id, title, level, block, i + 1, j + 1, i * 100 + j, 3, o + 1 + i * 100 + j, NULL, 'TABLE_CELL', {strip("cells[j + 2]")}, NULL, NULL
          FROM (SELECT *, unnest(range(len(cells) - 2)) AS j FROM (SELECT *, string_split({strip("ls[k + i + 1]")}, '|') AS cells FROM (SELECT *, unnest(range(stop - k)) AS i FROM placed WHERE step = 'table')))),
      grown AS (SELECT s.doc_id, s.section_no, coalesce(sum(inc), 0) + max((h.doc_id IS NOT NULL)::INT) AS grew FROM secs s LEFT JOIN grp USING (doc_id, section_no) LEFT JOIN heads h USING (doc_id, section_no) GROUP BY ALL),
      bases AS (SELECT doc_id, section_no, 1 + coalesce(sum(grew) OVER (PARTITION BY doc_id ORDER BY section_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM grown),
      seqs AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY block, p1, p2) - 1 AS seq FROM every),
      blocks AS (SELECT doc_id, section_no, seq::INT AS seq, CASE WHEN depth = 1 OR (block_type = 'LIST_ITEM' AND step > 0) THEN base + step ELSE step END::INT AS ord, depth, (min(seq) OVER (PARTITION BY doc_id, section_no, block))::INT AS top_seq,
        section_id || '_B' || printf('%03d', no::BIGINT) AS block_id, section_id, section_id || '_B' || printf('%03d', parent::BIGINT) AS parent_block_id, block_type, text, CASE WHEN block_type = 'HEADING' THEN level END AS level, title AS section_title, b::INT AS start_char, e::INT AS end_char FROM seqs JOIN bases USING (doc_id, section_no))"""


def candidates_cte() -> str:
    """cands: the candidates, their arrays of ids in order."""
    w = "PARTITION BY doc_id ORDER BY ord"
    last = lambda when, value: f"last_value(CASE WHEN {when} THEN {value} END IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    joins = ", ".join(q(x) for x in vocab.CONTINUATIONS)
    ws = words("s")
    return f"""{blocks_cte()},
      items AS (SELECT doc_id, section_no, top_seq AS seq, list({strip("text")} ORDER BY seq) AS items FROM blocks WHERE block_type = 'LIST_ITEM' GROUP BY ALL),
      k0 AS (SELECT b.doc_id, b.ord, b.section_id, nullif(b.section_title, '') AS section_title, b.block_id, i.items, CASE WHEN block_type = 'LIST' AND coalesce(len(list_filter(i.items, lambda x: regexp_matches(x, '^[-*•0-9(]') OR len({words("x")}) > 5)) = 0, TRUE) THEN 'BARE' ELSE block_type END AS kind,
        CASE WHEN block_type = 'LIST' THEN array_to_string(list_filter(i.items, lambda x: x <> ''), chr(10)) ELSE b.text END AS text FROM blocks b LEFT JOIN items i USING (doc_id, section_no, seq) WHERE b.depth = 1),
      k1 AS (SELECT *, {strip("coalesce(text, '')")} AS s FROM k0),
      k2 AS (SELECT *, kind = 'PARAGRAPH' AND len({ws}) BETWEEN 1 AND 3 AND NOT regexp_matches(s, '[.!?:]\\z') AND ((len({ws}) = 1 AND length({ws}[1]) <= 2) OR regexp_matches(s, '^\\p{{Ll}}') OR (regexp_matches(s, '^\\p{{Lu}}') AND len({ws}) <= 2)) AS quiet,
        len({ws}) <= 6 AND NOT (len({ws}) >= 3 AND regexp_matches(s, '[.!?]\\z')) AND length(rtrim(s, '.')) > 1 AS titled, coalesce(trim(lower({ws}[1]), '(') IN ({joins}), FALSE) AS joins, right(s, 1) AS tail FROM k1),
      k3 AS (SELECT *, lead(kind) OVER ({w}) AS nk, coalesce(lead(quiet) OVER ({w}), FALSE) AS nq FROM k2),
      k4 AS (SELECT *, quiet AND nq AS pair, quiet OR kind = 'LINK' AS menu FROM k3),
      k5 AS (SELECT *, menu AND (pair OR coalesce({last("pair OR NOT menu", "pair")}, FALSE)) AS dead FROM k4),
      k6 AS (SELECT *, kind = 'PARAGRAPH' AND NOT (quiet AND (nk IS NULL OR nk = 'LINK')) AS live, coalesce(nk = 'PARAGRAPH', FALSE) AS bp FROM k5 WHERE NOT dead),
      k7 AS (SELECT *, {last("(kind = 'HEADING' AND bp) OR live", "{'is': kind = 'HEADING' AND bp, 'id': block_id, 't': text}")} AS over FROM k6),
      k8 AS (SELECT *, live AND coalesce(over['is'], FALSE) AS headed FROM k7),
      k9 AS (SELECT *, live AND NOT headed AND titled AND bp AS names, live AND NOT headed AS plain FROM k8),
      k10 AS (SELECT *, (live AND NOT names) OR (kind = 'LIST' AND text <> '') AS says FROM k9),
      k11 AS (SELECT *, {last("plain", "{'is': names, 'id': block_id, 't': text}")} AS named, {last("says", "tail")} AS said FROM k10),
      k12 AS (SELECT *, plain AND NOT names AND coalesce(named['is'], FALSE) AS entitled FROM k11),
      k13 AS (SELECT *, headed OR entitled OR (plain AND NOT names AND NOT (joins AND said IS NOT NULL AND said NOT IN ('.', '!', '?'))) OR (says AND kind = 'LIST' AND said IS NULL) AS opens FROM k12),
      k14 AS (SELECT *, sum(opens::INT) OVER ({w}) - 1 AS no, CASE WHEN headed THEN over WHEN entitled THEN named END AS above FROM k13),
      k15 AS (SELECT *, last_value(CASE WHEN says THEN ord END IGNORE NULLS) OVER (PARTITION BY doc_id, no ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_said FROM k14 WHERE no >= 0 AND (opens OR says OR kind IN ('LIST', 'LINK', 'TABLE', 'NOTE'))),
      k16 AS (SELECT *, CASE WHEN says THEN CASE WHEN opens THEN '' WHEN kind = 'LIST' THEN chr(10) ELSE ' ' END || CASE WHEN ord < last_said THEN regexp_replace(text, '[{SP}]+\\z', '') ELSE text END END AS part FROM k15),
      cands0 AS (SELECT doc_id, no::INT AS ord, first(section_id ORDER BY ord) AS section_id, first(section_title ORDER BY ord) AS section_title, string_agg(part, '' ORDER BY ord) AS text, max(CASE WHEN headed THEN above['t'] END) AS heading, max(CASE WHEN entitled THEN rtrim({strip("above['t']")}, '.') END) AS title,
        list_concat(list(above['id'] ORDER BY ord) FILTER (above IS NOT NULL), list(block_id ORDER BY ord)) AS block_ids, list(block_id ORDER BY ord) FILTER (kind = 'LINK') AS link_block_ids, list(block_id ORDER BY ord) FILTER (kind = 'TABLE') AS table_block_ids, list(block_id ORDER BY ord) FILTER (kind = 'NOTE') AS note_block_ids FROM k16 GROUP BY doc_id, no),
      cands AS (SELECT *, section_id || '_P' || printf('%03d', row_number() OVER (PARTITION BY doc_id, section_id ORDER BY ord)) AS candidate_id FROM cands0)"""


def units_cte(source: str, keys: str) -> str:
    """units (keys, unit_no, unit_text, start_char, end_char, clause_number) of source (keys, text)."""
    guarded = "text"
    for a in sorted(vocab.ABBREVIATIONS, key=len, reverse=True):
        guarded = f"replace({guarded}, {q(a)}, {q(a.replace('.', chr(0xE000)))})"
    pua = chr(0xE000)
    digits = lambda c: f"regexp_replace({c}, '(\\p{{Nd}})\\.(\\p{{Nd}})', '\\1{pua}\\2', 'g')"
    marker = rf"(\(\p{{Nd}}+\)|\p{{Nd}}+(?:[.{pua}]\p{{Nd}}+)*[.)]|[A-Za-z][.)]|\([A-Za-z]\)|[-*•])"
    item = rf"^[{GAP}]*{marker}[{GAP}]+[^\n]+\z"
    return f"""u0 AS (SELECT {keys}, string_split({digits(digits(guarded))}, chr(10)) AS ls FROM {source} WHERE text IS NOT NULL),
      u1 AS (SELECT {keys}, unnest(range(len(ls))) AS k, unnest(ls) AS line FROM u0),
      u2 AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY {keys} ORDER BY k) - length(line) - 1 AS here, regexp_matches(line, '{item}') AS item, {strip("line")} = '' AS blank FROM u1),
      u3 AS (SELECT *, CASE WHEN item OR blank OR lag(item OR blank, 1, TRUE) OVER (PARTITION BY {keys} ORDER BY k) THEN 1 ELSE 0 END AS opens FROM u2),
      u4 AS (SELECT *, sum(opens) OVER (PARTITION BY {keys} ORDER BY k) AS block FROM u3),
      u5 AS (SELECT {keys}, block, bool_or(item) AS item, min(here) AS here, string_agg(line, chr(10) ORDER BY k) AS t FROM u4 WHERE NOT blank GROUP BY ALL),
      u6 AS (SELECT {keys}, block, item, here, CASE WHEN item THEN [t] ELSE string_split(regexp_replace(t, '([.!?])([{SP}]+)', '\\1' || chr(1) || '\\2' || chr(1), 'g'), chr(1)) END AS ps FROM u5),
      u7 AS (SELECT {keys}, block, item, here, unnest(range(len(ps))) AS i, ps FROM u6),
      u8 AS (SELECT {keys}, block, item, ps[i + 1] AS t, (here + coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0))::INT AS b FROM u7),
      units AS (SELECT {keys}, (row_number() OVER (PARTITION BY {keys} ORDER BY b) - 1)::INT AS unit_no, replace(t, '{pua}', '.') AS unit_text, b AS start_char, (b + length(t))::INT AS end_char, CASE WHEN item THEN replace(regexp_extract(t, '{item}', 1), '{pua}', '.') END AS clause_number FROM u8 WHERE {strip("t")} <> '')"""


def oracle_sql() -> dict[str, str]:
    ids = "coalesce(array_to_string({0}, ','), '') AS {0}"
    names = ("block_ids", "link_block_ids", "table_block_ids", "note_block_ids")
    return {
        "blocks": f"WITH RECURSIVE {blocks_cte()} SELECT * FROM blocks",
        "blocks_by_type": f"WITH RECURSIVE {blocks_cte()} SELECT block_type, depth, count(*) AS n FROM blocks GROUP BY ALL",
        "candidates": f"WITH RECURSIVE {candidates_cte()} SELECT doc_id, ord, candidate_id, section_id, section_title, text, heading, title, {', '.join(ids.format(n) for n in names)} FROM cands",
        "clause_units": f"WITH {CLAUSES}, src AS (SELECT doc_id, clause_id, clause_text AS text FROM c), {units_cte('src', 'doc_id, clause_id')} SELECT * FROM units",
        "preview_counts": preview_counts(),
        "pipeline_clauses": f"WITH RECURSIVE {clauses_cte()} SELECT * FROM made",
    }


def clauses_cte() -> str:
    """made: the clauses of the candidates."""
    return f"""{candidates_cte()}, {units_cte('cands', 'doc_id, candidate_id')},
      m AS (SELECT u.*, c.section_id, c.ord AS candidate_ord, min(c.ord) OVER (PARTITION BY u.doc_id, c.section_id) AS section_ord FROM units u JOIN cands c USING (doc_id, candidate_id)),
      firsts AS (SELECT doc_id, section_id, arg_min(coalesce(section_title, chr(1)), ord) AS t, min(ord) AS section_ord FROM cands GROUP BY ALL),
      made AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY f.section_ord, candidate_ord, unit_no) - 1 AS ord, section_id || '_C' || printf('%03d', row_number() OVER (PARTITION BY doc_id, section_id ORDER BY candidate_ord, unit_no)) AS clause_id, section_id,
        nullif(t, chr(1)) AS section_title, unit_text AS clause_text, start_char AS span_start, end_char AS span_end, clause_number FROM m JOIN firsts f USING (doc_id, section_id))"""


def preview_counts() -> str:
    """Of texts that are cleaned first: the whole pipeline."""
    steps, _, _ = clean_text().partition(" SELECT doc_id, t5")
    cleaned = steps.removeprefix(f"WITH {TEXTS}, ").replace("FROM texts", "FROM stored")
    stored = f"{TEXTS.replace('texts AS', 'stored AS', 1)}, {cleaned}, texts AS (SELECT doc_id, NULL AS title, t5 AS cleaned_text FROM s5)"
    own = "c AS (SELECT doc_id, clause_id, ord, section_id, section_title, clause_text FROM made)"
    # both the lines and the spans have a CTE of this name
    found = re.sub(r"\bcut\b", "cut_spans", entities_cte().replace(CLAUSES, own, 1))
    counts = {"sections": "secs", "clauses": "c", "classifications": "c", "references": "refs", "entities": "merged", "chunks": f"(SELECT * FROM c WHERE {strip('clause_text')} <> '')"}
    joined = " ".join(f"LEFT JOIN (SELECT doc_id, count(*) AS n_{n} FROM {t} GROUP BY ALL) USING (doc_id)" for n, t in counts.items())
    return f"""WITH RECURSIVE {clauses_cte().replace(TEXTS, stored, 1)}, {found}, f AS (SELECT doc_id, arg_min(clause_text, ord) AS first_clause FROM c GROUP BY ALL)
      SELECT doc_id, {", ".join(f"coalesce(n_{n}, 0) AS n_{n}" for n in counts)}, first_clause FROM (SELECT doc_id FROM texts WHERE cleaned_text IS NOT NULL) {joined} LEFT JOIN f USING (doc_id)"""
