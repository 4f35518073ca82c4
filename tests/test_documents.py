import io
import random
import re
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from lexmill.functions import ordered, vocab
from lexmill.operators import blocks as B
from lexmill.operators import classify as K
from lexmill.operators import clauses as C
from lexmill.operators import cleaning, entities, sections
from lexmill.sources import documents

HEADINGS = "## Markdown\n\n3. Numbered\n\nIV. Roman\n\nARTICLE V\n\nScope:\n\nStandalone Heading\n\nBody text."


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def docs(spark, *texts):
    return spark.createDataFrame([(f"D{k}", t) for k, t in enumerate(texts)], "doc_id string, cleaned_text string")


def clauses(spark, *texts, title=None):
    return spark.createDataFrame([("D", f"S001_C{k:03d}", k, "S001", title, t) for k, t in enumerate(texts)], "doc_id string, clause_id string, ord int, section_id string, section_title string, clause_text string")


def docx(paragraphs, table):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in paragraphs)
    t = "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in r) + "</w:tr>" for r in table)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p}<w:tbl>{t}</w:tbl></w:body></w:document>")
        z.writestr("docProps/core.xml", '<c:p xmlns:c="urn:c" xmlns:d="urn:d"><d:title> Act </d:title><d:creator>Me</d:creator><d:created>2024-01-02T03:04:05Z</d:created></c:p>')
    return out.getvalue()


def test_loading(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Grüße\nzwei", encoding="utf-8")
    (tmp_path / "b.TXT").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "c.docx").write_bytes(docx(["One", "Two"], [["x", "y"], ["z", "w"]]))
    (tmp_path / "d.docx").write_bytes(b"no zip")
    (tmp_path / "e.html").write_text("<p>")
    got = {r.filename: r for r in documents.scan(spark, str(tmp_path)).collect()}
    assert got["a.txt"].raw_text == "Grüße\nzwei" and got["a.txt"].error_kind is None
    assert got["b.TXT"].error_kind == "unreadable_document" and got["b.TXT"].raw_text is None
    assert got["c.docx"].raw_text == "One\nTwo\nx\ty\nz\tw" and got["c.docx"].title == "Act"
    assert got["c.docx"].extra == {"author": "Me", "creation_date": "2024-01-02T03:04:05+00:00"}
    assert got["d.docx"].error_kind == "corrupted_document" and got["e.html"].error_kind == "unsupported_file_type"
    assert re.fullmatch("DOC_[0-9a-f]{8}", got["a.txt"].doc_id)


def test_loading_keeps_given_metadata(spark):
    given = spark.createDataFrame([("x/c.docx", bytearray(docx(["One"], [])), "Own", {"author": "You"}), ("x/c.docx", bytearray(docx(["One"], [])), "", None), ("gone.txt", None, None, None)], "path string, content binary, title string, extra map<string,string>")
    got = documents.load(given).collect()
    assert (got[0].title, got[0].extra["author"], got[1].title, got[2].error_kind) == ("Own", "You", "Act", "unreadable_document")
    with pytest.raises(Exception, match="unreadable_document"):
        documents.checked(documents.load(given)).collect()


def test_loading_empty_content(spark):
    given = spark.createDataFrame([("a.txt", bytearray()), ("b.docx", bytearray())], "path string, content binary")
    got = documents.load(given).collect()
    assert got[0].raw_text == "" and got[1].error_kind == "corrupted_document"


def test_inline(spark):
    assert documents.inline(spark, [("note", "text")]).first().raw_text == "text"


def cleaned(text):
    notes, now = [], text
    lig = now.replace("\r\n", "\n").replace("\r", "\n")
    for step, value in ((0, lig), (1, None), (2, None), (3, None), (4, None)):
        if step == 1:
            value = now
            for a, b in vocab.LIGATURES.items():
                value = value.replace(a, b)
        elif step == 2:
            value = unicodedata.normalize("NFC", now)
        elif step == 3:
            value = "\n".join(x.rstrip() for x in now.split("\n"))
        elif step == 4:
            kept, run = [], 0
            for x in now.split("\n"):
                run = run + 1 if x == "" else 0
                if run <= 2:
                    kept.append(x)
            value = "\n".join(kept)
        if value != now:
            notes.append(list(vocab.NOTES.values())[step])
        now = value
    return now, notes


def test_cleaning_matches_the_steps_on_random_text(spark):
    random.seed(7)
    parts = ["\n", "\n", "\r\n", "\r", " ", "\t", " ", "a", "é", "ﬁ", "ﬄ", "x\x1c", " ", "é"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 14))) for _ in range(800)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "k int, raw string")
    got = {r.k: (r.cleaned_text, r.cleaning_notes) for r in cleaning.clean(df, "raw").collect()}
    assert [got[k] for k in range(len(texts))] == [cleaned(t) for t in texts]
    assert got[len(texts)] == (None, [])
    again = cleaning.clean(cleaning.clean(df, "raw").select("k", F.col("cleaned_text").alias("raw")), "raw")
    assert {r.k: r.cleaned_text for r in again.collect()} == {k: v[0] for k, v in got.items()}


def test_heading_styles(spark):
    assert [s for _, s in rows(sections.headings(docs(spark, HEADINGS)), "line_no", "style")] == ["markdown", "numbered", "roman", "uppercase", "colon", "standalone"]
    texts = ["1. lower case", "2. Ends with stop.", "12. GDPR rules", "3.1.4 Deep One", "Mix Colours", "A", "Text: more", "Not Standalone\nnext", "x" * 121, "Straße:", "#No space", "###### Six"]
    got = {r.doc_id: (r.style, r.level, r.title) for r in sections.headings(docs(spark, *texts)).collect()}
    assert got == {"D2": ("numbered", 1, "12. GDPR rules"), "D3": ("numbered", 3, "3.1.4 Deep One"), "D4": ("roman", 1, "Mix Colours"), "D9": ("colon", 1, "Straße"), "D11": ("markdown", 6, "Six")}


def test_sections_cover_the_text_and_nest(spark):
    texts = [HEADINGS, "", "no heading", None, "Preamble\n\n# A\n## B\n### C\n## D\n# E\n1.2.3.4.5 Deep One\n1.2.3.4.5.6 Deeper One\n1.1 Up Again", "a😀b\n# T\nx"]
    got = sections.sections(docs(spark, *texts)).collect()
    for k, text in enumerate(texts):
        own = sorted((r for r in got if r.doc_id == f"D{k}"), key=lambda r: r.section_no)
        if text is None:
            assert own == []
            continue
        assert "".join(r.text for r in own) == text and own[0].span_start == 0 and own[-1].span_end == len(text)
        assert all(text[r.span_start : r.span_end] == r.text for r in own)
        stack = []
        for r in own:
            if r.title is None:
                assert r.parent_section_id is None
                continue
            while stack and stack[-1][0] >= r.level:
                stack.pop()
            assert r.parent_section_id == (stack[-1][1] if stack else None)
            stack.append((r.level, r.section_id))


def kinds(text, title=None):
    return [(b.kind, b.text) for b in B.scan(text, title)[0]]


def test_blocks():
    table = B.scan("| a | b |\n| 1 | 2 |\n| 3 | 4 |", None)[0]
    assert [sum(b.kind == k for b in table) for k in ("TABLE", "TABLE_ROW", "TABLE_CELL")] == [1, 3, 6]
    assert kinds("Countries\n\nAustralia\nBrazil\nCanada\nFrance", "Countries")[0] == ("HEADING", "Countries")
    assert [k for k, _ in kinds("Countries\n\nAustralia\nBrazil\nCanada\nFrance", "Countries")].count("LIST_ITEM") == 4
    assert kinds("- one\n  more\n- two\nIt ends here.")[1:] == [("LIST_ITEM", "- one more"), ("LIST_ITEM", "- two"), ("PARAGRAPH", "It ends here.")]
    assert kinds("See https://x.y now\nNote: this\n> quoted\n> more\nA longer line that is a paragraph\nof two lines.") == [
        ("LINK", "See https://x.y now"),
        ("NOTE", "Note: this"),
        ("QUOTE", "> quoted\n> more"),
        ("PARAGRAPH", "A longer line that is a paragraph\nof two lines."),
    ]
    found = B.scan("- a b c d e f\n- b\n\npara one two three four five.", None)[0]
    assert [b.no for b in found] == [1, 1, 2, 2]


def test_blocks_and_candidates_over_sections(spark):
    s = spark.createDataFrame([("D", 1, "S001", "Scope", 1, "Scope\n\nThis applies to all people here.\n- 1st item\n- 2nd item"), ("D", 2, "S002", None, 1, "and so on it goes for a while"), ("D", 3, "S003", None, 1, None)], "doc_id string, section_no int, section_id string, title string, level int, text string")
    got = B.blocks(s)
    assert [r[0] for r in rows(got.where("depth = 1"), "ord")] == [1, 2, 3, 4]
    c = B.candidates(got).orderBy("ord").collect()
    assert [(r.candidate_id, r.heading, r.text) for r in c] == [("S001_P001", "Scope", "This applies to all people here.\n- 1st item\n- 2nd item and so on it goes for a while")]
    assert c[0].block_ids == ["S001_B001", "S001_B002", "S001_B003", "S002_B001"]


def blocks_frame(spark, *documents):
    """Documents of (kind, text, items) blocks as the rows of blocks(), an id being the first three letters."""
    out = []
    for d, found in enumerate(documents):
        for k, (kind, text, *items) in enumerate(found):
            out.append((f"D{d}", 1, 100 * k, k + 1, 1, 100 * k, (text or "")[:3], "S", kind, text, None))
            out += [(f"D{d}", 1, 100 * k + j, k + 1, 2, 100 * k, "i", "S", "LIST_ITEM", x, None) for j, x in enumerate(items, 1)]
    return spark.createDataFrame(out, "doc_id string, section_no int, seq int, ord int, depth int, top_seq int, block_id string, section_id string, block_type string, text string, section_title string")


LONG, MORE = "The controller keeps records of all processing.", "The processor keeps them as well, and for longer."


def test_candidate_rules(spark):
    p = lambda text: ("PARAGRAPH", text)
    head, link = ("HEADING", "Head"), ("LINK", "Lnk")
    cases = [
        ([head, ("LIST", "", "- a")], ["- a"]),
        ([head, p(LONG)], [LONG]),
        ([p("Short title here"), p(LONG)], [LONG]),
        ([p("Home"), p("About us"), p(LONG)], [LONG]),
        ([p(LONG), ("LIST", "", "France", "Spain")], [LONG]),
        ([p("It applies where the following hold today"), p("and then some more words follow now")], ["It applies where the following hold today and then some more words follow now"]),
        ([p(LONG), ("NOTE", "Nn"), ("TABLE", "Tt"), link, ("QUOTE", "> q")], [LONG]),
        ([], []),
        ([("LIST", "")], []),
        # a menu is skipped with its links; a quiet line before a link or at the end goes alone
        ([p(LONG), p("Home"), p("News"), link, p("Help"), p(MORE)], [LONG, MORE]),
        ([p(LONG), p("Home"), link, p("News"), p(MORE)], [LONG, MORE]),
        ([p(LONG), p("Home")], [LONG]),
        # a heading outlives a skipped line; a title waits for a paragraph without heading; a later title takes its place
        ([head, p("Home"), link, p(LONG)], [LONG]),
        ([p("One title line"), p("Home"), link, head, p(LONG), p(MORE)], [LONG, MORE]),
        ([p("First title line"), p("Second title line"), p(LONG)], [LONG]),
        # what goes on after a list goes on with the list's text
        ([p(LONG), ("LIST", "", "- item"), p("and more of it in many words here")], [LONG + "\n- item and more of it in many words here"]),
        ([p(LONG), ("LIST", "", "- item."), p("and more of it in many words here")], [LONG + "\n- item.", "and more of it in many words here"]),
        ([("NOTE", "Nn"), p(None), p(LONG)], ["", LONG]),
        # a list of bare words parts two quiet lines from the link
        ([p(LONG), p("Home"), p("News"), ("LIST", "", "x"), link], [LONG]),
    ]
    got = {}
    for r in B.candidates(blocks_frame(spark, *[c[0] for c in cases])).orderBy("ord").collect():
        got.setdefault(r.doc_id, []).append(r)
    for k, (_, want) in enumerate(cases):
        assert [r.text for r in got.get(f"D{k}", [])] == want, k
    assert got["D1"][0].heading == "Head" and got["D2"][0].title == "Short title here" and got["D12"][0].heading == "Head"
    assert (got["D13"][0].heading, got["D13"][0].title, got["D13"][1].title) == ("Head", None, "One title line") and got["D14"][0].title == "Second title line"
    c = got["D6"][0]
    assert (c.note_block_ids, c.table_block_ids, c.link_block_ids, c.block_ids) == (["Nn"], ["Tt"], ["Lnk"], ["The", "Nn", "Tt", "Lnk"])
    assert got["D9"][0].link_block_ids == [] and got["D10"][0].link_block_ids == ["Lnk"] == got["D18"][0].link_block_ids
    assert B.candidates(blocks_frame(spark, [])).count() == 0


def test_values_across_buckets(spark):
    random.seed(9)
    given = [(random.choice(["a", None, "hot", "hot"]), k, random.choice([None, k])) for k in range(300)] + [("a", None, 5)]
    df = spark.createDataFrame(given, "g string, o int, v int")
    got = ordered.across(df, ["g"], ["o"], ordered.bucket_of("o", 7), {"s": F.lit(2)}, {"last": F.col("v")}, {"next": F.col("v")}).collect()
    for g in ("a", None, "hot"):
        own = sorted((x for x in given if x[0] == g), key=lambda x: -1 if x[1] is None else x[1])
        for r in (r for r in got if r.g == g):
            k = own.index((r.g, r.o, r.v))
            before = [x[2] for x in own[:k] if x[2] is not None]
            assert (r.s, r.last, r.next) == (2 * k, before[-1] if before else None, own[k + 1][2] if k + 1 < len(own) else None)
    assert len(got) == len(given)


def plain_units(text: str) -> list[tuple[str, int, int, str | None]]:
    """Clause units of one string, line by line."""
    marker = re.compile(r"\s*(\(\d+\)|\d+(?:\.\d+)*[.)]|[A-Za-z][.)]|\([A-Za-z]\)|[-*•])\s+.+")
    guarded = text
    for a in sorted(vocab.ABBREVIATIONS, key=len, reverse=True):
        guarded = guarded.replace(a, a.replace(".", C.SHIELD))
    guarded = re.sub(r"(?<=\d)\.(?=\d)", C.SHIELD, guarded)
    out: list[tuple[str, int, int, str | None]] = []
    block: list[int] = []
    ends = [-1, *(m.start() for m in re.finditer("\n", text)), len(text)]

    def close() -> None:
        if block:
            begin, end = block[0], block[-1]
            at = begin
            for m in [*re.finditer(r"(?<=[.!?])\s+", guarded[begin:end]), None]:
                stop = begin + m.start() if m else end
                if text[at:stop].strip():
                    out.append((text[at:stop], at, stop, None))
                at = begin + m.end() if m else end
            block.clear()

    for a, b in zip(ends, ends[1:]):
        line = text[a + 1 : b]
        m = marker.fullmatch(line)
        if m or not line.strip():
            close()
        if m:
            out.append((line, a + 1, b, m.group(1)))
        elif line.strip():
            block[:] = [block[0] if block else a + 1, b]
    close()
    return out


def test_units_match_the_line_by_line_reading(spark):
    random.seed(3)
    parts = ["Foo bar. ", "e.g. this ", "No. 5 ", "\n", "\n\n", "- item one", "1. two", "(a) x", "3.1. y", "? ", "! ", "1.2.3 ", "  ", "Mr. X. ", "z.", "A. ", "•  dot\n", " \n", "\t", "intro:", "Baz qux.\n  Next line. ", "😀é. "]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 14))) for _ in range(1500)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "id int, text string")
    got = {}
    for r in C.units(df, ["id"]).orderBy("id", "unit_no").collect():
        got.setdefault(r.id, []).append((r.unit_text, r.start_char, r.end_char, r.clause_number))
    assert [got.get(k, []) for k in range(len(texts))] == [plain_units(t) for t in texts]
    assert len(texts) not in got


def test_clauses_number_within_sections(spark):
    c = spark.createDataFrame([("D", 0, "S001_P001", "S001", None, "First one. Second one."), ("D", 1, "S002_P001", "S002", "T", "Third."), ("D", 2, "S001_P002", "S001", "Late", "Fourth.")], "doc_id string, ord int, candidate_id string, section_id string, section_title string, text string")
    assert rows(C.clauses(c), "ord", "clause_id", "clause_text", "section_title") == [(0, "S001_C001", "First one.", None), (1, "S001_C002", "Second one.", None), (2, "S001_C003", "Fourth.", None), (3, "S002_C001", "Third.", "T")]


def test_roles(spark):
    texts = ["", "- item", "(a) thing", "Scope", "the scope of", "We shall comply with this.", "five words without a vrb", "tiny one", None]
    got = [(r.role, r.confidence, ",".join(r.reasons)) for r in K.classify(clauses(spark, *texts, title="Scope")).orderBy("ord").collect()]
    assert got == [
        ("UNKNOWN", 1.0, "empty_text"),
        ("LIST_ITEM", 1.0, "list_marker_detected"),
        ("LIST_ITEM", 1.0, "list_marker_detected"),
        ("HEADING", 0.95, "short_text,matches_section_title,title_case,no_verb"),
        ("HEADING", 0.95, "short_text,matches_section_title,no_verb"),
        ("STATEMENT", 0.92, "contains_verb"),
        ("STATEMENT", 0.65, "long_text"),
        ("UNKNOWN", 0.5, "no_heuristic_match"),
        ("UNKNOWN", 1.0, "empty_text"),
    ]


def test_context(spark):
    got = K.context(clauses(spark, "a", "b", "c")).orderBy("ord").collect()
    assert [(r.previous_clause_id, r.next_clause_id, r.is_first_in_section, r.is_last_in_section) for r in got] == [(None, "S001_C001", True, False), ("S001_C000", "S001_C002", False, False), ("S001_C001", None, False, True)]


def test_references(spark):
    texts = ["X Section 5 Y", "Section 5 section 5", "this Act and The Rules, subsection (2) of rule 7", "😀 Chapter IX", None, ""]
    got = rows(K.references(clauses(spark, *texts)), "clause_id", "ref_no", "reference_text", "reference_type", "ref_start", "ref_end")
    assert got == [
        ("S001_C000", 0, "Section 5", "section", 2, 11),
        ("S001_C001", 0, "Section 5", "section", 0, 9),
        ("S001_C001", 1, "section 5", "section", 10, 19),
        ("S001_C002", 0, "this Act", "act", 0, 8),
        ("S001_C002", 1, "The Rules", "rules", 13, 22),
        ("S001_C002", 2, "subsection (2)", "subsection", 24, 38),
        ("S001_C002", 3, "rule 7", "rule", 42, 48),
        ("S001_C003", 0, "Chapter IX", "chapter", 2, 12),
    ]


def test_entities(spark):
    c = clauses(spark, "The Data Fiduciary shall obtain consent within 30 days.", "sensitive personal data on 2024-01-02 or 3 March 2024, under Section 4", "éboard", None)
    refs = K.references(c)
    raw = entities.numbered(entities.raw_entities(c, refs), c)
    got = rows(entities.merged(raw), "clause_id", "start_offset", "entity_type", "entity_text")
    assert got == [
        ("S001_C000", 4, "LEGAL_ACTOR", "Data Fiduciary"),
        ("S001_C000", 32, "LEGAL_OBJECT", "consent"),
        ("S001_C000", 40, "TIME", "within 30 days"),
        ("S001_C001", 0, "LEGAL_OBJECT", "sensitive personal data"),
        ("S001_C001", 27, "DATE", "2024-01-02"),
        ("S001_C001", 41, "DATE", "3 March 2024"),
        ("S001_C001", 61, "LAW_REFERENCE", "Section 4"),
    ]
    ids = [r[0] for r in rows(raw, "entity_id")]
    assert ids == [f"E{k:03d}" for k in range(1, len(ids) + 1)] and len(ids) == 9
    made = entities.chunks(K.classify(c), entities.merged(raw), refs).orderBy("chunk_id").collect()
    assert made[0].token_estimate == 13 and made[0].context["entities"] == "Data Fiduciary,consent,within 30 days"
    assert made[1].context["references"] == "Section 4" and len(made) == 3


def test_running_sums_and_long_texts(spark):
    from lexmill.functions.text import find_spans, running

    given = [[], [5], list(range(40)), [random.randint(0, 9) for _ in range(1300)]]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(given)], "k int, xs array<int>")
    got = {r.k: r.s for r in df.select("k", running(F.col("xs"), 8).alias("s")).collect()}
    assert got == {k: [sum(x[:j]) for j in range(len(x))] for k, x in enumerate(given)}
    long = "Section 7 says it. " * 1500 + "- item\n" + "😀 No end"
    one = spark.createDataFrame([(1, long)], "id int, text string")
    spans = sorted((r.span_start, r.span_text) for r in find_spans(one, ["id"], "text", [r"Section \d"]).collect())
    assert spans == [(m.start(), m.group()) for m in re.finditer(r"Section \d", long)]
    units = [(r.unit_text, r.start_char, r.end_char, r.clause_number) for r in C.units(one, ["id"]).orderBy("unit_no").collect()]
    assert units == plain_units(long)
