"""Clauses: sentences and list items of candidate texts, numbered per section."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import vocab
from lexmill.functions.ordered import bucket_of, numbered
from lexmill.functions.text import running, strip
from lexmill.session import Workspace

#: Stands for a full stop that ends no sentence; and the cut between two parts.
SHIELD, CUT = "", "\x01"
STOP = r"[.\x{E000}]"
GAP = r"[[\s\x1c-\x1f]&&[^\n]]"
# What marks a list item.
MARKER = rf"(?:\(\d+\)|\d+(?:{STOP}\d+)*[.)]|[A-Za-z][.)]|\([A-Za-z]\)|[-*•])"
ITEM = rf"{GAP}*{MARKER}{GAP}[^\n]+"
#: An item's line, a blank line, or the white space after a sentence, which stops before a blank or an item's line.
PARTS = rf"(?Um)^{ITEM}$\n?|^{GAP}*$\n?|(?<=[.!?])(?:{GAP}*\n(?!{GAP}*$)(?!{ITEM}$){GAP}*|{GAP}+)"


def shield(text: Column) -> Column:
    """The text with the full stops of abbreviations and between digits replaced, at the same length."""
    for a in sorted(vocab.ABBREVIATIONS, key=len, reverse=True):
        text = F.replace(text, F.lit(a), F.lit(a.replace(".", SHIELD)))
    # a digit between two full stops belongs to both: the second pass takes what the first one's matches covered
    return F.regexp_replace(text, r"(?U)(\d)\.(?=\d)", f"$1{SHIELD}")


def units(candidates: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, unit_no (from 0), unit_text, start_char, end_char, clause_number of each unit: every line with a list marker
    is one (marker as clause_number); other lines up to a blank or list line are cut into sentences. Blank parts are
    dropped, offsets count code points of the text. Null and empty texts have no unit."""
    clean = shield(F.translate(F.col(text), CUT, "\x03"))
    parts = F.filter(F.split(F.regexp_replace(clean, PARTS, f"{CUT}$0{CUT}"), CUT, -1), lambda p: p != "")
    rows = candidates.where(F.col(text).isNotNull()).select(*keys, parts.alias("parts"))
    # only a part that begins a line can be a list item
    before = F.concat(F.array(F.lit("\n")), F.slice("parts", 1, F.greatest(F.size("parts") - 1, F.lit(0))))
    lined = F.zip_with("parts", before, lambda p, b: F.struct(p.alias("p"), (F.endswith(b, F.lit("\n")) | F.startswith(p, F.lit("\n"))).alias("at_line")))
    placed = F.zip_with(lined, running(F.transform("parts", F.length)), lambda x, at: F.struct(x["p"].alias("p"), x["at_line"].alias("at_line"), at.alias("at")))
    kept = F.when(F.size("parts") > 0, F.filter(placed, lambda x: strip(x["p"]) != ""))
    flat = rows.select(*keys, F.posexplode(kept).alias("unit_no", "x"))
    flat = flat.select(*keys, "unit_no", "x.at_line", F.regexp_replace("x.p", r"\A\n+|\n+\z", "").alias("unit"), (F.col("x.at") + F.length("x.p") - F.length(F.regexp_replace("x.p", r"\A\n+", ""))).cast("int").alias("start_char"))
    number = F.regexp_extract("unit", rf"(?U)\A{GAP}*({MARKER}){GAP}[^\n]+\z", 1)
    back = lambda c: F.replace(c, F.lit(SHIELD), F.lit("."))
    return flat.select(*keys, "unit_no", back(F.col("unit")).alias("unit_text"), "start_char", (F.col("start_char") + F.length("unit")).alias("end_char"), F.when(F.col("at_line") & (number != ""), back(number)).alias("clause_number"))


def clauses(candidates: DataFrame, key: str = "doc_id", split: Callable[[DataFrame, list[str]], DataFrame] = units) -> DataFrame:
    """key, ord, clause_id, section_id, section_title, clause_text, span_start, span_end, clause_number. Sections come in
    the order of their first candidate and take its title, even a null one; clauses are numbered within a section.
    Spans are those of the candidate's text."""
    found = split(candidates.select(key, "candidate_id", "text"), [key, "candidate_id"])
    per = candidates.groupBy(key, "section_id").agg(F.min("ord").alias("section_ord"), F.min_by(F.struct(F.nullif("section_title", F.lit("")).alias("t")), "ord").alias("first"))
    about = candidates.select(key, "candidate_id", "section_id", F.col("ord").alias("candidate_ord")).join(per, [key, "section_id"]).select(key, "candidate_id", "section_id", "candidate_ord", "section_ord", F.col("first.t").alias("title"))
    # units are written before they are numbered, as numbering reads them twice
    joined = Workspace(candidates.sparkSession, "units").write(found.join(about, [key, "candidate_id"]))
    placed = numbered(joined, [key], ["section_ord", "candidate_ord", "unit_no"], bucket_of("section_ord", 256), "ord")
    placed = numbered(placed, [key, "section_id"], ["candidate_ord", "unit_no"], bucket_of("candidate_ord", 256), "_k")
    return placed.select(
        key,
        F.col("ord").cast("int").alias("ord"),
        F.concat("section_id", F.lit("_C"), F.format_string("%03d", F.col("_k") + 1)).alias("clause_id"),
        "section_id",
        F.col("title").alias("section_title"),
        F.col("unit_text").alias("clause_text"),
        F.col("start_char").alias("span_start"),
        F.col("end_char").alias("span_end"),
        "clause_number",
    )
