"""Structural roles of clauses, and their context in the document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import vocab
from lexmill.functions.ordered import across, bucket_of
from lexmill.functions.text import find_spans, strip, words

EDGE = r"""[.,;:!?()\[\]{}'"]+"""


def has_verb(text: Column) -> Column:
    bare = F.transform(words(F.lower(text)), lambda w: F.regexp_replace(w, rf"\A{EDGE}|{EDGE}\z", ""))
    return F.arrays_overlap(bare, F.array(*[F.lit(v) for v in vocab.VERBS]))


def role(text: Column, title: Column) -> Column:
    """struct(role, confidence, reasons) of a clause's text under its section's title. A null text counts as empty."""
    s = F.coalesce(strip(text), F.lit(""))
    verb, n = has_verb(s), F.size(words(s))
    listed = s.rlike(r"(?U)^[•\-*–][\s\x1c-\x1f]|^\d+[.)][\s\x1c-\x1f]|^\(?[a-z]\)[\s\x1c-\x1f]")
    titled = (F.coalesce(title, F.lit("")) != "") & F.contains(F.lower(s), F.lower(title))
    titled = F.coalesce(titled, F.lit(False))
    upper = s.rlike(r"^\p{IsUppercase}")
    told = lambda name, confidence, reasons: F.struct(F.lit(name).alias("role"), confidence.alias("confidence"), reasons.alias("reasons"))
    why = lambda *r: F.array(*[F.lit(x) for x in r])
    heading = F.array_compact(F.array(F.lit("short_text"), F.when(titled, F.lit("matches_section_title")), F.when(upper, F.lit("title_case")), F.when(~verb, F.lit("no_verb"))))
    return (
        F.when(s == "", told("UNKNOWN", F.lit(1.0), why("empty_text")))
        .when(listed, told("LIST_ITEM", F.lit(1.0), why("list_marker_detected")))
        .when((n <= 4) & (titled | (upper & ~verb)), told("HEADING", F.when(titled, F.lit(0.95)).otherwise(F.lit(0.85)), heading))
        .when(verb, told("STATEMENT", F.lit(0.92), why("contains_verb")))
        .when(n > 4, told("STATEMENT", F.lit(0.65), why("long_text")))
        .otherwise(told("UNKNOWN", F.lit(0.5), why("no_heuristic_match")))
    )


def classify(clauses: DataFrame, classifier: Callable[[Column, Column], Column] = role) -> DataFrame:
    """clauses with role, confidence and reasons. The classifier takes the text and the section title and returns a struct
    of the three; a pandas UDF will do."""
    return clauses.withColumn("_r", classifier(F.col("clause_text"), F.col("section_title"))).select(*clauses.columns, "_r.role", "_r.confidence", "_r.reasons")


def context(clauses: DataFrame, key: str = "doc_id") -> DataFrame:
    """clauses with previous_clause_id, next_clause_id, neighbor_clause_ids (over the whole document), section_position
    (from 0), is_first_in_section and is_last_in_section. Order is by ord, then clause_id."""
    order, bucket = ["ord", "clause_id"], bucket_of("ord")
    near = across(clauses, [key], order, bucket, lasts={"previous_clause_id": F.col("clause_id")}, leads={"next_clause_id": F.col("clause_id")})
    out = across(near, [key, "section_id"], order, bucket, sums={"section_position": F.lit(1)}, leads={"_more": F.lit(True)})
    out = out.withColumn("section_position", F.col("section_position").cast("int")).withColumn("is_last_in_section", F.col("_more").isNull()).drop("_more")
    return out.withColumn("is_first_in_section", F.col("section_position") == 0).withColumn("neighbor_clause_ids", F.array_compact(F.array("previous_clause_id", "next_clause_id")))


def references(clauses: DataFrame, keys: list[str] = ["doc_id", "clause_id"], text: str = "clause_text") -> DataFrame:  # noqa: B006
    """keys, ref_no (from 0, in order of start, then of patterns), reference_text, reference_type, ref_start, ref_end. Of
    equal spans the first pattern's holds."""
    spans = find_spans(clauses, keys, text, [p for p, _ in vocab.REFERENCES])
    kind = F.element_at(F.array(*[F.lit(t) for _, t in vocab.REFERENCES]), F.col("pattern_no") + 1)
    same = Window.partitionBy(*keys, "span_start", "span_end").orderBy("pattern_no")
    order = Window.partitionBy(*keys).orderBy("span_start", "pattern_no", "span_end")
    once = spans.withColumn("k", F.row_number().over(same)).where("k = 1")
    return once.select(*keys, (F.row_number().over(order) - 1).alias("ref_no"), F.col("span_text").alias("reference_text"), kind.alias("reference_type"), F.col("span_start").alias("ref_start"), F.col("span_end").alias("ref_end"))
