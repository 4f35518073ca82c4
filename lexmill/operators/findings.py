"""Joins over a knowledge graph of obligations: which apply to a document, how well it covers them, and what hangs on
them. Tables are the caller's; thresholds are parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import find_spans

APPLIES = "requires_entity string, document_type_in array<string>"


def taxonomy_entities(clauses: DataFrame, taxonomy: list[tuple[str, str]], keys: list[str], text: str = "clause_text") -> DataFrame:
    """keys, tag, term, span_start, span_end, span_text of the terms (tag, term) of a fixed taxonomy, as whole words of any
    case; nothing beyond it is ever tagged. The terms are patterns of the plan, so the list must be one of hundreds."""
    found = find_spans(clauses, keys, text, [rf"(?iuU)(?<!\w)\Q{term}\E(?!\w)" for _, term in taxonomy])
    of = F.array(*[F.struct(F.lit(tag).alias("tag"), F.lit(term).alias("term")) for tag, term in taxonomy])[F.col("pattern_no")]
    return found.withColumn("_t", of).select(*keys, "_t.tag", "_t.term", "span_start", "span_end", "span_text")


def step(frontier: DataFrame, edges: DataFrame, kind: str, name: str, backward: bool = False, optional: bool = False) -> DataFrame:
    """frontier with `name`: where edges (scope, source, target, type) of that type lead from its column `at`, or come from.
    Rows without such an edge stay with a null if `optional`; edges are met once each, in their scope."""
    here, there = ("target", "source") if backward else ("source", "target")
    own = edges.where(F.col("type") == kind).select("scope", F.col(here).alias("at"), F.col(there).alias(name)).distinct()
    return frontier.join(own, ["scope", "at"], "left" if optional else "inner")


def seeds(documents: DataFrame, profiles: DataFrame, entities: DataFrame, required: DataFrame) -> DataFrame:
    """doc_id, obligation of documents (doc_id, document_type): those relevant for its type (profiles: document_type,
    obligation) and those that need an entity type found in it (entities: doc_id, entity_type; required: obligation,
    entity_type), once each."""
    by_type = documents.join(profiles, "document_type").select("doc_id", "obligation")
    by_entity = entities.select("doc_id", "entity_type").distinct().join(required, "entity_type").select("doc_id", "obligation")
    return by_type.unionAll(by_entity).distinct()


def related(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """candidates (doc_id, obligation) and what one link (obligation, related) leads to, marked by `linked`; an obligation
    that is a candidate itself isn't linked."""
    own = candidates.select("doc_id", "obligation", F.lit(False).alias("linked"))
    more = candidates.join(links, "obligation").select("doc_id", F.col("related").alias("obligation")).distinct()
    return own.unionAll(more.join(candidates, ["doc_id", "obligation"], "left_anti").withColumn("linked", F.lit(True)))


def applicable(candidates: DataFrame, obligations: DataFrame, documents: DataFrame, entities: DataFrame) -> DataFrame:
    """candidates (doc_id, obligation) with `applies`: whether the document meets the obligation's applies_if (JSON with
    requires_entity, document_type_in; null or without either: always; no valid JSON: never)."""
    types = entities.where("entity_type is not null").groupBy("doc_id").agg(F.collect_set("entity_type").alias("types"))
    rows = candidates.join(obligations.select("obligation", "applies_if"), "obligation").join(documents.select("doc_id", "document_type"), "doc_id").join(types, "doc_id", "left")
    rule = F.from_json("applies_if", APPLIES)
    has = F.col("rule.requires_entity").isNull() | F.coalesce(F.array_contains("types", F.col("rule.requires_entity")), F.lit(False))
    typed = F.col("rule.document_type_in").isNull() | F.coalesce(F.array_contains("rule.document_type_in", F.col("document_type")), F.lit(False))
    valid = F.col("applies_if").isNull() | F.try_parse_json("applies_if").isNotNull()
    return rows.withColumn("rule", rule).select(*candidates.columns, (valid & has & typed).alias("applies"))


def fused(candidates: DataFrame, matches: DataFrame, least: float = 0.55) -> DataFrame:
    """candidates (doc_id, obligation, ...) with their best match (matches: doc_id, obligation, clause_id, score) of `least`
    or more, ties by clause_id: clause_id and score, null without one. Matches never add a candidate."""
    best = matches.where(F.col("score") >= least).groupBy("doc_id", "obligation").agg(F.min(F.struct((-F.col("score")).alias("s"), "clause_id")).alias("b"))
    return candidates.join(best, ["doc_id", "obligation"], "left").select(*candidates.columns, F.col("b.clause_id").alias("clause_id"), (-F.col("b.s")).alias("score"))


def coverage(scored: DataFrame, patterns: DataFrame, high: float = 0.8, low: float = 0.55) -> DataFrame:
    """scored (doc_id, obligation, applies, score, ...) with coverage_score, the greater of score and the pattern's
    (patterns: doc_id, obligation, pattern_score), and status by the two thresholds."""
    best = patterns.groupBy("doc_id", "obligation").agg(F.max("pattern_score").alias("pattern_score"))
    met = scored.join(best, ["doc_id", "obligation"], "left").withColumn("coverage_score", F.greatest("score", "pattern_score")).drop("pattern_score")
    at_least = lambda x: F.coalesce(F.col("coverage_score") >= x, F.lit(False))
    return met.withColumn("status", F.when(~F.col("applies"), "NOT_APPLICABLE").when(at_least(high), "SATISFIED").when(at_least(low), "PARTIALLY_SATISFIED").otherwise("MISSING"))


def attached(findings: DataFrame, links: DataFrame, key: str, value: str, name: str, when: list[str] | None = None, but: DataFrame | None = None) -> DataFrame:
    """findings with `name`: the values that links (key, value) give its key, sorted, but for those in `but` (value); an
    empty array where there are none, or where the status isn't in `when`."""
    known = links if but is None else links.join(but.select(value).distinct(), value, "left_anti")
    listed = known.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(name))
    none = F.array().cast(listed.schema[name].dataType)
    own = F.coalesce(name, none)
    out = findings.join(listed, key, "left")
    return out.withColumn(name, own if when is None else F.when(F.col("status").isin(when), own).otherwise(none))


def frameworks(findings: DataFrame) -> DataFrame:
    """doc_id, framework, applicable, n_findings, n_open of findings (doc_id, framework, status): a framework is applicable
    if one of its findings is; the others stay in the list."""
    live = F.col("status") != "NOT_APPLICABLE"
    return findings.groupBy("doc_id", "framework").agg(F.bool_or(live).alias("applicable"), F.count("*").alias("n_findings"), F.count_if(F.col("status").isin("MISSING", "PARTIALLY_SATISFIED")).alias("n_open"))


def unsupported(candidates: DataFrame, patterns: DataFrame, matches: DataFrame, least: float = 0.55) -> DataFrame:
    """candidates (doc_id, obligation, ...) with neither a pattern nor a match of `least` or more."""
    keys = ["doc_id", "obligation"]
    return candidates.join(patterns.select(*keys).unionAll(matches.where(F.col("score") >= least).select(*keys)).distinct(), keys, "left_anti")


def answer_faults(answers: DataFrame, text: str, citations: str, status: str, phrases: dict[str, str], pattern: str = r"(?i)section\s+\d+(?:\.\d+)*[A-Z]?", sentences: int = 4) -> DataFrame:
    """answers with `faults` (an array, empty for a good one): unknown_citation where the text cites (pattern) what isn't in
    the citations, status_conflict where it has a phrase (phrase: status) of another status, too_long beyond `sentences`,
    markdown. A null text is missing."""
    low = F.lower(F.col(text))
    cited = F.transform(F.regexp_extract_all(F.col(text), F.lit(f"({pattern})"), 1), lambda x: F.lower(F.regexp_replace(x, r"\s+", " ")))
    allowed = F.transform(F.coalesce(citations, F.array().cast("array<string>")), lambda x: F.lower(F.regexp_replace(x, r"\s+", " ")))
    conflict = reduce(Column.__or__, [F.contains(low, F.lit(p)) & (F.col(status) != s) for p, s in phrases.items()], F.lit(False))
    n = F.size(F.filter(F.split(F.trim(F.col(text)), r"(?<=[.!?])\s+"), lambda x: x != ""))
    faults = [
        F.when(F.col(text).isNull(), "missing"),
        F.when(F.size(F.array_except(cited, allowed)) > 0, "unknown_citation"),
        F.when(conflict, "status_conflict"),
        F.when(n > sentences, "too_long"),
        F.when(F.col(text).rlike(r"(?m)^\s*(?:#{1,6}\s|[-*]\s|\d+\.\s)|\*\*|`|\[[^\]]*\]\("), "markdown"),
    ]
    return answers.withColumn("faults", F.array_compact(F.array(*faults)))


def by_section(findings: DataFrame, keys: list[str], columns: list[str], order: str) -> DataFrame:
    """keys, n, findings (JSON array, by `order`): the findings of one section together, for one prompt."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct(order, F.struct(*columns).alias("v")))), lambda x: x["v"])
    return findings.groupBy(*keys).agg(F.count("*").alias("n"), F.to_json(listed).alias("findings"))


def fallback_text(title: Column, framework: Column, section: Column, status: Column, citation: Column) -> Column:
    """The text for a finding without a model: null parts are left out."""
    words = F.lower(F.regexp_replace(status, "_", " "))
    return F.concat_ws(" ", F.concat(F.lit('"'), title, F.lit('"')), F.lit("under"), framework, section, F.lit("is currently"), words, F.concat(F.lit("based on this document"), F.lit(".")), citation)
