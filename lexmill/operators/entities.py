"""Entities of clauses by dictionaries and patterns, and what is made of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import ordered, vocab
from lexmill.functions.text import find_spans, strip

KEYS = ["doc_id", "clause_id"]
TYPES = ["LEGAL_ACTOR", "PERSON", "ORGANIZATION", "LEGAL_DOCUMENT", "LEGAL_OBJECT", "TIME", "DATE", "LAW_REFERENCE"]
FIELDS = ["detector_no", "pattern_no", "start_offset", "end_offset", "entity_text", "entity_type", "confidence", "detection_method"]


def detectors() -> list[tuple[int, str, str, str, float]]:
    """(detector, pattern, type, method, confidence) of all patterns, in order."""
    out = [(k, rf"(?iuU)(?<!\w)\Q{t}\E(?!\w)", kind, method, 0.95) for k, (terms, kind, method) in enumerate(vocab.DICTIONARIES) for t in terms]
    return out + [(3, p, kind, method, confidence) for p, kind, method, confidence in vocab.TIMES]


Detector = Callable[[DataFrame, DataFrame], DataFrame]


def raw_entities(clauses: DataFrame, references: DataFrame, detectors: list[Detector] | None = None) -> DataFrame:
    """Every detection, overlapping ones included: KEYS and FIELDS. A detector takes the clauses and their references and
    gives such rows; the order of those given is in their detector_no. By default they are the dictionaries with the
    patterns, and the references."""
    found = [d(clauses, references).select(*KEYS, *FIELDS) for d in detectors or [dictionary_entities, reference_entities]]
    return reduce(DataFrame.unionByName, found)


def dictionary_entities(clauses: DataFrame, references: DataFrame, text: str = "clause_text", rules: list[tuple] | None = None) -> DataFrame:
    """Detections by rules as detectors() gives them. Within a detector, equal spans count once, for the first pattern."""
    rules = rules or detectors()
    spans = find_spans(clauses.select(*KEYS, text), KEYS, text, [r[1] for r in rules])
    lookup = F.element_at(F.array(*[F.struct(F.lit(r[0]).alias("detector_no"), F.lit(r[2]).alias("entity_type"), F.lit(r[4]).alias("confidence"), F.lit(r[3]).alias("detection_method")) for r in rules]), F.col("pattern_no") + 1)
    found = spans.withColumn("r", lookup).select(*KEYS, "r.detector_no", "pattern_no", F.col("span_start").alias("start_offset"), F.col("span_end").alias("end_offset"), F.col("span_text").alias("entity_text"), "r.entity_type", "r.confidence", "r.detection_method")
    same = Window.partitionBy(*KEYS, "detector_no", "start_offset", "end_offset").orderBy("pattern_no")
    return found.withColumn("k", F.row_number().over(same)).where("k = 1").drop("k")


def reference_entities(clauses: DataFrame, references: DataFrame) -> DataFrame:
    """The references, as entities."""
    return references.select(*KEYS, F.lit(4).alias("detector_no"), (F.col("ref_no") + 1000).alias("pattern_no"), F.col("ref_start").alias("start_offset"), F.col("ref_end").alias("end_offset"), F.col("reference_text").alias("entity_text"), F.lit("LAW_REFERENCE").alias("entity_type"), F.lit(1.0).alias("confidence"), F.lit("reference_detector").alias("detection_method"))


def numbered(raw: DataFrame, clauses: DataFrame) -> DataFrame:
    """Adds entity_id: a counter over the document's raw detections, in order of clause, detector, pattern and start.
    raw is read twice."""
    placed = raw.join(clauses.select(*KEYS, "ord"), KEYS)
    counted = ordered.numbered(placed, ["doc_id"], ["ord", "clause_id", "detector_no", "pattern_no", "start_offset"], ordered.bucket_of("ord"), "_k")
    return counted.withColumn("entity_id", F.format_string("E%03d", F.col("_k") + 1)).drop("_k")


def merged(found: DataFrame) -> DataFrame:
    """Without the detections that lie inside those before them (by start, longer first, earlier detector first);
    partial overlaps stay."""
    order = Window.partitionBy(*KEYS).orderBy("start_offset", F.desc("end_offset"), "detector_no", "pattern_no")
    cover = F.max("end_offset").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("_cover", cover).where("_cover is null or end_offset > _cover").drop("_cover")


def chunks(classified: DataFrame, entities: DataFrame, references: DataFrame, most: int = 8) -> DataFrame:
    """One chunk per clause whose text isn't blank: doc_id, chunk_id, clause_id, text, token_estimate and the context map
    (role, section_id, confidence, classification_reason, and the first `most` entities and references)."""
    top = lambda df, order, text, name: df.withColumn("_k", F.row_number().over(Window.partitionBy(*KEYS).orderBy(*order))).where(F.col("_k") <= most).groupBy(*KEYS).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_k", text))), lambda x: x[text]), ",").alias(name))
    ents = top(entities, ["start_offset", F.desc("end_offset"), "detector_no", "pattern_no"], "entity_text", "_entities")
    refs = top(references, ["ref_no"], "reference_text", "_references")
    text = strip(F.col("clause_text"))
    joined = classified.where(text != "").join(ents, KEYS, "left").join(refs, KEYS, "left")
    reasons = F.array_join("reasons", ",")
    context = F.map_filter(
        F.create_map(F.lit("role"), F.col("role"), F.lit("section_id"), F.col("section_id"), F.lit("confidence"), F.col("confidence").cast("string"), F.lit("classification_reason"), F.when(reasons != "", reasons), F.lit("entities"), F.col("_entities"), F.lit("references"), F.col("_references")),
        lambda _, v: v.isNotNull(),
    )
    return joined.select("doc_id", F.col("clause_id").alias("chunk_id"), "clause_id", text.alias("text"), F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int").alias("token_estimate"), context.alias("context"))
