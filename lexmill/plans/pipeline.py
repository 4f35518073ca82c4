"""The whole way from raw texts to chunks, previews and graphs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators import blocks as B
from lexmill.operators import classify as K
from lexmill.operators import clauses as C
from lexmill.operators import cleaning, entities, graph, sections
from lexmill.session import Workspace, files_of
from lexmill.sources import stores


@dataclass
class Outputs:
    cleaned: DataFrame
    sections: DataFrame
    blocks: DataFrame
    candidates: DataFrame
    clauses: DataFrame
    classified: DataFrame
    context: DataFrame
    references: DataFrame
    entities: DataFrame
    chunks: DataFrame


@dataclass
class Parts:
    """The steps that a caller may put others in place of, each with the contract of its default."""

    heading: Callable = sections.heading
    splitter: Callable = C.units
    classifier: Callable = K.role
    references: Callable = K.references
    context: Callable = K.context
    detectors: list[Callable] = field(default_factory=lambda: [entities.dictionary_entities, entities.reference_entities])
    merger: Callable = entities.merged


def run(documents: DataFrame, text: str = "raw_text", parts: Parts | None = None) -> Outputs:
    """All stages over documents (doc_id unique, text). Cleaned texts, sections, candidates and clauses, which several
    stages read, are written once to the shared folder; everything else stays lazy. Documents of null text give no rows
    beyond `cleaned`."""
    parts = parts or Parts()
    work = Workspace(documents.sparkSession, "pipeline")
    cleaned = work.write(cleaning.clean(documents, text))
    found = work.write(sections.sections(cleaned, detect=parts.heading))
    cut = B.blocks(found)
    grouped = work.write(B.candidates(cut))
    made = work.write(C.clauses(grouped, split=parts.splitter))
    classified = K.classify(made, parts.classifier)
    references = work.write(parts.references(made))
    raw = work.write(entities.raw_entities(made, references, detectors=parts.detectors))
    kept = work.write(parts.merger(entities.numbered(raw, made)))
    return Outputs(cleaned, found, cut, grouped, made, classified, parts.context(classified), references, kept, entities.chunks(classified, kept, references))


def knowledge_graph(documents: DataFrame, clauses: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the hierarchy with its references resolved."""
    nodes, edges = graph.hierarchy(clauses, documents)
    return graph.link(nodes, edges, graph.resolve(nodes, clauses, references))


def preview(out: Outputs) -> DataFrame:
    """doc_id, preview: one JSON object a document of its cleaned text, sections, clauses, classifications, references,
    entities and chunks, each list in document order."""

    def listed(df: DataFrame, name: str, order: list[str], columns: list[str]) -> DataFrame:
        packed = F.struct(*order, F.struct(*columns).alias("v"))
        return df.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(packed)), lambda x: x["v"]).alias(name))

    order = out.clauses.select("doc_id", "clause_id", "ord")
    joined = out.cleaned.where("cleaned_text is not null").select("doc_id", "cleaned_text", "cleaning_notes")
    for part in (
        listed(out.sections, "sections", ["section_no"], ["section_id", "title", "text", "span_start", "span_end", "level", "parent_section_id"]),
        listed(out.clauses, "clauses", ["ord"], ["clause_id", "section_id", "section_title", "clause_text", "span_start", "span_end", "clause_number"]),
        listed(out.classified, "classifications", ["ord"], ["clause_id", "role", "confidence", "reasons"]),
        listed(out.references.join(order, ["doc_id", "clause_id"]), "references", ["ord", "ref_no"], ["clause_id", "reference_text", "reference_type", "ref_start", "ref_end"]),
        listed(out.entities, "entities", ["ord", "start_offset", "end_offset", "detector_no"], ["clause_id", "entity_id", "entity_text", "entity_type", "start_offset", "end_offset", "confidence", "detection_method"]),
        listed(out.chunks.join(order, ["doc_id", "clause_id"]).withColumn("context_json", F.to_json("context")), "chunks", ["ord"], ["chunk_id", "clause_id", "text", "token_estimate", "context_json"]),
    ):
        name = part.columns[1]
        joined = joined.join(part, "doc_id", "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    return joined.select("doc_id", F.to_json(F.struct(*joined.columns), {"pretty": "true"}).alias("preview"))


def write_previews(previews: DataFrame, folder: str) -> None:
    """One file {doc_id}.json a document, written by the executors into a folder of any file system they share."""
    where, files = files_of(previews.sparkSession, folder)
    files.mkdirs(where)
    root = stores.qualified(previews.sparkSession, folder).rstrip("/")

    def put(rows) -> None:
        for r in rows:
            stores.write_file(f"{root}/{r.doc_id}.json", (r.preview + "\n").encode())

    previews.select("doc_id", "preview").foreachPartition(put)
