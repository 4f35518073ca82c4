"""The property graph of documents, sections, clauses and references: construction, resolution, checks and export.

Graphs are two DataFrames, nodes (doc_id, ord, id, label, properties, source_clause) and edges (doc_id, ord, source,
target, type, properties). Node ids are unique within a document; (doc_id, id) is the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import vocab
from lexmill.functions.ordered import across, bucket_of, numbered
from lexmill.functions.text import find_spans, strip, words

IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_]*$"
LEVELS = {"Chapter": 1, "Section": 2, "SubSection": 3}
NUMBERED = r"(?U)^(\d+(?:\.\d+)*)\.?[\s\x1c-\x1f]"


def node_label(title: Column) -> Column:
    s = strip(F.coalesce(title, F.lit("")))
    first = F.regexp_replace(F.lower(F.element_at(words(s), 1)), r"\.+\z", "")
    number = F.regexp_extract(s, NUMBERED, 1)
    return F.when(s == "", "Section").when(first.isin(vocab.CHAPTER_WORDS), "Chapter").when(F.contains(number, F.lit(".")), "SubSection").otherwise("Section")


def node_number(title: Column) -> Column:
    s = strip(F.coalesce(title, F.lit("")))
    number = F.regexp_extract(s, NUMBERED, 1)
    return F.when(number != "", number).otherwise(F.regexp_extract(s, vocab.CHAPTER_NUMBER, 1))


def hierarchy(clauses: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the hierarchy of clauses (doc_id, ord, clause_id, section_id, section_title, clause_text) under
    documents (doc_id, title): a LawVersion per document, a Chapter, Section or SubSection per section, at its first
    clause, and a Clause per clause, each under the last node before of a lower level. Documents without clauses have no
    node; of nodes with one id the first holds; a null title is empty. A clause hangs on the section opened last, even
    where it returns to an earlier one."""
    order, bucket = ["ord", "clause_id"], bucket_of("ord")
    label = node_label(F.col("section_title"))
    rows = across(clauses.select("doc_id", "ord", "clause_id", "section_title", "clause_text", "section_id"), ["doc_id", "section_id"], order, bucket, lasts={"opened": F.lit(True)})
    rows = rows.withColumn("opens", F.col("opened").isNull()).withColumn("label", label).drop("opened")
    rows = rows.withColumn("level", F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[F.col("label")]).withColumn("node", F.concat(F.lower("label"), F.lit("_"), "section_id"))
    law = F.concat(F.lit("law_"), F.col("doc_id"))
    opened = lambda when: F.when(F.col("opens") & when, F.struct("ord", "clause_id", F.col("node").alias("id")))
    rows = across(rows, ["doc_id"], order, bucket, sums={"k": F.lit(1)}, lasts={"chapter": opened(F.col("level") == 1), "section": opened(F.col("level") == 2), "latest": opened(F.lit(True))})
    under = F.array_max(F.array_compact(F.array(F.when(F.col("level") > 1, F.col("chapter")), F.when(F.col("level") > 2, F.col("section")))))["id"]
    holder = F.when(F.col("opens"), F.col("node")).otherwise(F.col("latest.id"))
    rows = rows.withColumn("k", (F.col("k") + 1).cast("int")).select("*", F.coalesce(under, law).alias("parent"), holder.alias("holder"))
    text = F.coalesce("section_title", F.lit(""))
    section_properties = F.when(F.col("label") == "SubSection", F.create_map(F.lit("identifier"), text)).otherwise(F.create_map(F.lit("number"), node_number(F.col("section_title")), F.lit("title"), text))
    clause_properties = F.create_map(F.lit("clause_id"), F.col("clause_id"), F.lit("text"), F.col("clause_text"), F.lit("confidence"), F.lit("1.0"))
    none = F.lit(None).cast("string")
    laws = clauses.select("doc_id").distinct().join(documents.groupBy("doc_id").agg(F.max("title").alias("title")), "doc_id", "left")
    laws = laws.select("doc_id", F.lit(0).alias("ord"), law.alias("id"), F.lit("LawVersion").alias("label"), F.create_map(F.lit("law_code"), F.col("doc_id"), F.lit("title"), F.coalesce("title", F.lit(""))).alias("properties"), none.alias("source_clause"))
    made = rows.select("doc_id", F.explode(F.array_compact(F.array(
        F.when(F.col("opens"), F.struct((F.col("k") * 2).alias("ord"), F.col("node").alias("id"), "label", section_properties.alias("properties"), none.alias("source_clause"), F.col("parent").alias("above"), F.concat(F.lit("HAS_"), F.upper("label")).alias("type"))),
        F.struct((F.col("k") * 2 + 1).alias("ord"), F.concat(F.lit("clause_"), "clause_id").alias("id"), F.lit("Clause").alias("label"), clause_properties.alias("properties"), F.col("clause_text").alias("source_clause"), F.col("holder").alias("above"), F.lit("HAS_CLAUSE").alias("type")),
    ))).alias("n")).select("doc_id", "n.*")
    nodes = laws.unionByName(made.drop("above", "type"))
    first = Window.partitionBy("doc_id", "id").orderBy("ord")
    nodes = nodes.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    edges = made.select("doc_id", "ord", F.col("above").alias("source"), F.col("id").alias("target"), "type", F.create_map().cast("map<string,string>").alias("properties"))
    return nodes, edges


def reference_value(kind: Column, text: Column) -> Column:
    """What a reference names: digits, a letter in brackets or a Roman number; the whole text where there is none."""
    sub, digits, roman = F.regexp_extract(text, r"\((\d+|[a-z])\)", 1), F.regexp_extract(text, r"(\d+[A-Z]?(?:-[A-Za-z])?)", 1), F.regexp_extract(text, r"(?iU)\b([IVXLCDM]+)\b", 1)
    found = F.when(kind == "subsection", sub).when(kind.isin("section", "clause", "rule", "article", "regulation"), digits).when(kind.isin("chapter", "schedule", "part"), F.upper(roman)).otherwise("")
    return F.when(found != "", found).otherwise(text)


def collected_references(clauses: DataFrame, references: DataFrame) -> DataFrame:
    """doc_id, clause_id, kind, value, ref_text, ref_start, seq of every reference: those given and those of the fallback
    patterns, equal spans once (the given ones first), in order of start."""
    keys = ["doc_id", "clause_id"]
    given = references.where("reference_text <> '' and reference_type <> ''").select(*keys, F.col("reference_type").alias("kind"), reference_value(F.col("reference_type"), F.col("reference_text")).alias("value"), F.col("reference_text").alias("ref_text"), "ref_start", "ref_end", F.col("ref_no").cast("int").alias("seq"))
    spans = find_spans(clauses.select(*keys, "clause_text"), keys, "clause_text", [p for p, _ in vocab.FALLBACK_REFERENCES])
    kind = F.element_at(F.array(*[F.lit(t) for _, t in vocab.FALLBACK_REFERENCES]), F.col("pattern_no") + 1)
    part, letter = F.regexp_extract("span_text", r"(?iu)part[\s\x1c-\x1f]+(.+)\z", 1), F.regexp_extract("span_text", r"\((.)\)", 1)
    value = F.when(F.col("pattern_no") == 0, part).when(F.col("pattern_no") == 1, letter).otherwise(F.col("span_text"))
    more = spans.select(*keys, kind.alias("kind"), value.alias("value"), F.col("span_text").alias("ref_text"), F.col("span_start").alias("ref_start"), F.col("span_end").alias("ref_end"), (F.col("pattern_no") + 1_000_000).alias("seq"))
    same = Window.partitionBy(*keys, "ref_start", "ref_end").orderBy("seq")
    return given.unionByName(more).withColumn("_k", F.row_number().over(same)).where("_k = 1").drop("_k", "ref_end")


def node_index(nodes: DataFrame) -> DataFrame:
    """doc_id, kind, key (lower case), target: what references can name. Of nodes with one key the last holds."""
    p = lambda k: F.try_element_at("properties", F.lit(k))
    ident = F.coalesce(p("identifier"), F.lit(""))
    bracket, dotted = F.regexp_extract(ident, r"\((\d+|[a-z])\)", 1), F.regexp_extract(ident, r"(\d+(?:\.\d+)*)", 1)
    entry = lambda label, kind, key, turn: F.when(F.col("label") == label, F.struct(F.lit(kind).alias("kind"), F.lower(key).alias("key"), F.lit(turn).alias("turn")))
    entries = F.array_compact(F.array(
        entry("Section", "section", p("number"), 0),
        entry("Chapter", "chapter", p("number"), 0),
        entry("SubSection", "subsection", F.when(bracket != "", bracket).otherwise(dotted), 0),
        entry("SubSection", "subsection", ident, 1),
        entry("Clause", "clause", p("clause_number"), 0),
        entry("LawVersion", "law", p("law_code"), 0),
    ))
    rows = nodes.select("doc_id", "ord", "id", F.explode(entries).alias("e")).where("e.key <> ''")
    return rows.groupBy("doc_id", "e.kind", "e.key").agg(F.max_by("id", F.struct("ord", "e.turn", "id")).alias("target"))


def title_index(nodes: DataFrame) -> DataFrame:
    """doc_id, kind, target: the node of the first title that holds the word explanation or proviso; of nodes with one
    title the last holds, at the place of the first."""
    title = F.lower(F.try_element_at("properties", F.lit("title")))
    per = nodes.select("doc_id", "ord", "id", title.alias("title")).where("title <> ''").groupBy("doc_id", "title").agg(F.min("ord").alias("first"), F.max_by("id", "ord").alias("id"))
    hits = per.select("doc_id", "first", "id", F.explode(F.array_compact(F.array(*[F.when(F.contains("title", F.lit(k)), F.lit(k)) for k in ("explanation", "proviso")]))).alias("kind"))
    return hits.groupBy("doc_id", "kind").agg(F.min_by("id", F.struct("first", "id")).alias("target"))


def resolve(nodes: DataFrame, clauses: DataFrame, references: DataFrame) -> DataFrame:
    """Every collected reference of a clause that has a node, with its source and target node; target null if unresolved.
    Sections, chapters, subsections, clauses and laws are looked up by number; articles and parts as chapters, then as
    sections; schedules, rules, regulations and codes never resolve."""
    refs = collected_references(clauses, references)
    sources = nodes.where("label = 'Clause'").select("doc_id", F.element_at("properties", "clause_id").alias("clause_id"), F.col("id").alias("source"), F.col("ord").alias("clause_ord"))
    refs = refs.join(sources, ["doc_id", "clause_id"]).withColumn("key", F.lower("value"))
    first = F.when(F.col("kind").isin("article", "part"), "chapter").when(F.col("kind") == "act", "law").when(F.col("kind").isin("section", "chapter", "subsection", "clause"), F.col("kind"))
    second = F.when(F.col("kind").isin("article", "part"), F.struct(F.lit("section").alias("k"), F.col("key").alias("v"))).when(F.col("kind") == "subsection", F.struct(F.lit("subsection").alias("k"), F.regexp_extract("key", r"\((\d+|[a-z])\)", 1).alias("v")))
    refs = refs.withColumn("k1", first).withColumn("s", second).withColumn("k2", F.col("s.k")).withColumn("v2", F.col("s.v")).drop("s")
    index = node_index(nodes)
    one = index.select("doc_id", F.col("kind").alias("k1"), "key", F.col("target").alias("t1"))
    two = index.select("doc_id", F.col("kind").alias("k2"), F.col("key").alias("v2"), F.col("target").alias("t2"))
    named = title_index(nodes).select("doc_id", "kind", F.col("target").alias("t3"))
    met = refs.join(one, ["doc_id", "k1", "key"], "left").join(two, ["doc_id", "k2", "v2"], "left").join(named, ["doc_id", "kind"], "left")
    return met.select("doc_id", "clause_id", "clause_ord", "kind", "value", "ref_text", "ref_start", "seq", "source", F.coalesce("t1", "t2", "t3").alias("target"))


def link(nodes: DataFrame, edges: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with REFERENCES edges for resolved references (not to the clause itself) and, for the others, an
    UnresolvedReference node each and an edge to it; equal edges and nodes once, the first reference's text kept."""
    name = F.concat(F.lit("unresolved_"), "clause_id", F.lit("_"), "kind", F.lit("_"), F.lower(F.regexp_replace("value", "[^a-zA-Z0-9]", "_")))
    rows = resolved.where("target is null or target <> source").select("*", F.coalesce("target", name).alias("to"), F.when(F.col("target").isNull(), "UNRESOLVED_REFERENCE").otherwise("REFERENCES").alias("type"))
    same = Window.partitionBy("doc_id", "source", "to", "type").orderBy("clause_ord", "ref_start", "seq")
    once = rows.withColumn("_k", F.row_number().over(same)).where("_k = 1")
    end = F.lit(1 << 30) + F.col("clause_ord")
    added = once.where("target is null").select("doc_id", end.cast("int").alias("ord"), F.col("to").alias("id"), F.lit("UnresolvedReference").alias("label"), F.create_map(F.lit("reference_text"), "ref_text", F.lit("reference_type"), "kind", F.lit("clause_id"), "clause_id").alias("properties"), F.col("clause_id").alias("source_clause"))
    joined = once.select("doc_id", end.cast("int").alias("ord"), "source", F.col("to").alias("target"), "type", F.create_map().cast("map<string,string>").alias("properties"))
    return nodes.unionByName(added), edges.unionByName(joined)


def violations(nodes: DataFrame, edges: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """doc_id, rule, subject of every broken rule: empty_graph (of the documents given), unknown_label,
    empty_properties, duplicate_id, unknown_type, dangling_source, dangling_target, self_loop. A null label, type or end
    is unknown or dangling."""
    known = nodes.select("doc_id", "id").distinct()
    found = [
        nodes.where(~F.coalesce(F.col("label").isin(vocab.NODE_LABELS), F.lit(False))).select("doc_id", F.lit("unknown_label").alias("rule"), F.col("id").alias("subject")),
        nodes.where("properties is null or size(properties) = 0").select("doc_id", F.lit("empty_properties"), "id"),
        nodes.groupBy("doc_id", "id").count().where("count > 1").select("doc_id", F.lit("duplicate_id"), "id"),
        edges.where(~F.coalesce(F.col("type").isin(vocab.RELATIONSHIP_TYPES), F.lit(False))).select("doc_id", F.lit("unknown_type"), edge_name()),
        edges.join(known.withColumnRenamed("id", "source"), ["doc_id", "source"], "left_anti").select("doc_id", F.lit("dangling_source"), edge_name()),
        edges.join(known.withColumnRenamed("id", "target"), ["doc_id", "target"], "left_anti").select("doc_id", F.lit("dangling_target"), edge_name()),
        edges.where("source = target").select("doc_id", F.lit("self_loop"), edge_name()),
    ]
    if documents is not None:
        found.append(documents.select("doc_id").distinct().join(nodes.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit("empty_graph"), F.lit("")))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def edge_name() -> Column:
    gap = lambda c: F.coalesce(c, F.lit("null"))
    return F.concat(gap("source"), F.lit(" "), gap("type"), F.lit(" "), gap("target"))


def cypher(nodes: DataFrame, edges: DataFrame, indexed: bool = True) -> DataFrame:
    """doc_id, part (0 nodes, 1 edges), no, query, parameters (JSON) and error (null, or the name that is no identifier)
    of the MERGE statement of each node and edge, numbered in the document. indexed puts the number into parameter names,
    as a statement list does; without, all statements of a label are one text, as an exporter wants it."""
    n = numbered(nodes, ["doc_id"], ["ord", "id"], bucket_of("ord"), "no").select("doc_id", F.lit(0).alias("part"), "no", "id", "label", "properties", "source_clause")
    mark = F.concat(F.lit("n"), F.col("no").cast("string")) if indexed else F.lit("n")
    own = F.create_map(F.lit("id"), F.col("id"))
    props = F.map_concat(F.map_filter(F.coalesce("properties", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("id", "source_clause")), F.when(F.col("source_clause").isNull(), own).otherwise(F.map_concat(own, F.create_map(F.lit("source_clause"), F.col("source_clause")))))
    n = n.select("doc_id", "part", "no", F.concat(F.lit("MERGE (n:"), "label", F.lit(" {id: $"), mark, F.lit("_id}) SET n += $"), mark, F.lit("_props")).alias("query"), F.concat(F.lit('{"'), mark, F.lit('_id":'), quoted("id"), F.lit(',"'), mark, F.lit('_props":'), F.to_json(props), F.lit("}")).alias("parameters"), F.when(~F.coalesce(F.col("label").rlike(IDENTIFIER), F.lit(False)), F.concat(F.lit("Invalid node label "), F.coalesce("label", F.lit("null")))).alias("error"))
    e = numbered(edges, ["doc_id"], ["ord", "source", "target", "type"], bucket_of("ord"), "no").select("doc_id", F.lit(1).alias("part"), "no", "source", "target", "type", "properties")
    mark = F.concat(F.lit("r"), F.col("no").cast("string")) if indexed else F.lit("r")
    e = e.select("doc_id", "part", "no", F.concat(F.lit("MATCH (source {id: $source_id}) MATCH (target {id: $target_id}) MERGE (source)-[r:"), "type", F.lit("]->(target) SET r += $"), mark, F.lit("_props")).alias("query"), F.concat(F.lit('{"source_id":'), quoted("source"), F.lit(',"target_id":'), quoted("target"), F.lit(',"'), mark, F.lit('_props":'), F.to_json(F.coalesce("properties", F.create_map().cast("map<string,string>"))), F.lit("}")).alias("parameters"), F.when(~F.coalesce(F.col("type").rlike(IDENTIFIER), F.lit(False)), F.concat(F.lit("Invalid relationship type "), F.coalesce("type", F.lit("null")))).alias("error"))
    return n.unionByName(e)


def quoted(name: str) -> Column:
    """A string column as a JSON string."""
    return F.regexp_replace(F.to_json(F.struct(F.coalesce(name, F.lit("")).alias("v"))), r'\A\{"v":|\}\z', "")


def exported(nodes: DataFrame, edges: DataFrame, labels: dict[str, str] | None = None, types: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The graph under the names of the export; names without a counterpart stay."""

    def renamed(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
        if not names:
            return df
        return df.withColumn(column, F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col(column)], F.col(column)))

    return renamed(nodes, "label", vocab.EXPORT_LABELS if labels is None else labels), renamed(edges, "type", vocab.EXPORT_TYPES if types is None else types)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those rows of old whose key new doesn't have: a MERGE for tables without one. Keys of new must be
    unique."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, nodes_in_ir, relationships_in_ir, one row a document with nodes."""
    e = edges.groupBy("doc_id").agg(F.count("*").alias("relationships_in_ir"))
    return nodes.groupBy("doc_id").agg(F.count("*").alias("nodes_in_ir")).join(e, "doc_id", "left").select("doc_id", "nodes_in_ir", F.coalesce("relationships_in_ir", F.lit(0)).alias("relationships_in_ir"))
