"""Obligations from clauses by an injected analyzer, and graphs from model answers. The model is a callable
(system, user) -> str given by the caller; it is called in the executors, a batch of rows at a time."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import vocab
from lexmill.functions.ordered import bucket_of, numbered
from lexmill.functions.text import strip
from lexmill.session import Workspace

Model = Callable[[str, str], str]
OBLIGATION = ("subject", "action", "object", "condition", "exception")
ANALYSIS = "You analyse one clause of a legal document. List the obligations it states. Answer with JSON only."
GRAPH = "You turn a legal document, given as JSON, into a graph. Use only what the JSON states. Answer with one JSON object of nodes (id, label, properties, source_clause) and relationships (source, target, type, properties), and nothing else."


def analysis_prompt(text: Column) -> Column:
    """struct(system, user) for one clause."""
    shape = json.dumps({"obligations": [{k: "" for k in OBLIGATION}]}, indent=4)
    return F.struct(F.lit(ANALYSIS).alias("system"), F.concat(F.lit(f"Shape of the answer:\n{shape}\n\nClause:\n\n"), text).alias("user"))


def graph_prompt() -> str:
    """The system prompt for graphs, with the allowed names in order."""
    return f"{GRAPH}\n\nLabels: {', '.join(sorted(vocab.NODE_LABELS))}\nRelationship types: {', '.join(sorted(vocab.RELATIONSHIP_TYPES))}"


def user_prompt(document: Column) -> Column:
    """The prompt for one document's graph, of its JSON."""
    return F.concat(F.lit("The document:\n\n"), document)


def document_json(documents: DataFrame, context: DataFrame, entities: DataFrame, references: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """doc_id, document_json: each document (doc_id and, where known, filename, document_format, title) with its clauses in
    order, and in each its entities by start, its references in order and its context. `resolved` (doc_id, clause_id,
    ref_start, resolved_clause_id, resolved_section_id) tells what references lead to; without, none is resolved.
    Documents without clauses have an empty list."""
    keys = ["doc_id", "clause_id"]
    if resolved is None:
        refs = references.withColumns({"resolved_clause_id": F.lit(None).cast("string"), "resolved_section_id": F.lit(None).cast("string")})
    else:
        refs = references.join(resolved.select(*keys, "ref_start", "resolved_clause_id", "resolved_section_id"), [*keys, "ref_start"], "left")
    refs = refs.withColumn("resolved", F.col("resolved_clause_id").isNotNull() | F.col("resolved_section_id").isNotNull())
    listed = lambda df, order, columns, name: df.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.struct(*columns).alias("v")))), lambda x: x["v"]).alias(name))
    ents = listed(entities, ["start_offset", "end_offset", "entity_id"], ["entity_id", "entity_text", "entity_type", "confidence"], "entities")
    refs = listed(refs, ["ref_no"], ["reference_text", "reference_type", "resolved", "resolved_clause_id", "resolved_section_id"], "references")
    near = ("previous_clause_id", "next_clause_id", "section_position", "is_first_in_section", "is_last_in_section", "neighbor_clause_ids")
    rows = context.join(ents, keys, "left").join(refs, keys, "left")
    full = lambda name, of: F.coalesce(name, F.array().cast(of.schema[name].dataType)).alias(name)
    clause = F.struct("clause_id", "section_id", "section_title", strip(F.col("clause_text")).alias("text"), "role", F.col("confidence").alias("classification_confidence"), full("entities", ents), full("references", refs), F.struct(*near).alias("context"))
    per = rows.select("doc_id", "ord", clause.alias("clause")).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.col("clause.clause_id").alias("id"), F.to_json("clause", {"ignoreNullFields": "false"}).alias("j")))), lambda x: x["j"]).alias("clauses"))
    known = lambda c: F.col(c) if c in documents.columns else F.lit(None).cast("string")
    about = F.to_json(F.struct(F.col("doc_id").alias("document_id"), known("filename").alias("filename"), known("document_format").alias("format"), known("title").alias("title")), {"ignoreNullFields": "false"})
    text = F.concat(F.lit('{"document":'), about, F.lit(',"clauses":['), F.array_join(F.coalesce("clauses", F.array().cast("array<string>")), ","), F.lit("]}"))
    return documents.join(per, "doc_id", "left").select("doc_id", text.alias("document_json"))


def graph_prompts(documents: DataFrame) -> DataFrame:
    """doc_id, system, user of documents (doc_id, document_json)."""
    return documents.select("doc_id", F.lit(graph_prompt()).alias("system"), user_prompt(F.col("document_json")).alias("user"))


def ask(df: DataFrame, system: str, user: str, model: Model, out: str = "answer") -> DataFrame:
    """df with the model's answer to each row's two prompts."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{out}` string"])

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in rows:
            yield part.assign(**{out: [model(s, u) for s, u in zip(part[system], part[user])]})

    return df.mapInPandas(run, schema)


def read_obligations(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """answers with obligations (array of OBLIGATION) and error. The answer must be a JSON object with an array
    `obligations` of objects whose fields are strings (condition and exception may be null); else obligations is null and
    error tells why. Missing fields are empty; an empty condition or exception is null."""
    text = strip(F.coalesce(F.col(answer), F.lit("")))
    v = F.try_parse_json(text)
    kind = F.schema_of_variant(v)
    listed = F.schema_of_variant(F.try_variant_get(v, "$.obligations", "variant"))
    elements = F.try_variant_get(v, "$.obligations", "array<variant>")
    typed = lambda x, k: F.schema_of_variant(F.try_variant_get(x, f"$.{k}", "variant"))
    good = lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT"))
    strings = lambda x: F.array_compact(F.array(*[F.when(typed(x, k).isNotNull() & (typed(x, k) != "STRING") & ~((typed(x, k) == "VOID") & F.lit(k in OBLIGATION[3:])), F.lit(k)) for k in OBLIGATION]))
    value = lambda x, k: F.coalesce(F.try_variant_get(x, f"$.{k}", "string"), F.lit(""))
    made = F.transform(elements, lambda x: F.struct(*[(F.nullif(value(x, k), F.lit("")) if k in OBLIGATION[3:] else value(x, k)).alias(k) for k in OBLIGATION]))
    wrong = F.flatten(F.transform(elements, strings))
    # What callers are told of an answer that can't be read.
    error = (
        F.when(text == "", "LLM returned an empty response.")
        .when(v.isNull(), "Invalid JSON from LLM")
        .when(~F.startswith(kind, F.lit("OBJECT")), "LLM response must be a JSON object.")
        .when(~F.coalesce(F.startswith(listed, F.lit("ARRAY")), F.lit(False)), "LLM response must contain an 'obligations' array.")
        .when(~F.forall(elements, good), "Each obligation must be a JSON object.")
        .when(F.size(wrong) > 0, F.concat(F.lit("'"), F.try_element_at(wrong, F.lit(1)), F.lit("' must be a string.")))
    )
    told = answers.withColumn("error", error)
    return told.withColumn("obligations", F.when(F.col("error").isNull(), made))


def enrich(nodes: DataFrame, edges: DataFrame, model: Model) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, failures): the graph with an Obligation node per obligation of its Clause nodes, named by its clause
    and its place among the document's obligations, and a HAS_OBLIGATION edge; clauses whose answer can't be read are the
    failures (doc_id, id, error) and leave the graph as it is."""
    given = nodes.where("label = 'Clause'").select("doc_id", "ord", "id", F.coalesce(F.element_at("properties", "text"), F.lit("")).alias("text"))
    prompts = given.withColumn("p", analysis_prompt(F.col("text"))).select("doc_id", "ord", "id", F.col("p.system").alias("system"), F.col("p.user").alias("user"))
    # the answers are written, so that the model is asked once
    read = Workspace(nodes.sparkSession, "enrich").write(read_obligations(ask(prompts, "system", "user", model)).select("doc_id", "ord", "id", "obligations", "error"))
    flat = read.select("doc_id", "ord", "id", F.posexplode("obligations").alias("k", "o"))
    flat = numbered(flat, ["doc_id"], ["ord", "id", "k"], bucket_of("ord"), "no").withColumn("name", F.concat(F.lit("obl_"), "id", F.lit("_"), F.col("no").cast("string")))
    props = F.create_map(*[x for k in OBLIGATION for x in (F.lit(k), F.coalesce(F.col(f"o.{k}"), F.lit("")))])
    added = flat.select("doc_id", "ord", F.col("name").alias("id"), F.lit("Obligation").alias("label"), props.alias("properties"), F.lit(None).cast("string").alias("source_clause"))
    joined = flat.select("doc_id", "ord", F.col("id").alias("source"), F.col("name").alias("target"), F.lit("HAS_OBLIGATION").alias("type"), F.create_map().cast("map<string,string>").alias("properties"))
    return nodes.unionByName(added), edges.unionByName(joined), read.where("error is not null").select("doc_id", "id", "error")


def unfenced(answer: Column) -> Column:
    """The answer without a code fence around it."""
    return strip(F.regexp_replace(F.regexp_replace(strip(answer), r"(?i)\A```(?:json)?\s*", ""), r"\s*```\z", ""))


IR = "nodes array<struct<id:string,label:string,properties:map<string,string>,source_clause:string>>, relationships array<struct<source:string,target:string,type:string,properties:map<string,string>>>"


def read_graphs(answers: DataFrame, answer: str = "answer") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, failures) of the graphs in JSON answers, by doc_id; names are stripped, further
    fields ignored, null or missing properties empty. A failure (doc_id, error) is an empty or invalid answer, one that isn't
    an object with both lists, and one with an element that is no object, an id, label, end or type that is no string or
    blank, properties that are no object, or a source_clause that is no string."""
    text = unfenced(F.coalesce(F.col(answer), F.lit("")))
    parsed = answers.select("doc_id", text.alias("t")).withColumn("g", F.from_json("t", IR))
    whole = F.try_parse_json("t")
    parsed = parsed.withColumn("v", whole)
    elements = lambda name: F.try_variant_get("v", f"$.{name}", "array<variant>")
    kind = lambda x, path: F.schema_of_variant(F.try_variant_get(x, path, "variant"))
    is_object = lambda x, path: F.startswith(kind(x, path), F.lit("OBJECT"))
    is_list = lambda name: F.coalesce(F.startswith(kind(F.col("v"), f"$.{name}"), F.lit("ARRAY")), F.lit(False))
    named = lambda x, n: F.coalesce((kind(x, f"$.{n}") == "STRING") & (strip(F.try_variant_get(x, f"$.{n}", "string")) != ""), F.lit(False))
    free = lambda x, n, want: F.coalesce(F.startswith(kind(x, f"$.{n}"), F.lit(want)), F.lit(True))

    def wrong(name: str, names: tuple[str, ...]) -> Column:
        """The first field that isn't as it must be, of any element."""
        fault = lambda x: F.when(~F.coalesce(is_object(x, "$"), F.lit(False)), "an element is no object").otherwise(
            F.coalesce(*[F.when(~named(x, n), f"{n} must be a string with letters") for n in names], F.when(~free(x, "properties", "OBJECT"), "properties must be an object"), F.when(~(free(x, "source_clause", "STRING") | (kind(x, "$.source_clause") == "VOID")), "source_clause must be a string")))
        return F.try_element_at(F.array_compact(F.transform(elements(name), fault)), F.lit(1))

    error = (
        F.when(F.col("t") == "", "LLM returned an empty response.")
        .when(F.col("v").isNull(), "Invalid JSON")
        .when(~F.coalesce(is_object(F.col("v"), "$"), F.lit(False)), "the graph must be an object")
        .when(~is_list("nodes"), "nodes must be a list")
        .when(~is_list("relationships"), "relationships must be a list")
        .otherwise(F.coalesce(F.concat(F.lit("nodes: "), wrong("nodes", ("id", "label"))), F.concat(F.lit("relationships: "), wrong("relationships", ("source", "target", "type")))))
    )
    told = parsed.withColumn("error", error).drop("v")
    good = told.where("error is null")
    n = good.select("doc_id", F.posexplode("g.nodes").alias("ord", "x")).select("doc_id", "ord", strip(F.col("x.id")).alias("id"), strip(F.col("x.label")).alias("label"), F.coalesce("x.properties", F.create_map().cast("map<string,string>")).alias("properties"), "x.source_clause")
    e = good.select("doc_id", F.posexplode("g.relationships").alias("ord", "x")).select("doc_id", "ord", strip(F.col("x.source")).alias("source"), strip(F.col("x.target")).alias("target"), strip(F.col("x.type")).alias("type"), F.coalesce("x.properties", F.create_map().cast("map<string,string>")).alias("properties"))
    return n, e, told.where("error is not null").select("doc_id", "error")


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, graph_json: the graph of each document as one JSON object, its lists in order."""
    n = nodes.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "id", "label", F.to_json("properties").alias("p"), "source_clause"))).alias("n"))
    e = edges.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "source", "target", "type", F.to_json("properties").alias("p")))).alias("e"))
    props = lambda p: F.from_json(p, "map<string,string>")
    both = n.join(e, "doc_id", "left")
    ns = F.transform("n", lambda x: F.struct(x["id"].alias("id"), x["label"].alias("label"), props(x["p"]).alias("properties"), x["source_clause"].alias("source_clause")))
    es = F.transform(F.coalesce("e", F.array().cast(both.schema["e"].dataType)), lambda x: F.struct(x["source"].alias("source"), x["target"].alias("target"), x["type"].alias("type"), props(x["p"]).alias("properties")))
    return both.select("doc_id", F.to_json(F.struct(ns.alias("nodes"), es.alias("relationships")), {"ignoreNullFields": "false"}).alias("graph_json"))


