"""Documents from files or inline text: scan, format, parsing, metadata; failures come as rows, not as exceptions."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.session import files_of

FORMATS = {".pdf": "pdf", ".docx": "docx", ".txt": "txt"}
#: What a parser returns: text, page_count, title, author, creation_date.
Parsed = tuple[str, int | None, str | None, str | None, str | None]
Parser = Callable[[bytes, str], Parsed]
LOADED = "doc_id string, filename string, document_format string, title string, source_path string, extra map<string,string>, raw_text string, page_count int, extraction_notes array<string>, error_kind string, error_msg string"


class Corrupted(Exception):
    """The bytes aren't a document of their format."""


class Unreadable(Exception):
    """The document can't be read as text."""


def document_format(path: Column) -> Column:
    """pdf, docx, txt or unknown, by the lower-cased suffix."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    out = F.lit("unknown")
    for s, name in FORMATS.items():
        out = F.when(suffix == s, name).otherwise(out)
    return out


def document_id(key: Column) -> Column:
    """DOC_ and eight hex digits, the same for the same key on every run."""
    return F.concat(F.lit("DOC_"), F.substring(F.sha2(key, 256), 1, 8))


def parse_txt(data: bytes, encoding: str) -> Parsed:
    try:
        return data.decode(encoding), None, None, None, None
    except (UnicodeDecodeError, LookupError) as e:
        raise Unreadable(f"TXT isn't valid {encoding}") from e


W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def parse_docx(data: bytes, encoding: str) -> Parsed:
    """Paragraphs and tables of the body in order: a line each; a table's rows are lines, its cells parted by tabs."""
    if not data:
        raise Corrupted("DOCX file is empty")
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
            core = ElementTree.fromstring(z.read("docProps/core.xml")) if "docProps/core.xml" in z.namelist() else None
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise Corrupted("DOCX file is corrupted or unreadable") from e

    def text(node: ElementTree.Element) -> str:
        marks = {f"{W}t": None, f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n"}
        return "".join((x.text or "") if marks[x.tag] is None else marks[x.tag] for x in node.iter() if x.tag in marks)

    lines = []
    for child in body if body is not None else ():
        if child.tag == f"{W}p":
            lines.append(text(child))
        elif child.tag == f"{W}tbl":
            lines += ["\t".join("\n".join(text(p) for p in cell.iter(f"{W}p")) for cell in row.iter(f"{W}tc")) for row in child.iter(f"{W}tr")]
    about = {x.tag.rpartition("}")[2]: (x.text or "").strip() or None for x in core} if core is not None else {}
    created = about.get("created")
    return "\n".join(lines), None, about.get("title"), about.get("creator"), re.sub(r"Z$", "+00:00", created) if created else None


def parse_pdf(data: bytes, encoding: str) -> Parsed:
    """Text of all pages, joined without a separator. Needs pypdf, which need not be installed."""
    if not data:
        raise Corrupted("PDF file is empty")
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise Unreadable("PDF needs the package pypdf") from e
    try:
        reader = PdfReader(io.BytesIO(data), strict=True)
        about = reader.metadata or {}
        part = lambda k: (str(about.get(k)).strip() or None) if about.get(k) else None
        return "".join(p.extract_text() or "" for p in reader.pages), len(reader.pages), part("/Title"), part("/Author"), part("/CreationDate")
    except Exception as e:
        raise Corrupted("PDF file is corrupted or unreadable") from e


PARSERS: dict[str, Parser] = {"txt": parse_txt, "docx": parse_docx, "pdf": parse_pdf}


def load(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """LOADED rows of (path, content, and optionally doc_id, title, encoding, extra), as a binaryFile scan gives them.

    A row's own title wins over the parsed one unless it is empty; author and creation_date go into extra unless there
    already. error_kind is null, unsupported_file_type, unreadable_document (null content too) or corrupted_document;
    a row with an error has a null raw_text and stays."""
    known = PARSERS if parsers is None else parsers
    has = set(files.columns)
    given = files.select(
        F.col("path"),
        F.col("content"),
        (F.col("doc_id") if "doc_id" in has else document_id(F.col("path"))).alias("doc_id"),
        (F.col("title") if "title" in has else F.lit(None).cast("string")).alias("title"),
        (F.coalesce("encoding", F.lit("utf-8")) if "encoding" in has else F.lit("utf-8")).alias("encoding"),
        (F.coalesce("extra", F.create_map().cast("map<string,string>")) if "extra" in has else F.create_map().cast("map<string,string>")).alias("extra"),
        document_format(F.col("path")).alias("document_format"),
    )

    def parse(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in rows:
            out = []
            for r in part.itertuples(index=False):
                name = r.path.rsplit("/", 1)[-1]
                text = pages = title = author = created = kind = said = None
                parser = known.get(r.document_format)
                try:
                    if parser is None:
                        kind, said = "unsupported_file_type", f"Unsupported file type: {('.' + name.rsplit('.', 1)[1].lower()) if '.' in name else 'unknown'}"
                    elif r.content is None:
                        kind, said = "unreadable_document", f"Document not found: {r.path}"
                    else:
                        text, pages, title, author, created = parser(bytes(r.content), r.encoding)
                except Unreadable as e:
                    kind, said = "unreadable_document", str(e)
                except Corrupted as e:
                    kind, said = "corrupted_document", str(e)
                except Exception:
                    kind, said = "corrupted_document", f"Failed to parse document: {name}"
                found = {k: v for k, v in (("author", author), ("creation_date", created)) if v is not None}
                extra = dict(r.extra) if not isinstance(r.extra, list) else dict(r.extra)
                out.append((r.doc_id, name, r.document_format, r.title or title, r.path, found | extra, text, pages, [], kind, said))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in re.sub(r"<[^>]*>", "", LOADED).split(", ")])
            frame["page_count"] = frame["page_count"].astype("Int32")
            yield frame

    return given.mapInPandas(parse, LOADED)


def scan(spark: SparkSession, paths: str | list[str], parsers: dict[str, Parser] | None = None) -> DataFrame:
    """LOADED rows of all files under the paths (folders, files or patterns), those of no bytes included, which Spark's own
    scan leaves out."""
    rows = spark.read.format("binaryFile").load(paths).select("path", "content")
    empty = [(p, bytearray()) for p in empty_files(spark, [paths] if isinstance(paths, str) else paths)]
    return load(rows.unionAll(spark.createDataFrame(empty, "path string, content binary")) if empty else rows, parsers)


def empty_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """The files without bytes that a scan of the paths would meet; hidden ones (. or _ before the name) aren't met."""
    out: set[str] = set()
    for path in paths:
        where, files = files_of(spark, path)
        for found in files.globStatus(where) or ():
            for f in files.listStatus(found.getPath()) if found.isDirectory() else [found]:
                if f.isFile() and f.getLen() == 0 and f.getPath().getName()[0] not in "._":
                    out.add(f.getPath().toString())
    return sorted(out)


def inline(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """LOADED rows of (name, text) pairs; ids come from the names."""
    rows = spark.createDataFrame(texts, "path string, text string")
    return load(rows.select("path", F.encode("text", "utf-8").alias("content")), {"txt": parse_txt, "unknown": parse_txt})


def checked(loaded: DataFrame) -> DataFrame:
    """The rows, failing on the first with an error when it is read."""
    return loaded.withColumn("raw_text", F.when(F.col("error_kind").isNotNull(), F.raise_error(F.concat("error_kind", F.lit(": "), "error_msg"))).otherwise(F.col("raw_text")))
