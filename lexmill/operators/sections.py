"""Lines with offsets, headings, and the section tree of each document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import vocab
from lexmill.functions.text import strip, words

MOST_LENGTH = 120


def lines(df: DataFrame, key: str = "doc_id", text: str = "cleaned_text") -> DataFrame:
    """key, line_no (from 0), start_char, line of every line, the empty ones included. Null texts have no line; keys must
    be unique."""
    cut = df.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return cut.select(key, "line_no", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("int").alias("start_char"), "line")


def letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


def heading(s: Column, before: Column, after: Column) -> Column:
    """struct(style, level, title) of a stripped line between two others (null at the text's ends); null if it is none.
    The styles are tried in order; the first that holds decides."""
    numbered = r"(?Us)^(\d+(?:\.\d+)*)\.?[\s\x1c-\x1f]+(.+)\z"
    number, rest = F.regexp_extract(s, numbered, 1), F.regexp_extract(s, numbered, 2)
    first = F.element_at(words(rest), 1)
    capital = (first.rlike(r"\p{IsUppercase}") & ~first.rlike(r"\p{IsLowercase}|\p{Lt}") & (F.length(first) > 1)) | rest.rlike(r"^\p{IsUppercase}")
    roman = rf"(?Ui)^({vocab.ROMAN})\.?[\s\x1c-\x1f]+(?s:(.+))\z"
    # The patterns of the styles.
    marks = r"(?Us)^(#{1,6})[\s\x1c-\x1f]+(.+)\z"
    colon = F.regexp_extract(s, r"(?U)^([^\n:]{1,80}):\z", 1)
    colon_body = strip(colon)
    n_words = F.size(words(s))
    blank = lambda c: c.isNotNull() & (strip(c) == "")
    word = r"[A-Z][A-Za-z0-9'&()/\-]"
    standalone = (
        F.length(s).between(3, 80)
        & ~F.endswith(s, F.lit("."))
        & (n_words <= 12)
        & (s.rlike(rf"(?U)^{word}+(?:[\s\x1c-\x1f]+{word}+){{0,8}}\z") | s.rlike(rf"(?U)^{word}*(?:[\s\x1c-\x1f]+[A-Za-z0-9'&()/\-]+){{0,11}}[?]?\z"))
        & blank(before)
        & blank(after)
    )
    told = lambda style, level, title: F.struct(F.lit(style).alias("style"), level.cast("int").alias("level"), title.alias("title"))
    one = F.lit(1)
    return (
        F.when((s == "") | (F.length(s) > MOST_LENGTH), F.lit(None))
        .when(s.rlike(marks), told("markdown", F.length(F.regexp_extract(s, marks, 1)), F.regexp_extract(s, marks, 2)))
        .when((rest != "") & ~F.endswith(rest, F.lit(".")) & capital, told("numbered", F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1, s))
        .when((F.regexp_extract(s, roman, 1) != "") & F.regexp_extract(s, roman, 2).rlike(r"^\p{IsUppercase}"), told("roman", one, s))
        .when((letters(s) >= 2) & s.rlike(r"^[ A-Z0-9\-&.,'()/]+\z") & ~(F.endswith(s, F.lit(".")) & (n_words > 8)), told("uppercase", one, s))
        .when((colon_body != "") & ~F.endswith(colon_body, F.lit(".")) & (letters(colon_body) >= 2), told("colon", one, colon))
        .when(standalone, told("standalone", one, s))
    )


def headings(df: DataFrame, key: str = "doc_id", text: str = "cleaned_text", detect: Callable[[Column, Column, Column], Column] = heading) -> DataFrame:
    """key, line_no, start_char, style, level, title of every heading line, as `detect` tells them."""
    w = Window.partitionBy(key).orderBy("line_no")
    near = lines(df, key, text).select("*", strip(F.col("line")).alias("s"), F.lag("line").over(w).alias("before"), F.lead("line").over(w).alias("after"))
    return near.withColumn("h", detect(F.col("s"), F.col("before"), F.col("after"))).where("h is not null").select(key, "line_no", "start_char", "h.style", "h.level", "h.title")


def sections(df: DataFrame, key: str = "doc_id", text: str = "cleaned_text", detect: Callable[[Column, Column, Column], Column] = heading) -> DataFrame:
    """key, section_no, section_id, title, text, span_start, span_end, level, parent_section_id. The sections of a text
    lie end to end over the whole of it: what precedes the first heading is a section without title, as is a text
    without headings (an empty one too). A parent is the last section before of a lower level. Null texts have none."""
    found = headings(df, key, text, detect).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("line_no", "start_char", "level", "title", F.lit(True).alias("headed")))).alias("found"))
    base = df.where(F.col(text).isNotNull()).select(F.col(key), F.split(F.col(text), "\n", -1).alias("lines"), F.length(text).alias("n"))
    kind = "array<struct<line_no:int,start_char:int,level:int,title:string,headed:boolean>>"
    none = F.array().cast(kind)
    untitled = F.array(F.struct(F.lit(0).alias("line_no"), F.lit(0).alias("start_char"), F.lit(1).alias("level"), F.lit(None).cast("string").alias("title"), F.lit(False).alias("headed"))).cast(kind)
    joined = base.join(found, key, "left").withColumn("found", F.coalesce(F.col("found").cast(kind), none))
    joined = joined.withColumn("starts", F.when(F.coalesce(F.get("found", F.lit(0))["start_char"] == 0, F.lit(False)), F.col("found")).otherwise(F.concat(untitled, "found")))
    # one pass down the headings with those still open: a parent is the innermost of them once its equals are closed
    nothing = F.struct(F.array().cast("array<struct<level:int,no:int>>").alias("open"), F.array().cast("array<int>").alias("parents"))

    def step(acc: Column, x: Column) -> Column:
        left = F.filter(acc["open"], lambda o: o["level"] < x["level"])
        own = F.struct(x["level"].alias("level"), (F.size(acc["parents"]) + 1).alias("no"))
        parent = F.when(x["headed"], F.try_element_at(left, F.lit(-1))["no"])
        return F.struct(F.when(x["headed"], F.concat(left, F.array(own))).otherwise(acc["open"]).alias("open"), F.concat(acc["parents"], F.array(parent)).alias("parents"))

    parents = F.aggregate("starts", nothing, step, lambda acc: acc["parents"])
    after = F.concat(F.slice("starts", 2, 1 << 30), F.array(F.lit(None).cast(kind[6:-1])))
    joined = joined.withColumn("every", F.zip_with(F.arrays_zip(F.col("starts").alias("x"), after.alias("after")), parents, lambda z, p: F.struct(z["x"].alias("x"), z["after"].alias("after"), p.alias("parent"))))

    def section(every: Column, k: Column) -> Column:
        x, after = every["x"], every["after"]
        lines = F.slice("lines", x["line_no"] + 1, F.coalesce(after["line_no"], F.size("lines")) - x["line_no"])
        return F.struct(
            (k + 1).alias("section_no"),
            x["title"].alias("title"),
            F.concat(F.array_join(lines, "\n"), F.when(after.isNull(), "").otherwise("\n")).alias("text"),
            x["start_char"].alias("span_start"),
            F.coalesce(after["start_char"], F.col("n")).alias("span_end"),
            x["level"].alias("level"),
            every["parent"].alias("parent"),
        )

    named = lambda no: F.format_string("S%03d", no)
    every = joined.select(key, F.explode(F.transform("every", section)).alias("x"))
    return every.select(key, "x.section_no", named(F.col("x.section_no")).alias("section_id"), "x.title", "x.text", "x.span_start", "x.span_end", "x.level", F.when(F.col("x.parent").isNotNull(), named(F.col("x.parent"))).alias("parent_section_id"))


def tree_depths(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, level, n_sections, n_roots: how many sections each level holds, and how many of them have no parent."""
    return sections.groupBy(key, "level").agg(F.count("*").alias("n_sections"), F.count_if(F.col("parent_section_id").isNull()).alias("n_roots"))
