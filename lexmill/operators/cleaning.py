"""Cleaning of raw text, step by step, with a note for each step that changed it."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions import vocab


@F.pandas_udf(T.StringType())
def to_nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFC", s) if s is not None else None)


def line_endings(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def ligatures(c: Column) -> Column:
    for sign, letters in vocab.LIGATURES.items():
        c = F.replace(c, F.lit(sign), F.lit(letters))
    return c


def trailing(c: Column) -> Column:
    """White space before a line end or the text's end goes; the line ends stay."""
    return F.regexp_replace(c, r"(?U)[[\s\x1c-\x1f]&&[^\n]]+(?=\n|\z)", "")


def blank_lines(c: Column) -> Column:
    """At most two empty lines in a run: three line ends between lines, two at the text's start or end, one in a text of
    line ends only."""
    inner = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\A\n{3,}", "\n\n"), r"\n{3,}\z", "\n\n"), r"(?<=[^\n])\n{4,}(?=[^\n])", "\n\n\n")
    return F.when(c.rlike(r"\A\n{2,}\z"), F.lit("\n")).otherwise(inner)


def clean(df: DataFrame, text: str, out: str = "cleaned_text", notes: str = "cleaning_notes") -> DataFrame:
    """df with the cleaned text and the notes of the steps that changed it. A null text stays null with no notes; all
    rows and other columns stay."""
    steps = {"line_endings": line_endings, "ligatures": ligatures, "nfc": None, "trailing": trailing, "blank_lines": blank_lines}
    now = df.withColumn("_s0", F.col(text))
    for k, (name, step) in enumerate(steps.items()):
        old = F.col(f"_s{k}")
        if step is None:
            # pure ASCII is in NFC as it is and doesn't visit Python
            now = now.withColumn("_wide", F.when(old.rlike(r"[^\x00-\x7F]"), old)).withColumn(f"_s{k + 1}", F.coalesce(to_nfc("_wide"), old)).drop("_wide")
        else:
            now = now.withColumn(f"_s{k + 1}", step(old))
    told = F.array_compact(F.array(*[F.when(F.col(f"_s{k}") != F.col(f"_s{k + 1}"), F.lit(vocab.NOTES[name])) for k, name in enumerate(steps)]))
    last = len(steps)
    kept = [F.col(c) for c in df.columns if c not in (out, notes)]
    return now.select(*kept, F.col(f"_s{last}").alias(out), told.alias(notes))
