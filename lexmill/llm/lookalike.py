"""Problem 3: one consistent form for texts that look the same.

Method: the stretches of a text that aren't plain ASCII are exploded to positioned code points; broadcast joins bring
each code point's decomposition (and, in words of mixed script, its look-alike); combining marks are ordered by class;
the code points are recomposed and the strings rebuilt. Each distinct stretch is worked on once, however often it occurs.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.textarrays import code_points
from lexmill.session import Workspace, broadcast_if_small

#: A stretch is what lies between two ASCII spaces or controls, if it holds anything but ASCII. Texts are cut with
#: split(), whose time is in proportion to their length; that of regexp_extract_all() grows with its square.
NOT_ASCII, GAP = r"[^\x00-\x7F]", r"[\x00-\x20]+"
GAP_EDGES = r"(?<=[\x00-\x20])(?=[^\x00-\x20])|(?<=[^\x00-\x20])(?=[\x00-\x20])"
WORD_EDGES = r"(?<=\p{L})(?=\P{L})|(?<=\P{L})(?=\p{L})"

# Letters of Latin, Greek and Cyrillic script that look alike ("-" where a script has none) and that come
# before what the public confusables say.
LOOKALIKES = """
A Α А
B Β В
C - С
E Ε Е
H Η Н
I Ι І
J - Ј
K Κ К
M Μ М
N Ν -
O Ο О
P Ρ Р
S - Ѕ
T Τ Т
X Χ Х
Y Υ Ү
Z Ζ -
a α а
c ϲ с
d - ԁ
e - е
h - һ
i ι і
j ϳ ј
k κ к
m - м
n - п
o ο о
p ρ р
q - ԛ
s - ѕ
t τ т
u υ и
v ν ѵ
w ω ԝ
x χ х
y γ у
r - г
- Γ Г
- Λ Л
- Π П
- Φ Ф
- ε є
- π п
- φ ф
"""


# Characters without width that are no format characters: the grapheme joiner and the fillers.
FILLERS = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0"
#: Tags of decompositions of characters that are a shape of others joined.
JOINED = ("<compat>", "<isolated>", "<initial>", "<medial>", "<final>")


def is_widthless(c: str) -> bool:
    """Whether the character shows no width: format characters but the visible Arabic and Kaithi signs, variation
    selectors, the grapheme joiner and the fillers."""
    if unicodedata.category(c) == "Cf":
        return not unicodedata.name(c, "").startswith(("ARABIC NUMBER", "ARABIC SIGN", "ARABIC FOOTNOTE", "ARABIC END", "ARABIC POUND", "ARABIC PIASTRE", "ARABIC DISPUTED", "KAITHI", "SYRIAC ABBREVIATION"))
    return c in FILLERS or unicodedata.name(c, "").startswith(("VARIATION SELECTOR", "MONGOLIAN FREE VARIATION"))


def plain(c: str) -> str:
    """The character's full decomposition in the consistent form: canonical, of width variants and ligatures; widthless
    characters vanish and spaces become the ordinary one."""
    if is_widthless(c):
        return ""
    if unicodedata.category(c) == "Zs":
        return " "
    tag, _, rest = unicodedata.decomposition(c).partition(" ")
    if tag in ("<wide>", "<narrow>") or tag in JOINED and "LIGATURE" in unicodedata.name(c, ""):
        return "".join(plain(chr(int(x, 16))) for x in rest.split())
    return unicodedata.normalize("NFD", c)


@cache
def plain_forms() -> list[tuple[str, str]]:
    """Characters beyond ASCII that aren't their own plain form or are combining marks, with that form. Hangul syllables
    are left out: recomposition takes them as they are."""
    every = (chr(k) for k in range(0x80, 0x110000) if not 0xD800 <= k < 0xE000 and not 0xAC00 <= k < 0xD7A4 and unicodedata.category(chr(k)) != "Cn")
    return [(c, p) for c in every if (p := plain(c)) != c or unicodedata.combining(c)]


def decompositions(spark: SparkSession) -> DataFrame:
    """ch, parts (its plain form, as characters), marks (combining class of each part), of every character beyond ASCII
    that isn't its own plain form or is a combining mark. Bounded by Unicode: some 15,000 rows."""
    rows = [(c, list(p), [unicodedata.combining(x) for x in p]) for c, p in plain_forms()]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["ch", "parts", "marks"]), "ch string, parts array<string>, marks array<int>")


def lookalikes(spark: SparkSession) -> DataFrame:
    """ch, script and its look-alike in each script (itself in its own; null where it has none): those of LOOKALIKES, and
    for all other letters of the three scripts the public confusables, as ICU (a library of Spark's own) has them: letters
    of one skeleton look alike; of several in a script, one of the same case with the least code point."""
    rows = {}
    for line in LOOKALIKES.split("\n"):
        group = line.split()
        for k, c in enumerate(group):
            if c != "-" and c not in rows:
                rows[c] = [x if x != "-" else None for x in group]
    letters = [(chr(k), SCRIPTS.index(name.split(" ")[0].lower())) for k in range(0x110000) if (name := unicodedata.name(chr(k), "")).startswith(("LATIN ", "GREEK ", "CYRILLIC ")) and unicodedata.category(chr(k))[0] == "L" and unicodedata.normalize("NFD", chr(k)) == chr(k)]
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    skeletons = checker.getSkeleton("\n".join(c for c, _ in letters)).split("\n")
    alike: dict[str, list[tuple[str, int]]] = {}
    for (c, script), skeleton in zip(letters, skeletons, strict=True):
        alike.setdefault(skeleton, []).append((c, script))
    for same in alike.values():
        for c, own in same:
            known = rows.setdefault(c, [None] * 3)
            known[own] = c
            for k in range(3):
                others = sorted((x.isupper() != c.isupper(), x) for x, script in same if script == k)
                known[k] = known[k] or (others[0][1] if others else None)
    return spark.createDataFrame([(c, *x) for c, x in rows.items() if sum(y is not None for y in x) > 1], "ch string, latin string, greek string, cyrillic string")


def characters(text: str) -> Column:
    return F.split(F.col(text), "")


def key_of(text: str) -> Column:
    """A short key for a text, as exploded rows would each carry the whole of it."""
    return F.unhex(F.md5(text)).alias("key")


def stretches_of(text: str) -> Column:
    return F.filter(F.array_distinct(F.split(F.col(text), GAP)), lambda x: x.rlike(NOT_ASCII))


@cache
def compositions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted pairs (first << 21 | second) of characters that compose, what they compose to, and by code point the
    combining class. Hangul syllables go by arithmetic and aren't listed."""
    pairs = {}
    for k in range(0x110000):
        parts = unicodedata.decomposition(chr(k)).split(" ")
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", chr(k)) == chr(k):
            pairs[int(parts[0], 16) << 21 | int(parts[1], 16)] = k
    keys = np.array(sorted(pairs), np.int64)
    return keys, np.array([pairs[int(k)] for k in keys], np.int64), np.fromiter((unicodedata.combining(chr(k)) for k in range(0x110000)), np.uint8, 0x110000)


def pair_of(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """What two characters compose to; 0 where they don't."""
    keys, made, _ = compositions()
    key = first << 21 | second
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    out = np.where(keys[at] == key, made[at], 0)
    # Hangul: leading consonant and vowel, then a syllable without a final and the final
    lead, vowel, final, syllable = first - 0x1100, second - 0x1161, second - 0x11A7, first - 0xAC00
    out = np.where((lead >= 0) & (lead < 19) & (vowel >= 0) & (vowel < 21), 0xAC00 + (lead * 21 + vowel) * 28, out)
    return np.where((syllable >= 0) & (syllable < 11172) & (syllable % 28 == 0) & (final > 0) & (final < 28), first + final, out)


def composed_texts(texts: list[str]) -> list[str]:
    """The texts, decomposed and their marks in order, recomposed: in each round, every starter takes the first character
    behind those it has tried that no mark of its class or a higher one blocks and that composes with it. Texts must not
    hold line ends."""
    points = code_points("\n".join(texts)).astype(np.int64)
    mark = compositions()[2]
    tried = np.full(len(points), -1)
    place = np.arange(len(points))
    while len(points):
        cc = mark[points].astype(np.int64)
        starter = np.maximum.accumulate(np.where(cc == 0, np.arange(len(points)), -1))
        own = np.r_[-1, starter[:-1]]
        before = np.r_[0, cc[:-1]]
        adjacent = own == np.arange(len(points)) - 1
        open_ = (own >= 0) & (adjacent | ((cc > 0) & (before < cc)))
        at = np.flatnonzero(open_)
        made = pair_of(points[own[at]], points[at])
        good = (made > 0) & (place[at] > tried[own[at]])
        at, made = at[good], made[good]
        if not len(at):
            break
        # a starter that is itself taken waits for the next round
        free = ~np.isin(own[at], at[cc[at] == 0])
        at, made = at[free], made[free]
        takers, first = np.unique(own[at], return_index=True)
        at, made = at[first], made[first]
        points[takers], tried[takers] = made, place[at]
        keep = np.ones(len(points), bool)
        keep[at] = False
        points, tried, place = points[keep], tried[keep], place[keep]
    return points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").split("\n") if texts else []


@F.pandas_udf(T.StringType())
def recompose(decomposed: pd.Series) -> pd.Series:
    return pd.Series(composed_texts(decomposed.tolist()))


SCRIPTS = ("latin", "greek", "cyrillic")


def letters_of(script: str) -> str:
    return rf"[\p{{L}}&&\p{{Is{script.title()}}}]"


def mixes_scripts(text: Column) -> Column:
    """Whether some maximal run of letters has letters of two of the three scripts."""
    words = F.split(text, r"\P{L}+")
    kinds = lambda w: sum((w.rlike(letters_of(s)).cast("int") for s in SCRIPTS), F.lit(0))
    return F.exists(words, lambda w: kinds(w) > 1)


def composed(stretches: DataFrame) -> DataFrame:
    """Adds `form` to distinct stretches: decomposed by the broadcast table, marks in order, recomposed."""
    spark = stretches.sparkSession
    keyed = stretches.select(key_of("stretch"), "stretch")
    exploded = keyed.select("key", F.posexplode(characters("stretch")).alias("pos", "ch"))
    parts = exploded.join(F.broadcast(decompositions(spark)), "ch", "left").select("key", "pos", F.posexplode(F.arrays_zip(F.coalesce("parts", F.array("ch")).alias("c"), F.coalesce("marks", F.array(F.lit(0))).alias("m"))).alias("sub", "x"))
    # behind its starter, a run of marks is sorted by class, marks of one class staying as they came
    starter = F.sum((F.col("x.m") == 0).cast("int")).over(Window.partitionBy("key").orderBy("pos", "sub").rowsBetween(Window.unboundedPreceding, 0))
    listed = parts.withColumn("starter", starter).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("starter", "x.m", "pos", "sub", "x.c"))).alias("cs"))
    ordered = F.array_join(F.transform("cs", lambda x: x["c"]), "")
    # a stretch of widthless characters only has no parts left
    return keyed.join(listed.select("key", recompose(ordered).alias("form")), "key", "left").select("stretch", F.coalesce("form", F.lit("")).alias("form"))


def one_script(forms: DataFrame) -> DataFrame:
    """Words of mixed script in `form` brought to one script: the one into which all foreign letters have look-alikes and
    that has most letters of its own there, Latin before Greek before Cyrillic; where none takes all, the script with
    most letters, as far as look-alikes go."""
    spark = forms.sparkSession
    words = forms.where(mixes_scripts(F.col("form"))).select(F.explode(F.array_distinct(F.split("form", r"\P{L}+"))).alias("word")).distinct().where(mixes_scripts(F.col("word")))
    chars = words.select(key_of("word"), F.posexplode(characters("word")).alias("pos", "ch"))
    # an accented letter is looked up by its base
    chars = chars.join(F.broadcast(decompositions(spark)), "ch", "left").withColumn("nfd", F.when(F.size("parts") > 0, F.col("parts")).otherwise(F.array("ch"))).drop("parts", "marks").withColumn("base", F.element_at("nfd", 1))
    met = chars.join(F.broadcast(lookalikes(spark)).withColumnRenamed("ch", "base"), "base", "left")
    for s in SCRIPTS:
        met = met.withColumn(f"is_{s}", F.col("ch").rlike(letters_of(s)))
    foreign = F.col("is_latin") | F.col("is_greek") | F.col("is_cyrillic")
    fits = [F.min(F.when(foreign & ~F.col(f"is_{s}"), F.col(s).isNotNull()).otherwise(True)).alias(f"fit_{s}") for s in SCRIPTS]
    own = [F.sum(F.col(f"is_{s}").cast("int")).alias(f"own_{s}") for s in SCRIPTS]
    new = [F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.concat(F.when(foreign & ~F.col(f"is_{s}"), F.coalesce(s, "base")).otherwise(F.col("base")), F.array_join(F.slice("nfd", 2, 64), "")).alias("c")))), lambda x: x["c"]), "").alias(f"as_{s}") for s in SCRIPTS]
    told = met.groupBy("key").agg(*fits, *own, *new)
    ranked = F.array_sort(F.array(*[F.struct((~F.col(f"fit_{s}") | (F.col(f"own_{s}") == 0)).cast("int").alias("bad"), (-F.col(f"own_{s}")).alias("few"), F.lit(k).alias("k"), F.col(f"as_{s}").alias("c")) for k, s in enumerate(SCRIPTS)]))
    told = told.select("key", recompose(ranked[0]["c"]).alias("new"))
    mixed = forms.where(mixes_scripts(F.col("form")))
    # the form cut into words and what lies between, the words replaced, and the whole put together again
    cut = mixed.select(F.md5("stretch").alias("id"), F.posexplode(F.split("form", WORD_EDGES)).alias("pos", "word")).withColumn("key", F.unhex(F.md5("word")))
    whole = cut.join(told, "key", "left").groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("new", "word").alias("c")))), lambda x: x["c"]), "").alias("unified"))
    return forms.join(whole, F.md5("stretch") == F.col("id"), "left").select("stretch", F.coalesce("unified", "form").alias("form"))


def met(rows: DataFrame, forms: DataFrame, spread_by: str, how: str) -> DataFrame:
    """rows joined to written forms on `stretch`: by broadcast where the forms are few, else on (stretch, salt), so that a
    stretch of many rows is several tasks' work."""
    size = forms.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("stretch")), F.lit(0)).alias("b")).first()
    small = broadcast_if_small(forms, size.n * 64 + size.b * 2, 1)
    if small is not forms:
        return rows.join(small, "stretch", how)
    salts = 32
    salted = forms.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts))).join(salted, ["stretch", "_salt"], how).drop("_salt")


def consistent_forms(df: DataFrame, text: str, work: Workspace) -> DataFrame:
    """stretch, form of every distinct stretch of the column that isn't plain ASCII, and whether it changes (or keeps a
    word of mixed script that no look-alike resolves)."""
    stretches = df.where(F.col(text).rlike(NOT_ASCII)).select(F.explode(stretches_of(text)).alias("stretch")).distinct()
    forms = work.write(composed(work.write(stretches)))
    forms = one_script(forms)
    return work.write(forms.withColumn("changed", (F.col("form") != F.col("stretch")) | mixes_scripts(F.col("form"))))


def inconsistent(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys of the records whose text isn't in the consistent form. Null, empty and ASCII texts are; repeated rows give
    one case; a key with several texts is a case if one of them is. Columns other than keys and text are ignored."""
    work = Workspace(df.sparkSession, "lookalike")
    base = df.select(*keys, F.col(text).alias("_text")).where(F.col("_text").rlike(NOT_ASCII))
    changed = consistent_forms(base, "_text", work).where("changed").select("stretch")
    rows = base.select(*keys, F.struct(*keys).alias("_key"), F.explode(stretches_of("_text")).alias("stretch"))
    return met(rows, changed, "_key", "left_semi").select(*keys).distinct()


def consistent(df: DataFrame, text: str, out: str = "consistent_text") -> DataFrame:
    """df with the column `out`: its text in the consistent form, null for null. All rows and columns stay, repeated rows
    included; `out` may not be among the columns."""
    if out in df.columns:
        raise ValueError(f"{out} is already a column")
    work = Workspace(df.sparkSession, "lookalike")
    texts = df.where(F.col(text).rlike(NOT_ASCII)).select(F.col(text).alias("_text")).distinct()
    forms = consistent_forms(texts, "_text", work).where("form != stretch").select("stretch", "form")
    keyed = texts.select(F.md5("_text").alias("_key"), "_text")
    parts = keyed.select("_key", F.posexplode(F.split("_text", GAP_EDGES)).alias("pos", "stretch"))
    hits = met(parts, forms.select("stretch"), "_key", "left_semi").select("_key").distinct()
    built = met(parts.join(hits, "_key", "left_semi"), forms, "_key", "left").groupBy("_key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("form", "stretch").alias("c")))), lambda x: x["c"]), "").alias("_form"))
    return df.withColumn("_key", F.md5(text)).join(built, "_key", "left").withColumn(out, F.coalesce("_form", F.col(text))).drop("_key", "_form")
