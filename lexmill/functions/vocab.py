"""Word lists, patterns and names that results depend on, and Spark expressions built on them.

Patterns are Java's. SPACE is what Python calls white space: (?U)\\s and the separators U+001C to U+001F.
"""

from __future__ import annotations

SPACE = r"\s\x1c-\x1f"

# Typographic ligatures of PDF text and what replaces them.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}

# Notes of the cleaning steps, in the steps' order.
NOTES = {
    "line_endings": "Normalized line endings to LF",
    "ligatures": "Replaced PDF ligatures with standard character sequences",
    "nfc": "Applied Unicode NFC normalization",
    "trailing": "Trimmed trailing whitespace on each line",
    "blank_lines": "Collapsed runs of more than two consecutive blank lines",
}

# A non-negative number in Roman letters (it may be empty).
ROMAN = r"M{0,4}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})"

# Reference patterns in their order, with the type each gives.
REFERENCES = [
    (r"(?iuU)section[\s\x1c-\x1f]+(\d+)", "section"),
    (r"(?iuU)subsection[\s\x1c-\x1f]*\((\d+)\)", "subsection"),
    (r"(?iuU)rule[\s\x1c-\x1f]+(\d+)", "rule"),
    (r"(?iuU)article[\s\x1c-\x1f]+(\d+)", "article"),
    (r"(?iuU)chapter[\s\x1c-\x1f]+([IVXLCDM]+)", "chapter"),
    (r"(?iuU)schedule[\s\x1c-\x1f]+([IVXLCDM]+)", "schedule"),
    (r"(?iuU)clause[\s\x1c-\x1f]+(\d+)", "clause"),
    (r"(?iuU)regulation[\s\x1c-\x1f]+(\d+)", "regulation"),
    (r"(?U)\b[Tt]his[\s\x1c-\x1f]+Act\b", "act"),
    (r"(?U)\b[Tt]hat[\s\x1c-\x1f]+Act\b", "act"),
    (r"(?U)\b[Tt]he[\s\x1c-\x1f]+Rules\b", "rules"),
    (r"(?U)\b[Tt]he[\s\x1c-\x1f]+Code\b", "code"),
]

# Patterns the graph resolver adds.
FALLBACK_REFERENCES = [
    (r"(?iuU)\bpart[\s\x1c-\x1f]+([IVXLCDM]+|\d+)", "part"),
    (r"(?iuU)\bclause[\s\x1c-\x1f]+\(([a-z])\)", "clause"),
    (r"(?iuU)\bExplanation\b", "explanation"),
    (r"(?iuU)\bProviso\b", "proviso"),
]

# Dictionary terms of the three entity dictionaries.
ACTORS = ["data fiduciary", "data principal", "board", "central government", "state government", "controller", "processor", "authority", "court", "tribunal"]
DOCUMENTS = ["dpdp act", "it act", "constitution", "rules", "regulations"]
OBJECTS = ["personal data", "sensitive personal data", "consent", "notice", "request", "complaint", "application", "technical measures", "security safeguards"]
DICTIONARIES = [(ACTORS, "LEGAL_ACTOR", "actor_dict"), (DOCUMENTS, "LEGAL_DOCUMENT", "document_dict"), (OBJECTS, "LEGAL_OBJECT", "object_dict")]

MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"

# Time and date patterns in their order: pattern, entity type, method, confidence.
TIMES = [
    (r"(?iuU)\b\d+[\s\x1c-\x1f]*days?\b", "TIME", "time_duration", 0.9),
    (r"(?iuU)\bimmediately\b", "TIME", "time_adverb", 0.9),
    (r"(?iuU)\bwithin[\s\x1c-\x1f]+\d+[\s\x1c-\x1f]*days?\b", "TIME", "time_duration", 0.9),
    (r"(?iuU)\bbefore[\s\x1c-\x1f]+processing\b", "TIME", "time_event", 0.85),
    (rf"(?U)\b\d{{1,2}}[\s\x1c-\x1f]+{MONTH}[\s\x1c-\x1f]+\d{{4}}\b", "DATE", "date_explicit", 1.0),
    (r"(?U)\b\d{1,2}/\d{1,2}/\d{4}\b", "DATE", "date_explicit", 1.0),
    (r"(?U)\b\d{4}-\d{2}-\d{2}\b", "DATE", "date_iso", 1.0),
]

# Words that make a clause a statement.
VERBS = (
    "shall will must may can should would could is are was were be been being am have has had do does did agree accept "
    "acknowledge represent warrant indemnify comply maintain provide ensure notify disclose process collect use share transfer "
    "store delete retain require prohibit permit authorize consent certify"
).split()

# First words that continue the paragraph before.
CONTINUATIONS = "and or but because however therefore such this these those they it which that where when while although if unless until after before so".split()

# Abbreviations whose full stops end no sentence.
ABBREVIATIONS = ["e.g.", "i.e.", "etc.", "et al.", "vs.", "Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Sr.", "Jr.", "Inc.", "Ltd.", "Corp.", "Sec.", "No.", "Art.", "para.", "U.S.C.", "U.S.", "U.K.", "St."]

# First words of chapter titles, and the pattern of their numbers.
CHAPTER_WORDS = ["chapter", "ch", "article", "schedule", "part", "title", "book"]
CHAPTER_NUMBER = r"(?iuU)^(?:chapter|ch\.?|article|schedule|part|title|book)[\s\x1c-\x1f]+(\d+|[IVXLCDM]+)"

# Labels and relationship types a validated graph may hold.
NODE_LABELS = (
    "LawVersion Chapter Section SubSection Rule Definition Obligation Requirement Exception Penalty Authority Entity Actor DocumentType "
    "LegalConcept Clause PrivacyPractice SecurityPractice SensitiveData PersonalData Consent RetentionPolicy UnresolvedReference"
).split()
RELATIONSHIP_TYPES = (
    "HAS_CHAPTER HAS_SECTION HAS_SUBSECTION HAS_RULE DEFINES IMPOSES REQUIRES EXEMPTS PENALIZES ENFORCED_BY APPLIES_TO PROCESSES "
    "COLLECTS RETURNS RETAINS SHARES USES HAS_EXCEPTION REFERENCES DERIVED_FROM UNRESOLVED_REFERENCE"
).split()

# Names in the exported graph.
EXPORT_LABELS = {"LawVersion": "Document", "SubSection": "Section"}
EXPORT_TYPES = {"HAS_CHAPTER": "CONTAINS", "HAS_SECTION": "CONTAINS", "HAS_SUBSECTION": "CONTAINS", "UNRESOLVED_REFERENCE": "REFERS_TO"}
