"""De-obfuscation and citations as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions.text import SPACE_SET, trimmed

# Characters that count as invisible, and as unusual spaces.
INVISIBLE = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}\x{00AD}]"
UNUSUAL_SPACE = r"[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# Look-alike letters and the ASCII letters that they stand for.
CYRILLIC = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ъ": "b"}
GREEK = {"α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Υ": "Y"}
LATIN = {"ı": "i", "ȷ": "j", "ɡ": "g", "ᴀ": "a", "ᴇ": "e", "ɷ": "o", "ʏ": "y", "İ": "I"}
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "æ": "ae", "œ": "oe"}
#: Full-width forms lie at a fixed distance from ASCII.
SINGLE = CYRILLIC | GREEK | LATIN | {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
ANY_LOOK_ALIKE = "[" + "".join([*CYRILLIC, *GREEK, *LATIN, *LIGATURES]) + r"\x{FF01}-\x{FF5E}]"
FULL_WIDTH = r"[\x{FF01}-\x{FF5E}]"


def obfuscation(text: Column) -> Column:
    """array<struct<type, severity>> of what was found, in a fixed order."""
    n = F.regexp_count(text, F.lit(ANY_LOOK_ALIKE))

    def flag(kind: str, severity: Column, found: Column) -> Column:
        return F.when(found, F.struct(F.lit(kind).alias("type"), severity.alias("severity")))

    return F.filter(
        F.array(
            flag("invisible_chars", F.lit("HIGH"), text.rlike(INVISIBLE)),
            flag("unusual_whitespace", F.lit("MEDIUM"), text.rlike(UNUSUAL_SPACE)),
            flag("homoglyphs", F.when(n > 5, "HIGH").otherwise("MEDIUM"), n > 0),
            flag("fullwidth_ascii", F.lit("MEDIUM"), text.rlike(FULL_WIDTH)),
        ),
        lambda f: f.isNotNull(),
    )


def deobfuscated(text: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(text, INVISIBLE, ""), UNUSUAL_SPACE, " ")
    text = F.translate(text, "".join(SINGLE), "".join(SINGLE.values()))
    for of, to in LIGATURES.items():
        text = F.replace(text, F.lit(of), F.lit(to))
    return text


_NAME = r"[A-Z][a-zA-Zà-öø-ÿÀ-ÖØ-ß\-]+"
# The citation forms that are recognised.
APA = rf"\({_NAME}(?:\s+(?:&|and|et al\.?)\s+{_NAME})?,\s*[0-9]{{4}}(?:,\s*pp?\.\s*[0-9–\-]+)?\)"
MLA = r"\([A-Z][a-zA-Z\-]+(?:\s+(?:and|et al\.?)\s+[A-Z][a-zA-Z\-]+)?\s+[0-9]+\)"
IEEE = r"\[[0-9]+(?:[,–\-]\s*[0-9]+)*\]"
REFERENCE = r"^(?:\[[0-9]+\]|[0-9]+\.|[A-Z][a-zA-Z\-]+,\s+[A-Z]\.?)\s+[^\n]{20,}"
DOI = r"(?:doi|DOI):\s*10\.[0-9]{4,}/\S+"
URL = r"https?://\S+"


def is_citation(sentence: Column) -> Column:
    """A reference-list entry, a sentence with a DOI, or a short one with an inline citation."""
    s = trimmed(sentence)
    short = (F.length(s) < 60) & (s.rlike(IEEE) | s.rlike(APA) | s.rlike(MLA))
    return F.coalesce((s != "") & (s.rlike(REFERENCE) | s.rlike(rf"(?<![A-Za-z0-9_]){DOI}") | short), F.lit(False))


def without_citations(sentence: Column) -> Column:
    """All inline citations, the first DOI and the first URL removed."""
    for pattern in (APA, MLA, IEEE):
        sentence = F.regexp_replace(sentence, pattern, "")
    sentence = F.regexp_replace(sentence, rf"^([\s\S]*?)(?<![A-Za-z0-9_]){DOI}", "$1")
    sentence = F.regexp_replace(sentence, rf"^([\s\S]*?){URL}", "$1")
    return trimmed(F.regexp_replace(sentence, f"[{SPACE_SET}]{{2,}}", " "))
