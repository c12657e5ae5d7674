"""Scalar text functions as Column expressions: segmentation, tokens, languages, rewrites."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the data model knows it, written so that Java's and RE2's regular expressions agree.
SPACE_SET = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
SPACES = f"[{SPACE_SET}]+"
WORD_BEFORE, WORD_AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"

# Words that tell a text's language, tried in this order.
LANGUAGE_WORDS = (
    ("de", ("der", "die", "das", "und", "ist", "ein", "nicht")),
    ("fr", ("le", "la", "les", "et", "est", "une", "des")),
    ("es", ("el", "la", "los", "las", "y", "es", "un", "una")),
)
# Wordy phrases and their plain forms, in order.
PLAIN_PHRASES = (
    ("Furthermore|Moreover|Additionally", "Also"),
    ("Therefore|Thus|Hence", "So"),
    ("utilize|utilizing", "use"),
    ("in order to", "to"),
    ("it is important to note that", "Note that"),
)
# Extensions of source code files.
CODE_EXTENSIONS = ("js", "jsx", "ts", "tsx", "py", "java", "c", "cpp", "cs", "go", "rs", "rb", "php", "swift", "kt", "scala", "sh", "bash", "r", "m", "lua", "pl", "sql")


def rounded(x: Column, digits: int) -> Column:
    """Half-up rounding by IEEE operations alone, so that every engine gives the same double."""
    return F.floor(x * 10**digits + 0.5) / float(10**digits)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once for each row, however often the body names it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), 0)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACES}|{SPACES}$", "")


def sentences(text: Column) -> Column:
    """Pieces that end with a stop and white space; null text gives null."""
    return F.filter(F.transform(F.split(collapsed(text), r"(?<=[.!?]) "), lambda s: F.trim(s)), lambda s: s != "")


def tokens(text: Column) -> Column:
    """Lower-cased ASCII words of at least two characters."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: F.length(w) > 1)


def paragraphs(text: Column, longer_than: int = 40) -> Column:
    """Blocks between empty lines, trimmed, if longer than `longer_than` characters."""
    return F.filter(F.transform(F.split(text, "\n{2,}"), lambda p: trimmed(p)), lambda p: F.length(p) > longer_than)


def language(text: Column) -> Column:
    """multilingual if over 15 % is not ASCII, else the first language one of whose words occurs, else en."""
    odd = F.length(F.regexp_replace(text, r"[\x00-\x7F]", "")) / F.greatest(F.lit(1), F.length(text))
    out = F.when(odd > 0.15, "multilingual")
    for name, words in LANGUAGE_WORDS:
        out = out.when(text.rlike(f"(?i){WORD_BEFORE}({'|'.join(words)}){WORD_AFTER}"), name)
    return F.when(text.isNotNull(), out.otherwise("en"))


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), SPACES, " "))


def readable(text: Column) -> Column:
    """Plain phrases for wordy ones, clauses of long texts broken off, first letter a capital."""
    out = trimmed(text)
    for words, plain in PLAIN_PHRASES:
        out = F.regexp_replace(out, f"(?i){WORD_BEFORE}({words}){WORD_AFTER}", plain)
    out = F.regexp_replace(out, f"[{SPACE_SET}]{{2,}}", " ")
    cut = F.regexp_replace(out, f"(?i),{SPACES}(which|that|because|while|although){SPACES}", r". $1 ")
    out = F.when(F.length(out) > 220, cut).otherwise(out)
    return F.when(F.length(out) > 1, F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, 2, 1_000_000_000))).otherwise(out)


def safe_name(name: Column) -> Column:
    """The last part of a path with every character but letters, digits, dot, line and underscore replaced."""
    return F.regexp_replace(F.regexp_replace(name, "^.*/", ""), "[^a-zA-Z0-9._-]", "_")


def extension(name: Column) -> Column:
    return F.lower(F.element_at(F.split(name, r"\."), -1))


def is_code(name: Column) -> Column:
    return extension(name).isin(*CODE_EXTENSIONS)


# Environments that hold no prose, and commands whose argument is no prose.
_NO_PROSE = "equation|align|figure|table|lstlisting|verbatim|tabular"
_NO_TEXT = "label|ref|cite|bibitem|bibliography|usepackage|documentclass|setlength|setcounter|newcommand|renewcommand|def|let"
# One alternation tells apart what a LaTeX source holds: text, comments, environments, mathematics, commands, single signs.
_LATEX = "|".join((
    r"[^%\\${}]+", r"%[^\n]*", rf"\\begin\{{(?:{_NO_PROSE})[^}}]*\}}[\s\S]*?\\end\{{[^}}]+\}}", r"\$\$[\s\S]*?\$\$", r"\$[^$\n]*?\$", r"\\[\[(][\s\S]*?\\[\])]",
    rf"\\(?:{_NO_TEXT})\s*(?:\[[^\]]*\])?\{{[^}}]*\}}", r"\\[a-zA-Z]+\*?\s*(?:\[[^\]]*\](?=\{))?", r"[\s\S]",
))


def latex_text(source: Column) -> Column:
    """Prose of a LaTeX source, in one pass over its pieces: text stays, a comment leaves nothing, anything else a space."""
    kept = F.transform(F.regexp_extract_all(source, F.lit(_LATEX), 0), lambda p: F.when(p.startswith("%"), "").when(p.isin("{", "}") | ((F.length(p) > 1) & p.rlike(r"^[\\$]")), " ").otherwise(p))
    return trimmed(F.regexp_replace(F.regexp_replace(F.array_join(kept, ""), "[ \t]+", " "), "\n{3,}", "\n\n"))
