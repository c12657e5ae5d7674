"""Problem 1: visually identical text with different characters.

Every text gets a *look*: spaces of any kind become a plain space, characters that nobody sees are
dropped, and look-alike letters are mapped to one prototype. Looks are then grouped under Spark's
UNICODE collation, which is sensitive to accents and case but takes canonically equivalent spellings
(e + U+0301 and U+00E9) as equal. Of each class one member is the canonical text, by a fixed rule,
and is joined back to all members.

Defined results
- null text: no look, in no class, null plain form. Empty and blank text: an ordinary value.
- repeated rows of one key and text count once; a key with several texts takes part with each.
- ties for the canonical member: a text that is its own look first, then the smallest by code point.
- joiners that a reader sees (within emoji sequences, between letters of joining scripts) stay.
- columns besides the named key and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other scripts and letter-like symbols that look like a Latin letter.
LOOK_ALIKE = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y", "ӏ": "l", "Ӏ": "I",
    "ё": "ë", "Ё": "Ë", "ї": "ï", "Ї": "Ï", "ѐ": "è", "Ѐ": "È",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "υ": "u", "γ": "y", "ϲ": "c", "ϳ": "j",
    "ό": "ó", "ά": "á", "ί": "í", "ύ": "ú", "Ό": "Ó", "Ά": "Á", "Έ": "É", "Ί": "Í", "Ύ": "Ý", "Ή": "H́",
    "օ": "o", "հ": "h", "ո": "n", "ս": "u", "ց": "g", "զ": "q", "Օ": "O", "Տ": "S", "Լ": "L",
    "ɡ": "g", "ı": "i", "ɑ": "a", "ɩ": "i", "ʋ": "v", "ᴏ": "o", "ᴄ": "c", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ѡ": "w",
    "ⅰ": "i", "ⅴ": "v", "ⅹ": "x", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m", "Ⅰ": "I", "Ⅴ": "V", "Ⅹ": "X", "Ⅼ": "L", "Ⅽ": "C", "Ⅾ": "D", "Ⅿ": "M",
    "‐": "-", "‑": "-", "−": "-",
}
# Ligatures drawn as the letters they join.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ⅱ": "ii", "ⅲ": "iii", "ⅳ": "iv", "ⅵ": "vi", "ⅶ": "vii", "ⅸ": "ix", "Ⅱ": "II", "Ⅲ": "III", "Ⅳ": "IV", "H́": "Ή"}
del LOOK_ALIKE["Ή"], LIGATURES["H́"]

#: Full-width forms lie at a fixed distance from ASCII.
FULL_WIDTH = {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
ONE_TO_ONE = {k: v for k, v in (LOOK_ALIKE | FULL_WIDTH).items() if len(v) == 1}

SPACES = "[\\u00A0\\u1680\\u2000-\\u200A\\u202F\\u205F\\u3000]"
UNSEEN = "[\\u00AD\\u034F\\u061C\\u115F\\u1160\\u17B4\\u17B5\\u180B-\\u180E\\u200B-\\u200F\\u202A-\\u202E\\u2060-\\u206F\\uFE00-\\uFE0F\\uFEFF]"
#: Stand-ins, while unseen characters are dropped, for joiners that a reader does see.
SEEN_ZWJ, SEEN_ZWNJ = "\ue00d", "\ue00c"
# A joiner shows between pictographs, and beside letters of scripts whose letters join.
ZWJ_SHOWS = "(?<=[\\x{2190}-\\x{2BFF}\\x{1F000}-\\x{1FAFF}][\\uFE0F]?)\\u200D(?=[\\x{2190}-\\x{2BFF}\\x{1F000}-\\x{1FAFF}])|(?<=\\u094D|\\u09CD|\\u0D4D)\\u200D"
ZWNJ_SHOWS = "(?<=[\\u0620-\\u064A\\u066E-\\u06D3])\\u200C(?=[\\u0620-\\u064A\\u066E-\\u06D3])|(?<=\\u094D|\\u09CD|\\u0D4D)\\u200C"


def look(text: Column) -> Column:
    """The look of a text: JVM-side expressions only, so it stays inside code generation."""
    text = F.regexp_replace(text, SPACES, " ")
    text = F.regexp_replace(text, ZWJ_SHOWS, SEEN_ZWJ)
    text = F.regexp_replace(text, ZWNJ_SHOWS, SEEN_ZWNJ)
    text = F.regexp_replace(text, UNSEEN, "")
    text = F.translate(text, "".join(ONE_TO_ONE), "".join(ONE_TO_ONE.values()))
    for of, to in LIGATURES.items():
        text = F.replace(text, F.lit(of), F.lit(to))
    return text


_JAVA = re.compile(r"\\x\{([0-9A-F]+)\}|\\u([0-9A-F]{4})")


def _python(pattern: str) -> str:
    return _JAVA.sub(lambda m: chr(int(m[1] or m[2], 16)), pattern)


_SPACES, _UNSEEN = re.compile(_python(SPACES)), re.compile(_python(UNSEEN))
_PICTO = _python("[\\x{2190}-\\x{2BFF}\\x{1F000}-\\x{1FAFF}]")
_ZWJ_SHOWS = re.compile(f"(?:(?<={_PICTO})|(?<={_PICTO}\ufe0f))\u200d(?={_PICTO})|(?<=[\u094d\u09cd\u0d4d])\u200d")
_ZWNJ_SHOWS = re.compile(_python(ZWNJ_SHOWS).replace("(?<=\u094d|\u09cd|\u0d4d)", "(?<=[\u094d\u09cd\u0d4d])"))
_FOLD = str.maketrans(ONE_TO_ONE | LIGATURES)
# Scripts whose letters look like Latin ones: their blocks, and their own letter for each Latin one.
_BLOCKS = {"cyrillic": "\u0400-\u052f", "greek": "\u0370-\u03ff\u1f00-\u1fff", "armenian": "\u0530-\u058f"}
_OF_SCRIPT = {name: re.compile(f"[{block}]") for name, block in _BLOCKS.items()}
_BACK = {name: str.maketrans({v: k for k, v in reversed(LOOK_ALIKE.items()) if _OF_SCRIPT[name].fullmatch(k) and len(v) == 1}) for name in _BLOCKS}
#: Letters of each script that look like no letter of another one; Latin ones are those that none of the scripts has.
_OWN = {name: re.compile("[" + "".join(sorted({chr(c) for a, b in re.findall("(.)-(.)", block) for c in range(ord(a), ord(b) + 1)} - set(LOOK_ALIKE))).replace("\\", "") + "]") for name, block in _BLOCKS.items()}
_OWN_LATIN = re.compile("[" + "".join(c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" if not any(ord(c) in t for t in (_BACK["cyrillic"], _BACK["greek"]))) + "]")
_ANY_OTHER = re.compile("[" + "".join(_BLOCKS.values()) + "]")


@lru_cache(1 << 17)
def _plain_word(word: str, script: str) -> str:
    """A word in lower case, look-alikes folded. script: what a word of look-alikes alone is taken for.

    A word of another script than Latin is first spelled in that script's own letters, so that its capitals are lowered as such;
    a Latin one is folded first, since its capitals of other scripts are disguised ones.
    """
    own = next((name for name in _BLOCKS if _OWN[name].search(word)), "" if _OWN_LATIN.search(word) else script)
    word = word.translate(_FOLD)
    if own:
        word = word.translate(_BACK[own])
    return unicodedata.normalize("NFC", word.lower().translate(_FOLD))


def plain_words(text: str) -> list[str]:
    """The white-space separated words of the plain form, lower-cased: for operators that compare words."""
    if text.isascii():
        return text.lower().split()
    text = _UNSEEN.sub("", _SPACES.sub(" ", text))
    script = ""
    if _ANY_OTHER.search(text):  # the script of the letters that can't be disguised ones
        votes = {name: len(_OWN[name].findall(text)) for name in _BLOCKS}
        script = max(votes, key=lambda k: votes[k])
        if votes[script] <= len(_OWN_LATIN.findall(text)):
            script = ""
    return [_plain_word(w, script) for w in text.split()]


def classes(df: DataFrame, text: str, trimmed: bool = False) -> DataFrame:
    """(text, look, canonical, n_texts) for each distinct text: one row per text, with its class. trimmed: spaces at the ends of a look don't show.

    The group by runs on distinct texts only, so a text or a class that holds a third of all rows is
    reduced map-side before anything is shuffled by look.
    """
    spark = df.sparkSession
    texts = df.select(F.col(text).alias("text")).where("text is not null").groupBy("text").count().select("text", (F.trim(look(F.col("text"))) if trimmed else look(F.col("text"))).alias("look"))
    return spark.sql(
        """
        WITH class AS (
            SELECT look COLLATE UNICODE AS look,
                   min_by(text, struct(text <> look, text)) AS canonical,
                   count(*) AS n_texts
            FROM {texts} GROUP BY look COLLATE UNICODE)
        SELECT t.text, t.look, c.canonical, c.n_texts
        FROM {texts} t JOIN class c ON t.look COLLATE UNICODE = c.look
        """,
        texts=texts,
    )


def unify(df: DataFrame, text: str, into: str = "plain") -> DataFrame:
    """`df` with the canonical text of each row's class as a further column `into`."""
    found = classes(df, text).select(F.col("text").alias("__text"), F.col("canonical").alias(into))
    return df.drop(into).join(found, F.col(text) == F.col("__text"), "left").drop("__text")


def same_look_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key_a, key_b), key_a < key_b: keys whose texts look the same but differ in characters.

    All pairs of different texts of a class are linked. Copies of one text are not multiplied out:
    of a linked pair of texts each key meets the first and the last key of the other text.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null and text is not null").distinct()
    several = classes(rows, "text").where("n_texts > 1").select("text", "canonical")
    keys = rows.join(several, "text").select("key", "text", "canonical")
    ends = keys.groupBy("canonical", "text").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    met = ends.select("canonical", F.col("text").alias("other"), F.explode(F.array_distinct(F.array("first", "last"))).alias("end"))
    pairs = keys.join(met, "canonical").where("text <> other and key <> end")
    return pairs.select(F.least("key", "end").alias("key_a"), F.greatest("key", "end").alias("key_b")).distinct()


def same_look_lookup(df: DataFrame, key: str, text: str, names: DataFrame, name_key: str, name: str) -> DataFrame:
    """(key_a, key_b): rows whose text looks like a name of `names` without being the same characters.

    Space at the ends doesn't show. A text that is a name itself has no case with that name.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null and text is not null").distinct().withColumn("seen", F.trim("text"))
    known = names.select(F.col(name_key).alias("name_key"), F.col(name).alias("name")).where("name_key is not null and name is not null").distinct().withColumn("seen", F.trim("name"))
    found = classes(rows.select("seen").unionByName(known.select("seen")), "seen", trimmed=True).select(F.col("text").alias("seen"), "canonical")
    a = rows.join(found, "seen").select(F.col("key").alias("key_a"), "text", "canonical")
    b = known.join(found, "seen").select(F.col("name_key").alias("key_b"), "name", "canonical")
    return a.join(b, "canonical").where("text <> name").select("key_a", "key_b").distinct()
