"""Problem 6: sentence boundaries across languages and scripts.

Per language, unsupervised and over all distinct texts, three things are learned from counts by
log-likelihood ratios: abbreviations (tokens that come with a period far more often than chance, scaled
by length as long words are hardly ever abbreviations), sentence starters (tokens that follow a
sure boundary far more often than chance), and for each abbreviation whether what follows it with a
capital is mostly a sentence starter (`etc.`, `p.m.`: the sentence may end there) or not (`Dr.`, `Fig.`).
The fourth thing are collocations: a number with a period and the word after it that come together far more
often than a number and a sentence's first word would (`3. Oktober`, `19. Jahrhundert`), by the log-likelihood
ratio of the two-by-two table of what stands before and after a period.
Each period is then classified by these lists, its neighbours' letters, and the quotation or bracket
that it lies in.

Defined results
- null, empty and blank text: no row. A text without any boundary: one sentence.
- positions count code points of the text as stored; ends are exclusive; white space around is left out.
- repeated rows of a key and text count once; a key with several texts reports each text's sentences.
- columns besides the named ones are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.lookalike import _FOLD, _SPACES, _UNSEEN
from quillmesh.llm.wordsets import keyed
from quillmesh.tables import written

# Frequent words that tell languages of Latin script apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that this one each with by from on at as but when where".split(),
    "fr": "le la les des une est dans qui que avec pour sur après très être où et du".split(),
    "de": "der die das und nicht wird mit für unter ist ein eine auch wurde zwischen von".split(),
    "es": "el los las una con para según donde muy más está fue como pero del y".split(),
}
# First and last blocks of 128 code points of each script.
SCRIPTS = {"th": (0x1C, 0x1C), "ja": (0x60, 0x61), "zh": (0x9C, 0x13F), "hi": (0x12, 0x12), "ar": (0x0C, 0x0D), "el": (0x06, 0x07), "ru": (0x08, 0x09)}
_VOTES = {w: tuple(x for x in FUNCTION_WORDS if w in FUNCTION_WORDS[x]) for ws in FUNCTION_WORDS.values() for w in ws}
_LATIN = re.compile("[A-Za-zÀ-ɏ]")

_X = "[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]*"  # unseen characters between seen ones
_CLOSE_CJK = "\"'”’»›\\)\\]）」』】"
_CLOSE = _CLOSE_CJK + "“"
# Stretches that hold their stops: quotations and brackets, each within one paragraph.
_HELD = re.compile("„[^„“”]*[“”]|“[^“”]*”|«[^«»]*»|「[^「」]*」|『[^『』]*』|（[^（）]*）|(?<![^\\s(\\[（])\"(?=\\S)[^\"]*(?<=\\S)\"|\\([^()]*\\)|\\[[^\\[\\]]*\\]")
_STOP = re.compile(f"(?P<cjk>[。！？｡]+{_X}[{_CLOSE_CJK}]*)|(?P<stop>[.!?．؟।॥۔;\u037e…]+(?:{_X}[.!?．؟…]+)*{_X}[{_CLOSE}]*)(?={_X}(?:\\s|$))")
_PARAGRAPH = re.compile(r"[^\S\r\n]*(?:\r\n|\r|\n)(?:[^\S\r\n]*(?:\r\n|\r|\n))+\s*")
_THAI_BREAK = re.compile(f"(?<=[\u0e01-\u0e5b\u200b-\u200f\u2060-\u2064\ufeff\u00ad\u034f])\\s+(?={_X}[\u0e01-\u0e5b])")
_TOKEN = re.compile(r"\S+")
_EDGE = "\"'“”„«»‘’‹›()[]（）「」『』【】¿¡,;:"
_LETTER = re.compile(r"[^\W\d_]")


def _votes(words: list[str]) -> Counter:
    out: Counter = Counter()
    for which, n in Counter(map(_VOTES.get, words)).items():
        for x in which or ():
            out[x] += n
    return out


def language(text: str) -> str:
    """A language code by script, and among those of Latin script by function words."""
    if not text.isascii():
        blocks = np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) >> 7, minlength=0x140)
        counts = {name: int(blocks[a : b + 1].sum()) for name, (a, b) in SCRIPTS.items()}
        latin = len(_LATIN.findall(text))
        if counts["ja"] and counts["zh"] + counts["ja"] > latin and 8 * counts["ja"] >= counts["zh"]:
            return "ja"
        best = max(counts, key=lambda k: counts[k])
        if counts[best] > latin:
            return best
    words = text.lower().split()
    votes = _votes(words)
    if sum(votes.values()) < 3:  # a short text: look behind the punctuation too
        votes = _votes([w.strip(_EDGE + ".!?") for w in words])
    return max(FUNCTION_WORDS, key=lambda x: votes[x]) if votes else "en"


def plain(token: str) -> str:
    """A token for look-ups: unseen characters dropped, look-alike letters folded."""
    return token if token.isascii() else _UNSEEN.sub("", _SPACES.sub(" ", token)).translate(_FOLD)


def _tally(tokens: Counter, follows: Counter, lang: str, into: Counter) -> None:
    """Adds (lang, kind, token, next) counts: d a token with a period, w any token without, s what follows a period, c any token."""
    for raw, n in tokens.items():
        t = plain(raw).strip(_EDGE)
        if not t:
            continue
        word = _dotted(t)
        if word:
            into[lang, "d", word, ""] += n
        elif t[-1] != "." and _LETTER.search(t):
            into[lang, "w", t.lower().rstrip("!?…"), ""] += n
        into[lang, "c", t.rstrip(".!?…"), ""] += n
    for (raw, after), n in follows.items():
        token, after = plain(raw).strip(_EDGE), plain(after).strip(_EDGE)
        word = _dotted(token) or _number(token)
        if word and after and not after[:1].islower():
            into[lang, "s", word, after.rstrip(".!?…")] += n


def _dotted(token: str) -> str:
    """The word of a token that ends in one period, if it may be an abbreviation."""
    if len(token) < 2 or token[-1] != "." or token[-2] == ".":
        return ""
    word = token[:-1].lower()
    return word if _LETTER.search(word) and not any(c.isdigit() for c in word) else ""


def _number(token: str) -> str:
    """The kind of a number that ends in a period: of one or two digits, or of more."""
    return ("#" if len(token) < 4 else "###") if token[-1:] == "." and token[:-1].isdigit() else ""


def learn(texts: DataFrame, cut: float = 0.3, starter_cut: float = 10.0, least: int = 4, collocation_cut: float = 7.88) -> DataFrame:
    """(lang, abbreviation, next) of those after which a sentence does not end, from the counts over all rows (tid, text).

    next: null; 0 for a token that is often a word too, which ends no sentence before a number (`с. 12`); or the word before
    which the kind of number in `abbreviation` ends none.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            into: Counter = Counter()
            tokens, follows = defaultdict(Counter), defaultdict(Counter)
            for text in batch["text"]:
                lang, here = language(text), text.split()
                tokens[lang].update(here)
                follows[lang].update([x for x in zip(here, here[1:]) if "." in x[0][-3:]])
            for lang in tokens:
                _tally(tokens[lang], follows[lang], lang, into)
            yield pd.DataFrame([(*k, n) for k, n in into.items()], columns=["lang", "kind", "token", "next", "n"])

    spark = texts.sparkSession
    every = written(texts.select("text").mapInPandas(counted, "lang string, kind string, token string, next string, n bigint").groupBy("lang", "kind", "token", "next").agg(F.sum("n").alias("n")), "counts")
    return spark.sql(
        """
        WITH total AS (SELECT lang, sum(if(kind = 'd', n, 0)) AS dots, sum(if(kind = 's', n, 0)) AS starts, sum(if(kind = 'c', n, 0)) AS tokens FROM {every} GROUP BY lang),
        dotted AS (SELECT lang, token, sum(if(kind = 'd', n, 0)) AS a, sum(if(kind = 'w', n, 0)) AS b FROM {every} WHERE kind IN ('d', 'w') GROUP BY lang, token),
        scored AS (
            SELECT d.lang, token, a, b, a / (a + b) AS q, least(0.99, dots / tokens) AS p,
                   length(replace(token, '.', '')) AS len, length(token) - length(replace(token, '.', '')) AS inner
            FROM dotted d JOIN total t ON d.lang = t.lang WHERE a > 0),
        abbreviation AS (
            SELECT lang, token, q FROM scored
            WHERE q > p AND 2 * (a * ln(q / p) + if(b > 0, b * ln((1 - q) / (1 - p)), 0)) * exp(-len) * (inner + 1) * pow(greatest(len, 1), -b) >= {cut} AND a >= {least}),
        begun AS (
            SELECT s.lang, s.next AS token, sum(s.n) AS a FROM {every} s LEFT ANTI JOIN abbreviation x ON s.lang = x.lang AND s.token = x.token
            WHERE s.kind = 's' GROUP BY s.lang, s.next),
        starter AS (
            SELECT g.lang, g.token FROM begun g JOIN {every} c ON c.kind = 'c' AND c.lang = g.lang AND c.token = g.token JOIN total t ON t.lang = g.lang
            WHERE g.a >= 0.3 * c.n AND 2 * g.a * ln((g.a / c.n) / least(0.99, t.starts / t.tokens)) >= {starter_cut}),
        after AS (
            SELECT s.lang, s.token, sum(s.n) AS n, sum(if(r.token IS NOT NULL, s.n, 0)) AS started
            FROM {every} s LEFT JOIN starter r ON r.lang = s.lang AND r.token = s.next WHERE s.kind = 's' GROUP BY s.lang, s.token),
        pair AS (SELECT lang, token, next, sum(n) AS a FROM {every} WHERE kind = 's' GROUP BY lang, token, next),
        first AS (SELECT lang, token, sum(a) AS r FROM pair GROUP BY lang, token),
        second AS (SELECT lang, next, sum(a) AS c FROM pair GROUP BY lang, next),
        square AS (
            SELECT p.lang, p.token, p.next, double(a) AS a, double(r - a) AS b, double(c - a) AS d, double(t.starts - r - c + a) AS e, double(r) AS r, double(c) AS c, double(t.starts) AS n
            FROM pair p JOIN first f ON f.lang = p.lang AND f.token = p.token JOIN second s ON s.lang = p.lang AND s.next = p.next JOIN total t ON t.lang = p.lang WHERE p.token LIKE '#%'),
        collocation AS (
            SELECT lang, token, next FROM square WHERE a * n > r * c AND a > 0.5 * c
            AND 2 * (a * ln(a * n / (r * c)) + if(b > 0, b * ln(b * n / (r * (n - c))), 0) + if(d > 0, d * ln(d * n / ((n - r) * c)), 0) + if(e > 0, e * ln(e * n / ((n - r) * (n - c))), 0)) >= {collocation_cut})
        SELECT x.lang, x.token AS abbreviation, if(q < 0.9, '0', null) AS next FROM abbreviation x LEFT JOIN after f ON f.lang = x.lang AND f.token = x.token
        WHERE coalesce(f.started, 0) < 0.5 * coalesce(f.n, 1)
        UNION ALL SELECT lang, token, next FROM collocation
        """,
        every=every,
        cut=cut,
        starter_cut=starter_cut,
        least=least,
        collocation_cut=collocation_cut,
    )


def _starts_low(text: str, at: int) -> bool:
    """Whether the next token goes on in lower case; one of mixed case (pH) may begin a sentence."""
    n = len(text)
    while at < n and text[at].isspace():
        at += 1
    if at == n or text[at].isupper():
        return False
    token = ""
    while not token and (m := _TOKEN.search(text, at)):  # a dash alone: what it leads to
        token, at = plain(m[0]).lstrip(_EDGE + "-–—"), m.end()
    first = next((c for c in token if c.isalnum()), "")
    return first.islower() and not any(c.isupper() for c in token[1:])


def _after(text: str, at: int) -> str:
    """The next word, as learn() counts it."""
    m = _TOKEN.search(text, at)
    return plain(m[0]).strip(_EDGE).rstrip(".!?…") if m else ""


def _ends(text: str, lang: str, known: set[str]) -> list[int]:
    """Ends of sentences within one paragraph, besides the paragraph's own end."""
    held = [m.span() for m in _HELD.finditer(text)]
    ends: list[int] = []
    begin, h = 0, 0
    for m in _STOP.finditer(text):
        at, end = m.span()
        while h < len(held) and held[h][1] <= at:
            h += 1
        inside = held[h] if h < len(held) and held[h][0] <= at else None
        if inside and end < inside[1]:
            continue
        stop = m["cjk"] or m["stop"]
        cased = lang not in ("th", "ja", "zh", "hi", "ar")
        if m["stop"] and ";" in stop.replace("\u037e", ";"):
            if lang != "el":
                continue
        after = end
        if inside:  # the stretch closes with this stop: it ends the sentence that introduced it
            if text[inside[0]] in "(（[":
                if text[begin : inside[0]].strip():
                    continue
            elif not cased and not text[begin : inside[0]].strip():
                continue  # a quotation at the beginning, its speaker follows
            if lang == "ja" and text[after : after + 1] == "と":
                continue
        if m["stop"]:
            if _starts_low(text, after):
                continue
            bare = stop.rstrip(_CLOSE)
            if bare[:1] in ".．" and len(_UNSEEN.sub("", bare)) == 1 and not inside:
                k = at
                while k > begin and not text[k - 1].isspace():
                    k -= 1
                word = plain(text[k:at]).strip(_EDGE)
                low = word.lower()
                if len(word) == 1 and word.isalpha() and (word.isupper() or low in known):
                    continue
                if word.isdigit() and f"{_number(word + '.')}\0{_after(text, after)}" in known:
                    continue
                if f"{low}\x000" in known and _after(text, after)[:1].isdigit():
                    continue
                if low in known or re.split("[’'-]", low)[-1] in known:
                    continue
        ends.append(end)
        begin = end
    return ends


def split(text: str, known: dict[str, set[str]], lang: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of each sentence of a text."""
    lang = lang or language(text)
    mine = known.get(lang, set())
    cuts: list[int] = []
    start = 0
    for a, b in [*((m.start(), m.end()) for m in _PARAGRAPH.finditer(text)), (len(text), len(text))]:
        part = text[start:a]
        cuts += [start + e for e in _ends(part, lang, mine)]
        if "\u0e01" <= max(part, default="") and lang == "th":
            cuts += [start + m.start() for m in _THAI_BREAK.finditer(part)]
        cuts.append(b)
        start = b
    out, begin = [], 0
    for cut in sorted(set(cuts)):
        piece = text[begin:cut]
        lead = len(piece) - len(piece.lstrip())
        size = len(piece.strip())
        if size:
            out.append((begin + lead, begin + lead + size))
        begin = cut
    return out


def sentences(df: DataFrame, key: str, text: str, least: Column | int = 1, most_known: int = 1_000_000) -> DataFrame:
    """(rec_key, start_pos, end_pos): the sentences of each text that holds at least `least` of them.

    least: a number, or a column of `df`. What is learned is broadcast: at most `most_known` tokens and
    collocations, or the call fails.
    """
    rows = keyed(df, key, text, (least if isinstance(least, Column) else F.lit(least)).alias("least"))
    texts = written(rows.groupBy("tid").agg(F.first("text").alias("text")), "texts")
    found = learn(texts).limit(most_known + 1).collect()
    if len(found) > most_known:
        raise ValueError(f"more than {most_known} abbreviations")
    known: dict[str, set[str]] = {}
    for r in found:
        known.setdefault(r["lang"], set()).add(r["abbreviation"] if r["next"] is None else f"{r['abbreviation']}\0{r['next']}")
    # Words beside numbers hold in every language: a short text's may not be told.
    beside = {x for words in known.values() for x in words if x.startswith("#")}
    known = {lang: known.get(lang, set()) | beside for lang in {*known, *SCRIPTS, *FUNCTION_WORDS}}
    shared = df.sparkSession.sparkContext.broadcast(known)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(tid, spans) for tid, text in zip(batch["tid"], batch["text"]) if (spans := split(text, shared.value))]
            yield pd.DataFrame({"tid": [t for t, _ in out], "spans": [[{"start_pos": a, "end_pos": b} for a, b in s] for _, s in out]})

    spans = texts.mapInPandas(cut, "tid binary, spans array<struct<start_pos:int,end_pos:int>>")
    placed = rows.select(F.col("key").alias("rec_key"), "tid", "least").distinct().join(spans, "tid").where(F.size("spans") >= F.col("least"))
    return placed.select("rec_key", F.inline("spans")).distinct()
