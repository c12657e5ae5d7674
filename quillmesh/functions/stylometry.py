"""Signals of machine-made writing as Column expressions over one text and its tokens."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions.text import clamp, let, rounded

EPSILON = 1e-6
# Probabilities of frequent words and pairs of words.
WORD_PROBABILITY = {
    "the": 0.053, "of": 0.029, "and": 0.025, "to": 0.024, "in": 0.020, "a": 0.019, "is": 0.011, "that": 0.010,
    "for": 0.009, "with": 0.008, "as": 0.007, "on": 0.007, "by": 0.006, "this": 0.006, "are": 0.006, "be": 0.006,
    "from": 0.005, "it": 0.005, "an": 0.004, "at": 0.004, "or": 0.004, "which": 0.003, "can": 0.003, "has": 0.003,
    "was": 0.003, "will": 0.003, "also": 0.0025, "not": 0.0025, "have": 0.0024, "their": 0.0023, "more": 0.0022,
}
PAIR_PROBABILITY = {
    "of the": 0.030, "in the": 0.025, "to the": 0.020, "for the": 0.016, "on the": 0.015, "and the": 0.014, "is a": 0.012, "is the": 0.012, "as a": 0.011, "with the": 0.011,
    "it is": 0.010, "there is": 0.009, "in this": 0.009, "this is": 0.009, "can be": 0.009, "we can": 0.008, "we use": 0.008, "this paper": 0.008, "this study": 0.007, "this project": 0.007,
}
# Phrases counted by the two phrase densities.
CONNECTORS = ("furthermore", "moreover", "additionally", "therefore", "consequently", "in conclusion", "in summary", "as a result", "in other words")
TEMPLATES = ("the main objective", "the overall workflow", "this methodology", "it is important to note", "it should be noted", "the proposed system", "plays a crucial role", "this project aims")
# Knots of the calibration at 0, 0.2, 0.4, 0.6, 0.8 and 1.
CALIBRATION = {"default": (0.0, 0.08, 0.22, 0.46, 0.73, 1.0), "extreme": (0.0, 0.12, 0.35, 0.65, 0.88, 1.0)}
STRICTNESS = {"relaxed": 0.88, "balanced": 1.0, "strict": 1.15, "extreme": 1.3}
# What is said of each signal, in the order in which equal signals are told.
REASONS = {
    "perplexity": "Low perplexity indicates highly predictable token choices.",
    "burstiness": "Low sentence-level perplexity variance suggests uniform generation rhythm.",
    "trigram_repeat": "Repeated trigram patterns indicate autoregressive reuse.",
    "lexical_uniformity": "Lexical distribution appears overly uniform.",
    "entropy": "Character entropy is lower than expected for natural human variability.",
    "template_density": "Template-style instructional phrasing appears frequently.",
    "connector_density": "Connector-heavy transitions suggest formulaic generated style.",
    "structure_uniformity": "Sentence opening patterns are unusually repetitive.",
}
NO_REASON = "No dominant AI signal exceeded explanation threshold."


def _table(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def surprisal(tokens: Column) -> Column:
    """Mean of -ln p over the tokens, p from the tables of words and pairs; null without tokens."""
    words, pairs = _table(WORD_PROBABILITY), _table(PAIR_PROBABILITY)

    def of(t: Column) -> Column:
        def nats(token: Column, i: Column) -> Column:
            pair = F.when(i > 0, F.coalesce(F.element_at(pairs, F.concat(F.get(t, i - 1), F.lit(" "), token)), F.lit(0.0))).otherwise(0.0)
            return -F.log(F.greatest(F.lit(EPSILON), 0.7 * F.coalesce(F.element_at(words, token), F.lit(EPSILON)) + 0.3 * pair))

        return F.when(F.size(t) > 0, F.aggregate(F.transform(t, nats), F.lit(0.0), lambda s, x: s + x) / F.size(t))

    return let(tokens, of)


def perplexity(tokens: Column) -> Column:
    return F.coalesce(F.exp(surprisal(tokens)), F.lit(999.0))


def perplexity_signal(mean: Column) -> Column:
    return clamp((80 - mean) / 60)


def burstiness_signal(variance: Column, n: Column) -> Column:
    return F.when(n < 2, 0.5).otherwise(clamp((1200 - variance) / 1200))


def repeated_trigrams(tokens: Column) -> Column:
    """Share of distinct trigrams that occur again; for one sentence (quadratic in its length)."""

    def runs(t: Column) -> Column:
        return F.when(F.size(t) >= 6, F.transform(F.sequence(F.lit(1), F.size(t) - 2), lambda i: F.array_join(F.slice(t, i, 3), "\u0000"))).otherwise(F.array().cast("array<string>"))

    def share(r: Column) -> Column:
        again = F.filter(F.array_distinct(r), lambda k: F.size(F.filter(r, lambda x: x == k)) > 1)
        return F.coalesce(F.try_divide(F.size(again), F.size(F.array_distinct(r))), F.lit(0.0))

    return let(let(tokens, runs), share)


def diversity(tokens: Column) -> Column:
    return F.when(F.size(tokens) > 0, F.size(F.array_distinct(tokens)) / F.size(tokens)).otherwise(1.0)


def letter_entropy(text: Column) -> Column:
    """Bits per letter over a to z; null under 20 letters."""

    def of(letters: Column) -> Column:
        n = F.length(letters)
        counts = F.array(*[n - F.length(F.replace(letters, F.lit(chr(c)), F.lit(""))) for c in range(97, 123)])
        return F.when(n >= 20, F.aggregate(counts, F.lit(0.0), lambda s, c: s - F.when(c > 0, c / n * F.log2(c / n)).otherwise(0.0)))

    return let(F.regexp_replace(F.lower(text), "[^a-z]", ""), of)


def entropy_signal(text: Column) -> Column:
    return let(letter_entropy(text), lambda h: F.when(h.isNull(), 0.5).otherwise(clamp((4.5 - h) / 2.5)))


def phrase_density(text: Column, phrases: tuple[str, ...]) -> Column:
    lower = F.lower(text)
    return sum((F.when(lower.contains(p), 1).otherwise(0) for p in phrases), F.lit(0)) / len(phrases)


def punctuation_density(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[,:;!?()\-]")) / F.greatest(F.lit(1), F.length(text))


def opening(sentence: Column) -> Column:
    """The first two words, lower-cased."""
    return F.array_join(F.slice(F.split(F.lower(F.trim(sentence)), r"\s+"), 1, 2), " ")


def calibrated(raw: Column, strictness: str = "balanced") -> Column:
    """Piecewise linear between the knots."""
    y = CALIBRATION["extreme" if strictness == "extreme" else "default"]
    x = clamp(raw)
    out = None
    for k in range(5):
        part = y[k] + (x - k / 5) / 0.2 * (y[k + 1] - y[k])
        out = F.when(x <= (k + 1) / 5, part) if out is None else out.when(x <= (k + 1) / 5, part)
    return out.otherwise(1.0)


def sentence_score(text: Column, tokens: Column, strictness: str = "balanced") -> Column:
    """struct<p, lo, hi>: how likely a sentence is machine-made."""
    raw = (
        0.28 * perplexity_signal(perplexity(tokens)) + 0.14 * repeated_trigrams(tokens) + 0.12 * (1 - diversity(tokens)) + 0.11 * entropy_signal(text)
        + 0.10 * phrase_density(text, CONNECTORS) + 0.10 * phrase_density(text, TEMPLATES) + 0.15 * clamp(1 - punctuation_density(text) / 0.05)
    )
    spread = clamp(0.20 - 0.003 * F.size(tokens), 0.06, 0.20)
    p = let(raw * STRICTNESS.get(strictness, 1.3), lambda x: calibrated(x, strictness))
    full = let(p, lambda p: F.struct(rounded(p, 4).alias("p"), rounded(clamp(p - spread), 4).alias("lo"), rounded(clamp(p + spread), 4).alias("hi")))
    return F.when(F.size(tokens) < 4, F.struct(F.lit(0.4).alias("p"), F.lit(0.2).alias("lo"), F.lit(0.6).alias("hi"))).otherwise(full)


def document_raw(signals: dict[str, Column]) -> Column:
    structure = 0.35 * signals["connector_density"] + 0.35 * signals["template_density"] + 0.30 * signals["structure_uniformity"]
    return 0.25 * signals["perplexity"] + 0.15 * signals["burstiness"] + 0.10 * signals["trigram_repeat"] + 0.10 * signals["lexical_uniformity"] + 0.10 * signals["entropy"] + 0.30 * structure


def reasons(signals: dict[str, Column]) -> Column:
    """Texts of the four strongest signals of at least 0.55, strongest first, ties in the order of REASONS."""
    ranked = F.array_sort(F.array(*[F.struct((-signals[k]).alias("v"), F.lit(n).alias("n"), F.lit(text).alias("text")) for n, (k, text) in enumerate(REASONS.items())]))
    told = F.transform(F.filter(F.slice(ranked, 1, 4), lambda s: s["v"] <= -0.55), lambda s: s["text"])
    return F.when(F.size(told) > 0, told).otherwise(F.array(F.lit(NO_REASON)))


def fused(own: Column, external: Column) -> Column:
    """A weighted mean with an outside score where there is one."""
    return F.when(external.isNull(), own).otherwise(rounded(clamp(0.35 * own + 0.65 * external), 4))


def band(p: Column) -> Column:
    return F.when(p < 0.40, "LIKELY_HUMAN").when(p < 0.70, "UNCERTAIN").otherwise("LIKELY_AI")


LN2_PLUS_1 = math.log(2) + 1
