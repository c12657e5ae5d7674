"""Fingerprints, shingles and set similarities as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions.text import SPACES, let


def none(kind: str = "array<bigint>") -> Column:
    return F.array().cast(kind)


def poly_hash(text: Column) -> Column:
    """32-bit FNV-1a over the characters."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(2166136261).cast("bigint"), lambda h, c: (h.bitwiseXOR(F.ascii(c)) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))


def kgrams(tokens: Column, k: int) -> Column:
    """Hashes of each run of k tokens, joined by NUL."""

    def of(t: Column) -> Column:
        n = F.size(t)
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: poly_hash(F.array_join(F.slice(t, i, k), "\u0000")))).otherwise(none())

    return let(tokens, of)


def winnowed(hashes: Column, w: int = 4) -> Column:
    """The distinct least hashes of all windows of w; all hashes if there are fewer."""

    def of(h: Column) -> Column:
        n = F.size(h)
        return F.array_distinct(F.when(n >= w, F.transform(F.sequence(F.lit(1), n - w + 1), lambda i: F.array_min(F.slice(h, i, w)))).otherwise(h))

    return let(hashes, of)


def fingerprint(tokens: Column, k: int = 5, w: int = 4) -> Column:
    return winnowed(kgrams(tokens, k), w)


def shingle_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9_\x09-\x0D \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]", ""), SPACES, " "))


def char_shingles(normal: Column, k: int) -> Column:
    """Distinct runs of k characters of a normalised text, as strings."""

    def of(t: Column) -> Column:
        n = F.length(t)
        return F.when(n >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substr(t, i, F.lit(k))))).otherwise(none("array<string>"))

    return let(normal, of)


def containment(a: Column, b: Column) -> Column:
    """Share of a's elements that are in b; 0 if a is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(a)), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements among all; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def blended(c4: Column, c6: Column, c9: Column) -> Column:
    """The blend of shingle containments at three lengths."""
    return 0.25 * c4 + 0.45 * c6 + 0.30 * c9


def dot(a: Column, b: Column) -> Column:
    """Inner product of dense vectors; 0 if lengths differ or are 0."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total).otherwise(0.0)
