"""Problem 9: reading level of each document.

Per language, interpolated character n-gram models are trained on all documents from exact counts. An n-gram
whose share of all characters is below `floor` is left to the shorter ones, so what is broadcast holds at most
1 / floor n-grams of each length, whatever the data's size. Every document is then scored whole: the
surprisal of each of its characters, summed for each stretch between stops and line ends, gives a
distribution, of which quantiles are taken, weighted by length so that menus and titles weigh little.

The graded documents (at most `most_labels`, chosen by hash; the only thing that is bounded) fit three things: how
much a longer n-gram counts against a shorter one, by the least error on labels held out; the weights, none
negative, that make one score of the quantiles; and the isotonic regression that maps scores to grades.

Defined results
- null, empty or letterless text: score 0, so the lowest fitted level. Two grades of one document: their mean.
- levels are rounded half up and kept within the grades seen. No graded document at all: level 3.
- a document that is null in the labels, or missing among the documents: no row, score 0 respectively.
- repeated rows of a document count once (the greatest score); columns besides the named ones are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.sentences import language
from quillmesh.llm.wordsets import mix
from quillmesh.tables import written

ORDERS = 3
_P = [np.uint64(p) for p in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_GAP = re.compile(r"[^\w.!?。！？।؟;\n]+|_+")
_STOPS = re.compile(r"(?:[.!?。！？।؟\n]\s*)+")
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
#: Shares of a longer n-gram against the shorter ones that are tried.
KEEPS = (0.5, 0.65, 0.8, 0.9)


def prepared(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased characters with single gaps between words, and where each stretch begins."""
    parts = [p for p in (" ".join(_GAP.sub(" ", x).split()) for x in _STOPS.split(text.lower())) if p]
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    codes = np.frombuffer((" ".join(parts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return codes, np.r_[0, np.cumsum([len(p) + 1 for p in parts])[:-1]]


def grams(codes: np.ndarray, lang: str) -> list[np.ndarray]:
    """A hash of no character and of the 1 to ORDERS that end at each place, each with the language; gaps stand before the text."""
    total = np.full(len(codes), xxhash.xxh3_64_intdigest(lang.encode()), np.uint64)
    out = [mix(total)]
    for n in range(ORDERS):
        back = codes if n == 0 else np.r_[np.full(min(n, len(codes)), 32, np.uint64), codes[:-n]]
        total = total + back * _P[n]
        out.append(mix(total + np.uint64(n + 1)))
    return out


def surprisal(seen: list[np.ndarray], keep: float) -> np.ndarray:
    """Bits of each character under the interpolated model; seen: the counts of grams()."""
    p = (seen[1] + 0.5) / (seen[0] + 1)
    for n in range(2, ORDERS + 1):
        before = np.r_[seen[0][:1], seen[n - 1][:-1]]
        p = np.where(before > 0, (1 - keep) * p + keep * np.minimum(1.0, seen[n] / np.maximum(before, 1)), p)
    return -np.log2(np.maximum(p, 1e-12))


def weighted_quantiles(values: np.ndarray, weights: np.ndarray, at: tuple[float, ...]) -> np.ndarray:
    order = np.argsort(values, kind="stable")
    reach = np.cumsum(weights[order])
    return values[order][np.searchsorted(reach, np.array(at) * reach[-1])]


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(n, first)


def train(texts: DataFrame, floor: float = 2e-7) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, counts) of the n-grams over all rows (text) whose share of the characters is at least `floor`."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        new: list[np.ndarray] = []
        size = 0

        def settle() -> None:
            u, n = np.unique(np.concatenate(new), return_counts=True)
            keys[0], counts[0] = _summed(np.r_[keys[0], u], np.r_[counts[0], n])
            new.clear()

        for batch in batches:
            for text in batch["text"]:
                codes, _ = prepared(text)
                if len(codes):
                    new += grams(codes, language(text))
                    size += len(codes)
                    if size > 500_000:
                        settle()
                        size = 0
        if new:
            settle()
        yield pd.DataFrame({"gram": keys[0].view(np.int64), "n": counts[0]})

    every = written(texts.where("text is not null").select("text").mapInPandas(counted, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    # The gram of no character counts all characters of its language.
    total = every.agg(F.sum("n").alias("n")).first()["n"] or 0
    got = every.where(F.col("n") >= floor * total / (ORDERS + 1)).toPandas()  # at most (ORDERS + 1) / floor rows
    keys, n = got["gram"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.float64)
    order = np.argsort(keys)
    return keys[order], n[order]


def scores(docs: DataFrame, key: str, text: str, model: tuple[np.ndarray, np.ndarray], keeps: tuple[float, ...] = (0.8,)) -> DataFrame:
    """(key, q): the quantiles of each document's surprisal for each share in `keeps`, one after another; of repeated rows the greatest."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, counts = shared.value
        for batch in batches:
            out = []
            for text in batch["text"]:
                codes, begins = prepared(text or "")
                if not len(codes) or not len(known):
                    out.append(np.zeros(len(QUANTILES) * len(keeps)))
                    continue
                seen = []
                for g in grams(codes, language(text)):
                    at = np.minimum(np.searchsorted(known, g), len(known) - 1)
                    seen.append(np.where(known[at] == g, counts[at], 0.0))
                size = np.diff(np.r_[begins, len(codes)])
                out.append(np.concatenate([weighted_quantiles(np.add.reduceat(surprisal(seen, keep), begins), size, QUANTILES) for keep in keeps]))
            yield pd.DataFrame({"key": batch["key"], "q": out})

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null")
    return rows.mapInPandas(scored, f"key {kind}, q array<double>").groupBy("key").agg(F.max("q").alias("q"))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing function nearest to (x, y) in squares: neighbours that fall are pooled."""
    pools: list[list[float]] = []
    for a, b in sorted(zip(x.tolist(), y.tolist())):
        pools.append([b, 1, a, a])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m, n, _, last = pools.pop()
            p = pools[-1]
            p[0], p[1], p[3] = (p[0] * p[1] + m * n) / (p[1] + n), p[1] + n, last
    return np.array([v for p in pools for v in p[2:]]), np.array([p[0] for p in pools for _ in (0, 1)])


def blend(x: np.ndarray, y: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Weights, none negative, of the columns of x whose sum is nearest to y in squares, up to a constant."""
    a, b = x - x.mean(0), y - y.mean()
    g, h = a.T @ a, a.T @ b
    top = np.linalg.eigvalsh(g)[-1]
    w = np.full(x.shape[1], 1 / x.shape[1])
    for _ in range(rounds if top > 0 else 0):
        w = np.maximum(0, w - (g @ w - h) / top)
    return w if w.sum() > 0 else np.full(x.shape[1], 1 / x.shape[1])


class Scale:
    """From quantiles to a grade: one score, then a non-decreasing map."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.weights = blend(x, y)
        self.knots = isotonic(x @ self.weights, y)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x @ self.weights, *self.knots)


def fitted(x: np.ndarray, y: np.ndarray, keeps: int, folds: int = 3) -> tuple[int, Scale]:
    """Which of the `keeps` blocks of columns errs least on labels held out, and its scale fitted on all."""
    width = x.shape[1] // keeps
    blocks = [x[:, k * width : (k + 1) * width] for k in range(keeps)]
    fold = np.arange(len(y)) % folds

    def error(b: np.ndarray) -> float:
        return sum(float(np.abs(Scale(b[fold != f], y[fold != f])(b[fold == f]) - y[fold == f]).sum()) for f in range(folds))

    best = min(range(keeps), key=lambda k: error(blocks[k])) if len(y) >= 10 * folds else keeps // 2
    return best, Scale(blocks[best], y)


def estimate(docs: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, level: str, everything: bool = False, most_labels: int = 100_000) -> DataFrame:
    """(key, level, score): the level of each document whose grade is null, or of all documents; the score is the level before it is rounded."""
    spark = docs.sparkSession
    one = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null")
    model = train(one)
    graded = labels.select(F.col(label_key).alias("key"), F.col(level).alias("level")).where("key is not null").groupBy("key").agg(F.avg("level").alias("grade"))
    known = graded.where("grade is not null")
    n = known.count()
    known = known.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < max(1, int(1_000_000 * min(1.0, most_labels / max(n, 1)))))
    fit = scores(one.join(known.select("key"), "key", "left_semi"), "key", "text", model, KEEPS).join(known, "key").orderBy(F.xxhash64("key")).select("q", "grade").toPandas()
    wanted = one if everything else one.join(graded.where("grade is null").select("key"), "key", "left_semi")
    if not len(fit):
        keys = one.select("key").distinct() if everything else graded.where("grade is null").select("key")
        return keys.select("key", F.lit(3).alias("level"), F.lit(3.0).alias("score"))
    grades = fit["grade"].to_numpy(np.float64)
    best, scale = fitted(np.stack(fit["q"].to_numpy()), grades, len(KEEPS))
    found = scores(wanted, "key", "text", model, (KEEPS[best],))
    if not everything:
        found = graded.where("grade is null").select("key").join(found, "key", "left").select("key", F.coalesce("q", F.array(*[F.lit(0.0)] * len(QUANTILES))).alias("q"))
    low, high = int(np.floor(grades.min())), int(np.ceil(grades.max()))
    shared = spark.sparkContext.broadcast(scale)

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = shared.value(np.stack(batch["q"].to_numpy())) if len(batch) else np.empty(0)
            yield pd.DataFrame({"key": batch["key"], "level": np.clip(np.floor(at + 0.5), low, high).astype(np.int32), "score": at})

    return found.mapInPandas(mapped, f"key {docs.schema[key].dataType.simpleString()}, level int, score double")
