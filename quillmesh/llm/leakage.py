"""Problem 8: evaluation texts leaking into training text.

A leak is a run of at least `window` consecutive words that a page and a passage share. A word counts by
its letters and digits, lower-cased; words without any are skipped on both sides. Any such run covers a
whole block of `window` // 2 words of the passage that begins at a multiple of `window` // 2, so these blocks are
the patterns of one Aho-Corasick automaton: as many characters as the passages have. Each page is scanned
once; where a block is met, the run is followed to both sides word by word, each word of a run once.

Answers shorter than a window (`yes`, `B`) say nothing alone: they are patterns of the same automaton, and
one counts if it stands as a whole within `window` words after a leaked run of its item.

The passages are the small side: their size is measured, and a call beyond `max_chars` normalised characters
fails instead of broadcasting them (split such a set of items into several calls).

Defined results
- null or empty page: no match. Null passage: none. A passage of fewer than `window` words: never found alone.
- a passage under two items is reported under both; repeated rows of an item or a page count once.
- of several texts of one page the one with most leaked words is reported, then the one with the first place.
- columns besides the named ones are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 12
_NOT_WORD = re.compile(r"[^\w\s]+|_+")


def normalise(text: str) -> str:
    """Lower-cased words of letters and digits, each with one space before and after it."""
    return f" {' '.join(_NOT_WORD.sub('', text.lower()).split())} "


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where, in the text as stored, the words lie that normalise() keeps, in order."""
    return [m.span() for m in re.finditer(r"\S+", text) if _NOT_WORD.sub("", m[0].lower())]


class Book:
    """The automaton over the blocks of passages, and over whole answers that are shorter than a window."""

    def __init__(self, passages: list[tuple[object, str]], answers: list[tuple[object, str]], window: int) -> None:
        import ahocorasick

        self.window, self.words, self.items = window, [], []
        blocks: dict[str, list[tuple[int, int]]] = defaultdict(list)
        block = window // 2
        same: dict[str, int] = {}
        for item, text in passages:
            plain = normalise(text)
            if plain not in same:  # equal passages are one, with several items
                words = plain.split()
                if len(words) < window:
                    continue
                same[plain] = len(self.words)
                self.words.append(words)
                self.items.append(set())
                for k in range(0, len(words) - block + 1, block):
                    blocks[f" {' '.join(words[k : k + block])} "].append((same[plain], k))
            self.items[same[plain]].add(item)
        short: dict[str, set] = defaultdict(set)
        for item, text in answers:
            if 0 < len(normalise(text).split()) < window:
                short[normalise(text)].add(item)
        self.made = ahocorasick.Automaton()
        for pattern in {*blocks, *short}:
            self.made.add_word(pattern, (pattern.count(" ") - 1, blocks.get(pattern, ()), short.get(pattern, ())))
        self.made.make_automaton()

    def scan(self, text: str) -> dict[object, tuple[int, int, int, int | None, int | None]]:
        """For each item found: how many words of the page are covered, first and end character of the first run, and of the answer after a run."""
        plain = normalise(text)
        hits = list(self.made.iter(plain)) if len(self.made) else []
        if not any(places for _, (_, places, _) in hits):
            return {}
        page = plain.split()
        starts = list(accumulate((len(w) + 1 for w in page), initial=1))
        runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        reached: dict[tuple[int, int], int] = {}  # how far the runs on each diagonal of page and passage are followed
        for end, (n, places, _) in hits:
            last = bisect_right(starts, end)  # words up to the pattern's end
            for passage, k in places:
                begin, words = last - n, self.words[passage]
                if end <= 0 or reached.get((passage, begin - k), -1) >= last:
                    continue
                a, b = begin, last
                while a > 0 and k - (begin - a) > 0 and page[a - 1] == words[k - (begin - a) - 1]:
                    a -= 1
                while b < len(page) and k + (b - begin) < len(words) and page[b] == words[k + (b - begin)]:
                    b += 1
                reached[passage, begin - k] = b
                if b - a >= self.window:
                    runs[passage].append((a, b))
        if not runs:
            return {}
        spans, out = word_spans(text), {}
        of_item: dict[object, list[tuple[int, int]]] = defaultdict(list)
        for passage, found in runs.items():
            for item in self.items[passage]:
                of_item[item] += found
        for item, found in of_item.items():
            joined: list[list[int]] = []
            for a, b in sorted(found):
                if joined and a <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], b)
                else:
                    joined.append([a, b])
            answer = None
            for end, (n, _, told) in hits:
                last = bisect_right(starts, end)
                if item in told and any(b <= last - n <= b + self.window for _, b in joined):
                    answer = (spans[last - n][0], spans[last - 1][1])
                    break
            out[item] = (sum(b - a for a, b in joined), spans[joined[0][0]][0], spans[joined[0][1] - 1][1], *(answer or (None, None)))
        return out


def leaks(pages: DataFrame, page_key: str, text: str, items: DataFrame, item_key: str, passages: list[str], answer: str | None = None, window: int = WINDOW, max_chars: int = 100_000_000) -> DataFrame:
    """(page, item, n_words, start_pos, end_pos, answer_start, answer_end): pages that hold a run of at least `window` words of an item.

    n_words is how many words of the page are part of such runs, start_pos and end_pos place the first run in the page's text as
    stored. answer: a column of which a text of a window or more counts like a passage, and a shorter one after a run.
    """
    spark = pages.sparkSession
    told = items.select(F.col(item_key).alias("item"), F.inline(F.array(*[F.struct(F.lit(c == answer).alias("short"), F.col(c).alias("passage")) for c in [*passages, *([answer] if answer else [])]]))).where("item is not null and passage is not null").distinct()
    size = told.agg(F.coalesce(F.sum(F.length("passage") + 2), F.lit(0)).alias("n")).first()["n"]
    if size > max_chars:
        raise ValueError(f"passages of {size} characters; at most {max_chars} are broadcast")
    rows = [tuple(r) for r in told.collect()]  # at most max_chars characters
    shared = spark.sparkContext.broadcast(([(i, p) for i, _, p in rows], [(i, p) for i, s, p in rows if s]))
    kind = pages.schema[page_key].dataType.simpleString()
    columns = ["page", "item", "n_words", "start_pos", "end_pos", "answer_start", "answer_end"]

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book = Book(*shared.value, window)
        for batch in batches:
            out = [(page, item, *where) for page, text in zip(batch["page"], batch["text"]) for item, where in book.scan(text).items()]
            made = pd.DataFrame(out, columns=columns)
            yield made.astype({"answer_start": "Int32", "answer_end": "Int32"})

    texts = pages.select(F.col(page_key).alias("page"), F.col(text).alias("text")).where("page is not null and text is not null")
    found = texts.mapInPandas(scanned, f"page {kind}, item {items.schema[item_key].dataType.simpleString()}, n_words int, start_pos int, end_pos int, answer_start int, answer_end int")
    best = Window.partitionBy("page", "item").orderBy(F.desc("n_words"), "start_pos", "end_pos", "answer_start")
    return found.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r")
