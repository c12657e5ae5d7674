"""Word-sequence sets of texts: what the duplicate operators (problems 4 and 5) share.

A text's words are those of its plain form (problem 1), lower-cased. Its set holds a 64-bit hash of each
distinct run of n words. Distinct texts are found first, by the 128-bit digest of the text as stored, so
copies cost one row of keys each and are never compared.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.lookalike import plain_words

_P = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5), np.uint64(0x85EBCA77C2B2AE63)]
#: How many hashed counters order shingles from rare to common. Their number is fixed, so what is broadcast is too.
COUNTERS = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def word_hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    """64-bit hashes of words; `known` remembers those of a batch."""
    out = np.empty(len(words), np.uint64)
    for k, w in enumerate(words):
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        out[k] = h
    return out


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, in order."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        total += hashes[k : k + len(total)] * _P[k % len(_P)] + np.uint64(k // len(_P))
    return mix(total)


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    return np.unique(runs(hashes, n)).view(np.int64)


def keyed(df: DataFrame, key: str, text: str, *more: Column, within: str | None = None) -> DataFrame:
    """(key, tid, text, within, more...): tid is the digest that stands for the text as stored, in its group if `within` names one."""
    group = F.col(within).cast("string") if within else F.lit("")
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), group.alias("within"), *more).where("key is not null and text is not null and within is not null")
    return rows.withColumn("tid", F.unhex(F.md5(F.concat_ws("\u0000", "within", "text"))))


def enough_words(least: int) -> Column:
    """Whether a text is long enough for so many words, each a character and white space: what isn't need not be shuffled."""
    return F.length("text") >= 2 * least - 1


def salt(within: str) -> np.uint64:
    """What a group adds to every hash, so that texts of different groups share nothing."""
    return np.uint64(xxhash.xxh3_64_intdigest(within.encode("utf-8", "surrogatepass"))) if within else np.uint64(0)


class Words:
    """The words of some texts as one row of hashes: `hashes` and `bytes` of each word, `of` its text, `at` its place and `left` the words after it."""

    def __init__(self, lists: list[list[str]], salts: np.ndarray) -> None:
        flat = [w for words in lists for w in words]
        known = {w: k for k, w in enumerate(dict.fromkeys(flat))}
        raw = [w.encode("utf-8", "surrogatepass") for w in known]
        word = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
        self.sizes = np.array([len(words) for words in lists], np.int64)
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))[word]
        self.bytes = np.fromiter(map(len, raw), np.int32, len(raw))[word] + np.int32(1)
        self.of = np.repeat(np.arange(len(lists)), self.sizes)
        self.at = np.arange(len(flat)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.left = self.sizes[self.of] - self.at - 1
        self.salts = salts

    def each(self, values: np.ndarray, of: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
        """(ends, values, more...): the distinct values (unsigned) of each text in order, and what stands beside one of each; text k has those from ends[k] to ends[k + 1]."""
        bits = max(1, (len(self.sizes) - 1).bit_length())
        size = 8 * values.dtype.itemsize
        lost = max(0, bits + size - 64)  # of a value's bits, beside the text's number
        key = (of.astype(np.uint64) << np.uint64(min(size, 64 - bits))) | (values >> values.dtype.type(lost)).astype(np.uint64)
        order = np.argsort(key)
        key = key[order]
        values_, of_ = values[order], of[order]
        same = key[1:] == key[:-1]
        if lost and (same & (values_[1:] != values_[:-1])).any():  # different values of one text that the key doesn't tell apart
            order = np.lexsort((values, of))
            values_, of_ = values[order], of[order]
            same = (values_[1:] == values_[:-1]) & (of_[1:] == of_[:-1])
        first = np.r_[True, ~same] if len(of_) else np.zeros(0, bool)
        ends = np.r_[0, np.cumsum(np.bincount(of_[first], minlength=len(self.sizes)))]
        return ends, values_[first], *(m[order][first] for m in more)

    def shingles(self, n: int, salted: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """A hash of each run of n words within a text, and the run's text."""
        whole = np.flatnonzero(self.left >= n - 1)
        plain = self.hashes + self.salts[self.of] if salted else self.hashes
        total = np.zeros(len(whole), np.uint64)
        for k in range(n):
            total += plain[whole + k] * _P[k % len(_P)] + np.uint64(k // len(_P))
        return mix(total), self.of[whole]

    def chunks(self, reach: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text, bytes) of each content-defined chunk: one begins at each word whose hash is the least of the window of `reach` words on both sides."""
        order = mix(self.hashes)
        begins = np.ones(len(order), bool)
        for d in range(1, reach + 1):
            begins[d:] &= (order[d:] < order[:-d]) | (self.at[d:] < d)
            begins[:-d] &= (order[:-d] <= order[d:]) | (self.left[:-d] < d)
        edges = np.flatnonzero(begins | (self.at == 0))
        if not len(edges):
            return order[:0], self.of[:0], self.bytes[:0]
        # A polynomial over the words of each chunk, mod 2^64.
        place = np.arange(len(order)) - np.repeat(edges, np.diff(np.r_[edges, len(order)]))
        powers = np.cumprod(np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
        sums = np.add.reduceat(self.hashes * powers[place], edges)
        return mix(sums + self.salts[self.of[edges]]), self.of[edges], np.add.reduceat(self.bytes, edges)


def long_enough(batch: pa.RecordBatch, least: int) -> tuple[np.ndarray, Words]:
    """The rows of a batch (text, within) of at least so many words, and their words."""
    lists = [plain_words(t) for t in batch.column("text").to_pylist()]
    rows = np.flatnonzero(np.array([len(x) for x in lists], np.int64) >= least)
    groups = batch.column("within").to_pylist()
    of_group = {g: salt(g) for g in {groups[k] for k in rows}}
    return rows, Words([lists[k] for k in rows], np.array([of_group[groups[k]] for k in rows], np.uint64))


def lists_of(ends: np.ndarray, values: np.ndarray) -> pa.ListArray:
    """A column of arrays: row k has values[ends[k]:ends[k + 1]]."""
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


def sets(texts: DataFrame, n: int, least_words: int, bits: int) -> DataFrame:
    """(tid, n, shingles, print) of the rows (tid, text, within); texts of fewer words than `least_words` or n have no row."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, words = long_enough(batch, max(n, least_words))
            ends, found = words.each(*words.shingles(n))
            prints = pa.array([p.tobytes() for p in odd_sketches(found, ends, bits)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("tid").take(pa.array(rows)), pa.array(np.diff(ends).astype(np.int32)), lists_of(ends, found.view(np.int64)), prints], ["tid", "n", "shingles", "print"])

    return texts.select("tid", "text", "within").mapInArrow(made, "tid binary, n int, shingles array<bigint>, print binary")


def odd_sketches(values: np.ndarray, ends: np.ndarray, bits: int) -> np.ndarray:
    """A row of bytes for each set: `bits` bits (a power of 2), of which each value flips the one that its hash names."""
    spots = ((values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - bits.bit_length())).astype(np.int64)
    spots += np.repeat(np.arange(len(ends) - 1) * bits, np.diff(ends))
    return np.packbits((np.bincount(spots, minlength=(len(ends) - 1) * bits) & 1).astype(np.uint8).reshape(-1, bits), axis=1)


#: Counters that go together, so that they are added up by several tasks.
WIDTH = 1 << 14


def slot_counts(values: DataFrame, column: str) -> DataFrame:
    """(part, data): occurrences of an array column's values by hashed slot, of which there are COUNTERS; added up for each task before they are sent, WIDTH in a row."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            slots = batch.column(column).flatten().to_numpy(zero_copy_only=False) & np.int64(COUNTERS - 1)
            total += np.bincount(slots, minlength=COUNTERS).astype(np.uint32)
        parts = [k for k in range(COUNTERS // WIDTH) if total[k * WIDTH : (k + 1) * WIDTH].any()]
        data = [pa.compress(total[k * WIDTH : (k + 1) * WIDTH].tobytes(), codec="zstd", asbytes=True) for k in parts]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(data, pa.binary())], ["part", "data"])

    return values.select(column).mapInArrow(counted, "part int, data binary")


def gathered(counts: DataFrame) -> np.ndarray:
    """Counters as one byte each, on a logarithmic scale: an order from rare to common of fixed size.

    They are packed by the executors, so that the driver gets a few rows of bytes.
    """

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(WIDTH, np.int64)
        for data in group["data"]:
            total += np.frombuffer(pa.decompress(data, 4 * WIDTH, codec="zstd", asbytes=True), np.uint32)
        out = np.minimum(127, 4 * np.log2(np.maximum(total, 1))).astype(np.int8)
        return pd.DataFrame({"part": group["part"].iloc[:1], "data": [out.tobytes()]})

    rows = counts.groupBy("part").applyInPandas(packed, "part int, data binary").collect()
    out = np.zeros(COUNTERS, np.int8)
    for r in rows:
        out[r["part"] * WIDTH : (r["part"] + 1) * WIDTH] = np.frombuffer(r["data"], np.int8)
    return out


#: Bits of a membership table. Their number is fixed, so what is broadcast is too.
MEMBER_BITS = 1 << 26
#: Up to so many values (8 bytes each) are broadcast themselves.
MEMBERS = 1 << 20


def members(values: DataFrame, column: str) -> np.ndarray:
    """A table of MEMBER_BITS bits in which the bit of each value (64-bit hashes) is set; made by the executors, a word for each that has a bit."""
    at = F.col(column).bitwiseAND(F.lit(MEMBER_BITS - 1))
    words = values.select(F.shiftright(at, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast({column} & 63 AS int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(MEMBER_BITS // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out


def only_members(df: DataFrame, column: str, values: DataFrame, most: int | None = None) -> DataFrame:
    """Rows whose value is among the 64-bit hashes `values` (one column), so that a large table need not be shuffled to meet a small one.

    Up to MEMBERS values are broadcast. Beyond, their table of bits is, which lets a few others pass as well: what follows is a join in either case.
    most: how many rows `values` has at most; where it is known, they are neither made distinct nor counted.
    """
    some = values.select(F.col(values.columns[0]).alias(column))
    some = some if most is not None else some.distinct()
    if (some.limit(MEMBERS + 1).count() if most is None else most) <= MEMBERS:
        return df.join(F.broadcast(some), column, "left_semi").select(*df.columns)
    table = members(some, column)
    shared = df.sparkSession.sparkContext.broadcast(zlib.compress(table.tobytes(), 1))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            if table is None:
                table = np.frombuffer(zlib.decompress(shared.value), np.int64)
            h = batch.column(column).to_numpy(zero_copy_only=False) & np.int64(MEMBER_BITS - 1)
            yield batch.filter(pa.array((table[h >> 6] >> (h & 63)) & 1 == 1))

    return df.mapInArrow(kept, df.schema)


def rarest(values: np.ndarray, ends: np.ndarray, counts: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The take[k] rarest values of each set k by the counters, ties by value: the same order in every set. Also the set of each."""
    sizes = np.diff(ends)
    of = np.repeat(np.arange(len(sizes)), sizes)
    common = counts[values & np.int64(len(counts) - 1)]
    bits = max(1, (len(sizes) - 1).bit_length())
    lost = bits + 7  # of a value's bits, beside the set's number and the counter's seven
    key = (of.astype(np.uint64) << np.uint64(64 - bits)) | (common.astype(np.uint64) << np.uint64(57 - bits)) | (values.view(np.uint64) >> np.uint64(lost))
    order = np.argsort(key)
    key = key[order]
    if (key[1:] == key[:-1]).any():  # different values that the key doesn't tell apart
        order = np.lexsort((values.view(np.uint64), common, of))
    chosen = order[np.arange(len(of)) - ends[:-1][of] < take[of]]
    return values[chosen], of[chosen]


def with_copies(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Links between texts (tid_a, tid_b) as pairs of keys (key_a, key_b), key_a < key_b, each once.

    Each key of a linked text meets the first and the last key of the other text, and each key of a
    text with several keys the first and the last of its own: linear in the copies, and every link
    between different texts, and every copy, is there. rows: (key, tid), the texts that take part.
    """
    ends = rows.groupBy("tid").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    both = links.select("tid_a", "tid_b").unionByName(links.select(F.col("tid_b").alias("tid_a"), F.col("tid_a").alias("tid_b"))).distinct()
    met = both.join(ends.withColumnRenamed("tid", "tid_b"), "tid_b").select(F.col("tid_a").alias("tid"), "first", "last")
    met = met.unionByName(ends.where("first <> last"))
    pairs = rows.join(met, "tid").select("key", F.explode(F.array_distinct(F.array("first", "last"))).alias("end")).where("key <> end")
    return pairs.select(F.least("key", "end").alias("key_a"), F.greatest("key", "end").alias("key_b")).distinct()
