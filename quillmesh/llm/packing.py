"""Problem 7: filling fixed-capacity containers with items.

Sizes are tokens of a public tokenizer, counted over whole texts. Best-two-fit: a container is filled
greedily with the largest item that fits, then its smallest item is exchanged for the two unpacked
items that fill the widened gap more tightly, if there are such. Items go to blocks of about `block` by
hash and each block is packed by one task, so no task holds more than a block's sizes and at most one
container for each block and capacity stays loosely filled.

Defined results
- a page with null or empty text has size 0 and lies in a container like any other.
- a page larger than the capacity is cut into full pieces, each a container of its own, and a rest that
  is packed like an item; no other page is cut. Pieces are numbered from 0 and say where they begin.
- ties: items of one size are used in ascending key order. A capacity below 1 or null: no container.
- repeated rows of a page count once (the greatest text); null keys take no part; columns besides the named ones are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The public pre-tokenization pattern of byte-level BPE vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, tokens) of each row; null text has no tokens."""

    def sized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = encoding(vocabulary)
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "tokens": np.array([len(code.encode_ordinary(t)) if t else 0 for t in batch["text"]], np.int64)})

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null")
    return rows.mapInPandas(sized, f"key {df.schema[key].dataType.simpleString()}, tokens bigint").groupBy("key").agg(F.max("tokens").alias("tokens"))


class Pool:
    """Unpacked items by size; items of one size are taken in order."""

    def __init__(self, sizes: np.ndarray, capacity: int) -> None:
        self.count = np.bincount(sizes, minlength=capacity + 1)
        self.left = int(len(sizes))
        self._below: np.ndarray | None = None

    def below(self) -> np.ndarray:
        """For each x the largest size present that is at most x; 0 if none."""
        if self._below is None:
            self._below = np.maximum.accumulate(np.where(self.count > 0, np.arange(len(self.count)), 0))
        return self._below

    def take(self, size: int, n: int = 1) -> None:
        self.count[size] -= n
        self.left -= n
        if n > 0 and not self.count[size] or n < 0:
            self._below = None


def best_pair(pool: Pool, gap: int, least: int) -> tuple[int, int] | None:
    """Two items whose sum is the largest within the gap and above `least`."""
    below, present = pool.below(), np.flatnonzero(pool.count[1:gap]) + 1
    if not len(present):
        return None
    partner = below[gap - present]
    alone = (partner == present) & (pool.count[present] < 2)  # the item itself is no partner
    if alone.any():
        partner[alone] = np.where(present[alone] > 0, below[present[alone] - 1], 0)
    total = np.where(partner > 0, present + partner, 0)
    k = int(total.argmax())
    return (int(present[k]), int(partner[k])) if total[k] > least else None


def best_two_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Containers as lists of item sizes, for items of 1 to capacity."""
    pool, out = Pool(sizes, capacity), []
    while pool.left:
        gap, here = capacity, []
        while gap and pool.left:
            size = int(pool.below()[gap])
            if not size:
                break
            n = min(int(pool.count[size]), gap // size)
            pool.take(size, n)
            here += [size] * n
            gap -= n * size
        if gap and pool.left and here:
            smallest = here[-1]
            pair = best_pair(pool, gap + smallest, smallest)
            if pair:
                here.pop()
                for size in pair:
                    pool.take(size)
                pool.take(smallest, -1)
                here += pair
        out.append(here)
    return out


def pack_block(keys: np.ndarray, tokens: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(place, piece, first_token, tokens, container) of the items keys[place] of a block, containers from 0."""
    out, n = [], 0
    rest, first, piece = tokens.copy(), np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
    for k in np.flatnonzero(tokens > capacity):
        while rest[k] > capacity:
            out.append((int(k), int(piece[k]), int(first[k]), capacity, n))
            n, piece[k], first[k], rest[k] = n + 1, piece[k] + 1, first[k] + capacity, rest[k] - capacity
    order = np.lexsort((keys, rest))
    starts = np.searchsorted(rest[order], np.arange(capacity + 2))
    next_of = starts[:-1].copy()
    filled = best_two_fit(rest[rest > 0], capacity)
    empty = np.flatnonzero(rest == 0)
    for k in empty:  # nothing to hold: they lie in the first container
        out.append((int(k), 0, 0, 0, 0))
    for here in filled:
        for size in here:
            k = order[next_of[size]]
            next_of[size] += 1
            out.append((int(k), int(piece[k]), int(first[k]), size, n))
        n += 1
    return out


def pack(items: DataFrame, key: str, tokens: str, targets: DataFrame, target: str, capacity: str, block: int = 20_000, most_targets: int = 1000) -> DataFrame:
    """(target, container, key, piece, first_token, tokens): where each item lies for each capacity."""
    kind, target_kind = items.schema[key].dataType.simpleString(), targets.schema[target].dataType.simpleString()
    rows = items.select(F.col(key).alias("key"), F.col(tokens).cast("bigint").alias("tokens"))
    blocks = max(1, -(-rows.count() // block))
    wanted = targets.select(F.col(target).alias("target"), F.col(capacity).cast("bigint").alias("capacity")).where("capacity >= 1").distinct().limit(most_targets + 1).collect()
    if len(wanted) > most_targets:
        raise ValueError(f"more than {most_targets} capacities")
    schema = f"target {target_kind}, container bigint, key {kind}, piece int, first_token bigint, tokens bigint"
    if not wanted:
        return items.sparkSession.createDataFrame([], schema)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        keys, target, block = group["key"].to_numpy(), group["target"].iloc[0], int(group["block"].iloc[0])
        got = pack_block(keys, group["tokens"].to_numpy(np.int64), int(group["capacity"].iloc[0]))
        place, piece, first, size, container = (np.array(x, np.int64) for x in zip(*got))
        return pd.DataFrame({"target": target, "container": (block << 32) + container, "key": keys[place], "piece": piece.astype(np.int32), "first_token": first, "tokens": size})

    # Each item, by its size alone, goes once to each capacity.
    each = F.array(*[F.struct(F.lit(w["target"]).cast(target_kind).alias("target"), F.lit(w["capacity"]).cast("bigint").alias("capacity")) for w in wanted])
    placed = rows.select("key", "tokens", "block", F.inline(each))
    return placed.groupBy("target", "block").applyInPandas(packed, schema)
