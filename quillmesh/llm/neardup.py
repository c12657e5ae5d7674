"""Problem 5: near-duplicate records with small edits.

Two texts belong together if the overlap (Jaccard similarity) of their sets of word runs is at least a
threshold. The search is exact:

1. A text's fingerprint is a 512-bit odd sketch of its set: every run flips one bit. The Hamming
   distance of two fingerprints never exceeds the size of the sets' difference, and sets of sizes a and
   b with overlap >= t differ in at most (1-t)/(1+t) (a+b) runs: a radius that loses no pair.
2. Fingerprints of unrelated texts all lie about equally far apart, so no vantage point separates them
   (README). Shards are therefore seeded: texts that share one of the rarest (1-t) of their runs go to
   that run's shard, which every pair with overlap >= t does at least once.
3. A shard larger than `leaf` is cut into shells by the distance to its vantage point. A text lives in
   one shell and also queries each lower shell that its radius reaches over the boundary. Shells that
   are still large are cut into blocks, so no task holds more than two blocks.
4. Shards of up to `LEAF` are compared row by row; in larger ones a vantage-point tree is searched with the
   radius, branches pruned by the triangle bound. Pairs found are compared exactly.

Defined results
- null text or key: no part. Texts under `least_words` words, so also empty ones: no part.
- repeated rows of a key and text count once; a key with several texts takes part with each.
- copies of a text meet the first and the last key of their text, and of each linked text.
- columns besides the named ones are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.wordsets import enough_words, gathered, keyed, only_members, rarest, sets, slot_counts, with_copies
from quillmesh.tables import written

BITS = 512
#: What a tree's leaf holds. A shard no larger is a tree of one leaf; such leaves are scanned many at once.
LEAF = 48


def reach(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """How far from a set of this size any set with the wanted overlap can lie: it has at most size / t runs."""
    return (1 - threshold) / (1 + threshold) * (sizes + sizes / threshold) + 1e-9


class VPTree:
    """A vantage-point tree over fingerprints under Hamming distance."""

    def __init__(self, prints: np.ndarray, leaf: int = LEAF) -> None:
        self.prints, self.leaf = prints, leaf
        self.root = self._build(np.arange(len(prints)))

    def _far(self, k: int, of: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.prints[of] ^ self.prints[k]).sum(1)

    def _build(self, of: np.ndarray):
        if len(of) <= self.leaf:
            return of
        far = self._far(of[0], of[1:])
        cut = np.median(far)
        inner, outer = of[1:][far <= cut], of[1:][far > cut]
        if not len(outer):  # as many as are equally far: no vantage point tells them apart
            return of
        near, rest = far[far <= cut], far[far > cut]
        return of[0], (near.min(), near.max(), self._build(inner)), (rest.min(), rest.max(), self._build(outer))

    def within(self, query: np.ndarray, radius: float) -> np.ndarray:
        """Places of all fingerprints no farther than radius from the query."""
        found, open_ = [], [self.root]
        while open_:
            node = open_.pop()
            if isinstance(node, np.ndarray):
                found.append(node[np.bitwise_count(self.prints[node] ^ query).sum(1) <= radius])
                continue
            point, *sides = node
            far = int(np.bitwise_count(self.prints[point] ^ query).sum())
            if far <= radius:
                found.append(np.array([point]))
            open_ += [below for least, most, below in sides if far - radius <= most and far + radius >= least]  # triangle bound
        return np.concatenate(found) if found else np.empty(0, np.int64)


def _close(sizes_a: np.ndarray, sizes_b: np.ndarray, far: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets of these sizes, whose fingerprints lie this far apart, may have the wanted overlap."""
    share = (1 - threshold) / (1 + threshold)
    return (far <= share * (sizes_a + sizes_b) + 1e-9) & (np.minimum(sizes_a, sizes_b) >= threshold * np.maximum(sizes_a, sizes_b) - 1e-9)


def _of_small(few: np.ndarray, lengths: np.ndarray, ends: np.ndarray, prints: np.ndarray, sizes: np.ndarray, home: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of close pairs of all small shards at once: each row with the one next to it, then the one after, and so on."""
    at = np.flatnonzero(np.repeat(few, lengths))
    until = np.repeat(ends, lengths)[at]
    left, right = [], []
    step = 1
    while len(at):
        keep = at + step < until
        at, until = at[keep], until[keep]
        to = at + step
        ok = (home[at] | home[to]) & _close(sizes[at], sizes[to], np.bitwise_count(prints[at] ^ prints[to]).sum(1), threshold)
        left.append(at[ok])
        right.append(to[ok])
        step += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (at, at)


def _of_large(a: int, b: int, prints: np.ndarray, sizes: np.ndarray, home: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of close pairs of one shard: its residents with each other, and its visitors with residents."""
    residents = np.flatnonzero(home[a:b]) + a
    if not len(residents):
        return residents, residents
    tree, radius = VPTree(prints[residents]), reach(sizes[a:b], threshold)
    left, right = [], []
    for k in range(a, b):
        near = residents[tree.within(prints[k], radius[k - a])]
        if home[k]:
            near = near[near > k]
        near = near[_close(sizes[near], sizes[k], np.bitwise_count(prints[near] ^ prints[k]).sum(1), threshold)]
        left.append(np.full(len(near), k))
        right.append(near)
    return np.concatenate(left), np.concatenate(right)


def _searched(rows: pd.DataFrame, starts: np.ndarray, ends: np.ndarray, threshold: float) -> pd.DataFrame:
    """Close pairs of the shards rows[starts:ends]."""
    prints = np.frombuffer(b"".join(rows["print"]), np.uint64).reshape(len(rows), BITS // 64)
    sizes, ids, home = rows["n"].to_numpy(np.float64), rows["sid"].to_numpy(), rows["home"].to_numpy(bool)
    few = ends - starts <= LEAF
    found = [_of_small(few, ends - starts, ends, prints, sizes, home, threshold)]
    found += [_of_large(a, b, prints, sizes, home, threshold) for a, b in zip(starts[~few], ends[~few])]
    one, two = ids[np.concatenate([f[0] for f in found]).astype(np.int64)], ids[np.concatenate([f[1] for f in found]).astype(np.int64)]
    pairs = np.unique(np.stack([np.minimum(one, two), np.maximum(one, two)], 1)[one != two], axis=0)
    return pd.DataFrame({"sid_a": pairs[:, 0], "sid_b": pairs[:, 1]})


def links(of: DataFrame, threshold: float, leaf: int = 1000) -> DataFrame:
    """(sid_a, sid_b, overlap) of all sets (sid, n, shingles, print) with at least this overlap, each pair once."""
    spark = of.sparkSession
    common = spark.sparkContext.broadcast(gathered(slot_counts(of, "shingles")))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("shingles")
            ends = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
            sizes = np.diff(ends)
            values, of = rarest(lists.flatten().to_numpy(zero_copy_only=False), ends, common.value, sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(values), batch.column("sid").take(pa.array(of))], ["shard", "sid"])

    # Made twice, which is cheaper than to keep: as many rows as the texts have rare runs.
    seeded = of.select("sid", "shingles").mapInArrow(seeds, "shard bigint, sid bigint")
    sized = written(seeded.groupBy("shard").agg(F.count("*").alias("size"), F.min("sid").alias("vantage"), F.max("sid").alias("other")).where("size > 1"), "sized")
    # A shard of two is its pair already; only larger ones are gathered.
    twos = _near_twos(sized.where("size = 2").select(F.col("vantage").alias("sid_a"), F.col("other").alias("sid_b")).distinct(), of, threshold)
    members = seeded.join(sized.where("size > 2").drop("other"), "shard").join(of.select("sid", "n", "print"), "sid")
    largest = sized.agg(F.max("size").alias("m")).first()["m"] or 0
    row = ["shard", "shell", "block", "sid", "n", "print", "home"]
    if largest <= leaf:
        everywhere = members.select("shard", F.lit(0).alias("shell"), F.lit(0).alias("block"), "sid", "n", "print", F.lit(True).alias("home"))
    else:
        members = written(members, "members")
        small = members.where(F.col("size") <= leaf).select("shard", F.lit(0).alias("shell"), F.lit(0).alias("block"), "sid", "n", "print", F.lit(True).alias("home"))
        everywhere = small.unionByName(_shells(members.where(F.col("size") > leaf), threshold, leaf).select(*row))

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for batch in batches:
            if rest is not None:
                batch = pd.concat([rest, batch], ignore_index=True)
            if not len(batch):
                continue
            key = batch[row[:3]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
            if len(starts) > 1:  # the last shard may go on in the next batch
                yield _searched(batch.iloc[: starts[-1]], starts[:-1], starts[1:], threshold)
            rest = batch.iloc[starts[-1] :]
        if rest is not None and len(rest):
            yield _searched(rest, np.array([0]), np.array([len(rest)]), threshold)

    tasks = everywhere.repartition("shard", "shell", "block").sortWithinPartitions("shard", "shell", "block")
    near = written(tasks.mapInPandas(searched, "sid_a bigint, sid_b bigint").unionByName(twos).distinct(), "near")
    return compared(near, of, threshold)


def _near_twos(pairs: DataFrame, of: DataFrame, threshold: float) -> DataFrame:
    """The pairs (sid_a, sid_b) whose sizes and fingerprints allow the wanted overlap."""

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                one, two = (np.frombuffer(b"".join(b[c]), np.uint64).reshape(len(b), -1) for c in ("print_a", "print_b"))
                ok = _close(b["n_a"].to_numpy(np.float64), b["n_b"].to_numpy(np.float64), np.bitwise_count(one ^ two).sum(1), threshold)
                yield b.loc[ok, ["sid_a", "sid_b"]]

    a = of.select(F.col("sid").alias("sid_a"), F.col("n").alias("n_a"), F.col("print").alias("print_a"))
    b = of.select(F.col("sid").alias("sid_b"), F.col("n").alias("n_b"), F.col("print").alias("print_b"))
    sized = pairs.join(a, "sid_a").join(b, "sid_b").where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9)
    return sized.mapInPandas(close, "sid_a bigint, sid_b bigint")


def _shells(large: DataFrame, threshold: float, leaf: int, width: int = 32, parts: int = 8) -> DataFrame:
    """Members of large shards at each shell and block where they live (home) or that they query."""
    points = large.where("sid = vantage").select("shard", F.col("print").alias("point")).dropDuplicates(["shard"])

    def shells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                one, two = (np.frombuffer(b"".join(b[c]), np.uint64).reshape(len(b), -1) for c in ("print", "point"))
                far = np.bitwise_count(one ^ two).sum(1).astype(np.float64)
                low = np.maximum(0, np.floor((far - reach(b["n"].to_numpy(np.float64), threshold)) / width))
                yield b.assign(at=(far // width).astype(np.int32), low=low.astype(np.int32))[["shard", "sid", "n", "print", "at", "low"]]

    shelled = large.join(points, "shard").select("shard", "sid", "n", "print", "point").mapInPandas(shells, "shard bigint, sid bigint, n int, print binary, at int, low int")
    blocks = shelled.groupBy("shard", "at").agg(F.ceil(F.count("*") / leaf).cast("int").alias("blocks")).withColumnRenamed("at", "shell")
    placed = shelled.withColumn("shell", F.explode(F.sequence("low", "at"))).join(blocks, ["shard", "shell"])
    # A resident lives in one block and queries those before it; a visitor from a higher shell queries all.
    placed = placed.withColumn("own", F.when(F.col("shell") == F.col("at"), F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")).otherwise(F.col("blocks") - 1))
    placed = placed.withColumn("block", F.explode(F.sequence(F.lit(0), "own"))).withColumn("home", (F.col("shell") == F.col("at")) & (F.col("block") == F.col("own")))
    # Visitors are split over `parts` tasks; residents, of which there are about `leaf`, are copied to each.
    mine = F.array(F.pmod(F.xxhash64("sid", F.lit(1)), F.lit(parts)).cast("int"))
    placed = placed.withColumn("part", F.explode(F.when(F.col("home"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(mine)))
    return placed.withColumn("block", F.col("block") * parts + F.col("part"))


def compared(pairs: DataFrame, of: DataFrame, threshold: float) -> DataFrame:
    """(sid_a, sid_b, overlap): the pairs whose sets overlap by at least the threshold, compared exactly."""

    # Sets that stand in no pair need not be shuffled.
    ids = pairs.select(F.explode(F.array("sid_a", "sid_b")).alias("sid")).select(F.xxhash64("sid").alias("h"))
    some = only_members(of.select("sid", "shingles", F.xxhash64("sid").alias("h")), "h", ids, 2 * pairs.count())
    one, two = some.select(F.col("sid").alias("sid_a"), F.col("shingles").alias("one")), some.select(F.col("sid").alias("sid_b"), F.col("shingles").alias("two"))
    shared = F.size(F.array_intersect("one", "two"))
    overlap = shared / (F.size("one") + F.size("two") - shared)
    return pairs.join(one, "sid_a").join(two, "sid_b").select("sid_a", "sid_b", overlap.alias("overlap")).where(F.col("overlap") >= threshold)


def near_duplicates(df: DataFrame, key: str, text: str, n: int = 5, threshold: float = 0.8, least_words: int = 5, within: str | None = None, leaf: int = 1000) -> DataFrame:
    """(key_a, key_b), key_a < key_b: keys of texts with at least this overlap of their n-word runs.

    within: a column whose values part the rows into groups; texts of different groups are not compared.
    """
    rows = keyed(df, key, text, within=within).where(enough_words(max(n, least_words)))
    made = sets(rows.groupBy("tid").agg(F.first("text").alias("text"), F.first("within").alias("within")), n, least_words, BITS)
    made = written(made.withColumn("sid", F.monotonically_increasing_id()), "sets")
    found = links(made, threshold, leaf)
    tids = made.select("sid", "tid")
    found = found.join(tids.withColumnsRenamed({"sid": "sid_a", "tid": "tid_a"}), "sid_a").join(tids.withColumnsRenamed({"sid": "sid_b", "tid": "tid_b"}), "sid_b")
    part = rows.select("key", "tid").join(made.select("tid"), "tid", "left_semi")
    return with_copies(part, found.select("tid_a", "tid_b"))
