"""Problem 4: deduplicating new batches against all history.

Content-defined chunking over words: a rolling window of five words begins a chunk at each word whose hash
is the least of them, so chunks hold three words at least, five on average, and an edit changes only the chunks
that it touches. The store keeps, for each batch,

- chunks: (chunk, tid, batch_no) of each distinct text that the batch brought first,
- records: (tid, batch_no, n, shingles, print) of the same texts,

and a new batch is met by them alone: no text of the history is read or cut again, and no history is
shuffled. The batch's chunks, or beyond a bound their bits in a table of fixed size, are broadcast; the history's
chunks stream past them, and only postings of the batch's chunks go on. For each new text the postings give the bytes that it shares with each
stored one; of its chunks the most common ones, up to `drop` of its bytes, are not looked up, so any text that
shares `coverage` of them still shows `coverage - drop`. What passes is decided by coverage and, if a
threshold is given, by exact overlap; then the texts that the store doesn't have are accepted and appended.
Sets are read only for pairs whose sizes and prints (odd sketches) leave such an overlap possible: the bits in which
two prints differ are never more than the runs that only one of the texts has, so no pair is lost.

Texts that are found to repeat another one are appended too, unless they are the same: a later text may be
near to them and not to what they repeat.

Defined results
- null text, key or batch: no part. Texts under `least_words` words, so also empty ones: no part.
- a row repeated within a batch counts once; the same text in a later batch is a case of that batch,
  under its old key or a new one; the same text twice within one batch alone is none.
- appending a batch again adds nothing: texts that the store has are left out.
- batches go in ascending order; a batch below one that the store has meets only what lies below it.
- columns besides the named ones are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import let
from quillmesh.llm import wordsets
from quillmesh.llm.wordsets import enough_words, keyed, lists_of, long_enough, odd_sketches, only_members
from quillmesh.tables import scratch_dir, written

RECORD = "tid binary, batch_no int, n int, shingles array<int>, print array<bigint>"
SIGNED = f"{RECORD}, chunks array<bigint>, bytes array<int>, weight bigint"
#: Bits of a print.
PRINT = 512
#: About how many chunks of a batch one task and one file of the store get, so that a batch of few texts is not spread over many.
SHARE = 1 << 19


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def signed(texts: DataFrame, n: int, least_words: int) -> DataFrame:
    """Set (as 32-bit hashes, for comparing two texts), its print and chunks of each text (tid, text, within, batch_no) of at least `least_words` words."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, words = long_enough(batch, max(n, least_words, 1))
            runs, of = words.shingles(n, salted=False)
            ends, found = words.each(runs.astype(np.uint32), of)
            chunk, of, size = words.chunks()
            parts, chunks, sizes = words.each(chunk, of, size)
            sums = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
            tid, batch_no = (batch.column(c).take(pa.array(rows)) for c in ("tid", "batch_no"))
            prints = lists_of(np.arange(len(rows) + 1) * (PRINT // 64), odd_sketches(found.astype(np.uint64), ends, PRINT).reshape(-1).view(np.int64))
            columns = [tid, batch_no, pa.array(np.diff(ends).astype(np.int32)), lists_of(ends, found.view(np.int32)), prints, lists_of(parts, chunks.view(np.int64)), lists_of(parts, sizes.astype(np.int32)), pa.array(sums[parts[1:]] - sums[parts[:-1]])]
            yield pa.RecordBatch.from_arrays(columns, names(SIGNED))

    return texts.select("tid", "text", "within", "batch_no").mapInArrow(made, SIGNED)


def possible(threshold: float) -> Column:
    """Whether two sets (n, print; other_n, other_print) can have this overlap, by their sizes and prints; true where a print is missing."""
    differ = sum((F.bit_count(F.col("print")[k].bitwiseXOR(F.col("other_print")[k])) for k in range(PRINT // 64)), F.lit(0))
    apart = F.greatest(F.abs(F.col("n") - F.col("other_n")), differ)  # the values that only one of them has are so many at least; greatest skips nulls
    return apart <= (F.col("n") + F.col("other_n")) * F.lit((1 - threshold) / (1 + threshold)) + F.lit(1e-6)


class ChunkStore:
    """The persistent chunk-to-record table below `path`, in the folder that all executors share.

    Each append writes its own folder of records and chunks; neither is read to make another.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, what: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{what}").select(*names(schema))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def records(self) -> DataFrame | None:
        return self._read("records", RECORD)

    def _with_stored(self, met: DataFrame, most: int, few: bool, *columns: Column | str) -> DataFrame:
        """`met` (other, h, ...; `most` rows at most) and these columns of the stored text; broadcast if they are few, else no history is shuffled but what `met` names."""
        stored = self.records().select(F.col("tid").alias("other"), *columns)
        if few:
            return stored.join(F.broadcast(met), "other")
        return met.join(only_members(stored.withColumn("h", F.xxhash64("other")), "h", met.select("h"), most).drop("h"), "other")

    def append(self, new: DataFrame) -> None:
        """Accepts signed texts that the store doesn't have; they are read twice."""
        run = uuid.uuid4().hex
        new.select(*names(RECORD)).write.parquet(f"{self.path}/records/run={run}")
        new.select(F.explode("chunks").alias("chunk"), "tid", "batch_no").write.parquet(f"{self.path}/chunks/run={run}")

    def match(self, new: DataFrame, coverage: float = 0.10, drop: float = 0.08, threshold: float | None = None, most: int | None = None) -> DataFrame:
        """(tid, other, batch_no, coverage, overlap): stored texts of a batch below the new text's, or the same text, that it repeats.

        new: signed texts that need not be in the store; batch_no is that of the stored text. coverage is what the chunks
        that were looked up show. most: how many chunks the new texts have at most, if known.
        """
        stored = self._read("chunks", "chunk bigint, tid binary, batch_no int")
        if stored is None:
            return self.spark.createDataFrame([], "tid binary, other binary, batch_no int, coverage double, overlap double")
        pieces = new.select("tid", F.col("batch_no").alias("before"), "weight", F.explode(F.arrays_zip("chunks", "bytes")).alias("c")).select("tid", "before", "weight", F.col("c.chunks").alias("chunk"), F.col("c.bytes").alias("bytes"))
        posted = written(only_members(stored, "chunk", pieces.select("chunk"), most).withColumnRenamed("tid", "other"), "posted")
        common = posted.groupBy("chunk").agg(F.count("*").alias("n"))  # of the batch's own chunks where those are broadcast, so no more rows than they
        common = F.broadcast(common) if most is not None and most <= wordsets.MEMBERS else common
        passed = F.sum("bytes").over(Window.partitionBy("tid").orderBy(F.desc("n"), "chunk"))  # of one text: its chunks, from common to rare
        wanted = pieces.join(common, "chunk").withColumn("passed", passed).where(F.col("passed") > drop * F.col("weight"))
        met = wanted.join(posted, "chunk").where("batch_no < before or tid = other").groupBy("tid", "other").agg(F.sum("bytes").alias("shared"), F.first("weight").alias("weight"))
        met = written(met.select("tid", "other", (F.col("shared") / F.col("weight")).alias("coverage")).where(F.col("coverage") >= coverage - drop - 1e-9).withColumn("h", F.xxhash64("other")), "met")
        count = met.coalesce(1).count()  # one job; no column is read
        few = count <= wordsets.MEMBERS // 8  # then they and their prints are broadcast, and the history is not even shuffled in part
        if threshold is not None:
            mine = new.select("tid", "n", "print").join(F.broadcast(met) if few else met, "tid")
            near = self._with_stored(mine, count, few, F.col("n").alias("other_n"), F.col("print").alias("other_print")).where((F.col("tid") == F.col("other")) | possible(threshold))
            met = written(near.select("tid", "other", "coverage", "h"), "near")
            count = count if few else met.coalesce(1).count()
        some = only_members(new.select("tid", F.col("shingles").alias("mine"), F.xxhash64("tid").alias("of")), "of", met.select(F.xxhash64("tid")), count)
        shared = F.size(F.array_intersect("mine", "theirs"))
        both = self._with_stored(met, count, few, "batch_no", F.col("shingles").alias("theirs")).join(some, "tid")
        found = both.select("tid", "other", "batch_no", "coverage", (shared / (F.size("mine") + F.size("theirs") - shared)).alias("overlap"))
        return found.where((F.col("tid") == F.col("other")) | (F.col("coverage") >= coverage if threshold is None else F.col("overlap") >= threshold))


def repeated_rows(df: DataFrame, key: str, text: str, batch: str, store: ChunkStore | None = None, n: int = 3, threshold: float | None = 0.55, least_words: int = 16, coverage: float = 0.10, drop: float = 0.08, within: str | None = None) -> DataFrame:
    """(key, within, batch_no): rows for which an earlier batch, in `df` or in the store, brought a text with this overlap.

    Batch after batch is signed, matched against the store and appended to it. within: a column whose values part the
    rows into groups; texts of different groups are not compared.
    """
    spark = df.sparkSession
    store = store or ChunkStore(spark, f"{scratch_dir(spark)}/quillmesh/store-{uuid.uuid4().hex}")
    rows = keyed(df, key, text, F.col(batch).cast("int").alias("batch_no"), within=within).where("batch_no is not null").where(enough_words(max(n, least_words)))
    texts = rows.groupBy("batch_no", "tid").agg(F.first("text").alias("text"), F.first("within").alias("within"))
    every = written(signed(texts, n, least_words), "signed", partition_by=["batch_no"])
    sizes = every.groupBy("batch_no").agg(F.sum(F.size("chunks")).alias("n")).collect()  # as many as there are batches
    repeated = None
    for number, most in sorted((r["batch_no"], r["n"]) for r in sizes):
        new = every.where(F.col("batch_no") == number).select(*names(SIGNED)).coalesce(max(1, -(-most // SHARE)))
        found = written(store.match(new, coverage, drop, threshold, most), "found")
        own = found.where("tid = other").select("tid")
        store.append(new.join(own, "tid", "left_anti"))
        one = found.where(F.col("batch_no") < number).select("tid", F.lit(number).alias("batch_no"))
        repeated = one if repeated is None else repeated.unionByName(one)
    if repeated is None:
        return rows.select("key", "within", "batch_no").limit(0)
    return rows.select("key", "tid", "within", "batch_no").join(repeated.distinct(), ["tid", "batch_no"], "left_semi").select("key", "within", "batch_no").distinct()


JOB = "report struct<sentences: array<struct<text: string>>>, _bad string"


def report_text(json: Column) -> Column:
    """The sentence texts of a stored job's report, in order, joined by one space; null if none can be read."""
    job = F.from_json(json, JOB, {"columnNameOfCorruptRecord": "_bad"})
    return let(job, lambda job: F.when(job["_bad"].isNull() & job["report"]["sentences"].isNotNull(), F.array_join(F.transform(job["report"]["sentences"], lambda s: s["text"]), " ")))
