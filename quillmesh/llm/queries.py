"""The queries of the nine problems, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import history, knn, leakage, lookalike, neardup, packing, reading, sentences, spans
from quillmesh.llm.oracles import ORACLES  # noqa: F401  (the driver reads it here)
from quillmesh.tables import table, written


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    sentences = lookalike.same_look_pairs(table(spark, d, "sentences"), "sent_id", "text").select(F.lit("sentence").alias("src"), "key_a", "key_b")
    flags = lookalike.same_look_lookup(table(spark, d, "obfuscation_flags"), "flag_id", "type", table(spark, d, "flag_types"), "type_id", "type").select(F.lit("flag").alias("src"), "key_a", "key_b")
    return sentences.unionByName(flags)


def p1_plain_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flags by canonical type: how many raw spellings and how many flags each holds."""
    flags = table(spark, d, "obfuscation_flags").dropDuplicates(["flag_id", "type"])
    return lookalike.unify(flags, "type", "plain").groupBy("plain").agg(F.count("*").alias("n_flags"), F.countDistinct("type").alias("n_spellings"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    near = knn.nearest(table(spark, d, "sentence_vectors"), "vec_id", "embedding", dim=96, k=5, least=0.80)
    return near.select(F.least("id", "other").alias("vec_a"), F.greatest("id", "other").alias("vec_b")).distinct()


def p2_search(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar vectors, at any similarity, of every vector whose id is divisible by 50."""
    near = knn.nearest(table(spark, d, "sentence_vectors"), "vec_id", "embedding", dim=96, k=5, queries=F.col("id") % 50 == 0, probes=48)
    return near.select(F.col("id").alias("vec_id"), "other", F.round("cosine", 6).alias("cosine"), "rank")


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Corpus documents and scanned sentences as records of one kind."""
    docs = table(spark, d, "corpus_docs").select(F.lit("corpus").alias("src"), F.col("id").alias("rec_key"), F.col("content").alias("text"))
    return docs.unionByName(table(spark, d, "sentences").select(F.lit("sentence").alias("src"), F.col("sent_id").alias("rec_key"), "text"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(_records(spark, d), "rec_key", "text").select("rec_key", "start_pos", "end_pos")


def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    """How much of each record is found elsewhere."""
    return spans.shared_shares(_records(spark, d), "rec_key", "text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "corpus_docs").select(F.lit("corpus").alias("src"), F.col("id").alias("rec_key"), F.col("content").alias("text"), "batch_no")
    text = F.explode(F.array(history.report_text(F.col("json"))))  # one row each; filters aren't pushed below it, where they would parse the report again
    jobs = table(spark, d, "jobs").select(F.lit("job").alias("src"), F.col("job_id").alias("rec_key"), text.alias("text"), "batch_no")
    found = history.repeated_rows(docs.unionByName(jobs), "rec_key", "text", "batch_no", within="src")
    return found.select(F.col("within").alias("src"), F.col("key").alias("rec_key"), "batch_no")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicates(_records(spark, d), "rec_key", "text", n=3, threshold=0.55, least_words=16, within="src")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = sentences.sentences(_records(spark, d), "rec_key", "text", least=F.when(F.col("src") == "corpus", 1).otherwise(2))
    return found.select("rec_key", "start_pos", "end_pos")


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    sizes = written(packing.token_sizes(table(spark, d, "documents"), "doc_id", "text"), "sizes")
    placed = packing.pack(sizes, "key", "tokens", table(spark, d, "pack_targets"), "target_id", "capacity_tokens")
    return placed.withColumnsRenamed({"target": "target_id", "key": "doc_id", "container": "container_id"})


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """For each capacity: containers, tokens and the share of space used."""
    of = p7_pack(spark, d).groupBy("target_id").agg(F.countDistinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    used = F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6)
    return of.join(table(spark, d, "pack_targets"), "target_id").select("target_id", "containers", "tokens", used.alias("used"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", ["text"]).select(F.col("page").alias("doc_id"), F.col("item").alias("item_id"))


def p8_leak_places(spark: SparkSession, d: str) -> DataFrame:
    """Leaks of questions with the number of leaked words, the first run's place in the page, and that of an answer after it."""
    return leakage.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", ["text"], answer="answer").withColumnsRenamed({"page": "doc_id", "item": "item_id"})


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.estimate(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "reading_labels"), "doc_id", "level").select(F.col("key").alias("doc_id"), "level")


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    """The estimated level of every page."""
    return reading.estimate(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "reading_labels"), "doc_id", "level", everything=True).select(F.col("key").alias("doc_id"), "level")


QUERIES = {"p1_found": p1_found, "p1_plain_flags": p1_plain_flags, "p2_found": p2_found, "p2_search": p2_search, "p3_found": p3_found, "p3_shares": p3_shares, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p7_pack": p7_pack, "p7_fill": p7_fill, "p8_found": p8_found, "p8_leak_places": p8_leak_places, "p9_found": p9_found, "p9_levels": p9_levels}

