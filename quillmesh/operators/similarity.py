"""Sentences against a corpus: TF-IDF, candidates, pair scores, sources, document scores.

All submissions are scored at once. Features are computed once for each distinct sentence, candidates
and pair scores are made block by block inside tasks (`candidates`), within what an organisation may see.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import prints, rewrite, text
from quillmesh.functions.cleaning import without_citations
from quillmesh.functions.stylometry import LN2_PLUS_1
from quillmesh.operators.candidates import best_sources, candidate_lists, scored_pairs

# English words without weight.
STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "shall", "can",
    "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "through", "during", "before", "after", "above", "below", "between", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "just", "but", "and", "or", "if", "then", "that", "this", "these", "those", "it", "its", "i", "you", "he", "she", "we", "they", "what", "which", "who", "also", "about", "there", "up", "out", "when", "how", "all", "both", "their", "they",
)
CANDIDATES, SOURCES, THRESHOLD = 120, 5, 0.12


def content(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*STOP_WORDS))


def corpus_sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, org_id, sent_idx, sentence) of documents (id, org_id, content), each id once."""
    one = docs.where("id is not null and content is not null").groupBy("id").agg(F.min(F.struct("org_id", "content")).alias("d"))
    return one.select(F.col("id").alias("doc_id"), F.col("d.org_id").alias("org_id"), F.posexplode(text.sentences(F.col("d.content"))).alias("sent_idx", "sentence"))


def idf_table(sentences: DataFrame) -> DataFrame:
    """(term, df, idf) over all sentences (sentence)."""
    terms = sentences.select(F.explode(F.array_distinct(text.tokens(F.col("sentence")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    spark = sentences.sparkSession
    return spark.sql("SELECT term, df, ln(((SELECT count(*) FROM {s}) + 1) / (df + 1)) + 1 AS idf FROM {t}", s=sentences, t=terms)


def term_weights(rows: DataFrame, table: DataFrame) -> DataFrame:
    """(key, term, weight) of rows (key, text): term frequency by inverse sentence frequency."""
    terms = rows.select("key", content(text.tokens(F.col("text"))).alias("c")).select("key", F.size("c").alias("n"), F.explode("c").alias("term")).groupBy("key", "n", "term").agg(F.count("*").alias("tf"))
    return terms.join(table.select("term", "idf"), "term", "left").select("key", "term", (F.col("tf") / F.col("n") * F.coalesce("idf", F.lit(LN2_PLUS_1))).alias("weight"))


def visible(queries: DataFrame, docs: DataFrame, on: list[str], org: str = "org_id", doc_org: str = "doc_org") -> DataFrame:
    """Queries joined with what their organisation may see, by equality alone: first the shared documents, then its own."""
    shared = queries.join(docs.where(F.col(doc_org) == "global"), on)
    own = queries.where(F.col(org) != "global").join(docs, [*on]).where(F.col(org) == F.col(doc_org)) if not on else queries.where(F.col(org) != "global").withColumn("__o", F.col(org)).join(docs.withColumn("__o", F.col(doc_org)), [*on, "__o"]).drop("__o")
    return shared.unionByName(own)


def candidates(queries: DataFrame, corpus: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """(qid, doc_id, shared, rank) of queries (qid, org_id, tokens): the documents that share most distinct tokens.

    Ties: the earlier position of the first shared token, then the smaller id. A query that shares no
    token with any document gets the first `most` that it may see.
    """
    found = candidate_lists(queries.select("qid", "org_id", "tokens"), corpus, most)
    return found.select("qid", F.posexplode("best").alias("n", "b")).select("qid", "b.doc_id", "b.shared", (F.col("n") + 1).alias("rank"))


def asked_sentences(queries: DataFrame) -> DataFrame:
    """(qid, org_id, text, tokens, normal): each distinct sentence of an organisation (org_id, text) without its citations."""
    asked = queries.where("text is not null and org_id is not null").select("org_id", "text").distinct().withColumn("clean", without_citations(F.col("text")))
    return asked.select(F.xxhash64("org_id", "text").alias("qid"), "org_id", "text", text.tokens(F.col("clean")).alias("tokens"), prints.shingle_text(F.col("clean")).alias("normal")).where(F.size("tokens") >= 3)


def pair_scores(queries: DataFrame, docs: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """(qid, org_id, text, doc_id, sent_idx, w, cos, sh, jaccard): each distinct sentence of an organisation with every sentence of its candidate documents.

    queries: (org_id, text); docs: (id, org_id, content). w: fingerprint containment, cos: TF-IDF cosine, sh: blended shingle containment.
    """
    found = scored_pairs(asked_sentences(queries), corpus_sentences(docs), most, STOP_WORDS)
    return found.select("qid", "org_id", "text", F.explode("best").alias("b")).select("qid", "org_id", "text", "b.*")


def sentence_sources(queries: DataFrame, docs: DataFrame, most: int = CANDIDATES, sources: int = SOURCES, threshold: float = THRESHOLD) -> DataFrame:
    """(org_id, text, doc_id, score, method, rank): the best sources of each distinct sentence of an organisation.

    queries: (org_id, text); docs: (id, org_id, content). A pair's score is the largest of fingerprint
    containment (exact), TF-IDF cosine (semantic) and blended shingle containment (shingle); of a
    document the best sentence counts, the first of equal ones.
    """
    found = best_sources(asked_sentences(queries), corpus_sentences(docs), most, STOP_WORDS, sources, threshold)
    return found.select("org_id", "text", F.posexplode("best").alias("n", "b")).select("org_id", "text", "b.*", (F.col("n") + 1).alias("rank"))


def code_sources(codes: DataFrame, docs: DataFrame, sources: int = SOURCES, threshold: float = 0.1) -> DataFrame:
    """(key, doc_id, score, rank): of each source text (key, org_id, code) the visible documents that hold most of its fingerprint.

    docs: (id, org_id, content). Texts of under ten tokens have no sources. The threshold is applied after
    the best are taken; ties: the smaller id.
    """
    asked = codes.where("key is not null and org_id is not null and code is not null").groupBy("key").agg(F.min(F.struct("org_id", "code")).alias("c"))
    tokens = asked.select("key", "c.org_id", rewrite.code_tokens(F.col("c.code")).alias("t")).where(F.size("t") >= 10)
    theirs = tokens.select("key", "org_id", prints.fingerprint(F.col("t")).alias("p")).select("key", "org_id", F.size("p").alias("n"), F.explode("p").alias("print"))
    one = docs.where("id is not null and content is not null").groupBy("id").agg(F.min(F.struct("org_id", "content")).alias("d"))
    posted = one.select(F.col("id").alias("doc_id"), F.col("d.org_id").alias("doc_org"), F.explode(prints.fingerprint(rewrite.code_tokens(F.col("d.content")))).alias("print"))
    met = visible(theirs, posted, ["print"]).groupBy("key", "doc_id", "n").agg(F.count("*").alias("shared"))
    best = Window.partitionBy("key").orderBy(F.desc("score"), "doc_id")
    ranked = met.select("key", "doc_id", (F.col("shared") / F.col("n")).alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= sources)
    return ranked.where(F.col("score") >= threshold).withColumn("score", text.rounded(F.col("score"), 6))


def best_match(weights: DataFrame) -> DataFrame:
    """(key, best, cosine): the other key of its group with the greatest inner product of weights (key, group, term, weight); ties: the smaller key."""
    a, b = weights, weights.withColumnsRenamed({"key": "best", "weight": "other"})
    dots = a.join(b, ["group", "term"]).where("key <> best").groupBy("key", "best").agg(text.rounded(F.sum(F.col("weight") * F.col("other")), 4).alias("cosine"))
    best = Window.partitionBy("key").orderBy(F.desc("cosine"), "best")
    return dots.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def document_scores(rows: DataFrame, aggressive: bool = False) -> DataFrame:
    """(key, n, similarity) of scorable sentences (key, score, n_tokens): a weighted blend of means, coverage and top shares."""
    by = Window.partitionBy("key")
    ranked = rows.withColumn("r", F.row_number().over(by.orderBy(F.desc("score")))).withColumn("n", F.count("*").over(by))
    t, s, total = F.col("n_tokens"), F.col("score"), F.sum("n_tokens")
    top = lambda share: F.avg(F.when(F.col("r") <= F.greatest(F.lit(1), F.ceil(F.col("n") * share)), s))
    agg = ranked.groupBy("key", "n").agg(
        total.alias("t"), F.sum(s * t).alias("st"), F.sum(F.when(s >= 0.20, t).otherwise(0)).alias("cov"), F.sum(F.when(s >= 0.12, t).otherwise(0)).alias("mc"),
        top(0.25).alias("top"), top(0.5).alias("ut"), F.avg(F.when(s >= 0.35, 1.0).otherwise(0.0)).alias("high"), F.avg(F.when(s >= 0.30, 1.0).otherwise(0.0)).alias("r30"),
    )
    mc = F.col("mc") / F.col("t")
    b = F.least(F.lit(1.0), 0.35 * F.col("st") / F.col("t") + 0.25 * F.col("cov") / F.col("t") + 0.25 * F.col("top") + 0.15 * F.col("ut"))
    if aggressive:
        when = lambda c, x: F.when(c, x).otherwise(0.0)
        b = F.least(F.lit(1.0), 0.45 * b + 0.35 * F.sqrt(mc) + 0.20 * F.pow("top", F.lit(0.70)))
        b = b + when((F.col("r30") >= 0.45) & (mc >= 0.70), 0.18) + when((F.col("r30") >= 0.60) & (mc >= 0.80), 0.20) + when((F.col("top") >= 0.45) & (mc >= 0.85), 0.14) + when(mc >= 0.90, 0.14)
        b = F.when((mc >= 0.75) & (F.col("top") >= 0.35), F.greatest(b, text.clamp(0.95 * mc + 0.35 * F.col("top")))).otherwise(b)
        b = F.least(F.lit(1.0), b + when(mc >= 0.75, 0.10) + when(mc >= 0.85, 0.08) + when(mc >= 0.92, 0.06))
    overwhelming = (mc >= 0.92) & (F.col("top") >= 0.55) & (F.col("high") >= 0.65)
    b = F.when(overwhelming, b).otherwise(F.least(b, F.lit(0.94)))
    return agg.select("key", "n", F.when(F.col("t") > 0, text.rounded(b, 4)).otherwise(0.0).alias("similarity"))
