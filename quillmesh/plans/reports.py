"""Queries over stored scores: report texts and lines, classes of sentences and paragraphs, shares, best matches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillmesh.operators import similarity
from quillmesh.queries import _IDF, _PARA, _SCORES, _WEIGHTS, CORPUS, DOCS, SENTENCES, _scores, _sentences, _weights, d_rounded, paragraph_scores, q, query
from quillmesh.tables import table


def percent(share: Column, digits: int = 1) -> Column:
    """A share as a percentage with so many decimals, rounded half up by whole numbers."""
    n = F.floor(share * 10 ** (digits + 2) + 0.5).cast("bigint")
    return F.concat(F.floor(n / 10**digits).cast("string"), F.lit("."), F.lpad((n % 10**digits).cast("string"), digits, "0"))


def _d_percent(x: str, digits: int = 1) -> str:
    n = f"floor({x} * 1e{digits + 2} + 0.5)::BIGINT"
    return f"(({n}) // {10**digits})::VARCHAR || '.' || lpad((({n}) % {10**digits})::VARCHAR, {digits}, '0')"


# Thresholds and texts of the explanation, each text's parts parted by the values put in.
_SIMILAR = (("similarity >= 0.40", "Plagiarism similarity is {s}% — above the HIGH threshold of 40%. {h} of {n} sentences match external sources."), ("similarity >= 0.18", "Plagiarism similarity is {s}% — MODERATE risk. {h} sentences exceed the per-sentence threshold."), ("true", "Plagiarism similarity is {s}% — within acceptable range."))
_MACHINE = (("ai >= 0.50", "AI generation probability is {a}% — HIGH. {m} sentences show strong AI authorship signals (connector overuse, passive voice, hedging, repetitive patterns)."), ("ai >= 0.22", "AI generation probability is {a}% — MODERATE. Some AI-generated passages detected."), ("true", "AI generation probability is {a}% — within human range."))
_HIDDEN = "⚠ HIGH-severity obfuscation detected: {o}. Text may have been deliberately manipulated to evade detection."
_SUMMARY = "We checked {n} sentences. {h} sentences had strong source overlap. {m} sentences looked highly machine-like. Overall similarity is {s}% and AI likelihood is {a}%."
_VALUES = {"{s}": "s", "{a}": "a", "{h}": "high_similarity", "{m}": "high_ai", "{n}": "n", "{o}": "hidden"}


def _filled(template: str) -> Column:
    """A text with its values put in from the columns that they are named after."""
    out = F.lit(template)
    for mark, column in _VALUES.items():
        if mark in template:
            out = F.replace(out, F.lit(mark), F.col(column).cast("string"))
    return out


def _d_filled(template: str) -> str:
    out = q(template)
    for mark, column in _VALUES.items():
        if mark in template:
            out = f"replace({out}, '{mark}', {column}::VARCHAR)"
    return out


def explained(rows: DataFrame) -> DataFrame:
    """`rows` (similarity, ai, n, high_similarity, high_ai, hidden) with explanation and summary; hidden: names of grave flags, null if none."""
    rows = rows.withColumn("s", percent(F.col("similarity"))).withColumn("a", percent(F.col("ai")))

    def first(choices: tuple) -> Column:
        out = None
        for condition, template in choices:
            out = F.when(F.expr(condition), _filled(template)) if out is None else out.when(F.expr(condition), _filled(template))
        return out

    return rows.withColumn("explanation", F.concat_ws(" ", first(_SIMILAR), first(_MACHINE), F.when(F.col("hidden").isNotNull(), _filled(_HIDDEN)))).withColumn("summary", _filled(_SUMMARY))


_D_EXPLAINED = f"""{_SCORES}, f AS (SELECT job_id, string_agg(DISTINCT type, ', ' ORDER BY type) AS hidden FROM obfuscation_flags WHERE severity = 'HIGH' AND type IS NOT NULL GROUP BY job_id),
e AS (SELECT r.job_id, n, high_similarity, high_ai, hidden, similarity, ai, {_d_percent('similarity')} AS s, {_d_percent('ai')} AS a FROM (SELECT job_id, n, high_similarity, high_ai, coalesce(similarity, 0.0) AS similarity, coalesce(ai, 0.0) AS ai FROM r) r LEFT JOIN f ON f.job_id = r.job_id),
x AS (SELECT *, concat_ws(' ', CASE {' '.join(f'WHEN {c} THEN {_d_filled(t)}' for c, t in _SIMILAR)} END, CASE {' '.join(f'WHEN {c} THEN {_d_filled(t)}' for c, t in _MACHINE)} END, CASE WHEN hidden IS NOT NULL THEN {_d_filled(_HIDDEN)} END) AS explanation, {_d_filled(_SUMMARY)} AS summary FROM e)"""


def _explained(spark: SparkSession, d: str) -> DataFrame:
    grave = table(spark, d, "obfuscation_flags").where("severity = 'HIGH' and type is not null").groupBy("job_id").agg(F.array_join(F.array_sort(F.collect_set("type")), ", ").alias("hidden"))  # of one job
    return explained(_scores(spark, d).na.fill(0.0, ["similarity", "ai"]).join(grave, "job_id", "left"))


@query(f"WITH {_D_EXPLAINED} SELECT job_id, explanation, summary FROM x")
def risk_texts(spark, d):
    """The explanation and the plain summary of each job's scores."""
    return _explained(spark, d).select("job_id", "explanation", "summary")


_D_BAND = "CASE WHEN similarity >= 0.35 OR ai >= 0.50 THEN 'HIGH' WHEN similarity >= 0.15 OR ai >= 0.22 THEN 'MODERATE' ELSE 'LOW' END"


@query(
    f"""WITH {_D_EXPLAINED}, u AS (SELECT DISTINCT sent_id, job_id, sources FROM sentences WHERE job_id IS NOT NULL AND sources IS NOT NULL), m AS (SELECT job_id, unnest(sources) AS m FROM u),
    src AS (SELECT job_id, m.url AS url, max(m.match_percentage) AS best, min(m.title) AS title FROM m WHERE m.url IS NOT NULL GROUP BY job_id, m.url), t15 AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY best DESC, url) AS r FROM src QUALIFY r <= 15),
    s1 AS (SELECT * FROM sentences WHERE job_id IS NOT NULL AND sent_idx IS NOT NULL AND text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sent_id ORDER BY scored_at DESC NULLS LAST, sent_idx, text, similarity_score NULLS FIRST, ai_probability NULLS FIRST) = 1), s50 AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY sent_idx, sent_id) AS r FROM s1 QUALIFY r <= 50)
    SELECT job_id, 'summary' AS section, 1 AS ord, summary AS line FROM x UNION ALL SELECT job_id, 'scores', 1, 'Similarity Score : ' || {_d_percent('similarity', 2)} || '%' FROM x UNION ALL SELECT job_id, 'scores', 2, 'AI Probability   : ' || {_d_percent('ai', 2)} || '%' FROM x UNION ALL SELECT job_id, 'scores', 3, 'Risk Band        : ' || {_D_BAND} FROM x
    UNION ALL SELECT job_id, 'sources', r, r::VARCHAR || '. ' || coalesce(title, '') || ' | ' || {_d_percent('best / 100', 2)} || '% | ' || url FROM t15 UNION ALL SELECT job_id, 'sentences', r, '[' || r::VARCHAR || '] ' || substr(text, 1, 200) FROM s50"""
)
def report_lines(spark, d):
    """A printed report as lines: summary, scores, the 15 best sources and the first 50 sentences cut at 200 characters."""
    x = _explained(spark, d).withColumn("band", F.expr(_D_BAND))
    line = lambda section, ord_, value: F.struct(F.lit(section).alias("section"), F.lit(ord_).alias("ord"), value.alias("line"))
    lines = F.array(
        line("summary", 1, F.col("summary")), line("scores", 1, F.concat(F.lit("Similarity Score : "), percent(F.col("similarity"), 2), F.lit("%"))),
        line("scores", 2, F.concat(F.lit("AI Probability   : "), percent(F.col("ai"), 2), F.lit("%"))), line("scores", 3, F.concat(F.lit("Risk Band        : "), "band")),
    )
    head = x.select("job_id", F.inline(lines))
    found = table(spark, d, "sentences").where("job_id is not null").select("sent_id", "job_id", "sources").distinct().select("job_id", F.explode("sources").alias("m")).where("m.url is not null")
    found = found.groupBy("job_id", F.col("m.url").alias("url")).agg(F.max("m.match_percentage").alias("best"), F.min("m.title").alias("title"))
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("best"), "url"))).where("r <= 15")
    best = best.select("job_id", F.lit("sources").alias("section"), F.col("r").alias("ord"), F.concat(F.col("r").cast("string"), F.lit(". "), F.coalesce("title", F.lit("")), F.lit(" | "), percent(F.col("best") / 100, 2), F.lit("% | "), "url").alias("line"))
    one = Window.partitionBy("sent_id").orderBy(F.col("scored_at").desc_nulls_last(), "sent_idx", "text", "similarity_score", "ai_probability")
    s = table(spark, d, "sentences").where("job_id is not null and sent_idx is not null and text is not null").withColumn("one", F.row_number().over(one)).where("one = 1")
    s = s.withColumn("r", F.row_number().over(Window.partitionBy("job_id").orderBy("sent_idx", "sent_id"))).where("r <= 50")
    return head.unionByName(best).unionByName(s.select("job_id", F.lit("sentences").alias("section"), F.col("r").alias("ord"), F.concat(F.lit("["), F.col("r").cast("string"), F.lit("] "), F.substring("text", 1, 200)).alias("line")))


@query(f"WITH {_D_EXPLAINED} SELECT job_id, concat_ws(chr(10), 'Similarity Score : ' || {_d_percent('similarity', 2)} || '%', 'AI Probability   : ' || {_d_percent('ai', 2)} || '%', 'Risk Band        : ' || {_D_BAND}, '', explanation, '', 'Job ID: ' || job_id) AS body FROM x")
def mail_texts(spark, d):
    """The text of the message that tells of a finished scan."""
    x = _explained(spark, d).withColumn("band", F.expr(_D_BAND))
    parts = (F.concat(F.lit("Similarity Score : "), percent(F.col("similarity"), 2), F.lit("%")), F.concat(F.lit("AI Probability   : "), percent(F.col("ai"), 2), F.lit("%")), F.concat(F.lit("Risk Band        : "), "band"), F.lit(""), F.col("explanation"), F.lit(""), F.concat(F.lit("Job ID: "), "job_id"))
    return x.select("job_id", F.concat_ws("\n", *parts).alias("body"))


def signed_payloads(rows: DataFrame, secret: str, stamp: str = "stamp", body: str = "body") -> DataFrame:
    """`rows` with signature: HMAC-SHA256 of `stamp.body`, in hexadecimal; null without a body."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        import hmac

        for batch in batches:
            signature = [hmac.new(secret.encode(), f"{s}.{b}".encode(), hashlib.sha256).hexdigest() if b is not None else None for s, b in zip(batch[stamp], batch[body])]
            yield batch.assign(signature=pd.Series(signature, index=batch.index, dtype=object))

    return rows.mapInPandas(sign, StructType([*rows.schema.fields, StructField("signature", StringType())]))


@query(f"WITH {_D_EXPLAINED} SELECT job_id, 'scan.complete' AS event, {_D_BAND} AS band, md5(summary) AS digest FROM x")
def scan_events(spark, d):
    """What is sent on when a scan is complete."""
    return _explained(spark, d).select("job_id", F.lit("scan.complete").alias("event"), F.expr(_D_BAND).alias("band"), F.md5("summary").alias("digest"))


@query("SELECT DISTINCT sent_id, CASE WHEN is_citation THEN 'citation' WHEN similarity_score >= 0.3 AND ai_probability >= 0.6 THEN 'both' WHEN similarity_score >= 0.3 THEN 'plagiarism' WHEN ai_probability >= 0.6 THEN 'ai' ELSE 'clean' END AS class, NOT coalesce(is_citation, false) AND coalesce(similarity_score > 0.1 OR ai_probability > 0.1, false) AS rewritable FROM sentences")
def sentence_classes(spark, d):
    """How a reader's view marks each sentence, and whether it offers to rewrite it."""
    similar, machine = F.col("similarity_score"), F.col("ai_probability")
    kind = F.when(F.col("is_citation"), "citation").when((similar >= 0.3) & (machine >= 0.6), "both").when(similar >= 0.3, "plagiarism").when(machine >= 0.6, "ai").otherwise("clean")
    return table(spark, d, "sentences").select("sent_id", kind.alias("class"), (~F.coalesce("is_citation", F.lit(False)) & F.coalesce((similar > 0.1) | (machine > 0.1), F.lit(False))).alias("rewritable")).distinct()


@query(
    f"""WITH {DOCS}, {_PARA}, v AS (SELECT id, para_idx, {d_rounded('coalesce(avg(s), 0.0)', 4)} AS s, {d_rounded('coalesce(avg(a), 0.0)', 4)} AS a FROM x LEFT JOIN m ON x.sentence = m.text GROUP BY id, para_idx)
    SELECT id, para_idx::INT AS para_idx, CASE WHEN s > a THEN 'plagiarism' ELSE 'ai' END AS dominant, greatest(s, a) AS intensity FROM v"""
)
def paragraph_signals(spark, d):
    """The stronger signal of each paragraph."""
    s, a = F.col("avg_similarity"), F.col("avg_ai")
    return paragraph_scores(spark, d).select("id", "para_idx", F.when(s > a, "plagiarism").otherwise("ai").alias("dominant"), F.greatest(s, a).alias("intensity"))


@query(
    f"""WITH c AS (SELECT job_id, detection_method, count(*) AS n FROM (SELECT DISTINCT sent_id, job_id, detection_method FROM sentences WHERE NOT coalesce(is_citation, false) AND job_id IS NOT NULL AND detection_method <> 'none') GROUP BY job_id, detection_method)
    SELECT job_id, detection_method, n, {_d_percent('n / sum(n) OVER (PARTITION BY job_id)')} AS share FROM c"""
)
def method_shares(spark, d):
    """The share of each detection method among a job's sentences that have one."""
    s = table(spark, d, "sentences").where(~F.coalesce("is_citation", F.lit(False))).where("job_id is not null and detection_method <> 'none'").select("sent_id", "job_id", "detection_method").distinct()
    c = s.groupBy("job_id", "detection_method").agg(F.count("*").alias("n"))
    return c.withColumn("share", percent(F.col("n") / F.sum("n").over(Window.partitionBy("job_id"))))


@query(f"WITH {_SCORES} SELECT job_id, {_d_percent('similarity')} || '%' AS label, floor(similarity * 180 + 0.5)::INT AS angle FROM r WHERE similarity IS NOT NULL")
def score_labels(spark, d):
    """The similarity of each job as a percentage and as a gauge's angle."""
    s = F.col("similarity")
    return _scores(spark, d).where("similarity is not null").select("job_id", F.concat(percent(s), F.lit("%")).alias("label"), F.floor(s * 180 + 0.5).cast("int").alias("angle"))


@query(
    f"""WITH {CORPUS}, {_IDF}, {SENTENCES}, {_WEIGHTS}, norm AS (SELECT sent_id, sqrt(sum(w * w)) AS n FROM w GROUP BY sent_id), k AS (SELECT DISTINCT sent_id, job_id FROM s WHERE job_id IS NOT NULL),
    x AS (SELECT k.job_id, w.* FROM w JOIN k ON k.sent_id = w.sent_id), dots AS (SELECT a.sent_id AS a, b.sent_id AS b, sum(a.w * b.w) AS dot FROM x a JOIN x b ON a.job_id = b.job_id AND a.term = b.term AND a.sent_id <> b.sent_id GROUP BY a.sent_id, b.sent_id),
    best AS (SELECT a, b, {d_rounded('dot / (p.n * q.n)', 4)} AS cosine FROM dots JOIN norm p ON p.sent_id = a JOIN norm q ON q.sent_id = b)
    SELECT a AS sent_id, b AS best, cosine FROM best QUALIFY row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) = 1"""
)
def best_cosine(spark, d):
    """The sentence of the same job that is most similar by TF-IDF cosine; a job's sentences meet by the terms that they share."""
    w = _weights(spark, d)
    norm = w.groupBy("key").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    of = w.join(norm, "key").join(_sentences(spark, d).where("job_id is not null").select(F.col("sent_id").alias("key"), "job_id").distinct(), "key")
    return similarity.best_match(of.select("key", F.col("job_id").alias("group"), "term", (F.col("weight") / F.col("norm")).alias("weight"))).select(F.col("key").alias("sent_id"), "best", "cosine")


