"""Queries over records: listings, look-ups, versions, retention, validation and outside answers as documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import text
from quillmesh.operators import store
from quillmesh.queries import DOCS, WS, d_tokens, query
from quillmesh.sources import live
from quillmesh.tables import table

JOB = "file_name string, created_at string, updated_at string, scan_version int, error string, parent_job_id string, report struct<risk_band: string, metadata: struct<language: string, word_count: int>>, _bad string"


def _j(path: str, kind: str = "VARCHAR") -> str:
    value = f"json_extract_string(json, '$.{path}')"
    return f"CASE WHEN json_valid(json) THEN {value if kind == 'VARCHAR' else f'TRY_CAST({value} AS {kind})'} END"


_LAST = f"""last AS (SELECT seq, job_id, org_id, status, {_j('file_name')} AS file_name, {_j('created_at')} AS created_at, {_j('updated_at')} AS updated_at, coalesce({_j('scan_version', 'INT')}, 1) AS scan_version, {_j('error')} AS error,
    {_j('parent_job_id')} AS parent, {_j('report.risk_band')} AS risk_band, {_j('report.metadata.word_count', 'INT')} AS word_count, json_valid(json) AND json_type(json, '$.report') = 'OBJECT' AS reported
    FROM jobs WHERE job_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) = 1)"""


def last_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of each job with the fields of its stored record; those of an unreadable record are null."""
    jobs = store.latest(table(spark, d, "jobs").where("job_id is not null").select("seq", "job_id", "org_id", "status", "json"), "job_id", F.col("seq"))
    x = F.from_json("json", JOB, {"columnNameOfCorruptRecord": "_bad"})
    read = jobs.withColumn("x", F.when(x["_bad"].isNull(), x)).drop("json")
    return read.select(
        "seq", "job_id", "org_id", "status", "x.file_name", "x.created_at", "x.updated_at", F.coalesce("x.scan_version", F.lit(1)).alias("scan_version"), "x.error",
        F.col("x.parent_job_id").alias("parent"), "x.report.risk_band", "x.report.metadata.word_count", F.coalesce(F.col("x.report").isNotNull(), F.lit(False)).alias("reported"),
    )


@query(f"WITH {_LAST} SELECT job_id, org_id, status, file_name, created_at, updated_at, scan_version, risk_band FROM last")
def submission_listing(spark, d):
    """One row for each job, as a listing shows it."""
    return last_jobs(spark, d).select("job_id", "org_id", "status", "file_name", "created_at", "updated_at", "scan_version", "risk_band")


@query(f"WITH {_LAST} SELECT job_id, status, error, created_at, updated_at, scan_version, parent FROM last")
def submission_status(spark, d):
    return last_jobs(spark, d).select("job_id", "status", "error", "created_at", "updated_at", "scan_version", "parent")


@query(
    f"""WITH RECURSIVE {_LAST}, u AS (SELECT job_id AS id, CASE WHEN parent <> job_id THEN parent END AS up FROM last),
    w AS (SELECT id, coalesce(up, id) AS root, CASE WHEN up IS NULL THEN 0 ELSE 1 END AS depth FROM u UNION ALL SELECT w.id, u.up, w.depth + 1 FROM w JOIN u ON u.id = w.root WHERE u.up IS NOT NULL AND w.depth > 0 AND w.depth < (SELECT greatest(64, count(*)) FROM u)),
    c AS (SELECT id, max_by(root, depth) AS root, max(depth)::INT AS depth FROM w GROUP BY id)
    SELECT root, job_id, depth, scan_version, status, risk_band, word_count FROM c JOIN last ON id = job_id"""
)
def submission_history(spark, d):
    """Every job under the first scan of its chain."""
    jobs = last_jobs(spark, d)
    return store.chains(jobs.select("job_id", "parent"), "job_id", "parent").withColumnRenamed("id", "job_id").join(jobs, "job_id").select("root", "job_id", "depth", "scan_version", "status", "risk_band", "word_count")


@query(
    f"""WITH {_LAST}, a AS (SELECT DISTINCT id, job_id, org_id FROM audit_log WHERE id IS NOT NULL AND job_id IS NOT NULL)
    SELECT a.id, coalesce(l.org_id = a.org_id, false) AS found, coalesce(l.org_id = a.org_id AND l.status = 'complete' AND reported, false) AS ready FROM a LEFT JOIN last l ON a.job_id = l.job_id"""
)
def tenant_lookups(spark, d):
    """Whether the job that an audited request names is found, which it is only for its own organisation, and has a report."""
    asked = table(spark, d, "audit_log").where("id is not null and job_id is not null").select("id", "job_id", F.col("org_id").alias("asker")).distinct()
    met = asked.join(last_jobs(spark, d).select("job_id", "org_id", "status", "reported"), "job_id", "left")
    own, no = F.col("org_id") == F.col("asker"), F.lit(False)
    return met.select("id", F.coalesce(own, no).alias("found"), F.coalesce(own & (F.col("status") == "complete") & F.col("reported"), no).alias("ready"))


@query("SELECT DISTINCT id, org_id, title, url, epoch_us(created_at) AS created_us, batch_no FROM corpus_docs")
def corpus_listing(spark, d):
    """Corpus documents without their contents."""
    return table(spark, d, "corpus_docs").withColumn("created_us", F.unix_micros("created_at")).drop("content", "created_at").distinct()


_KEYS = "k AS (SELECT api_key_id AS id, sha256(api_key_id) AS key_hash, min(org_id) AS org_id, max(created_at) >= TIMESTAMPTZ '2025-10-01 00:00:00+00' AS active FROM audit_log WHERE api_key_id IS NOT NULL GROUP BY api_key_id)"


def _keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys as the audit log knows them; one unused since October counts as inactive."""
    rows = table(spark, d, "audit_log").where("api_key_id is not null").groupBy(F.col("api_key_id").alias("id")).agg(F.min("org_id").alias("org_id"), (F.max("created_at") >= F.lit("2025-10-01 00:00:00").cast("timestamp")).alias("active"))
    return rows.withColumn("key_hash", F.sha2("id", 256))


@query(f"WITH {_KEYS} SELECT id, org_id, active FROM k")
def key_listing(spark, d):
    """Keys without their hashes."""
    return _keys(spark, d).drop("key_hash")


@query(f"WITH {_KEYS} SELECT seq, k.id AS key_id, k.org_id AS key_org FROM audit_log a JOIN k ON sha256(a.api_key_id) = k.key_hash AND k.active")
def key_lookup(spark, d):
    """The active key whose hash is that of each request's credential."""
    asked = table(spark, d, "audit_log").where("api_key_id is not null").select("seq", F.sha2("api_key_id", 256).alias("key_hash"))
    return asked.join(_keys(spark, d).where("active").select("key_hash", F.col("id").alias("key_id"), F.col("org_id").alias("key_org")), "key_hash").drop("key_hash")


@query(
    f"""WITH {_LAST} SELECT job_id, org_id, file_name, count(*) FILTER (status = 'complete') OVER w + 1 AS version, last_value(CASE WHEN status = 'complete' THEN job_id END IGNORE NULLS) OVER w AS parent FROM last
    WHERE org_id IS NOT NULL AND file_name IS NOT NULL WINDOW w AS (PARTITION BY org_id, file_name ORDER BY created_at NULLS FIRST, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)
def file_versions(spark, d):
    """Each job's version among the scans of the same file of its organisation, and the finished scan before it."""
    jobs = last_jobs(spark, d).where("org_id is not null and file_name is not null").select("job_id", "org_id", "file_name", "created_at", "status")
    return store.versions(jobs, ["org_id", "file_name"], ["created_at", "job_id"], F.col("status") == "complete").select("job_id", "org_id", "file_name", "version", "parent")


_EXT = "lower(regexp_extract(file_name, '[^.]*$'))"


@query(f"WITH {_LAST} SELECT job_id, o.name AS org_name, coalesce(o.student_source_reveal, false) AS reveals, o.id IS NULL OR coalesce(list_contains(o.allowed_file_types, {_EXT}), true) AS allowed FROM last l LEFT JOIN orgs o ON l.org_id = o.id WHERE file_name IS NOT NULL")
def job_org_config(spark, d):
    """Each job with its organisation's settings, and whether they take its type of file; without an organisation any is taken."""
    orgs = table(spark, d, "orgs").select(F.col("id").alias("org"), F.col("name").alias("org_name"), "student_source_reveal", "allowed_file_types")
    jobs = last_jobs(spark, d).where("file_name is not null").join(F.broadcast(orgs), F.col("org_id") == F.col("org"), "left")  # one row for each organisation: a fixed table
    allowed = F.col("org").isNull() | F.coalesce(F.array_contains("allowed_file_types", text.extension(F.col("file_name"))), F.lit(True))
    return jobs.select("job_id", "org_name", F.coalesce("student_source_reveal", F.lit(False)).alias("reveals"), allowed.alias("allowed"))


@query("SELECT seq, id, event_type FROM audit_log ORDER BY seq DESC LIMIT 10000")
def audit_retained(spark, d):
    """What a compaction to the newest 10,000 entries keeps."""
    return store.newest(table(spark, d, "audit_log").select("seq", "id", "event_type"), "seq", 10_000)


@query(
    f"""SELECT DISTINCT id, CASE WHEN org_id IS NULL OR org_id = '' THEN 'org_id' WHEN title IS NULL OR title = '' THEN 'title' WHEN url IS NULL OR NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^{WS}/]+') THEN 'url'
    WHEN content IS NULL OR content = '' THEN 'content' ELSE 'valid' END AS outcome FROM corpus_docs"""
)
def corpus_upload(spark, d):
    """Each uploaded document with what an upload's validation says: valid, or the first field that fails."""
    return table(spark, d, "corpus_docs").select("id", store.upload_outcome().alias("outcome")).distinct()


@query(f"WITH {DOCS} SELECT id, len({d_tokens('content')})::INT AS n_tokens, len(list_filter(regexp_split_to_array(content, '[{WS}]+'), lambda w: w <> ''))::INT AS n_words FROM d")
def document_counts(spark, d):
    """Tokens and white-space words of each document."""
    docs = table(spark, d, "corpus_docs").select("id", "content").where("content is not null").distinct()
    return docs.select("id", F.size(text.tokens(F.col("content"))).alias("n_tokens"), F.size(F.filter(F.split("content", text.SPACES), lambda w: w != "")).alias("n_words"))


@query("SELECT sent_id, substr(sha1(text), 1, 8) AS short_hash, sha1(lower(text)) AS cache_key FROM (SELECT DISTINCT sent_id, text FROM sentences WHERE text IS NOT NULL AND regexp_matches(text, '^[\\x00-\\x7F]*$'))")
def sentence_hashes(spark, d):
    """Short hash and cache key of each plain sentence (lower-casing beyond ASCII differs between engines)."""
    s = table(spark, d, "sentences").where("text is not null").where(F.col("text").rlike(r"^[\x00-\x7F]*$")).select("sent_id", "text").distinct()
    return s.select("sent_id", F.substring(F.sha1("text"), 1, 8).alias("short_hash"), live.cache_key(F.col("text")).alias("cache_key"))


@query("SELECT seq, CASE WHEN ip IS NULL THEN 'unknown' ELSE ip END AS client FROM audit_log")
def client_ips(spark, d):
    """The client's address: the first element of a forwarding header as a chain of proxies writes it."""
    header = F.concat(F.lit(" "), "ip", F.lit(" , 198.51.100.7, 192.0.2.1"))
    return table(spark, d, "audit_log").select("seq", store.client_ip(header).alias("client"))


# --- outside answers --------------------------------------------------------------------------


def _words(content: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(content, f"[{text.SPACE_SET}]+", " "), " "), lambda w: w != "")


def _indexed(docs: DataFrame, key: str, words: str) -> DataFrame:
    """`docs` with an inverted index of its words, as a service sends it: word to positions."""
    at = docs.select(key, F.posexplode(words).alias("p", "w")).groupBy(key, "w").agg(F.array_sort(F.collect_list("p")).alias("ps"))  # of one document
    return docs.join(at.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("index")), key, "left")


@query(f"WITH {DOCS}, w AS (SELECT id, array_to_string(list_filter(regexp_split_to_array(content, '[{WS}]+'), lambda w: w <> ''), ' ') AS abstract FROM d) SELECT DISTINCT id, coalesce(abstract, '') AS abstract FROM w")
def inverted_abstract(spark, d):
    """Contents rebuilt from their inverted indexes."""
    docs = table(spark, d, "corpus_docs").select("id", "content").where("content is not null").distinct().select("id", F.xxhash64("id", "content").alias("k"), _words(F.col("content")).alias("words"))
    return _indexed(docs, "k", "words").select("id", F.coalesce(live.inverted_text(F.col("index")), F.lit("")).alias("abstract")).distinct()


_ONE = "one AS (SELECT org_id AS query, id, trim(title) AS title, url, content FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY batch_no, created_at NULLS LAST, content) AS r FROM corpus_docs WHERE id IS NOT NULL AND org_id IS NOT NULL AND content IS NOT NULL) WHERE r = 1)"


@query(
    f"""WITH {_ONE}, n AS (SELECT *, coalesce(nullif(title, ''), 'Untitled work') AS t1, coalesce(nullif(title, ''), 'Untitled entry') AS t2, array_to_string(list_filter(regexp_split_to_array(content, '[{WS}]+'), lambda w: w <> ''), ' ') AS words, row_number() OVER (PARTITION BY query ORDER BY id) - 1 AS place FROM one),
    s AS (SELECT query, place, 0 AS source, t1 AS title, coalesce('https://doi.org/' || url, id) AS url, trim(t1 || '. ' || words) AS content FROM n
        UNION ALL SELECT query, place, 1, t2, coalesce('https://doi.org/' || url, 'unknown'), trim(t2 || '. ' || words) FROM n
        UNION ALL SELECT query, 0, 2, title, coalesce(url, 'unknown'), title || '. ' || trim(words) FROM n WHERE length(trim(words)) >= 80),
    k AS (SELECT * FROM s WHERE length(content) >= 80 QUALIFY row_number() OVER (PARTITION BY query, lower(title), lower(url) ORDER BY source, place, url NULLS FIRST) = 1)
    SELECT query, title, url, content FROM k QUALIFY row_number() OVER (PARTITION BY query ORDER BY source, place, url NULLS FIRST) <= 40"""
)
def live_corpus(spark, d):
    """Answers of three services, made up from the corpus documents, parsed and brought together for each organisation."""
    first = store.Window.partitionBy("id").orderBy("batch_no", F.col("created_at").asc_nulls_last(), "content")
    one = table(spark, d, "corpus_docs").where("id is not null and org_id is not null and content is not null").withColumn("r", F.row_number().over(first)).where("r = 1")
    one = one.select(F.col("org_id").alias("query"), "id", F.trim("title").alias("title"), "url", _words(F.col("content")).alias("words"))
    every = store.Window.partitionBy("query").orderBy("id")
    one = _indexed(one.withColumn("nth", F.row_number().over(every) - 1), "id", "words")
    # Each document is one answer's entry; its place is its number among the organisation's documents.
    work = F.to_json(F.struct(F.array(F.struct(F.col("id"), F.col("url").alias("doi"), F.col("title"), F.col("index").alias("abstract_inverted_index"))).alias("results")))
    entry = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("url").alias("DOI"), F.array("title").alias("title"), F.concat(F.lit("<p>"), F.array_join("words", " "), F.lit("</p>")).alias("abstract"))).alias("items")).alias("message")))
    page = F.to_json(F.struct("title", F.array_join("words", " ").alias("extract"), F.struct(F.struct(F.col("url").alias("page")).alias("desktop")).alias("content_urls")))
    named = lambda body: one.select(F.concat_ws("\u0000", "query", F.col("nth").cast("string")).alias("query"), body.alias("body"))

    def back(docs: DataFrame, at: Column) -> DataFrame:
        return docs.withColumn("place", at).withColumn("query", F.element_at(F.split("query", "\u0000"), 1))

    nth = F.element_at(F.split("query", "\u0000"), 2).cast("int")
    found = live.live_corpus(back(live.works(named(work)), nth), back(live.registry(named(entry)), nth), back(live.summaries(named(page)), F.lit(0)))
    return found.select("query", "title", "url", "content")


@query(
    """WITH RECURSIVE e AS (SELECT event_id, user_id || '/' || event_type AS k, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id || '/' || event_type ORDER BY epoch_us(ts) / 1e6, event_id) AS r FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL),
    w AS (SELECT k, event_id, r, t AS start, true AS missed FROM e WHERE r = 1 UNION ALL SELECT e.k, e.event_id, e.r, CASE WHEN e.t > w.start + 86400 THEN e.t ELSE w.start END, e.t > w.start + 86400 FROM w JOIN e ON e.k = w.k AND e.r = w.r + 1)
    SELECT event_id, missed FROM w"""
)
def cache_misses(spark, d):
    """Requests that a cache of a day's life doesn't answer: an entry is written by a miss and serves until it expires."""
    from quillmesh.streaming.limiter import limited

    asked = table(spark, d, "events").withColumn("k", F.concat_ws("/", F.col("user_id").cast("string"), "event_type")).where("user_id is not null and event_type is not null")
    return limited(asked, "k", "ts", "event_id", most=1, seconds=86_400).select("event_id", F.col("allowed").alias("missed"))


_CROSS = f"WITH {_LAST}, f AS (SELECT org_id, job_id, row_number() OVER (PARTITION BY org_id ORDER BY seq DESC) AS r FROM last WHERE status = 'complete' AND reported AND org_id IS NOT NULL), n AS (SELECT org_id, job_id, r, count(*) OVER (PARTITION BY org_id) AS n FROM f), d AS (SELECT DISTINCT id, org_id FROM corpus_docs WHERE id IS NOT NULL)"


@query(
    f"""{_CROSS} SELECT n.job_id, least(n.n - 1, 250) AS others, (SELECT count(*) FROM d WHERE org_id = 'global') + coalesce(o.own, 0) AS docs
    FROM n LEFT JOIN (SELECT org_id, count(*) AS own FROM d WHERE org_id <> 'global' GROUP BY org_id) o ON o.org_id = n.org_id"""
)
def scan_corpus(spark, d):
    """How much each finished job is compared with: documents that its organisation sees, and its newest 250 other finished jobs."""
    done = last_jobs(spark, d).where("status = 'complete' and reported and org_id is not null")
    sizes = done.groupBy("org_id").agg(F.count("*").alias("n"))
    docs = table(spark, d, "corpus_docs").where("id is not null").select("id", "org_id").distinct().groupBy("org_id").agg(F.count("*").alias("own"))
    shared = docs.where("org_id = 'global'").agg(F.coalesce(F.max("own"), F.lit(0)).alias("n"))
    met = done.join(sizes, "org_id").join(docs.where("org_id <> 'global'"), "org_id", "left")
    return spark.sql("SELECT job_id, least(n - 1, 250) AS others, (SELECT n FROM {shared}) + coalesce(own, 0) AS docs FROM {met}", shared=shared, met=met)


